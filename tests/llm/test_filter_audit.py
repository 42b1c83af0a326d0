"""The streaming audit of filters against plain Python, with retractions, nulls and repeated rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from scoremill.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string, h1 string, n int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, total = {}, Counter()
    parts = defaultdict(list)
    for i, t, p in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)))) if x}
        parts[p].append((i, fails | ({"E"} if i is not None and i > least[t] else set())))
    for p, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            gone = [False] * len(rows)
            for k, c in enumerate(order):
                cell = Counter()
                for n, (i, fails) in enumerate(rows):
                    cell["unique_fails"] += fails == {c}
                    if c in fails and gone[n]:
                        cell["redundant"] += 1
                    elif c in fails:
                        gone[n] = True
                        cell["removed"] += 1
                        cell["good_lost"] += i in good
                        cell["toxic_lost"] += i in toxic
                cell["kept"] = gone.count(False)
                total[p, c] += cell["removed"]
                out[p, "".join(order), k + 1] = cell
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: (*(c[n] for n in names), total[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def found(spark, path, labels):
    df = fa.audit(spark, path, spark.createDataFrame(labels, LABELS))
    rows = df.collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def written(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(folder)
    return folder


LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [None, "", " \n", "A", "a$b", "x " * 300, LONG, LONG + " #", LONG.upper(), "é" * 40 + "AB", "\x00 \x1f", LONG + " z"]


def test_retractions_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fa, "TEXTS", 7)
    rng = random.Random(2)
    rows = [(i, rng.choice(TEXTS), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(None, t, "en") for t in TEXTS] + [(-5, LONG, "fr"), (-5, LONG, "fr"), (-5, LONG, "de"), (7, "", None)]
    rows.sort(key=lambda r: -r[0] if r[0] is not None else 0)  # smaller ids arrive later
    batches = [rows[k : k + 20] for k in range(0, len(rows), 20)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(-5, 120)] + [(None, 1, 1), (4, None, None), (4, 1, 0), (9999, 1, 1)]
    labels = [(i, q, int(x) if x is not None else None) for i, q, x in labels]
    path = written(spark, str(tmp_path / "docs"), batches)
    assert found(spark, path, labels) == brute(rows, labels)


def test_one_file_and_hot_text(spark, tmp_path):
    rows = [(i, LONG if i % 3 else f"{LONG} {i}", "en") for i in range(600, 0, -1)]
    path = written(spark, str(tmp_path / "docs"), [rows])
    file = next((tmp_path / "docs").glob("*.parquet"))
    expected = brute(rows, [])
    assert found(spark, str(file), []) == expected == found(spark, path, [])


def test_empty_table(spark, tmp_path):
    path = written(spark, str(tmp_path / "docs"), [[]])
    assert found(spark, path, [(1, 1, 1)]) == {}


@pytest.mark.parametrize("text, mask", [("", 1), ("a " * 200, 2), (LONG, 0), (LONG + " B" * 50 + "%", 12), ("A", 5)])
def test_masks(text, mask):
    assert fa.Rules().failed(text) == mask


def test_very_long_text():
    assert fa.Rules().failed("word " * 4_000_000) == 2
