"""Secret scans: three fixed patterns, and windows of high character entropy in long unbroken strings.

Everything is an expression over one row: no shuffle, no Python. Spans are code points, end exclusive. A span's
place follows from the lengths of the text between matches and of the matches, added up from the left.

Entropy: candidate strings are unbroken runs of ``CANDIDATE`` characters. Each has a character class with its
own threshold. A window of ``WINDOW`` characters slides over it; counts per character and the sum of
``c * log2(c)`` change by the character that enters and the one that leaves. That sum is held in whole
millionths of a bit, so that it never drifts. Overlapping windows above the threshold form one span.
Strings that match the allow-list (identifiers, paths of words) are left out. Names in camel case, placeholders and
alphabets are judged by path segment: what lies between two slashes is blanked, and the rest of the string is scanned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.llm.words import text_of

# Fixed values of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # same matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # whole runs of 24 characters or more
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
UNIT = 1_000_000
STEP = 256  # running sums are put together from pieces of this length; changes no result


@dataclass(frozen=True)
class EntropyRules:
    """Thresholds in bits a character by class, tested in this order; the last class takes the rest."""

    classes: tuple[tuple[str, str, float], ...] = (
        ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
        ("letters", r"^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", 3.8),
        ("alnum", r"^[A-Za-z0-9]+$", 3.7),
        ("symbols", r"", 3.9),
    )
    allow: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^[A-Za-z]{1,20}([/_-]([A-Za-z]{1,20}|[0-9]{1,4}))+$",
    )
    allow_segments: tuple[str, ...] = (
        r"(?i)example|sample|placeholder|changeme|your[_-]",
        r"(?i)abcdefghij|0123456789",
        r"^([a-z]+|[A-Z][a-z]+)([A-Z][a-z]+)+[0-9]{0,3}$",
    )
    window: int = field(default=WINDOW)


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, put together from pieces so that no long array is copied per element."""
    zero = F.lit(0)
    empty = F.array().cast("array<int>")

    def piece(state, number):
        inner = F.aggregate(
            F.slice(lengths, number * STEP + 1, F.lit(STEP)),
            F.struct(state["at"].alias("at"), empty.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")
            ),
        )
        return F.transform(
            F.array(inner),
            lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], F.array(i["out"])).alias("out")),
        )[0]

    pieces = F.sequence(zero, F.floor((F.size(lengths) - 1) / STEP).cast("int"))
    start = F.struct(zero.alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.when(F.size(lengths) > 0, F.flatten(F.aggregate(pieces, start, piece)["out"])).otherwise(empty)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of struct(start, end, match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def place(parts: Column) -> Column:
        found, between = parts["found"], parts["between"]
        lengths = F.flatten(
            F.transform(found, lambda m, i: F.array(F.char_length(F.get(between, i)), F.char_length(m)))
        )
        return F.transform(
            F.array(_running(lengths)),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(ends, i * 2).alias("start"), F.get(ends, i * 2 + 1).alias("end"), m.alias("match")
                ),
            ),
        )[0]

    return F.transform(F.array(F.struct(found.alias("found"), between.alias("between"))), place)[0]


def _spans(text: Column, kind: int, pattern: str, might: Column, keep=None) -> Column:
    """Spans of one kind as array of struct(start, kind, end), empty where ``might`` says that none can be."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["match"]))
    out = F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )
    return F.when(might, out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _weight_table(window: int) -> list[int]:
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def entropy_limit(threshold: float, window: int = WINDOW) -> int:
    """Largest sum of c * log2(c), in units, of a window whose entropy reaches the threshold."""
    return math.floor((window * (math.log2(window) - threshold)) * UNIT)


def _hot_windows(match: Column, rules: EntropyRules) -> Column:
    """Array of struct(start, end) within one candidate: merged windows that reach its class's threshold."""
    w = rules.window
    table = F.array(*[F.lit(v).cast("bigint") for v in _weight_table(w)])
    limit = F.lit(entropy_limit(rules.classes[-1][2], w))
    for _, pattern, threshold in reversed(rules.classes[:-1]):
        limit = F.when(match.rlike(pattern), F.lit(entropy_limit(threshold, w))).otherwise(limit)
    weight = lambda c: F.get(table, c)

    def slide(state, i):
        codes, counts = state["codes"], state["counts"]
        old = F.when(i >= w, F.get(codes, i - w)).otherwise(-1)
        new = F.get(codes, i)

        def step(x):
            gone, come = x["old"], x["new"]
            changed = F.transform(
                counts, lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0)
            )
            c_old, c_new = F.get(counts, F.greatest(gone, F.lit(0))), F.get(counts, come)
            moved = weight(c_new + 1) - weight(c_new) + weight(c_old - 1) - weight(c_old)
            entered = weight(c_new + 1) - weight(c_new)
            total = state["total"] + F.when(gone == come, 0).when(gone < 0, entered).otherwise(moved)
            hot = (i >= w - 1) & (total <= state["limit"])
            last = F.get(state["out"], F.size(state["out"]) - 1)
            joins = F.coalesce(last["end"] >= i - w + 1, F.lit(False))
            fresh = F.struct((i - w + 1).alias("start"), (i + 1).alias("end"))
            longer = F.struct(last["start"].alias("start"), (i + 1).alias("end"))
            out = (
                F.when(~hot, state["out"])
                .when(joins, F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(longer)))
                .otherwise(F.concat(state["out"], F.array(fresh)))
            )
            return F.struct(
                codes.alias("codes"),
                state["limit"].alias("limit"),
                changed.alias("counts"),
                total.alias("total"),
                out.alias("out"),
            )

        return F.transform(F.array(F.struct(old.alias("old"), new.alias("new"))), step)[0]

    codes = F.transform(F.split(match, ""), lambda c: F.ascii(c))
    start = F.struct(
        codes.alias("codes"),
        limit.cast("bigint").alias("limit"),
        F.array_repeat(F.lit(0), 128).alias("counts"),
        F.lit(0).cast("bigint").alias("total"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.char_length(match) - 1), start, slide, lambda s: s["out"])


def _entropy_spans(text: Column, rules: EntropyRules) -> Column:
    def within(m: Column) -> Column:
        return F.transform(
            _hot_windows(m["match"], rules),
            lambda s: F.struct(
                (m["start"] + s["start"]).alias("start"),
                F.lit(3).alias("kind"),
                (m["start"] + s["end"]).alias("end"),
            ),
        )

    allowed = lambda m, patterns: F.greatest(*[m.rlike(p) for p in patterns], F.lit(False), F.lit(False))

    def blanked(m: Column) -> Column:
        """The match with slashes in place of the characters of allowed segments."""
        if not rules.allow_segments:
            return m
        segment = lambda s: F.when(
            allowed(s, rules.allow_segments), F.repeat(F.lit("/"), F.char_length(s))
        ).otherwise(s)
        return F.array_join(F.transform(F.split(m, "/"), segment), "/")

    found = F.filter(matches(text, CANDIDATE), lambda m: ~allowed(m["match"], rules.allow))
    found = F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), blanked(m["match"]).alias("match"))
    )
    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(found, within))).otherwise(
        F.array().cast("array<struct<start:int,kind:int,end:int>>")
    )


def scan(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``docs`` with ``base_spans`` and ``entropy_spans``, arrays of struct(start, kind, end) in order of start, kind.

    ``kind`` is a place in ``KINDS``. The base scan finds assigned values, access keys and long hex runs, per
    kind leftmost and without overlap. An entropy span that lies within a base span is left out; base spans are
    never changed. A null or empty text has no spans; a text of any length is scanned whole. Rows are independent: repeated rows get equal spans, extra
    columns pass through, an empty table stays empty. Needs ``text``.
    """
    text = text_of("text")
    assign = _spans(
        text,
        0,
        ASSIGN,
        # the pattern cannot match without one of these signs
        (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN),
        lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE,
    )
    access = _spans(text, 1, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = _spans(text, 2, HEX, text.rlike(HEX))
    base = F.array_sort(F.concat(assign, access, hexes))
    covered = lambda e: F.exists(F.col("base_spans"), lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"]))
    return docs.withColumn("base_spans", base).withColumn(
        "entropy_spans", F.filter(_entropy_spans(text, rules), lambda e: ~covered(e))
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def report(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """One row per document: doc_id, counts per kind, digest of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return scan(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
        F.size("entropy_spans").cast("bigint").alias("n_entropy"),
    )


MASK = "[SECRET]"


def redact(docs: DataFrame, rules: EntropyRules = EntropyRules(), mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask``, and ``n_chars`` set anew; documents without spans are unchanged.

    Overlapping spans are replaced as one. A null text stays null.
    """
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")
    found = scan(docs.select(whole, F.col("text").alias("text")), rules)
    text = F.col("text")

    def cut(state, span):
        fresh = span["start"] >= state["at"]
        gap = F.when(fresh, F.array(F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mask)))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.concat(state["out"], F.coalesce(gap, F.array().cast("array<string>"))).alias("out"),
        )

    spans = F.array_sort(F.concat("base_spans", "entropy_spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        spans,
        start,
        cut,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))),
    )
    new = F.when(F.size(spans) > 0, clean).otherwise(text)
    # one step after the other: the text is put together once
    redacted = found.select("doc", new.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return redacted.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in columns])
