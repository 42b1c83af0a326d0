"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes long with the counts of the bytes that follow. A
text's code length under a language is the sum over its bytes of -log2 P(byte | longest known context). A byte not
seen in a context costs the escape probability q / (n + q), with n bytes and q different bytes seen there, and is
coded in the context one byte shorter; below the empty context all 256 bytes are equally likely. Statistics are
frozen after learning. The language with the shortest code wins.

As statistics are frozen, the cost of every byte seen in a context and of every context's escape is worked out
beforehand. Both lie in sorted arrays, one row per string seen in any language, so the model is as large as its sample
has different strings of up to four bytes, and nothing is left out. A text is a binary search per byte in numpy, over the
bytes of a whole Arrow batch; bytes not seen after three others go on to the context one byte shorter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.llm.arrays import bytes_of, small_batches
from scoremill.llm.words import text_of

ORDER = 3
SAMPLE_DOCS = 1500  # documents per language aimed at when learning: the documented bound of the sample
PIECE = 1 << 18  # bytes scored at a time
UNKNOWN = "und"
START = 0  # stands before a text; a byte 0 inside a text looks the same to the bytes behind it


@dataclass(frozen=True)
class Order:
    """What was seen with contexts of one length; strings of bytes are numbers with the last byte lowest."""

    strings: np.ndarray  # context and byte, sorted
    cost: np.ndarray  # bits of the byte, one column per language
    contexts: np.ndarray  # sorted
    escape: np.ndarray  # bits of leaving the context; 0 where a language never saw it


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    orders: tuple[Order, ...]  # from the empty context on


def remainder(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 5


def _before(data: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """Bytes ``back`` places earlier, START across the start of a text."""
    out = np.empty_like(data)
    out[:back] = START
    out[back:] = data[: len(data) - back]
    for shift in range(back):
        at = starts + shift
        out[at[at < len(out)]] = START
    return out


def _strings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Every byte with the ``ORDER`` before it, as a number with the byte itself lowest."""
    key = data.astype(np.int64)
    for back in range(1, ORDER + 1):
        key |= _before(data, starts[:-1], back).astype(np.int64) << (8 * back)
    return key


def _grams(batches):
    """Counts of four-byte strings per language of a batch; byte 0 stands before a text."""
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        data, starts = bytes_of(batch.column("text"))
        key = _strings(data, starts)
        row_lang, names = np.unique(langs.astype(str), return_inverse=True)
        lang_of = np.repeat(names, np.diff(starts))
        for no, lang in enumerate(row_lang):
            keys, counts = np.unique(key[lang_of == no], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))],
                ["lang", "gram", "seen"],
            )


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Model of the languages in ``docs`` (doc_id, text, lang); rows with a null text or lang teach nothing.

    About ``sample_docs`` documents per language are taken by a hash of their id, whole texts each; fewer where a
    language has fewer. An empty table gives a model without languages.
    """
    small_batches(docs)
    usable = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel((), ())
    parts = 1_000_000
    limit = F.lit(None).cast("bigint")
    for lang, n in sorted(sizes.items()):
        limit = F.when(F.col("lang") == lang, F.lit(int(parts * min(1.0, sample_docs / n)))).otherwise(limit)
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(parts)) < limit
    grams = (
        usable.where(drawn)
        .select("lang", "text")
        .mapInArrow(_grams, "lang string, gram bigint, seen bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("seen").alias("seen"))
        .toPandas()
    )
    return build(grams, tuple(sorted(sizes)))


def build(grams, languages: tuple[str, ...]) -> LanguageModel:
    """Model from counts of four-byte strings (pandas columns lang, gram, seen)."""
    gram = grams["gram"].to_numpy(np.int64)
    seen = grams["seen"].to_numpy(np.int64)
    lang = np.searchsorted(np.array(languages, dtype=object), grams["lang"].to_numpy(object))
    orders: list[Order] = []
    for order in range(ORDER + 1):
        strings, string_of = np.unique(gram & ((1 << (8 * order + 8)) - 1), return_inverse=True)
        contexts, context_of = np.unique(strings >> 8, return_inverse=True)
        cost = np.empty((len(strings), len(languages)), np.float32)
        escape = np.zeros((len(contexts), len(languages)), np.float32)
        if order:  # every string was counted without its first byte too
            shorter = np.searchsorted(orders[-1].strings, strings & ((1 << (8 * order)) - 1))
        for no in range(len(languages)):
            counts = np.bincount(string_of, seen * (lang == no), len(strings))
            total = np.bincount(context_of, counts, len(contexts))
            kinds = np.bincount(context_of, counts > 0, len(contexts))
            known = total > 0
            escape[known, no] = -np.log2(kinds[known] / (total + kinds)[known])
            cost[:, no] = escape[context_of, no] + (orders[-1].cost[shorter, no] if order else 8.0)
            here = counts > 0
            cost[here, no] = -np.log2(counts[here] / (total + kinds)[context_of[here]])
        orders.append(Order(strings, cost, contexts, escape))
    return LanguageModel(languages, tuple(orders))


def _places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stands in the sorted ``known``, and whether it does."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _costs(strings: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Bits of the last byte of every string under each language."""
    out = np.zeros((len(strings), len(model.languages)), np.float32)
    left = np.arange(len(strings))
    for order in range(ORDER, -1, -1):
        table = model.orders[order]
        wanted = strings[left] & ((1 << (8 * order + 8)) - 1)
        at, found = _places(table.strings, wanted)
        out[left[found]] += table.cost[at[found]]
        left, wanted = left[~found], wanted[~found]
        if not len(left):
            return out
        at, found = _places(table.contexts, wanted >> 8)
        out[left[found]] += table.escape[at[found]]
    out[left] += 8.0
    return out


def code_lengths(texts: pa.Array, model: LanguageModel) -> np.ndarray:
    """Bits of each text under each language."""
    data, starts = bytes_of(texts)
    out = np.zeros((len(texts), len(model.languages)))
    if not len(data):
        return out
    strings = _strings(data, starts)
    for at in range(0, len(data), PIECE):
        end = min(at + PIECE, len(data))
        # common strings repeat: each different one is looked up once
        different, which = np.unique(strings[at:end], return_inverse=True)
        cost = _costs(different, model)[which]
        low, high = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end, "left")
        bounds = np.maximum(starts[low:high], at) - at
        filled = np.diff(np.append(bounds, end - at)) > 0
        out[np.arange(low, high)[filled]] += np.add.reduceat(cost, bounds[filled], axis=0, dtype=np.float64)
    return out


def prediction(model: LanguageModel, text: Column | str = "text") -> Column:
    """Column struct(lang_pred, score, bits) for a text.

    ``score`` is the share of the winner in the sum of 2 ** -bits over all languages, which is its posterior under
    equal priors; ``bits`` its code length. Ties go to the language first in order. A text that is null or has no
    letter, and any text under a model without languages, is ``und`` with score 0 and null bits.
    """

    def predict(texts: pa.Array) -> pa.Array:
        n = len(texts)
        known = np.asarray(texts.is_valid()) if model.languages else np.zeros(n, bool)
        if not known.any():
            return pa.StructArray.from_arrays(
                [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.nulls(n, pa.float64())], ["lang_pred", "score", "bits"]
            )
        bits = code_lengths(texts.fill_null(""), model)
        best = bits.argmin(1)
        least = bits[np.arange(n), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(least, mask=~known)],
            ["lang_pred", "score", "bits"],
        )

    column = text_of(text)
    lettered = F.when(column.rlike(r"\p{L}"), column)
    returned = "struct<lang_pred:string,score:double,bits:double>"
    return F.arrow_udf(predict, returned).asNondeterministic()(lettered)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits.

    The model learns from the rows that are not held out; a row is held out if crc32 of its id as text modulo 5 is
    0. A null id is not held out. Empty tables, repeated rows and extra columns need no care: each row is
    predicted from its whole text alone, which is scored ``PIECE`` bytes at a time.
    """
    held_out = F.coalesce(remainder() == 0, F.lit(False))
    model = learn(docs.where(~held_out))
    small_batches(docs)
    return docs.select("doc_id", held_out.alias("held_out"), prediction(model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.bits"
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is ``und``; a null lang is filled with the prediction."""
    held_out = F.coalesce(remainder() == 0, F.lit(False))
    model = learn(docs.where(~held_out))
    small_batches(docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(whole.alias("doc"), prediction(model, docs["text"]).alias("p")).where(
        F.col("p.lang_pred") != UNKNOWN
    )
    filled = {"lang": F.coalesce(F.col("doc.lang"), F.col("p.lang_pred"))}
    return found.select(*[filled.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
