"""Language identification with bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds one bit for each language, so one probe of k slots, AND-ed, returns the set
of all languages whose filter contains an n-gram. Popcounts over a text, corrected for each language's
false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, few_of_each, table
from .words import pieces

GRAM = 4
#: Labelled documents of each language that the filters are fitted on, at most.
SAMPLE_PER_LANGUAGE = 2000
#: Sampled ids that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: A language's filter takes an n-gram whose share of its texts is at least this part of the largest share.
RELATIVE = 0.3
#: ... and which at least so many of its sampled texts contain.
LEAST_TEXTS = 2
#: Slots for each n-gram of the fullest language (12 and 2 probes: about 2.4 % false positives).
SLOTS_PER_GRAM, PROBES = 12, 2
#: A text has a language if its evidence is at least BAR times what all but QUANTILE of that language's held-out
#: documents of LEAST_GRAMS n-grams have; known from LEAST_JUDGED of them on. At a third, texts in three languages stay.
BAR, QUANTILE, LEAST_GRAMS, LEAST_JUDGED = 1 / 3, 0.05, 50, 20
_SEP = np.zeros(256, bool)
_SEP[[i for i in range(128) if not chr(i).isalpha()]] = True
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def _prepared(col: pa.Array) -> pa.Array:
    text = pc.utf8_lower(pc.fill_null(col, ""))
    return pc.binary_join_element_wise(" ", text, "  ", "")


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as 32-bit words, n + 1 bounds): GRAM bytes each of lower-cased text, with runs of what is not
    a letter as one space; none reaches over the end of a text."""
    sep = _SEP[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    keep[off[:-1]] = True
    b = np.where(sep, np.uint8(32), data)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    if len(b) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    n = len(b) - GRAM + 1
    g = np.zeros(n, np.uint32)
    for k in range(GRAM):
        g |= b[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    good = np.ones(n, bool)
    for k in range(1, GRAM):
        cut = at[1:] - k
        good[cut[(cut >= 0) & (cut < n)]] = False
    bounds = np.concatenate([[0], np.cumsum(good)])[np.minimum(at, n)]
    return g[good], bounds


def _slots(g: np.ndarray, m: int) -> list[np.ndarray]:
    out = []
    for k in range(PROBES):
        x = g * _MULT[k]
        x ^= x >> np.uint32(15)
        x *= _MULT[(k + 1) % 4]
        x ^= x >> np.uint32(13)
        out.append(x & np.uint32(m - 1))
    return out


class BloomSlices:
    """Filters of up to any number of languages: planes of 64-bit masks over m slots."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.langs = sorted(grams)
        most = max([len(g) for g in grams.values()] + [1])
        self.m = 1 << int(np.ceil(np.log2(most * SLOTS_PER_GRAM)))
        self.masks = np.zeros(((len(self.langs) + 63) // 64 or 1, self.m), np.uint64)
        self.rate = np.zeros(len(self.langs))
        for i, lang in enumerate(self.langs):
            bit = np.uint64(1 << (i % 64))
            for s in _slots(np.asarray(grams[lang], np.uint32), self.m):
                self.masks[i // 64][s] |= bit
            self.rate[i] = ((self.masks[i // 64] & bit) != 0).mean() ** PROBES

    def counts(self, g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language the n-grams that are in the language, less the expected false ones."""
        size = np.diff(bounds).astype(float)
        out = np.zeros((len(size), len(self.langs)))
        slots = _slots(g, self.m)
        for plane, masks in enumerate(self.masks):
            hit = masks[slots[0]]
            for s in slots[1:]:
                hit &= masks[s]
            for i in range(64 * plane, min(64 * plane + 64, len(self.langs))):
                run = np.concatenate([[0], np.cumsum((hit >> np.uint64(i % 64)).astype(np.uint8) & 1, dtype=np.int64)])
                out[:, i] = run[bounds[1:]] - run[bounds[:-1]]
        return np.maximum(0, (out - size[:, None] * self.rate) / (1 - self.rate))


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        rb = rb.set_column(1, "text", _prepared(rb.column(1)))
        for rows, data, off in pieces(iter([rb])):
            g, bounds = _grams(data, off)
            langs = rows.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = [np.unique(g[bounds[i] : bounds[i + 1]]) for i, x in enumerate(langs) if x == lang]
                u, c = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "texts"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[BloomSlices, str]:
    """(filters, most frequent language) of labelled (id, text, lang). Fitted on the per_language documents
    of each language whose hashed id is smallest; what reaches the driver is bounded by that sample. Without
    any labelled text the filters are of no language, and the language is `und`."""
    chosen = cut(few_of_each(labelled.where("lang is not null and text is not null").select("id", "lang"), "lang", "id", per_language), "lang-sample")
    sizes = {r[0]: r[1] for r in chosen.groupBy("lang").count().collect()}
    if not sizes:
        return BloomSlices({}), "und"
    small = sum(sizes.values()) <= BROADCAST_IDS
    sample = labelled.join(F.broadcast(chosen) if small else chosen, ["id", "lang"], "left_semi").select("lang", "text")
    counts = arrow_map(sample, _texts_with, "lang string, gram long, texts long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    rows = counts.toArrow()
    discard(chosen)
    langs = sorted(sizes)
    code = {x: i for i, x in enumerate(langs)}
    li = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
    grams, inv = np.unique(rows.column("gram").to_numpy(), return_inverse=True)
    share = np.zeros((len(langs), len(grams)))
    share[li, inv] = rows.column("texts").to_numpy() / np.array([sizes[x] for x in langs], float)[li] if len(li) else 0
    top = share.max(axis=0) if len(grams) else np.zeros(0)
    chosen_grams = {x: grams[(share[i] > 0) & (share[i] >= RELATIVE * top)].astype(np.uint32) for i, x in enumerate(langs)}
    return BloomSlices(chosen_grams), max(langs, key=lambda x: (sizes[x], x))


def _predicted(batches: Iterator[pa.RecordBatch], filters: BloomSlices, usual: str) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        rb = rb.set_column(1, "text", _prepared(rb.column(1)))
        for rows, data, off in pieces(iter([rb])):
            g, bounds = _grams(data, off)
            c = filters.counts(g, bounds)
            total = c.sum(axis=1)
            best = c.argmax(axis=1) if filters.langs else np.zeros(len(total), int)
            score = np.divide(c.max(axis=1, initial=0), total, out=np.zeros(len(total)), where=total > 0)
            lang = [filters.langs[b] if t > 0 else usual for b, t in zip(best, total, strict=True)]
            score = np.clip(score, 0, 1)
            keep = [rows.column(i) for i in range(rows.num_columns) if i != 1]
            names = [n for i, n in enumerate(rows.schema.names) if i != 1]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])


def identify(docs: DataFrame, filters: BloomSlices, usual: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row of docs; whole texts are read.

    score is the winner's part of all languages' corrected counts. A null text or one without a letter gives
    `und` with score 0; a text whose n-grams are in no filter gives the most frequent language with score 0;
    ties go to the first language by name; filters of no language give `usual`. Null ids are kept; repeated rows
    each give a row; an empty table gives none. Other columns aren't read, so their names don't matter.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    kind = src.schema["id"].dataType.simpleString()
    out = arrow_map(src, lambda it: _predicted(it, filters, usual), f"id {kind}, letters boolean, lang_pred string, score double")
    ok = F.coalesce("letters", F.lit(False))
    return out.select(
        F.col("id").alias(id_col), F.when(ok, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(ok, F.col("score")).otherwise(0.0).alias("score")
    )


def _evidence(batch: pa.RecordBatch, filters: BloomSlices) -> tuple[np.ndarray, ...]:
    """(n-grams, best language, its corrected hits for each n-gram) of each row of a batch with a column `text`."""
    rb = pa.RecordBatch.from_arrays([_prepared(batch.column(batch.schema.get_field_index("text")))], names=["text"])
    size, counts = [np.zeros(0)], [np.zeros((0, len(filters.langs)))]
    for _, data, off in pieces(iter([rb])):
        g, bounds = _grams(data, off)
        size.append(np.diff(bounds).astype(float))
        counts.append(filters.counts(g, bounds))
    n, c = np.concatenate(size), np.concatenate(counts)
    return n, c.argmax(axis=1), c.max(axis=1) / np.maximum(n, 1)


def _right(batches: Iterator[pa.RecordBatch], filters: BloomSlices) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        n, best, share = _evidence(rb, filters)
        label = np.array(rb.column(1).to_pylist(), object)
        at = np.flatnonzero((n >= LEAST_GRAMS) & (np.array(filters.langs, object)[best] == label))
        yield pa.RecordBatch.from_arrays([pa.array(best[at]), pa.array(share[at])], names=["best", "share"])


def bars(labelled: DataFrame, filters: BloomSlices) -> np.ndarray:
    """For each language of the filters BAR times the QUANTILE of the evidence of its labelled (text, lang)
    documents, which the filters shouldn't be fitted on. Zero, which rejects nothing, for languages of fewer
    than LEAST_JUDGED of them. The best language's lead over the next is no measure: texts in two languages
    have little of it (0.17 for one of sf0.01, where 0.8 is usual) and are no junk."""
    rows = arrow_map(labelled.where("text is not null and lang is not null").select("text", "lang"), lambda it: _right(it, filters), "best long, share double")
    out = np.zeros(len(filters.langs))
    for best, n, share in rows.groupBy("best").agg(F.count(F.lit(1)), F.percentile_approx("share", QUANTILE, 10_000)).collect():
        if n >= LEAST_JUDGED:
            out[best] = BAR * share
    return out


def _told(batches: Iterator[pa.RecordBatch], filters: BloomSlices, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        n, best, share = _evidence(rb, filters)
        slack = 1 / np.sqrt(np.maximum(n, 1))  # two deviations of a share, at most: a short text shows little
        yield rb.filter(pa.array(share + slack >= least[best]))


def with_language(docs: DataFrame, filters: BloomSlices, least: np.ndarray) -> DataFrame:
    """The rows of docs (with a column `text`), with all columns, whose text has a letter and reaches the bar of its
    best language. Null and empty texts go; repeated rows stay or go together; filters of no language reject nothing more."""
    some = docs.where(F.col("text").rlike(r"\p{L}"))
    if not filters.langs:
        return some
    return arrow_map(some, lambda it: _told(it, filters, least), docs.schema)


def held_out(doc_id, modulus: int, left: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == left, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents, fitted on those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where(~held_out("doc_id", 3, 1)).select(F.col("doc_id").alias("id"), "text", "lang")
    filters, usual = fit(train)
    out = identify(docs, filters, usual)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
