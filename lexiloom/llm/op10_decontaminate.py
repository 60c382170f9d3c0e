"""Latent semantic retrieval of benchmark items: a randomised SVD of TF-IDF passages, cosine candidates,
then longest common subsequences and an answer check, so that paraphrases are found with verbatim copies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table
from .words import NON_ALNUM, hashes, pieces, spans, text_bytes

#: Passages are BLOCKS blocks of BLOCK words; one starts with each block.
BLOCK, BLOCKS = 32, 3
#: Latent dimensions, and further random ones for the sketch.
RANK, OVERSAMPLE = 96, 32
#: Terms in more than this share of all passages are left out, but for the LEAST_TERMS rarest of an item.
COMMON, LEAST_TERMS = 0.02, 5
COSINE = 0.45
#: Share of an item's words, in order, that tells a leak; from PARAPHRASE on only if the answer is there too.
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Items compared in one pass over the documents, at most; more are done in several passes.
ITEMS_PER_PASS = 20_000
#: Cosines computed at a time, at most.
CELLS = 4_000_000


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(col, ""))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    data, off = text_bytes(_lower(pa.array(texts, pa.string())))
    s, e, first = spans(data, off, NON_ALNUM)
    h = hashes(data, s, e)
    return [h[first[i] : first[i + 1]] for i in range(len(texts))]


def answer_of(text: str) -> str:
    """The item's last sentence of at least three words; else all of it."""
    parts = [p for p in re.split(r"[.!?\n]+", text) if len(p.split()) >= 3]
    return parts[-1] if parts else text


def lcs(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    v = full = (1 << len(item)) - 1
    for w in other.tolist():
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Terms:
    """Numbers for a fixed set of word hashes, by direct addressing and one comparison."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.bits = max(16, int(len(self.known)).bit_length() + 4)
        key = (self.known >> np.uint64(64 - self.bits)).astype(np.int64)
        self.begin = np.searchsorted(key, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.begin).max()) if len(self.known) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.known):
            return out
        key = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[key], self.begin[key + 1]
        for step in range(self.deep):
            live = np.flatnonzero(at + step < end)
            p = at[live] + step
            same = self.known[p] == h[live]
            out[live[same]] = p[same]
        return out


def _hits(batches: Iterator[pa.RecordBatch], terms: Terms):
    """For each run of documents: (rows, all word hashes, first word of each document, first block of each
    document, places of known words, their terms, their blocks)."""
    for rb in batches:
        rb = rb.set_column(1, "text", _lower(rb.column(1)))
        for rows, data, off in pieces(iter([rb])):
            s, e, first = spans(data, off, NON_ALNUM)
            h = hashes(data, s, e)
            t = terms.find(h)
            at = np.flatnonzero(t >= 0)
            count = np.diff(first)
            blocks = np.concatenate([[0], np.cumsum(-(-count // BLOCK))])
            doc = np.searchsorted(first, at, "right") - 1
            yield rows, h, first, blocks, at, t[at], blocks[doc] + (at - first[doc]) // BLOCK


def _passage(first_blocks: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the passages that don't overlap, for blocks of a run of documents; how many there are."""
    per = -(-np.diff(first_blocks) // BLOCKS)
    begin = np.concatenate([[0], np.cumsum(per)])
    doc = np.searchsorted(first_blocks, block, "right") - 1
    return begin[doc] + (block - first_blocks[doc]) // BLOCKS, int(begin[-1])


def _frequencies(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(len(terms.known) + 1, np.int64), 0
    for _, _, _, blocks, _, t, b in _hits(batches, terms):
        p, more = _passage(blocks, b)
        n += more
        df[:-1] += np.bincount(np.unique(p * len(terms.known) + t) % len(terms.known), minlength=len(terms.known)) if len(t) else 0
    df[-1] = n  # the last number stands for the count of passages
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])


def _gram_sketch(p: np.ndarray, t: np.ndarray, w: np.ndarray, omega: np.ndarray, into: np.ndarray, scale: float = 1.0) -> None:
    """Adds A'A omega for the passages' unit TF-IDF rows; p ascending, t the terms, w their weights."""
    if not len(p):
        return
    u, c = np.unique(p * len(omega) + t, return_counts=True)
    p, t = u // len(omega), u % len(omega)
    a = (c * w[t]).astype(np.float32)
    begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    which = np.cumsum(np.concatenate([[True], p[1:] != p[:-1]])) - 1
    a /= np.sqrt(np.add.reduceat(a * a, begin))[which]
    y = np.add.reduceat(a[:, None] * omega[t], begin)
    order = np.argsort(t, kind="stable")
    ts = t[order]
    cuts = np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]]))
    into[ts[cuts]] += scale * np.add.reduceat(a[order, None] * y[which[order]], cuts)


def _sketched(batches: Iterator[pa.RecordBatch], terms: Terms, w: np.ndarray, omega: np.ndarray) -> Iterator[pa.RecordBatch]:
    z = np.zeros(omega.shape, np.float32)
    for _, _, _, blocks, _, t, b in _hits(batches, terms):
        _gram_sketch(_passage(blocks, b)[0], t, w, omega, z)
    yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["z"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = None
    for rb in batches:
        for v in rb.column(0):
            x = np.frombuffer(v.as_buffer(), np.float32)
            z = x.copy() if z is None else z + x
    if z is not None:
        yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["z"])


@dataclass
class Space:
    """The latent space of all items, whatever the pass that compares them."""

    terms: Terms
    basis: np.ndarray  # weighted term vectors in the latent space


@dataclass
class Index:
    """What each task of the search needs: bounded by the items of one pass, not by the documents."""

    items: list[Item]
    terms: Terms
    basis: np.ndarray
    vectors: np.ndarray  # unit vectors of the items


def _own(items: list[Item], terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(item's place, term) of each known word of items."""
    hit = [terms.find(i.words) for i in items]
    return np.repeat(np.arange(len(items)), [int((x >= 0).sum()) for x in hit]), np.concatenate([x[x >= 0] for x in hit] + [np.zeros(0, np.int64)])


def build_space(docs: DataFrame, pages: Callable[[], Iterator[list[Item]]], seed: int = 11) -> Space:
    """The latent space of the items of all pages over all passages of docs (id, text): document frequencies in one
    pass, the sketch of the SVD in another. The items are rows of the matrix too, weighted to half of its energy."""
    words, n_items = np.zeros(0, np.uint64), 0
    for items in pages():
        words, n_items = np.unique(np.concatenate([words, *[i.words for i in items]])), n_items + len(items)
    all_terms = Terms(words)
    rows = arrow_map(docs, lambda it: _frequencies(it, all_terms), "term long, df long").groupBy("term").agg(F.sum("df")).collect()
    df = np.zeros(len(all_terms.known) + 1)
    for t, n in rows:
        df[t] = n
    passages, df = df[-1] + n_items, df[:-1]
    for items in pages():
        for i in items:
            df[np.unique(all_terms.find(i.words))] += 1
    keep = df <= COMMON * passages
    for items in pages():
        for i in items:
            o = np.unique(all_terms.find(i.words))
            if keep[o].sum() < LEAST_TERMS:
                keep[o[np.argsort(df[o], kind="stable")[:LEAST_TERMS]]] = True
    terms = Terms(all_terms.known[keep])
    w = np.log((passages + 1) / df[keep]) + 0.1
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((len(terms.known), RANK + OVERSAMPLE)).astype(np.float32)
    parts = arrow_map(docs, lambda it: _sketched(it, terms, w, omega), "z binary")
    parts = arrow_map(parts.repartition(8), _summed, "z binary")
    parts = arrow_map(parts.repartition(1), _summed, "z binary").collect()
    z = np.frombuffer(parts[0][0], np.float32).reshape(omega.shape).copy() if parts else np.zeros(omega.shape, np.float32)
    for items in pages():
        _gram_sketch(*_own(items, terms), w, omega, z, scale=max(1.0, (passages - n_items) / max(1, n_items)))
    u = np.linalg.svd(z.astype(np.float64), full_matrices=False)[0][:, :RANK] if len(z) else np.zeros((0, RANK))
    return Space(terms, (u * w[:, None]).astype(np.float32))


def build_index(space: Space, items: list[Item]) -> Index:
    vectors = np.zeros((len(items), space.basis.shape[1]), np.float32)
    p, t = _own(items, space.terms)
    np.add.at(vectors, p, space.basis[t])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Index(items, space.terms, space.basis, np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0))


def _candidates(index: Index, blocks: np.ndarray, t: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block, item, cosine) of passages and items with at least that cosine."""
    none = np.zeros(0, np.int64)
    if not len(t):
        return none, none, np.zeros(0)
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    sums = np.add.reduceat(index.basis[t], begin)
    there = b[begin]
    doc_begin = blocks[np.searchsorted(blocks, there, "right") - 1]
    starts = np.unique(np.concatenate([np.maximum(there - k, doc_begin) for k in range(BLOCKS)]))
    end = blocks[np.searchsorted(blocks, starts, "right")]
    vec = np.zeros((len(starts), sums.shape[1]), np.float32)
    for k in range(BLOCKS):
        i = np.searchsorted(there, starts + k)
        ok = (i < len(there)) & (starts + k < end)
        ok[ok] = there[i[ok]] == (starts + k)[ok]
        vec[ok] += sums[i[ok]]
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    vec = np.divide(vec, norm, out=np.zeros_like(vec), where=norm > 0)
    out = []
    step = max(1, CELLS // max(1, len(index.vectors)))
    for c in range(0, len(vec), step):
        score = vec[c : c + step] @ index.vectors.T
        r, i = np.nonzero(score >= cosine)
        out.append((starts[r + c], i, score[r, i]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _leaks(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for rows, h, first, blocks, _, t, b in _hits(batches, index.terms):
        best: dict[tuple[int, int], tuple] = {}
        for start, i, cos in zip(*(x.tolist() for x in _candidates(index, blocks, t, b, COSINE)), strict=True):
            d = int(np.searchsorted(blocks, start, "right")) - 1
            item = index.items[i]
            m = len(item.words)
            lo = max(first[d], first[d] + (start - blocks[d]) * BLOCK - m)
            hi = min(first[d + 1], first[d] + (start - blocks[d] + BLOCKS) * BLOCK + m)
            old = best.get((d, i))
            if old and old[0] == 1.0:
                continue
            share = lcs(item.words, h[lo:hi]) / m
            if share < PARAPHRASE:
                continue
            answer = lcs(item.answer, h[lo:hi]) / len(item.answer)
            if share >= VERBATIM or answer >= ANSWER:
                best[d, i] = max(old or (0.0,), (share, answer, float(cos), int(lo - first[d]), int(hi - first[d])))
        keys = sorted(best)
        cols = [rows.column(0).take(pa.array([d for d, _ in keys], pa.int64())), pa.array([index.items[i].item_id for _, i in keys], pa.int64())]
        cols += [pa.array([best[k][j] for k in keys], kind) for j, kind in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "item_id", "lcs_share", "answer_share", "cosine", "word_from", "word_to"])


def read_items(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> Iterator[list[Item]]:
    """The benchmark in runs of at most ITEMS_PER_PASS items, by id, text and answer; blank items are left out."""
    cols = [F.col(item_col).alias("i"), F.col(text_col).alias("t"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a")]
    src = benchmark.select(*cols).where("i is not null and t is not null").distinct()
    kinds = [src.schema["i"].dataType, "string", "string", "boolean"]
    key, last = F.struct("i", "t", F.coalesce("a", F.lit("")).alias("b"), F.col("a").isNotNull().alias("c")), None
    while True:
        part = src if last is None else src.where(key > F.struct(*[F.lit(v).cast(kind) for v, kind in zip(last, kinds, strict=True)]))
        rows = part.orderBy(key).limit(ITEMS_PER_PASS).collect()
        if not rows:
            return
        words, answers = word_hashes([r.t for r in rows]), word_hashes([r.a if r.a is not None else answer_of(r.t) for r in rows])
        items = [Item(r.i, x, y if len(y) else x) for r, x, y in zip(rows, words, answers, strict=True) if len(x)]
        if items:
            yield items
        if len(rows) < ITEMS_PER_PASS:
            return
        r = rows[-1]
        last = (r.i, r.t, r.a or "", r.a is not None)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row for each document and benchmark item that it holds: id_col, item_id, lcs_share, answer_share,
    cosine, word_from, word_to (the span of words that was compared).

    A passage of 96 words is a candidate for an item when their latent vectors have a cosine of COSINE at
    least. It is a leak if, widened by the item's length on both sides, it holds VERBATIM of the item's words
    in order, or PARAPHRASE of them and ANSWER of the answer's (a column of the benchmark, else its last
    sentence). Words are runs of letters and digits, lower-cased. Whole texts are searched. Null or empty
    texts, blank items and an empty benchmark give no row; repeated rows of docs repeat theirs, also with null ids;
    of items that share an id each is compared. Of several passages the one with the largest share is told, on ties
    the largest answer share, cosine and place. Other columns aren't read, so their names don't matter.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, lcs_share double, answer_share double, cosine double, word_from long, word_to long"
    kept: list[list[Item]] = []

    def pages() -> Iterator[list[Item]]:
        if kept:
            yield from kept  # one run is read once
            return
        for n, items in enumerate(read_items(benchmark, item_col, item_text, answer_col)):
            if n == 0 and len(items) < ITEMS_PER_PASS:
                kept.append(items)
            yield items

    out, space = None, build_space(src, pages) if any(True for _ in pages()) else None
    for items in pages():
        index = build_index(space, items)
        part = arrow_map(src, lambda it, index=index: _leaks(it, index), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated() of all documents by all benchmark items."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("lcs_share", 6).alias("lcs_share"), F.round("answer_share", 6).alias("answer_share"))
