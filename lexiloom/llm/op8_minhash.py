"""b-bit MinHash near-duplicates: band candidates, packed low bits of the minima to estimate similarity,
and a check of every link on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, runs, table
from .components import components
from .words import SPACES, hashes, mix, pieces, shingles, spans

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
WORDS64 = HASHES * BITS // 64
#: Estimates below 0.8 by more than five standard deviations are dropped before the check.
SLACK = 5
#: Members, and shingles of members, of a bucket that one task compares at a time; fuller buckets are dealt into cells.
CELL_ROWS, CELL_SHINGLES = 4096, 2_000_000
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_SKETCH = "id long, n long, k1 long, k2 long, " + ", ".join(f"s{i} long" for i in range(WORDS64)) + ", bands array<long>"


def _minima(u: np.ndarray) -> np.ndarray:
    x = (u >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        m = _A * x[i : i + 1024]
        m += _B
        np.minimum(out, m.min(axis=1), out=out)
    return out


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    place = (np.arange(64 // BITS) * BITS).astype(np.uint64)
    band = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for rows, data, off in pieces(batches):
        s, e, first = spans(data, off, SPACES)
        g, at = shingles(hashes(data, s, e), first, n)
        d = rows.num_rows
        size, keys = np.zeros(d, np.int64), np.zeros((d, 2), np.uint64)
        sig, bands = np.zeros((d, WORDS64), np.uint64), np.zeros((d, BANDS), np.uint64)
        for i in np.flatnonzero(np.diff(at)):
            u = np.unique(g[at[i] : at[i + 1]])
            size[i] = len(u)
            keys[i] = np.bitwise_xor.reduce(mix(u)), mix(u ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
            m = _minima(u)
            low = (m & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(WORDS64, -1)
            sig[i] = (low << place).sum(axis=1, dtype=np.uint64)
            b = band.copy()
            for r in m.reshape(BANDS, ROWS).T:
                b = mix(b * np.uint64(0x9E3779B97F4A7C15) + r)
            bands[i] = b
        cols = [rows.column(0).cast(pa.int64()), pa.array(size), *[pa.array(x.view(np.int64)) for x in keys.T.copy()], *[pa.array(x.view(np.int64)) for x in sig.T.copy()]]
        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, d * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))))
        yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "k1", "k2", *[f"s{i}" for i in range(WORDS64)], "bands"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for rows, data, off in pieces(batches):
        s, e, first = spans(data, off, SPACES)
        g, at = shingles(hashes(data, s, e), first, n)
        sets = [np.unique(g[at[i] : at[i + 1]]).tobytes() for i in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        keep = []
        for x, y in zip(rb.column(2), rb.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= percent * (len(p) + len(q) - same))
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similarity(x: str, y: str) -> Column:
    """Jaccard similarity estimated from two packed signatures: the share of equal b-bit values, less what
    unequal minima would give by chance (1 in 2**b)."""
    differ = F.lit(0)
    mask = sum(1 << (BITS * i) for i in range(64 // BITS))
    for i in range(WORDS64):
        v = F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))
        fold = v
        for k in range(1, BITS):
            fold = fold.bitwiseOR(F.shiftrightunsigned(v, k))
        differ = differ + F.bit_count(fold.bitwiseAND(F.lit(mask)))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / HASHES) - chance) / (1 - chance)


def _floor(percent: int) -> float:
    j, c = percent / 100, 2.0**-BITS
    p = j + (1 - j) * c
    return j - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - c)


def _likely(x: str, y: str, percent: int) -> Column:
    small, big = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (small * 100 >= big * percent) & (similarity(x, y) >= _floor(percent))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough. Texts are read again for just the ids that
    occur in pairs."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "mh-ids")
    sets = arrow_map(docs.join(ids, "id", "left_semi").select("id", "text"), lambda it: _sets(it, n), "id long, set binary")
    sets = cut(sets, "mh-sets")
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    out = cut(arrow_map(both, lambda it: _linked(it, percent), "a long, b long"), "mh-links")
    discard(sets)
    discard(ids)
    return out


def _root(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _cell_links(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between outsiders and members of one cell of a bucket, no more than join its components: pairs of
    components that are already joined are skipped, all others are checked on the full sets."""
    col = {n: rows.column(n).combine_chunks() for n in rows.schema.names}
    ids, n = col["rep"].to_numpy(), col["n"].to_numpy()
    sig = np.stack([col[f"s{i}"].to_numpy() for i in range(WORDS64)], axis=1).view(np.uint64)
    bands = np.array(col["bands"].to_pylist(), np.int64).reshape(len(ids), BANDS)
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in col["set"]]
    label = np.unique(col["component"].to_numpy(), return_inverse=True)[1]
    up = np.arange(len(ids))
    outside, inside = np.flatnonzero(col["outsider"].to_numpy(zero_copy_only=False)), np.flatnonzero(col["member"].to_numpy(zero_copy_only=False))
    here = col["band"][0].as_py()
    mask = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    most = HASHES * (1 - 2.0**-BITS) * (1 - _floor(percent))  # differing values at the floor of the estimate
    out = []
    for a in range(0, len(outside), 128):
        o = outside[a : a + 128]
        differ = np.zeros((len(o), len(inside)), np.uint16)
        for w in range(WORDS64):
            v = sig[o, w][:, None] ^ sig[inside, w][None]
            fold = v.copy()
            for k in range(1, BITS):
                fold |= v >> np.uint64(k)
            differ += np.bitwise_count(fold & mask)
        small, big = np.minimum(n[o][:, None], n[inside][None]), np.maximum(n[o][:, None], n[inside][None])
        x, y = np.nonzero((differ <= most) & (100 * small >= percent * big) & (label[o][:, None] != label[inside][None]))
        order = np.argsort(differ[x, y], kind="stable")
        for i, j in zip(o[x[order]].tolist(), inside[y[order]].tolist(), strict=True):
            p, q = _root(up, label[i]), _root(up, label[j])
            if p == q or (bands[i, :here] == bands[j, :here]).any():  # a pair is checked in its first common band
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            if 100 * same >= percent * (len(both) - same):
                up[max(p, q)] = min(p, q)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _joined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Cells, whose rows follow one another, to their links."""
    for cell in runs(batches, "cell"):
        links = _cell_links(cell, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    A text's set holds the distinct runs of `words` words (white space apart, A-Z lower-cased); fewer words
    make one shingle; null, empty or blank texts have an empty set and stay alone. Texts are linked when
    100 * intersection >= percent * union, checked on the full sets (as 64-bit hashes). component_id is the
    smallest id reachable; kept marks it. A row with a null id is never linked and has a null component.
    Repeated rows each give a row; an empty table gives none. Columns beside id_col and text_col aren't read,
    so their names don't matter. Whole texts are read, however long.

    Texts of equal sets are one class from the start, so copies cost one row each and make no pairs. Each member
    of a band bucket is first checked against the smallest of its buckets' smallest members. Buckets that still hold several
    components are then finished inside Arrow tasks: members outside the bucket's largest component are compared
    with all members by counting bits of the signatures, and likely pairs of components that aren't joined yet on their full
    sets. Only the links that join components become rows, so a group of near copies gives rows in proportion to its size.
    A full bucket is dealt into cells, so none is more than one task holds; no candidate is capped. With 32
    bands of 5 a pair at 0.8 is missed once in 300,000.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = cut(arrow_map(src, lambda it: _sketches(it, words), _SKETCH), "mh-sketch")
    sig = [f"s{i}" for i in range(WORDS64)]
    classes = sk.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in sig], F.min_by("bands", "id").alias("bands")
    )
    classes = cut(classes, "mh-classes")
    entries = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    full = cut(entries.groupBy("key", "band").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1"), "mh-keys")
    multi = cut(entries.join(full, ["key", "band"]), "mh-buckets")
    marks = cut(classes.select("rep", "n", *sig), "mh-marks")
    side = F.struct("n", *sig)
    # each member with the smallest of its buckets' smallest members
    first = multi.groupBy("rep").agg(F.min("lead").alias("a")).where("rep <> a").select("a", F.col("rep").alias("b"))
    first = first.join(marks.select(F.col("rep").alias("a"), side.alias("x")), "a").join(marks.select(F.col("rep").alias("b"), side.alias("y")), "b")
    first = cut(first.where(_likely("x", "y", percent)).select("a", "b"), "mh-first")
    links = _verified(first, src, words, percent)
    # of buckets with several components those outside the largest with all members
    cc = cut(components(links), "mh-cc").withColumnRenamed("id", "rep")
    now = cut(multi.select("key", "band", "rep").join(cc, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "mh-labels")
    size = now.join(marks.select("rep", "n"), "rep").groupBy("key", "band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    top = size.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("k"), F.max_by(F.struct("component", "m", "w"), F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w")
    )
    cells = lambda m, w: F.ceil(F.greatest(m / CELL_ROWS, w / CELL_SHINGLES)).cast("int")
    top = top.where("k > 1").select(
        "key", "band", F.col("top.component").alias("largest"), cells(F.col("m"), F.col("w")).alias("across"), cells((F.col("m") - F.col("top.m")) * 4, F.col("w") - F.col("top.w")).alias("down")
    )
    more = cut(now.join(cut(top, "mh-top"), ["key", "band"]), "mh-open")
    ids = cut(more.select(F.col("rep").alias("id")).distinct(), "mh-ids")
    sets = arrow_map(src.join(ids, "id", "left_semi").select("id", "text"), lambda it: _sets(it, words), "id long, set binary")
    sets = cut(sets.groupBy(F.col("id").alias("rep")).agg(F.first("set").alias("set")), "mh-sets")
    row, column = F.pmod(F.xxhash64("rep", F.lit(1)), "down").cast("int"), F.pmod(F.xxhash64("rep", F.lit(2)), "across").cast("int")
    out_there = F.col("component") != F.col("largest")
    as_member = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda d: F.struct(d.alias("d"), column.alias("c")))
    as_outsider = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda c: F.struct(row.alias("d"), c.alias("c")))
    dealt = more.withColumn("at", F.explode(F.when(out_there, F.array_union(as_member, as_outsider)).otherwise(as_member)))
    dealt = dealt.select(
        F.concat_ws("/", "key", "band", "at.d", "at.c").alias("cell"), "rep", "band", "component",
        (out_there & (F.col("at.d") == row)).alias("outsider"), (F.col("at.c") == column).alias("member"),
    )
    dealt = dealt.join(classes.select("rep", "n", *sig, "bands"), "rep").join(sets, "rep").repartition("cell").sortWithinPartitions("cell", "rep")
    later = cut(arrow_map(dealt, lambda it: _joined(it, percent), "a long, b long"), "mh-later")
    links = cut(links.unionByName(later), "mh-links")
    cc = cut(components(links), "mh-cc")
    named = classes.select("k1", "k2", "n", "rep").join(cc.withColumnRenamed("id", "rep"), "rep", "left")
    named = cut(named.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component")), "mh-named")
    for t in (full, multi, first, now, more, ids, sets, later, links, cc, marks, classes):
        discard(t)
    out = sk.select("id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept")
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


#: The same rows in DuckDB: shingle sets compared through an inverted index, then reachability.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w
), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS one FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.one = b.one AND a.doc_id < b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS other FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.id
"""
