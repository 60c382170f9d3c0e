"""Embedding near-duplicates on a robust-pruned flat graph: built on overlapping cluster shards, adjacency
lists united, searched greedily from medoids with the range expanded, every link checked in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, table
from .components import components

COSINE = 0.98
#: Vectors of a cluster that is aimed at, and of a shard at most: a fuller cluster is dealt into blocks, each
#: pair of which is a shard.
CLUSTER, SHARD = 1500, 3000
#: Nearest clusters that a vector joins.
OVERLAP = 2
#: Vectors that the cluster centres are fitted on, at most, over all labels.
SAMPLE = 40_000
#: Robust pruning: candidates, degree and slack; beam width of the search, and nodes expanded at a time.
POOL, DEGREE, ALPHA, BEAM, EXPAND = 48, 16, 1.2, 24, 8
_FOUND = ["id", "root", "common", "owner", "shards", "links", "sum"]


def robust_graph(x: np.ndarray, pool: int = POOL, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (n x degree, -1 where empty) of unit vectors x: of each node's nearest candidates, in order
    of distance, those that no kept one is alpha times nearer to."""
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    c = min(pool, n - 1)
    if c < 1:
        return out
    for a in range(0, n, 256):
        s = x[a : a + 256] @ x.T
        m = len(s)
        s[np.arange(m), np.arange(a, a + m)] = -np.inf
        near = np.argpartition(-s, c - 1, axis=1)[:, :c] if c < n - 1 else np.argsort(-s, axis=1)[:, :c]
        sim = np.take_along_axis(s, near, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * sim))
        v = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))))
        alive = np.ones((m, c), bool)
        rows = np.arange(m)
        for k in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = np.where(some, alive.argmax(axis=1), 0)
            out[a : a + m, k] = np.where(some, near[rows, pick], -1)
            alive &= ~(alpha * between[rows, pick] <= dist) & some[:, None]
            alive[rows, pick] = False
    return out


def range_search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, entry: int, cosine: float, beam: int = BEAM) -> list[np.ndarray]:
    """For each query (a row of x) the nodes with at least that cosine which the search meets. It starts at
    the medoid `entry` and the query's own node, expands the best unexpanded nodes while one is within the `beam` best or within the range, and
    so follows the graph over the whole of a dense range."""
    n, width = len(x), max(1, max((len(g) for g in graph), default=1))
    table_ = np.full((n + 1, width), n, np.int32)
    for i, g in enumerate(graph):
        table_[i, : len(g)] = g
    out: list[np.ndarray] = []
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        m = len(q)
        sim = np.full((m, n + 1), -np.inf, np.float32)
        done = np.zeros((m, n + 1), bool)
        done[:, n] = True
        sim[:, entry] = x[q] @ x[entry]
        sim[np.arange(m), q] = 1.0
        live = np.arange(m)
        k = min(beam, n)
        while len(live):
            open_ = np.where(done[live], -np.inf, sim[live])
            e = min(EXPAND, n)
            top = np.argpartition(-open_, e - 1, axis=1)[:, :e]
            val = np.take_along_axis(open_, top, 1)
            bar = -np.partition(-sim[live], k - 1, axis=1)[:, k - 1]
            good = (val >= np.minimum(bar, cosine)[:, None]) & (val > -np.inf)
            rows, cols = np.nonzero(good)
            if not len(rows):
                break
            done[live[rows], top[rows, cols]] = True
            nb = table_[top[rows, cols]]
            r = np.repeat(live[rows], nb.shape[1])
            nb = nb.ravel()
            fresh = (nb < n) & np.isneginf(sim[r, nb])
            r, nb = r[fresh], nb[fresh]
            sim[r, nb] = np.einsum("ij,ij->i", x[q[r]], x[nb])
            live = live[good.any(axis=1)]
        sim = sim[:, :n]
        out += [np.flatnonzero(row >= cosine - 1e-5) for row in sim]
    return out


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), c)
    return c


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors, scaled to length 1 in double precision: (id, label, dim, unit)."""
    for rb in batches:
        keep, unit = [], []
        for i, v in enumerate(rb.column(1)):
            if v.is_valid and len(v) and rb.column(2)[i].is_valid and not v.values.null_count:
                x = np.asarray(v.values, np.float64)
                if np.isfinite(x).all() and np.any(x):
                    x = x / np.abs(x).max()
                    keep.append(i)
                    unit.append((x / np.linalg.norm(x)).tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rb.column(0).take(at).cast(pa.int64()), rb.column(2).take(at).cast(pa.int64()), pa.array([len(u) // 8 for u in unit], pa.int32()), pa.array(unit, pa.binary())],
            names=["id", "label", "dim", "unit"],
        )


def _assigned(batches: Iterator[pa.RecordBatch], centres: dict, overlap: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        rows = rb.to_pydict()
        lists = []
        for label, dim, u in zip(rows["label"], rows["dim"], rows["unit"], strict=True):
            c = centres.get((label, dim))
            if c is None or len(c) == 1:
                lists.append([0])
            else:
                s = c @ np.frombuffer(u, np.float64)
                lists.append(np.argsort(-s, kind="stable")[:overlap].tolist())
        yield rb.append_column("clusters", pa.array(lists, pa.list_(pa.int32())))


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack([np.frombuffer(u, np.float64) for u in pdf["unit"]]).astype(np.float32)
    ids = pdf["id"].to_numpy()
    g = robust_graph(x)
    return pd.DataFrame({"id": ids, "near": [ids[r[r >= 0]].tolist() for r in g]})


def _profiles(shards: list[list[str]]) -> tuple[np.ndarray, list[frozenset]]:
    """Number of each node's set of shards, and those sets."""
    seen: dict[frozenset, int] = {}
    at = np.array([seen.setdefault(frozenset(s), len(seen)) for s in shards], np.int64)
    return at, list(seen)


def _spot(common: frozenset) -> tuple[str, str, int]:
    """Name of a set of shards, the one of them that settles disputes, and their number."""
    return hashlib.md5("|".join(sorted(common)).encode()).hexdigest(), min(common), len(common)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each id."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _roots(hit: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by the symmetric matrix `hit`."""
    n = len(hit)
    root = np.full(n, -1, np.int64)
    for i in range(n):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(hit[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _sums(hit: np.ndarray, ids: np.ndarray, copies: np.ndarray, shards: list[list[str]]) -> pd.DataFrame:
    """One row for each node and each set of shards that it has in common with nodes it is linked to: how many
    rows those are, and the sum of their ids' hashes (by which shards see whether they found the same)."""
    prof, sets = _profiles(shards)
    mixed, spots, rows = _mixed(ids), {}, []
    for i, own in enumerate(prof.tolist()):
        js = np.flatnonzero(hit[i])
        per: dict[tuple, list[int]] = {}
        for other in np.unique(prof[js]).tolist():
            spot = spots.get((own, other)) or spots.setdefault((own, other), _spot(sets[own] & sets[other]))
            some = js[prof[js] == other]
            sums = per.setdefault(spot, [0, 0])
            sums[0] += int(copies[some].sum())
            sums[1] += int(mixed[some].sum())
        rows += [(int(ids[i]), *spot, n, f"{h % (1 << 64):x}") for spot, (n, h) in per.items()]
    return pd.DataFrame(rows, columns=["id", "common", "owner", "shards", "links", "sum"])


def _search(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """What a shard's search finds: the rows of _sums, and a row (id, root) for each node, without `common`."""
    pdf = pdf.sort_values("id")
    unit = np.stack([np.frombuffer(u, np.float64) for u in pdf["unit"]])
    x, ids, n = unit.astype(np.float32), pdf["id"].to_numpy(), len(pdf)
    place = {v: i for i, v in enumerate(ids.tolist())}
    out: list[set[int]] = [set() for _ in range(n)]
    for i, near in enumerate(pdf["near"]):
        for v in near:
            j = place.get(v)
            if j is not None:  # edges of the united lists lead both ways
                out[i].add(j)
                out[j].add(i)
    graph = [np.array(sorted(s), np.int32) for s in out]
    hit = np.zeros((n, n), bool)
    for i, js in enumerate(range_search(x, graph, np.arange(n), medoid(x), cosine)):
        hit[i, js] = True
    hit |= hit.T
    for i in range(n):
        js = i + 1 + np.flatnonzero(hit[i, i + 1 :])
        hit[i, i:] = False
        hit[i, js[unit[js] @ unit[i] >= cosine]] = True
    hit = np.triu(hit, 1)
    hit |= hit.T
    found = _sums(hit, ids, pdf["copies"].to_numpy(), list(pdf["shards"]))
    tops = pd.DataFrame({"id": ids, "root": ids[_roots(hit)], "common": None, "owner": None, "shards": 0, "links": 0, "sum": None})
    return pd.concat([found.assign(root=found["id"]), tops])[_FOUND].astype({c: "int64" for c in ("id", "root", "shards", "links")})


def _settled(pdf: pd.DataFrame, disputes: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(id, links, root) for each dispute (id, common) of a shard: its links with the nodes that have just those
    shards in common with it, by comparing it with all of them."""
    if pdf.empty or disputes.empty:
        return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
    pdf = pdf.sort_values("id")
    unit = np.stack([np.frombuffer(u, np.float64) for u in pdf["unit"]])
    ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
    prof, sets = _profiles(list(pdf["shards"]))
    place, rows = {v: i for i, v in enumerate(ids.tolist())}, []
    for v, common in zip(disputes["id"].tolist(), disputes["common"].tolist(), strict=True):
        i = place[v]
        fits = np.array([_spot(sets[prof[i]] & s)[0] == common for s in sets])
        js = np.flatnonzero(fits[prof])
        js = js[(js != i) & (unit[js] @ unit[i] >= cosine)]
        rows += [(v, int(copies[js].sum()), v)] + [(v, 0, int(ids[j])) for j in js]
    return pd.DataFrame(rows, columns=["id", "links", "root"])


def links_of(
    vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cluster: int = CLUSTER, shard: int = SHARD,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors.

    Rows of one label and dimension are linked when their cosine in double precision is at least `cosine`.
    Vectors that are null, empty, zero or hold a null or non-finite component, and those without a label,
    link with nothing; so do rows without an id, whose component is null. Equal vectors (in direction and to
    the last bit) are one node of the graph with a count, so copies make no edges. No pair leaves a shard:
    each gives a count for each node and set of shards that several links have in common. Shards that could
    all see the same links and count other ones have those nodes compared anew, in one of them, so a link found
    anywhere counts, and once. Repeated rows each give a row and link each other, as any two
    equal vectors. Other columns, whatever their names, are not read. An empty table gives none.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    unit = cut(arrow_map(src.where("id is not null"), _unit, "id long, label long, dim int, unit binary"), "emb-unit")
    members = unit.select("id", "label", "dim", "unit", F.xxhash64("unit").alias("h"), F.crc32("unit").alias("c"))
    nodes = cut(members.groupBy("label", "dim", "h", "c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "emb-nodes")
    sizes = {(r[0], r[1]): r[2] for r in nodes.groupBy("label", "dim").count().collect()}
    total = sum(sizes.values())
    part = min(1.0, SAMPLE / max(1, total))
    sample = nodes.where((F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)).select("label", "dim", "unit").limit(2 * SAMPLE).toPandas()
    rng, centres = np.random.default_rng(8), {}
    for key, own in sample.groupby(["label", "dim"]):
        x = np.stack([np.frombuffer(u, np.float64) for u in own["unit"]])
        k = min(-(-sizes[key] // cluster), max(1, len(x) // 8))
        centres[key] = _centres(x, k, rng) if k > 1 else x[:1]
    flat = nodes.select(F.col("rep").alias("id"), "label", "dim", "unit", "copies")
    flat = assigned = cut(arrow_map(flat, lambda it: _assigned(it, centres, overlap), "id long, label long, dim int, unit binary, copies long, clusters array<int>"), "emb-assigned")
    name = F.concat_ws("/", "label", "dim", "cluster")
    each = flat.select("id", F.explode("clusters").alias("cluster"), "label", "dim").select("id", name.alias("cluster"))
    blocks = each.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("blocks"))
    blocks = cut(blocks.where("blocks > 1"), "emb-blocks")  # clusters too full for one shard
    placed = each.join(blocks, "cluster", "left").withColumn("b", F.when(F.col("blocks") > 1, 2 * F.col("blocks")))
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("b")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.concat_ws("/", "cluster", F.least(o, mine), F.greatest(o, mine)))
    placed = placed.withColumn("own", F.when(F.col("b").isNull(), F.array("cluster")).otherwise(pairs))
    shards = placed.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("shards"))
    flat = cut(flat.select("id", "unit", "copies").join(shards, "id"), "emb-shards")
    dealt = flat.withColumn("shard", F.explode("shards"))
    lists = dealt.select("id", "unit", "shard").groupBy("shard").applyInPandas(_graph, "id long, near array<long>")
    near = cut(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "emb-graph")
    found = flat.join(near, "id").withColumn("shard", F.explode("shards"))
    found = found.groupBy("shard").applyInPandas(lambda p: _search(p, cosine), "id long, root long, common string, owner string, shards int, links long, sum string")
    found = cut(found, "emb-found")
    seen = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("shards", "links", "sum", "owner")]]
    counts = found.where("common is not null").groupBy("id", "common").agg(*seen)
    counts = cut(counts.withColumn("agreed", F.expr("n = max_shards and min_links = max_links and min_sum = max_sum")), "emb-counts")
    links, roots = counts.where("agreed").select("id", F.col("max_links").alias("links")), found.where("id <> root").select("id", "root")
    disputes = counts.where("not agreed").select("id", "common", F.col("max_owner").alias("shard"))
    if not disputes.isEmpty():
        there = dealt.join(disputes.select("shard").distinct(), "shard", "left_semi")
        again = there.groupBy("shard").cogroup(disputes.groupBy("shard")).applyInPandas(lambda p, d: _settled(p, d, cosine), "id long, links long, root long")
        again = cut(again, "emb-again")
        links, roots = links.unionByName(again.select("id", "links")), roots.unionByName(again.where("id <> root").select("id", "root"))
    links = links.groupBy("id").agg(F.sum("links").alias("links"))
    cc = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = nodes.select("label", "dim", "h", "c", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(cc.withColumnRenamed("id", "rep"), "rep", "left")
    per = cut(per.select("label", "dim", "h", "c", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "emb-per")
    for t in (nodes, assigned, flat, blocks, near, found, counts):
        discard(t)
    known = members.select("id", "label", "dim", "h", "c").join(per, ["label", "dim", "h", "c"]).select("id", "links", "component")
    # rows that link with nothing stand alone
    usable = unit.select("id").distinct().withColumn("usable", F.lit(True))
    alone = src.select("id").join(usable, "id", "left").where("usable is null")
    out = known.unionByName(alone.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, found: DataFrame, cosine: float = COSINE, every: int = 20) -> float:
    """Share of the true links of the vectors with vec_id % every = 0 that `found` (of links_of) has: those
    queries are compared with all rows, in blocks of the batches that are read."""
    rows = vectors.where(F.col("vec_id") % every == 0)
    unit = arrow_map(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), _unit, "id long, label long, dim int, unit binary").toPandas()
    if unit.empty:
        return 1.0

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _unit(batches):
            if rb.num_rows:
                other = rb.to_pandas()
                for key, q in unit.groupby(["label", "dim"]):
                    o = other[(other["label"] == key[0]) & (other["dim"] == key[1])]
                    if len(o):
                        s = np.stack([np.frombuffer(u, np.float64) for u in q["unit"]]) @ np.stack([np.frombuffer(u, np.float64) for u in o["unit"]]).T
                        n = ((s >= cosine) & (q["id"].to_numpy()[:, None] != o["id"].to_numpy()[None])).sum(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(q["id"].to_numpy()), pa.array(n)], names=["id", "n"])

    true = arrow_map(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), against, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    a, b = true.join(found.select(F.col("vec_id").alias("id"), "n_links"), "id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return b / a if a else 1.0


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(table(spark, sf_dir, "embeddings"))


#: The same rows in DuckDB: every pair of a label, then reachability.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
), u AS (
  SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT DISTINCT a AS id, a AS other FROM links UNION SELECT r.id, e.b FROM reach r JOIN links e ON r.other = e.a),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.id
"""
