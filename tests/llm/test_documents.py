import random
from collections import defaultdict

import numpy as np
import pytest

from lexiloom.llm import op3_line_dedup, op4_sharding, op8_minhash

from .helpers import components, crc, documents, frame, prose, save, shingle_set, words


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = save(frame(spark, documents()), tmp_path_factory.mktemp("docs") / "documents.parquet")
    return spark.read.parquet(path)


def _edit(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _near(x: str, y: str) -> bool:
    p, q = words(x), words(y)
    least = min(len(p), len(q))
    if least >= 12:
        edits = min(6, 2 + max(0, (least - 75) // 75))
        return abs(len(p) - len(q)) <= edits and _edit(p, q) <= edits
    return min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 2 and _edit(x, y) <= 2


def _lines_brute(rows):
    """By row (id, text): [copies, near, dropped], as the docstring of repeated_lines says."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    lines = [(k, r, p, x.strip()) for k, r in enumerate(order) if rows[r][1] is not None for p, x in enumerate(rows[r][1].split("\n"))]
    first: dict[str, tuple] = {}
    for k, _, p, x in lines:
        if x:
            first.setdefault(x, (k, p))
    near = {x for x in first for y in first if first[y] < first[x] and _near(x, y)}
    out = {r: [0, 0, []] for r in range(len(rows))}
    for k, r, p, x in lines:
        if x and (copy := first[x] != (k, p)) | (x in near):
            out[r][0 if copy else 1] += 1
            out[r][2].append(p)
    return [out[r] for r in range(len(rows))]


def _check_lines(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _row string, row string").coalesce(1)
    got = [[r["n_copies"], r["n_near"], list(r["dropped"])] for r in sorted(op3_line_dedup.repeated_lines(table.withColumn("id", table.row)).collect(), key=lambda r: (r["id"] is not None, r["id"] or 0))]
    want = _lines_brute(rows)
    key = lambda v: str(v)
    assert sorted(got, key=key) == sorted(want, key=key)
    return table, want


def test_op3_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 5000 or text is null").collect()]
    _, want = _check_lines(spark, rows)
    by_id = {i: w for (i, _), w in zip(rows, want, strict=True)}
    assert by_id[5][1] == 1 and by_id[6][0] == 1
    assert op3_line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_op3_long_lines(spark):
    """Lines of 8 to 330 words, altered in up to four words or characters."""
    r, rows = random.Random(4), []
    for k in range(90):
        base = prose(500 + k % 30, (8, 11, 12, 13, 40, 70, 99, 148, 149, 150, 151, 330)[k % 30 % 12]).split()
        line = list(base)
        for _ in range(r.randrange(0, 5)):
            i = r.randrange(len(line))
            line[i : i + 1] = r.choice(([], ["other"], [line[i], "more"], [line[i] + "x"]))
        rows.append((k, prose(k, 3) + "\n" + " ".join(line)))
    _, want = _check_lines(spark, rows)
    assert sum(w[1] for w in want) > 10


def test_op3_group_of_near_lines(spark, monkeypatch):
    """300 variants of a line, most of them further than the threshold from the earliest, dealt into several cells."""
    monkeypatch.setattr(op3_line_dedup, "CELL_ROWS", 64)
    r, base, rows = random.Random(3), prose(31, 40).split(), []
    for k in range(300):
        line = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            line[r.randrange(40)] = f"other{r.randrange(3)}"
        rows.append((k, " ".join(line)))
    r.shuffle(rows)
    _, want = _check_lines(spark, rows)
    assert 100 < sum(w[1] for w in want) < 300


def test_op3_rows_that_share_an_id(spark):
    rows = [(7, "L\nsecond of the first text"), (7, "top of the other text\nL"), (None, "L"), (None, "alone"), (None, None), (7, "L\nsecond of the first text"), (8, ""), (8, "a" * 150_000 + "\n" + "a" * 150_000)]
    table, want = _check_lines(spark, rows)
    assert want[0] == [1, 0, [0]] and want[1] == [1, 0, [1]] and want[2] == [0, 0, []] and want[7] == [1, 0, [1]]
    kept = sorted((str(r["doc_id"]), str(r["text"])[:30]) for r in op3_line_dedup.without_repeated_lines(table).collect())
    assert kept == sorted([("7", "second of the first text"), ("7", "top of the other text"), ("None", "L"), ("None", "alone"), ("None", "None"), ("8", ""), ("8", "a" * 30)])


def test_op3_cuts_lines(spark, docs):
    kept = {r["doc_id"]: r["text"] for r in op3_line_dedup.without_repeated_lines(docs).collect()}
    assert 1 not in kept and 0 in kept and kept[16] == "a\nb" and kept[8] is None and kept[7] == "" and "stands in" not in kept[6]


def test_op4_is_the_smallest_capacity(spark, docs):
    rows = op4_sharding.shard_documents(docs).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["text"]].append(r["doc_id"])
    assert len(rows) == docs.count()
    loads, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for t, ids in texts.items():
        for r in rows:
            if r["doc_id"] in ids:
                of_text[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in of_text.items() if t is not None)
    size = lambda t: len((t or "").encode()) + 1
    assert sum(loads.values()) == sum(size(t) * len(i) for t, i in texts.items())
    import hashlib

    groups = [size(t) * len(i) for t, i in sorted(texts.items(), key=lambda g: b"" if g[0] is None else hashlib.sha256(g[0].encode()).digest())]

    def fits(cap):
        n, load = 1, 0
        for g in groups:
            if g > cap:
                return False
            n, load = (n, load + g) if load + g <= cap else (n + 1, g)
        return n <= op4_sharding.SHARDS

    best = next(c for c in range(max(groups), sum(groups) + 1) if fits(c))
    assert max(loads.values()) == best
    assert all(r["text_crc32"] >= 0 for r in rows) and op4_sharding.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_op8_against_brute_force(spark, docs, n):
    got = op8_minhash.near_duplicates(docs, words=n).collect()
    rows = docs.select("doc_id", "text").collect()
    sets = {r[0]: shingle_set(r[1], n) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i), i
    assert op8_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_op8_on_a_table(spark):
    """Every link of a whole table, found by brute force over shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r[0]: shingle_set(r[1], 2) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    got = op8_minhash.op8_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_null_ids(spark, docs):
    nulls = docs.selectExpr("cast(null as long) as doc_id", "text").limit(3)
    assert op4_sharding.shard_documents(nulls).count() == 3
    assert {r["component_id"] for r in op8_minhash.near_duplicates(nulls).collect()} == {None}
    assert op3_line_dedup.repeated_lines(nulls).count() == 3 and crc("x") > 0


def test_op8_group_of_near_copies(spark):
    """2,000 copies of a text with 0 to 24 of 150 words changed: most pairs are somewhat above or below the threshold."""
    r, base, rows = random.Random(9), prose(77, 150).split(), []
    for i in range(2000):
        w = list(base)
        for _ in range(r.choice((2, 5, 9, 12, 16, 24))):
            w[r.randrange(150)] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = op8_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    names: dict = {}
    sets = [np.array(sorted(names.setdefault(x, len(names)) for x in shingle_set(t, 2))) for _, t in rows]
    shared = np.zeros((2000, 2000), np.int32)
    holders = defaultdict(list)
    for i, x in enumerate(sets):
        for v in x.tolist():
            holders[v].append(i)
    for h in holders.values():
        if len(h) > 1:
            shared[np.ix_(h, h)] += 1
    size = np.array([len(x) for x in sets])
    a, b = np.nonzero(np.triu(100 * shared >= 80 * (size[:, None] + size[None] - shared), 1))
    comp = components(range(2000), zip(a.tolist(), b.tolist(), strict=True))
    assert {x["doc_id"]: x["component_id"] for x in got} == comp and len(set(comp.values())) > 100
