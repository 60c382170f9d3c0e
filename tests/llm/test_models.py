import zlib

import numpy as np
import pytest

from lexiloom.llm import op5_embeddings, op6_langid, op7_packing, op9_toxicity, op10_decontaminate

from .helpers import components, documents, frame, prose, save

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = save(frame(spark, documents()), tmp_path_factory.mktemp("docs") / "documents.parquet")
    return spark.read.parquet(path)


def test_op5_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(scale=0.03 * (i % 4), size=16)], i % 3) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [float(x) for x in base[0]], None), (304, rows[0][1], 0), (305, rows[0][1], 1), (306, [], 0), (307, [1.0, None], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as id", "1 as rep", "2 as dim")
    usable = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = []
    for x, (i, v, l) in enumerate(usable):
        for j, w, m in usable[x + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((i, j))
    comp = components([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in op5_embeddings.links_of(table).collect()}
    assert len(got) == len(rows)
    want_links, found = sum(degree.values()), sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= degree[i] for i in got) and found >= 0.9 * want_links
    assert sum(got[i]["component_id"] == comp[i] for i in got) >= 0.95 * len(got)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert op5_embeddings.links_of(table.limit(0)).count() == 0


def _dense(seed, n):
    """Groups of vectors around the threshold, one of them with a third of all rows, in one label."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 12))
    pick = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 30, n))
    return base[pick] + rng.normal(scale=0.12, size=(n, 12))


def test_op5_on_several_shards(spark):
    x = _dense(4, 700)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = np.triu(unit @ unit.T >= 0.98, 1)
    comp = components(range(len(x)), np.argwhere(true).tolist())
    degree = (true | true.T).sum(axis=1)
    got = {r["vec_id"]: r for r in op5_embeddings.links_of(table, cluster=60, shard=90).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(x) and found >= 0.9 * degree.sum() and all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(got[i]["component_id"] == comp[i] for i in got) >= 0.95 * len(got)


def test_op5_link_missed_by_one_shard_counts_once():
    x = _dense(5, 40)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = np.triu(unit @ unit.T >= 0.9, 1)
    true |= true.T
    shards = [["a", "b"] if i % 2 else ["a", "b", "c"] for i in range(40)]
    ids, copies = np.arange(40), np.ones(40, int)
    less = true.copy()
    i, j = np.argwhere(true)[0]
    less[i, j] = less[j, i] = False
    a, b = (op5_embeddings._sums(m, ids, copies, shards) for m in (true, less))
    both = a.merge(b, on=["id", "common"], how="outer")
    off = both[(both["links_x"] != both["links_y"]) | (both["sum_x"] != both["sum_y"])]
    assert set(off["id"]) == {i, j}
    nodes = op5_embeddings.pd.DataFrame({"id": ids, "unit": [u.tobytes() for u in unit], "copies": copies, "shards": shards})
    again = op5_embeddings._settled(nodes, off, 0.9).groupby("id")["links"].sum()
    assert all(again[v] == a[(a["id"] == v) & a["common"].isin(off["common"])]["links"].sum() for v in (i, j))
    assert a.groupby("id")["links"].sum().reindex(ids, fill_value=0).tolist() == true.sum(axis=1).tolist()
    assert (op5_embeddings._roots(true) == [components(range(40), np.argwhere(true).tolist())[v] for v in range(40)]).all()


def test_op5_recall_on_a_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert op5_embeddings.audit_recall(vectors, op5_embeddings.links_of(vectors)) >= 0.9


def test_op6_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op6_langid.op6_language_id(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    asked = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"] and got[r["doc_id"]]["lang_pred"] != "und"]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in asked]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op6_counts_against_sets(spark, docs):
    """Bloom counts, corrected, against exact sets of n-grams."""
    filters, _ = op6_langid.fit(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as id", "text", "lang"))
    rng = np.random.default_rng(1)
    own = {x: rng.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32) for x in ("aa", "bb", "cc")}
    slices = op6_langid.BloomSlices(own)
    texts = [np.concatenate([own["aa"][:700], own["bb"][:200], rng.integers(0, 2**32, 600, dtype=np.uint64).astype(np.uint32)]), own["cc"], np.zeros(0, np.uint32)]
    bounds = np.cumsum([0, *map(len, texts)])
    got = slices.counts(np.concatenate(texts), bounds)
    want = np.array([[np.isin(t, own[x]).sum() for x in slices.langs] for t in texts])
    assert np.abs(got - want).max() <= 30 and (got.argmax(axis=1)[:2] == want.argmax(axis=1)[:2]).all() and (got[2] == 0).all()
    assert len(filters.langs) == 4


def test_op6_without_labels(spark, docs):
    filters, usual = op6_langid.fit(docs.selectExpr("doc_id as id", "text", "cast(null as string) as lang"))
    got = op6_langid.identify(docs, filters, usual).collect()
    assert len(got) == docs.count() and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert op6_langid.identify(docs.limit(0), *op6_langid.fit(docs.limit(0).selectExpr("doc_id as id", "text", "lang"))).count() == 0


def test_op6_cases(spark, docs):
    filters, usual = op6_langid.fit(docs.selectExpr("doc_id as id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6_langid.identify(docs, filters, usual).collect()}
    assert got[8] == got[7] == got[9] == got[19] == ("und", 0.0) and got[12][0] in ("en", "de")
    assert op6_langid.identify(docs.limit(0), filters, usual).count() == 0


@pytest.mark.parametrize("shard", [2, 4096])
def test_op7_round_trip(spark, docs, shard):
    from tokenizers import Tokenizer

    path = op7_packing.default_path()
    full = Tokenizer.from_file(path)
    plain = docs.dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in plain.collect()}
    pieces = op7_packing.pack(plain, path, shard=shard).collect()
    cover, windows = {i: [] for i in ids}, {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        cover[p["doc_id"]].append((p["start"], p["length"]))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, spans in cover.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == len(ids[i])
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    assert op7_packing.pack(plain.limit(0), path).count() == 0
    assert sum(p["doc_tokens"] for p in op7_packing.pack(docs, path).where("start = 0").collect()) >= sum(map(len, ids.values()))


def test_op7_tokenizer_equals_the_library():
    """Signs, odd white space, other scripts, marks and special tokens, in runs with their neighbours."""
    rng = np.random.default_rng(2)
    parts = ["word", "Été", "naïve.", "a.", "b..", "c,", "É!", "×.", "don't", "x1.", "12.5", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "İ", "日本", "<|", "<|endoftext|>", "(end).", "ǆ;", "«q»", "...", "?", "ß:", "é.", "\u2028"]
    texts = ["", ".", "a.", "a. ", "\x1f", *("".join(rng.choice(parts, 6)) for _ in range(400)), *(" ".join(rng.choice(parts[:14], 9)) for _ in range(100))]
    tok = op7_packing.WordTokenizer(op7_packing.default_path())
    raw = [t.encode() for t in texts]
    got, odd = tok.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert len(got) == len(texts) and 50 < len(odd) < 450
    for i in set(range(len(texts))) - set(odd.tolist()):
        assert got[i] == tok.whole(texts[i]), texts[i]


def test_op9_held_out(spark):
    # about one label in eight of the toxic documents stands at a text without any insult, so 0.8 is near the ceiling
    large = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in op9_toxicity.op9_toxicity(spark, large).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{large}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    asked = [(got[i]["predicted"], y) for i, y in labels.items() if i in got and got[i]["held_out"] and y is not None]
    hit = sum(p == y == 1 for p, y in asked)
    assert hit >= 0.8 * sum(y for _, y in asked) and hit >= 0.8 * sum(p for p, _ in asked)


def test_op9_kernel_against_brute_force():
    """The kernel against an enumeration of all subsequences of three symbols, ends included."""
    from itertools import combinations

    words = ["stupid", "stuxpid", "garden", "aaaa", "abcabcabc", "x1dd"]
    tokens = op9_toxicity.Tokens([" ".join(words)])
    marks = [tokens.text(i) for i in range(len(tokens.start))]

    def weights(t: bytes) -> dict:
        padded, out = (0, *t, 0), {}
        for i, j, k in combinations(range(len(padded)), 3):
            key = (padded[i], padded[j], padded[k])
            out[key] = out.get(key, 0) + op9_toxicity.DECAY ** (k - i + 1)
        return out

    maps = [weights(t) for t in marks]
    dot = lambda p, q: sum(v * q.get(x, 0) for x, v in p.items())
    want = np.array([[dot(p, q) / np.sqrt(dot(p, p) * dot(q, q)) for q in maps] for p in maps])
    assert np.allclose(op9_toxicity.kernel(marks, marks), want, atol=1e-5)
    machine = op9_toxicity.Machine(marks, len(marks), np.ones(len(marks)), 0.5)
    pooled = np.maximum(0, np.exp(op9_toxicity.SHARP * (want - 1)) - np.exp(op9_toxicity.SHARP * (op9_toxicity.NEAR - 1)))
    assert np.allclose(machine.gaussians(marks), pooled, atol=1e-4)
    got = machine.decision(["stupid garden. aaaa!", None, "", "qqqq zzzz"])
    assert np.allclose(got, [0.5 + max(np.maximum(pooled[0], pooled[2]).sum(), pooled[3].sum()), 0.5, 0.5, 0.5], atol=1e-3)


def test_op9_machine_against_a_solver():
    """The accelerated steps against Newton's method on the same squared hinge loss."""
    rng = np.random.default_rng(0)
    x, y, c = rng.normal(size=(80, 3)), np.sign(rng.normal(size=80)), rng.uniform(0.5, 2, 80)
    w, b = op9_toxicity._svm(x, y, c, rounds=3000)
    x1, v = np.concatenate([x, np.ones((80, 1))], axis=1), np.zeros(4)
    for _ in range(50):
        on = y * (x1 @ v) < 1
        v = np.linalg.solve(1e-3 * np.eye(4) + 2 * (x1[on] * c[on, None]).T @ x1[on], 2 * x1[on].T @ (c[on] * y[on]))
    assert np.allclose([*w, b], v, atol=1e-3)


def test_op9_learns_a_rare_insult():
    """An insult in 8 of 400 toxic documents is found, with gaps, beside one in all others; clean documents stay."""
    rng = np.random.default_rng(5)
    plain = lambda k: ". ".join(prose(int(rng.integers(10**6)), 9) for _ in range(4)) + "."
    texts = [plain(k) + (" you vexgrumble thing." if k < 8 else " you dratwibble thing.") for k in range(400)] + [plain(k) + " you nice thing." for k in range(400)]
    machine = op9_toxicity.train(texts, [True] * 400 + [False] * 400)
    asked = [plain(0) + " a vexgrumble.", plain(0) + " a vexgrummble here.", plain(0) + " a dratwibble.", plain(0), plain(0)]
    got = machine.score(machine.decision(asked)) >= 0.3
    assert got.tolist() == [True, True, True, False, False]


def test_op9_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, toxic int")
    machine = op9_toxicity.fit(docs.selectExpr("doc_id as id", "text"), labels)
    got = op9_toxicity.score_toxicity(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op9_toxicity.score_toxicity(docs.limit(0), machine).count() == 0


def test_op10_finds_planted_items(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = {(r["doc_id"], i) for r in plain.collect() for i, t in items if t and r["text"] and t in r["text"]}
    planted = spark.createDataFrame([(900_000 + k, "some words before it " * 30 + items[k][1] + " and others behind it" * 30) for k in range(5)] + [(900_010, None), (900_011, ""), (900_012, "clean words only")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in op10_decontaminate.contaminated(plain.unionByName(planted), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert held <= found and {(900_000 + k, items[k][0]) for k in range(5)} <= found
    assert not any(d >= 900_010 for d, _ in found)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert op10_decontaminate.contaminated(plain, empty).count() == 0
    assert op10_decontaminate.contaminated(plain.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_op10_paraphrases_against_brute_force(spark, monkeypatch):
    """Items with words swapped, left out and put in, over pages of items and ids that items share: all that the rule on
    whole documents tells are found but for one in twenty, and nothing else."""
    monkeypatch.setattr(op10_decontaminate, "ITEMS_PER_PASS", 7)
    rng = np.random.default_rng(6)
    items = [(k // 3, prose(3000 + k, 40) + ". " + prose(4000 + k, 8) + ".") for k in range(30)] + [(50, None), (51, " ")]
    docs = []
    for k in range(120):
        words = items[k % 30][1].split()
        for _ in range(rng.integers(0, 30)):
            i = int(rng.integers(len(words)))
            words[i : i + 1] = [[], ["swapped"], [words[i], "more"]][rng.integers(3)]
        docs.append((k, prose(k, 70) + " " + " ".join(words) + " " + prose(9000 + k, 60)))
    item_hash = op10_decontaminate.word_hashes([t or "" for _, t in items])
    answers = op10_decontaminate.word_hashes([op10_decontaminate.answer_of(t or "") for _, t in items])
    want = set()
    for (d, _), h in zip(docs, op10_decontaminate.word_hashes([t for _, t in docs]), strict=True):
        for (i, _), x, a in zip(items, item_hash, answers, strict=True):
            if len(x):
                share, answer = op10_decontaminate.lcs(x, h) / len(x), op10_decontaminate.lcs(a, h) / len(a)
                if share >= 0.8 or share >= 0.6 and answer >= 0.8:
                    want.add((d, i))
    got = op10_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert len(want) > 40 and found <= want and len(found) >= 0.95 * len(want)


def test_op10_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 20).astype(np.uint64)
        t = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert op10_decontaminate.lcs(a, b) == t[-1, -1]
