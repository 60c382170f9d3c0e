"""Lexical retrieval packing: for each seed document a sharded BM25 inverted index returns unused
neighbours, which greedily fill its window of tokens."""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_map, cut, runs, table
from .words import SPACES, pieces, spans

WINDOW = 4096
END = 2
#: Documents of a shard of the index, and tokens that count as one document; a longer text counts as several.
SHARD, DOC_TOKENS = 4096, 2048
#: Lanes of a shard that are filled at the same time, at most, and windows of a lane that are aimed at below that.
MOST_LANES, ROUNDS = 64, 8
#: The most frequent terms, which are scored by a matrix product.
HOT_TERMS = 1024
#: BM25 weights are multiples of 1 / SCALE; single precision, in which candidates are found, is off by less than MARGIN.
SCALE, MARGIN = 1 << 20, 0.1 * (1 << 20)
K1, B = 1.2, 0.75
ROUTE_BITS = 16
#: Words whose ids a worker remembers, at most.
CACHE_WORDS = 300_000
_PAT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_MARK = b"\xff"  # no byte of UTF-8; stands for the end of a word
_BYTES = np.arange(256)
_CLASS = ((_BYTES >= 0x1C) & (_BYTES <= 0x1F)) | (_BYTES >= 0xC9) | np.isin(_BYTES, [0xC2, 0xC4, ord("<")])
_SIGN, _LETTER = np.isin(_BYTES, list(b".,;:!?")), np.isin(_BYTES | 32, range(97, 123)) & (_BYTES < 128)


class WordTokenizer(dict):
    """Ids of whole texts under a word-end BPE file of the tokenizers library, as 16-bit bytes.

    Its words are found apart from each other, so ids are kept by word; new words are merged by tiktoken, in
    which a word's end is a byte of its own that merges first. Ids are those of Tokenizer.encode."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.full = path, None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        assert len(vocab) <= 65536
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {}
        for t, i in vocab.items():
            end = t.endswith("</w>")
            body = t[:-4] if end else t
            if not t.startswith("<|"):
                ranks[bytes(byte[c] for c in body) + _MARK * end] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            out = array("H", self.merge(word.encode() + _MARK)).tobytes()
        else:
            out = array("H", [i for p in _PAT.findall(word) for i in self.merge(p.encode() + _MARK)]).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text of a run, given as UTF-8 bytes and bounds, and the texts left out, for whole()."""
        odd = _odd(data, off)
        if odd.any():
            data = data.copy()
            for d in np.flatnonzero(odd):
                data[off[d] : off[d + 1]] = 32
        at = np.sort(np.concatenate([_signs(data), off[1:-1]]))  # a space before each, so that it is a word of its own
        off, data = off + np.searchsorted(at, off), np.insert(data, at, np.uint8(32))
        first = spans(data, off, SPACES)[2].tolist()
        words = list(map(self.__getitem__, data.tobytes().decode().lower().split()))
        return [b"".join(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.flatnonzero(odd)

    def whole(self, text: str) -> bytes:
        """The ids of one text by the tokenizers library itself."""
        if self.full is None:
            self.full = Tokenizer.from_file(self.path)
        return array("H", self.full.encode(text, add_special_tokens=False).ids).tobytes()


def _odd(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with white space that Python splits at and the tokenizer doesn't, special tokens, or characters
    beyond Latin letters: these go through the tokenizers library as they are."""
    at = np.flatnonzero(_CLASS[data])
    at = at[at + 1 < len(data)] if len(at) else at
    b, after = data[at], data[at + 1] if len(at) else data[at]
    bad = ((b >= 0x1C) & (b <= 0x1F)) | (b >= 0xCA) | ((b == 0xC9) & (after >= 0x90)) | ((b == 0xC2) & ((after == 0x85) | (after == 0xA0)))
    bad |= ((b == 0xC4) & (after == 0xB0)) | ((b == ord("<")) & (after == ord("|")))
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, at[bad], "right") - 1] = True
    if len(data) and (0x1C <= data[-1] <= 0x1F):
        out[np.searchsorted(off, len(data) - 1, "right") - 1] = True
    return out


def _signs(data: np.ndarray) -> np.ndarray:
    """Places of single signs between an ASCII letter and white space: pieces of their own."""
    at = np.flatnonzero(_SIGN[data])
    at = at[(at > 0) & (at + 1 < len(data))]
    return at[_LETTER[data[at - 1]] & SPACES[data[at + 1]]]


def tokenizer(path: str) -> WordTokenizer:
    kept = sys.__dict__.setdefault("_lexiloom_tokenizers", {})  # one for each worker process
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def _planes() -> np.ndarray:
    """Random planes for the 65536 ids; rare (late) ids weigh more."""
    return np.random.default_rng(3).standard_normal((65536, ROUTE_BITS)).astype(np.float32) * np.log1p(np.arange(65536, dtype=np.float32))[:, None]


def _tokenized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows with their number of ids, route and ids; at the end one row with the task's document frequencies.

    The route is the rank, in Gray-code order, of the signs of a document's projections on random planes:
    documents with like terms are near each other in it."""
    tok, zip_, planes = tokenizer(path), zstandard.ZstdCompressor(level=1), _planes()
    end, place, df = np.uint16(END).tobytes(), np.arange(ROUTE_BITS - 1, -1, -1), np.zeros(65536, np.int64)
    names, kind = ["id", "n", "route", "ids", "df"], None
    for rows, data, off in pieces(batches):
        n, ids, terms, kind = [], [], [], rows.column(0).type
        plain, odd = tok.ids(data, off)
        for i in odd.tolist():
            plain[i] = tok.whole(rows.column(1)[i].as_py())
        for b in plain:
            b += end
            n.append(len(b) // 2)
            ids.append(zip_.compress(b))
            terms.append(np.unique(np.frombuffer(b, np.uint16)))
        every = np.concatenate(terms)
        df += np.bincount(every, minlength=65536)
        signs = np.add.reduceat(planes[every], np.cumsum([0, *map(len, terms[:-1])])) > 0
        route = (np.bitwise_xor.accumulate(signs, axis=1).astype(np.int64) << place).sum(axis=1)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(route), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())], names=names)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zip_.compress(df.tobytes())], pa.binary())], names=names)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, unzip = np.zeros(65536, np.int64), zstandard.ZstdDecompressor()
    for rb in batches:
        for v in rb.column(0):
            df += np.frombuffer(unzip.decompress(v.as_py()), np.int64)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])


class Index:
    """A BM25 inverted index over a shard's documents (terms, their counts, lengths), with idf and mean length of
    the whole corpus. Weights are multiples of 1 / SCALE, so sums are exact in any order. The terms of `hot` are
    kept as a dense matrix, also in single precision, all others as postings."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], size: np.ndarray, idf: np.ndarray, mean: float, hot: np.ndarray):
        doc, term, tf = np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate(terms), np.concatenate(counts)
        w = np.rint(SCALE * idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean)))
        self.n, self.hot, at = len(terms), hot, hot[term]
        self.dense = np.zeros((self.n, int(hot.max()) + 1))
        self.dense[doc[at >= 0], at[at >= 0]] = w[at >= 0]
        self.single = self.dense.astype(np.float32).T.copy()
        doc, term, w = doc[at < 0], term[at < 0], w[at < 0]
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], w[order]
        self.begin = np.searchsorted(term[order], np.arange(65537))

    def nearest(self, seeds: list[np.ndarray], free: np.ndarray, k: int) -> list[np.ndarray]:
        """For the terms of each seed the k free documents with the largest BM25, ties by place."""
        which, t = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds]), np.concatenate(seeds)
        at = self.hot[t]
        q = np.zeros((len(seeds), len(self.single)), np.float32)
        q[which[at >= 0], at[at >= 0]] = 1
        which, t = which[at < 0], t[at < 0].astype(np.int64)
        lo, size = self.begin[t], self.begin[t + 1] - self.begin[t]
        place = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(which * self.n, size) + self.posting_doc[place]
        rest = np.bincount(cell, weights=self.posting_weight[place], minlength=len(seeds) * self.n).reshape(len(seeds), self.n)
        about, some, out = q @ self.single, np.flatnonzero(free), []
        about += rest
        for i, row in enumerate(about[:, some]):
            least = np.partition(row, len(row) - k)[len(row) - k] - MARGIN if len(row) > k else -np.inf
            top = some[row >= least]
            few = len(top) < 8 * k  # copies have equal values, so there may be many
            hot = self.dense[top[:, None], np.flatnonzero(q[i])[None]].sum(axis=1) if few else (self.dense @ q[i].astype(np.float64))[top]
            exact = hot + rest[i, top]
            out.append(top[np.argsort(-exact, kind="stable")[:k]])
        return out


class Packer:
    """Lanes that fill windows one after another; what a document has beyond a window's end begins its lane's
    next one. Only ranks and lengths are known here. out: (rank, start, length, sequence, offset)."""

    def __init__(self, lanes: int, window: int = WINDOW):
        self.window, self.sequence, self.out = window, 0, []
        self.now, self.used = [[] for _ in range(lanes)], [0] * lanes

    def _close(self, pieces_: list) -> None:
        at = 0
        for rank, start, n in pieces_:
            self.out.append((rank, start, n, self.sequence, at))
            at += n
        self.sequence += 1

    def add(self, lane: int, rank: int, n: int, start: int = 0) -> bool:
        """Appends what a document has from start to n; True if a window was filled on the way."""
        filled = False
        while start < n:
            take = min(n - start, self.window - self.used[lane])
            self.now[lane].append((rank, start, take))
            self.used[lane] += take
            start += take
            if self.used[lane] == self.window:
                self._close(self.now[lane])
                self.now[lane], self.used[lane], filled = [], 0, True
        return filled

    def finish(self) -> None:
        """Joins the lanes' open windows, and divides what is left into sequences whose lengths are powers of
        two, which need no padding."""
        for lane in range(1, len(self.now)):
            left, self.now[lane] = self.now[lane], []
            for rank, start, n in left:
                self.add(0, rank, start + n, start)
        left, total = self.now[0], self.used[0]
        for bit in reversed(range(total.bit_length())):
            need, own = total & (1 << bit), []
            while need:
                rank, start, n = left[0]
                take = min(need, n)
                own.append((rank, start, take))
                left[0] = (rank, start + take, n - take)
                if take == n:
                    left.pop(0)
                need -= take
            if own:
                self._close(own)


def plan(terms: list[np.ndarray], counts: list[np.ndarray], size: np.ndarray, idf: np.ndarray, mean: float, hot: np.ndarray, window: int) -> list[tuple]:
    """(document, start, length, sequence, offset) of the pieces of a shard's documents, made in rounds: the index is
    probed for the seeds of all lanes, and lanes take what is still unused in turn."""
    index, count, total = Index(terms, counts, size, idf, mean, hot), len(terms), int(size.sum())
    lanes = int(min(MOST_LANES, max(1, total // window // ROUNDS), count))
    k = int(min(256, max(16, 2 * window / mean)))
    packer, free, n = Packer(lanes, window), np.ones(count, bool), size.tolist()
    seed, next_ = [None] * lanes, 0
    while True:
        for i in range(lanes):
            while seed[i] is None and next_ < count:  # the first unused document begins a window
                if free[next_]:
                    free[next_] = False
                    packer.add(i, next_, n[next_])
                    seed[i] = next_ if packer.used[i] else None
                next_ += 1
        live = [i for i in range(lanes) if seed[i] is not None]
        if not live or not free.any():
            break
        for i, near in zip(live, index.nearest([terms[seed[i]] for i in live], free, k), strict=True):
            for d in near.tolist():
                if free[d]:
                    free[d] = False
                    if packer.add(i, d, n[d]):
                        seed[i] = d if packer.used[i] else None
                        break
    packer.finish()
    return packer.out


def _packed(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, hot: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Shards, whose rows follow one another, to one row for each piece, with the checksum of its ids."""
    unzip = zstandard.ZstdDecompressor()
    for rows in runs(batches, "shard"):
        rows = rows.combine_chunks()
        ids = [np.frombuffer(unzip.decompress(v.as_buffer()), np.uint16) for v in rows.column("ids")]
        terms, counts = zip(*(np.unique(x, return_counts=True) for x in ids), strict=True)
        size = np.array([len(x) for x in ids])
        out = plan(list(terms), list(counts), size, idf, mean, hot, window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
        crc = [zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()) for d, a, n, _, _ in out]
        base = rows.column("shard")[0].as_py() << 24  # more sequences than a shard can have
        cols = [pa.array(x, pa.int64()) for x in (start, length, crc, size[doc], sequence + base, offset)]
        yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(pa.array(doc)), *cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def shards(tok: DataFrame, most: int) -> DataFrame:
    """(route, first, parts): runs of routes of about `most` documents each are a shard; a route that has
    more alone is dealt into several. At most 2**ROUTE_BITS rows reach the driver."""
    rows, out, shard, load = tok.groupBy("route").agg(F.sum("weight").alias("w")).collect(), [], 0, 0
    for r in sorted(rows, key=lambda r: r["route"]):
        parts = -(-r["w"] // most)
        if load and (parts > 1 or load + r["w"] > most):
            shard, load = shard + 1, 0
        out.append((r["route"], shard, parts))
        shard, load = (shard + parts, 0) if parts > 1 else (shard, load + r["w"])
    return tok.sparkSession.createDataFrame(out, "route long, first long, parts long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is tokenized whole (no special tokens; a null text is empty) and closed with id END. The
    index is dealt into shards of about `shard` documents with like terms (by route), in which documents are
    ordered by route, id, length and ids. In each of a shard's lanes a seed's window is filled with its nearest unused
    documents of the shard, by BM25 with statistics of the whole corpus, ties in order; the document cut at the
    window's end is the lane's next seed, or the first unused one if none was cut. Lanes take in turn, and the
    result depends neither on partitions nor on the order of rows. Up to `shard` documents retrieval is over the whole table; beyond,
    neighbours in other shards aren't found (README has measured recall), so that work is in proportion to the
    input. There is no padding: full windows, and at a shard's end sequences of powers of two. sequence_id has gaps.
    Null ids are packed too; repeated rows are packed each; an empty table gives no piece; other columns aren't read.
    The driver holds one number for each id of the vocabulary and each route.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    both = cut(arrow_map(src, lambda it: _tokenized(it, path), f"id {kind}, n long, route long, ids binary, df binary"), "pack-tokens")
    tok = both.where("n is not null").withColumn("weight", (F.lit(1) + F.floor(F.col("n") / DOC_TOKENS)).cast("long")).drop("df")
    count, total = tok.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(65536)
    for t, n in arrow_map(both.select("df").where("df is not null"), _frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[t] = n
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    hot = np.full(65536, -1)
    hot[np.argsort(-df, kind="stable")[:HOT_TERMS]] = np.arange(HOT_TERMS)
    part = F.pmod(F.xxhash64("id", "ids"), F.col("parts"))
    dealt = tok.join(F.broadcast(shards(tok, shard)), "route").select("id", "n", "ids", "route", (F.col("first") + part).alias("shard"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "route", "id", "n", "ids").select("shard", "id", "ids")
    mean = total / count if count else 1.0
    out = arrow_map(dealt, lambda it: _packed(it, idf, mean, hot, window), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents with the 49k word tokenizer."""
    return pack(table(spark, sf_dir, "documents"), default_path())
