"""Segment-partition edit join over lines: each line is split into threshold + 1 segments, shorter lines'
segments are probed by longer lines' substrings at the few places where they can stand, and candidates are
verified with a banded bit-parallel edit distance. Long lines are sequences of words, short ones of characters."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, runs, table
from .words import SPACES, hashes, mix, pieces, powers, spans

#: Edits between near-equal lines, at most: of characters in lines of fewer than LEAST_WORDS words, else of words.
EDITS = 2
#: One more edit for each WORDS_PER_EDIT words beyond as many, up to MOST_EDITS.
WORDS_PER_EDIT, MOST_EDITS = 75, 6
LEAST_WORDS = 12
#: Code points of a short line, at least, for near-equality; shorter lines are only compared for equality.
LEAST_CHARS = 20
#: Bytes of rows with line numbers that are broadcast instead of joined with all texts by a shuffle, at most.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that are signed at a time, line keys that a task remembers, and cells of one run of edit distances.
PIECE, REMEMBERED, CELLS = 1 << 19, 500_000, 2_000_000
#: Bits of a line's sketch.
PARITIES = 56
#: Lines of a bucket that one task compares at a time; fuller buckets are dealt into cells.
CELL_ROWS = 4096
_SALT = np.uint64(0xD6E8FEB86659FD93)


def allowed(words: np.ndarray) -> np.ndarray:
    """Edits of words between lines the shorter of which has so many words."""
    return np.clip(EDITS + (words - WORDS_PER_EDIT) // WORDS_PER_EDIT, EDITS, MOST_EDITS)


class Sequences:
    """Symbols of lines, one after another, with a running hash sum."""

    def __init__(self, value: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.start, self.size, n = start, size, len(value)
        up, self.down = powers(n + 1)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=self.run[1:])
        bits = np.uint64(1) << ((mix(value[:-1] * _SALT + value[1:]) >> np.uint64(32)) * np.uint64(PARITIES) >> np.uint64(32)) if n > 1 else np.zeros(0, np.uint64)
        even = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)]) if n > 1 else np.zeros(1, np.uint64)
        last = len(even) - 1
        #: Parities of the counts of hashed pairs of symbols; one edit flips four of them at most.
        self.parity = np.where(size > 1, even[np.clip(start + size - 1, 0, last)] ^ even[np.clip(start, 0, last)], np.uint64(0))

    def hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.run[e] - self.run[s]) * self.down[s]


class Lines:
    """The lines (by \\n, white space at their ends dropped) of a run of texts: their texts, and of each its
    document, number, key (k1, k2), code points and words."""

    def __init__(self, texts: list[str | None]):
        rows = [[x.strip() for x in t.split("\n")] if t is not None else [] for t in texts]
        self.doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.pos = np.concatenate([np.arange(len(r)) for r in rows] + [np.zeros(0, np.int64)]).astype(np.int64)
        self.flat = [x for r in rows for x in r]
        self.chars = np.array([len(x) for x in self.flat], np.int64)
        coded = [x.encode("utf-8", "surrogatepass") for x in self.flat]
        key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded)), np.uint64).reshape(-1, 2)
        self.k1, self.k2 = key[:, 0].copy(), key[:, 1].copy()
        self.coded = coded

    def by_words(self) -> Sequences:
        data = np.frombuffer(b"\n".join(self.coded), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.coded])]).astype(np.int64)
        off[-1] = len(data)
        begin, end, first = spans(data, off, SPACES)
        return Sequences(hashes(data, begin, end), first[:-1], np.diff(first))

    def by_chars(self, use: np.ndarray) -> Sequences:
        codes = np.frombuffer("".join(self.flat[i] for i in use).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = self.chars[use]
        return Sequences(mix(codes.astype(np.uint64) + np.uint64(0x5851F42D)), np.cumsum(size) - size, size)


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the edits + 1 segments of lines of `length`, a column each: the last
    length % (edits + 1) segments are one longer."""
    base, extra, i = (length // (edits + 1))[:, None], (length % (edits + 1))[:, None], np.arange(edits + 1)[None]
    short = edits + 1 - extra
    start = i * base + np.maximum(0, i - short)
    return start, start + base + (i >= short)


def signatures(lines: Sequences, edits, least: int, kind: int) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
    """(is index entry, threshold, keys, line numbers): the segments of each line of `least` symbols, and its
    substrings that may equal a segment of another line as long or shorter by as many symbols as the other's
    threshold (multi-match-aware selection of places). edits: thresholds by sizes; kind: told apart in keys."""
    longest = int(lines.size.max()) if len(lines.size) else 0

    def key(length: np.ndarray, i: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix(lines.hash(s, e) + _SALT * (length * 64 + 2 * i + kind).astype(np.uint64))

    for t in np.unique(edits(np.arange(least, longest + 1))).tolist():
        i = np.arange(t + 1)
        for gap in range(t + 1):
            other = lines.size - gap
            use = np.flatnonzero((other >= least) & (edits(other) == t))
            if not len(use):
                continue
            o, at = other[use], lines.start[use][:, None]
            s, e = segments(o, t)
            if not gap:
                yield True, t, key(o[:, None], i[None], at + s, at + e).ravel(), np.repeat(use, t + 1)
            lo = np.maximum(np.maximum(s - i, s + gap - (t - i)), 0)
            hi = np.minimum(np.minimum(s + i, s + gap + (t - i)), lines.size[use][:, None] - (e - s))
            wide = np.maximum(hi - lo + 1, 0).ravel()
            which = np.repeat(np.arange(len(wide)), wide)
            p = lo.ravel()[which] + np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
            if not gap:  # the entry's own place is not repeated
                other_place = p != s.ravel()[which]
                which, p = which[other_place], p[other_place]
            line, begin = which // (t + 1), at.ravel()[which // (t + 1)] + p
            yield False, t, key(o[line], which % (t + 1), begin, begin + (e - s).ravel()[which]), use[line]


def edit_within(x: list[np.ndarray], y: list[np.ndarray], edits: int) -> np.ndarray:
    """For each pair whether its edit distance is at most `edits`, all pairs at once: a band of 2 * edits + 1
    diagonals in the bits of one word, moved along the shorter line (Hyyrö's banded form of Myers)."""
    n = len(x)
    swap = [len(a) < len(b) for a, b in zip(x, y, strict=True)]
    long = [b if s else a for a, b, s in zip(x, y, swap, strict=True)]
    short = [a if s else b for a, b, s in zip(x, y, swap, strict=True)]
    m, k = np.array([len(a) for a in long], np.int64), np.array([len(a) for a in short], np.int64)
    out = np.zeros(n, bool)
    live = np.flatnonzero(m - k <= edits)
    live = live[np.argsort(k[live], kind="stable")]
    c = 0
    while c < len(live):
        end = min(c + 512, len(live))
        while end - c > 1 and (end - c) * k[live[end - 1]] > CELLS:
            end = c + (end - c) // 2
        part, c = live[c:end], end
        out[part] = _band([long[i] for i in part], [short[i] for i in part], m[part], k[part], edits) <= edits
    return out


def _band(long: list[np.ndarray], short: list[np.ndarray], m: np.ndarray, k: np.ndarray, t: int) -> np.ndarray:
    n, width = len(long), 2 * t + 1
    a = np.full((n, int(max(m.max(), k.max())) + 2 * width), 2**64 - 1, np.uint64)
    b = np.full((n, int(k.max()) + 1), 2**64 - 2, np.uint64)
    for i in range(n):
        a[i, t : t + m[i]] = long[i]
        b[i, : k[i]] = short[i]
    one, full = np.uint64(1), np.uint64((1 << width) - 1)
    vp = np.full(n, (((1 << (t + 1)) - 1) << t), np.uint64)
    vn = np.zeros(n, np.uint64)
    dist = np.full(n, t, np.int64)
    for j in range(int(k.max())):
        eq = np.zeros(n, np.uint64)
        for d in range(width):
            eq |= (a[:, j + d] == b[:, j]).astype(np.uint64) << np.uint64(d)
        d0 = ((((eq & vp) + vp) & full) ^ vp) | eq | vn
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        on, slide = j < k, j < m - t
        dist += on & slide & ((d0 >> np.uint64(2 * t)) & one == 0)
        shift = np.clip(2 * t - 1 - (j - (m - t)), 0, 63).astype(np.uint64)
        flat = on & ~slide
        dist += flat & ((hp >> shift) & one == 1)
        dist -= flat & ((hn >> shift) & one == 1)
        d0 >>= one
        vp = (hn | ~(d0 | hp)) & full
        vn = d0 & hp
    return dist


def near_equal(lines: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair (x, y) of places in lines whether these are near-equal: by words (A-Z as a-z) if both have
    LEAST_WORDS of them, else by characters, if both have LEAST_CHARS."""
    known: dict[bytes, int] = {}
    use = np.unique(np.concatenate([x, y])).tolist()
    words = {i: np.array([known.setdefault(w, len(known)) for w in lines[i].encode("utf-8", "surrogatepass").lower().split()], np.uint64) for i in use}
    least = np.array([min(len(words[i]), len(words[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    out, by_word = np.zeros(len(x), bool), least >= LEAST_WORDS
    for t in np.unique(allowed(least[by_word])).tolist():
        at = np.flatnonzero(by_word & (allowed(least) == t))
        out[at] = edit_within([words[i] for i in x[at].tolist()], [words[i] for i in y[at].tolist()], t)
    at = np.array([k for k in np.flatnonzero(~by_word).tolist() if min(len(lines[x[k]]), len(lines[y[k]])) >= LEAST_CHARS], np.int64)
    codes = {i: np.frombuffer(lines[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for i in np.unique(np.concatenate([x[at], y[at]])).tolist()}
    out[at] = edit_within([codes[i] for i in x[at].tolist()], [codes[i] for i in y[at].tolist()], EDITS)
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in pieces(batches, budget=PIECE):
        x = Lines(rows.column(2).to_pylist())
        at = pa.array(x.doc)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(at), rows.column(1).take(at), pa.array(x.pos), pa.array(x.k1.view(np.int64)), pa.array(x.k2.view(np.int64)), pa.array(x.chars)],
            names=["row", "id", "pos", "k1", "k2", "chars"],
        )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.uint64)  # lines already given by this task; bounded, for later stages drop what is given twice
    for rows, _, _ in pieces(batches, budget=PIECE):
        x = Lines(rows.column(2).to_pylist())
        once, first = np.unique(x.k1, return_index=True)
        place = np.minimum(np.searchsorted(seen, once), max(0, len(seen) - 1))
        new = seen[place] != once if len(seen) else np.ones(len(once), bool)
        if len(seen) < REMEMBERED:
            seen = np.sort(np.concatenate([seen, once[new]]))
        fresh = np.zeros(len(x.k1), bool)
        fresh[first[new]] = True
        words = x.by_words()
        short = np.flatnonzero(fresh & (words.size < LEAST_WORDS + EDITS) & (x.chars >= LEAST_CHARS))
        words.size = np.where(fresh, words.size, -1)
        chars = x.by_chars(short)
        got = [(g, words.parity, g[3], g[3]) for g in signatures(words, allowed, LEAST_WORDS, 0)]
        got += [(g, chars.parity, g[3], short[g[3]]) for g in signatures(chars, lambda n: np.full(np.shape(n), EDITS), LEAST_CHARS, 1)]
        for (entry, t, key, _), parity, own, line in got:
            mark = (parity[own] << np.uint64(8)) | np.uint64(2 * t + entry)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (key, x.k1[line], mark)], names=["key", "line", "mark"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        texts, places, lines = (rb.column(i).to_pylist() for i in (1, 2, 3))
        k, out = [], []
        for t, ps, ks in zip(texts, places, lines, strict=True):
            split = t.split("\n")
            k += ks
            out += [split[p].strip() for p in ps]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(out, pa.string())], names=["line", "words"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, x, y) to the b of near-equal lines x and y."""
    for rb in batches:
        for a in range(0, rb.num_rows, 2048):
            part = rb.slice(a, 2048)
            n, lines = part.num_rows, part.column(1).to_pylist() + part.column(2).to_pylist()
            yield part.select(["b"]).filter(pa.array(near_equal(lines, np.arange(n), np.arange(n, 2 * n))))


def _late(cells: list[pa.Table]) -> np.ndarray:
    """Of cells, each in order of occurrence, the lines that are asked for and near-equal to an earlier member of
    their cell: the likeliest of each is tried first, then twice as many, until one is found or there are no more."""
    row, col, differs, base = [], [], [], 0
    for cell in cells:
        mark, inside = cell.column("mark").to_numpy().view(np.uint64), np.flatnonzero(cell.column("member").to_numpy())
        edits = ((mark >> np.uint64(1)) & np.uint64(127)).astype(np.int64)
        for part in np.array_split(np.flatnonzero(cell.column("asked").to_numpy()), -(-cell.num_rows // 256)):
            differ = np.bitwise_count((mark[part][:, None] ^ mark[inside][None]) >> np.uint64(8)).astype(np.int64)
            fits = (differ <= 4 * np.maximum(edits[part][:, None], edits[inside][None])) & (inside[None] < part[:, None])
            r, c = np.nonzero(fits)
            row.append(part[r] + base)
            col.append(inside[c] + base)
            differs.append(differ[r, c])
        base += cell.num_rows
    lines = [v for cell in cells for v in cell.column("words").to_pylist()]
    row, col = np.concatenate(row), np.concatenate(col)
    order = np.lexsort((np.concatenate(differs), row))
    row, col = row[order], col[order]
    nth, open_ = np.arange(len(row)) - np.searchsorted(row, row), np.ones(base, bool)
    done, take = 0, 1
    while len(at := np.flatnonzero((nth >= done) & (nth < done + take) & open_[row])):
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            open_[row[some[near_equal(lines, row[some], col[some])]]] = False
        done, take = done + take, 2 * take
    return np.flatnonzero(~open_)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for cell in itertools.chain(runs(batches, "cell"), [None]):
        if cell is not None:
            held.append(cell)
        if held and (cell is None or sum(c.num_rows for c in held) >= CELL_ROWS):
            line = pa.concat_tables(held).column("line").combine_chunks()
            yield pa.RecordBatch.from_arrays([line.take(pa.array(_late(held)))], names=["b"])
            held = []


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written, with a number for each row in a column of a name that docs hasn't; the column's name."""
    name = "_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "ln-rows"), name


def _sized(rows: DataFrame, numbers: str) -> DataFrame:
    """rows, marked for a broadcast if they and their arrays `numbers` are small."""
    n, m = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(rows) if 48 * n + 24 * m <= BROADCAST_BYTES else rows


def _texts(src: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, words): the text of each line of the table lines (line, at: row and pos), read there."""
    per = lines.groupBy("line").agg(F.first("at").alias("at")).groupBy("at.row").agg(F.collect_list("at.pos").alias("ps"), F.collect_list("line").alias("ks"))
    per = cut(per, "ln-fetch")
    texts = src.join(_sized(per, "ps"), "row").select("row", "text", "ps", "ks")
    texts = cut(arrow_map(texts, _chosen, "line long, words string"), "ln-texts")
    discard(per)
    return texts


def near_lines(src: DataFrame, lines: DataFrame) -> DataFrame:
    """k1 of the lines that are near-equal to another line which occurs earlier.

    src: row, id, text; lines: k1 and `first` (id, row, pos), where it occurs first. A copy of a line adds nothing:
    classes of equal lines are compared. Of a bucket of lines that share a segment each is first compared with the
    earliest. Those that this doesn't settle are compared, inside Arrow tasks, with all earlier lines of their
    buckets, until one is near-equal. Only lines become rows, never pairs of a group.
    """
    # mark: a sketch of the line, its threshold, and whether the row is a segment of the index
    signed = arrow_map(src, _signed, "key long, line long, mark long")
    w = Window.partitionBy("key")
    open_ = signed.select("*", (F.min("line").over(w) < F.max("line").over(w)).alias("several"), F.max(F.col("mark").bitwiseAND(F.lit(1))).over(w).alias("indexed"))
    open_ = cut(open_.where("several and indexed = 1").select("key", "line", F.shiftleft(F.shiftright("mark", 1), 1).alias("mark")).distinct(), "ln-open")
    open_, old = cut(open_.join(lines.select(F.col("k1").alias("line"), "first"), "line"), "ln-ordered"), open_
    lead = open_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("first", "line", "mark")).alias("lead"))
    at = lambda c: F.struct(F.col(f"{c}.row").alias("row"), F.col(f"{c}.pos").alias("pos"))
    lead = cut(lead.select("key", "m", F.col("lead.line").alias("a"), F.col("lead.mark").alias("ma"), at("lead.first").alias("ata")), "ln-lead")
    led = open_.join(lead, "key").where("line <> a")
    edits = lambda c: F.shiftright(c, 1).bitwiseAND(F.lit(127))
    likely = F.bit_count(F.shiftrightunsigned(F.col("mark").bitwiseXOR(F.col("ma")), 8)) <= 4 * F.greatest(edits("mark"), edits("ma"))
    cand = led.where(likely).groupBy("a", F.col("line").alias("b")).agg(F.first("ata").alias("ata"), F.first(at("first")).alias("atb"))
    cand = cut(cand, "ln-cand")
    texts = _texts(src, cand.select(F.inline(F.array(F.struct(F.col("a").alias("line"), F.col("ata").alias("at")), F.struct(F.col("b").alias("line"), F.col("atb").alias("at"))))))
    both = cand.join(texts.select(F.col("line").alias("a"), F.col("words").alias("x")), "a")
    both = both.join(texts.select(F.col("line").alias("b"), F.col("words").alias("y")), "b").select("b", "x", "y")
    settled = cut(arrow_map(both, _close, "b long").distinct(), "ln-settled")
    # what is left, in buckets with more lines than the earliest and one other
    left = led.where("m > 2").join(settled.withColumnRenamed("b", "line"), "line", "left_anti").select("key", "line", "m")
    left = cut(left, "ln-left")
    many = left.groupBy("key").agg(F.count(F.lit(1)).alias("u"), F.max("m").alias("m"))
    many = cut(many.select("key", F.ceil(F.col("u") / (CELL_ROWS / 4)).cast("int").alias("down"), F.ceil(F.col("m") / CELL_ROWS).cast("int").alias("across")), "ln-many")
    rows = open_.join(many, "key").join(left.select("key", "line", F.lit(True).alias("left")), ["key", "line"], "left")
    down, across = F.pmod(F.xxhash64("line", F.lit(1)), "down").cast("int"), F.pmod(F.xxhash64("line", F.lit(2)), "across").cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda d: F.struct(d.alias("d"), across.alias("c")))
    as_asked = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda c: F.struct(down.alias("d"), c.alias("c")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("left"), F.array_union(as_member, as_asked)).otherwise(as_member)))
    rows = rows.select(
        F.concat_ws("/", "key", "at.d", "at.c").alias("cell"), "first", "line", "mark",
        (F.coalesce("left", F.lit(False)) & (F.col("at.d") == down)).alias("asked"), (F.col("at.c") == across).alias("member"),
    )
    rows = cut(rows, "ln-cells")
    more = _texts(src, rows.select("line", at("first").alias("at")))
    rows = rows.join(more, "line").repartition("cell").sortWithinPartitions("cell", "first").select("cell", "line", "mark", "asked", "member", "words")
    later = cut(arrow_map(rows, _later, "b long"), "ln-later")
    near = cut(settled.unionByName(later).distinct().withColumnRenamed("b", "k1"), "ln-near")
    for t in (old, open_, lead, cand, texts, settled, left, many, more, later):
        discard(t)
    return near


def _repeated(rows: DataFrame) -> DataFrame:
    """(row, n_lines, n_copies, n_near, dropped) of those of rows (row, id, text) that have a line."""
    src = rows.select("row", "id", "text")
    kind = src.schema["id"].dataType.simpleString()
    where = cut(arrow_map(src, _occurrences, f"row long, id {kind}, pos long, k1 long, k2 long, chars long"), "ln-where")
    real, place = where.where("chars > 0"), F.struct("id", "row", "pos")
    lines = cut(real.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")), "ln-lines")
    near = near_lines(src, lines)
    bad = lines.join(near.withColumn("near", F.lit(True)), "k1", "left").where("c > 1 or near")
    bad = cut(bad.select("k1", "k2", F.col("first.row").alias("frow"), F.col("first.pos").alias("fpos"), F.coalesce("near", F.lit(False)).alias("near")), "ln-bad")
    gone = real.join(bad, ["k1", "k2"]).withColumn("copy", (F.col("row") != F.col("frow")) | (F.col("pos") != F.col("fpos"))).where("near or copy")
    per = gone.groupBy("row").agg(F.count_if("copy").alias("n_copies"), F.count_if(~F.col("copy")).alias("n_near"), F.sort_array(F.collect_list("pos")).alias("dropped"))
    base = where.groupBy("row").agg((F.max("pos") + 1).alias("n_lines"))
    out = cut(base.join(per, "row", "left"), "ln-rows-out")
    for t in (where, lines, near, bad):
        discard(t)
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_copies, n_near, dropped) for each row of docs: its lines, how many of them are copies of
    earlier lines or, being no copies, near-equal to an earlier line, and their numbers.

    Earlier means by (id, row, line number), nulls first; rows are in the order in which docs are read. A line
    goes if an equal or near-equal line comes earlier anywhere in docs; empty lines stay. Lines are near-equal
    within EDITS characters, or, from LEAST_WORDS words on, within EDITS and more words (see allowed()). Rows that share
    an id, or have none, are rows of their own, and so are repeated rows. A null text has no line; whole
    texts and lines of any length are compared; an empty table gives none. Other columns aren't read.
    """
    rows, _ = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.withColumnRenamed("_row", "row")
    out = rows.select("row", "id").join(_repeated(rows), "row", "left")
    none = F.array().cast("array<long>")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_copies", "n_near")], F.coalesce("dropped", none).alias("dropped"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the lines of repeated_lines() cut out of their texts; a row left without any goes.
    Names of other columns don't matter."""
    rows, row = numbered(docs)
    drops = _repeated(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))).where("dropped is not null")
    drops = drops.select(F.col("row").alias(row), F.col("dropped").alias(f"{row}_gone"), (F.size("dropped") == F.col("n_lines")).alias(f"{row}_all"))
    j = rows.join(_sized(drops, f"{row}_gone"), row, "left").where(~F.coalesce(f"{row}_all", F.lit(False)))
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(f"{row}_gone", i.cast("long"))), "\n")
    return j.withColumn(text_col, F.when(F.col(f"{row}_gone").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_lines() of all documents, by doc_id."""
    return repeated_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
