"""Toxicity of sentences by a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two tokens sums, over all common subsequences of three symbols, DECAY to the power of the
places they span in both, and is normalised: characters left out, put in or between cost little. A Gaussian
of it, exp(SHARP * (k - 1)), less its value at k = NEAR and cut off there, to each landmark gives a token's features; a
sentence has the largest of its tokens' in each. Whitened by the landmarks' own kernel (Nyström) they are the
features in which the machine, trained on sentences, is linear. One pass over a token's subsequences bounds its kernel to each group of like
landmarks from above; tokens with a bound below NEAR have no feature but zeros, so that only others are compared.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, few_of_each, table
from .op6_langid import held_out
from .words import mix, pieces, powers

DECAY = 0.6
#: Labelled documents of each class that the machine is trained on, at most.
SAMPLE_PER_CLASS = 3000
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 160, 32
SHARP, NEAR, GROUPS = 8.0, 0.5, 24
#: Decision values that a task remembers, at most.
REMEMBERED = 300_000
#: Likelihood-ratio statistic of a witness token (toxic against clean documents), at least, and documents that hold it.
LEAST_G2, LEAST_DOCS = 20.0, 3
#: Rounds in which each toxic document's positive sentence is chosen anew.
ROUNDS = 3
#: Tokens of clean sentences that the machine is trained on, at most, those nearest to the landmarks first.
NEGATIVES = 8_000
#: A longer token is scored in windows of LONGEST characters, one at each half.
LONGEST = 20
_BREAK, _OTHER = 0, 27
_FLOOR = np.float32(np.exp(SHARP * (NEAR - 1)))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _codes() -> np.ndarray:
    """Code points below 0x180 to 32 symbols: letters by their base, digits and signs that stand for letters
    as those letters, white space 0, all else 27."""
    import unicodedata

    t = np.full(0x181, _OTHER, np.uint8)
    for cp in range(0x180):
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        if "a" <= base <= "z":
            t[cp] = ord(base) - 96
        elif chr(cp).isalpha():
            t[cp] = 28 + cp % 4
        elif chr(cp).isspace():
            t[cp] = _BREAK
    for a, b in zip("0134578@$", "oieastbas", strict=True):
        t[ord(a)] = ord(b) - 96
    return t


_CODE = _codes()


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = (np.array(x, np.int64) for x in zip(*combinations(range(n), 3), strict=True))
    w = DECAY ** (k - i + 1).astype(np.float64)
    return i, j, k, (w / np.sqrt((w * w).sum())).astype(np.float32)


_TRIPLES = {n: _triples(n + 2) for n in range(3, LONGEST + 1)}  # with a symbol for each end


class Tokens:
    """Tokens of a run of texts: what stands between white space, without signs; runs of single symbols joined;
    windows of long ones. first[d]:first[d + 1] are those of text d."""

    def __init__(self, texts: list[str | None]):
        flat = [t or "" for t in texts]
        cp = np.frombuffer(" ".join([*flat, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + 1 for t in flat], np.int64)
        end_of = np.cumsum(size)
        c = _CODE[np.minimum(cp, 0x180)]
        c[np.minimum(cp, 0x180) == 0x180] = 28 + (cp[cp >= 0x180] % 4).astype(np.uint8)
        keep = c != _OTHER
        c, end_of = c[keep], np.cumsum(keep)[end_of - 1] if len(keep) else end_of
        inside = c != _BREAK
        s = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        e = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        doc = np.searchsorted(end_of, s, "right")
        extra = []  # (document, symbols) of single symbols in a row
        one = e - s == 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2):
            for lo in range(a, b):
                if lo == a or doc[lo] != doc[lo - 1]:
                    hi = lo
                    while hi < b and doc[hi] == doc[lo]:
                        hi += 1
                    if hi - lo >= 3:
                        extra.append((doc[lo], c[s[lo:hi]]))
        if extra:
            base = len(c)
            c = np.concatenate([c, *[x for _, x in extra]])
            length = np.array([len(x) for _, x in extra])
            ends = base + np.cumsum(length)
            s, e, doc = np.concatenate([s, ends - length]), np.concatenate([e, ends]), np.concatenate([doc, [d for d, _ in extra]])
        long = np.flatnonzero(e - s > LONGEST)
        if len(long):
            half = LONGEST // 2
            times = -(-(e[long] - s[long] - half) // half)
            which = np.repeat(long, times)
            step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            ws = s[which] + step * half
            we = np.minimum(ws + LONGEST, e[which])
            keep = e - s <= LONGEST
            s, e, doc = np.concatenate([s[keep], ws]), np.concatenate([e[keep], we]), np.concatenate([doc[keep], doc[which]])
        keep = e - s >= 3
        s, e, doc = s[keep], e[keep], doc[keep]
        order = np.argsort(doc, kind="stable")
        self.codes, self.start, self.end, self.doc = c, s[order], e[order], doc[order]
        self.first = np.searchsorted(self.doc, np.arange(len(flat) + 1))
        up, down = powers(len(c) + 1)
        run = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(mix(c.astype(np.uint64) + np.uint64(991)) * up[: len(c)], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start])

    def text(self, i: int) -> bytes:
        return self.codes[self.start[i] : self.end[i]].tobytes()


def _indices(codes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The triples of tokens of n symbols, as numbers below 32768, one row for each token."""
    c = np.zeros((len(start), n + 2), np.int32)
    c[:, 1:-1] = codes[start[:, None] + np.arange(n)]
    i, j, k, _ = _TRIPLES[n]
    return (c[:, i] << 10) + (c[:, j] << 5) + c[:, k]


def folded(codes: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each token the largest column of the sum over its triples of their decay times weight[triple]."""
    out = np.zeros(len(start), np.float32)
    size = end - start
    for n in np.unique(size).tolist():
        w = _TRIPLES[n][3]
        rows = np.flatnonzero(size == n)
        step = max(1, (1 << 19) // (len(w) * weight.shape[1]))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            out[r] = (w @ weight[_indices(codes, start[r], n)]).max(axis=1)
    return out


def features(tokens: list[bytes]) -> np.ndarray:
    """The kernel's explicit feature map, of unit length: one row of 32768 for each token."""
    out = np.zeros((len(tokens), 32768), np.float32)
    for r, t in enumerate(tokens):
        idx = _indices(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), len(t))[0]
        out[r] = np.bincount(idx, weights=_TRIPLES[len(t)][3], minlength=32768)
        out[r] /= np.linalg.norm(out[r])
    return out


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    return features(a) @ features(b).T


class Machine:
    """coef and bias over the Gaussian features of the landmarks, the first `toxic` of which are toxic; slope
    and offset turn a decision value into a score."""

    def __init__(self, marks: list[bytes], toxic: int, coef: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.marks, self.toxic, self.coef, self.bias, self.slope, self.offset = marks, toxic, coef, bias, slope, offset

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if "_z" not in self.__dict__:
            self._z = features(self.marks).T.copy()
            groups: list[list[int]] = []
            k = self._z.T @ self._z
            for i in range(len(self.marks)):  # like landmarks share one bound, the more the more there are
                best = max(groups, key=lambda g: k[i, g].max(), default=None)
                if best is None or k[i, best].max() < 0.25 and len(groups) < GROUPS:
                    groups.append([i])
                else:
                    best.append(i)
            self._bound = np.stack([self._z[:, g].max(axis=1) for g in groups], axis=1) if groups else np.zeros((32768, 1), np.float32)
            self._seen = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            self._rows = np.zeros((0, len(self.marks)), np.float32)
        return self._z, self._bound

    def near(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """An upper bound of each token's kernel to any landmark."""
        return folded(codes, start, end, self._tables()[1])

    def gaussians(self, tokens: list[bytes]) -> np.ndarray:
        z = self._tables()[0]
        size = np.array([len(t) for t in tokens], np.int64)
        end = np.cumsum(size)
        codes = np.frombuffer(b"".join(tokens), np.uint8)
        out = np.zeros((len(tokens), z.shape[1]), np.float32)
        for n in np.unique(size).tolist():
            w, rows = _TRIPLES[n][3], np.flatnonzero(size == n)
            step = max(1, (1 << 20) // (len(w) * z.shape[1]))
            for a in range(0, len(rows), step):
                r = rows[a : a + step]
                idx = _indices(codes, (end - size)[r], n)
                flat = (idx + (np.arange(len(r), dtype=np.int64) << 15)[:, None]).ravel()
                order = np.argsort(flat, kind="stable")
                begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
                once = np.add.reduceat(np.tile(w, len(r))[order], begin)  # triples that recur count together
                norm = np.sqrt(np.bincount(flat[order][begin] >> 15, weights=once * once))
                out[r] = (w @ z[idx]) / norm[:, None]
        return np.maximum(0, np.exp(SHARP * (out - 1)) - _FLOOR)

    def pooled(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(sentences, features) of those of a run of sentences that have a feature besides zeros."""
        self._tables()
        h, at, back = np.unique(tokens.hash, return_index=True, return_inverse=True)
        known, slot = self._seen
        place, here = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1)), np.full(len(h), -1, np.int64)
        old = known[place] == h if len(known) else np.zeros(len(h), bool)
        here[old] = slot[place[old]]
        new = np.flatnonzero(~old)
        close = new[self.near(tokens.codes, tokens.start[at[new]], tokens.end[at[new]]) >= NEAR]
        got = self.gaussians([tokens.text(i) for i in at[close]]) if len(close) else self._rows[:0]
        some = got.any(axis=1)
        here[close[some]] = len(self._rows) + np.arange(int(some.sum()))
        rows = np.concatenate([self._rows, got[some]])
        if len(known) < REMEMBERED:
            known, slot = np.concatenate([known, h[new]]), np.concatenate([slot, here[new]])
            order = np.argsort(known)
            self._seen, self._rows = (known[order], slot[order]), rows
        use = np.flatnonzero(here[back] >= 0)
        sentence, first = np.unique(tokens.doc[use], return_index=True)
        out = np.maximum.reduceat(rows[here[back[use]]], first) if len(use) else np.zeros((0, len(self.marks)), np.float32)
        return sentence, out

    def decision(self, texts: list[str | None]) -> np.ndarray:
        """For each text the largest decision value of its sentences; a sentence without a feature has the bias."""
        split = [_SENTENCE.split(t or "") for t in texts]
        value = np.full(sum(map(len, split)), self.bias)
        if self.marks and len(value):
            sentence, x = self.pooled(Tokens([v for part in split for v in part]))
            value[sentence] += x @ self.coef
        return np.maximum.reduceat(value, np.cumsum([0, *map(len, split[:-1])])) if split else value

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -500, 500)))


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared hinge loss with weights c, by accelerated gradient steps. Returns (w, b)."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = v = np.zeros(x1.shape[1])
    lip = 1e-3 + 2 * np.linalg.norm((x1 * c[:, None]).T @ x1, 2)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = 1e-3 * v - 2 * x1.T @ (c * y * slack)
        new = v - grad / lip
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _platt(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        g = np.array([(d * (p - y)).sum() + 1e-2 * a, (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(d * d * s).sum() + 1e-2, (d * s).sum()], [(d * s).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _altered(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one symbol put in or left out."""
    i = int(rng.integers(1, len(word)))
    if len(word) > 5 and rng.random() < 0.4:
        return word[:i] + word[i + 1 :]
    return (word[:i] + bytes([int(rng.integers(1, 27))]) + word[i:])[:LONGEST]


def _parts(texts: list[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    """texts in runs of about `chars` characters: Tokens holds some 80 bytes for each."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _telling(toxic: Counter, clean: Counter, n_tox: int, n_clean: int) -> set[bytes]:
    """Tokens that are far more frequent in toxic documents than in clean ones, by a bar that doesn't depend on
    the number of documents."""
    out = set()
    for w, n in toxic.items():
        c = clean[w]
        if n >= LEAST_DOCS and c * n_tox <= 0.02 * n * n_clean:
            share = n_tox / max(1, n_tox + n_clean)
            g2 = 2 * (n * np.log(n / ((n + c) * share)) + (c * np.log(c / ((n + c) * (1 - share))) if c else 0)) if n_clean else 0
            if g2 >= LEAST_G2:
                out.add(w)
    return out


def train(texts: list[str], toxic: list[bool], seed: int = 4) -> Machine:
    """Fits the machine on labelled sentences, where labels are those of the documents.

    All sentences of clean documents are negative; those without a feature are one case with a weight. At least one
    sentence of a toxic document is positive: at first those with a token which toxic documents
    have far more often than clean ones (then those of the documents that are left, so that a rare insult is found too), in further rounds the sentence with the
    largest decision value. Landmarks are those tokens, and tokens of clean sentences nearest to them; altered spellings of
    the former are positive sentences too. A document's value is the largest of its sentences' values; Platt's method turns it
    into a score. Without a landmark every text gets the share of toxic documents.
    """
    y = np.array(toxic, bool)
    n_tox, n_clean = int(y.sum()), int((~y).sum())
    prior = float(np.log((n_tox + 0.5) / (n_clean + 0.5)))
    rng = np.random.default_rng(seed)
    own, clean = [], Counter()
    for t, bad in zip(texts, y, strict=True):
        k = Tokens([t])
        words = {k.text(i) for i in np.unique(k.hash, return_index=True)[1]}
        own.append(words) if bad else clean.update(words)
    strong: set[bytes] = set()
    for _ in range(2):  # the second time for documents that hold none of the first
        left = [w for w in own if not w & strong]
        strong |= _telling(Counter(x for w in left for x in w), clean, len(left), n_clean)
    held = Counter(x for w in own for x in w & strong)
    order = [w for w, _ in sorted(held.items(), key=lambda x: (-x[1], x[0]))]
    pool = sorted(set(clean) - strong)
    if not order or not pool:
        return Machine([], 0, np.zeros(0), 0.0, 1.0, prior)
    marks = order[:LANDMARKS_TOXIC]
    first = Machine(marks, len(marks), np.zeros(len(marks)), 0.0)
    size = np.array([len(t) for t in pool], np.int64)
    end = np.cumsum(size)
    near = first.near(np.frombuffer(b"".join(pool), np.uint8), end - size, end)
    hard = np.argsort(-near, kind="stable")[:NEGATIVES]
    exact = first.gaussians([pool[i] for i in hard]).max(axis=1)
    marks = marks + [pool[i] for i in hard[np.argsort(-exact, kind="stable")[:LANDMARKS_CLEAN]]]
    machine = Machine(marks, len(first.marks), np.zeros(len(marks)), 0.0)
    val, vec = np.linalg.eigh(machine.gaussians(marks).astype(np.float64))
    keep = val > 1e-6 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])
    doc, x, plain, done = [], [], 0, 0  # plain: clean sentences without a feature
    for part in _parts(texts):
        split = [_SENTENCE.split(t) for t in part]
        of = np.repeat(np.arange(done, done + len(part)), [len(v) for v in split])
        sentence, rows = machine.pooled(Tokens([v for own_ in split for v in own_]))
        plain += int((~y[of]).sum() - (~y[of[sentence]]).sum())
        doc.append(of[sentence])
        x.append(rows)
        done += len(part)
    doc, x = np.concatenate(doc), np.concatenate(x)
    bad, z = y[doc], x @ root
    exactly = x[:, : machine.toxic].max(axis=1, initial=0) >= 0.97 * (1 - _FLOOR)
    altered = sorted({_altered(w, rng) for w in order for _ in range(3)} - set(pool) - set(order))
    z_altered = machine.gaussians(altered) @ root
    positive = bad & exactly
    for _ in range(ROUNDS):
        p, n = np.flatnonzero(positive), np.flatnonzero(~bad)
        rows = np.concatenate([z[p], z_altered, z[n], np.zeros((1, z.shape[1]))])
        lab = np.concatenate([np.ones(len(p) + len(altered)), -np.ones(len(n) + 1)])
        c = np.concatenate([np.full(len(p), 500 / max(1, len(p))), np.full(len(altered), 100 / max(1, len(altered))), np.full(len(n), 500 / max(1, len(n))), [500 if plain else 1]])
        w, machine.bias = _svm(rows, lab, c)
        value = z @ w + machine.bias
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc[bad], value[bad])
        positive = bad & (value == best[doc]) & (value > -0.5)  # documents without any such sentence have a doubtful label
    machine.coef = root @ w
    values = np.concatenate([machine.decision(part) for part in _parts(texts)])
    machine.slope, machine.offset = _platt(values, y.astype(float))
    return machine


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in pieces(batches):
        d = machine.decision(rows.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(machine.score(d))], names=["id", "score"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled machine of all rows (text, toxic): one task of a sample of bounded size, tried again when lost."""
    rows = sorted((t, y) for rb in batches for t, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()))
    machine = train([t for t, _ in rows], [y for _, y in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["machine"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """The machine trained on the per_class labelled documents (id, text) of each class (id, toxic) whose
    hashed id is smallest, in one executor task: the driver gets the machine only. Of several labels of a document the largest counts."""
    one = labels.where("toxic is not null and id is not null").groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = few_of_each(one.join(docs.select("id").distinct(), "id", "left_semi"), "toxic", "id", per_class)
    rows = docs.join(F.broadcast(chosen), "id").where("text is not null").select("text", "toxic").distinct()
    made = arrow_map(rows.coalesce(1), _trained, "machine binary").collect()
    return pickle.loads(made[0][0]) if made else train([], [])


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score in 0 to 1 for each row of docs; whole texts are read. Null, empty and letterless
    texts get the lowest score. Null ids are kept; repeated rows each give a row; an empty table gives none."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, lambda it: _scored(it, machine), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity() of all documents, by a machine fitted on those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    seen = docs.where(~held_out("doc_id", 4, 2)).select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    out = score_toxicity(docs, fit(seen, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
