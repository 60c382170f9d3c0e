"""Small inputs with every awkward row, and brute-force parts shared by the tests."""

from __future__ import annotations

import random
import re
import zlib

import pandas as pd

WORDS = "lorem ipsum dolor sit amet tempor labore magna aliqua veniam quis nostrud ullamco nisi ex ea commodo irure esse velit cillum fugiat nulla sint culpa mollit anim est".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def documents() -> pd.DataFrame:
    """Copies, near copies, repeated and near-equal lines, nulls in each column, blank and long texts."""
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    line = "this line of text stands in many documents of the set"
    texts = [
        base, base, " ".join(near), prose(2, 80), prose(3, 80) + "\n" + line + "\n" + prose(4, 20), prose(5, 30) + "\n" + line.replace("many", "mang"),
        line + "\n" + prose(6, 10), "", None, "   ", "one", "one two", "ÄÖ Straße 日本語 𝒳", prose(7, 9000), base.upper(), "\n\n", "a\nb\na", prose(8, 80), None, "12 34",
    ]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append((21, prose(2, 80), None, None, 5))
    rows.append((3, texts[3], "en", "src1", len(texts[3])))  # a repeated row
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    for clash in ("id", "a", "b", "n", "key", "rep", "component", "shard", "pos", "label"):
        frame[clash] = "extra"
    return frame


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, data: pd.DataFrame, head: str = SCHEMA):
    names = [p.split()[0] for p in head.split(", ")]
    rest = [c for c in data.columns if c not in names]
    schema = ", ".join([head, *[f"{c} string" for c in rest]])
    rows = [tuple(None if x is None or x != x else (x.item() if hasattr(x, "item") else x) for x in r) for r in data[names + rest].itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema)


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def words(text: str | None) -> list[str]:
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text: str | None, n: int) -> set:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def save(df, path) -> str:
    df.write.mode("overwrite").parquet(str(path))
    return str(path)
