"""Small documents with every awkward case: nulls, empty and long texts, ties,
repeated rows, and columns whose names clash with the operators' own."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("uid", "id", "fp", "digest", "score", "_uid", "size", "parts", "seq")],
    ]
)

WORDS = "the of and thing stone river light over under early grass bright walk seven house winter voice paper cloud garden".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(seed=0, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = sentence(rng, rng.randint(1, 60))
        kind = i % 10
        if kind == 1:
            text = None
        elif kind == 2:
            text = ""
        elif kind == 3:
            text = " \t\n"
        elif kind == 4 and out:
            text = (out[-4][1] or "") + " "  # a copy, white space apart
        elif kind == 5 and out:
            text = (out[0][1] or "").replace(" ", "  ")
        elif kind == 6:
            text = sentence(rng, 4000) + " é ß 漢字 😀"
        out.append((None if i == 7 else i, text, "en", None if i % 9 == 0 else f"src{i % 4}", None if text is None else len(text), *["x"] * 9))
    return out + out[10:14]  # repeated rows


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def components(n, linked):
    """Union-find over pairs of places."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]
