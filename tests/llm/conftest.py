import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       # names that the operators use inside
                       *[T.StructField(c, T.StringType()) for c in ("id", "doc", "key", "home", "groups", "size", "bucket", "source")]])


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows as a table with extra columns of clashing names, in several partitions."""
    def make(rows, partitions=3):
        return spark.createDataFrame([(d, t, *["x"] * 7, f"s{(d or 0) % 3}" if d is None or d % 7 else None) for d, t in rows],
                                     SCHEMA).repartition(partitions)
    return make


def corpus(seed: int, n: int = 60, vocabulary: int = 400):
    """Random texts with exact copies, near copies, shared passages and odd shapes."""
    rng = random.Random(seed)
    word = lambda: "w" + str(int(rng.paretovariate(0.6)) % vocabulary) + rng.choice(["", "", ",", ".", "é"])
    passage = [word() for _ in range(40)]
    rows = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.6:
                w = text.split(" ")
                for _ in range(rng.randrange(1, 4)):
                    w[rng.randrange(len(w))] = word()
                text = " ".join(w)
            elif rng.random() < 0.5:
                text = text.upper()
        else:
            w = [word() for _ in range(rng.choice([0, 1, 3, 5, 14, 40, 120]))]
            if rng.random() < 0.4:
                at, k = rng.randrange(len(w) + 1), rng.randrange(len(passage))
                w[at:at] = passage[k:]
            if rng.random() < 0.2:
                w += w[:30]
            text = " ".join(w)
            text = "\n".join(text[i:i + 90] for i in range(0, len(text), 90)) if rng.random() < 0.3 else text
        rows.append((d, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "aaaa " * 300), (n + 4, "a" * 1500), (n + 5, "ab" * 700)]
    return rows


EDGES = [(None, "one two three four five six seven eight"), (None, None), (5, "one two three four five six seven eight"),
         (5, "one two three four five six seven eight"), (7, None), (8, ""), (9, " \n\t "), (5, "another text under the same id")]
