import pytest
from pyspark.sql import types as T

from dwell.llm import scratch

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """rows (id, text[, source]) -> documents."""
    scratch.folder(spark)

    def make(rows, **extra):
        df = spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows], SCHEMA)
        from pyspark.sql import functions as F
        return df.withColumns({k: F.lit(v) for k, v in extra.items()})
    return make


def words(n, seed=0, vocabulary=5000):
    import random
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, repeats inside a text, nulls, empty and odd texts, tied ids."""
    import random
    r = random.Random(7)
    base = [" ".join(words(n, n)) for n in (3, 60, 120, 400)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10, base[2], "s0"), (11, base[2], None)]
    for i in range(20, 40):
        w = base[3].split()
        for _ in range(r.choice((1, 4, 12, 30))):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "s1"))
    passage = " ".join(words(55, 99))
    rows += [(i, " ".join(words(70, 1000 + i)) + " " + passage + " " + " ".join(words(70, 2000 + i)), "s2") for i in range(50, 56)]
    rows += [(60, None, "s0"), (61, "", "s0"), (62, " \n\t ", None), (63, "ab " * 300, "s1"), (64, "é漢😀 " * 100, "s1"), (65, "x" * 5000, "s1"),
             (None, base[1], "s0"), (None, None, None), (66, "one", "s0"), (67, "one", "s0"), (70, base[3], "s0"), (70, base[3], "s0")]
    return rows
