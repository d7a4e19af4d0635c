"""The manifest against plain trees, with blocks of one, two and three levels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dwell.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and the (before, after) of each leaf's path."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p - p % 16
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 16])))
        level = [h("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], paths


def plain(rows) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, tops = [], []
    for s in order:
        rs = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        top, paths = tree([leaf(*r) for r in rs])
        tops.append((top, list(zip(rs, paths))))
    root, upper = tree([t for t, _ in tops])
    for (top, members), up in zip(tops, upper):
        out += [(r[0], leaf(*r), top, root, tuple(p + up)) for r, p in members]
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((bytes(x["before"]).decode(), bytes(x["after"]).decode()) for x in r["path"]))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equals_plain_trees(spark, docs, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    monkeypatch.setattr(merkle, "PIECE_ROWS", 40)
    r = random.Random(1)
    rows = [(i, f"Text {r.random()}", "en", "hot", i) for i in range(300)] + [(i, "é" * i, None, "wide", None) for i in range(17)]
    rows += [(900, "alone", "de", "é", 1), (901, None, "de", None, 1), (None, "", None, None, None), (None, "", None, None, None), (902, "x", "fr", "", 2),
             (5, "same", "en", "ties", 1), (5, "other", "en", "ties", 1), (5, "same", "en", "ties", 1)]
    rows += [(i, "t", "en", f"s{i}", 1) for i in range(1000, 1020)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit(1), "leaf": F.lit("x"), "pos": F.lit(3)})
    assert found(merkle.manifest(df)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_around_full_runs(spark, docs, n):
    rows = [(i, str(i), "en", "s", 1) for i in range(n)]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_altered_rows_do_not_fold_to_the_root(spark, docs):
    rows = [(i, "Word" if i % 3 else "word", "en", f"s{i % 2}", 4) for i in range(50)] + [(99, None, "en", "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(df, F.when(F.col("doc_id") % 5 == 0, F.lower("text")))
    checked = got.select("doc_id", (merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path")) == F.col("root")).alias("same")).collect()
    assert {r["doc_id"]: r["same"] for r in checked} == {i: not (i < 50 and i % 5 == 0 and i % 3) for i in (*range(50), 99)}


def test_empty_table(spark, docs):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_empty_and_long_texts(spark, docs):
    rows = [(1, "", "en", "s", 0), (2, "Ab é " * 200_000, "en", "s", 1)]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
