"""The prefix trie against a plain trie, with shards and matrices small enough that nodes cross their borders."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dwell.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Rows of the trie from nested dictionaries."""
    members: dict[tuple, list[int]] = {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, ids in members.items():
        under = [k for k in members if k[:len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(len(x) == len(k) + 1 and x[:len(k)] == k for x in under)]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) for k in under)
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(key))
        out.append((ids[0], len(key), members[key[:-1]][0] if key else None, len(ids), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard, columns", [(3, 2), (7, 64), (4096, 3)])
def test_equals_a_plain_trie(spark, docs, monkeypatch, shard, columns):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    monkeypatch.setattr(prefix_trie, "COLUMNS", columns)
    r = random.Random(shard)
    convs = {c: [("user" if i % 2 else "system", r.choice(("a", "b", "é"))) for i in range(r.choice((1, 2, 4, 5)))] for c in range(40)}
    convs |= {c: convs[1] for c in range(40, 60)}                                    # a group of copies over several shards
    convs |= {c: convs[1] + [("user", f"x{i}") for i in range(c - 50)] for c in range(60, 70)}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    r.shuffle(rows)
    got = prefix_trie.prefix_trie(prefix_trie.conversations(spark.createDataFrame(rows, TURNS)))
    assert found(got) == plain_trie(convs)


def test_nulls_ties_and_repeats(spark, docs):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 5, "user", "first"), (2, 6, "", ""), (None, 0, "user", "x"),
            (3, 0, "user", "x"), (3, 0, "user", "y")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"shard": F.lit(1), "seq": F.lit("x"), "t": F.lit(2)})
    got = found(prefix_trie.prefix_trie(prefix_trie.conversations(df)))
    tied = sorted((("user", "x"), ("user", "y")), key=lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest())
    assert got == plain_trie({1: [("user", "first"), ("", ""), ("", "")], 2: [("user", "first"), ("", "")], 3: tied})


def test_roles_and_texts_do_not_run_together(spark, docs):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]
    assert len(found(prefix_trie.prefix_trie(prefix_trie.conversations(spark.createDataFrame(rows, TURNS))))) == 3


def test_empty_table(spark, docs):
    assert found(prefix_trie.prefix_trie(prefix_trie.conversations(spark.createDataFrame([], TURNS)))) == []


def test_rebuilt_takes_heads_of_another_conversation(spark, docs):
    rows = [(c, i, "user", f"{c}.{i}") for c, n in ((0, 3), (1, 5), (2, 1), (6, 2)) for i in range(n)]
    convs = prefix_trie.conversations(spark.createDataFrame(rows, TURNS))
    base = F.col("conv_id") - F.col("conv_id") % 5
    mixed = prefix_trie.rebuilt(convs, base, F.when(F.col("conv_id") == 1, 4).otherwise(2), 8)
    got = {r["conv_id"]: [t["size"] for t in r["turns"]] for r in mixed.collect()}
    assert {c: len(t) for c, t in got.items()} == {0: 3, 1: 3 + 1, 2: 2, 6: 0}       # 6: no conversation 5, and no turn left
    trie = found(prefix_trie.prefix_trie(mixed))
    t = {c: [("user", f"{c}.{i}") for i in range(n)] for c, n in ((0, 3), (1, 5), (2, 1), (6, 2))}
    assert trie == plain_trie({0: t[0], 1: t[0] + t[1][4:], 2: t[0][:2], 6: []})


def test_long_conversation(spark, docs):
    turns = [("user", str(i)) for i in range(3000)]
    convs = {1: turns, 2: turns[:2000], 3: turns[:100] + [("user", "z")]}
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)]
    got = found(prefix_trie.prefix_trie(prefix_trie.conversations(spark.createDataFrame(rows, TURNS))))
    assert len(got) == 3002
    by_depth = {(r[1], r[0]): r for r in got}
    assert by_depth[0, 1][3:7] == (3, 1, 2, sum(len(str(i)) for i in range(2000)) + sum(len(str(i)) for i in range(100)))
    assert by_depth[101, 3][2] == 1 and by_depth[2000, 1][7] == hashlib.sha256(b"2").hexdigest()
