"""Operators over the whole corpus, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import chunk_dedup, components, difference_cover, near_dups, pareto_mix, resharding, suffix_dedup
from dwell.llm.queries import laid_out_by_source

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def plain_components(rows, size, percent=80):
    sets = [shingle_set(r[1], size) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, corpus, size, monkeypatch):
    monkeypatch.setattr(near_dups, "HUBS", 1)
    got = near_dups.near_duplicates(docs(corpus, kept=1, component_id="x", root=2), size).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(plain_components(corpus, size), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dups.near_duplicates(docs([]), size).count() == 0


def test_keep_one(docs, corpus):
    df = docs(corpus, row="clash", hash=1)
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns
    want = Counter()
    seen = set()
    for (i, n, c), r in zip(plain_components(corpus, 5), corpus):
        if n == 0 or (i == c and c not in seen):
            want[i] += 1
            seen.add(c)
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_chained_variants_of_one_text(docs):
    """Variants that are near their neighbours, but mostly not the first: no pair may be lost."""
    r = random.Random(4)
    w = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        if i % 6 == 0:
            w = [f"w{i}" for i in range(150)]
        w = list(w)
        w[r.randrange(150)] = f"y{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = near_dups.near_duplicates(docs(rows), 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows, 4))


def test_registers_and_estimate():
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 63, 1000, dtype=np.uint64) >> r.integers(0, 63, 1000).astype(np.uint64)
    for value, packed in zip(values.tolist(), near_dups.compressed(values).tolist()):
        bits = f"{value:064b}"
        zeros = min(63, len(bits) - len(bits.lstrip("0")))
        assert packed >> 10 == zeros and packed & 1023 == int((bits[zeros + 1:] + "0" * 10)[:10], 2)
    shared = r.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.concatenate((shared, r.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(2))
    ra, rb = (near_dups.compressed(near_dups.least_hashes(x))[None] for x in (a, b))
    assert abs(near_dups.estimate(ra, rb, np.array([900]), np.array([900]))[0] - 0.8) < 0.12


def test_components(spark, docs):
    docs([])
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node, root in got.items():
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert root == min(seen)
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_difference_cover(monkeypatch):
    r = random.Random(1)
    for i in range(1500):
        monkeypatch.setattr(difference_cover, "MOST", 5 if i % 2 else 1 << 20)
        text = [r.randint(1, r.choice((1, 2, 10))) for _ in range(r.randint(1, 60))]
        for depth in (4, 100):
            order = difference_cover.suffix_order(np.array(text), depth).tolist()
            assert sorted(order) == list(range(len(text)))
            assert [text[i:i + depth] for i in order] == sorted(text[i:i + depth] for i in range(len(text)))


def plain_cut(rows):
    seen, out = {}, []
    key = lambda r: (r[0] is not None, r[0] or 0)
    texts = [(key(r), (r[1] or "").encode()) for r in rows]
    for k, raw in texts:
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            seen[w] = min(seen.get(w, (k, p)), (k, p))
    for (k, raw), r in zip(texts, rows):
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 99):
            if seen[raw[p:p + 100]] < (k, p):
                gone[p:p + 100] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((r[0], len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 10_000])
def test_suffix_dedup(docs, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 5000)
    r = random.Random(8)
    line = "Licensed under the same common line of about sixty bytes, as ever. "
    rows = corpus + [(400 + i, "".join(r.choices("abc", k=90)) + line + "".join(r.choices("abc", k=90))) for i in range(15)]
    rows += [(450, "".join(r.choices("abcd ", k=150)) * 2), (451, "z" * 99), (452, "z" * 100), (453, "z" * 101)]
    rows = [x for x in rows if x[0] is not None] + [(None, rows[1][1])]
    got = suffix_dedup.suffix_dedup(docs(rows, tag=1, spans="x"), hot=hot).collect()
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(x[c] for c in cols) for x in got), key=repr) == plain_cut(rows)
    assert suffix_dedup.suffix_dedup(docs([])).count() == 0


def plain_chunks(raw):
    """Borders found one byte at a time, the gear hash of the last 32 bytes summed anew at each."""
    gear, last = chunk_dedup.GEAR.tolist(), 0
    for end in range(1, len(raw) + 1):
        h = sum(gear[raw[end - 1 - j]] << j for j in range(min(32, end))) % 2 ** 32
        forced = end - last > chunk_dedup.MOST  # seen one byte late, as the byte after it
        if forced:
            yield last, last + chunk_dedup.MOST
            last += chunk_dedup.MOST
        if end == len(raw) or (h < 2 ** (32 - chunk_dedup.TOP_BITS) and end - last >= chunk_dedup.LEAST):
            yield last, end
            last = end


def plain_chunk_dedup(texts):
    """The spans cut from each text, in order: earliest places in a dictionary, runs grown byte by byte."""
    raws, seen, out = [(t or "").encode() for t in texts], {}, []
    for n, raw in enumerate(raws):
        runs = []  # start, end, places in earlier texts that stand for them
        for a, b in plain_chunks(raw):
            doc, at = seen.setdefault(raw[a:b], (n, a))
            if (doc, at) != (n, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1], runs[-1][3] = b, (doc, at + b - a)
                else:
                    runs.append([a, b, (doc, at), (doc, at + b - a)])
        merged = []
        for k, (a, b, (left, at), (right, stop)) in enumerate(runs):
            floor, ceiling = runs[k - 1][1] if k else 0, runs[k + 1][0] if k + 1 < len(runs) else len(raw)
            while a > floor and at > 0 and raw[a - 1] == raws[left][at - 1]:
                a, at = a - 1, at - 1
            while b < ceiling and stop < len(raws[right]) and raw[b] == raws[right][stop]:
                b, stop = b + 1, stop + 1
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append([(a, b) for a, b in merged if b - a >= chunk_dedup.LEAST_RUN or b - a == len(raw)])
    return out


def test_chunk_dedup_equals_brute_force(docs, corpus):
    """Passages at odd places, a stretch without borders in two phases (growth beyond one chunk), texts
    that repeat themselves, repeated rows and the corpus at large."""
    r = random.Random(91)
    word = lambda n: " ".join("".join(r.choices("abcdefghijkl", k=r.randrange(2, 9))) for _ in range(n))
    shared, flat = [word(51) for _ in range(4)], "x" * 3 + "yz" * 4000
    rows = [(1000 + i, f"{word(30)} {shared[i % 4]} {word(r.randrange(40))}") for i in range(40)]
    rows += [(2000, word(20) + flat + "#" + word(30)), (2001, word(23) + flat[r.randrange(400):] + "#" + word(30)), (2002, word(40)[:97] * 30)]
    texts = {}
    for i, text, *_ in [x for x in corpus if x[0] is not None] + rows:
        texts.setdefault(i, text)
    got = {x["doc_id"]: x for x in chunk_dedup.chunk_dedup(docs([*texts.items(), (1001, texts[1001])], doc=1, spans="x")).collect()}
    plain = plain_chunk_dedup([texts[i] for i in sorted(texts)])
    for i, spans in zip(sorted(texts), plain):
        assert [(s["start"], s["start"] + s["length"]) for s in got[i]["spans"]] == spans, i
        raw = (texts[i] or "").encode()
        assert got[i]["kept_text"] == chunk_dedup.without(raw, spans) and got[i]["n_removed"] == sum(b - a for a, b in spans)
    assert got[10]["n_removed"] == got[10]["n_bytes"] and not got[2]["n_removed"]
    assert all(got[i]["n_removed"] > 100 for i in range(51, 56)) and not got[50]["n_removed"]
    left = sum(shared[i % 4].encode() in got[1000 + i]["kept_text"] for i in range(4, 40))
    assert left <= 2
    assert chunk_dedup.chunk_dedup(docs([])).count() == 0


def test_chunk_dedup_of_null_and_equal_ids(docs):
    """A null id comes first; rows of one id are told apart by their texts; equal rows don't repeat each other."""
    r = random.Random(92)
    a, b = ("".join(r.choices("abcdefgh ", k=900)) for _ in range(2))
    got = chunk_dedup.chunk_dedup(docs([(None, a), (7, a), (7, b), (7, b), (8, "-" + b), (None, None), (9, "")])).collect()
    assert sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in got) == [
        (0, 0, 0), (0, 900, 0), (7, 900, 0), (7, 900, 0), (7, 900, 900), (8, 901, 900), (9, 0, 0)]


def test_chunks_resist_insertions():
    r = random.Random(9)
    raw = bytes(r.randrange(256) for _ in range(20_000))
    ends = chunk_dedup.chunk_ends(np.frombuffer(raw, np.uint8))
    moved = raw[:5000] + b"inserted" + raw[5000:]
    later = chunk_dedup.chunk_ends(np.frombuffer(moved, np.uint8)) - 8
    assert ends[-1] == len(raw) and set(ends[ends < 4900]) <= set(later + 8) and len(set(ends[ends > 5600]) - set(later)) == 0


def test_fewest_moves():
    r = random.Random(10)
    for _ in range(50):
        old = [r.randrange(1000) for _ in range(6)]
        even, more = divmod(sum(old), 6)
        new = [even + (j < more) for j in range(6)]
        flow = resharding.fewest_moves(old, new)
        assert [sum(f) for f in flow] == old and [sum(f[j] for f in flow) for j in range(6)] == new
        assert sum(map(sum, flow)) - sum(flow[i][i] for i in range(6)) == sum(max(0, a - b) for a, b in zip(old, new))


def test_fewest_moves_with_other_numbers_and_capacities():
    """Against the least cost over all ways to fill small capacities, byte by byte."""
    def least(old, room):
        ways = {tuple(room): 0}
        for i, n in enumerate(old):
            for _ in range(n):
                more = {}
                for left, cost in ways.items():
                    for j, r in enumerate(left):
                        if r:
                            to = left[:j] + (r - 1,) + left[j + 1:]
                            more[to] = min(more.get(to, 10 ** 9), cost + (i != j))
                ways = more
        return min(ways.values())

    r = random.Random(13)
    for _ in range(60):
        old, new = [r.randrange(5) for _ in range(r.choice((1, 2, 4)))], [r.randrange(6) for _ in range(r.choice((1, 3, 4)))]
        if sum(old) > sum(new):
            with pytest.raises(ValueError):
                resharding.fewest_moves(old, new)
            continue
        flow = resharding.fewest_moves(old, new)
        assert [sum(f) for f in flow] == old and all(sum(f[j] for f in flow) <= c for j, c in enumerate(new))
        assert sum(n for i, f in enumerate(flow) for j, n in enumerate(f) if i != j) == least(old, new)


def test_reshard_to_more_shards_and_given_capacities(spark, docs, tmp_path):
    rows = [(i, "x" * (i % 90), f"s{i}") for i in range(2000)]
    old = F.pmod(F.col("doc_id"), F.lit(3)).cast("int")
    total = sum(i % 90 + 1 for i in range(2000))
    for shards, capacities in ((12, None), (2, None), (8, [total] + [0] * 7), (4, [total // 2, total // 4, total // 4, total // 8])):
        got = resharding.reshard(docs(rows), old, shards, capacities=capacities).collect()
        sizes = [sum(x["size"] for x in got if x["shard"] == j) for j in range(shards)]
        room = capacities or [total / shards] * shards
        assert len(got) == 2000 and sum(sizes) == total and all(n <= c + 2 * 90 for n, c in zip(sizes, room))
        if capacities is None:
            assert max(sizes) - min(sizes) <= 4 * 90
    with pytest.raises(ValueError, match="do not fit"):
        resharding.reshard(docs(rows), old, capacities=[5, 5])


def test_rewrite_leaves_no_emptied_shard(spark, docs, tmp_path):
    rows = [(i, "x" * 50, "s") for i in range(600)]
    df, path = docs(rows), str(tmp_path / "shards")
    old = F.pmod(F.col("doc_id"), F.lit(4)).cast("int")
    df.withColumn("shard", old).withColumn("slot", F.col("doc_id")).write.partitionBy("shard").parquet(path)
    resharding.rewrite(resharding.resharded(df, old, capacities=[0, 600 * 51]), path)
    back = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in back.select("doc_id").collect()) == list(range(600))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {1} and not (tmp_path / "shards" / "shard=0").exists()


def test_reshard(spark, docs, corpus, tmp_path):
    r = random.Random(11)
    rows = corpus + [(1000 + i, "x" * r.randrange(200), f"s{r.randrange(20)}") for i in range(3000)]
    df = docs(rows, shard="clash", cell=1)
    got = resharding.reshard(df, laid_out_by_source()).collect()
    assert sorted(((x["doc_id"], x["size"], x["text_crc32"]) for x in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    sizes, slots = Counter(), defaultdict(list)
    for x in got:
        sizes[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * 5001
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert resharding.reshard(docs([]), laid_out_by_source()).count() == 0
    placed = resharding.resharded(df, laid_out_by_source())
    assert placed.columns == df.columns + ["_shard", "slot", "old_shard", "moved"] and placed.count() == len(rows)
    placed = resharding.resharded(docs(rows), laid_out_by_source())
    resharding.rewrite(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_pareto_mix(docs, corpus):
    r = random.Random(12)
    rows = corpus + [(1000 + i, " ".join(["w"] * r.randrange(1, 300)), r.choice(("big", "big", "s0", "s9", None))) for i in range(3000)]
    df = docs(rows, size="clash", target=1, k=2)
    got = pareto_mix.pareto_mix(df).collect()
    sizes = Counter()
    for i, t, *s in rows:
        sizes[s[0] if s else None] += len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    source = {}
    for i, t, *s in rows:
        source.setdefault(i, s[0] if s else None)
    taken = Counter()
    for x in got:
        assert x["taken"] <= 2 * x["size"] and x["taken"] == x["size"] * x["copies"]
        if x["doc_id"] is not None and x["doc_id"] >= 1000:
            assert x["target"] == pytest.approx(target[source[x["doc_id"]]]) and x["source_size"] == sizes[source[x["doc_id"]]]
        taken[round(x["target"], 6)] += x["taken"]
    for s in order:
        if sizes[s]:
            assert abs(taken[round(target[s], 6)] - target[s] * sum(round(target[q], 6) == round(target[s], 6) for q in order)) <= 400
    again = sorted(((x["doc_id"], x["size"], x["taken"]) for x in pareto_mix.pareto_mix(df).collect()), key=repr)
    assert again == sorted(((x["doc_id"], x["size"], x["taken"]) for x in got), key=repr)
    copies = pareto_mix.mixed_copies(df)
    assert copies.columns == df.columns and copies.count() == sum(x["copies"] for x in got)
    assert pareto_mix.pareto_mix(docs([])).count() == 0 and pareto_mix.mixed_copies(docs([])).count() == 0


def test_inclusion_odds_follow_the_size(spark, docs):
    """Over many salts a document is in the sample as often as its probability says; large ones are certain."""
    sizes = [400, 90, 60, *[5 + i for i in range(27)]]
    whole, salts = sum(sizes), 450
    # every salt is a source of its own; the ids differ, so the random numbers do
    many = docs([(s * 1000 + i, " ".join(["w"] * n), f"a{s:03d}") for s in range(salts) for i, n in enumerate(sizes)])
    # weights 3, 1, 2: targets of 2, 5/6 and 5/3 times the source; the third has one whole copy and samples 2/3
    got = [x for x in pareto_mix.pareto_mix(many).collect() if x["doc_id"] // 1000 % 3 == 2]
    salts //= 3
    assert got[0]["target"] == pytest.approx(whole * 5 / 3)
    rest = whole * 2 / 3
    certain: set[int] = set()
    while True:
        c = (rest - sum(sizes[i] for i in certain)) / sum(n * n for i, n in enumerate(sizes) if i not in certain)
        more = {i for i, n in enumerate(sizes) if i not in certain and c * n >= 1}
        if not more:
            break
        certain |= more
    often = Counter(x["doc_id"] % 1000 for x in got if x["copies"] > 1)
    for i, n in enumerate(sizes):
        p = 1.0 if i in certain else c * n
        assert abs(often[i] / salts - p) < 0.17, (i, n, p, often[i])
    assert certain and sum(often[i] for i in range(21, 30)) > 1.3 * sum(often[i] for i in range(3, 12))


def test_equal_rows_and_null_ids_spread(spark, docs):
    rows = [(None, f"a b c {i}", "s") for i in range(3000)] + [(9007, "same row here", "s")] * 2000 + [(i, "x y", "t") for i in range(3000)]
    got = pareto_mix.pareto_mix(docs(rows)).collect()
    assert len(got) == 8000 and len({x["copies"] for x in got if x["doc_id"] == 9007}) == 1
    for source_size in {x["source_size"] for x in got}:
        own = [x for x in got if x["source_size"] == source_size]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 6000
