"""Benchmark decontamination (3): BM25 inverted index with block-max WAND.

Test items are indexed by their words (lower-case ASCII, alphanumeric): a posting holds the item's BM25
weight of the word as a share of the item's full score, so a passage with all words of an item scores 1.
Items are searched by classes of length (up to 64, 512, 4,096, ... words), each with an index of its own,
so that an item's passages do not depend on how long other items are. A class reads every training text as
overlapping passages, twice as long as its longest possible item and half overlapping, so each place an
item can stand lies in one passage as a whole. Block-max WAND retrieves all items whose score reaches
``LEAST_SCORE``; those are verified: ``LEAST_OVERLAP`` of the question and of the words of the answer must
stand in one stretch of the passage, of half as many words again as the item and 8. The question's overlap
is the share of its 5-word shingles, or, if that is too small, 1 less the word edits a word that turn it
into the nearest part of the stretch: one edit breaks five shingles, but costs a question of 5 words or more a fifth at most. The answer is an
item's last sentence or line (or last third, if there is one only), the question what stands before it.

One map over the documents, no shuffle. The index is built by Spark from whole items; its parts hold at
most ``MOST_WORDS`` words each (word counts are checked, larger sets are split by item and searched
part by part), and travel with the function. Other items move an item's BM25 weights (how many items hold
a word, their mean length), but nothing else of its search.

Defined results: null or empty texts have no passages, null or wordless items match nothing; equal
texts under different ids are all reported, and so are different texts under one id (a row each); a row
that stands twice in the item table counts once; a null id is an id like others; a text with an item at many places gives one row, of its best passage; repeated
rows are all reported; an empty table of either kind gives no rows; further columns never matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import scratch, words

K1, B = 1.2, 0.75
LEAST_SCORE = 0.7
LEAST_OVERLAP = 0.8
SHINGLE = 5
CLASS_BITS = 3            # a class holds items up to eight times as long as the one below
BLOCK = 16                # postings under one maximum
RARE = 8                  # items of a word that counts in the bound taken for all passages at once
MOST_WORDS = 4_000_000    # words of the items of one part of the index

LEAKS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:long>>"
SENTENCE_END = re.compile(rb"[.?!]\s|\n")


def hashes(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = words.as_bytes(raw, lower=True)
    starts, ends = words.bounds(b, words.ALNUM)
    return words.word_hashes(b, starts, ends), starts, ends


def answer_start(raw: bytes, ends: np.ndarray) -> int:
    """Word at which the answer begins; each side keeps SHINGLE words if a sentence end allows it."""
    cuts = [int(np.searchsorted(ends, m.end(), side="right")) for m in SENTENCE_END.finditer(raw)]
    fit = [c for c in cuts if SHINGLE <= c <= len(ends) - SHINGLE]
    return fit[-1] if fit else len(ends) - len(ends) // 3


class Item(NamedTuple):
    item_id: int | None
    question: np.ndarray   # distinct shingles
    answer: np.ndarray     # distinct words
    asked: np.ndarray      # the question's words in order
    n_words: int


class Index(NamedTuple):
    codes: np.ndarray              # sorted word hashes
    items: list[Item]
    ids: list[list[int]]           # of each word: its items, ascending
    shares: list[list[float]]      # their shares
    block_max: list[list[float]]   # largest share of each BLOCK postings
    most: np.ndarray               # largest share of each word
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]   # of words in RARE items at most: offsets, items, shares
    common: np.ndarray             # of each item: sum of the shares of its other words
    span: int                      # words of the longest item of the class


def item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, item, raw): the different items, each under a key of its id and text."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("raw")).filter(F.col("raw").isNotNull())
    key = F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("null")), F.sha2("raw", 256))
    return rows.select(key.alias("row"), "item", "raw").dropDuplicates(["row"])


def postings(rows: DataFrame) -> DataFrame:
    """(row, word, n, length) of every item, then its share by BM25 over all items."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.string()), ("word", pa.int64()), ("n", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, _, _ = hashes(raw)
                word, n = np.unique(h.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(word), pa.string()), pa.array(word), pa.array(n.astype(np.int64)),
                                                  pa.array(np.full(len(word), len(h)))], schema=schema)

    table = scratch.stored(rows.select("row", "raw").mapInArrow(counts, "row string, word long, n long, length long"), "bm25-counts")
    n_items, mean = table.groupBy("row").agg(F.max("length").alias("length")).agg(F.count(F.lit(1)), F.avg("length")).first()
    df = table.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(mean))
    weight = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("n") * (K1 + 1) / (F.col("n") + norm)
    weighted = table.join(df, "word").withColumn("weight", weight)
    full = weighted.groupBy("row").agg(F.sum("weight").alias("full"))
    return scratch.stored(weighted.join(full, "row").select("row", "word", "length", (F.col("weight") / F.col("full")).alias("share")), "bm25-postings")


def index_of(items: list[tuple[str, int | None, bytes]], table: pd.DataFrame, span: int) -> Index:
    """items: (row, id, text) with words, at most ``span``, a row each; table: their postings."""
    parts = []
    for _, item_id, raw in items:
        h, _, ends = hashes(raw)
        at = answer_start(raw, ends)
        parts.append(Item(item_id, np.unique(words.shingles(h[:at], SHINGLE)), np.unique(h[at:]), h[:at], len(h)))
    slots = {row: i for i, (row, _, _) in enumerate(items)}
    word = table["word"].to_numpy().astype(np.int64).view(np.uint64)
    codes, code = np.unique(word, return_inverse=True)
    rows: list[list[tuple[int, float]]] = [[] for _ in codes]
    for c, row, share in zip(code.tolist(), table["row"].tolist(), table["share"].tolist()):
        rows[c].append((slots[row], share))
    rows = [sorted(r) for r in rows]
    shares = [[s for _, s in r] for r in rows]
    common = np.zeros(len(items))
    for r in rows:
        for i, s in r if len(r) > RARE else ():
            common[i] += s
    few = [r if len(r) <= RARE else [] for r in rows]
    rare = (np.cumsum([0, *map(len, few)]), np.array([i for r in few for i, _ in r], dtype=np.int64),
            np.array([s for r in few for _, s in r], dtype=float))
    return Index(codes, parts, [[i for i, _ in r] for r in rows], shares,
                 [[max(s[k:k + BLOCK]) for k in range(0, len(s), BLOCK)] for s in shares],
                 np.array([max(s) for s in shares]), rare, common, span)


def wand(terms: list[int], index: Index, least: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of ``least`` or more, for a passage's distinct words."""
    ids, shares, block_max, most = index.ids, index.shares, index.block_max, index.most
    cursors = [[ids[t][0], 0, t] for t in terms]
    out = []
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            total += most[t]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, after = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(index.items)
        for c in cursors[:pivot + 1]:  # blocks that would hold the pivot
            own, t = ids[c[2]], c[2]
            at = bisect_left(own, item, c[1])
            if at < len(own):
                bound += block_max[t][at // BLOCK]
                last = min(len(own), (at // BLOCK + 1) * BLOCK) - 1
                after = min(after, own[last] + 1)
        if bound < least:
            target = max(after, item + 1)
        else:
            target, score = item + 1, 0.0
            for c in cursors[:pivot + 1]:
                own = ids[c[2]]
                at = bisect_left(own, item, c[1])
                if at < len(own) and own[at] == item:
                    score += shares[c[2]][at]
            if score >= least:
                out.append((item, score))
        kept = []
        for k, c in enumerate(cursors):
            if k <= pivot and c[0] < target:
                own = ids[c[2]]
                c[1] = bisect_left(own, target, c[1])
                if c[1] == len(own):
                    continue
                c[0] = own[c[1]]
            kept.append(c)
        cursors = kept
    return out


def likely(half: np.ndarray, word: np.ndarray, n_halves: int, index: Index, least: float) -> np.ndarray:
    """Passages (a half and the next one) that may hold an item: its rare words that are there, and all
    its common words, would make the score. An upper bound, for all passages and items at once."""
    offset, items, shares = index.rare
    n = offset[word + 1] - offset[word]
    at = np.repeat(offset[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pair = np.repeat(half, n) * len(index.items) + items[at]
    pairs = np.concatenate((pair, pair - len(index.items)))   # a half belongs to two passages
    weight = np.concatenate((shares[at], shares[at]))[pairs >= 0]
    pairs, code = np.unique(pairs[pairs >= 0], return_inverse=True)
    score = np.bincount(code, weights=weight, minlength=len(pairs)) + index.common[pairs % len(index.items)]
    sure = np.arange(n_halves) if (index.common >= least).any() else np.empty(0, dtype=np.int64)
    return np.unique(np.concatenate((pairs[score >= least] // len(index.items), sure)))


def aligned(question: np.ndarray, passage: np.ndarray) -> float:
    """1 - (least word edits between the question and any stretch of the passage) / its words."""
    place = np.arange(len(passage) + 1)
    cost = np.zeros(len(passage) + 1, dtype=np.int64)
    for i, word in enumerate(question, 1):
        step = np.minimum(cost[:-1] + (passage != word), cost[1:] + 1)
        cost = np.minimum.accumulate(np.concatenate(([i], step)) - place) + place
    return 1 - int(cost.min()) / len(question)


def overlaps(item: Item, passage: np.ndarray) -> tuple[float, float, int] | None:
    """(question, answer, first word) of the best stretch of a passage in which both overlap enough."""
    width, step = item.n_words + item.n_words // 2 + 8, item.n_words // 4 + 1
    best = None
    for at in range(0, max(1, len(passage) - width + step), step):
        stretch = passage[at:at + width]
        answer = np.isin(item.answer, stretch).mean() if len(item.answer) else 1.0
        if answer < LEAST_OVERLAP:
            continue
        question = np.isin(item.question, words.shingles(stretch, SHINGLE)).mean() if len(item.question) else 1.0
        if question < LEAST_OVERLAP:
            question = max(question, aligned(item.asked, stretch))
        if question >= LEAST_OVERLAP and (best is None or question + answer > best[0] + best[1]):
            best = float(question), float(answer), at
    return best


def leaks(h: np.ndarray, index: Index) -> list[dict]:
    """The verified items in a text's words, each with its best stretch."""
    if not len(h) or not index.items:
        return []
    at = np.minimum(np.searchsorted(index.codes, h), len(index.codes) - 1)
    place = np.flatnonzero(index.codes[at] == h)
    n_codes, span = len(index.codes), index.span
    found = np.unique(place // span * n_codes + at[place])   # distinct words of each half passage
    half, word = found // n_codes, found % n_codes
    n_halves = -(-len(h) // span)
    edges = np.searchsorted(half, np.arange(n_halves + 1))
    best: dict[int, tuple] = {}
    least = LEAST_SCORE - 1e-9
    for p in likely(half, word, n_halves, index, least).tolist():
        if p + 1 == n_halves and p:
            continue  # the last half alone lies in the passage before
        terms = np.unique(word[edges[p]:edges[min(p + 2, n_halves)]])
        for i, score in wand(terms.tolist(), index, least):
            seen = overlaps(index.items[i], h[p * span:(p + 2) * span])
            if seen is not None:
                question, answer, first = seen
                best[i] = max(best.get(i, (0.0,)), (question + answer, float(score), question, answer, -p * span - first))
    return [{"item_id": index.items[i].item_id, "score": s, "question_overlap": q, "answer_overlap": a, "first_word": -w}
            for i, (_, s, q, a, w) in sorted(best.items())]


def _indexes(items: DataFrame, id_col: str, text_col: str) -> list[Index]:
    rows = item_rows(items, id_col, text_col)
    # the power of eight, 64 or more, that holds the item's words
    bits = F.length(F.bin(F.col("length") - 1))
    table = postings(rows).withColumn("power", F.greatest(F.lit(6), F.ceil(bits / CLASS_BITS).cast("int") * CLASS_BITS))
    totals = table.groupBy("row", "power").agg(F.max("length").alias("n")).groupBy("power").agg(F.sum("n").alias("n")).orderBy("power").collect()
    out = []
    for power, total in totals:
        parts = -(-total // MOST_WORDS)
        for p in range(parts):
            own = table.filter((F.col("power") == power) & (F.pmod(F.xxhash64("row"), F.lit(parts)) == p))
            shares = own.select("row", "word", "share").toPandas()       # about MOST_WORDS words
            texts = [(r["row"], r["item"], bytes(r["raw"])) for r in rows.join(own.select("row").distinct(), "row", "left_semi").collect()]
            out.append(index_of(sorted(texts, key=lambda t: (t[1] is not None, t[1], t[0])), shares, 1 << power))
    return out


def leaked_items(text: Column, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Column:
    """LEAKS for a text column."""
    indexes = _indexes(items, id_col, text_col)
    if not indexes:
        return F.array().cast(LEAKS)

    @F.pandas_udf(LEAKS)
    def found(raw: pd.Series) -> pd.Series:
        hashed = (hashes(r)[0] for r in raw)
        return pd.Series([[leak for index in indexes for leak in leaks(h, index)] for h in hashed], dtype=object)

    return found(text.cast("binary"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item found in it: id, item_id, score, question_overlap,
    answer_overlap, first_word (of the stretch)."""
    found = docs.select(F.col(id_col), F.explode(leaked_items(F.col(text_col), items)).alias("_leak"))
    return found.select(F.col(id_col), "_leak.*")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that hold a test item."""
    mark = scratch.fresh(docs, "_leaks")
    marked = docs.withColumn(mark, leaked_items(F.col(text_col), items))
    return marked.filter(F.size(mark) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
