"""Substring dedup (9): content-defined chunking.

A gear hash rolls over each text's bytes; a chunk ends where the hash of the last 32 bytes has its top
bits zero, so chunk borders move with the content and an insertion changes the chunks around it only.
A chunk whose 128-bit digest stands earlier (smaller id, then earlier start) is a repeat; repeats side
by side make a run. A passage begins and ends inside chunks that hold other bytes too, so each end of
a run grows byte by byte as far as the text agrees with the one around the earliest place of the
run's outermost chunk. Runs that touch are one; runs of ``LEAST_RUN`` bytes, or of a whole text, are
cut out. Each byte cut stands earlier too, so the earliest place always stays.

Scale: chunk records are dealt by digest; a task first keeps the earliest place of each digest it has
seen and sends later ones straight on as repeats, so a hot chunk sends a record per task and flush.
Growing joins the ends of runs with the earliest places (one row a digest), reads the bytes beside
both, at most one chunk's length, and compares them; ends that agree throughout go on with twice that
length, so nothing limits the growth and rounds follow its logarithm.

Defined results: null and empty texts have no chunks; rows with equal ids and different texts are
documents of their own, in the order of a hash of their texts; rows equal in both don't repeat each
other; a null id counts as the smallest; ties in digest are resolved by place, so reruns agree; an
empty table gives no rows; further columns never matter.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from dwell.llm import packing, scratch, words

TOP_BITS = 5         # a border after 32 bytes on average
LEAST, MOST = 16, 512
LEAST_RUN = 100

GEAR = (words.constants(41, 256) >> np.uint64(32)).astype(np.uint32)
RECORD = np.dtype([("hi", "u8"), ("lo", "u8"), ("doc", "i8"), ("tag", "i8"), ("start", "u4"), ("length", "u4")])
SPAN = np.dtype([("start", "u4"), ("length", "u4")])
SHARED, LAST = 1, 2  # flags: a task has seen the digest at a later place too; the chunk ends its text
CHUNK = np.dtype(RECORD.descr + [("flags", "u4")])
REPEAT = np.dtype(SPAN.descr + [("flags", "u4"), ("hi", "u8"), ("lo", "u8")])


def rolling(b: np.ndarray) -> np.ndarray:
    """Gear hash of the up to 32 bytes that end at each place."""
    h, width = GEAR[b], 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunk_ends(b: np.ndarray) -> np.ndarray:
    ends, last = [], 0
    for end in (np.flatnonzero(rolling(b) >> np.uint32(32 - TOP_BITS) == 0) + 1).tolist() + [len(b)]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == len(b) > last:
            ends.append(end)
            last = end
    return np.array(ends, dtype=np.int64)


def chunks(raw: bytes | None, doc: int, tag: int) -> np.ndarray:
    b = words.as_bytes(raw)
    ends = chunk_ends(b)
    out = np.empty(len(ends), dtype=CHUNK)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    view = memoryview(raw or b"")
    digests = b"".join([xxhash.xxh128_digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())])
    halves = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)
    out["hi"], out["lo"], out["doc"], out["tag"] = halves[:, 0], halves[:, 1], doc, tag
    out["start"], out["length"], out["flags"] = starts, ends - starts, 0
    out["flags"][-1:] = LAST
    return out


def _first(r: np.ndarray) -> np.ndarray:
    """For each of the sorted records the number of the first one with its digest."""
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["hi"][1:] != r["hi"][:-1]) | (r["lo"][1:] != r["lo"][:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))


def later(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records, sorted, and which of them have the same digest at an earlier place."""
    r = r[np.lexsort((r["start"], r["tag"], r["doc"], r["lo"], r["hi"]))]
    first = _first(r)
    return r, (r["doc"] != r["doc"][first]) | (r["tag"] != r["tag"][first]) | (r["start"] != r["start"][first])


def later_chunks(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``later``, with the earliest places of repeated chunks flagged (all of them, where rows are equal)."""
    r, is_later = later(r)
    first = _first(r)
    some = np.zeros(len(r), dtype=bool)
    some[first[is_later | (r["flags"] & SHARED > 0)]] = True
    r["flags"] |= np.where(some[first] & ~is_later, SHARED, 0).astype("u4")
    return r, is_later


def _spans(r: np.ndarray) -> tuple[list, list, list]:
    docs, tags, spans = [], [], []
    r = r[np.lexsort((r["start"], r["tag"], r["doc"]))]
    border = np.flatnonzero((r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1])) + 1
    for part in np.split(r, border) if len(r) else []:
        docs.append(int(part["doc"][0]))
        tags.append(int(part["tag"][0]))
        own = np.empty(len(part), dtype=REPEAT)
        for name in REPEAT.names:
            own[name] = part[name]
        spans.append(own.tobytes())
    return docs, tags, spans


def repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, spans): the repeated chunks of each document; and the earliest place of each chunk
    that has repeats: hi, lo, first_doc, first_tag, start, length, flags."""
    buckets = packing.n_buckets(docs, text_col)
    text = F.col(text_col).cast("binary")
    rows = docs.select(packing.row_id(F.col(id_col)).alias("doc"), packing.text_tag(text).alias("tag"), text.alias("raw"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            r, is_later = later_chunks(np.concatenate(held))
            out = [(int(k), False, part.tobytes()) for k, part in packing.grouped(r[~is_later], r["hi"][~is_later] % np.uint64(buckets))]
            r = r[is_later]
            out += [(int(k), True, part.tobytes()) for k, part in packing.grouped(r, words.mix(r["doc"].astype(np.uint64)) % np.uint64(buckets))]
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "later", "records"), map(list, zip(*out[i:i + 1000])))), schema)

        schema = pa.schema([("bucket", pa.int64()), ("later", pa.bool_()), ("records", pa.binary())])
        held, n = [], 0
        for batch in batches:
            for doc, tag, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(chunks(raw, doc, tag))
                n += len(held[-1])
                if n >= packing.FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("spans", pa.binary()), ("firsts", pa.binary())])
        for _, held in packing.runs_of(batches, "bucket"):
            table = pa.Table.from_batches(held)
            known = packing.blobs(table.filter(table["later"]).to_batches(), "records", CHUNK)
            r, is_later = later_chunks(packing.blobs(table.filter(pa.compute.invert(table["later"])).to_batches(), "records", CHUNK))
            docs_, tags, spans = _spans(np.concatenate((known, r[is_later])))
            firsts = np.unique(r[~is_later & (r["flags"] & SHARED > 0)])  # equal rows give theirs twice
            blocks = [firsts[i:i + packing.FLUSH // 10].tobytes() for i in range(0, len(firsts), packing.FLUSH // 10)]
            columns = (docs_ + [0] * len(blocks), tags + [0] * len(blocks), spans + [None] * len(blocks), [None] * len(spans) + blocks)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    dealt = rows.mapInArrow(local, "bucket long, later boolean, records binary").repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.stored(dealt.mapInArrow(meet, "doc long, tag long, spans binary, firsts binary"), "chunk-meetings")
    found = met.filter(F.col("spans").isNotNull()).groupBy("doc", "tag").agg(F.collect_list("spans").alias("spans"))
    return scratch.stored(found, "chunk-repeats"), met.filter(F.col("firsts").isNotNull()).select("firsts").mapInArrow(_first_rows, FIRST)


FIRST = "hi long, lo long, first_doc long, first_tag long, start long, length long, flags long"


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("firsts").to_pylist():
            r = np.frombuffer(blob, dtype=CHUNK)
            columns = (r[name].astype(np.int64) for name in CHUNK.names)  # digests wrap around, as in _edges
            yield pa.RecordBatch.from_pydict({name.split()[0]: pa.array(c) for name, c in zip(FIRST.split(", "), columns)})


def runs(spans: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The repeated chunks of a text in order, and the runs of those side by side: (first, last) of each."""
    r = np.unique(np.frombuffer(b"".join(spans), dtype=REPEAT))
    r = r[np.concatenate(([True], r["start"][1:] != r["start"][:-1]))]  # repeated rows give their spans twice
    border = np.flatnonzero(r["start"][1:] != r["start"][:-1] + r["length"][:-1]) + 1
    return r, [(int(p[0]), int(p[-1])) for p in np.split(np.arange(len(r)), border)]


EDGE = "doc long, tag long, side int, at long, room long, hi long, lo long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both ends of each run that lie inside the text: side (-1 start, 1 end), place, bytes up to the
    next run (null: to the end of the text), digest of the outermost chunk."""
    names = [c.split()[0] for c in EDGE.split(", ")]
    types = [pa.int32() if c.endswith("int") else pa.int64() for c in EDGE.split(", ")]
    for batch in batches:
        out = []
        for doc, tag, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            r, own = runs(spans)
            hi, lo = r["hi"].astype(np.int64).tolist(), r["lo"].astype(np.int64).tolist()
            begins, ends = r["start"].astype(int).tolist(), (r["start"].astype(int) + r["length"]).tolist()
            for i, (a, b) in enumerate(own):
                if begins[a] > 0:
                    out.append((doc, tag, -1, begins[a], begins[a] - (ends[own[i - 1][1]] if i else 0), hi[a], lo[a]))
                if not r["flags"][b] & LAST:
                    out.append((doc, tag, 1, ends[b], begins[own[i + 1][0]] - ends[b] if i + 1 < len(own) else None, hi[b], lo[b]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)


@F.pandas_udf(LongType())
def _agreeing(side: pd.Series, own: pd.Series, other: pd.Series) -> pd.Series:
    """Bytes in which two texts agree, from the run outwards."""
    out = []
    for s, a, b in zip(side, own, other):
        n = min(len(a), len(b))
        x, y = np.frombuffer(a, dtype=np.uint8)[::s][:n], np.frombuffer(b, dtype=np.uint8)[::s][:n]
        differ = np.flatnonzero(x != y)
        out.append(int(differ[0]) if len(differ) else n)
    return pd.Series(out, dtype="int64")


def _compared(rows: DataFrame, asks: DataFrame, most: int) -> DataFrame:
    """asks (doc, tag, side, at, room, first_doc, first_tag, first_at, done) with n: the bytes, of at
    most ``most`` beyond the ``done`` ones, that also stand beside the earliest place."""
    key = ["first_doc", "first_tag", "side", "first_at", "done"]
    own = F.struct("side", "at", "room", "first_doc", "first_tag", "first_at", "done")
    theirs = F.struct("side", F.col("first_at").alias("at"), F.lit(None).cast("long").alias("room"), F.lit(None).cast("long").alias("first_doc"),
                      F.lit(None).cast("long").alias("first_tag"), F.lit(None).cast("long").alias("first_at"), "done")
    served = asks.select(key).distinct().select(F.col("first_doc").alias("doc"), F.col("first_tag").alias("tag"), theirs.alias("want"))
    wants = asks.select("doc", "tag", own.alias("want")).unionByName(served).groupBy("doc", "tag").agg(F.collect_list("want").alias("wants"))

    def beside(w):
        from_ = w["at"] + w["side"] * w["done"]
        n = F.least(F.lit(most), w["room"] - w["done"])  # a null room sets no bound
        n = F.when(w["side"] < 0, F.least(n, from_)).otherwise(n)
        begin = F.when(w["side"] < 0, from_ - n).otherwise(from_)
        return F.struct(w.alias("want"), F.substring(F.col("raw"), (begin + 1).cast("int"), n.cast("int")).alias("bytes"))

    read = (rows.join(wants, ["doc", "tag"]).select("doc", "tag", F.explode(F.transform("wants", beside)).alias("w"))
            .select("doc", "tag", "w.want.*", "w.bytes"))
    read = scratch.stored(read.dropDuplicates(["doc", "tag", "side", "at", "room", "first_doc"]), "chunk-beside")
    theirs = (read.filter(F.col("first_doc").isNull()).select(F.col("doc").alias("first_doc"), F.col("tag").alias("first_tag"), "side",
                                                             F.col("at").alias("first_at"), "done", F.col("bytes").alias("other")))
    return read.filter(F.col("first_doc").isNotNull()).join(theirs, key).withColumn("n", _agreeing("side", "bytes", "other")).drop("bytes", "other")


def grown(rows: DataFrame, found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, tag, grown): how far the ends of the runs of each document grow, as (side, at, n)."""
    edges = found.select("doc", "tag", "spans").mapInArrow(_edges, EDGE)
    inside = F.when(F.col("side") < 0, F.col("start") > 0).otherwise(F.col("flags").bitwiseAND(F.lit(LAST)) == 0)
    first_at = F.when(F.col("side") < 0, F.col("start")).otherwise(F.col("start") + F.col("length"))
    asks = scratch.stored(edges.join(firsts, ["hi", "lo"]).filter(inside).select(
        "doc", "tag", "side", "at", "room", "first_doc", "first_tag", first_at.alias("first_at"), F.lit(0).cast("long").alias("done")), "chunk-edges")
    steps, most = None, MOST
    while not asks.isEmpty():
        step = scratch.stored(_compared(rows, asks, most), "chunk-grown")
        steps = step if steps is None else steps.unionByName(step)
        asks = step.filter(F.col("n") == most).withColumn("done", F.col("done") + F.col("n")).drop("n")
        most *= 2
    if steps is None:
        return found.select("doc", "tag", F.lit(None).cast("array<struct<side:int,at:long,n:long>>").alias("grown")).limit(0)
    ends = steps.groupBy("doc", "tag", "side", "at").agg(F.sum("n").alias("n")).filter("n > 0")
    return ends.groupBy("doc", "tag").agg(F.collect_list(F.struct("side", "at", "n")).alias("grown"))


def cut(size: int, spans: list[bytes], ends: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """What to cut out: the runs with their grown ends (by side and place), those that touch as one,
    if long enough or the whole text."""
    r, own = runs(spans)
    begins, stops = r["start"].astype(int).tolist(), (r["start"].astype(int) + r["length"]).tolist()
    whole: list[tuple[int, int]] = []
    for a, b in own:
        begin, stop = begins[a] - ends.get((-1, begins[a]), 0), stops[b] + ends.get((1, stops[b]), 0)
        if whole and begin <= whole[-1][1]:
            begin, stop = whole[-1][0], max(stop, whole.pop()[1])
        whole.append((begin, stop))
    return [(a, b) for a, b in whole if b - a >= LEAST_RUN or b - a == size]


def without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in gone for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (start, length), kept_text (bytes;
    a cut may split a character), kept_sha256."""
    found, firsts = repeats(docs, id_col, text_col)
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), packing.row_id(F.col(id_col)).alias("doc"), packing.text_tag(text).alias("tag"),
                       F.coalesce(text, F.lit(b"")).alias("raw"))
    marked = scratch.stored(found.join(grown(rows.drop("id"), found, firsts), ["doc", "tag"], "left"), "chunk-runs")

    @F.pandas_udf("n_removed long, n_spans long, spans array<struct<start:long,length:long>>, kept_text binary, kept_sha256 string")
    def cleaned(raw: pd.Series, spans: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for r, s, g in zip(raw, spans, ends):
            far = {(e["side"], e["at"]): e["n"] for e in g} if g is not None else {}
            gone = cut(len(r), list(s), far) if s is not None else []
            kept = without(r, gone)
            out.append((len(r) - len(kept), len(gone), [{"start": a, "length": b - a} for a, b in gone], kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "spans", "kept_text", "kept_sha256"])

    return rows.join(marked, ["doc", "tag"], "left").select(
        F.col("id").alias(id_col), F.octet_length("raw").cast("long").alias("n_bytes"), cleaned("raw", "spans", "grown").alias("c")).select(id_col, "n_bytes", "c.*")
