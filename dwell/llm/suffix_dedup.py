"""Suffix-array dedup (8): difference-cover suffix sorting.

Removes every byte covered by a 100-byte string that also starts earlier (smaller id, or same id and
earlier start). Whether two places start the same 100 bytes is decided by suffix order: suffixes are
sorted by the difference cover modulo 3 (sampled triples are sorted and named, the names' string is
ordered recursively, the remaining suffixes are merged in) and adjacent ones are compared over 100 bytes.

Sorting the suffixes of the whole corpus would shuffle tens of bytes for each byte of text at every
level. Equal 100-byte strings have the same least 32-byte hash (their anchor), so the work is cut up by
anchors, without losing a place:

1. Each text is split into runs of 100-byte windows with the same anchor. Anchors that occur at one
   place only can't start a repeat; the others are found by dealing anchors out (``_repeated_runs``).
2. The text of each run that is left goes to its anchor's group. There, equal runs are resolved by
   place, and the suffixes of different runs are sorted together, in batches of whole groups.
3. Each document gets its covered spans and is cut.

Identical texts are handled once: later copies of 100 bytes or more are removed entirely.

Scale: tasks reduce what they hold before each shuffle (equal anchors, equal runs), so a hot passage
sends a record per task and flush. An anchor of more than ``HOT`` places in different surroundings would
make a large group; its windows are dealt out one by one, by 128-bit digest. The list of such anchors
is bounded by ``MOST_HOT``, as the limit grows with the input's bytes. Texts are shuffled twice.

Defined results: null and empty texts have nothing to remove; a null id is the smallest; rows with equal
ids and different texts are documents of their own, in the order of a hash of their texts; rows equal in
both are cut alike, neither being earlier; texts are cut at bytes, so kept text may not be valid UTF-8; an empty table gives no rows; further
columns never matter. Hashes and digests decide only where strings meet, but for hot anchors, whose
windows are compared by 128-bit digest.
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

from dwell.llm import chunk_dedup, packing, scratch, words
from dwell.llm.difference_cover import suffix_order

LENGTH = 100
ANCHOR = 32                     # bytes of an anchor, a power of two
WINDOW = LENGTH - ANCHOR + 1
BATCH = 1_000_000               # bytes of runs sorted together, in whole groups
HELD = 16_000_000               # bytes of runs a task holds before it hands them over
HOT = 10_000
MOST_HOT = 1_000_000

RUN = np.dtype([("anchor", "u8"), ("tag", "i8"), ("start", "u4"), ("length", "u4"), ("twice", "?")])
SPAN = chunk_dedup.SPAN
SEEN = np.uint32(0xFFFFFFFF)    # start of a record that stands for ``length`` places of an anchor
BODY = "anchor long, kind int, doc long, tag long, start long, twice boolean, body binary"
SPANS, PART, WINDOWS = 0, 1, 2  # kinds of BODY rows

POWERS = {1: np.uint64(0x9E3779B97F4A7C15)}
for _width in (2, 4, 8, 16):
    POWERS[_width] = np.uint64(int(POWERS[_width // 2]) ** 2 % (1 << 64))


def anchor_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place."""
    h, width = words.BYTE_CODE[b], 1
    while width < ANCHOR:
        h = h[:-width] * POWERS[width] + h[width:]
        width *= 2
    return words.mix(h)


def sliding(x: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each WINDOW consecutive values."""
    y, width = x, 1
    while 2 * width <= WINDOW:
        y = pick(y[:-width], y[width:])
        width *= 2
    return pick(y[:len(x) - WINDOW + 1], y[WINDOW - width:])


def runs(b: np.ndarray, tag: int) -> np.ndarray:
    """The runs of windows with the same anchor; twice: the anchor stands at several places."""
    if len(b) < LENGTH:
        return np.empty(0, dtype=RUN)
    h = anchor_hashes(b)
    least = sliding(h, np.minimum)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    margin = np.zeros(WINDOW - 1, dtype=np.uint64)
    places, times = np.unique(h[sliding(np.concatenate((margin, least, margin)), np.maximum) == h], return_counts=True)
    out = np.empty(len(start), dtype=RUN)
    out["anchor"], out["tag"], out["start"] = least[start], tag, start
    out["length"] = np.diff(np.append(start, len(least)))
    out["twice"] = np.isin(out["anchor"], places[times > 1])
    return out


def occurrences(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by anchor, each place once; the number of places of each record's anchor; and
    whether a place repeats the anchor itself."""
    r = r[np.lexsort((r["start"], r["tag"], r["anchor"]))]
    seen = r["start"] == SEEN
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["anchor"][1:] != r["anchor"][:-1]) | (r["tag"][1:] != r["tag"][:-1]) | (r["start"][1:] != r["start"][:-1]) | seen[1:]
    r, seen = r[new], seen[new]
    head = np.flatnonzero(np.concatenate(([True], r["anchor"][1:] != r["anchor"][:-1]))) if len(r) else np.empty(0, dtype=int)
    sizes = np.diff(np.append(head, len(r)))
    places = np.add.reduceat(np.where(seen, r["length"], 1).astype(np.int64), head) if len(r) else sizes
    twice = np.logical_or.reduceat(r["twice"], head) if len(r) else sizes.astype(bool)
    return r, np.repeat(places, sizes), np.repeat(twice, sizes)


def _rows(out: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about 16 MB."""
    part, size = [], 0
    for row in out:
        part.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _repeated_runs(rows: DataFrame, buckets: int, limit: int) -> tuple[DataFrame, list[int]]:
    """(tag, runs): of each text, the runs whose anchor has several places; and the hot anchors."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("records", pa.binary())])

        def flush() -> Iterator[pa.RecordBatch]:
            r, places, twice = occurrences(np.concatenate(held))
            known = (places > 1) | twice
            first = known & np.concatenate(([True], r["anchor"][1:] != r["anchor"][:-1]))
            seen = r[first]
            seen["tag"], seen["start"], seen["length"], seen["twice"] = 0, SEEN, places[first], True
            open_ = np.concatenate((r[~known], seen))
            out = [(int(k), False, p.tobytes()) for k, p in packing.grouped(open_, open_["anchor"] % np.uint64(buckets))]
            r = r[known]
            out += [(int(k), True, p.tobytes()) for k, p in packing.grouped(r, r["tag"].astype(np.uint64) % np.uint64(buckets))]
            yield from _rows(out, schema)

        held, n = [], 0
        for batch in batches:
            for tag, raw in zip(batch.column("tag").to_pylist(), batch.column("raw").to_pylist()):
                held.append(runs(words.as_bytes(raw), tag))
                n += len(held[-1])
                if n >= packing.FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tag", pa.int64()), ("records", pa.binary())])
        for _, held in packing.runs_of(batches, "bucket"):
            table = pa.Table.from_batches(held)
            known = packing.blobs(table.filter(table["known"]).to_batches(), "records", RUN)
            r, places, twice = occurrences(packing.blobs(table.filter(pa.compute.invert(table["known"])).to_batches(), "records", RUN))
            hot = np.unique(r["anchor"][places > limit])
            r = np.concatenate((known, r[((places > 1) | twice) & (r["start"] != SEEN)]))
            out = [(int(k), p.tobytes()) for k, p in packing.grouped(r, r["tag"])]
            yield from _rows(out + [(None, hot.tobytes())] * bool(len(hot)), schema)

    dealt = rows.mapInArrow(local, "bucket long, known boolean, records binary").repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.stored(dealt.mapInArrow(meet, "tag long, records binary"), "suffix-anchors")
    hot = [int(x) for r in met.filter(F.col("tag").isNull()).toLocalIterator() for x in np.frombuffer(r["records"], dtype=np.uint64)]
    return met.filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.collect_list("records").alias("runs")), hot


class Covered(dict):
    """(doc, tag) -> spans (start, end) that are covered; spans added in order are joined."""

    def add(self, doc: int, tag: int, start: int, end: int) -> None:
        own = self.setdefault((doc, tag), [])
        if own and own[-1][0] <= start <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], end))
        else:
            own.append((start, end))

    def windows(self, docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> None:
        order = np.lexsort((starts, tags, docs))
        for doc, tag, start in zip(docs[order].tolist(), tags[order].tolist(), starts[order].tolist()):
            self.add(doc, tag, start, start + LENGTH)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        for (doc, tag), spans in self.items():
            yield doc, tag, np.array([(a, b - a) for a, b in spans], dtype=SPAN).tobytes()


class Parts:
    """Runs to compare: of equal ones the earliest place stays, the others are covered."""

    def __init__(self, covered: Covered):
        self.covered, self.bytes, self.best = covered, 0, {}

    def add(self, body: bytes, place: tuple[int, int, int], anchor: int, twice: bool) -> None:
        old = self.best.get(body)
        if old is None:
            self.best[body] = (place, anchor, twice)
            self.bytes += len(body) + 300
        elif place != old[0]:
            first, other = sorted((place, old[0]))
            self.best[body] = (first, anchor, twice or old[2])
            doc, tag, start = other
            self.covered.add(doc, tag, start, start + len(body))
            self.bytes += 100

    def compare(self) -> None:
        """Sort the suffixes of the runs whose anchor has several of them, or repeats in one, and mark
        the windows that stand earlier."""
        times: dict[int, int] = {}
        for _, anchor, _ in self.best.values():
            times[anchor] = times.get(anchor, 0) + 1
        chosen = [(body, place) for body, (place, anchor, twice) in self.best.items() if twice or times[anchor] > 1]
        if not chosen:
            return
        text = np.frombuffer(b"".join(body for body, _ in chosen), dtype=np.uint8)
        sizes = np.array([len(body) for body, _ in chosen])
        ends = np.cumsum(sizes)
        order = suffix_order(text.astype(np.int64) + 1, LENGTH)
        owner = np.searchsorted(ends, order, side="right")
        inside = order + LENGTH <= ends[owner]      # suffixes that begin with a window of their run
        order, owner = order[inside], owner[inside]
        new = np.ones(len(order), dtype=bool)       # does the prefix differ from that of the suffix before?
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
        for i in range(1, len(order), 50_000):
            block = windows[order[i - 1:i + 50_000]]
            new[i:i + 50_000] = (block[1:] != block[:-1]).any(axis=1)
        doc, tag, start = (np.array(x, dtype=np.int64)[owner] for x in zip(*(place for _, place in chosen)))
        start = start + order - (ends - sizes)[owner]
        by_place = np.lexsort((start, tag, doc, np.cumsum(new)))
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # groups keep their extent
        first = by_place[head]
        later = (doc[by_place] != doc[first]) | (tag[by_place] != tag[first]) | (start[by_place] != start[first])
        later = by_place[later]
        self.covered.windows(doc[later], tag[later], start[later])


def _run_bodies(texts: DataFrame, buckets: int, hot: list[int]) -> DataFrame:
    """texts (doc, tag, raw, runs) -> BODY rows: runs to compare, windows of hot anchors, known spans."""
    hot_anchors = np.array(hot, dtype=np.uint64)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()),
                            ("twice", pa.bool_()), ("body", pa.binary())])

        def flush() -> Iterator[pa.RecordBatch]:
            out = [(anchor, PART, *place, twice, body) for body, (place, anchor, twice) in parts.best.items()]
            if single:
                r, later = chunk_dedup.later(np.concatenate(single))
                parts.covered.windows(r["doc"][later], r["tag"][later], r["start"][later])
                r = r[~later]
                out += [(int(k), WINDOWS, 0, 0, 0, False, p.tobytes()) for k, p in packing.grouped(r, r["hi"] % np.uint64(buckets))]
            out += [(tag, SPANS, doc, tag, 0, False, spans) for doc, tag, spans in parts.covered.rows()]
            yield from _rows(out, schema)

        parts, single = Parts(Covered()), []
        for batch in batches:
            for doc, tag, raw, records in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "raw", "runs"))):
                r = np.sort(np.frombuffer(b"".join(records), dtype=RUN), order="start")
                many = np.isin(r["anchor"], hot_anchors)
                cold = r[~many]
                signed = cold["anchor"].astype(np.int64).tolist()
                for anchor, start, length, twice in zip(signed, *(cold[c].tolist() for c in ("start", "length", "twice"))):
                    parts.add(raw[start:start + length + LENGTH - 1], (doc, tag, start), anchor, twice)
                for start, length in zip(r["start"][many].tolist(), r["length"][many].tolist()):
                    w = np.empty(length, dtype=chunk_dedup.RECORD)
                    digests = b"".join([xxhash.xxh128_digest(raw[i:i + LENGTH]) for i in range(start, start + length)])
                    w["hi"], w["lo"] = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2).T
                    w["doc"], w["tag"], w["start"], w["length"] = doc, tag, np.arange(start, start + length), LENGTH
                    single.append(w)
                    parts.bytes += w.nbytes
                if parts.bytes > HELD:
                    yield from flush()
                    parts, single = Parts(Covered()), []
        yield from flush()

    return texts.mapInArrow(bodies, BODY)


def _resolved(bodies: DataFrame) -> DataFrame:
    """BODY rows, each anchor's together -> (doc, tag, spans)."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("spans", pa.binary())])
        covered = Covered()
        parts = Parts(covered)
        for _, held in packing.runs_of(batches, "anchor"):
            single, known = [], []
            for batch in held:
                for kind, doc, tag, start, anchor, twice, body in zip(*(batch.column(c).to_pylist() for c in (
                        "kind", "doc", "tag", "start", "anchor", "twice", "body"))):
                    if kind == PART:
                        parts.add(body, (doc, tag, start), anchor, twice)
                    elif kind == WINDOWS:
                        single.append(np.frombuffer(body, dtype=chunk_dedup.RECORD))
                    else:
                        known.append((doc, tag, body))
            if single:
                r, later = chunk_dedup.later(np.concatenate(single))
                covered.windows(r["doc"][later], r["tag"][later], r["start"][later])
            yield from _rows(known, schema)
            if parts.bytes > BATCH:
                parts.compare()
                yield from _rows(list(covered.rows()), schema)
                covered = Covered()
                parts = Parts(covered)
        parts.compare()
        yield from _rows(list(covered.rows()), schema)

    dealt = bodies.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(meet, "doc long, tag long, spans binary")


def merged(spans: list[bytes]) -> list[tuple[int, int]]:
    """The maximal runs of bytes under the spans."""
    out: list[tuple[int, int]] = []
    for a, n in np.sort(np.frombuffer(b"".join(spans), dtype=SPAN), order="start").tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (start, length), kept_text (bytes),
    kept_sha256."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // packing.BUCKET_BYTES))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), packing.row_id(F.col(id_col)).alias("doc"), packing.text_tag(F.col(text_col)).alias("tag"),
                       text.alias("raw"))
    repeated, hot_anchors = _repeated_runs(rows.select("tag", "raw"), buckets, max(hot, size // MOST_HOT))
    copies = scratch.stored(rows.select("doc", "tag", F.sha2("raw", 256).alias("sha")), "suffix-copies")
    firsts = scratch.stored(copies.groupBy("sha").agg(F.min(F.struct("doc", "tag")).alias("f")).select("f.doc", "f.tag"), "suffix-firsts")
    wanted = scratch.stored(firsts.join(repeated, "tag"), "suffix-runs")
    bodies = _run_bodies(rows.select("doc", "tag", "raw").join(wanted, ["doc", "tag"]), buckets, hot_anchors)
    spans = _resolved(bodies).groupBy("doc", "tag").agg(F.collect_list("spans").alias("spans"))
    plan = scratch.stored(firsts.join(spans, ["doc", "tag"], "left").withColumn("first", F.lit(True)), "suffix-spans")

    @F.pandas_udf("n_removed long, n_spans long, spans array<struct<start:long,length:long>>, kept_text binary, kept_sha256 string")
    def cleaned(raw: pd.Series, spans: pd.Series, first: pd.Series) -> pd.DataFrame:
        out = []
        for r, s, f in zip(raw, spans, first):
            if f:
                cuts = merged(list(s)) if s is not None else []
            else:
                cuts = [(0, len(r))] if len(r) >= LENGTH else []
            kept = chunk_dedup.without(r, cuts)
            out.append((len(r) - len(kept), len(cuts), [{"start": a, "length": b - a} for a, b in cuts], kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "spans", "kept_text", "kept_sha256"])

    placed = rows.join(plan, ["doc", "tag"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return placed.select(F.col("id").alias(id_col), F.octet_length("raw").cast("long").alias("n_bytes"),
                         cleaned("raw", "spans", "first").alias("c")).select(id_col, "n_bytes", "c.*")
