"""Quality rules (7): compression bands.

A text that zstandard packs far better than prose repeats itself; one that it can hardly pack is
not prose. Both the whole text and fixed chunks of it are packed (a rest shorter than a chunk counts
within the text's last 1,024 bytes; shorter texts are judged as a whole only); the limits depend on length,
because short input packs worse. Plain counts (words, symbols, repeated lines and windows) come
from the same pass. One map over the documents, no shuffle; memory is bounded by the longest text.

Defined results: a null or empty text has zero counts and fails (fewer than 50 words); repeated
rows are judged alike; an empty table gives no rows; further columns never matter. A text of only
white space has no words and no lines that count.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import scratch, words

LEVEL = 3
CHUNK = 1024
MIN_WORDS = 50
#: (below so many bytes, least ratio, largest ratio) of the whole text; the last band has no end.
BANDS = ((512, 0.30, 0.95), (1024, 0.28, 0.88), (4096, 0.25, 0.80), (16384, 0.20, 0.75), (None, 0.15, 0.72))
#: Band of a full chunk, and the share of chunks outside it that rejects a text.
CHUNK_BAND = (0.25, 0.88)
BAD_CHUNK_SHARE = 1 / 3

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, bad_chunks long, n_chunks long")
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def repeated_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that stand twice or more in the text."""
    if len(h) < 4:
        return 0
    _, which, times = np.unique(words.shingles(h, 3), return_inverse=True, return_counts=True)
    twice = times[which] > 1
    inside = np.zeros(len(h), dtype=bool)
    for j in range(3):
        inside[j:len(h) - 2 + j] |= twice
    return int(inside.sum())


def repeated_lines(raw: bytes) -> int:
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\x0b\x0c\r"):
            seen.add(line)
    return again


def bands(raw: bytes, packer) -> tuple[bool, float | None, int, int]:
    """(inside all bands, ratio of the whole, chunks outside their band, chunks)."""
    if not raw:
        return False, None, 0, 0
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = next((lo, hi) for below, lo, hi in BANDS if below is None or len(raw) < below)
    at = list(range(0, len(raw) - CHUNK + 1, CHUNK))
    if at and len(raw) % CHUNK:
        at.append(len(raw) - CHUNK)
    chunks = [len(packer.compress(raw[i:i + CHUNK])) / CHUNK for i in at]
    bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
    good = low <= ratio <= high and (not chunks or bad < BAD_CHUNK_SHARE * len(chunks))
    return good, ratio, bad, len(chunks)


def judge(raw: bytes | None, packer) -> tuple:
    raw = raw or b""
    b = words.as_bytes(raw)
    starts, ends = words.bounds(b)
    n = len(starts)
    heads = np.cumsum((b & 0xC0) != 0x80, dtype=np.int64)  # code points begin at bytes that do not continue one
    chars = int((heads[ends - 1] - np.where(starts > 0, heads[starts - 1], 0)).sum()) if n else 0
    repeats = repeated_words(words.word_hashes(b, starts, ends))
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    good, ratio, bad, chunks = bands(raw, packer)
    return n, chars, int(SYMBOL[b].sum()), repeated_lines(raw), repeats, failed, not failed and good, ratio, bad, chunks


def verdict(text: Column) -> Column:
    """Struct of ``SCHEMA`` for a text column."""
    @F.pandas_udf(SCHEMA)
    def rules(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        for part in parts:
            yield pd.DataFrame([judge(raw, packer) for raw in part], columns=names)
    return rules(text.cast("binary"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the columns of ``SCHEMA``."""
    judged = docs.select(F.col(id_col), verdict(F.col(text_col)).alias("_rules"))
    return judged.select(F.col(id_col), "_rules.*")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    mark = scratch.fresh(docs, "_rules")
    return docs.withColumn(mark, verdict(F.col(text_col))["kept"]).filter(F.col(mark)).select(*[F.col(f"`{c}`") for c in docs.columns])
