"""Language identification by error-correcting output codes.

Method: every language gets a codeword of +1 and -1 bits. For each bit a linear classifier over hashed
byte n-grams is learnt that tells the languages with +1 from those with -1. A text's bits are decoded
by loss: each language's codeword is charged the logistic loss of every bit, weighted by how reliable
that bit was for the language, and the cheapest one wins. A text whose second codeword costs little
more is flagged as ambiguous.

Training reads a sample of at most about ``per_language`` labelled rows of each language (a bound, not
a share of the table; rare languages are taken whole) and keeps one count for each (language, bucket),
so the model has a fixed size. Every text is scored whole. Only the text goes into a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import scratch
from dwell.llm.words import LOWER, constants

PER_LANGUAGE = 5_000      # labelled rows of a language in the sample, about
MOST_LANGUAGES = 256      # the most frequent ones are learnt: bounds the model
UNKNOWN = "und"
SIZES = (1, 2, 3, 4)      # bytes of an n-gram
BITS = 14                 # of a bucket's number
BUCKETS = 1 << BITS
SMOOTHING = 0.5           # pseudo-counts a bucket, spread as the mean over all languages
SHARPNESS = 4.0           # the loss's argument for a text whose margin is the mean of its side
AMBIGUOUS = 0.6           # texts below this score are flagged
CHUNK = 64                # texts scored at a time
EXHAUSTIVE = 5            # up to so many languages every distinct bit is used
TRIALS = 200

#: a letter of a-z and every byte of a longer character as it is, all else a space
_SPACED = np.array([c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in LOWER], dtype=np.uint8)
_MULTIPLIERS = (constants(29, len(SIZES)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def bucket_counts(raw: bytes) -> np.ndarray:
    """How often each bucket's n-grams occur in a text: lower-cased, runs of other characters one space."""
    b = _SPACED[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    space = b == 0x20
    b = b[~(space & np.append(False, space[:-1]))].astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    gram = np.zeros(len(b), dtype=np.uint32)
    for j, multiplier in enumerate(_MULTIPLIERS):
        if len(b) <= j:
            break
        gram = (gram[:len(b) - j] | (b[j:] << np.uint32(8 * j)))[:len(b) - j]
        out += np.bincount((gram * multiplier + np.uint32(j)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return out


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of +1 and -1: all distinct bits for a few languages, else the best of some
    random codes by its least distance between two codewords."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= EXHAUSTIVE:
        bits = [[1, *(1 if k >> i & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=np.int8).T
    width, best, far = 15 * int(np.ceil(np.log2(n))), None, -1
    draw = np.random.default_rng(n)
    for _ in range(TRIALS):
        code = draw.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        apart = (width - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        least = int((apart + width * np.eye(n, dtype=np.int32)).min())
        if least > far and not np.any(np.abs(code.sum(axis=0)) == n):
            best, far = code, least
    return best


@dataclass
class Model:
    """Languages in order, their codewords, each bit's weights over buckets, the middle between its two
    sides' margins and their distance from it, and how far each bit counts for each language."""
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    reach: np.ndarray
    trust: np.ndarray

    def margins(self, raws: list[bytes]) -> np.ndarray:
        """Mean weight of a text's n-grams, for each bit."""
        counts = np.stack([bucket_counts(raw) for raw in raws]).astype(np.float32)
        return (counts @ self.weights) / counts.sum(axis=1, keepdims=True)

    def decode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the nearest language, its score) of each text; ties: the first language."""
        z = SHARPNESS * (self.margins(raws) - self.middle) / self.reach
        losses = np.logaddexp(0, -z[:, None, :] * self.code[None, :, :])
        cost = (losses * self.trust[None, :, :]).sum(axis=2)
        likely = np.exp(cost.min(axis=1, keepdims=True) - cost)
        return cost.argmin(axis=1), 1.0 / likely.sum(axis=1)


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of about ``per_language`` rows of each of the most frequent languages, by hash."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return labelled.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["n"]))])
    draw = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
    return labelled.filter(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model from rows (lang, text). Rows without a language, or without a letter in the text, teach
    nothing; without any other rows the model knows no language and answers `und`."""
    known = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(F.col("lang").cast("string"), "text")
    taught = scratch.stored(sample(known, per_language), "language-sample")
    counted = (taught.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
               .toPandas())                                    # at most languages x buckets
    languages = sorted(counted["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    table[np.searchsorted(languages, counted["lang"]), counted["bucket"].to_numpy(dtype=np.int64)] = counted["n"]
    code = codewords(len(languages))
    model = Model(languages, code, _bit_weights(table, code), np.zeros(code.shape[1]), np.ones(code.shape[1]), np.ones(code.shape))
    return _calibrated(model, taught) if code.size else model


def _bit_weights(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(buckets, bits): log ratio of a bucket's mean share over the languages with +1 and with -1."""
    if not code.size:
        return np.zeros((BUCKETS, 0), dtype=np.float32)
    share = table / table.sum(axis=1, keepdims=True)
    smooth = SMOOTHING * BUCKETS * (share.mean(axis=0) + 1.0 / BUCKETS) / 2
    share = (table + smooth) / (table.sum(axis=1, keepdims=True) + smooth.sum())
    sides = [(code == side).T.astype(float) for side in (1, -1)]
    plus, minus = (s @ share / s.sum(axis=1, keepdims=True) for s in sides)
    return np.log(plus / minus).T.astype(np.float32)


def _calibrated(model: Model, taught: DataFrame) -> Model:
    """Middle and reach of each bit's margin, then each bit's accuracy on each language, smoothed, as
    weights with mean 1 over the bits."""
    shape = model.code.shape
    found = taught.mapInArrow(_margin_sums(model), "lang string, bit long, n double, s double").groupBy("lang", "bit").agg(
        *[F.sum(c).alias(c) for c in ("n", "s")]).toPandas()          # languages x bits
    at = np.searchsorted(model.languages, found["lang"]), found["bit"].to_numpy(dtype=np.int64)
    n, mean = np.ones(shape), np.zeros(shape)
    n[at], mean[at] = found["n"], found["s"] / found["n"]
    plus, minus = ((mean * (model.code == side)).sum(axis=0) / (model.code == side).sum(axis=0) for side in (1, -1))
    model.middle, model.reach = (plus + minus) / 2, np.maximum((plus - minus) / 2, 1e-6)
    right = taught.mapInArrow(_margin_signs(model), "lang string, bit long, n double").groupBy("lang", "bit").agg(F.sum("n").alias("n")).toPandas()
    hits = np.zeros(shape)
    hits[np.searchsorted(model.languages, right["lang"]), right["bit"].to_numpy(dtype=np.int64)] = right["n"]
    trust = (hits + 1) / (n + 2)
    model.trust = trust / trust.mean(axis=1, keepdims=True)
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Chunks of a batch's texts, with their place."""
    texts = batch.column("text").cast(pa.large_binary())
    for at in range(0, len(texts), CHUNK):
        yield at, texts.slice(at, CHUNK).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, raws in _texts(batch):
            for lang, raw in zip(langs[at:], raws):
                table[lang] = table.get(lang, 0) + bucket_counts(raw)
    for lang, counts in table.items():
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(there), pa.string()), "bucket": there, "n": counts[there]})


def _by_language(batches, n_bits: int, values) -> Iterator[pa.RecordBatch]:
    """Sums over the texts of each (language, bit) of the arrays that ``values`` gives."""
    sums: dict[str, dict[str, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for at, raws in _texts(batch):
            here = langs[at:at + len(raws)]
            for lang in set(here):
                for name, x in values(lang, [r for r, own in zip(raws, here) if own == lang]).items():
                    held = sums.setdefault(lang, {})
                    held[name] = held.get(name, 0) + x
    for lang, held in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n_bits, pa.string()), "bit": np.arange(n_bits), **held})


def _margin_sums(model: Model):
    def values(lang, raws):
        m = model.margins(raws).astype(float)
        return {"n": np.full(m.shape[1], float(len(m))), "s": m.sum(axis=0)}
    return lambda batches: _by_language(batches, model.code.shape[1], values)


def _margin_signs(model: Model):
    def values(lang, raws):
        own = model.code[model.languages.index(lang)]
        return {"n": (((model.margins(raws) - model.middle) * own) > 0).sum(axis=0).astype(float)}
    return lambda batches: _by_language(batches, model.code.shape[1], values)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., lang_pred, score, ambiguous) of every row of ``docs`` (column text).

    A text that is null or has no letter is `und` with score 0, and ambiguous. With one learnt language
    every other text has that language, with score 1. The score is the winner's share of exp(-loss)."""
    rows = docs.select(*keep, F.when(has_letter(F.col("text")), F.col("text")).alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        for batch in batches:
            langs, scores = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            there = np.flatnonzero(np.asarray(batch.column("text").is_valid())) if model.languages else []
            for at in range(0, len(there), CHUNK):
                rows_here = there[at:at + CHUNK]
                won, score = model.decode(batch.column("text").take(pa.array(rows_here)).cast(pa.large_binary()).to_pylist())
                langs[rows_here], scores[rows_here] = np.array(model.languages, dtype=object)[won], score
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(scores < AMBIGUOUS)],
                                             names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
