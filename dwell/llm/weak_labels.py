"""Quality classifier (6): weak labels and a hashed linear scorer.

Overlapping heuristics vote good, bad or abstain on every document. The table of vote patterns, at most
3 to the number of labellers, is all that expectation-maximisation needs: it estimates each labeller's
vote probabilities on good and on bad documents, and each pattern's posterior. The posteriors are soft
labels for a linear scorer over hashed words, word shapes and pairs of shapes, fitted on a sample of
about ``SAMPLE`` documents (those whose hash of id and text is below a share, each row once); all
documents are scored by it.

Texts are read once: votes and features are stored together, and the sample and the scores come from
them. Votes are counted over all documents. Each round of fitting runs gradient steps in ``FITTERS`` tasks on
their shares of the sample and averages the weights; the sample's size and the weights (``DIMENSION``
numbers) are the only things that reach the driver or one task, and both are constants.

Defined results: a null, empty or wordless text is bad (score 0); a null id may be in the sample like
another; repeated rows score alike; an empty table gives no rows; further columns never matter. If all
votes agree the scorer only learns the prior.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import compression_rules, scratch, words

GOOD, BAD, ABSTAIN = "+", "-", "0"
SAMPLE = 20_000
FITTERS = 8
ROUNDS, PASSES, RATE, DECAY = 4, 3, 0.5, 1e-5
DIMENSION = 1 << 16
EM_STEPS = 100

UPPER = np.isin(np.arange(256), list(range(65, 91)))
LETTER = UPPER | np.isin(np.arange(256), list(range(97, 123)))
LINE_END = frozenset(b".?!:;\"')")
#: Byte classes of word shapes: upper case, lower case and other letters, digits, white space; other bytes stand for themselves
SHAPE = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)], dtype=np.uint8)

#: labeller -> (bad below, good from, good to, bad above) of its measure; between them it abstains
LIMITS = {
    "words": (30, 60, 1e9, 1e10),
    "word_length": (2.5, 3.0, 9.0, 14.0),
    "repeated_words": (-1, 0, 0.15, 0.40),
    "repeated_lines": (-1, 0, 0.05, 0.30),
    "symbols": (-1, 0, 0.005, 0.03),
    "capitals": (-1, 0, 0.25, 0.50),
    "compression": (0.25, 0.36, 0.80, 0.95),
    "finished_lines": (0.15, 0.5, 1.0, 2.0),
    "distinct_words": (0.08, 0.25, 1.0, 2.0),
    "bare_marks": (-1, 0, 0.03, 0.15),
}


class Split:
    """A text's bytes, word bounds and word hashes."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.b = words.as_bytes(self.raw)
        self.starts, self.ends = words.bounds(self.b)
        self.h = words.word_hashes(self.b, self.starts, self.ends)


def measures(text: Split, packer) -> list[float]:
    """The labellers' measures, in the order of LIMITS."""
    raw, b, starts, ends, h = text.raw, text.b, text.starts, text.ends, text.h
    n = len(starts)
    if not n:
        return [0.0] * len(LIMITS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = max(1, int(LETTER[b].sum()))
    plain = np.add.reduceat(words.ALNUM[words.LOWER[b]], starts) == 0  # words without a letter or digit
    return [n, float((ends - starts).mean()), compression_rules.repeated_words(h) / n,
            compression_rules.repeated_lines(raw) / len(lines), float(compression_rules.SYMBOL[b].mean()),
            float(UPPER[b].sum()) / letters, len(packer.compress(raw)) / len(raw),
            sum(line.rstrip()[-1] in LINE_END for line in lines) / len(lines), len(np.unique(h)) / min(n, 400),
            float(plain.mean())]


def vote(values: list[float]) -> str:
    out = []
    for value, (bad_below, good_from, good_to, bad_above) in zip(values, LIMITS.values()):
        out.append(BAD if value < bad_below or value > bad_above else GOOD if good_from <= value <= good_to else ABSTAIN)
    return "".join(out)


def examined(text: Column) -> Column:
    """votes, and the text's features: places (uint16) and times (uint32) as binary, and n_words."""
    @F.pandas_udf("votes string, places binary, times binary, n_words long")
    def looked(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=compression_rules.LEVEL)
        for part in parts:
            rows = []
            for raw in part:
                split = Split(raw)
                place, times = features(split)
                rows.append((vote(measures(split, packer)), place.astype(np.uint16).tobytes(), times.astype(np.uint32).tobytes(), len(split.h)))
            yield pd.DataFrame(rows, columns=["votes", "places", "times", "n_words"])
    return looked(text.cast("binary"))


class LabelModel(NamedTuple):
    prior: float               # of good
    chance: np.ndarray         # [labeller, class, vote] with classes bad, good and votes -, 0, +

    def posterior(self, patterns: list[str]) -> np.ndarray:
        coded = np.array([[(BAD + ABSTAIN + GOOD).index(v) for v in p] for p in patterns]).reshape(len(patterns), len(self.chance))
        logs = np.log(self.chance)
        each = logs[np.arange(len(self.chance))[None, :, None], np.arange(2)[None, None, :], coded[:, :, None]].sum(axis=1)
        each += np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(each[:, 0] - each[:, 1], -700, 700)))


def estimate(patterns: list[str], counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation over vote patterns, begun with the majority of the votes."""
    coded = np.array([[(BAD + ABSTAIN + GOOD).index(v) for v in p] for p in patterns])
    balance = (coded - 1).mean(axis=1)
    good = np.clip(0.5 + balance, 0.02, 0.98)
    model = None
    for _ in range(EM_STEPS):
        weights = np.stack([counts * (1 - good), counts * good])
        chance = np.stack([[np.bincount(column, weights=w, minlength=3) + 0.5 for w in weights] for column in coded.T])
        chance /= chance.sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip(weights[1].sum() / weights.sum(), 1e-3, 1 - 1e-3)), chance)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return model


def features(text: Split) -> tuple[np.ndarray, np.ndarray]:
    """Places in the weights, and how often each occurs."""
    h = text.h
    if not len(h):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    shape = SHAPE[text.b]
    shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))]  # a class in a row counts once
    s = words.word_hashes(shape, *words.bounds(shape))
    again = np.concatenate(([False], h[1:] == h[:-1])).astype(np.uint64)
    kinds = [h, words.mix(s + np.uint64(1)), words.mix(again + np.uint64(2)), words.shingles(words.mix(s + np.uint64(3)), 2)]
    return np.unique(np.concatenate(kinds) % np.uint64(DIMENSION), return_counts=True)


def unpacked(part: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values (root of times over the text's words) of stored features."""
    return [(np.frombuffer(p, dtype=np.uint16), np.sqrt(np.frombuffer(t, dtype=np.uint32) / max(1, n)))
            for p, t, n in zip(part["places"], part["times"], part["n_words"])]


def scores(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Probability of good; the last weight is the constant."""
    z = np.array([weights[-1] + float(weights[place] @ value) for place, value in rows])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def step(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
    """PASSES of stochastic gradient steps with rates that fall by place (Adagrad)."""
    weights, squares = weights.copy(), np.full(len(weights), 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)).tolist():
            place, value = rows[i]
            error = 1 / (1 + np.exp(-np.clip(weights[-1] + weights[place] @ value, -30, 30))) - labels[i]
            slope = error * value + DECAY * weights[place]
            squares[place] += slope * slope
            weights[place] -= RATE * slope / np.sqrt(squares[place])
            squares[-1] += error * error
            weights[-1] -= RATE * error / np.sqrt(squares[-1])
    return weights


def fit(sample: DataFrame) -> np.ndarray:
    """sample (part, order, label and features): averaged weights of ROUNDS rounds."""
    weights = np.zeros(DIMENSION + 1)
    for r in range(ROUNDS):
        now = weights

        def fitted(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["order", "label"])
            new = step(unpacked(part), part["label"].to_numpy(), now, r)
            return pd.DataFrame({"n": [len(part)], "weights": [new.astype(np.float64).tobytes()]})

        got = sample.groupBy("part").applyInPandas(fitted, "n long, weights binary").collect()  # FITTERS rows
        if not got:
            return weights
        weights = sum(g["n"] * np.frombuffer(g["weights"]) for g in got) / sum(g["n"] for g in got)
    return weights


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, votes, posterior (of its votes), score (of the scorer), kept."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    seen = scratch.stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), examined(text).alias("x"))
                          .select("id", "x.*", F.xxhash64(F.col("id").cast("string"), "hash").alias("order")), "weak-seen")
    patterns = seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 3 ** labellers rows
    if not len(patterns):
        return seen.select(F.col("id").alias(id_col), "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    model = estimate(patterns["votes"].tolist(), patterns["n"].to_numpy(dtype=float))
    posterior = dict(zip(patterns["votes"], model.posterior(patterns["votes"].tolist()).tolist()))
    table = F.broadcast(spark.createDataFrame(list(posterior.items()), "votes string, posterior double"))
    share = min(1.0, SAMPLE / int(patterns["n"].sum()))
    chosen = seen.filter(F.pmod("order", F.lit(1 << 40)) < int(share * (1 << 40))).dropDuplicates(["order"]).join(table, "votes")
    sample = scratch.stored(chosen.select("order", F.pmod(F.shiftright("order", 40), F.lit(FITTERS)).alias("part"), "places", "times",
                                          "n_words", F.col("posterior").alias("label")), "weak-sample")
    weights = fit(sample)

    @F.pandas_udf("double")
    def scored(places: pd.Series, times: pd.Series, n_words: pd.Series) -> pd.Series:
        out = scores(unpacked({"places": places, "times": times, "n_words": n_words}), weights)
        return pd.Series(np.where(n_words > 0, out, 0.0))

    result = seen.select("id", "votes", scored("places", "times", "n_words").alias("score")).join(table, "votes", "left")
    return result.select(F.col("id").alias(id_col), "votes", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
