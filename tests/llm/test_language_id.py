"""Language identification: counts and decoding against plain versions, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import language_id as li

WORDS = {"aa": "tora kema nilo sura vako", "bb": "schrit blund krag wolft zandt", "cc": "éole ùniu àrre quèt îlle", "dd": "мост река дом лес поле",
         "ee": "zzix qwop vrrk xylp jjub", "ff": "banana manana canada panama havana", "gg": "θαλ αση νερο φως γη"}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def rows(spark, langs, n=30, words=20):
    return spark.createDataFrame([(lang, text(lang, words, i)) for lang in langs for i in range(n)], "lang string, text string")


def plain_grams(t: str) -> Counter:
    raw = b" " + t.encode() + b" "
    b = []
    for c in raw:
        c = c + 32 if 65 <= c <= 90 else c
        c = c if c >= 128 or 97 <= c <= 122 else 32
        if not (c == 32 and b and b[-1] == 32):
            b.append(c)
    return Counter(tuple(b[i:i + n]) for n in li.SIZES for i in range(len(b) - n + 1))


@pytest.mark.parametrize("t", ["a", "Ab  c12 D", "", "été - ÉTÉ", "x" * 50])
def test_buckets_hold_every_gram(t):
    grams = plain_grams(t)
    counts = li.bucket_counts(t.encode())
    buckets: Counter = Counter()
    for g, n in grams.items():
        value = sum(c << 8 * i for i, c in enumerate(g))
        hashed = (value * int(li._MULTIPLIERS[len(g) - 1]) + len(g) - 1) % 2 ** 32
        buckets[hashed >> 32 - li.BITS] += n
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(buckets)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20, 100])
def test_codewords_are_apart(n):
    code = li.codewords(n)
    assert len({tuple(r) for r in code}) == n and all(abs(int(c.sum())) < n for c in code.T)
    least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert least >= (2 ** (n - 2) if n <= li.EXHAUSTIVE else code.shape[1] // 5)


@pytest.mark.parametrize("langs", [("aa", "bb"), ("aa", "bb", "cc", "dd"), tuple(WORDS)])
def test_held_out_accuracy(spark, docs, langs):
    model = li.fit(rows(spark, langs))
    unseen = spark.createDataFrame([(lang, text(lang, 8, f"new{i}")) for lang in langs for i in range(10)], "lang string, text string")
    got = li.predict(unseen, model, keep=("lang",)).collect()
    assert len(got) == 10 * len(langs) and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got)


def test_decoding_equals_a_plain_version(spark, docs):
    model = li.fit(rows(spark, ("aa", "bb", "cc", "dd")))
    for t in (text("aa", 5, 1), text("aa", 5, 1) + " " + text("cc", 5, 1), "q"):
        grams = li.bucket_counts(t.encode())
        margins = [sum(float(grams[i]) * float(model.weights[i, b]) for i in np.flatnonzero(grams)) / grams.sum() for b in range(7)]
        cost = [sum(model.trust[k, b] * math.log1p(math.exp(-model.code[k, b] * li.SHARPNESS * (margins[b] - model.middle[b]) / model.reach[b]))
                    for b in range(7)) for k in range(4)]
        won, score = model.decode([t.encode()])
        assert won[0] == cost.index(min(cost))
        assert score[0] == pytest.approx(1 / sum(math.exp(min(cost) - c) for c in cost), rel=1e-3)


def test_mixed_text_scores_lower(spark, docs):
    model = li.fit(rows(spark, ("aa", "bb", "cc")))
    pure, mixed = model.decode([text("aa", 40, 1).encode(), (text("aa", 20, 1) + " " + text("bb", 20, 1)).encode()])[1]
    assert pure > 0.95 and mixed < pure - 0.1


def test_rare_language_is_learnt(spark, docs):
    many = rows(spark, ("aa", "bb"), n=300).unionByName(rows(spark, ("dd",), n=2))
    model = li.fit(many, per_language=40)
    assert model.languages == ["aa", "bb", "dd"]
    assert li.predict(rows(spark, ("dd",), n=3), model, keep=()).select("lang_pred").distinct().collect() == [("dd",)]


def test_odd_rows(spark, docs):
    train = rows(spark, ("aa", "bb")).unionByName(spark.createDataFrame(
        [(None, "schrit"), ("xx", None), ("yy", ""), ("yy", "12 3"), ("aa", None)], "lang string, text string"))
    model = li.fit(train)
    assert model.languages == ["aa", "bb"]
    odd = [(1, None), (2, ""), (3, " \n12 ."), (4, "é"), (5, text("bb", 200_000, 1)), (5, text("bb", 3, 1)), (None, text("aa", 9, 1)), (6, "②")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "lang": F.lit("zz")})
    got = [tuple(r) for r in li.predict(df, model).collect()]
    assert [(r[0], r[1]) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, got[3][1]), (5, "bb"), (5, "bb"), (None, "aa"), (6, "und")]
    assert got[3][1] in ("aa", "bb") and all((r[2], r[3]) == (0.0, True) for r in got if r[1] == "und")


def test_no_or_one_language(spark, docs):
    empty = spark.createDataFrame([], "lang string, text string")
    one = li.fit(rows(spark, ("aa",)))
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in li.predict(df, li.fit(empty)).collect()] == [(1, "und", 0.0, True), (2, "und", 0.0, True)]
    assert [tuple(r) for r in li.predict(df, one).collect()] == [(1, "aa", 1.0, False), (2, "und", 0.0, True)]
    assert li.predict(df.limit(0), one).collect() == []
