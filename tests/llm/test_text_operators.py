"""Operators that judge each text by itself, against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard

from dwell.llm import compression_rules, decontaminate, licenses, token_counts, weak_labels
from dwell.llm.license_templates import NOTICES, PHRASES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def pairs(df, *cols):
    return sorted(((r["doc_id"] is not None, r["doc_id"], *[r[c] for c in cols]) for r in df.collect()), key=repr)


def test_token_counts_equal_the_library(docs, corpus):
    r = random.Random(1)
    odd = [(1000 + i, "".join(r.choices(" ▁\n\t\0ab1.,é漢😀 the </s><unk>\r", k=r.randrange(40)))) for i in range(500)]
    rows = [x[:2] for x in corpus] + odd + [(2000, "the word " * 3000)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(docs(rows, n_tokens=5, n_bytes="x"), MODEL)
    want = [(i is not None, i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in rows]
    assert pairs(got, "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    with open(MODEL, "rb") as f:
        model = f.read()
    sp = token_counts.processor(model)
    counts = token_counts.Counts(sp, token_counts.prove(model))
    for text in ("qxz zzq vvq kkj", "qxz ppq", "the\nqxz"):
        assert token_counts.count([text], counts) == [len(sp.encode(text))]


def plain_rules(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_a_model_that_removes_spaces_is_refused():
    with open(MODEL, "rb") as file:
        model = file.read()
    flag = model.rindex(b"\x20\x00") + 1
    with pytest.raises(ValueError, match="normaliser"):     # remove_extra_whitespaces, the normaliser's fourth field
        token_counts.prove(model[:flag] + b"\x01" + model[flag + 1:])


def test_quality_rules(docs, corpus):
    rows = [x[:2] for x in corpus] + [(300, "a b\n\na b\nc#*$ d\n \n a b"), (301, "x y z x y z x"), (302, "a\u0085b c d")]
    got = compression_rules.quality_rules(docs(rows, kept="clash", _rules=1))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert pairs(got, *cols) == sorted([(i is not None, i, *plain_rules(t)) for i, t in rows], key=repr)


def test_compression_bands():
    packer = zstandard.ZstdCompressor(level=3)
    r = random.Random(2)
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randrange(2, 8))) for _ in range(800))
    noise = "".join(chr(r.randrange(33, 127)) if r.random() < 0.9 else " " for _ in range(8000))
    assert compression_rules.judge(prose.encode(), packer)[6]
    assert not compression_rules.judge(("la la la di da " * 200).encode(), packer)[6]
    assert not compression_rules.judge(noise.encode(), packer)[6] and not compression_rules.judge(noise.encode(), packer)[5]


def test_the_rest_after_the_last_chunk_is_judged():
    packer = zstandard.ZstdCompressor(level=3)
    r = random.Random(4)
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randrange(2, 8))) for _ in range(400))[:1024]
    assert compression_rules.bands(prose.encode(), packer)[0] and compression_rules.bands(prose.encode(), packer)[3] == 1
    good, ratio, bad, chunks = compression_rules.bands((prose + "so la " * 170).encode(), packer)
    assert 0.25 <= ratio <= 0.80 and (good, bad, chunks) == (False, 1, 2)
    assert compression_rules.bands((prose + prose[::-1]).encode(), packer)[3] == 2 and compression_rules.bands(prose[:900].encode(), packer)[3] == 0


def test_keep_good_keeps_columns_and_rows(docs, corpus):
    df = docs(corpus, kept="clash", _rules=1)
    kept = compression_rules.keep_good(df)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[70] == 2 and ids[None] == 1 and not ids[60] and not ids[63]


def plain_base(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
            ",".join(sorted({label for _, label in hits})))


def test_license_base_places(docs, corpus):
    r = random.Random(3)
    vocabulary = "gnu general public license apache cc by mit the of GNU License CC é".split()
    rows = [x[:2] for x in corpus] + [(1000 + i, " ".join(r.choices(vocabulary, k=r.randrange(25)))) for i in range(400)]
    got = licenses.license_scan(docs(rows, n_words=1, labels="x")).collect()
    have = sorted(((x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in got), key=repr)
    assert have == sorted(((i, *plain_base(t)) for i, t in rows), key=repr)
    assert all(0 <= x["score"] <= 1 and set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(",")) for x in got)


@pytest.mark.parametrize("label", sorted(NOTICES))
def test_license_notices_are_found_when_edited(label):
    automaton = licenses.build()
    notice = NOTICES[label][0].split()
    notice[len(notice) // 2] = "otherwise"
    out = licenses.report((" ".join(["intro"] * 5 + notice + ["outro"] * 5)).encode(), automaton)
    assert label in out[5].split(",") and 0.5 <= out[6] <= 1
    assert licenses.report(" ".join(reversed(notice)).encode(), automaton)[5] == licenses.report(" ".join(reversed(notice)).encode(), automaton)[4]


def plain_cover(text: list[str], notice: list[str]) -> float:
    """Share of the notice's words that lie in four of its words in a row that stand in the text."""
    grams = {tuple(text[i:i + 4]) for i in range(len(text) - 3)}
    hit = set()
    for i in range(len(notice) - 3):
        if tuple(notice[i:i + 4]) in grams:
            hit |= set(range(i, i + 4))
    return len(hit) / len(notice)


@pytest.mark.parametrize("label", sorted(NOTICES))
def test_license_chains_keep_what_stands_there(label):
    automaton = licenses.build()
    split = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for number, raw in enumerate(NOTICES[label]):
        notice = split.findall(raw.translate(LOWER))
        half, foreign = len(notice) // 2, [f"zz{i}" for i in range(13)]
        variants = {
            "as it is": notice, "first words twice": notice[:5] + notice, "last words first": notice[-6:] + ["so"] + notice,
            "foreign words": notice[:half] + foreign + notice[half:], "moved": notice[half:] + ["and"] + notice[:half],
            "three edits": [w if i not in (7, half, len(notice) - 6) else "otherwise" for i, w in enumerate(notice)]}
        for name, words_ in variants.items():
            spans = [s for s in licenses.report(" ".join(["intro"] * 9 + words_ + ["outro"]).encode(), automaton)[7] if s["label"] == label]
            want = plain_cover(words_, notice)
            best = max((s["cover"] for s in spans), default=0.0)
            assert best >= want - 0.1 if want >= licenses.LEAST_COVER + 0.1 else True, (label, number, name, best, want)
        twice = licenses.report(" ".join(notice + ["then"] + notice).encode(), automaton)[7]
        whole = [s for s in twice if s["label"] == label and s["cover"] > 0.9]
        assert len(whole) >= 2, (label, number)
        far = notice[:half] + [f"zz{i}" for i in range(licenses.GAP + 5)] + notice[half:]
        assert max((s["cover"] for s in licenses.report(" ".join(far).encode(), automaton)[7] if s["label"] == label), default=0) < 0.8


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "What is the capital of the far province of Umber. It is the old town of Brenmoor by the lake."),
                                  (2, "Name seven rivers that cross the northern plain\nAlda Brine Corro Dunn Esk Farrow Glim"),
                                  (3, None), (4, ""), (5, "What is the capital of the far province of Umber. It is the old town of Brenmoor by the lake.")],
                                 "item_id long, text string")


def test_leaks_are_found_and_clean_texts_left(docs, items, corpus):
    first, second = (r["text"] for r in items.filter("item_id < 3").orderBy("item_id").collect())
    filler = "The lake and the town of the plain are what it is. " * 30
    rows = [x[:2] for x in corpus] + [(200, filler + first.upper() + filler), (201, second.replace(" ", "  ")), (202, filler),
                                      (203, first.replace("old", "new")), (204, first.split(".")[0]), (205, second + " " + filler + first)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(rows, item_id=9, score="x"), items).collect()}
    assert got == {(200, 1), (200, 5), (201, 2), (203, 1), (203, 5), (205, 1), (205, 2), (205, 5)}
    df = docs(rows, item_id=9, _leaks=1)
    clean = decontaminate.keep_clean(df, items)
    assert clean.columns == df.columns and clean.count() == len(rows) - 4
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), items).count() == 0


def test_one_word_edits_of_the_question_are_found(docs, items):
    texts = {i: r["text"] for i, r in enumerate(items.filter("item_id < 3").orderBy("item_id").collect(), 1)}
    rows, want = [], set()
    for i, text in texts.items():
        for k in range(10 if i == 1 else 8):
            for n, new in enumerate((["zebra"], [], ["zebra", text.split()[k]])):   # changed, left out, put in
                w = text.replace("\n", " \n ").split(" ")
                w[k:k + 1] = new + (["."] if i == 1 and k == 9 and not new else [])
                rows.append((1000 * i + 10 * k + n, "so it is " * 30 + " ".join(w) + " so it is" * 30))
                want.add((rows[-1][0], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(rows), items.filter("item_id < 3")).collect()}
    assert got == want
    r = random.Random(6)
    for _ in range(200):
        q, p = ([r.randrange(4) for _ in range(r.randrange(a, 9))] for a in (1, 0))
        edits = [[0] * (len(p) + 1)]
        for x in q:
            edits.append([edits[-1][0] + 1])
            for j, y in enumerate(p):
                edits[-1].append(min(edits[-2][j] + (x != y), edits[-2][j + 1] + 1, edits[-1][j] + 1))
        assert decontaminate.aligned(np.array(q), np.array(p, dtype=np.int64)) == 1 - min(edits[-1]) / len(q)


def test_items_are_told_apart_by_id_and_text(spark, docs, items, monkeypatch):
    first, second = (r["text"] for r in items.filter("item_id < 3").orderBy("item_id").collect())
    third = "Which bridge spans the narrow gorge near the village of Tarn. The iron bridge built by Holm and Vance stands there."
    table = spark.createDataFrame([(1, first), (1, first), (2, second), (2, third), (None, third), (None, third), (4, first)], items.schema)
    rows = [(200, "so " * 40 + first), (201, second), (202, third), (203, "so " * 40)]
    want = [(200, 1), (200, 4), (201, 2), (202, 2), (202, None)]
    for most in (decontaminate.MOST_WORDS, 20):
        monkeypatch.setattr(decontaminate, "MOST_WORDS", most)
        got = decontaminate.contaminated(docs(rows), table).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=repr) == sorted(want, key=repr)
        assert all(abs(r["score"] - 1) < 1e-9 for r in got)
        assert [r["doc_id"] for r in decontaminate.keep_clean(docs(rows), table).collect()] == [203]


def test_parts_of_the_index_and_wand_find_all(docs, items, monkeypatch):
    rows = [(i, r["text"]) for i, r in enumerate(items.filter("text <> ''").collect())]
    whole = sorted(map(tuple, decontaminate.contaminated(docs(rows), items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 20)
    assert sorted(map(tuple, decontaminate.contaminated(docs(rows), items).select("doc_id", "item_id").collect())) == whole
    r = random.Random(5)
    ids = [sorted(r.sample(range(60), r.randrange(1, 40))) for _ in range(30)]
    shares = [[r.random() / 4 for _ in own] for own in ids]
    index = decontaminate.Index(None, [None] * 60, ids, shares, [[max(s[k:k + decontaminate.BLOCK]) for k in range(0, len(s), decontaminate.BLOCK)]
                                                                  for s in shares], [max(s) for s in shares], None, None, 1)
    for _ in range(200):
        terms = r.sample(range(30), r.randrange(1, 20))
        sums = Counter()
        for t in terms:
            for i, s in zip(ids[t], shares[t]):
                sums[i] += s
        assert {i for i, _ in decontaminate.wand(terms, index, 0.8)} == {i for i, s in sums.items() if s >= 0.8}


def test_items_do_not_change_each_others_rows(docs, spark):
    """An item's passages depend on its own length: a very long item, or any other, changes no other row."""
    asked = " ".join(words(20, 1))
    answer = [f"a{i}" for i in range(10)]
    items = [(1, f"{asked}. {' '.join(answer)}"), (2, " ".join(words(30, 2)) + ". " + " ".join(words(12, 3))), (3, " ".join(words(9, 4)))]
    long = (9, " ".join(words(3500, 5)) + ". " + " ".join(words(500, 6)))
    filler = words(1800, 7, 3000)
    texts = [(1, f"{asked} {' '.join(filler)} {' '.join(reversed(answer))}"),        # the answer's words far away, in another order
             (2, f"{' '.join(filler)} {items[0][1]} {' '.join(filler)}"), (3, f"{' '.join(filler[:7])} {items[1][1]}"), (4, items[2][1]),
             (5, " ".join(filler) + " " + long[1] + " " + " ".join(filler))]

    def found(chosen):
        table = spark.createDataFrame(chosen, "item_id long, text string")
        return sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in decontaminate.contaminated(docs(texts), table).collect())

    everything = found([*items, long])
    assert [(d, i) for d, i, _ in everything] == [(2, 1), (3, 2), (4, 3), (5, 9)]
    for left_out in range(4):
        chosen = [x for k, x in enumerate([*items, long]) if k != left_out]
        assert found(chosen) == [r for r in everything if r[1] in {i for i, _ in chosen}]


def test_label_model_and_scorer(spark, docs, corpus):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in weak_labels.quality_scores(documents).collect()}
    right = [got[i]["kept"] == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.85 and all(got[i]["kept"] for i, q in labels.items() if q == 1)
    odd = weak_labels.quality_scores(docs(corpus, votes=1, score="x"))
    assert len(odd.collect()) == len(corpus) and not [r for r in odd.collect() if r["doc_id"] in (60, 61, 62) and r["kept"]]
    assert weak_labels.quality_scores(docs([])).count() == 0
