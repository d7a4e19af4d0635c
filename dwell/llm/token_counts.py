"""Token counts (1): whole-token shortcut.

SentencePiece turns a text into ▁-marked characters and merges neighbours. Facts about a
model are proved offline, on the driver, before anything is counted (``prove``):

* its normaliser only writes ▁ for each space and one ▁ in front, on every code point;
* no piece has ▁ behind another character, so no merge crosses the place before a run of ▁ and the
  pre-tokens (a run of ▁ with what follows it) are merged independently of each other;
* no piece holds a line feed (it becomes a byte token), so that lines are merged on their own too;
* which ▁-pieces the library itself encodes as one token.

A text's count is then the sum over its pre-tokens: proven whole tokens count 1 by lookup, the rest
are merged by the library, once per task and distinct pre-token (a bounded memo). One map over the
documents, no shuffle; whole texts are counted, memory is bounded by the longest.

Defined results: null and empty texts have 0 tokens; no begin, end or special tokens are added, and
their strings inside a text are ordinary text; repeated rows are counted alike; an empty table gives
no rows; further columns never matter.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from typing import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LIMIT = 4096
MEMO = 300_000      # merged pre-tokens that a task remembers before it starts anew
BLOCK = 1_000_000   # characters of text split at a time


def processor(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> list[str]:
    """Pre-tokens (without their first ▁) that encode alone as one token; an error if a fact fails."""
    sp = processor(model)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    # rules of several code points: composition; spaces at both ends and in runs: their removal
    apart = (unicodedata.normalize(form, c) for c in every for form in ("NFD", "NFKD"))
    composed = " ".join(sorted({c for c in apart if len(c) > 1}))
    for probe in (every, composed, "  a  b  ", " ", "a \n b", "\n\n "):
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model's normaliser changes more than spaces")
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or MARK not in pieces:
        raise ValueError("a piece crosses the start of a pre-token")
    if any("\n" in p for p in pieces) or len(sp.encode("\n")) != 2:
        raise ValueError("a line feed is not a token of its own")
    alone = [p[1:] for p in pieces if re.fullmatch(f"{MARK}[^{MARK}]+", p)]
    return [w for w, ids in zip(alone, sp.encode(alone)) if len(ids) == 1]


def pre_tokens(text: str | None) -> list[str]:
    """A pre-token is given without its first ▁ and with later ▁ as spaces; what follows a line feed
    without ▁ is given with the line feed."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " ":
        marked = MARK + text.replace(" ", MARK)
        found = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*", marked)
        return [p if p[0] == "\n" else p[1:].replace(MARK, " ") for p in found]
    return text.replace("\n", " \n").split(" ")


class Counts(dict):
    """Tokens by pre-token: the proven ones, and a bounded memo of merged ones."""

    def __init__(self, sp, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self[""] = 1  # ▁ alone
        self.encode, self.proven = sp.encode, frozenset(self)

    def learn(self, wanted: set[str]) -> None:
        """Merge what is not known yet, in one call. In front of a line feed the library puts a ▁."""
        if len(self) > len(self.proven) + MEMO:
            for word in [w for w in self if w not in self.proven]:
                del self[word]
        new = [w for w in wanted if w not in self]
        self.update((w, len(ids) - (w[0] == "\n")) for w, ids in zip(new, self.encode(new, num_threads=1)))


def count(texts: Iterable[str | None], counts: Counts) -> list[int]:
    split = [pre_tokens(t) for t in texts]
    counts.learn(set().union(*split))
    return [sum(map(counts.__getitem__, words)) for words in split]


def blocks(texts: Iterable[str | None], most: int = BLOCK) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``most`` characters together."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= most:
            yield block
            block, size = [], 0
    yield block


def n_tokens(text: Column, model: bytes) -> Column:
    whole = prove(model)  # bounded by the vocabulary

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(processor(model), whole)
        for part in parts:
            yield pd.Series([n for block in blocks(part) for n in count(block, counts)], dtype="int64")
    return tokens(text)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit. ``model_path``: a
    SentencePiece model that the driver can read; it travels to the tasks with the function."""
    with open(model_path, "rb") as file:
        model = file.read()
    text = F.col(text_col)
    counted = docs.select(F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                          n_tokens(text, model).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
