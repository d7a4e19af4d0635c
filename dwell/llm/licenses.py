"""License scans (4): generalised suffix automaton of licence tokens.

All templates (base phrases and notice texts, as word sequences) go into one suffix automaton. A
text's words are streamed through it; at each word the automaton knows the longest stretch ending
there that stands in a template (matching statistics) and which templates hold it. A base phrase is
found where it is a suffix of that stretch. Long stretches that can't be prolonged are chained per
template in the order of the text: each goes to the open chain, of several, where it covers the most new
words of the template, so stray repeats, foreign words and moved sentences cost a chain nothing, and a
second copy starts a chain of its own. A chain is a span with the share of the template's words it covers.
Words in no template reset the automaton, so only runs of template words are streamed.

One map over the documents, no shuffle. The automaton is bounded by ``MOST_TEMPLATE_WORDS``; memory
by the longest text.

Defined results: a null or empty text has no words, no places (nulls), empty labels and score 0; a
template repeated in a text counts at each place; repeated rows are scanned alike; an empty table
gives no rows; further columns never matter.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import words
from dwell.llm.license_templates import NOTICES, PHRASES

LEAST_MATCH = 4        # words of a stretch that may enter a chain
GAP = 40               # foreign words of text that a chain may leave out between two stretches
LEAST_COVER = 0.5      # share of a notice that gives its label
MOST_TEMPLATE_WORDS = 100_000

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,cover:double>>")


class Template(NamedTuple):
    label: str
    length: int
    phrase: bool


class Automaton(NamedTuple):
    codes: np.ndarray          # sorted word hashes
    steps: list[dict[int, int]]
    longest: list[int]
    link: list[int]
    ends: list[list[tuple[int, int]]]   # (template, index of last word) of a state's stretches
    phrases: list[list[int]]            # phrases that are suffixes of a state's longest stretch
    templates: list[Template]


def hashes(raw: bytes | None) -> np.ndarray:
    b = words.as_bytes(raw, lower=True)
    return words.word_hashes(b, *words.bounds(b, words.ALNUM))


def build(phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES) -> Automaton:
    texts = [(label, p, True) for p, label in phrases.items()] + [(label, t, False) for label, ts in notices.items() for t in ts]
    coded = [hashes(t.encode()) for _, t, _ in texts]
    if sum(map(len, coded)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words")
    codes = np.unique(np.concatenate(coded))
    templates = [Template(label, len(c), phrase) for (label, _, phrase), c in zip(texts, coded)]
    steps: list[dict[int, int]] = [{}]
    longest, link, ends = [0], [-1], [[]]

    def state(length: int, moves: dict[int, int], suffix: int) -> int:
        steps.append(moves)
        longest.append(length)
        link.append(suffix)
        ends.append([])
        return len(steps) - 1

    def split(p: int, c: int, q: int) -> int:
        """The state for the stretch of ``p`` with ``c``, taken out of ``q`` if ``q`` holds longer ones."""
        if longest[p] + 1 == longest[q]:
            return q
        twin = state(longest[p] + 1, dict(steps[q]), link[q])
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = twin
            p = link[p]
        link[q] = twin
        return twin

    for t, sequence in enumerate(coded):
        last = 0
        for at, c in enumerate(np.searchsorted(codes, sequence).tolist()):
            if c in steps[last]:
                last = split(last, c, steps[last][c])
            else:
                p, last = last, state(longest[last] + 1, {}, 0)
                while p >= 0 and c not in steps[p]:
                    steps[p][c] = last
                    p = link[p]
                if p >= 0:
                    link[last] = split(p, c, steps[p][c])
            ends[last].append((t, at))
    found: list[list[int]] = [[] for _ in steps]
    for s in sorted(range(1, len(steps)), key=longest.__getitem__, reverse=True):
        ends[link[s]].extend(ends[s])
    for s in sorted(range(1, len(steps)), key=longest.__getitem__):
        own = [t for t, at in ends[s] if templates[t].phrase and at + 1 == templates[t].length
               and longest[link[s]] < templates[t].length <= longest[s]]
        found[s] = found[link[s]] + own
    return Automaton(codes, steps, longest, link, ends, found, templates)


class Chain:
    """Matches of one template that follow each other in the text, and the template's words they cover."""

    def __init__(self, template: int, first: int):
        self.template, self.first, self.last, self.mask, self.template_end = template, first, first, 0, -1

    @property
    def covered(self) -> int:
        return self.mask.bit_count()

    def gain(self, begin: int, length: int) -> int:
        """Words of the template that a match at ``begin`` would add."""
        return (((1 << length) - 1 << begin) & ~self.mask).bit_count()

    def add(self, start: int, end: int, begin: int, length: int) -> None:
        self.first, self.last = min(self.first, start), max(self.last, end)
        self.mask |= (1 << length) - 1 << begin
        self.template_end = begin + length - 1


class Hits(NamedTuple):
    places: list[tuple[int, int]]   # (phrase, first word)
    chains: list[Chain]


def scan(h: np.ndarray, automaton: Automaton) -> Hits:
    steps, longest, link, ends, phrases = automaton.steps, automaton.longest, automaton.link, automaton.ends, automaton.phrases
    at = np.minimum(np.searchsorted(automaton.codes, h), len(automaton.codes) - 1)
    known = automaton.codes[at] == h
    edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
    places: list[tuple[int, int]] = []
    done: list[Chain] = []
    open_chains: dict[int, list[Chain]] = {}

    def stretch(end: int, length: int, s: int) -> None:
        """A longest match goes to the open chain, and to the place in its template, where it adds the most
        words; one that would add less than half of its words begins a chain (another copy)."""
        start = end - length + 1
        begins: dict[int, list[int]] = {}
        for t, e in ends[s]:
            if not automaton.templates[t].phrase:
                begins.setdefault(t, []).append(e - length + 1)
        for t, own in begins.items():
            chains = open_chains.setdefault(t, [])
            done.extend(c for c in chains if start - c.last > GAP + 1)
            chains[:] = [c for c in chains if start - c.last <= GAP + 1]
            # ties: the chain that covers more, then the place next to its last one
            choices = [(c.gain(b, length), c.covered, -abs(b - c.template_end - 1), -k, b) for k, c in enumerate(chains) for b in own]
            best = max(choices, default=(0, 0, 0, 0, 0))
            if 2 * best[0] >= length:
                chains[-best[3]].add(start, end, best[4], length)
            else:
                chains.append(Chain(t, start))
                chains[-1].add(start, end, min(own), length)

    for begin, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if stop - begin < 2:
            continue
        s = length = 0
        for i, c in enumerate(at[begin:stop].tolist(), begin):
            if length >= LEAST_MATCH and c not in steps[s]:
                stretch(i - 1, length, s)
            while s and c not in steps[s]:
                s = link[s]
                length = longest[s]
            if c in steps[s]:
                s = steps[s][c]
                length += 1
            for t in phrases[s] if length == longest[s] else phrases_within(automaton, s, length):
                places.append((t, i - automaton.templates[t].length + 1))
        if length >= LEAST_MATCH:
            stretch(stop - 1, length, s)
    return Hits(places, done + [c for chains in open_chains.values() for c in chains])


def phrases_within(automaton: Automaton, s: int, length: int) -> list[int]:
    return [t for t in automaton.phrases[s] if automaton.templates[t].length <= length]


def report(raw: bytes | None, automaton: Automaton) -> tuple:
    h = hashes(raw)
    hits = scan(h, automaton)
    templates = automaton.templates
    base = {templates[t].label for t, _ in hits.places}
    spans = [(templates[c.template].label, c.first, c.last, c.covered / templates[c.template].length) for c in hits.chains]
    spans = sorted(x for x in spans if x[3] >= LEAST_COVER)
    labels = base | {x[0] for x in spans}
    score = 1.0 if base else max((c.covered / templates[c.template].length for c in hits.chains), default=0.0)
    starts = [start for _, start in hits.places]
    return (len(h), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), min(1.0, score), [dict(zip(("label", "first_word", "last_word", "cover"), x)) for x in spans])


def found(text: Column) -> Column:
    automaton = build()

    @F.pandas_udf(SCHEMA)
    def licenses(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for part in parts:
            out = pd.DataFrame([report(raw, automaton) for raw in part], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})
    return licenses(text.cast("binary"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the columns of ``SCHEMA``."""
    return docs.select(F.col(id_col), found(F.col(text_col)).alias("_found")).select(F.col(id_col), "_found.*")
