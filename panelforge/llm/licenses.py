"""License scans: fuzzy search for short notices by exact seeds and bounded-error verification.

A notice is a phrase with an error budget k. By the pigeonhole principle, of k + 1 pieces of the phrase one must stand unharmed
in any match with at most k edits. The pieces of all notices are looked for at once (an Aho-Corasick automaton); each hit
locates a short candidate window, and the bounded-error matching of the ``regex`` library verifies the edits in it.
A notice without errors is one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import of_worker, text_or_empty

#: Phrases without errors, as the query's contract fixes them: phrase, label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Notices that may differ by some edits (insertions, deletions, substitutions of characters): phrase, label, edits.
NOTICES = [
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version", "apache", 4),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("bsd 3 clause license", "bsd", 1),
    ("bsd 2 clause license", "bsd", 1),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("licensed under cc by", "cc-by", 1),
    ("creative commons attribution", "cc-by", 2),
    ("boost software license version", "boost", 2),
    ("all rights reserved", "proprietary", 1),
    ("spdx license identifier", "spdx", 2),
]

#: Windows that a worker remembers: passages repeated over many texts are verified once.
CACHE_WINDOWS = 100_000
CUT = "\x01"
FOUND = "n_words long, spans array<struct<label: string, start: int, end: int, word: int, edits: int, size: int, base: boolean>>"
WORD = rb"[0-9a-z\x80-\xff]+"


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length with their places."""
    cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeScanner:
    """Finds notices in texts of lower-cased words joined by single spaces; one in every worker."""

    def __init__(self, notices: list[tuple[str, str, int, bool]]):
        self.notices = notices
        for phrase, _, errors, _ in notices:
            if not phrase or phrase != b" ".join(re.findall(WORD, phrase.lower().encode())).decode():
                raise ValueError(f"a phrase is words in lower case, one space between them: {phrase!r}")
            if min(len(p) for _, p in pieces(phrase, errors)) < 1:
                raise ValueError(f"{errors} edits leave no seeds of {phrase!r}")
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, _, errors, _) in enumerate(notices):
            for at, piece in pieces(phrase, errors):
                found.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, users in found.items():
            self.seeds.add_word(piece, (len(piece), users))
        self.seeds.make_automaton()
        # A whole number of words: the match starts after a space or the start and ends before a space or the end. A budget of
        # errors wants the best match (b) of a window.
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(p)}){{e<={e}}}(?![^ ])" if e else rf"(?<![^ ]){regex.escape(p)}(?![^ ])") for p, _, e, _ in notices]
        self.verified = lru_cache(CACHE_WINDOWS)(self._verified)

    def _verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match in a window."""
        m = self.patterns[k].search(window)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """Notice, start, end and edits of each match; overlapping matches of one notice with errors are one, the one of fewest edits."""
        wanted: dict[int, set[int]] = {}
        for last, (size, users) in self.seeds.iter(text):
            for k, at in users:
                wanted.setdefault(k, set()).add(last + 1 - size - at)
        out = []
        for k, places in wanted.items():
            phrase, _, errors, _ = self.notices[k]
            hits: dict[tuple[int, int], int] = {}
            for place in places:  # where the phrase would start if only what precedes the seed were unharmed
                # A word that the window cuts must not look whole: it goes on with more characters than the budget can take up.
                low, high = max(0, place - errors), min(len(text), place + len(phrase) + errors)
                before, after = [CUT * (errors + 1) if 0 < at < len(text) and " " not in text[at - 1 : at + 1] else "" for at in (low, high)]
                if m := self.verified(k, before + text[low:high] + after):
                    hits[m[0] + low - len(before), m[1] + low - len(before)] = m[2]
            taken: list[tuple[int, int]] = []
            for (start, end), edits in sorted(hits.items(), key=lambda h: (h[1], h[0])) if errors else sorted(hits.items()):
                if not errors or all(end <= a or b <= start for a, b in taken):
                    taken.append((start, end))
                    out.append((k, start, end, edits))
        return sorted(out, key=lambda h: (h[1], h[0], h[2]))


def _placed(text: bytes, words: list[bytes], hits: list[tuple[int, int, int, int]], notices: list) -> list[tuple]:
    """Matches as places in the text (code points, end exclusive) and the number of their first word."""
    lengths = [len(w.decode()) for w in words]
    marks = sorted({h[1] for h in hits} | {h[2] for h in hits})
    word_of, at, i = {}, 0, 0
    for mark in marks:  # the word that starts, or ends, at each mark of the joined text
        while i < len(words) and at + lengths[i] < mark:
            at += lengths[i] + 1
            i += 1
        word_of[mark] = i
    needed, bounds, chars, done = set(word_of.values()), {}, 0, 0
    for i, m in enumerate(re.finditer(WORD, text)):
        if i in needed:
            chars += len(text[done : m.start()].decode())
            end = chars + len(m.group().decode())
            bounds[i] = (chars, end)
            chars, done = end, m.end()
    return [(notices[k][1], bounds[word_of[s]][0], bounds[word_of[e]][1], word_of[s], edits, len(notices[k][0]), notices[k][3]) for k, s, e, edits in hits]


def _scanned(docs: DataFrame, base: list[tuple[str, str]], notices: list[tuple[str, str, int]], text: str) -> Column:
    rows = [(p, label, 0, True) for p, label in base] + [(p, label, e, False) for p, label, e in notices]
    NoticeScanner(rows)  # a bad phrase is an error here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast({"notices": rows})

    @F.pandas_udf(FOUND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner, split = of_worker(shared, lambda held: NoticeScanner(held["notices"])), re.compile(WORD).findall
        for texts in batches:
            sizes, spans = [], []
            for data in texts:
                low = data.lower()
                words = split(low)
                hits = scanner.scan(b" ".join(words).decode())
                sizes.append(len(words))
                spans.append([dict(zip(("label", "start", "end", "word", "edits", "size", "base"), s)) for s in _placed(low, words, hits, scanner.notices)] if hits else [])
            yield pd.DataFrame({"n_words": sizes, "spans": spans})

    return scanned(text_or_empty(text).cast("binary"))


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str, int]] = NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with n_words, spans, labels, score; columns of these names are replaced.

    Words are maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII; a text is searched as its words
    joined by single spaces, so separators never count as edits. ``spans`` are structs (label, start, end in code points, end
    exclusive, word: number of the first word, edits, size: characters of the phrase, base) by start: every place where the words
    of a ``base`` phrase stand consecutively, also overlapping ones, and for a notice (phrase, label, edits) the matches
    of whole words within its edits, of overlapping ones the one with fewest edits. ``labels`` are those of all spans, distinct
    and sorted. ``score`` is the best share of a phrase that stands unharmed, 1 - edits / size, and 0 without a span. Null texts are
    empty, empty texts have no words; repeated rows are scanned each. No row is moved, the phrases are the caller's few.
    """
    best = F.aggregate("__found.spans", F.lit(0.0), lambda s, x: F.greatest(s, 1 - x["edits"] / x["size"]))
    result = {"n_words": F.col("__found.n_words"), "spans": F.col("__found.spans"), "labels": F.array_sort(F.array_distinct("__found.spans.label")), "score": best}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in result or c == text]
    out = docs.withColumn("__found", _scanned(docs, base, notices, text))
    return out.select(*[c for c in kept], *[c.alias(n) for n, c in result.items() if n != text])
