"""Benchmark decontamination: a broadcast set of normalised n-grams, scanned over training texts and verified.

Words are maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. Every ``n`` consecutive words of a
benchmark item are a window; an item of fewer words, but not none, is one window. A text's words become numbers of the
benchmark's vocabulary; stretches of known words as long as a window are hashed and looked up in the sorted
hashes, and a hit counts only if all words are equal.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import of_worker, staged, text_or_empty

#: Benchmark text that one index holds; a larger benchmark is scanned in as many passes over the documents as it takes. A block
#: of this size of random words takes INDEX_PEAK bytes at most to build (tested).
INDEX_BYTES, INDEX_PEAK = 16 << 20, 400 << 20
#: Windows hashed in one go.
CHUNK = 1 << 18
STATE = "n_words long, starts array<int>, ends array<int>, items array<string>"


class WindowIndex:
    """Windows of a block of benchmark items, in arrays.

    ``ids`` are the word numbers of all items, one after another. Per window length there are the sorted hashes of the distinct windows,
    where in ``ids`` each stands, and the numbers of the items that hold it, as one array with offsets.
    """

    def __init__(self, vocabulary: dict[bytes, int], items: list[str], ids: np.ndarray, lengths: dict[int, tuple]):
        self.vocabulary, self.items, self.ids, self.lengths = vocabulary, items, ids, lengths

    @classmethod
    def of(cls, items: Iterable[tuple[str, bytes]], n: int) -> WindowIndex:
        words = re.compile(rb"[0-9a-z\x80-\xff]+").finditer
        vocabulary: dict[bytes, int] = {}
        number: dict[str, int] = {}
        ids, begins, holders = array("i"), array("q"), array("i")
        for name, text in items:
            at = len(ids)
            ids.extend(vocabulary.setdefault(w.group(), len(vocabulary)) for w in words(text.lower()))
            if len(ids) > at:
                begins.append(at)
                holders.append(number.setdefault(name, len(number)))
        ids, begins, holders = np.frombuffer(ids, np.int32), np.frombuffer(begins, np.int64), np.frombuffer(holders, np.int32)
        sizes = np.diff(np.append(begins, len(ids)))
        lengths = {}
        for size in np.unique(np.minimum(sizes, n)):
            own = np.flatnonzero(np.minimum(sizes, n) == size)
            count = sizes[own] - size + 1
            # Each item's window starts: consecutive places from its first word on.
            starts = np.repeat(begins[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            lengths[int(size)] = cls._grouped(ids, starts, np.repeat(holders[own], count), int(size))
        return cls(vocabulary, list(number), ids, lengths)

    @classmethod
    def _grouped(cls, ids: np.ndarray, starts: np.ndarray, holders: np.ndarray, size: int) -> tuple:
        hashes = np.concatenate([cls.hashed(ids, starts[i : i + CHUNK], size) for i in range(0, len(starts), CHUNK)])
        order = np.lexsort((holders, hashes))
        hashes, starts, holders = hashes[order], starts[order], holders[order]
        same = hashes[1:] == hashes[:-1]
        for k in range(size):  # a window is the same as the one before it only if all words are
            at = np.flatnonzero(same)
            same[at] = ids[starts[at + 1] + k] == ids[starts[at] + k]
        fresh = np.concatenate([[True], ~same])
        use = np.concatenate([[True], ~same | (holders[1:] != holders[:-1])])
        offsets = np.append(np.flatnonzero(fresh[use]), use.sum())
        return hashes[fresh], starts[fresh], offsets, holders[use]

    @staticmethod
    def hashed(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for k in range(size):
            out = (out ^ ids[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of the windows that occur, and the items that hold them."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        ranges, hit = [], []
        for size, (hashes, starts, _, _) in self.lengths.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = self.hashed(ids, at, size)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(low < high):
                for w in range(low[i], high[i]):  # equal hashes: verify the words
                    if (self.ids[starts[w] : starts[w] + size] == ids[at[i] : at[i] + size]).all():
                        ranges.append((int(at[i]), int(at[i]) + size))
                        hit.append((size, int(w)))
                        break
        found: set[int] = set()
        for size, w in set(hit):
            _, _, offsets, holders = self.lengths[size]
            found.update(holders[offsets[w] : offsets[w + 1]].tolist())
        return ranges, {self.items[k] for k in found}


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _scan(df: DataFrame, items: DataFrame, n: int, text: str) -> DataFrame:
    """``df`` with its column __state extended by the hits of ``items``."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), text_or_empty("text").cast("binary").alias("data")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(vars(WindowIndex.of(((name.as_py(), data.as_py()) for name, data in zip(rows["name"], rows["data"])), n)))

    @F.pandas_udf(STATE)
    def scanned(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        split, index = re.compile(rb"[0-9a-z\x80-\xff]+").findall, of_worker(shared, lambda held: WindowIndex(held["vocabulary"], held["items"], held["ids"], held["lengths"]))
        for texts, states in batches:
            out = []
            for data, starts, ends, items in zip(texts, states["starts"], states["ends"], states["items"]):
                words = split(data.lower())
                ranges, hit = index.scan(words)
                whole = merged(ranges + list(zip(starts, ends)))
                out.append((len(words), [int(r[0]) for r in whole], [int(r[1]) for r in whole], sorted(hit | set(items))))
            yield pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    return df.withColumn("__state", scanned(text_or_empty(text).cast("binary"), F.col("__state")))


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, text: str) -> DataFrame:
    """``docs`` with the column __state of :data:`STATE`."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // INDEX_BYTES
    none = F.struct(F.lit(0).cast("long").alias("n_words"), *[F.array().cast("array<int>").alias(c) for c in ("starts", "ends")], F.array().cast("array<string>").alias("items"))
    out = docs.withColumn("__state", none)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        out = _scan(out, part, n, text)
        if blocks > 1:
            out = staged(out, "scanned-documents")
    return out


def _n_hit() -> Column:
    return F.aggregate(F.zip_with("__state.ends", "__state.starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated(share: int) -> Column:
    return (_n_hit() > 0) & (share * _n_hit() >= F.col("__state.n_words"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, hit_starts, hit_ends, hit_items, contaminated; columns of these names are replaced.

    A word inside any occurrence of a window is hit; hit_starts and hit_ends are the merged word ranges. A text is contaminated if
    it has hits and ``share`` * n_hit >= n_words. ``benchmark`` has item_id and text; items of one id are one item, a
    null id is named "null", null texts have no words. No document is moved between tasks.

    The benchmark is measured first: within ``INDEX_BYTES`` one index is broadcast. A larger one is cut by hash into
    blocks of about that size; each block is scanned over all documents in turn, the documents being written in
    between, and ranges and items add up to the same result.
    """
    result = {
        "n_words": F.col("__state.n_words"), "n_hit": _n_hit(), "n_items": F.size("__state.items").cast("long"),
        "hit_starts": F.col("__state.starts"), "hit_ends": F.col("__state.ends"), "hit_items": F.col("__state.items"), "contaminated": _contaminated(share),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in result]
    return _scanned(docs, benchmark, n, text).select(*kept, *[c.alias(name) for name, c in result.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, columns as they were."""
    return _scanned(docs, benchmark, n, text).where(~_contaminated(share)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", out: str = "text") -> DataFrame:
    """Documents with every hit word range, from its first word's start to its last word's end, cut out of ``text``; contaminated or not."""
    marked = _scanned(docs, benchmark, n, text)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        words, result = re.compile(rb"[0-9A-Za-z\x80-\xff]+").finditer, []
        for data, first, last in zip(texts, starts, ends):
            if not len(first):
                result.append(data.decode())
                continue
            at = [m.span() for m in words(data)]
            pieces, done = [], 0
            for s, e in zip(first, last):
                pieces.append(data[done : at[s][0]])
                done = at[e - 1][1]
            result.append(b"".join([*pieces, data[done:]]).decode())
        return pd.Series(result, dtype=object)

    rest = cut(text_or_empty(text).cast("binary"), F.col("__state.starts"), F.col("__state.ends"))
    return marked.withColumn(out, F.when(F.size("__state.starts") > 0, rest).otherwise(F.col(f"`{text}`"))).drop("__state")
