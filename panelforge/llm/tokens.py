"""Token counts by byte-pair merging over a heap and a linked list; no token ids are produced.

The vocabulary file is one of the public ``tokenizers`` JSON files with a byte-level BPE model. A word starts
as one symbol per UTF-8 byte (the last one marked as the word's end). The adjacent pair of lowest merge rank,
leftmost first, is popped from a heap; the two symbols become one and the pairs with its new neighbours are
pushed. Stale heap entries are recognised by the symbols they name. The count of a word is its initial symbols
minus its merges, so a word of n bytes costs O(n log n) whatever its length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import of_worker, text_or_empty

#: Words kept per Python worker with their counts; a full table is emptied, which costs time and no result.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed table)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Counts tokens of words; a dict of the words seen so far, one in every worker."""

    def __init__(self, spec: dict):
        super().__init__()
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a byte-level BPE vocabulary is needed")
        end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(s, -1) for s in symbols]
        self.last = [vocab.get(s + end, -1) for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = splits[0].replace(r"\s", r"\p{White_Space}")
        # Added tokens that are looked for in the raw text; each occurrence is one token.
        self.added = "|".join(regex.escape(t["content"]) for t in spec["added_tokens"])

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.merged(word.encode("utf-8", "surrogatepass"))
        return n

    def merged(self, data: bytes) -> int:
        """Tokens of one word given as bytes."""
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        ids = [i for i in ids if i >= 0]  # a byte outside the vocabulary is no symbol
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        heap = [(*m, p, ids[p], ids[p + 1]) for p in range(n - 1) if (m := merges.get((ids[p], ids[p + 1])))]
        heapify(heap)
        # Entries sort by (rank, ..): one rank names one pair, so position decides among equals.
        done = 0
        while heap:
            _, new, p, left, right = heappop(heap)
            q = after[p]
            if ids[p] != left or q >= n or ids[q] != right:
                continue  # one of the two has been merged meanwhile
            ids[p], ids[q] = new, -1
            after[p] = r = after[q]
            done += 1
            if r < n:
                before[r] = p
                if m := merges.get((new, ids[r])):
                    heappush(heap, (*m, p, new, ids[r]))
            o = before[p]
            if o >= 0 and (m := merges.get((ids[o], new))):
                heappush(heap, (*m, o, ids[o], new))
        return n - done

    def counter(self):
        """A function from a text to its number of tokens."""
        words, added = regex.compile(self.words).findall, regex.compile(self.added)
        one = self.__getitem__

        def count(text: str) -> int:
            total, parts = 0, [text]
            if self.added and "<" in text:
                parts = added.split(text)
                total = len(parts) - 1
            for part in parts:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final-sigma rule
                total += sum(map(one, words(part.lower())))
            return total

        return count


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in ``out``; a column of that name is replaced.

    The file at ``tokenizer_path`` is read on the driver (a vocabulary of fixed size, some MB) and broadcast, so
    executors need no copy. Null and empty texts have no tokens. No row is moved: the count is one
    projection, and a word that a worker has counted before costs a look-up.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"spec": json.load(f)})

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = of_worker(shared, lambda held: MergeCounter(held["spec"])).counter()
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return docs.withColumn(out, counted(text_or_empty(text)))
