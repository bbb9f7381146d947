"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming distance by pigeonring filtering.

The 64 bits form a ring of 8 segments. If two fingerprints differ in at most 3 bits, some segment of the ring starts a
chain whose first l segments differ in at most floor(3 l / 8) bits for every l = 1..8, that is 0, 0, 1, 1, 1, 2, 2, 3.
So the first two segments are equal and at least two of the next three are: for each of the 8 starts and 3 choices
these 32 bits are an exact key, and every linked pair shares one of the 24 keys. Pairs that share a key must pass the whole
chain before their full distance is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import staged, text_or_empty
from panelforge.llm.components import connected_components
from panelforge.llm.runs import gathered, local_roots, runs, spread_hot_groups

SEGMENTS, WIDTH, DISTANCE = 8, 8, 3
#: Fingerprints compared in one go; groups beyond it are dealt out in pairs of parts.
CHUNK = 1024
SEED = 42


def fingerprint_of(data: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half of the shingles' hashes have it; no words give 0."""
    parts = data.lower().split()
    n = len(parts)
    if n > words:
        shingles = zip(*(parts[i:] for i in range(words)))
        digests = [xxhash.xxh64_digest(b" ".join(s), SEED) for s in shingles]
    elif n:
        digests = [xxhash.xxh64_digest(b" ".join(parts), SEED)]
    else:
        return 0
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(digests), 65536):
        part = np.frombuffer(b"".join(digests[i : i + 65536]), dtype=np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * set_bits > len(digests)).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of the whole ``text`` as a long; null and wordless texts have 0."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(text_or_empty(text).cast("binary")))


def _segment(i: int) -> Column:
    shift = WIDTH * (i % SEGMENTS)
    return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys() -> Column:
    """The 24 keys: start and choice in the upper half, the four equal segments in the lower."""
    out = []
    for start in range(SEGMENTS):
        for c, differing in enumerate((2, 3, 4)):
            equal = [start + i for i in range(5) if i != differing]
            bits = F.lit(0).cast("long")
            for place, i in enumerate(equal):
                bits = bits.bitwiseOR(F.shiftleft(_segment(i), WIDTH * place))
            out.append(F.lit((3 * start + c) << 32).cast("long").bitwiseOR(bits))
    return F.array(*out)


def chain_passes(diff: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which XORed pairs keep every prefix of the chain from segment ``start`` within its share of the distance.

    The key has settled the first five segments but for one bit; each further test runs on what the last one left, and
    the prefix of all eight segments is the full Hamming check.
    """
    turn = np.asarray(start, dtype=np.uint64) * np.uint64(WIDTH)
    ring = (diff >> turn) | (diff << ((np.uint64(64) - turn) % np.uint64(64)))
    ok = np.ones(diff.shape, dtype=bool)
    for length in range(5, SEGMENTS + 1):
        mask = np.uint64((1 << (WIDTH * length)) - 1)
        left = np.flatnonzero(ok)
        ok.flat[left] = np.bitwise_count(ring.flat[left] & mask) <= DISTANCE * length // SEGMENTS
    return ok


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group reduced to a forest: every node with the lowest node of its part of the group."""
    for t, starts, ends in runs(batches, ["key", "part_a", "part_b"]):
        fps = t.column("fp").to_numpy().view(np.uint64)
        first = (t.column("key").to_numpy() >> 32) // 3
        two = ends - starts == 2
        s = starts[two]
        s = s[chain_passes(fps[s] ^ fps[s + 1], first[s])]
        src, dst = [fps[s]], [fps[s + 1]]
        for b, e in zip(starts[~two], ends[~two]):
            group = fps[b:e]
            root = local_roots(chain_passes(group[:, None] ^ group[None, :], int(first[b])))
            moved = root != np.arange(len(group))
            src.append(group[moved])
            dst.append(group[root[moved]])
        cols = [pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)]
        yield pa.RecordBatch.from_arrays(cols, ["src", "dst"])


def link_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """node, root of every fingerprint (column ``fp``, distinct) that has a partner within the distance."""
    keyed = fingerprints.select("fp", F.explode(_keys()).alias("key"))
    dealt = spread_hot_groups(keyed, ["key"], F.xxhash64("fp"), CHUNK)
    links = gathered(dealt, ["key", "part_a", "part_b"]).mapInArrow(_forest, "src long, dst long")
    return connected_components(links)


def _marks(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, hash of the text, fingerprint: all that the rest of the work needs of a document."""
    marked = add_fingerprints(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("t")), "t", "fp", words)
    return staged(marked.select("doc_id", F.xxhash64("t").alias("text_hash"), "fp"), "fingerprints")


def _first_of_components(marks: DataFrame) -> DataFrame:
    """fp, first: for every fingerprint the first document of its component (smallest doc_id, null last, then text hash)."""
    document = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "fp")
    nodes = staged(marks.groupBy("fp").agg(F.min(document).alias("first")), "fingerprint-nodes")
    roots = link_fingerprints(nodes.select("fp")).withColumnRenamed("node", "fp")
    nodes = staged(nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    firsts = nodes.groupBy("root").agg(F.min("first").alias("first"))
    return nodes.select("fp", "root").join(firsts, "root").select("fp", "first")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links lead to).

    Null and wordless texts have fingerprint zero and link like any other. Equal fingerprints are one node, so copies cost
    nothing beyond their own row. Rows without a doc_id take part and get the smallest id of their component, null if
    it has none. Texts are read once and never shuffled.
    """
    marks = _marks(docs, doc_id, text, words)
    named = marks.join(_first_of_components(marks), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with one row per component, all columns kept: the first by doc_id (null last); of repeated rows one stays."""
    firsts = _first_of_components(_marks(docs, doc_id, text, words))
    kept = staged(firsts.select("first.doc_id", "first.text_hash").distinct().withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), "kept-documents")
    keyed = docs.withColumn("__hash_of", F.xxhash64(text_or_empty(text)))
    out = keyed.join(kept, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash_of") == F.col("__hash")), "left_semi")
    return out.dropDuplicates([doc_id, "__hash_of"]).drop("__hash_of")
