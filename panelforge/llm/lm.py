"""Language-model scores by masked pseudo-likelihood.

A small network sees the words on both sides of a position and predicts the word that is masked there. The sum of the logarithms
of these conditional probabilities over all positions of a document is its score. All words of all documents are counted. The vocabulary
holds the most frequent ones and grows with the root of the number of distinct words; any other word is predicted as one of a number of
hash buckets that grows alike, times its share of the bucket's count, which is joined by word. Probabilities factor into class and word
within class, so a position costs two small softmaxes.

Every text is cut into symbols once, in a written table that training and scoring read. Training covers every position of every
document once, in eight turns over disjoint parts. In a turn the documents are dealt by hash to shards, each of which
trains a copy of the network; the copies are averaged by number of positions, block by block, in two steps, and the next turn goes on
from the average. The number of shards follows from the number of words, so the network depends on the documents and not on how they are
partitioned. Only the averaged network and the vocabulary come to the driver; the counts of the other words stay distributed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import of_worker, staged, text_or_empty

#: What each byte of a text becomes: letters in lower case, digits and bytes of other characters stay, all else parts words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Parts in which a network is averaged, and copies averaged at a time.
BLOCKS, FAN_IN = 16, 64
#: Words for each shard of a table, and words that a copy lays out and shuffles at a time.
SHARD_WORDS, LINE_WORDS = 8_000_000, 200_000
#: Bytes of texts whose words are told apart at a time, for counting and for cutting into symbols.
COUNT_BYTES, CUT_BYTES = 1 << 23, 1 << 22
#: Logits held at a time, and the size below which exponentials of them need no shift.
CACHE_LOGITS, EXP_BOUND = 1 << 16, 75


@dataclass(frozen=True)
class LmShape:
    """``classes`` times ``per_class`` symbols, one of them the text's edge and ``buckets`` for words beyond the vocabulary."""

    classes: int = 48
    per_class: int = 48
    buckets: int = 256
    window: int = 2
    dim: int = 12
    hidden: int = 24
    masked: float = 1.0
    turns: int = 8
    batch: int = 8192
    rate: float = 0.15
    seed: int = 3

    @property
    def words(self) -> int:
        return self.classes * self.per_class - self.buckets - 1

    def grown(self, distinct: int) -> LmShape:
        """This shape or, beyond 83,000 distinct words, 8 symbols for each unit of their root, a ninth of them buckets."""
        side = math.ceil(math.sqrt(8 * math.sqrt(distinct)))
        return self if side * side <= self.classes * self.per_class else replace(self, classes=side, per_class=side, buckets=side * side // 9)


class WindowNetwork:
    """The network and its vocabulary. Symbol 0 is the edge, then words by frequency, then buckets.

    ``counts`` (word, n) holds the words beyond the vocabulary that occur twice or more, ``totals`` the occurrences in each bucket.
    """

    def __init__(self, shape: dict, words: list[bytes], weights: dict[str, np.ndarray] | None = None, totals: np.ndarray | None = None, counts: DataFrame | None = None):
        self.shape = s = LmShape(**shape)
        self.words, self.vocabulary = words, pa.array(words, pa.binary())
        if weights is None:
            rng = np.random.default_rng(s.seed)
            scale = lambda *d: (rng.standard_normal(d) / np.sqrt(d[-2] if len(d) > 1 else 1)).astype(np.float32)
            symbols, context = s.classes * s.per_class, 2 * s.window * s.dim
            weights = {
                "embed": (rng.standard_normal((symbols, s.dim)) * 0.3).astype(np.float32), "w": scale(context, s.hidden), "b": np.zeros(s.hidden, np.float32),
                "cw": scale(s.hidden, s.classes) * np.float32(0.1), "cb": np.zeros(s.classes, np.float32),
                "ow": scale(s.classes, s.hidden, s.per_class) * np.float32(0.1), "ob": np.zeros((s.classes, s.per_class), np.float32),
            }
        self.weights, self.totals, self.counts = weights, totals, counts
        self.trained_on: tuple[DataFrame, DataFrame] | None = None  # documents and their symbols

    def symbols(self, data: bytes) -> np.ndarray:
        return self.encode(data)[0]

    def encode(self, data: bytes) -> tuple[np.ndarray, float, bytes]:
        """A text's symbols, minus the summed log of the bucket totals over its words beyond the vocabulary, and these words, joined by spaces."""
        _, symbols, lp, rare = next(self.encoded(pa.array([data], pa.binary())))
        return symbols.values.to_numpy(), lp[0], rare.cast(pa.binary())[0].as_py()

    def encoded(self, texts: pa.BinaryArray) -> Iterator[tuple[slice, pa.ListArray, np.ndarray, pa.StringArray]]:
        """Slices of texts with their symbols, log shares and joined rare words, as in :meth:`encode`. Every different word of a slice is looked up once.

        One occurrence more in each bucket stands for all words that were not counted.
        """
        first, n = self.shape.words + 1, self.shape.buckets
        for rows, words, at, ends in cut_words(texts, CUT_BYTES):
            symbol_of = pc.index_in(words.cast(pa.binary()), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False) + np.int32(1)
            places = np.flatnonzero(symbol_of == 0)
            buckets = np.fromiter(map(zlib.crc32, _bytes_of(words.take(pa.array(places)))), dtype=np.int64, count=len(places)) % n
            symbol_of[places] = first + buckets
            symbols = symbol_of[at]
            lp, rare, rare_ends = np.zeros(len(ends)), words[:0], np.zeros(len(ends), np.int64)
            if self.totals is not None and len(places):
                share = np.zeros(len(symbol_of))
                share[places] = -np.log1p(self.totals[buckets])
                begins = np.concatenate([[0], ends[:-1]])
                some = begins < ends
                lp[some] = np.add.reduceat(share[at], begins[some])
                beyond = np.flatnonzero(symbols >= first)
                rare, rare_ends = words.take(pa.array(at[beyond])), np.searchsorted(beyond, ends)
            yield rows, _lists(pa.array(symbols), ends), lp, pc.binary_join(_lists(rare, rare_ends), " ")

    def laid_out(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Documents one after another with edges between, and the positions of their words."""
        edge = np.zeros(self.shape.window, dtype=np.int32)
        parts, at, places = [edge], self.shape.window, []
        for d in docs:
            parts += [d, edge]
            places.append(np.arange(at, at + len(d)))
            at += len(d) + len(edge)
        return np.concatenate(parts), np.concatenate(places) if places else np.zeros(0, dtype=np.int64)

    def _by_class(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order of the positions in which each class is one slice. Neighbouring ranks fall into different classes, so that every class has frequent and rare words."""
        return np.argsort((line[at] % self.shape.classes).astype(np.int16), kind="stable")

    def _forward(self, line: np.ndarray, at: np.ndarray):
        """Context, class and place of the words at ``at``, ordered by class, and the ends of the classes."""
        k, classes = self.shape.window, self.shape.classes
        place, kind = np.divmod(line[at], classes)
        return line[at[:, None] + np.array([o for o in range(-k, k + 1) if o])], kind, place, np.searchsorted(kind, np.arange(classes + 1))

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and hidden values, which end in a one for the bias."""
        p = self.weights
        x = p["embed"].take(context.ravel(), axis=0).reshape(len(context), -1)
        h = np.ones((len(context), self.shape.hidden + 1), x.dtype)
        z = x @ p["w"]
        np.tanh(np.add(z, p["b"], out=z), out=h[:, :-1])
        return x, h

    def _tables(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of the classes and of the words within them, the bias as last input, and whether a logit could pass ``EXP_BOUND``: hidden values lie in [-1, 1]."""
        p = self.weights
        cw, ow = np.concatenate([p["cw"], p["cb"][None]]), np.concatenate([p["ow"], p["ob"][:, None]], axis=1)
        small = all(self.shape.hidden * max(w.max(), -w.min()) + max(b.max(), -b.min()) < EXP_BOUND for w, b in ((p["cw"], p["cb"]), (p["ow"], p["ob"])))
        return cw, ow, not (small or max(np.abs(cw).sum(axis=0).max(), np.abs(ow).sum(axis=1).max()) < EXP_BOUND)

    def _within(self, kinds: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, list[tuple[int, slice, slice]]]]:
        """Slices of positions ordered by class, with the classes in each: class, its positions and where they lie in the slice."""
        for rows in _slices(len(kinds), self.shape.per_class):
            classes = range(int(kinds[rows.start]), int(kinds[rows.stop - 1]) + 1)
            bounds = [(k, max(int(ends[k]), rows.start), min(int(ends[k + 1]), rows.stop)) for k in classes]
            yield rows, [(k, slice(b, e), slice(b - rows.start, e - rows.start)) for k, b, e in bounds if b < e]

    def log_probabilities(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(word | words on both sides) at the positions ``at`` of a laid-out line."""
        (cw, ow, large), out = self._tables(), np.empty(len(at))
        for begin in range(0, len(at), 65536):
            order = self._by_class(line, at[begin : begin + 65536])
            context, kind, place, ends = self._forward(line, at[begin : begin + 65536][order])
            h, lp = np.empty((len(order), self.shape.hidden + 1), cw.dtype), np.empty(len(order), cw.dtype)
            for rows in _slices(len(order), self.shape.classes):
                h[rows] = self._hidden(context[rows])[1]
                lp[rows] = _log_share(h[rows] @ cw, kind[rows], large)
            for rows, parts in self._within(kind, ends):
                o = np.empty((rows.stop - rows.start, self.shape.per_class), h.dtype)
                for k, own, part in parts:
                    np.matmul(h[own], ow[k], out=o[part])
                lp[rows] += _log_share(o, place[rows], large)
            out[begin + order] = lp
        return out

    def step(self, line: np.ndarray, at: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the mean negative log-probability of the positions ``at``."""
        p, s, n = self.weights, self.shape, len(at)
        context, kind, place, ends = self._forward(line, at[self._by_class(line, at)])
        x, h = self._hidden(context)
        cw, ow, large = self._tables()
        gcw, gow, gh = np.zeros_like(cw), np.zeros_like(ow), np.empty((n, s.hidden), h.dtype)
        for rows in _slices(n, s.classes):
            c = h[rows] @ cw
            factor = _errors(c, kind[rows], large, n)
            gcw += (h[rows] * factor).T @ c
            np.multiply(c @ p["cw"].T, factor, out=gh[rows])
        for rows, parts in self._within(kind, ends):
            o, back = (np.empty((rows.stop - rows.start, width), h.dtype) for width in (s.per_class, s.hidden))
            for k, own, part in parts:
                np.matmul(h[own], ow[k], out=o[part])
            factor = _errors(o, place[rows], large, n)
            scaled = h[rows] * factor
            for k, _, part in parts:
                gow[k] += scaled[part].T @ o[part]
                np.matmul(o[part], p["ow"][k].T, out=back[part])
            gh[rows] += np.multiply(back, factor, out=back)
        gz = np.square(h[:, :-1])
        np.multiply(np.subtract(1, gz, out=gz), gh, out=gz)
        g = {"cw": gcw[:-1], "cb": gcw[-1], "ow": gow[:, :-1], "ob": gow[:, -1], "w": x.T @ gz, "b": gz.sum(axis=0)}
        seen, gx = np.zeros(len(p["embed"]), bool), (p["w"] @ gz.T).reshape(-1, s.dim, n)
        seen[context] = True
        met, number = np.flatnonzero(seen), np.cumsum(seen) - 1  # symbols in some context; the gradients of the others are 0
        which, ge = number[context.T.ravel()], np.empty((len(met), s.dim), h.dtype)
        for d in range(s.dim):
            ge[:, d] = np.bincount(which, gx[:, d].ravel(), minlength=len(met))
        some = p["embed"][met], squares["embed"][met]
        _descend(*some, ge, s.rate)
        p["embed"][met], squares["embed"][met] = some
        for name, grad in g.items():
            _descend(p[name], squares[name], grad, s.rate)


def _descend(weights: np.ndarray, squares: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adagrad in place, by parts that stay in the processor's cache."""
    rows = max(1, CACHE_LOGITS // 2 // max(1, grad[:1].size))
    for b in range(0, len(grad), rows):
        some, sums = grad[b : b + rows], squares[b : b + rows]
        sums += some * some
        root = np.sqrt(sums)
        root += np.float32(1e-6)
        weights[b : b + rows] -= np.divide(some * np.float32(rate), root, out=root)


def _slices(n: int, width: int) -> Iterator[slice]:
    """Slices of rows whose logits, ``width`` each, stay in the processor's cache."""
    rows = max(64, CACHE_LOGITS // width)
    return (slice(b, min(b + rows, n)) for b in range(0, n, rows))


def _shifted(logits: np.ndarray, large: bool) -> np.ndarray:
    """The largest logit of a row becomes 0 where exponentials could overflow."""
    if large:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _log_share(logits: np.ndarray, target: np.ndarray, large: bool) -> np.ndarray:
    own = _shifted(logits, large)[np.arange(len(target)), target]
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _errors(logits: np.ndarray, target: np.ndarray, large: bool, n: int) -> np.ndarray:
    """Turn logits into probabilities less one at the target, divided by ``n``, but for a factor of each row, which comes back."""
    total = np.exp(_shifted(logits, large), out=logits) @ np.ones(logits.shape[1], logits.dtype)
    logits[np.arange(len(target)), target] -= total
    return np.reciprocal(total * logits.dtype.type(n))[:, None]


def _keep_freed_memory() -> None:
    """Free one block of 24 MB: glibc then keeps the freed arrays of a step for the next one, where it would return and fault in their pages at each."""
    np.empty(24 << 20, np.uint8)


def cut_words(texts: pa.BinaryArray, most: int) -> Iterator[tuple[slice, pa.StringArray, np.ndarray, np.ndarray]]:
    """Slices of texts of about ``most`` bytes: their different words, the place of each word among these, and the number of words up to each text's end."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1)
        low, high = int(ends[begin]), int(ends[end])
        plain = texts.buffers()[2][low:high].to_pybytes().translate(WORD_BYTES) if high > low else b""
        parts = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.utf8(), end - begin, [None, pa.py_buffer(ends[begin : end + 1] - low), pa.py_buffer(plain)]))
        found, upto = parts.values.dictionary_encode(), parts.offsets.to_numpy()[1:]
        at, empty = found.indices.to_numpy(), pc.index(found.dictionary, "").as_py()
        if empty >= 0:  # a part before the first or after the last word
            full = at != empty
            at, upto = at[full], np.concatenate([[0], np.cumsum(full, dtype=np.int32)])[upto]
        yield slice(begin, end), found.dictionary, at, upto
        begin = end


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def _bytes_of(words: pa.StringArray) -> Iterator[bytes]:
    if not len(words):
        return iter(())
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist(), words.buffers()[2].to_pybytes()
    return map(data.__getitem__, map(slice, ends[:-1], ends[1:]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words, at, _ in cut_words(batch.column("data"), COUNT_BYTES):
            n = pa.array(np.bincount(at, minlength=len(words)), pa.int64())
            yield pa.RecordBatch.from_arrays([words, n], ["w", "n"]).filter(pc.greater(n, 0))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """w, n: every word of all documents with its occurrences, which combine in each slice of texts and before the shuffle; written once for the steps that read it."""
    words = docs.select(text_or_empty(text).cast("binary").alias("data")).mapInArrow(_counted, "w string, n long")
    return staged(words.groupBy("w").agg(F.sum("n").alias("n")), "lm-words")


def _with_vocabulary(counts: DataFrame, shape: LmShape) -> WindowNetwork:
    """A new network for the most frequent words, ties by code point; the others are only summed by bucket."""
    top = counts.orderBy(F.desc("n"), "w").limit(shape.words).collect()
    rare = counts.limit(0) if len(top) < shape.words else counts.where((F.col("n") < top[-1]["n"]) | ((F.col("n") == top[-1]["n"]) & (F.col("w") > top[-1]["w"])))
    totals = np.zeros(shape.buckets)
    for r in rare.groupBy(F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(shape.buckets)).alias("b")).agg(F.sum("n").alias("n")).collect():
        totals[r["b"]] = r["n"]
    return WindowNetwork(asdict(shape), [r["w"].encode() for r in top], None, totals, rare.where("n > 1").withColumnRenamed("w", "word"))


class Copy:
    """A copy of the network that learns from one shard's documents, in the order given."""

    def __init__(self, held: dict, turn: int, shard: int):
        _keep_freed_memory()
        self.net = WindowNetwork(held["shape"], [], {k: v.copy() for k, v in held["weights"].items()})
        self.squares = {k: v.copy() for k, v in held["squares"].items()}
        self.rng = np.random.default_rng([self.net.shape.seed, turn, shard])
        self.shard, self.docs, self.waiting, self.seen = shard, [], 0, 0

    def add(self, symbols: np.ndarray) -> None:
        self.docs.append(symbols)
        self.waiting += len(symbols)
        if self.waiting >= LINE_WORDS:
            self.learn()

    def learn(self) -> None:
        line, places = self.net.laid_out(self.docs)
        at = self.rng.permutation(places[self.rng.random(len(places)) < self.net.shape.masked])
        for b in range(0, len(at), self.net.shape.batch):
            self.net.step(line, at[b : b + self.net.shape.batch], self.squares)
        self.seen += len(at)
        self.docs, self.waiting = [], 0

    def result(self) -> pa.RecordBatch:
        """Weights and squares in blocks."""
        self.learn()
        parts = np.array_split(np.concatenate([flat(self.net.weights), flat(self.squares)]), BLOCKS)
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, self.shard // FAN_IN, dtype=np.int32)), pa.array(np.full(BLOCKS, self.shard, dtype=np.int32)),
            pa.array(np.full(BLOCKS, float(self.seen))), pa.array(list(parts), type=pa.list_(pa.float32())),
        ], ["block", "bin", "shard", "weight", "values"])


def _trained(shared, turn: int):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy: Copy | None = None
        for batch in batches:
            shards, column = batch.column("shard").to_pylist(), batch.column("symbols")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for i, shard in enumerate(shards):
                if copy is None or copy.shard != shard:
                    if copy:
                        yield copy.result()
                    copy = Copy(shared.value, turn, shard)
                copy.add(values[ends[i] : ends[i + 1]].copy())
        if copy:
            yield copy.result()

    return trained


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(weights: dict[str, np.ndarray], values: np.ndarray) -> None:
    at = 0
    for k in sorted(weights):
        w = weights[k]
        weights[k] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size


def _mean(t: pa.Table) -> pa.Table:
    t = t.sort_by("shard")  # the same order of summation always
    w = t.column("weight").to_numpy()
    values = np.stack([np.asarray(v) for v in t.column("values").to_numpy()]).astype(np.float64)
    mean = (values * (w / w.sum())[:, None]).sum(axis=0).astype(np.float32)
    return pa.table({"block": t.column("block")[:1], "shard": t.column("shard")[:1], "weight": [w.sum()], "values": pa.array([mean], type=pa.list_(pa.float32()))})


def encoded(docs: DataFrame, net: WindowNetwork, shards: int, text: str = "text") -> DataFrame:
    """__text, __text2 (hashes of the text), row (a hash of all columns), shard, turn, n, symbols, lp, rare: each text cut into symbols, written once, by turn."""
    held = docs.sparkSession.sparkContext.broadcast({"shape": asdict(net.shape), "words": net.words, "weights": {}, "totals": net.totals})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = of_worker(held, lambda h: WindowNetwork(h["shape"], h["words"], h["weights"], h["totals"]))
        for batch in batches:
            for rows, symbols, lp, rare in model.encoded(batch.column("data")):
                kept = [c[rows] for c in batch.columns[:-1]]
                n = pa.array(np.diff(symbols.offsets.to_numpy()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*kept, n, symbols, pa.array(lp), rare], [*batch.schema.names[:-1], "n", "symbols", "lp", "rare"])

    t, row = text_or_empty(text), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    rows = docs.select(F.xxhash64(t).alias("__text"), F.hash(t).alias("__text2"), row.alias("row"), t.cast("binary").alias("data"))
    dealt = rows.select("__text", "__text2", "row", F.pmod(F.shiftrightunsigned("row", 8), F.lit(shards)).cast("int").alias("shard"), F.pmod("row", F.lit(net.shape.turns)).cast("int").alias("turn"), "data")
    out = dealt.mapInArrow(cut, "__text long, __text2 int, row long, shard int, turn int, n long, symbols array<int>, lp double, rare string")
    return staged(out, "lm-symbols", by="turn")


def train_language_model(docs: DataFrame, shape: LmShape | None = None, text: str = "text") -> WindowNetwork:
    """Vocabulary and network of all ``docs``; null texts have no words. Any partitioning of the documents gives the same network.

    Without ``shape`` the number of distinct words decides the size of the vocabulary. A row's values decide its shard and its turn.
    """
    counts = word_counts(docs, text)
    size = counts.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    shape = shape or LmShape().grown(size["distinct"])
    net = _with_vocabulary(counts, shape)
    shards = 1 + size["words"] // SHARD_WORDS
    symbols = encoded(docs, net, shards, text)
    squares = {k: np.full_like(v, 1e-4) for k, v in net.weights.items()}
    for turn in range(shape.turns):
        shared = docs.sparkSession.sparkContext.broadcast({"shape": asdict(shape), "weights": net.weights, "squares": squares})
        part = symbols.where((F.col("turn") == turn) & (F.col("n") > 0)).select("shard", "row", "symbols")
        part = part.repartition(shards, "shard").sortWithinPartitions("shard", "row").select("shard", "symbols")
        copies = part.mapInArrow(_trained(shared, turn), "block int, bin int, shard int, weight double, values array<float>")
        columns = "block int, shard int, weight double, values array<float>"
        means = copies.groupBy("block", "bin").applyInArrow(_mean, columns).groupBy("block").applyInArrow(_mean, columns)
        found = sorted(means.collect(), key=lambda r: r["block"])
        if found:
            both = np.concatenate([np.asarray(r["values"], dtype=np.float32) for r in found])
            unflat(net.weights, both[: len(both) // 2])
            unflat(squares, both[len(both) // 2 :])
        shared.unpersist()
    net.trained_on = (docs, symbols)
    return net


def score_documents(docs: DataFrame, net: WindowNetwork, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_prob (natural, summed over all positions) and mean_log_prob; columns of these names are replaced.

    A text without words has log_prob 0 and a null mean. Every position of the whole text counts. Words beyond the vocabulary meet
    their counts in a join by word, whose sums come back by text. Documents that the network was trained on are not cut again.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"shape": asdict(net.shape), "words": [], "weights": net.weights})

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = of_worker(shared, lambda held: WindowNetwork(held["shape"], held["words"], held["weights"]))
        for texts in batches:
            sums, block, size = [], [], 0

            def flush() -> None:
                line, at = model.laid_out(block)
                lp = np.concatenate([[0.0], np.cumsum(model.log_probabilities(line, at))])
                ends = np.cumsum([len(d) for d in block])
                sums.extend(lp[ends] - lp[ends - [len(d) for d in block]])
                block.clear()

            _keep_freed_memory()
            for symbols in texts:
                block.append(np.asarray(symbols, dtype=np.int32))
                size += len(symbols)
                if size >= LINE_WORDS:
                    flush()
                    size = 0
            if block:
                flush()
            yield pd.Series(sums, dtype=float)

    key = ["__text", "__text2"]
    known = net.trained_on is not None and net.trained_on[0] is docs
    symbols = net.trained_on[1] if known else encoded(docs, net, 1, text)
    found = symbols.select(*key, "n", (scored("symbols") + F.col("lp")).alias("lp"))
    sums = found.groupBy(*key).agg(F.max("n").alias("__n"), F.min("lp").alias("__lp"), F.count("*").alias("__copies"))
    if net.counts is not None:
        words = symbols.where(F.col("rare") != "").select(*key, F.explode(F.split("rare", " ")).alias("word"))
        # Counts of different words are far fewer than the words that meet them: hashed in each partition, the words need no sort.
        shares = words.join(net.counts.hint("shuffle_hash"), "word").groupBy(*key).agg(F.sum(F.log("n")).alias("__more"))
        sums = sums.join(shares, key, "left").withColumn("__lp", F.col("__lp") + F.coalesce(F.col("__more") / F.col("__copies"), F.lit(0.0)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "log_prob", "mean_log_prob")]
    marked = docs.withColumns({"__text": F.xxhash64(text_or_empty(text)), "__text2": F.hash(text_or_empty(text))})
    return marked.join(sums, key).select(*kept, F.col("__n").alias("n_tokens"), F.col("__lp").alias("log_prob"), F.when(F.col("__n") > 0, F.col("__lp") / F.col("__n")).alias("mean_log_prob"))
