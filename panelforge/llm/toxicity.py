"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

The chain has two states per word: clean and toxic. A word's features are itself and its first four, five and six letters; states of
neighbouring words are tied by a transition matrix. Documents carry only one label each, so word labels are derived first:
features that single out toxic training documents are picked one by one, each time the one that best explains documents
not explained yet, and words with a picked feature are labelled toxic. Forward-backward marginals give each word's
probability; the highest and the expected number of toxic words give the document's score by a logistic
curve fitted on the same training documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import of_worker, text_or_empty

WORD = r"[0-9A-Za-z\x80-\U0010ffff]+"
PREFIXES = (4, 5, 6)
SLOTS = 1 << 18
#: Word scores kept per Python worker; a full table is emptied, which costs time and no result.
CACHE_WORDS = 400_000
#: Words scored side by side in one go.
BLOCK_WORDS = 1_000_000


@dataclass(frozen=True)
class TrainingBounds:
    """What is fitted on the driver: documents per class, characters of the longest, words per training segment, segments, steps."""

    toxic: int = 2_000
    clean: int = 4_000
    chars: int = 20_000
    segment: int = 32
    segments: int = 8_000
    steps: int = 80


def features(word: str) -> tuple[str, ...]:
    return (f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n))


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


class Tagger(dict):
    """The fitted chain; as a dict it keeps the scores of words seen."""

    def __init__(self, weights: np.ndarray, bias: float, transition: np.ndarray, curve: np.ndarray | None, base: float):
        super().__init__()
        self.weights, self.bias, self.transition, self.curve, self.base = weights, bias, transition, curve, base

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        s = self[word] = self.bias + float(sum(self.weights[slot(f)] for f in features(word.lower())))
        return s

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every word of every document, by forward-backward over all documents side by side."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        lengths = np.array([len(scores[i]) for i in order], dtype=np.int64)
        if not len(lengths) or not lengths[0]:
            return [np.zeros(0) for _ in scores]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t
        begin = np.concatenate([[0], np.cumsum(alive)])
        flat = np.empty(begin[-1])
        for r, i in enumerate(order):
            flat[begin[: lengths[r]] + r] = scores[i]
        odds = np.exp(np.clip(flat, -25, 25))
        (p00, p01), (p10, p11) = np.exp(self.transition)
        ahead, back = np.empty_like(odds), np.ones_like(odds)
        ahead[: alive[0]] = odds[: alive[0]]
        for t in range(1, len(alive)):
            k = alive[t]
            o = ahead[begin[t - 1] : begin[t - 1] + k]
            ahead[begin[t] : begin[t] + k] = np.clip(odds[begin[t] : begin[t] + k] * (p01 + p11 * o) / (p00 + p10 * o), 1e-30, 1e30)
        for t in range(len(alive) - 1, 0, -1):
            k = alive[t]
            o = odds[begin[t] : begin[t] + k] * back[begin[t] : begin[t] + k]
            back[begin[t - 1] : begin[t - 1] + k] = np.clip((p10 + p11 * o) / (p00 + p01 * o), 1e-30, 1e30)
        both = ahead * back
        p = both / (1 + both)
        out: list[np.ndarray] = [np.zeros(0)] * len(scores)
        for r, i in enumerate(order):
            out[i] = p[begin[: lengths[r]] + r]
        return out

    def document_score(self, p: np.ndarray) -> float:
        if self.curve is None:
            return self.base
        top, some = evidence(p)
        return float(1 / (1 + np.exp(-np.clip(self.curve @ (1.0, top, some), -40, 40))))


def evidence(p: np.ndarray) -> tuple[float, float]:
    """The highest marginal as log-odds and the log of the expected number of clearly toxic words."""
    if not len(p):
        return -12.0, 0.0
    top = min(max(float(p.max()), 6e-6), 1 - 6e-6)
    return float(np.log(top / (1 - top))), float(np.log1p(p[p > 0.2].sum()))


class Sample:
    """Training documents as numbers: word numbers per document, and of every word its features and their slots."""

    def __init__(self, texts: list[str]):
        split, words, names = re.compile(WORD).findall, {}, {}
        self.docs = [np.fromiter((words.setdefault(w.lower(), len(words)) for w in split(t)), dtype=np.int32) for t in texts]
        width = 1 + len(PREFIXES)
        self.features = np.full((len(words), width), -1, dtype=np.int32)
        self.slots = np.full((len(words), width), SLOTS, dtype=np.int32)  # the last weight stays zero
        for w, i in words.items():
            for k, f in enumerate(features(w)):
                self.features[i, k] = names.setdefault(f, len(names))
                self.slots[i, k] = slot(f)
        self.names = list(names)

    def features_of(self, i: int) -> np.ndarray:
        found = np.unique(self.features[np.unique(self.docs[i])])
        return found[found >= 0]


def pick_features(sample: Sample, toxic: np.ndarray, least: int = 3, least_evidence: float = 10.0) -> np.ndarray:
    """Numbers of the features that single out toxic documents, picked until none explains ``least`` more of them.

    A feature's worth is its log-likelihood ratio over the toxic documents not explained yet and all clean ones;
    among equals a longer one wins.
    """
    n = len(sample.names)
    counts = np.zeros((2, n))
    for i, y in enumerate(toxic):
        counts[int(y), sample.features_of(i)] += 1
    names = np.flatnonzero((counts[1] >= least) & (counts[0] <= 0.05 * counts[1]))
    if not len(names):
        return names
    place = np.full(n, -1)
    place[names] = np.arange(len(names))
    open_docs = {}
    for i in np.flatnonzero(toxic):
        own = place[sample.features_of(i)]
        open_docs[i] = own[own >= 0]
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    share = n1 / (n1 + n0)
    a, b = counts[1, names], counts[0, names]
    longer = np.array([len(sample.names[f]) for f in names]) * 1e-6
    picked = []
    while True:
        with np.errstate(divide="ignore", invalid="ignore"):
            worth = 2 * (a * np.log(a / ((a + b) * share)) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
        worth = np.where(a >= least, worth + longer, 0)
        best = int(worth.argmax())
        if worth[best] < least_evidence:
            return names[picked]
        picked.append(best)
        for i in [i for i, own in open_docs.items() if (own == best).any()]:
            a[open_docs.pop(i)] -= 1


def train_tagger(texts: list[str], toxic: np.ndarray, bounds: TrainingBounds = TrainingBounds()) -> Tagger:
    """Fit the chain and the score curve on labelled documents. Without both classes the score is the share of toxic ones."""
    base = float(toxic.mean()) if len(toxic) else 0.0
    if not toxic.any() or toxic.all():
        return Tagger(np.zeros(SLOTS), 0.0, np.zeros((2, 2)), None, base)
    sample = Sample(texts)
    bad = np.isin(sample.features, pick_features(sample, toxic)).any(axis=1)
    weights, bias, transition = _fit_chain(sample, bad, toxic, bounds)
    tagger = Tagger(weights, bias, transition, None, base)
    of_word = bias + np.append(weights, 0.0)[sample.slots].sum(axis=1)
    seen = []
    for begin in range(0, len(texts), 500):
        seen += [evidence(p) for p in tagger.marginals([of_word[d] for d in sample.docs[begin : begin + 500]])]
    tagger.curve = _fit_curve(np.array(seen), toxic)
    return tagger


def _fit_chain(sample: Sample, bad: np.ndarray, toxic: np.ndarray, bounds: TrainingBounds) -> tuple[np.ndarray, float, np.ndarray]:
    """Conditional likelihood of the tags over fixed-length segments, raised by Adam with a quadratic penalty."""
    rng, length, width = np.random.default_rng(5), bounds.segment, sample.slots.shape[1]
    marked, plain = [], []
    for i, d in enumerate(sample.docs):
        for b in range(0, len(d), length):
            if not toxic[i]:
                plain.append((i, b))
            elif bad[d[b : b + length]].any():
                marked.append((i, b))
    half = bounds.segments // 2
    chosen = [marked[i] for i in rng.permutation(len(marked))[:half]] + [plain[i] for i in rng.permutation(len(plain))[:half]]
    n = len(chosen)
    x = np.full((n, length, width), SLOTS, dtype=np.int32)
    y, here = np.zeros((n, length), dtype=np.int64), np.zeros((n, length), dtype=bool)
    for r, (i, b) in enumerate(chosen):
        part = sample.docs[i][b : b + length]
        x[r, : len(part)], here[r, : len(part)] = sample.slots[part], True
        if toxic[i]:
            y[r, : len(part)] = bad[part]
    weights, rest = np.zeros(SLOTS + 1), np.array([-3.0, 0.5, -0.5, 0.0, 0.0])  # bias, transitions by (before, after)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(rest), np.zeros_like(rest)]
    last = here.sum(axis=1) - 1
    for step in range(1, bounds.steps + 1):
        e = weights[x].sum(axis=2) + rest[0]
        trans = rest[1:].reshape(2, 2)
        score = np.zeros((n, length, 2))
        score[:, :, 1] = e
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + score[:, t]
        for t in range(length - 2, -1, -1):
            ahead = score[:, t + 1] + beta[:, t + 1]
            new = np.stack([np.logaddexp(trans[s, 0] + ahead[:, 0], trans[s, 1] + ahead[:, 1]) for s in (0, 1)], axis=1)
            beta[:, t] = np.where(here[:, t + 1, None], new, 0.0)
        total = np.logaddexp(alpha[np.arange(n), last, 0], alpha[np.arange(n), last, 1])
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
        g = np.where(here, p - y, 0.0)
        grad = np.bincount(x.ravel(), np.repeat(g.ravel(), width), minlength=SLOTS + 1) / n + 2e-5 * weights
        grad[SLOTS] = 0
        rest_grad = np.zeros(5)
        rest_grad[0] = g.sum() / n
        pair = here[:, 1:]
        for s in (0, 1):
            for d in (0, 1):
                q = np.exp(alpha[:, :-1, s] + trans[s, d] + score[:, 1:, d] + beta[:, 1:, d] - total[:, None])
                true = (y[:, :-1] == s) & (y[:, 1:] == d)
                rest_grad[1 + 2 * s + d] = np.where(pair, q - true, 0.0).sum() / n
        for value, gradient, m, v in ((weights, grad, *moments[:2]), (rest, rest_grad, *moments[2:])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return weights[:SLOTS], float(rest[0]), rest[1:].reshape(2, 2)


def _fit_curve(seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic curve over the two kinds of evidence, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(seen)), seen])
    y, w = toxic.astype(float), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
    return w


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id's text is divisible by 5; never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds(), doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``bounds`` training documents per class, the first by hash of the id.

    Rows that are held out, unlabelled or longer than ``bounds.chars`` are left out. A document with several labels is toxic
    if one of them says so. At most ``toxic + clean`` ids are broadcast, and their texts come to the driver.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    kinds = [known.where(F.col("__toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in ((1, bounds.toxic), (0, bounds.clean))]
    ids = kinds[0].unionByName(kinds[1])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text")).where(F.length("__text") <= bounds.chars)
    rows = rows.join(F.broadcast(ids), "__id").orderBy(F.xxhash64("__id"), "__text").limit(bounds.toxic + bounds.clean).collect()
    return [r["__text"] for r in rows], np.array([r["__toxic"] == 1 for r in rows], dtype=bool)


def score_toxicity(docs: DataFrame, tagger: Tagger, text: str = "text", span_threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and toxic_spans (start, end in code points, p); columns of these names are replaced.

    Whole texts are scored; null and wordless texts get the score of no evidence. A span is a run of words whose marginal
    reaches ``span_threshold``. No row is moved: the tagger (about 2 MB whatever the data) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(tagger)))

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, pattern = of_worker(shared, lambda held: Tagger(**held)), re.compile(WORD)
        for texts in batches:
            out, block, size = [], [], 0

            def flush() -> None:
                marginals = model.marginals([s for _, s in block])
                for (t, _), p in zip(block, marginals):
                    out.append((model.document_score(p), _spans(t, p, pattern, span_threshold)))
                block.clear()

            for t in texts:
                words = pattern.findall(t)
                block.append((t, np.fromiter(map(model.__getitem__, words), dtype=float, count=len(words))))
                size += len(words)
                if size >= BLOCK_WORDS:
                    flush()
                    size = 0
            flush()
            yield pd.DataFrame(out, columns=["score", "spans"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "toxic_spans")]
    out = docs.withColumn("__scored", scored(text_or_empty(text)))
    return out.select(*kept, F.col("__scored.score").alias("score"), F.col("__scored.spans").alias("toxic_spans"))


def _spans(text: str, p: np.ndarray, pattern: re.Pattern, threshold: float) -> list[dict]:
    if not len(p) or p.max() < threshold:
        return []
    out, open_span, last = [], None, -2
    places = np.flatnonzero(p >= threshold)
    wanted = set(places.tolist())
    for i, m in enumerate(pattern.finditer(text)):
        if i not in wanted:
            continue
        if i == last + 1 and open_span is not None:
            open_span["end"], open_span["p"] = m.end(), max(open_span["p"], float(p[i]))
        else:
            open_span = {"start": m.start(), "end": m.end(), "p": float(p[i])}
            out.append(open_span)
        last = i
    return out


def drop_toxic(docs: DataFrame, tagger: Tagger, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more, columns as they were."""
    scored = score_toxicity(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_or_empty(text).alias("__text")), tagger, "__text")
    return scored.where(F.col("score") < threshold).select("__row.*")
