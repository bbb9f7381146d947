"""Toxicity, language-model scores, personal data, mixing and the pipeline: held-out accuracy, brute force, exact properties."""

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelforge.llm import decontaminate, lm, mixing, pii, queries, simhash, toxicity
from panelforge.llm.common import table

# Toxicity


def made_labels(spark, n=400):
    rng = np.random.default_rng(0)
    plain = [f"plain{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, size=rng.integers(5, 120)))
        bad = i % 5 == 1
        if bad:
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(len(words))] = f"vilegrub{rng.integers(50)}" if i % 2 else "rotten"
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    odd = [(1000, None, "s"), (1001, "", "s"), (1002, "…!", "s"), (None, "rotten", "s"), (1003, "plain1 " * 60_000 + "rotten", "s"), (1004, "Say ROTTEN rotten, é plain1", "s"), (1004, "Say ROTTEN rotten, é plain1", "s")]
    return spark.createDataFrame([(i, t, "s") for i, t in docs] + odd, "doc_id long, text string, Score string"), spark.createDataFrame([*labels, (None, 1), (3, None), (77777, 1)], "doc_id long, toxic int"), dict(labels)


def test_tagger_finds_held_out_toxic_documents_and_their_words(spark):
    docs, labels, truth = made_labels(spark)
    tagger = toxicity.train_tagger(*toxicity.labelled_sample(docs, labels))
    out = toxicity.score_toxicity(docs, tagger)
    assert out.columns == ["doc_id", "text", "score", "toxic_spans"]
    rows = out.collect()
    assert len(rows) == 407 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) >= 0.95
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["score"] < 0.5 and not by_id[i]["toxic_spans"] for i in (1000, 1001, 1002))
    assert [(s["start"], s["end"]) for s in by_id[1004]["toxic_spans"]] == [(4, 17)] or [(s["start"], s["end"]) for s in by_id[1004]["toxic_spans"]] == [(4, 10), (11, 17)]
    assert by_id[1003]["score"] >= 0.5 and by_id[1003]["toxic_spans"][-1]["end"] == len("plain1 ") * 60_000 + 6
    kept = toxicity.drop_toxic(docs, tagger)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in rows)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    tagger = toxicity.Tagger(np.zeros(2), 0.0, rng.normal(size=(2, 2)), None, 0.0)
    docs = [rng.normal(size=n) for n in (4, 0, 1, 6, 4)]
    for scores, p in zip(docs, tagger.marginals(docs)):
        n = len(scores)
        weight, on = 0.0, np.zeros(n)
        for state in range(1 << n):
            y = [state >> t & 1 for t in range(n)]
            w = np.exp(sum(s for s, v in zip(scores, y) if v) + sum(tagger.transition[a, b] for a, b in zip(y, y[1:])))
            weight += w
            on += w * np.array(y)
        assert np.allclose(p, on / weight if n else [])


def test_without_two_classes_the_score_is_the_base_rate(spark):
    docs, labels, _ = made_labels(spark, 20)
    for part, base in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        tagger = toxicity.train_tagger(*toxicity.labelled_sample(docs, part))
        assert {r["score"] for r in toxicity.score_toxicity(docs, tagger).collect()} == {base}
    assert toxicity.score_toxicity(docs.limit(0), tagger).count() == 0


def test_toxicity_query_never_learns_from_held_out_rows(spark, sf):
    rows = queries.op10_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    _, flags = toxicity.labelled_sample(table(spark, sf, "documents"), table(spark, sf, "labels"))
    known = table(spark, sf, "labels").where("crc32(cast(doc_id as string)) % 5 != 0").count()
    assert len(flags) <= known


# Language model


def test_log_probabilities_are_normalised_and_equal_a_plain_forward_pass():
    shape = lm.LmShape(classes=3, per_class=4, buckets=4, dim=3, hidden=5)
    net = lm.WindowNetwork(vars(shape), [b"a", b"b", b"c"])
    net.weights["ob"] += np.random.default_rng(0).normal(size=net.weights["ob"].shape).astype(np.float32)
    line, at = net.laid_out([net.symbols(b"a B zz c"), net.symbols(b""), net.symbols("é a".encode())])
    p, got = net.weights, net.log_probabilities(line, at)
    for t, place in enumerate(at):
        x = np.concatenate([p["embed"][line[place + o]] for o in (-2, -1, 1, 2)])
        h = np.tanh(x @ p["w"] + p["b"])
        c = np.exp(h @ p["cw"] + p["cb"])
        probability = np.zeros(12)
        for k in range(3):
            o = np.exp(h @ p["ow"][k] + p["ob"][k])
            probability[k::3] = c[k] / c.sum() * o / o.sum()
        assert abs(probability.sum() - 1) < 1e-5 and abs(np.log(probability[line[place]]) - got[t]) < 1e-4


def test_training_step_follows_the_gradient():
    shape = lm.LmShape(classes=3, per_class=4, buckets=4, dim=3, hidden=5)
    net = lm.WindowNetwork(vars(shape), [b"a", b"b", b"c"])
    line, at = net.laid_out([net.symbols(b"a b c a b zz a")])
    before = {k: v.copy() for k, v in net.weights.items()}

    class Recorder(dict):
        pass

    squares = Recorder({k: np.zeros_like(v) for k, v in before.items()})
    net.step(line, at, squares)
    rng = np.random.default_rng(1)
    for name, w in before.items():
        for _ in range(4):
            spot = tuple(rng.integers(s) for s in w.shape)
            net.weights = {k: v.astype(np.float64) for k, v in before.items()}
            losses = []
            for e in (1e-4, -1e-4):
                net.weights[name] = before[name].astype(np.float64)
                net.weights[name][spot] += e
                losses.append(-net.log_probabilities(line, at).mean())
            assert abs(abs((losses[0] - losses[1]) / 2e-4) - np.sqrt(squares[name][spot])) < 1e-4


def plain_step(net, line, at, squares):
    """One Adagrad step, a class at a time and with dense gradients."""
    p, s, n = net.weights, net.shape, np.float32(len(at))
    at = at[np.argsort(line[at] % s.classes, kind="stable")]
    context = line[at[:, None] + np.array([-2, -1, 1, 2])]
    kind, place = line[at] % s.classes, line[at] // s.classes
    x = p["embed"][context].reshape(len(at), -1)
    h = np.tanh(x @ p["w"] + p["b"])

    def errors(logits, target):
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(len(target)), target] -= 1
        return e / n

    c = errors(h @ p["cw"] + p["cb"], kind)
    g = {"cw": h.T @ c, "cb": c.sum(axis=0), "ow": np.zeros_like(p["ow"]), "ob": np.zeros_like(p["ob"])}
    gh = c @ p["cw"].T
    for k in set(kind.tolist()):
        rows = slice(*np.searchsorted(kind, [k, k + 1]))
        o = errors(h[rows] @ p["ow"][k] + p["ob"][k], place[rows])
        g["ow"][k], g["ob"][k] = h[rows].T @ o, o.sum(axis=0)
        gh[rows] += o @ p["ow"][k].T
    gz = gh * (1 - h * h)
    g["w"], g["b"] = x.T @ gz, gz.sum(axis=0)
    gx, seen = (gz @ p["w"].T).reshape(-1, s.dim), context.ravel()
    g["embed"] = np.stack([np.bincount(seen, gx[:, d], minlength=len(p["embed"])) for d in range(s.dim)], axis=1).astype(np.float32)
    for name, grad in g.items():
        squares[name] += grad * grad
        p[name] -= s.rate * grad / (np.sqrt(squares[name]) + np.float32(1e-6))


def test_training_steps_equal_plain_ones_and_take_less_cpu_time():
    rng = np.random.default_rng(4)
    shape = lm.LmShape(classes=96, per_class=96, buckets=1024)
    line = np.minimum(rng.pareto(0.6, 50_000) * 3, 96 * 96 - 1).astype(np.int32)
    nets = [lm.WindowNetwork(vars(shape), []) for _ in range(2)]
    squares = [{k: np.full_like(v, 1e-4) for k, v in net.weights.items()} for net in nets]
    spent = [[], []]
    for _ in range(10):
        at = rng.permutation(np.arange(2, len(line) - 2))[: shape.batch]
        for i, step in enumerate((plain_step, lm.WindowNetwork.step)):
            begin = time.process_time()
            step(nets[i], line, at, squares[i])
            spent[i].append(time.process_time() - begin)
    for name, w in nets[0].weights.items():
        assert np.abs(w - nets[1].weights[name]).max() < 1e-4 and np.allclose(squares[0][name], squares[1][name], rtol=1e-3, atol=1e-7)
    assert min(spent[1]) < 0.85 * min(spent[0])


@pytest.mark.parametrize("size", [1, 8, 60])
def test_large_weights_neither_overflow_nor_lose_a_probability(size):
    shape = lm.LmShape(classes=5, per_class=7, buckets=4, dim=3, hidden=6)
    net = lm.WindowNetwork(vars(shape), [])
    rng = np.random.default_rng(size)
    for name in ("cw", "cb", "ow", "ob"):
        net.weights[name] = (rng.normal(size=net.weights[name].shape) * size).astype(np.float32)
    line = rng.integers(0, 35, 400).astype(np.int32)
    at = np.arange(2, 398)
    p = {k: v.astype(np.float64) for k, v in net.weights.items()}
    h = np.tanh(p["embed"][line[at[:, None] + np.array([-2, -1, 1, 2])]].reshape(len(at), -1) @ p["w"] + p["b"])
    want = np.zeros(len(at))
    for i, t in enumerate(line[at]):
        for logits, own in ((h[i] @ p["cw"] + p["cb"], t % 5), (h[i] @ p["ow"][t % 5] + p["ob"][t % 5], t // 5)):
            want[i] += logits[own] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    got = net.log_probabilities(line, at)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and net._tables()[2] == (size > 8)
    squares = {k: np.full_like(v, 1e-4) for k, v in net.weights.items()}
    other = lm.WindowNetwork(vars(shape), [], {k: v.copy() for k, v in net.weights.items()})
    plain_step(other, line, at, {k: v.copy() for k, v in squares.items()})
    net.step(line, at, squares)
    assert all(np.allclose(net.weights[k], other.weights[k], rtol=1e-3, atol=1e-3) for k in net.weights)


def test_words_of_odd_texts_are_cut_in_slices_as_by_the_pattern(monkeypatch):
    shape = lm.LmShape(classes=3, per_class=4, buckets=4, dim=3, hidden=5)
    odd = ["", "…", " a", "a ", "A\x00b\x7fc", "9Zz-9zZ", "x" * 5000, "\u00a0É é\u2003É", "a b zz " * 400, "\t\n\r", "", "É zz new", "a\x0bb\x0cc\x1cd"]
    texts = [t.encode() for t in odd] + [b"bad \xff\xfe bytes", b"\x80"]
    words = [re.findall(rb"[0-9a-z\x80-\xff]+", t.lower()) for t in texts]
    totals = np.array([3.0, 1.0, 0.0, 7.0])
    net = lm.WindowNetwork(vars(shape), [b"a", b"b", b"zz"], totals=totals)
    rare = [[w for w in ws if w not in net.words] for ws in words]
    for most in (1, 100, 1 << 22):
        monkeypatch.setattr(lm, "CUT_BYTES", most)
        monkeypatch.setattr(lm, "COUNT_BYTES", most)
        column = pa.array([b"gone", *texts], pa.binary())[1:]
        found = [r for _, symbols, lp, more in net.encoded(column) for r in zip(symbols.to_pylist(), lp, more.cast(pa.binary()).to_pylist())]
        assert len(found) == len(texts)
        for ws, beyond, (symbols, lp, more) in zip(words, rare, found):
            assert symbols == [net.words.index(w) + 1 if w in net.words else shape.words + 1 + zlib.crc32(w) % 4 for w in ws]
            assert abs(lp + sum(np.log1p(totals[zlib.crc32(w) % 4]) for w in beyond)) < 1e-9 and more == b" ".join(beyond)
        counted = list(lm._counted([pa.RecordBatch.from_arrays([column], ["data"])]))
        pairs = [(w, n) for b in counted for w, n in zip(b.column("w").cast(pa.binary()).to_pylist(), b.column("n").to_pylist())]
        total = {}
        for w, n in pairs:
            total[w] = total.get(w, 0) + n
        every = [w for ws in words for w in ws]
        assert total == {w: every.count(w) for w in set(every)}
        assert most < 1 << 22 or len(pairs) == len(total)  # a word goes on once for each slice, not once for each occurrence


def test_trained_model_beats_word_frequencies_and_prefers_fluent_text(spark):
    rng = np.random.default_rng(2)
    follow = {i: rng.choice(40, size=3, replace=False) for i in range(40)}

    def text(n):
        w = [int(rng.integers(40))]
        while len(w) < n:
            w.append(int(rng.choice(follow[w[-1]])))
        return w

    train = [(i, " ".join(f"t{w}" for w in text(120))) for i in range(300)]
    held = text(300)
    mixed = list(held)
    rng.shuffle(mixed)
    odd = [(900, " ".join(f"t{w}" for w in held), "a"), (901, " ".join(f"t{w}" for w in mixed), "a"), (902, None, "b"), (903, "", "b"), (904, "unseen ÜBER", "c"), (905, "t1 " * 30_000, "d"), (None, "t1 t2", "e"), (None, "t1 t2", "e")]
    schema = "doc_id long, text string, N_tokens string"
    docs = spark.createDataFrame([(*d, "x") for d in train], schema).repartition(4)
    net = lm.train_language_model(docs, lm.LmShape(classes=8, per_class=8, buckets=8, dim=8, hidden=16, masked=0.5, batch=256))
    rows = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(odd, schema), net).collect()}
    assert rows[900]["n_tokens"] == 300 and rows[900]["mean_log_prob"] > rows[901]["mean_log_prob"] + 0.3
    counts = np.bincount([int(w[1:]) for _, t in train for w in t.split()], minlength=40)
    unigram = np.log(counts / counts.sum())[held].mean()
    assert rows[900]["mean_log_prob"] > unigram + 0.3
    assert (rows[902]["n_tokens"], rows[902]["log_prob"], rows[902]["mean_log_prob"]) == (0, 0.0, None) and rows[903]["n_tokens"] == 0
    assert rows[904]["n_tokens"] == 2 and rows[905]["n_tokens"] == 30_000 and rows[905]["log_prob"] < 0
    empty = docs.limit(0)
    assert lm.score_documents(empty, lm.train_language_model(empty, lm.LmShape(classes=8, per_class=8, buckets=8))).count() == 0


def test_every_position_is_a_training_target(spark):
    docs = spark.createDataFrame([(f"a{i % 7} b c{i % 5} d",) for i in range(500)], "text string").repartition(3)
    shape = lm.LmShape(turns=3)
    net = lm._with_vocabulary(lm.word_counts(docs), shape)
    symbols = lm.encoded(docs, net, 4)
    shared = spark.sparkContext.broadcast({"shape": vars(shape), "weights": net.weights, "squares": {k: v * 0 + 1 for k, v in net.weights.items()}})
    seen = 0
    for turn in range(3):
        part = symbols.where(f"turn = {turn}").select("shard", "symbols").repartition(2, "shard").sortWithinPartitions("shard")
        copies = part.mapInArrow(lm._trained(shared, turn), "block int, bin int, shard int, weight double, values array<float>")
        seen += sum(r["weight"] for r in copies.where("block = 0").collect())
    assert seen == 2000


SMALL_NET = {"classes": 4, "per_class": 4, "buckets": 4, "dim": 4, "hidden": 6, "batch": 64, "turns": 3}


def lm_docs(spark, partitions):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(w)}" for w in rng.geometric(0.2, 30)), "x") for i in range(120)] + [(500, None, "x"), (501, "", "x"), (502, "w1 unseen w1", "y"), (502, "w1 unseen w1", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(partitions)


def test_scores_do_not_depend_on_the_partitioning_and_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 1000)
    shape, found = lm.LmShape(**SMALL_NET), []
    for partitions in (1, 5):
        docs = lm_docs(spark, partitions)
        net = lm.train_language_model(docs, shape)
        found.append({r["doc_id"]: r["log_prob"] for r in lm.score_documents(docs, net).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-6 for k in found[0])
    # The same training in plain loops over the collected symbols.
    symbols = net.trained_on[1].collect()
    plain = lm.WindowNetwork(vars(shape), net.words)
    squares = {k: np.full_like(v, 1e-4) for k, v in plain.weights.items()}
    assert len({r["shard"] for r in symbols}) == 4
    for turn in range(3):
        copies = []
        for shard in range(4):
            own = sorted((r["row"], list(r["symbols"])) for r in symbols if (r["turn"], r["shard"]) == (turn, shard) and r["n"])
            if own:
                copy = lm.Copy({"shape": vars(shape), "weights": plain.weights, "squares": squares}, turn, shard)
                for _, s in own:
                    copy.add(np.array(s, dtype=np.int32))
                copy.learn()
                copies.append(copy)
        total = sum(c.seen for c in copies)
        for name in plain.weights:
            plain.weights[name] = sum(c.net.weights[name] * (c.seen / total) for c in copies).astype(np.float32)
            squares[name] = sum(c.squares[name] * (c.seen / total) for c in copies).astype(np.float32)
    counts = {}
    for r in lm_docs(spark, 1).collect():
        for w in (r["text"] or "").split():
            counts[w] = counts.get(w, 0) + 1
    for r in lm_docs(spark, 1).collect():
        words = (r["text"] or "").split()
        line, at = plain.laid_out([net.symbols((r["text"] or "").encode())])
        rare = [w for w in words if w.encode() not in net.words]
        more = sum(np.log(counts[w]) - np.log1p(net.totals[zlib.crc32(w.encode()) % 4]) for w in rare)
        assert abs(found[1][r["doc_id"]] - (plain.log_probabilities(line, at).sum() + more)) < 1e-3


def test_every_word_beyond_the_vocabulary_has_its_own_probability(spark):
    shape = lm.LmShape(classes=3, per_class=3, buckets=2, dim=3, hidden=4)
    rows = [(i, " ".join(f"common{k}" for k in range(6)) * 3 + f" often twice{i % 9}" + (" once" if i == 5 else "")) for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    net = lm.train_language_model(docs, shape)
    words = [w for _, t in rows for w in t.split()]
    known = {w.decode() for w in net.words}
    bucket = lambda w: zlib.crc32(w.encode()) % 2
    rare = {w: words.count(w) for w in set(words) - known}
    totals = [sum(n for w, n in rare.items() if bucket(w) == b) for b in (0, 1)]
    assert len(rare) >= 8 and list(net.totals) == totals
    asked = [*sorted(rare), "unseen", sorted(known)[0]]
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(asked + asked[:1])], "doc_id long, text string")
    for r in lm.score_documents(asked, net).collect():
        w = r["text"]
        line, at = net.laid_out([net.symbols(w.encode())])
        share = np.log(rare.get(w, 1) / (totals[bucket(w)] + 1)) if w not in known else 0
        assert abs(r["log_prob"] - net.log_probabilities(line, at)[0] - share) < 1e-6


def test_the_vocabulary_grows_with_the_distinct_words(spark):
    assert lm.LmShape().grown(70_000) == lm.LmShape()
    sizes = [lm.LmShape().grown(n).words for n in (70_000, 10**6, 10**8)]
    assert sizes[1] > 3 * sizes[0] and sizes[2] > 9 * sizes[1]
    docs = spark.range(120_000).selectExpr("id AS doc_id", "concat('w', id) AS text")
    assert len(lm._with_vocabulary(lm.word_counts(docs), lm.LmShape().grown(120_000)).words) > 2_400


def test_language_model_query_equals_a_plain_score(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op2_lm_score(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text")
    net = lm.train_language_model(docs.repartition(3))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert rows.keys() == texts.keys()
    counts = {r["word"]: r["n"] for r in net.counts.collect()}
    for i in sorted(texts)[:40]:
        symbols, lp, rare = net.encode(texts[i].encode())
        line, at = net.laid_out([symbols])
        want = net.log_probabilities(line, at).sum() + lp + sum(np.log(counts.get(w.decode(), 1)) for w in rare.split())
        assert rows[i]["n_tokens"] == len(symbols) and abs(rows[i]["log_prob"] - want) < 1e-3 * max(1, abs(want))


# Personal data


def brute_entities(text):
    text = text or ""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        total = 0
        for i, d in enumerate(reversed(digits)):
            v = int(d) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    ok = {
        "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d), "phone": lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(pii.KINDS) for m in re.finditer(patterns[kind], text) if ok[kind](m.group())]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def base_spans(spans):
    return [s for s in spans.split(",") if s and not s.startswith("term:")]


def test_personal_data_query_equals_brute_force(spark, sf):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op3_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_entities(texts[r["doc_id"]])
        assert base_spans(r["spans"]) == want and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert all(r[f"n_{k}"] == sum(w.startswith(k) for w in want) for k in pii.KINDS)


ODD_TEXTS = [
    None, "", "a@b.c@d.e.f", "x@y.z%w@v.u.", "😀é a.b+c@d-e.f-g.h, next@q.r", "1.2.3.4.5.6.7.8 and 256.1.1.1 00255.0.0.1 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111 x 41111111111111110000000",
    "+1 (555) 123-4567", "+1234567890123456 +12 34.56(78)90", "+1+2 345 678 9012", "0 " * 5_000, "9" * 30_000, "a" * 50_000, "a@" + "b." * 20_000 + "c", "1." * 20_000, "((((" * 5_000 + "+1" + "(" * 20_000, "79927398713 4 5 6", "12 a@b.c 4111111111111111@x.y",
]


def test_personal_data_of_odd_texts(spark):
    docs = spark.createDataFrame([(i if i != 4 else None, t, "v") for i, t in enumerate(ODD_TEXTS)] + [(4, ODD_TEXTS[9], "v")] * 2, "doc_id long, text string, Spans string")
    rows = pii.find_personal_data(docs).select("doc_id", pii.span_text(pii.F.col("spans")).alias("spans")).collect()
    want = [(i if i != 4 else None, t) for i, t in enumerate(ODD_TEXTS)] + [(4, ODD_TEXTS[9])] * 2
    assert sorted(str((r["doc_id"], base_spans(r["spans"]))) for r in rows) == sorted(str((i, brute_entities(t))) for i, t in want)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "[EMAIL]@d.e.f" and clean[9] == "[PHONE]" and clean[13] == "9" * 30_000
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.sanitise(docs).columns == docs.columns


def test_terms_that_give_an_entity_away_are_found_as_by_hand(spark):
    rows = [(i, f"The zebrafold clinic, {'Common words here'} wrote to ann@x.org about the matter") for i in range(4)]
    rows += [(10 + i, f"nothing but the common words here and a matter of {i}") for i in range(40)] + [(60, "zebrafold alone"), (61, "call ann@x.org"), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = pii.Disclosure(near=60, support=3, generalise=0.5, remove=0.9)
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, rule).collect()}
    n, n_e = len(rows), 5
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    tells = {}
    for term in words(rows[0][1][: rows[0][1].index("ann@")]) | {"about", "the", "matter"}:
        df = sum(term in words(t) for _, t in rows)
        tells[term] = np.log(4 * n / (n_e * df)) / np.log(n / n_e)
    text = rows[0][1]
    got = {text[s["start"] : s["end"]].lower(): s["disclosure"] for s in found[0] if s["kind"] == "term"}
    assert got.keys() == {t for t, d in tells.items() if d >= 0.5} and all(abs(got[t] - tells[t]) < 1e-9 for t in got) and "clinic" in got and "the" not in got
    assert [s["kind"] for s in found[61]] == ["email"] and not found[60] and not found[62]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, rule).collect()}
    assert "clinic" not in clean[0] and "[EMAIL]" in clean[0] and "The " in clean[0] and clean[60] == "zebrafold alone" and clean[62] is None


def test_repeated_rows_change_no_span(spark):
    rows = [(i, f"Zebrafold wrote to ann@x.org about {'it' if i % 2 else 'that'}") for i in range(4)] + [(10 + i, f"about it and that, number {i}") for i in range(30)] + [(None, "zebrafold or ann@x.org"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = docs
    for _ in range(7):
        again = again.unionByName(docs)
    once, often = [sorted({str((r["doc_id"], r["spans"])) for r in pii.find_personal_data(d, pii.Disclosure(generalise=0.6)).select("doc_id", pii.span_text(pii.F.col("spans")).alias("spans")).collect()}) for d in (docs, again)]
    assert once == often and any("term" in r for r in once)


def test_thousands_of_entities_in_one_text(spark):
    text = " ".join(f"😀 Name{i} user{i}@host{i % 7}.org, 4111 1111 1111 1111!" for i in range(1_500))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string")
    rows = pii.find_personal_data(docs).collect()
    assert all(base_spans(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"])) == brute_entities(text) for r in rows)
    clean = pii.sanitise(docs).first()["text"]
    assert clean.count("[EMAIL]") == clean.count("[CARD]") == 1_500 and "@" not in clean and "4111" not in clean
    assert re.sub(r"\[TERM\]|Name\d+", "", clean).startswith("😀  [EMAIL], [CARD]!")


def test_telling_terms_are_marked_at_any_distance_from_the_entity(spark):
    far = "filler words " * 3_000
    rows = [(i, f"{'ZebraFold 😀' if i == 2 else 'Report'} {far if i < 4 else ''}zebrafold wrote to ann@x.org{' ' + far + 'signed Zebrafold' if i == 3 else ''}") for i in range(5)]
    rows += [(5, f"zebrafold. {far} ann@x.org"), (6, f"zebrafold zebrafoldy {far}"), (None, f"ann@x.org {far} ZEBRAFOLD")] + [(10 + i, f"Report filler words signed wrote to {i}") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[2:3], "doc_id long, text string")
    found = pii.find_personal_data(docs, pii.Disclosure(generalise=0.7)).collect()
    assert len(found) == len(rows) + 1
    texts = dict(rows)
    for r in found:
        want = [m.span() for m in re.finditer(r"(?i)\bzebrafold\b", texts[r["doc_id"]])] if "ann@" in texts[r["doc_id"]] else []
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"] == want
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, pii.Disclosure(generalise=0.7)).collect()}
    assert all(("zebrafold" in t.lower()) == (i == 6) for i, t in clean.items())


# Mixing


def fill(sizes, weights, total):
    """Reshare what is above twice a source's size until none is."""
    target, capped = {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        level = rest / max(1e-9, sum(weights[s] for s in sizes if s not in capped))
        over = {s for s in sizes if s not in capped and level * weights[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= over


def check_mix(docs, rows, tolerance):
    sizes = {}
    for _, source, text in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()))
    source_of = {}
    for i, s, t in docs:
        source_of.setdefault(i, []).append((s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    assert len(rows) == len(docs)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s, size = next(x for x in source_of[r["doc_id"]] if x[1] == r["size"] and sizes[x[0]] == r["source_size"])
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r["taken"] <= 2 * size
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= tolerance(target[s]), (s, taken[s], target[s])


def test_mix_query_meets_its_targets_and_reruns_agree(spark, sf):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in table(spark, sf, "documents").collect()]
    rows = queries.op4_mix_sources(spark, sf).collect()
    check_mix(docs, rows, lambda t: 64)
    assert sorted(rows) == sorted(queries.op4_mix_sources(spark, sf).collect())


def mix_rows():
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(600)]
    return rows + [(1000, None, "a b c"), (1001, None, None), (None, "é", "one two"), (1002, "", ""), (1003, "Z", "long " * 30_000), (1004, "s1", "x y z"), (1004, "s1", "x y z")]


def test_mix_of_odd_rows_over_many_shards(spark):
    docs = mix_rows()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, Size int")
    plan = mixing.MixPlan(block_words=8, shard_slots=256)
    mixture = mixing.mix(frame, plan)
    check_mix(docs, mixing.words_taken(mixture).collect(), lambda t: 8)
    slots = mixture.slots.collect()
    assert len({(s["shard"], s["slot"]) for s in slots}) == len(slots) == sum(r["quota"] for r in mixture.sources.collect())
    assert max(s["shard"] for s in slots) > 10 and {s["slot"] for s in slots if s["shard"] == 0} == set(range(256))
    assert len({(s["source_no"], s["pass_no"], s["block"]) for s in slots}) == len(slots)  # each pass takes a block once
    assert mixing.words_taken(mixing.mix(frame.limit(0))).count() == 0
    assert [r["taken"] for r in mixing.words_taken(mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string"))).collect()] == [0]


def test_mixed_texts_are_the_words_of_their_blocks(spark):
    docs = [(i, f"s{i % 2}", " ".join(f"d{i}w{k}" for k in range(i % 23))) for i in range(100)]
    mixture = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), mixing.MixPlan(block_words=16, shard_slots=32), with_text=True)
    rows = mixture.texts().collect()
    assert len(rows) == mixture.slots.count()
    words = {}
    for r in rows:
        got = r["text"].split(" ")
        assert len(got) == r["n_words"] <= 16 and {int(w[1:].split("w")[0]) for w in got} == set(r["doc_ids"])
        for w in got:
            words[w] = words.get(w, 0) + 1
    assert max(words.values()) <= 2
    full = {s["source_no"]: s for s in mixture.sources.collect()}
    assert sum(words.values()) <= sum(s["target"] for s in full.values()) + 32


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100])
def test_permutations(spark, size):
    rows = mixing.permuted(spark.range(size).withColumn("n", mixing.F.lit(size).cast("long")), "id", "n", [mixing.F.lit(5)], "to").collect()
    assert sorted(r["to"] for r in rows) == list(range(size))


# Pipeline


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    docs = table(spark, sf, "documents").collect()
    kept = {r["doc_id"] for r in queries.op10_toxicity(spark, sf).collect() if r["predicted"] == 0}
    rest = table(spark, sf, "documents").where(simhash.F.col("doc_id").isin(list(kept)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, rest, sf)
        assert after.columns == rest.columns, name
    firsts = {r["component_id"] for r in simhash.simhash_components(rest).collect()}
    alone = rest.where(simhash.F.col("doc_id").isin(list(firsts)))
    clean = decontaminate.find_contamination(alone, table(spark, sf, "benchmark")).where("not contaminated")
    want = {r["doc_id"]: r["text"] for r in pii.sanitise(clean.select(*rest.columns)).collect()}
    assert len(want) < len(docs)
    rows = corpus_pipeline.run(spark, sf).collect()
    used = {i for r in rows for i in r["doc_ids"]}
    assert used <= set(want)
    words = {}
    for r in rows:
        for w in r["text"].split(" "):
            words[w] = words.get(w, 0) + 1
    source = {}
    for t in want.values():
        for w in re.findall(r"[^\x20\x09-\x0D]+", t):
            source[w] = source.get(w, 0) + 1
    assert all(n <= 2 * source[w] for w, n in words.items())
    assert abs(sum(words.values()) - 1.5 * sum(source.values())) <= 64 * 40


def test_stages_keep_odd_rows_without_crashing(spark, sf):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "a b c " * 5_000, "en", "a", 9), (2, "a b c " * 5_000, "en", "a", 9), (3, "mail me: x@y.org", None, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((docs, 3), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame, sf)
        assert frame.count() == n and frame.columns == docs.columns
        corpus_pipeline.STAGES[4][1](spark, frame, sf).collect()
