"""Conversation repair, hard negatives and licence scans against enumeration and brute force."""

import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import licenses, negatives, queries, repair
from panelforge.llm.common import table

ROWS = "conv_id long, turn long, role string, text string, cost string, Messages int"

# Conversation repair


def enumerated(pattern):
    """The cheapest edits by trying all of them, with up to two insertions before and after each row."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = [["D"] if fault == "x" else ["D", "K", "u", "a"] for _, fault, _ in pattern]
    for edits in itertools.product(*choices):
        for more in itertools.product(inserts, repeat=len(pattern) + 1):
            roles = audit = ""
            cost = 0
            for k, (initial, fault, copies) in enumerate(pattern):
                roles, audit, cost = roles + more[k], audit + "I" * len(more[k]), cost + 2 * len(more[k])
                e = edits[k]
                roles += "" if e == "D" else (initial or "?") if e == "K" else e
                cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and fault == "t") + 3 * (copies - 1)
                audit += (e if e in "DK" else "R") + "D" * (copies - 1)
            roles, audit, cost = roles + more[-1], audit + "I" * len(more[-1]), cost + 2 * len(more[-1])
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


PATTERN = st.lists(st.tuples(st.sampled_from("sua") | st.just(""), st.sampled_from(["", "", "t", "x"]), st.sampled_from([1, 1, 2])), max_size=4)


def tables(pattern, cuts):
    bounds = [0, *sorted(cuts), len(pattern)]
    return [[{"start": s, "end": q, "cost": c, "audit": w} for s in repair.NEXT for q, (c, w) in repair.lightest(tuple(pattern[a:b]), s).items()] for a, b in zip(bounds, bounds[1:]) if b > a]


@settings(max_examples=60, deadline=None)
@given(PATTERN, st.sets(st.integers(0, 4)))
def test_the_agenda_finds_the_cheapest_edits_with_the_least_audit(pattern, cuts):
    cost, audit, path = repair.joined(tables(pattern, {c for c in cuts if c <= len(pattern)}))
    assert (cost, audit) == enumerated(pattern) and "".join(w for _, _, w in path) == audit


def plain_repair(rows):
    """Facts of one conversation's rows (turn, role, text), which are in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, pattern, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        pattern.append((role[:1] if role[:1] in ("s", "u", "a") else "", {"": "", "truncated": "t"}.get(fault, "x"), 1))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, _ = repair.joined(tables(pattern, set()))
    return {"n_rows": len(rows), "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **count, "illegal": illegal, "cost": cost, "audit": audit}


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "Because of this"), (1, 5, "assistant", "Because of this"), (1, 5, "assistant", "Because of this"), (1, 6, "user", ""),
    (2, None, None, None), (2, None, "user", "a. \t\n"), (2, 3, "tool", "x" * 50_000 + "."), (3, 7, "", " "), (None, 1, "user", "Hm."), (None, 1, "assistant", "Yes!"),
    *[(4, t, "user" if t % 2 else "assistant", f"row {t}.") for t in range(1, 40)], *[(5, 1, "user", "same.")] * 9, *[(6, None, "useless", f"{t}?") for t in range(9)],
]


@pytest.mark.parametrize("piece", [2, 256])
def test_odd_conversations_whole_and_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    done = repair.repair_conversations(spark.createDataFrame([(*r, "clash", 1) for r in ODD], ROWS).repartition(5))
    facts = {r["conv_id"]: r.asDict() for r in done.facts.collect()}
    assert set(facts) == {1, 2, 3, 4, 5, 6, None}
    for conv, got in facts.items():
        assert {k: v for k, v in got.items() if k != "conv_id"} == plain_repair([r[1:] for r in ODD if r[0] == conv])
    messages = done.messages().orderBy("conv_id", "piece", "at").collect()
    for conv in facts:
        own = [m for m in messages if m["conv_id"] == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(m["role"][:1] for m in own))
        assert "".join(m["edit"] for m in own) == facts[conv]["audit"].replace("D", "")
        assert all(m["text"] == "" for m in own if m["edit"] == "I") and all(m["role"] in ("user", "assistant") for m in own if m["edit"] != "K")
    assert [m["text"] for m in messages if m["conv_id"] is None] == ["Yes!", "Hm."] or {m["text"] for m in messages if m["conv_id"] is None} >= {"Hm.", "Yes!"}


def test_no_conversations(spark):
    done = repair.repair_conversations(spark.createDataFrame([], ROWS))
    assert done.facts.count() == 0 and done.messages().count() == 0


def test_damage_follows_the_checksum(spark, sf):
    rows = table(spark, sf, "conversations")
    kept = queries.damaged(rows).groupBy("conv_id", "turn").count().collect()
    fate = {(r["conv_id"], r["turn"]): zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20 for r in rows.collect()}
    assert {(r["conv_id"], r["turn"]): r["count"] for r in kept} == {k: 2 if v == 3 else 1 for k, v in fate.items() if v}


# Hard negatives


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=dims)))
    place = negatives.hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute_negatives(rows, every, scale=256):
    """rows: (vec_id, label, vector)."""
    usable = [(i, lab, [int(np.floor(float(scale) * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, q in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r)), j, other) for j, other, r in usable if len(r) == len(q))
        for lost, j, _ in [s for s in scored if s[2] == lab and s[1] != i][:5]:
            fits = [s for s in scored if s[2] != lab and 80 * -lost <= 100 * -s[0] <= 100 * -lost][:5]
            out += [(i, j, k + 1, n, -lost, -low) for k, (low, n, _) in enumerate(fits)]
    return sorted(out)


def odd_vectors(seed, n=300, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, d))
    rows = [(i, int(rng.integers(0, 3)), np.round(centres[rng.integers(0, 4)] + rng.standard_normal(d) * 0.3, 1).tolist()) for i in range(n)]
    rows += [(None, 1, [1.0] * d), (1001, None, [1.0] * d), (1002, 1, None), (1003, 2, [None] * d), (1010, 2, [float("nan")] * d), (1020, 2, [float("inf")] * d), (1030, 0, [0.0] * d), (1040, 0, []), (1050, 1, [1.0, 2.0]), (1061, 0, [1.0, 2.0])]
    return rows + rows[20:25] + [(i, 1 - lab, v) for i, lab, v in rows[30:50] if lab < 2]


@pytest.mark.parametrize("block,per_pass", [(7, 16384), (256, 10)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, per_pass):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = odd_vectors(3)
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, label int, embedding array<double>, q double").repartition(3)
    got = negatives.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, anchors_per_pass=per_pass)
    want = brute_negatives(rows, 10)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_scores_beyond_doubles_stay_exact(spark):
    rows = [(i, i % 2, [float(2**21 + i), float(2**20 - 3 * i), float(i)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in negatives.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()) == brute_negatives(rows, 10)


def test_no_vectors_and_no_anchors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine_hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    some = spark.createDataFrame([(1, 1, [1.0]), (3, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine_hard_negatives(some, F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_leave_out_far_blocks(spark):
    """Two tight clouds far apart: an anchor's windows read only blocks of its own cloud."""
    rng = np.random.default_rng(5)
    near, far = np.array([8.0, 0, 0, 0]), np.array([0, 0, 0, -8.0])
    held = {"row": np.array([0]), "ids": np.array([0]), "labels": np.array([1]), "home": np.array([0]), "q": np.array([[800, 0, 0, 0]]), "low": np.array([[500_000]]), "high": np.array([[700_000]]), "mode": "other"}
    search = negatives.Search(held, 5)
    for centre, wanted in ((near, 1), (far, 0)):
        q = np.floor(100 * (centre + rng.uniform(-0.5, 0.5, (50, 4)))).astype(np.int64)
        assert len(search.wanted(9, 2, q.min(axis=0), q.max(axis=0))) == wanted
    assert len(search.wanted(9, 1, np.full(4, -900), np.full(4, 900))) == 0


# Licence scans


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode() if text is None or text.isascii() else "".join(c.lower() if c.isascii() else c for c in text).encode())


def fewest_edits(phrase, words):
    """Fewest edits between a phrase and any run of whole words joined by spaces."""
    text = " ".join(words)
    starts = {0} | {i + 1 for i, c in enumerate(text) if c == " "}
    ends = {i for i, c in enumerate(text) if c == " "} | {len(text)}
    row = [0 if j in starts else 10**6 for j in range(len(text) + 1)]
    for i, c in enumerate(phrase, 1):
        new = [row[0] + 1]
        for j in range(1, len(text) + 1):
            new.append(min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[-1] + 1))
        row = new
    return min((row[j] for j in ends), default=10**6)


SMALL = [("gnu general public license", "gpl2", 2), ("all rights reserved", "own", 1), ("boost software license version", "boost", 3)]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_a_notice_is_found_exactly_if_its_edits_are_within_the_budget(data):
    scanner = licenses.NoticeScanner([(p, lab, e, False) for p, lab, e in SMALL])
    text = list(data.draw(st.sampled_from(["xx ", "", "all ", "general "])) + data.draw(st.sampled_from([p for p, _, _ in SMALL])) + data.draw(st.sampled_from([" yy", "", "s", " reserved", " license"])))
    for _ in range(data.draw(st.integers(0, 4))):
        at = data.draw(st.integers(0, max(0, len(text) - 1)))
        if text:
            text[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "q", "e", " ", "l"]))
    words = "".join(text).split()
    found = {k: edits for k, _, _, edits in scanner.scan(" ".join(words))}
    for k, (phrase, _, errors) in enumerate(SMALL):
        fewest = fewest_edits(phrase, words)
        assert (k in found) == (fewest <= errors), (words, phrase, fewest)


NOTES = [
    (1, "Released under the MIT License. Apache\n license, MIT-license mit license licenses", "x"), (2, None, "y"), (3, "", None), (None, "GENERAL publıc license; General Public... License!", "z"),
    (4, "mit " * 20_000 + "license", "z"), (4, "mit " * 20_000 + "license", "z"), (5, "gnu generel publik license ÄÖ gnu general public license", ""), (6, "submit license admit license mit licenses", ""),
    (7, "日本語 permission is hereby grunted, free of charge, to any persn obtaining a copy", ""),
]


def plain_base(text):
    words = [w.decode() for w in words_of(text)]
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_odd_texts_and_spans(spark):
    rows = licenses.scan_licenses(spark.createDataFrame(NOTES, "doc_id long, text string, Labels string")).collect()
    assert len(rows) == len(NOTES) and set(rows[0].asDict()) == {"doc_id", "text", "n_words", "spans", "labels", "score"}
    for r in rows:
        base = [s for s in r["spans"] if s["base"]]
        starts = [s["word"] for s in base]
        assert (r["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s["label"] for s in base}))) == plain_base(r["text"])
        assert all(words_of(r["text"][s["start"] : s["end"]]) == words_of(r["text"])[s["word"] :][: len(words_of(r["text"][s["start"] : s["end"]]))] for s in r["spans"])
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["spans"])
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["labels"] == ["mit"] and by_id[7]["spans"][0]["edits"] == 2 and by_id[7]["spans"][0]["start"] == 4
    assert [s["edits"] for s in by_id[5]["spans"] if s["size"] == 26] == [2, 0] and by_id[6]["spans"] == []
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_bad_phrase_is_an_error(spark):
    for notice in (("Two  Words", "x", 0), ("ab", "x", 2), ("", "x", 0)):
        with pytest.raises(ValueError):
            licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), [], [notice])


def test_license_query_against_a_plain_scan(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op13_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_base"] for r in rows) > 0
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        if r["labels"] != r["base_labels"] or r["n_base"] == 0:
            words = [w.decode() for w in words_of(texts[r["doc_id"]])]
            if len(words) < 300:
                own = {label for phrase, label, errors in licenses.NOTICES if fewest_edits(phrase, words) <= errors}
                assert set(r["labels"].split(",")) - {""} == own | (set(r["base_labels"].split(",")) - {""})
