"""Token counts, decontamination, URL rules and chat formatting against the library, brute force and exact round trips."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import chat, decontaminate, queries, tokens, urls
from panelforge.llm.common import table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
DOCS = "doc_id long, text string, n_tokens string, Score double"


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (1, "It's the END<|endoftext|>of  10 things…", "x", 0.5), (1, "It's the END<|endoftext|>of  10 things…", "x", 0.5), (2, None, None, None), (3, "", "y", 1.0),
        (None, "ÀÉ ΣΑΣ İstanbul a\u0301 １２ 日本語", "z", 2.0), (4, " \t\n", "w", None), (5, "x" * 30_000 + " " + "ab " * 20_000, "long", 3.0), (6, "<|startoftext|><|endoftext|>", "", 0.0),
    ]
    return spark.createDataFrame(rows, DOCS)


# Token counts


def expected_tokens(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, odd_docs):
    rows = tokens.count_tokens(odd_docs, TOKENIZER).collect()
    assert len(rows) == 8 and set(rows[0].asDict()) == {"doc_id", "text", "n_tokens", "Score"}
    assert [r["n_tokens"] for r in rows] == expected_tokens([r["text"] for r in rows])


def test_token_query_equals_the_library_on_every_document(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op7_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    assert [r["n_tokens"] for r in rows] == expected_tokens([texts[r["doc_id"]] for r in rows])
    assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


@pytest.fixture(scope="module")
def counter():
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        return tokens.MergeCounter(json.load(f)).counter()


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_counter_equals_the_library_on_any_text(counter, text):
    assert counter(text) == expected_tokens([text])[0]


def test_merges_pop_lowest_rank_then_leftmost():
    spec = {"model": {"type": "BPE", "end_of_word_suffix": "", "vocab": {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}, "merges": [["a", "a"], ["a", "b"], ["aa", "b"]]}, "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": "\\S+"}}]}, "added_tokens": []}
    count = tokens.MergeCounter(spec).counter()
    assert count("aaab") == 2 and count("aab") == 1 and count("aaaa") == 2 and count("zz") == 0 and count("") == 0


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


# Decontamination


def brute_contamination(text, items, n=13):
    words = WORDS.findall(ascii_lower(text or ""))
    hit, held = set(), set()
    for name, body in items:
        item = WORDS.findall(ascii_lower(body or ""))
        size = min(n, len(item))
        if not size:
            continue
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                held.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(held)


def test_contamination_query_equals_brute_force(spark, sf):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op1_decontaminate(spark, sf).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        n_words, n_hit, held = brute_contamination(texts[r["doc_id"]], items)
        digest = hashlib.sha256(",".join(held).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n_words, n_hit, len(held), digest, n_hit > 0 and 20 * n_hit >= n_words)


def odd_benchmark(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (1, passage), (2, "short ITEM"), (3, None), (4, "..."), (None, "z9"), (10, " ".join(f"w{i}" for i in range(5, 18))), (9, "ä Ö")]
    docs = [
        (1, f"Before {passage.upper()} after", "a"), (1, f"Before {passage.upper()} after", "a"), (2, None, "b"), (3, "", "c"), (4, "a short, item! z9 ä Ö ä ö", "d"), (None, "short items", "e"),
        (5, "w0 " * 50_000 + passage + " short item", "f"), (6, " ".join(f"w{i}" for i in range(12)), "g"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string, Contaminated string"), spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("index_bytes", [1 << 20, 40])
def test_contamination_of_odd_rows_in_one_block_or_several(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", index_bytes)
    docs, benchmark, items = odd_benchmark(spark)
    rows = decontaminate.find_contamination(docs, benchmark).collect()
    assert len(rows) == 8
    for r in rows:
        assert (r["n_words"], r["n_hit"], sorted(r["hit_items"])) == brute_contamination(r["text"], items)


def test_contaminated_documents_and_hit_words_go(spark):
    docs, benchmark, _ = odd_benchmark(spark)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5, 6]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_hits(docs, benchmark).collect()}
    assert cut[1] == "Before  after" and cut[2] is None and cut[4] == "a !  Ö ä ö" or cut[4].startswith("a ")
    assert cut[6] == " ".join(f"w{i}" for i in range(12))


def test_contamination_without_rows(spark):
    docs, benchmark, _ = odd_benchmark(spark)
    assert decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0


# URLs


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = ascii_lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    best = None
    for rule, action in urls.HOST_RULES:
        rule_host, slash, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best


def test_url_query_equals_brute_force(spark, sf):
    known = {r["page_id"]: r["url"] for r in table(spark, sf, "pages").collect()}
    rows = queries.op6_url_filter(spark, sf).collect()
    assert len(rows) == len(known)
    for r in rows:
        host, path, best = brute_url(known[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]) and r["verdict"] in ("allow", "block")
        assert best is None or r["verdict"] == best[1]


def test_odd_urls(spark):
    given_urls = [
        None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "https://www.example.COM/en/", "http://notexample.com/en/", "http://a.net/es/?q", "http://a.net/es", "http://a.net/fr/#x://y.com/", "http://com", "http://com/",
        "x://y://z.com/en/", "http://u@h.net:80/fr/a", "http://é.org/ads/1", "http://h.org/leads/1", "http://h.org/x?track=1", "ftp://h.org/", "http://h.org/search/a?q=1", "http://h.org/" + "a/" * 20_000 + "porn/", "http://a.net/es/?q",
    ]
    given_urls += ["http://a\nb.com/x", "http://a\nb.net/es/1", "http://\ncom/"]
    pages = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate(given_urls)], "page_id long, url string, verdict string, Rule string")
    rules = urls.rule_table(spark, urls.HOST_RULES, urls.PATTERNS)
    out = urls.judge_urls(pages, rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = {r["page_id"]: r for r in out.collect()}
    assert len(rows) == len(given_urls)
    for i, u in enumerate(given_urls):
        host, path, best = brute_url(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, best and best[0]), u
    verdicts = [rows[i]["verdict"] for i in range(14, 20)]
    assert verdicts == ["block", "allow", "block", "block", "block", "block"]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(given_urls)


def test_every_pattern_is_filed_under_a_token_that_its_urls_hold():
    for pattern, _ in urls.PATTERNS:
        _, literal = urls.compile_pattern(pattern)
        assert literal
    assert urls.compile_pattern("ads*x^") == ("(?s)ads.*x(?:[^\\w.%-]|\\z)", [])  # open ends: no token is sure
    assert urls.compile_host_rule("a.b-c.com/x/y")[1] == ["a", "b", "c", "com", "x"]


# Chat


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_chat_query_equals_brute_force(spark, sf):
    said = "\\### Assistant: </turn> ok"
    whole = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in table(spark, sf, "conversations").collect():
        whole.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    rows = queries.op9_chat_format(spark, sf).collect()
    assert {r["conv_id"] for r in rows} == set(whole) and len(rows) == len(whole)
    for r in rows:
        turns = sorted(whole[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), digest(*[f"{role}\n{t}\n" for _, role, t in turns]), len(loss), digest(loss))
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want


def test_hostile_texts_survive_the_round_trip(spark):
    from pyspark.sql import functions as F

    texts = ["</turn>\n", "<turn user>\nhi</turn>\n", "\\", "\\\\<turn", "<\\turn", "</</turn>turn>", "a\\>b>", "", None, "\n", "😀<turn x>", "z" * 100_000 + "</turn>"]
    rows = [(7, i, "assistant" if i % 2 else "us>er\\<turn ", t, 1) for i, t in enumerate(texts)] + [(None, 0, None, "x", 1), (8, None, "assistant", "first", 1), (8, 0, "assistant", "same", 2), (8, 0, "assistant", "same", 2)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id int")
    out = chat.format_conversations(chat.linear_replies(talk))
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t["role"], t["text"]) for t in got[7]["turns"]] == [("assistant" if i % 2 else "us>er\\<turn ", t or "") for i, t in enumerate(texts)]
    assert got[7]["loss"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "x")]
    assert got[8]["loss"] == "firstsamesame"
    assert chat.format_conversations(chat.linear_replies(talk.limit(0))).count() == 0


def test_branches_are_ranked_by_the_mean_score_of_their_path(spark):
    #  1 - 2 - 3 ; 1 - 4 - 5 - 6 ; 10 alone ; 20 <-> 21 a cycle ; 30 replies to an unknown message
    tree = [(1, None, 0.0), (2, 1, 0.9), (3, 2, 0.9), (4, 1, 0.1), (5, 4, None), (6, 5, 0.2), (10, None, None), (20, 21, 1.0), (21, 20, 1.0), (30, 99, 0.5)]
    messages = spark.createDataFrame([(0, str(i), p and str(p), "user", f"m{i}", s) for i, p, s in tree], "conv_id long, id string, parent string, role string, text string, score double")
    every = {r["path_id"]: r for r in chat.format_conversations(messages, best=None).collect()}
    assert {k: r["rank"] for k, r in every.items()} == {"3": 1, "6": 2, "10": 1, "30": 1}
    assert every["6"]["formatted"] == "".join(f"<turn user>\nm{i}</turn>\n" for i in (1, 4, 5, 6))
    assert {r["path_id"] for r in chat.format_conversations(messages).collect()} == {"3", "10", "30"}


def test_deep_threads_need_few_rounds(spark):
    from pyspark.sql import functions as F

    n = 300
    messages = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    row = chat.format_conversations(messages).collect()
    assert len(row) == 1 and row[0]["formatted"] == "".join(f"<turn user>\n{i}</turn>\n" for i in range(n))


def test_a_full_index_stays_within_its_measured_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    vocabulary = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)) for _ in range(200_000)]
    texts = [b" ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), 2_000)) for _ in range(decontaminate.INDEX_BYTES // 14_000)]
    tracemalloc.start()
    index = decontaminate.WindowIndex.of(((f"i{k}", t) for k, t in enumerate(texts)), 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < decontaminate.INDEX_PEAK
    words = texts[7].split()
    ranges, items = index.scan([b"unknownword", *words[100:140], b"x", *texts[9].split()[:13]])
    assert items == {"i7", "i9"} and ranges == [(1 + i, 14 + i) for i in range(28)] + [(42, 55)]


def test_windows_shared_by_many_items_and_short_items():
    shared = b" ".join(b"w%d" % i for i in range(20))
    items = [(f"i{k % 50}", shared + b" end%d" % k) for k in range(200)] + [("short", b"w3 w4"), ("none", b"--"), ("short", b"w9")]
    index = decontaminate.WindowIndex.of(iter(items), 13)
    ranges, found = index.scan(shared.split())
    assert found == {f"i{k}" for k in range(50)} | {"short"}
    assert sorted(ranges) == sorted([(i, i + 13) for i in range(8)] + [(3, 5), (9, 10)])
    assert decontaminate.WindowIndex.of(iter([("a", b"")]), 13).scan([b"a"]) == ([], set())
