"""The registered queries of this subpackage: thin digests over the operators' real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import chat, decontaminate, lattice, licenses, lm, mixing, negatives, pii, repair, simhash, tokens, toxicity, urls
from panelforge.llm.common import staged, table, text_or_empty

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_documents(docs, lm.train_language_model(docs)).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM_KIND)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, urls.HOST_RULES, urls.PATTERNS)
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    size = F.octet_length(text_or_empty("text")).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.embedding_links(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = staged(chat.linear_replies(rows.unionByName(own)), "chat-messages")
    out = chat.format_conversations(messages).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said_back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_back, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = toxicity.train_tagger(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(docs, tagger)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, chosen by the checksum of ``conv_id:turn``; nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fault.alias("fault")).where(F.col("fault") != 0)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair.repair_conversations(damaged(rows))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    parts = repaired.pieces.where(F.size("messages") > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", lines.alias("lines")))).alias("parts"))
    said = parts.select(F.col("conv_id").alias("s"), F.array_join("parts.lines", "\n").alias("said"))
    facts = repaired.facts.withColumnRenamed("conv_id", "f")
    out = rows.select("conv_id").distinct().join(facts, F.col("conv_id").eqNullSafe(F.col("f")), "left").join(said, F.col("conv_id").eqNullSafe(F.col("s")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("said", F.lit("")), 256).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, label)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["word"].cast("long"))
    own = F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_personal_data": op3_personal_data,
    "op4_mix_sources": op4_mix_sources,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_license_scan": op13_license_scan,
}
