"""Mixing sources to target weights, with DataFrame functions only.

The words of each source's documents are laid end to end in a fixed pseudorandom order and cut into blocks of ``block_words``
words. The mix is a table of slots, ``shard_slots`` to an output shard; each slot draws its source, so a shard's source counts are one
multinomial draw. The k-th slot that a source gets over all shards takes the block that a pseudorandom permutation
of the source's block numbers puts at k (a new permutation for each pass over the source), and blocks are joined by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the swap-or-not shuffle (Hoang, Morris and Rogaway 2012) behind each permutation.
ROUNDS = 16
#: Tables with one narrow row per source are broadcast up to this many rows.
BROADCAST_SOURCES = 50_000
#: Slots that a task expands and permutes.
SLOTS_PER_TASK = 250_000


@dataclass(frozen=True)
class MixPlan:
    """Weights repeat over the sources in code point order (null last); ``share`` of all words is drawn; no source gives more than ``most`` times its size."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 64
    shard_slots: int = 1 << 16
    seed: int = 11


@dataclass(frozen=True)
class Mixture:
    """``sources``: source_no, source, size, target, blocks, quota. ``documents``: one row per input row with its place in its source.

    ``pieces``: source_no, block, place, n_words and what documents give to blocks. ``slots``: shard, slot, source_no, pass_no, block.
    """

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def texts(self) -> DataFrame:
        """shard, slot, source, pass_no, block, doc_ids, n_words, text: the mix itself, one row per slot. Needs pieces with text."""
        parts = F.sort_array(F.collect_list(F.struct("place", "doc_id", "n_words", "piece")))
        blocks = self.pieces.groupBy("source_no", "block").agg(parts.alias("parts"))
        blocks = blocks.select("source_no", "block", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n_words"]).alias("n_words"), F.array_join(F.transform("parts", lambda p: p["piece"]), " ").alias("text"))
        named = self.slots.join(blocks, ["source_no", "block"]).join(self.sources.select("source_no", "source"), "source_no")
        return named.select("shard", "slot", "source", "pass_no", "block", "doc_ids", "n_words", "text")


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """Adds source_no, target and cap to a table of sources (source, size): words by weight, held at ``most`` times the size.

    The excess of capped sources goes to the others by weight until none is above. That ends where every source has
    min(cap, level * weight) for one level; sources are sorted by cap per weight, and the level is the first one
    that does not cap the source it is worked out at. The table has one row per source, so its windows are small.
    """
    whole = Window.partitionBy(F.lit(0))
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    t = sizes.withColumn("source_no", (F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    t = t.withColumn("weight", F.element_at(weights, (F.col("source_no") % len(plan.weights) + 1).cast("int")))
    t = t.withColumn("cap", (plan.most * F.col("size")).cast("double")).withColumn("wanted", plan.share * F.sum("size").over(whole))
    by_ratio = whole.orderBy(F.col("cap") / F.col("weight"), "source_no")
    capped = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    level = (F.col("wanted") - capped) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", level)
    t = t.withColumn("fits", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level")))
    t = t.withColumn("target", F.least("cap", F.min("fits").over(whole)["level"] * F.col("weight")))
    return t.drop("weight", "wanted", "place", "level", "fits")


def permuted(df: DataFrame, place: str, size: str, key: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: the image of ``place`` under a pseudorandom permutation of 0 .. ``size`` - 1 chosen by ``key``.

    Swap-or-not works for every size: a round pairs each number with its mirror about a random point and swaps the
    pair or not by a hash of its larger member, which is a bijection.
    """
    n = F.col(size)

    def swap_or_not(v: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - v, n)
        return F.when(F.xxhash64(*key, -1 - r, F.greatest(v, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(v)

    # A fold over the rounds: as nested expressions the rounds would multiply.
    return df.withColumn(out, F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col(place).cast("long"), swap_or_not))


def _per_source(sources: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(sources) if rows <= BROADCAST_SOURCES else sources


def _draw_slots(sources: DataFrame, n_sources: int, n_slots: int, plan: MixPlan) -> DataFrame:
    """shard, slot, source_no, pass_no, block of every slot."""
    spark = sources.sparkSession
    ranges = sources.where(F.col("quota") > 0)
    cell = max(1, n_slots // (4 * n_sources))
    first, last = F.floor(F.col("low") / cell), F.floor((F.col("low") + F.col("quota") - 1) / cell)
    cells = ranges.select("source_no", "low", "quota", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("cell"))
    draws = spark.range(n_slots).select((F.col("id") / plan.shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(plan.seed), "id"), F.lit(n_slots)).alias("draw"))
    draws = draws.withColumn("cell", F.floor(F.col("draw") / cell).cast("long")).join(_per_source(cells, 5 * n_sources), "cell")
    draws = draws.where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("low") + F.col("quota")))
    # Each shard's multinomial counts, and where a source's slots of a shard begin among all its slots.
    counts = draws.groupBy("shard", "source_no").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    counts = staged(counts.withColumn("in_shard", F.sum("n").over(Window.partitionBy("shard"))), "mix-counts")
    drawn = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    # Slots beyond a source's quota go, in order, to the sources that were drawn too seldom.
    whole = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    table = sources.join(drawn, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    table = table.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    table = table.withColumn("over_begin", F.coalesce(F.sum("over").over(whole), F.lit(0))).withColumn("under_begin", F.coalesce(F.sum("under").over(whole), F.lit(0)))
    table = staged(table.select("source_no", "quota", "blocks", "drawn", "under", "over_begin", "under_begin"), "mix-sources")
    # A row of counts stands for many slots: as many tasks as the slots ask for, not as the counts do.
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_slots // SLOTS_PER_TASK))
    slots = counts.repartition(tasks, "shard", "source_no").select("shard", "source_no", "in_shard", "inside", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    slots = slots.select("shard", "source_no", "in_shard", (F.col("inside") + F.col("i")).alias("order"), (F.col("begin") + F.col("i")).alias("rank"))
    slots = slots.join(_per_source(table.select("source_no", "quota", "over_begin"), n_sources), "source_no")
    kept = slots.where(F.col("rank") < F.col("quota")).select("shard", "in_shard", "order", "source_no", "rank")
    moved = slots.where(F.col("rank") >= F.col("quota")).select("shard", "in_shard", "order", (F.col("over_begin") + F.col("rank") - F.col("quota")).alias("spare"))
    wanting = table.where(F.col("under") > 0).select("source_no", "drawn", "under_begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"))
    wanting = wanting.select("source_no", (F.col("drawn") + F.col("i")).alias("rank"), (F.col("under_begin") + F.col("i")).alias("spare"))
    kept = kept.unionByName(moved.join(wanting, "spare").select("shard", "in_shard", "order", "source_no", "rank"))
    kept = kept.join(_per_source(table.select("source_no", "blocks"), n_sources), "source_no")
    kept = kept.withColumn("pass_no", F.floor(F.col("rank") / F.col("blocks")).cast("long")).withColumn("within", F.col("rank") % F.col("blocks"))
    kept = permuted(kept, "within", "blocks", [F.lit(plan.seed), F.col("source_no"), F.col("pass_no")], "block")
    kept = permuted(kept, "order", "in_shard", [F.lit(plan.seed), F.col("shard"), F.lit("shard")], "slot")
    return kept.select("shard", "slot", "source_no", "pass_no", "block")


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), doc_id: str = "doc_id", source: str = "source", text: str = "text", with_text: bool = False) -> Mixture:
    """Plan the mix of all ``docs``. Sizes are numbers of words; null texts and null sources count (0 words, a source of its own).

    Documents of a source are ordered by a hash of id and text. Their places are running sums in two steps, over about
    sqrt(n) buckets and over about sqrt(n) documents in each, so a source of any share of the rows is never one group.
    Each block is drawn at most ``most`` times, and each source exactly as often as its target asks, to the block: draws
    beyond that are passed to sources drawn too seldom. Draws and permutations are hashes, so reruns agree.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), text_or_empty(text).alias("text"))
    rows = rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"), *(["text"] if with_text else []))
    rows = staged(rows, "mix-documents")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs"))
    b = plan.block_words
    sources = source_targets(sizes, plan).withColumn("blocks", F.ceil(F.col("size") / b).cast("long"))
    asked = F.round(F.col("target") / F.greatest("size", F.lit(1)) * F.col("blocks")).cast("long")
    sources = sources.withColumn("quota", F.least(asked, plan.most * F.col("blocks")))
    before = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("low", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    sources = staged(sources.withColumn("buckets", F.ceil(F.sqrt("n_docs")).cast("long")), "mix-targets")
    n_sources, n_slots = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    facts = _per_source(sources.select(F.col("source").alias("s"), "source_no", F.col("size").alias("source_size"), "target", "buckets"), n_sources)
    placed = rows.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod("h", F.col("buckets")))
    buckets = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source_no", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_begin"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(buckets, ["source_no", "bucket"])
    placed = placed.withColumn("begin", F.col("bucket_begin") + F.col("upto") - F.col("size"))
    placed = placed.select("doc_id", "source", "source_no", "size", "source_size", "target", "h", "begin", *(["text"] if with_text else []))
    end = F.col("begin") + F.col("size")
    first, last = F.floor(F.col("begin") / b).cast("long"), F.floor((end - 1) / b).cast("long")
    start_in = lambda k: F.greatest(F.col("begin"), k * b) - F.col("begin")
    length = lambda k: F.least(end, (k + 1) * b) - F.greatest(F.col("begin"), k * b)

    def piece(k: Column) -> Column:
        fields = [k.alias("block"), (F.col("begin") + start_in(k)).alias("place"), length(k).alias("n_words")]
        if with_text:
            fields.append(F.array_join(F.slice(F.col("all_words"), (start_in(k) + 1).cast("int"), length(k).cast("int")), " ").alias("piece"))
        return F.struct(*fields)

    filled = placed.where(F.col("size") > 0)
    if with_text:
        filled = filled.withColumn("all_words", F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))
    pieces = filled.select("source_no", "doc_id", "begin", "size", "source_size", "target", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    pieces = pieces.select("source_no", "doc_id", "begin", "size", "source_size", "target", "p.*")
    if n_slots:
        slots = _draw_slots(sources, n_sources, n_slots, plan)
    else:
        slots = docs.sparkSession.createDataFrame([], "shard long, slot long, source_no long, pass_no long, block long")
    return Mixture(sources, placed, pieces, slots)


def words_taken(mixture: Mixture) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: the words that the slots take of it, repeats counted."""
    times = mixture.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    used = mixture.pieces.join(times, ["source_no", "block"], "left")
    key = ["doc_id", "size", "source_size", "target"]
    taken = used.groupBy("source_no", "begin", *key).agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken")).select(*key, "taken")
    empty = mixture.documents.where(F.col("size") == 0).select(*key, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)
