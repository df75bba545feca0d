"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents form one stream of words (in a pseudorandom order), cut into blocks of a fixed length. The
mix is a list of slots, dealt to output shards; for every shard a multinomial draw says how many of its slots each
source fills. A source's slots are numbered through all shards, mapped through pseudorandom permutations of its block
indices (a new one for each pass over the source), and joined with the blocks by index.

Draws alone miss a target by about the square root of its slots. A source's slots beyond its target are therefore
left out, and what sources lack is filled into one last shard, so that every total is the rounded target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, fresh, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 65536
ROUNDS = 12
GUIDE = 1024
BUCKET_DOCS = 10_000
EXPLODE = 8192
TASK_SLOTS = 1 << 18
BROADCAST_SOURCES = 10_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``sized(source, size)`` → per source its rank, size, weight and target words.

    Sources rank by code point, null last, and weigh ``weights`` in turn. Targets are ``level * weight``, stopped at
    ``max_passes`` times the source's size; the level is the one that makes targets add up to all words. Sorted by
    the level at which they stop, sources give a candidate level each, and the largest candidate is the level.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))
    )
    every = Window.partitionBy()
    capped = ranked.withColumn("cap", F.col("source_size") * float(max_passes)).withColumn(
        "total", F.sum("source_size").over(every).cast("double")
    )
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        capped.withColumn("level", level)
        .withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
        .select("source", "rank", "weight", "source_size", "target")
    )


def _streams(sized: DataFrame, sources: DataFrame, docs: int, seed: int) -> DataFrame:
    """Adds each document's first word position in its source's stream.

    Positions come from sums in two steps (source and hash bucket, then the documents of a bucket), so no task gathers
    a whole source."""
    buckets = max(1, -(-docs // BUCKET_DOCS))
    named = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    named = named.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(buckets)))
    sums = named.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy(F.xxhash64("k1", "k2", F.lit(seed + 1)), "k1", "k2", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(starts, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop(
        "base", "inner", "bucket"
    )


def permuted(df: DataFrame, index: str, size: str, keys: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """Replaces ``index`` (0 to size - 1) by its image under a pseudorandom permutation chosen by ``keys``.

    A swap-or-not shuffle: each round pairs x with (k - x) mod size, and a hash of the pair decides whether both change
    places. It is a bijection for any size, and one row needs no other.
    """
    key = F.xxhash64(*keys)

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), F.col(size)) - x, F.col(size))
        return F.when(F.xxhash64(key, -r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    steps = F.array(*[F.lit(r) for r in range(1, rounds + 1)])
    return df.withColumn(index, F.aggregate(steps, F.col(index), swapped))


def draw_slots(sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``sources(rank, blocks, slots)`` → one row per slot of the mix: ``shard, rank, pass, block``."""
    spark = sources.sparkSession
    held = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.count("*").alias("n")).first()
    total = int(held["slots"])
    width = total // GUIDE + 1
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sources.where("slots > 0").withColumn("low", F.coalesce(F.sum("slots").over(by_rank), F.lit(0)))
    ranges = ranges.select("rank", "low", (F.col("low") + F.col("slots")).alias("high"))
    guide = ranges.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    )
    if held["n"] <= BROADCAST_SOURCES:  # then the guide has at most that many rows and GUIDE more
        guide = F.broadcast(guide)
    drawn = spark.range(total).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("u")
    ).withColumn("cell", F.floor(F.col("u") / width))
    counts = drawn.join(guide, "cell").where("u >= low AND u < high").groupBy("shard", "rank").agg(F.count("*").alias("n"))

    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(sources, "rank")
    fitted = counts.withColumn("n", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first"))))
    fitted = fitted.select("shard", "rank", "first", "n", "blocks", "slots")
    reached = fitted.groupBy("rank").agg(F.sum("n").alias("reached"))
    lacking = sources.join(reached, "rank", "left").withColumn("first", F.coalesce("reached", F.lit(0))).select(
        F.lit(-(-total // shard_slots)).cast("bigint").alias("shard"), "rank", "first",
        (F.col("slots") - F.col("first")).alias("n"), "blocks", "slots",
    )
    runs = fitted.unionByName(lacking).where("n > 0")
    # in steps, so that no array grows with the input
    runs = runs.withColumn("from", F.explode(F.sequence(F.col("first"), F.expr("first + n - 1"), F.lit(EXPLODE).cast("bigint"))))
    runs = runs.repartition(total // TASK_SLOTS + 1, "rank", "from")  # few light rows here, very many after the next step
    slots = runs.withColumn(
        "slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + EXPLODE, F.expr("first + n")) - 1))
    ).select("shard", "rank", "blocks", "slot")
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("block", F.pmod("slot", "blocks"))
    return permuted(slots, "block", "blocks", [F.lit(seed), F.col("rank"), F.col("pass")]).select(
        "shard", "rank", "pass", "block"
    )


def mix_sources(
    docs: DataFrame,
    id_cols: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 20,
) -> DataFrame:
    """Per row of ``docs``: its ``id_cols``, ``size`` (words), ``source_size``, ``target`` of its source (double) and
    ``taken``: the words of it that the mix holds, repeats counted.

    Null texts have no words, null is a source of its own, repeated rows are documents of their own, null ids are kept,
    other columns are not read, an empty table (or one without words) takes nothing. A run with the same rows and seed
    gives the same result, however the rows are partitioned.
    """
    k1, k2 = content_key(*id_cols, "source", "text")
    sized = written(
        docs.select(
            *id_cols, "source", k1.alias("k1"), k2.alias("k2"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ),
        "sized",
    )
    sources = written(
        source_targets(sized, weights, max_passes)
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("slots", F.least(F.round(F.col("target") / block_words).cast("bigint"), F.col("blocks") * max_passes)),
        "sources",
    )
    uses = draw_slots(sources, seed, shard_slots).groupBy("rank", "block").agg(F.count("*").alias("uses"))

    streams = _streams(sized, sources.select("source", "rank", "source_size", "target"), sized.count(), seed).drop("k1", "k2")
    shown = [*id_cols, "size", "source_size", "target"]
    pieces = streams.where("size > 0").withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))),
    )
    overlap = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.greatest(
        F.col("block") * block_words, F.col("start")
    )
    taken = (
        pieces.withColumn("words", overlap)
        .join(uses, ["rank", "block"], "left")
        .groupBy("rank", "start", *shown)  # a start belongs to one document with words
        .agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
        .select(*shown, "taken")
    )
    return taken.unionByName(streams.where("size = 0").select(*shown, F.lit(0).cast("bigint").alias("taken")))


def repeat_to_mix(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """``docs`` (all columns) as the mix takes them: each document whole, as often as the mix holds its words.

    The number of copies is taken / size, rounded up or down by a hash with the fraction's odds. Rows equal in
    doc_id, source and text share their copies; documents without words are not taken.
    """
    one, two = fresh(docs, "k1"), fresh(docs, "k2")
    k1, k2 = content_key("doc_id", "source", "text")
    keyed = docs.withColumn(one, k1).withColumn(two, k2)
    mixed = mix_sources(keyed, (one, two), seed=seed, **options).where("taken > 0")
    share = F.col("taken") / F.col("size")
    odds = F.pmod(F.xxhash64(one, two, "size", F.lit(seed + 2)), F.lit(1 << 40)) / float(1 << 40)
    copies = fresh(docs, "copies")
    times = mixed.select(one, two, (F.floor(share) + (odds < share - F.floor(share)).cast("bigint")).alias(copies))
    times = times.groupBy(one, two).agg(F.sum(copies).alias(copies)).where(F.col(copies) > 0)
    # of rows with one key only the first numbered copies stay, as many as the key is due
    joined = keyed.dropDuplicates([one, two]).join(times, [one, two])
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
