"""Cross-site boilerplate lines, found by the spread of each line over sites.

Every line hash gets a HyperLogLog sketch of the sites that show it, merged by aggregation (partial sketches are
built before the shuffle, so a line that a third of all documents hold costs one small sketch per map task). Lines
whose estimate lies near the threshold get an exact distinct count; the others are decided by their sketch, whose
error at that distance is beyond four standard errors.

How many sites make a line boilerplate depends on its length. Short lines (a word, a date, a closing brace) come up
anew on many sites and need ``MIN_SITES``; a line of ``LONG_WORDS`` words or more is not written twice by chance and
is boilerplate from ``LONG_SITES`` sites on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, fresh, written

MIN_SITES = 10
LONG_SITES = 2
LONG_WORDS = 20
LG_K = 12
HOT_SHARE = 1000
BLANK = " \t\r"
#: A word is a run without blanks; where words are written without blanks, two characters.
_WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{1,2}|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+"


def _line_table(docs: DataFrame) -> DataFrame:
    """One light row per non-blank line: document key, position, line hash, words and site; texts stay behind."""
    parts = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("site"),
        *_row_key(),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"),
    ).withColumn("line", F.btrim("raw", F.lit(BLANK)))
    h1, h2 = content_key("line")
    words = F.regexp_count("line", F.lit(_WORD)).alias("words")
    return parts.where("line <> ''").select("doc_id", "site", "k1", "k2", "pos", h1.alias("h1"), h2.alias("h2"), words)


def _row_key() -> list[Column]:
    k1, k2 = content_key("doc_id", "text")
    return [k1.alias("k1"), k2.alias("k2")]


def _dealt_join(lines: DataFrame, few: DataFrame, hot: DataFrame) -> DataFrame:
    """``lines`` joined with one row per line hash. The hashes of ``hot`` (``HOT_SHARE`` at most, as each holds that part
    of all lines) are broadcast, so that no task gets all occurrences of a common line."""
    key, hot = ["h1", "h2"], F.broadcast(hot)
    often = lines.join(F.broadcast(few.join(hot, key, "left_semi")), key)
    rest = lines.join(hot, key, "left_anti").join(few.join(hot, key, "left_anti"), key)
    return often.unionByName(rest)


def widespread_lines(
    lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, long_sites: int = LONG_SITES, long_words: int = LONG_WORDS
) -> tuple[DataFrame, DataFrame]:
    """From ``lines(h1, h2, site, words)``, line hashes ``(h1, h2)`` that enough distinct sites show: ``long_sites`` (never
    more than ``min_sites``) for lines of ``long_words`` words or more, ``min_sites`` for others. Also the hashes that
    hold one of ``HOT_SHARE`` parts of all lines or more."""
    few_sites, error = min(long_sites, min_sites), 4 * 1.04 / math.sqrt(2**lg_k)
    need = F.when(F.col("words") >= long_words, F.lit(few_sites)).otherwise(F.lit(min_sites))
    margin = F.greatest(F.lit(1), F.ceil(need * error))
    total = lines.count()
    enough = (F.col("n") >= need) & (F.col("sites") >= need - margin)  # a line has no more sites than occurrences
    spread = written(
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
            F.count("*").alias("n"),
            F.max("words").alias("words"),
        )
        .select("h1", "h2", "sites", need.alias("need"), margin.alias("margin"), enough.alias("enough"),
                (F.col("n") * HOT_SHARE >= total).alias("hot"))
        .where("enough or hot"),
        "spread",
    )
    hot = spread.where("hot").select("h1", "h2")
    sure = spread.where("enough and sites > need + margin").select("h1", "h2")
    near = spread.where("enough and sites <= need + margin").select("h1", "h2", "need")
    exact = (
        _dealt_join(lines.select("h1", "h2", "site"), near, hot)
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"), F.max("need").alias("need"))
        .where("sites >= need")
        .select("h1", "h2")
    )
    return sure.unionByName(exact), hot


def remove_boilerplate_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    keep_first: bool = True,
    long_sites: int = LONG_SITES,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """``docs`` with the lines taken out that at least ``min_sites`` sources show, and ``lines_removed`` (int). For lines
    of ``long_words`` words or more, ``long_sites`` sources are enough.

    Lines are cut at line feeds and compared without blanks, tabs and carriage returns at their ends; blank lines
    never count. With ``keep_first`` the line stays where it stands first (smallest doc_id, null last, then smallest
    position), so no content is lost; without it every occurrence goes. ``text`` and, if there is one, ``n_chars``
    follow; all other columns stay as they are (a clashing ``lines_removed`` is replaced). A null text stays null, a
    null source counts as one site of its own, repeated rows are decided alike, an empty table gives an empty one.
    """
    lines = written(_line_table(docs), "lines")
    widespread, hot = widespread_lines(lines, min_sites, lg_k, long_sites, long_words)
    found = _dealt_join(lines.drop("site", "words"), written(widespread, "widespread"), hot)
    if keep_first:
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "pos")
        found = written(found, "found")
        first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"))
        found = _dealt_join(found, first, hot).where(
            ~((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("pos") == F.col("first.pos")))
        )
    drop, k1, k2 = (fresh(docs, n) for n in ("drop", "k1", "k2"))
    drops = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.sort_array(F.collect_set("pos")).alias(drop))
    key1, key2 = content_key("doc_id", "text")
    kept = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains(F.col(drop), at)), "\n"
    )
    columns = [c for c in docs.columns if c.lower() != "lines_removed"]
    out = (
        docs.select(*columns).withColumn(k1, key1).withColumn(k2, key2)
        .join(drops, [k1, k2], "left")
        .withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept))
        .withColumn("lines_removed", F.coalesce(F.size(drop), F.lit(0)).cast("int"))
    )
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        )
    return out.select(*columns, "lines_removed")
