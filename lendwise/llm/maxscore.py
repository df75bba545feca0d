"""Exact top-k by inner product with MaxScore, shard by shard.

Vectors are quantised to integers; each dimension is a query term. Within a shard a term's contributions are counted
from the shard's least favourable value, so none is negative and each term has a largest one, its bound. Terms sorted
by bound split into non-essential ones (whose bounds together cannot lift a candidate over the threshold) and
essential ones: the essential terms' postings are traversed, the others are probed, largest bound first, only for the
candidates that can still compete. Shards keep their best rows and are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, small_batches, written

SCALE = 1024.0
SHARD_ROWS = 4096
QUERY_ROWS = 256
SEED_ROWS = 64
PROBE = 4


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores; ties go to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Shard:
    """A shard's postings, one column a term, with each term's range of values. Values are whole numbers held as
    doubles: sums stay exact below 2^53."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.low, self.high = values.min(axis=0), values.max(axis=0)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the shard's best ``k`` rows for a query; rows of the query's own id take no part."""
        usable = self.ids != query_id
        base = np.where(query > 0, self.low, self.high)
        bound = np.abs(query) * (self.high - self.low)
        floor = float(query @ base)  # what a candidate has before any term adds to it
        seed = np.nonzero(usable)[0][:SEED_ROWS]
        first = np.sort(self.values[seed] @ query)
        threshold = first[-k] - floor if len(first) >= k else -np.inf
        order = np.argsort(bound, kind="stable")
        reach = np.cumsum(bound[order])
        split = int(np.searchsorted(reach, threshold, side="left"))  # bounds below it add up to less than the threshold
        essential, others = order[split:], order[:split][::-1]
        alive = np.nonzero(usable)[0]
        score = self.values[:, essential] @ query[essential] - query[essential] @ base[essential]
        score = score[alive]
        left = float(bound[others].sum())
        for at in range(0, len(others), PROBE):
            competitive = score + left >= threshold
            alive, score = alive[competitive], score[competitive]
            if len(score) >= k:
                threshold = max(threshold, float(np.partition(score, -k)[-k]))  # more terms only add
            terms = others[at : at + PROBE]
            score = score + self.values[np.ix_(alive, terms)] @ query[terms] - query[terms] @ base[terms]
            left -= float(bound[terms].sum())
        best = top_of(score, self.ids[alive], k)
        return self.ids[alive][best], score[best] + floor


def quantised(column: str = "embedding") -> Column:
    """floor(1024 x) of every component, null unless all components are finite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x * SCALE).cast("double")))


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(vec_id, embedding)`` over ``vectors(vec_id, embedding)``.

    Scores are inner products of the quantised components; ties go to the smaller vec_id; a query's own id is no
    candidate. Vectors that are null, or hold null or non-finite components, and rows without vec_id take no part;
    repeated rows are one; vectors of another dimension than the query's are no candidates. Fewer candidates than
    ``k`` give fewer rows; empty tables give an empty result; other columns are not read.

    Shards and query blocks are of bounded size and meet once each: a stated query set against all rows, in blocks.
    """
    small_batches(vectors.sparkSession, 2048)

    def ready(df: DataFrame) -> DataFrame:
        key = content_key("vec_id", "values")
        valued = df.select("vec_id", quantised().alias("values")).where("vec_id IS NOT NULL AND size(values) > 0")
        return valued.withColumn("k1", key[0]).withColumn("k2", key[1]).dropDuplicates(["k1", "k2"]).select(
            "vec_id", "values", F.size("values").alias("dim"), F.col("k1").alias("key")
        )

    rows, asked = written(ready(vectors), "shard-rows"), written(ready(queries), "query-rows")
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    posed = asked.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    )

    def matrix(table: pa.Table, dim: int) -> np.ndarray:
        values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.asfortranarray(values.reshape(-1, dim))

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if ours.num_rows and theirs.num_rows:
            dim = ours.column("dim")[0].as_py()
            shard = Shard(ours.column("vec_id").to_numpy(), matrix(ours, dim))
            for query_id, query in zip(theirs.column("vec_id").to_numpy(), matrix(theirs, dim)):
                ids, scores = shard.search(query_id, np.ascontiguousarray(query), k)
                found.append((np.full(len(ids), query_id), ids, scores))
        query_id, vec_id, score = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()),
                         "score": pa.array(score.astype(np.int64), pa.int64())})

    key = ["dim", "shard", "block"]
    best = dealt.groupBy(*key).cogroup(posed.groupBy(*key)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
