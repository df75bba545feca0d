"""Near-duplicate vectors by spherical-cap filters (locality-sensitive filtering).

Filter directions form random product codes: after a random rotation the dimensions are cut into parts, every part has
a few random codewords, and each combination of codewords, one a part, is a direction. A vector passes a filter if its
projection on the direction exceeds a threshold; the directions it exceeds are list-decoded from the parts' projections
without going through all combinations. Vectors that pass a common filter are compared exactly.

Directions of one product code depend on each other: a vector with weak projections in the parts may exceed none. So
there are several codes with rotations of their own, and a vector that exceeds no direction of a code passes its best.

The threshold follows from the number of vectors, so that a filter holds about ``BUCKET`` unrelated ones, and the
number of directions from the wanted number of filters that a pair at the similarity limit shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, small_batches, written
from lendwise.llm.components import connected_components

MIN_COSINE = 0.93
BUCKET = 8
CODES = 6
SHARED = 1.5  # per code
PARTS = 4
BLOCK = 1024
BROADCAST_ROWS = 50_000


@dataclass
class ProductCode:
    """``words[part][i]`` are the codewords of a part, scaled so that every combination is a unit vector."""

    words: list[np.ndarray]
    threshold: float
    rotation: np.ndarray

    @property
    def directions(self) -> int:
        return math.prod(len(w) for w in self.words)

    @classmethod
    def design(cls, dim: int, n: int, cosine: float, bucket: float = BUCKET, shared: float = SHARED, seed: int = 5):
        normal = NormalDist()
        alone = min(0.02, bucket / max(n, 1))
        cut = normal.inv_cdf(1.0 - alone)
        x = np.linspace(cut, cut + 8.0, 4001)
        tail = np.array([1.0 - normal.cdf((cut - cosine * v) / math.sqrt(1.0 - cosine * cosine)) for v in x])
        both = float(np.sum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tail) * (x[1] - x[0]))
        parts = max(1, min(PARTS, dim // 4))
        counts = [max(2, int((shared / both) ** (1.0 / parts)))] * parts
        for k in range(parts):
            if math.prod(counts) < shared / both:
                counts[k] += 1
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        words = []
        for each, columns in zip(counts, np.array_split(np.arange(dim), parts)):
            w = rng.standard_normal((each, len(columns)))
            w *= math.sqrt(len(columns) / dim) / np.linalg.norm(w, axis=1, keepdims=True)
            words.append(w)
        return cls(words, cut / math.sqrt(dim), rotation)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the directions that each unit vector exceeds, or of its best one.

        Parts are folded into a front and a back half; the back's sums are sorted, so that every front sum reads off
        just the back sums that lift it over the threshold.
        """
        unit, at, sums = unit @ self.rotation, 0, []
        for w in self.words:
            sums.append(unit[:, at : at + w.shape[1]] @ w.T)
            at += w.shape[1]

        def fold(parts: list[np.ndarray]) -> np.ndarray:
            total = np.zeros((len(unit), 1))
            for p in parts:
                total = (total[:, :, None] + p[:, None, :]).reshape(len(unit), -1)
            return total

        half = (len(sums) + 1) // 2
        front, back = fold(sums[:half]), fold(sums[half:])
        order = np.argsort(-back, axis=1)
        ranked = np.take_along_axis(back, order, axis=1)
        out = []
        for f, b, o in zip(front, ranked, order):
            least = min(self.threshold, float(f.max() + b[0]))
            count = np.searchsorted(-b, f - least, side="right")
            if not count.any():  # rounding at the best direction itself
                count[int(f.argmax())] = 1
            some = np.nonzero(count)[0]
            count = count[some]
            first = np.repeat(np.cumsum(count) - count, count)
            chosen = o[np.arange(count.sum()) - first]
            out.append(np.sort(np.repeat(some, count) * back.shape[1] + chosen))
        return out


def _usable() -> Column:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        finite & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def decode_all(codes: list[ProductCode], unit: np.ndarray) -> list[np.ndarray]:
    """Filters of each unit vector over all codes, which are numbered one after the other."""
    base, lists = 0, []
    for code in codes:
        lists.append([x + base for x in code.decode(unit)])
        base += code.directions
    return [np.concatenate(own) for own in zip(*lists)]


def _filtered(classes: DataFrame, codes: dict[int, list[ProductCode]]) -> DataFrame:
    """One row per class and filter, with what comparing needs."""
    label = classes.schema["label"].dataType.simpleString()
    vec = classes.schema["vec"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                lists = decode_all(codes[int(dim)], unit_rows(part.column("vec"), dim))
                counts = [len(x) for x in lists]
                rows = part.take(pa.array(np.repeat(np.arange(len(lists)), counts)))
                every = np.concatenate([np.zeros(0, np.int64), *lists])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(every, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("label", "dim", "cid", "size", "vec")), pa.array(every, pa.int64()),
                     own.take(pa.array(np.repeat(np.arange(len(lists)), counts)))],
                    ["label", "dim", "cid", "size", "vec", "filter", "filters"],
                )

    kind = f"label {label}, dim int, cid bigint, size bigint, vec {vec}, filter bigint, filters array<bigint>"
    return classes.mapInArrow(decode, kind)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _first_shared(filters: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, at: int) -> np.ndarray:
    """Which pairs share no filter below ``at``: those are counted here, and nowhere else."""
    below = [f[f < at] for f in filters]
    if len(rows) <= 64:
        sets = {i: set(below[i].tolist()) for i in {*rows.tolist(), *cols.tolist()}}
        return np.array([sets[i].isdisjoint(sets[j]) for i, j in zip(rows.tolist(), cols.tolist())], dtype=bool)
    names, place = np.unique(np.concatenate(below), return_inverse=True)
    held = np.zeros((len(filters), len(names)), dtype=np.float32)
    held[np.repeat(np.arange(len(filters)), [len(b) for b in below]), place] = 1.0
    return ~((held @ held.T)[rows, cols] > 0)


def _group_links(ids, sizes, unit, filters, blocks, at: int, cosine: float):
    """Verified links of one group: per linked class the other rows it gains, and the smallest class it reaches."""
    rows, cols = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    if blocks[0] != blocks[1]:  # pairs inside a block are another group's
        across = (blocks[2][rows] != blocks[2][cols])
        rows, cols = rows[across], cols[across]
    new = _first_shared(filters, rows, cols, at) if len(rows) else np.zeros(0, bool)
    rows, cols = rows[new], cols[new]
    if not len(rows):
        return None
    gained = np.bincount(rows, sizes[cols], len(ids)) + np.bincount(cols, sizes[rows], len(ids))
    least = ids.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, rows, least[cols])
        np.minimum.at(least, cols, least[rows])
        if (before == least).all():
            break
    on = np.nonzero(gained)[0]
    return ids[on], gained[on].astype(np.int64), least[on]


def _links(filtered: DataFrame, cosine: float, block: int) -> DataFrame:
    """``(cid, gained, least)`` of every group; groups of a crowded filter are pairs of its blocks."""
    key = ["label", "dim", "filter"]
    crowded = filtered.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = written(crowded.select(*key, F.ceil(F.col("n") / block).alias("blocks")), "crowded")
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    placed = filtered.join(crowded, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))).withColumn(
        "own", F.pmod(F.xxhash64("cid"), F.col("blocks"))
    )
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        *key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "size", "vec", "filters"
    )
    group = [*key, "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, names: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.concatenate([[0], np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1, [len(names)]])
            found = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo).combine_chunks()
                dim = int(names[lo, 1])
                unit = unit_rows(part.column("vec").combine_chunks(), dim)
                filters = [np.asarray(f, dtype=np.int64) for f in part.column("filters").to_pylist()]
                pair = (names[lo, 3], names[lo, 4], part.column("own").to_numpy())
                hit = _group_links(part.column("cid").to_numpy(), part.column("size").to_numpy(), unit, filters,
                                   pair, int(names[lo, 2]), cosine)
                if hit:
                    found.append(hit)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["cid", "gained", "least"]
                )

        def named(table: pa.Table) -> np.ndarray:
            label = table.column("label").dictionary_encode().combine_chunks()
            codes = label.indices.to_numpy() if isinstance(label, pa.DictionaryArray) else label.chunk(0).indices.to_numpy()
            return np.column_stack([codes, *(table.column(c).to_numpy() for c in group[1:])])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            names = named(table)
            last = np.nonzero((names[1:] != names[:-1]).any(axis=1))[0]
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from done(table.slice(0, cut), names[:cut])
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from done(rest, named(rest))

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(verify, "cid bigint, gained bigint, least bigint")


def near_duplicate_vectors(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, shared: float = SHARED, block: int = BLOCK, seed: int = 5
) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Only vectors with equal, non-null labels and equal dimensions are compared; cosines are in double precision. A
    vector that is null, all zero or holds null or non-finite components links with nothing; a row without vec_id
    neither (component_id null, kept false). Equal vectors are one class, linked without being compared; a vec_id's
    repeated rows are one vector. Other columns are not read; an empty table gives an empty result.

    ``shared`` filters of each of the ``CODES`` codes are expected in common at the similarity limit, more above it.
    Every link returned is exact; the share of links found is measured in the tests and the README.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    k1, k2 = content_key("label", "embedding")
    rows = vectors.select("vec_id", "embedding", "label", _usable().alias("ok"), k1.alias("k1"), k2.alias("k2"))
    classes = written(
        rows.where("ok")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("cid"), F.count_distinct("vec_id").alias("size"),
             F.first("embedding").alias("embedding"), F.first("label").alias("label"))
        .withColumnRenamed("embedding", "vec")
        .withColumn("dim", F.size("vec")),
        "vector-classes",
    )
    crowd = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    codes = {
        r["dim"]: [ProductCode.design(r["dim"], r["n"], min_cosine, shared=shared, seed=seed + k) for k in range(CODES)]
        for r in crowd
    }
    links = written(_links(_filtered(classes, codes), min_cosine, block), "vector-links")
    gained = links.groupBy("cid").agg(F.sum("gained").alias("gained"))
    member = connected_components(links.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    named = (
        classes.select("k1", "k2", "cid", "size")
        .join(gained, "cid", "left")
        .join(member.withColumnRenamed("node", "cid"), "cid", "left")
        .select(F.col("k1").alias("c1"), F.col("k2").alias("c2"),
                (F.col("size") - 1 + F.coalesce("gained", F.lit(0))).alias("links"),
                F.coalesce("component", "cid").alias("component"))
    )
    joined = rows.select("vec_id", "ok", "k1", "k2").join(
        named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("ok"), "left"
    )
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
