"""Hard negatives by inner product from cover trees over norm-augmented vectors.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M the largest length of its tree, so all lie on one sphere and a query
(q, 0) has the same inner product with both forms. A tree's nodes cover their points: half the radius at each level,
children's centres further apart than that. What a node covers lies within its radius r of its centre c, so its inner
products lie within q.c - |q| r and q.c + |q| r. Search opens nodes best first by the upper end, leaves out nodes that
lie outside the window of wanted scores, computes leaves exactly, and ends when no node left can beat what is held.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, small_batches, written

SCALE = 256.0
SHARD_COMPONENTS = 1 << 19
LEAF_ROWS = 64
EXACT = float(1 << 53)
POSITIVES = 5
NEGATIVES = 3
#: Shares of the positive's score, in percent: 50 * positive <= 100 * negative <= 95 * positive.
LOW_PERCENT, HIGH_PERCENT = 50, 95


class CoverTree:
    """Nodes as flat arrays: a centre's row, the radius that covers the node's points, and either its children or, in
    a leaf, its points. ``rows`` are positions in the shard's arrays."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        squares = np.einsum("ij,ij->i", values, values)
        augmented = np.column_stack([values, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))])
        self.largest = float(np.abs(values).max(initial=0.0))
        self.centre: list[int] | np.ndarray = []
        self.radius: list[float] = []
        self.below: list[np.ndarray] = []  # children's numbers, or a leaf's rows
        self.leaf: list[bool] = []
        self._grow(augmented)
        self.centre = np.array(self.centre)
        self.centres = values[self.centre]
        self.radii = np.array(self.radius)

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.below.append(np.zeros(0, np.int64))
        self.leaf.append(False)
        return len(self.centre) - 1

    def _grow(self, points: np.ndarray) -> None:
        def distances(rows: np.ndarray, centre: int) -> np.ndarray:
            apart = points[rows] - points[centre]
            return np.sqrt(np.einsum("ij,ij->i", apart, apart))

        squares = np.einsum("ij,ij->i", points, points)
        rough = 1e-9 * float(squares.max(initial=0.0))  # squared distances far above this can be told from products
        rows = np.arange(len(points))
        away = distances(rows, 0)
        level = float(away.max())  # covering radius of this level
        open_nodes = [(self._node(0, level), rows, away, level)]
        while open_nodes:
            node, rows, away, level = open_nodes.pop()
            if len(rows) <= LEAF_ROWS or self.radius[node] == 0.0:
                self.leaf[node], self.below[node] = True, rows
                continue
            level, children = level / 2, []
            centre = self.centre[node]
            near = away <= level  # the first centre is the node's own, so trees nest
            block, left, count = points[rows], np.ones(len(rows), bool), len(rows)
            while True:
                covered = rows[near]
                away = distances(covered, centre)
                child = self._node(centre, float(away.max()))
                open_nodes.append((child, covered, away, level))
                children.append(child)
                left[near] = False
                count -= len(covered)
                if not count:
                    break
                if 2 * count < len(rows):
                    rows, block, left = rows[left], block[left], np.ones(count, bool)
                first = int(left.argmax())
                centre = int(rows[first])
                if level * level > rough:
                    near = left & (squares[rows] + squares[centre] - 2.0 * (block @ points[centre]) <= level * level)
                else:
                    near = left & (distances(rows, centre) <= level)
                near[first] = True
            self.below[node] = np.array(children)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles while all sums stay below 2^53, else in whole numbers of any size."""
        if self.largest * float(np.abs(query).sum()) < EXACT:
            return self.values[rows] @ query
        whole = [int(x) for x in query]
        found = [sum(int(a) * b for a, b in zip(row, whole)) for row in self.values[rows]]
        if any(not -(2**63) <= s < 2**63 for s in found):
            raise OverflowError("an inner product does not fit 64 bits")
        return np.array(found, dtype=object)


def best_rows(
    trees: list[CoverTree], query_id: int, query: np.ndarray, k: int, low: float = -np.inf, high: float = np.inf,
    opened: dict | None = None,
) -> list[tuple[int, int]]:
    """``(score, id)`` of the ``k`` best rows of the trees with ``low <= score <= high``, ties to the smaller id; the
    query's own id is left out. Searches of one query in the same trees may share ``opened``, the bounds of the nodes
    that were opened so far.

    The centres of a node's children are different rows, so the k-th best centre inside the window bounds what can still
    be among the best: of a node with many children only those that reach it are kept."""
    opened = {} if opened is None else opened
    length = float(np.sqrt(query @ query))
    slack = 1e-9 * length  # rounding of centres' products and of radii
    open_nodes: list[tuple[float, int, int]] = []
    held: list[tuple[int, int]] = []  # a heap with the worst first: score, -id
    least = -np.inf  # k rows are known that score this or more

    def bounds(at: int, node: int) -> tuple[np.ndarray, ...]:
        """Of a node's children, which are numbered in a row (a leaf at the root stands for itself): upper and lower
        ends, tree and number, and the ends of what their centres score, where the query's own id is none."""
        tree = trees[at]
        nodes = np.zeros(1, np.int64) if tree.leaf[node] else tree.below[node]
        run = slice(int(nodes[0]), int(nodes[-1]) + 1)
        middle = tree.centres[run] @ query
        rounding = slack * (1.0 + tree.largest * len(query))
        reach = length * tree.radii[run] + rounding
        own = tree.ids[tree.centre[run]] == query_id
        return (middle + reach, middle - reach, np.full(len(nodes), at), nodes,
                np.where(own, -np.inf, middle - rounding), np.where(own, np.inf, middle + rounding))

    def open_up(key: tuple[int, int] | None) -> None:
        nonlocal least
        if key not in opened:
            ends = [bounds(*key)] if key else [bounds(at, 0) for at in range(len(trees))]  # all roots are opened together
            opened[key] = [np.concatenate(e) for e in zip(*ends)]
        upper, lower, owner, nodes, centre_from, centre_to = opened[key]
        inside = centre_from[(centre_from >= max(low, least)) & (centre_to <= high)]
        if len(inside) >= k:
            least = max(least, float(np.partition(inside, -k)[-k]))
        for n in np.nonzero((upper >= max(low, least)) & (lower <= high))[0].tolist():
            heapq.heappush(open_nodes, (-float(upper[n]), int(owner[n]), int(nodes[n])))

    if trees:
        open_up(None)
    while open_nodes:
        upper, at, node = heapq.heappop(open_nodes)
        if -upper < least:
            break
        tree = trees[at]
        if not tree.leaf[node]:
            open_up((at, node))
            continue
        rows = tree.below[node]
        rows = rows[tree.ids[rows] != query_id]
        found = tree.scores(rows, query)
        wanted = np.nonzero((found >= low) & (found <= high))[0]
        if len(held) == k:
            wanted = wanted[found[wanted] >= held[0][0]]
        for n in wanted.tolist():
            entry = (int(found[n]), -int(tree.ids[rows[n]]))
            if len(held) < k:
                heapq.heappush(held, entry)
            elif entry > held[0]:
                heapq.heapreplace(held, entry)
        if len(held) == k:
            least = max(least, held[0][0])
    return sorted(((s, -i) for s, i in held), key=lambda e: (-e[0], e[1]))


def window_of(score: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """The whole scores s with low_percent * score <= 100 * s <= high_percent * score, ends included."""
    return -(-low_percent * score // 100), high_percent * score // 100


def whole_vector(column: str, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component; null unless all components are there and finite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x * scale).cast("double")))


def ready_rows(vectors: DataFrame) -> DataFrame:
    """Rows that take part, once each, with whole components: ``vec_id, label, values, key``."""
    key = content_key("vec_id", "label", "values")
    valued = vectors.select("vec_id", "label", whole_vector("embedding").alias("values"))
    valued = valued.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(values) > 0")
    return valued.withColumn("key", key[0]).withColumn("k2", key[1]).dropDuplicates(["key", "k2"]).drop("k2")


def _in_shards(rows: DataFrame, shards: int, asked: DataFrame, found: str, answer) -> DataFrame:
    """Rows of ``answer(trees by size and label, anchor)`` for every anchor in every shard of rows. Rows are shuffled
    once, into shards of bounded size; anchors are copied to each shard and pass its trees as a stream behind its rows."""
    kind = asked.schema["posed"].dataType.simpleString()
    names = [f.split()[0] for f in found.split(",")]
    shard = F.pmod("key", F.lit(shards)).cast("int")
    dealt = rows.select(
        shard.alias("shard"), F.lit(0).alias("part"), "vec_id", "label", "values", "key", F.lit(None).cast(kind).alias("posed")
    )
    copies = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"), "vec_id", "label", "values",
        "key", "posed",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees, now = {}, {}, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "part", "vec_id", "label", "key", "posed")]
            out = []
            for n, (shard, part, vec_id, label, key, posed) in enumerate(zip(*columns)):
                if shard != now:
                    held, trees, now = {}, {}, shard
                vector = batch.column("values")[n].values.to_numpy(zero_copy_only=False)
                if part == 0:
                    held.setdefault((len(vector), label), []).append((vec_id, vector))
                    continue
                for group, members in held.items():
                    trees[group] = CoverTree(np.array([i for i, _ in members]), np.array([v for _, v in members]))
                held = {}
                out += answer(trees, {"vec_id": vec_id, "label": label, "values": vector, "key": key, "posed": posed})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    stream = dealt.unionByName(copies).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "part")
    return stream.mapInArrow(search, found)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    shard_components: int = SHARD_COMPONENTS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``anchors(vec_id, label,
    embedding)`` among ``vectors`` of the same columns.

    Scores are inner products of floor(256 x), higher first, ties by smaller vec_id. An anchor's positives are the
    first rows of its label; each positive's negatives are the first rows of other labels that score within the given
    shares of its score. Rows without vec_id or label, and vectors that are null, empty or hold null or non-finite
    components, take no part; equal rows are one; rows with the anchor's vec_id are no candidates; vectors of another
    length meet only their like. Too few candidates give fewer rows, empty tables an empty result; other columns are
    not read. Components count exactly up to 2^53; a score beyond 64 bits raises ``OverflowError``.

    The anchors are a stated query set that meets all rows in blocks: a shard holds ``shard_components`` numbers of
    any labels, so neither a hot label nor a group of copies makes a shard larger, and a task reads anchors as a stream.
    """
    small_batches(vectors.sparkSession, 2048)
    rows = written(ready_rows(vectors), "mining-rows")
    asked = written(ready_rows(anchors), "mining-anchors")
    total = rows.agg(F.sum(F.size("values"))).first()[0] or 0
    shards = max(1, -(-total // shard_components))

    def same_label(trees, anchor):
        own = trees.get((len(anchor["values"]), anchor["label"]))
        found = best_rows([own], anchor["vec_id"], anchor["values"], positives) if own else []
        return [(anchor["key"], i, s) for s, i in found]

    near = _in_shards(
        rows, shards, asked.withColumn("posed", F.lit(None).cast("int")), "key bigint, positive_id bigint, positive_score bigint", same_label
    )
    first = Window.partitionBy("key").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    posed = chosen.groupBy("key").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("posed"))
    posed = written(asked.join(posed, "key"), "mining-positives")

    def other_labels(trees, anchor):
        others = [t for (size, label), t in trees.items() if size == len(anchor["values"]) and label != anchor["label"]]
        by_score: dict[int, list] = {}
        opened: dict = {}
        out = []
        for p in anchor["posed"]:
            score = p["positive_score"]
            low, high = window_of(score, low_percent, high_percent)
            if score not in by_score:
                by_score[score] = best_rows(others, anchor["vec_id"], anchor["values"], negatives, low, high, opened) if low <= high else []
            out += [(anchor["key"], anchor["vec_id"], p["positive_id"], i, score, s) for s, i in by_score[score]]
        return out

    hard = _in_shards(
        rows, shards, posed,
        "key bigint, anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint", other_labels,
    )
    order = Window.partitionBy("key", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
