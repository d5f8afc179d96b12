"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one queue over all trees, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.llm.common import batch_of, schema_of, stored

#: Rows of a leaf, and queries that visit it, that one task compares at most.
CHUNK = 4096


@dataclass
class Forest:
    """Complete binary trees. Node ``n`` has the children ``2n+1`` and ``2n+2``; leaves are numbered from the left.

    Vectors get one more component that makes all as long as the longest, queries
    get 0 there: the largest inner product is then the smallest distance.
    """

    longest: float
    directions: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return (self.cuts.shape[1] + 1).bit_length() - 1

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(1)))
        return np.hstack([x, rest[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        wide = self.lengthened(x)
        out = np.zeros((len(self.cuts), len(x)), np.int64)
        for tree, (directions, cuts) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", wide, directions[node]) > cuts[node]
                node = 2 * node + 1 + side
            out[tree] = node - (2**self.depth - 1)
        return out

    def visited(self, query: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves in the order of their distance, over all trees together, until they hold ``wanted`` rows.

        The distance of a leaf is the sum of the squared distances to the cuts
        that the query lies on the other side of.
        """
        margins = self.directions @ np.append(query, 0.0) - self.cuts
        inner = self.cuts.shape[1]
        queue = [(0.0, tree, 0) for tree in range(len(margins))]
        found, held = [], 0
        while queue and held < wanted:
            cost, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree, node]
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + margin * margin, tree, far))
                node = near
            leaf = node - inner
            if sizes[tree, leaf]:
                found.append((tree, leaf))
                held += sizes[tree, leaf]
        return found


def grown(sample: np.ndarray, longest: float, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Trees that halve the sample at the medians of random projections until a leaf holds about ``leaf_rows`` of it."""
    depth = max(0, int(np.log2(max(1, len(sample) / leaf_rows))))
    inner = 2**depth - 1
    draw = np.random.default_rng(seed)
    forest = Forest(longest, draw.normal(size=(trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)))
    if inner:
        forest.directions /= np.linalg.norm(forest.directions, axis=2, keepdims=True)
    wide = forest.lengthened(sample)
    for tree in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            value = np.einsum("ij,ij->i", wide, forest.directions[tree][node])
            order = np.lexsort((value, node))
            firsts = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1)))
            for k in range(2**level):
                own = value[order[firsts[k] : firsts[k + 1]]]
                forest.cuts[tree, 2**level - 1 + k] = np.median(own) if len(own) else 0.0
            node = 2 * node + 1 + (value > forest.cuts[tree][node])
    return forest


def usable(vectors: DataFrame) -> DataFrame:
    """(``vec_id``, ``x``): vectors as doubles, without null, empty, zero and non-finite ones and without null ids.

    Vectors of another length than most take no part either.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    ).where(
        F.col("vec_id").isNotNull()
        & (F.size("x") > 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("x", lambda v: v != 0)
    )
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (usual.n if usual else 0))


def _packed(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.float64)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    trees: int = 8,
    fit_rows: int = 16_384,
    leaf_rows: int = 64,
    share: float = 0.9,
    least_rows: int = 4000,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row whose ``vec_id`` is divisible by ``every``.

    Returns ``query_id``, ``rank``, ``vec_id`` and ``score``, nearest first, ties to
    the smaller ``vec_id``; all candidates, if there are fewer than ``k``. The trees
    are grown on up to ``fit_rows`` rows, chosen by a hash of their ids; every row
    is in the index. A query visits leaves of all trees until they hold ``share``
    of all rows and ``least_rows`` (a row counts once per tree), and what they hold
    is compared exactly. On vectors without any structure that finds over nine tenths of the
    true neighbours; with less share, fewer.

    Of equal vectors the ``k + 1`` smallest ids are indexed: others can be in no
    result. Rows of one vec_id are one candidate, with their best score, and one
    query per row. Rows that ``usable`` leaves out take no part; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = stored(usable(vectors).distinct(), "vectors")
    copies = Window.partitionBy("x").orderBy("vec_id")
    candidates = stored(rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"), "candidates")
    queries = rows.where(F.col("vec_id") % every == 0)
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()
    fields = schema_of("query_id bigint, rank int, vec_id bigint, score double")
    # floats are sent as such and multiplied as doubles
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    if not sample:
        return rows.sparkSession.createDataFrame([], fields)
    width = len(sample[0].x)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    longest = candidates.agg(F.max(norm)).first()[0]
    forest = grown(np.array([row.x for row in sample]), longest, trees, leaf_rows, seed)
    shipped = rows.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                leaves, vectors = shipped.value.leaves(x), [row.tobytes() for row in x.astype(kind)]
                for tree, own in enumerate(leaves):
                    yield batch_of(indexed, [[tree] * len(x), own.astype(np.int32), batch.column(0), vectors])

    indexed = schema_of("tree int, leaf int, vec_id bigint, v binary")
    index = stored(candidates.mapInArrow(place, indexed), "vector-index")
    # a number per leaf, of which the sample's size bounds how many there are
    held = index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows")).collect()
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    for row in held:
        sizes[row.tree, row.leaf] = row.rows
    wanted = max(share * sizes[0].sum(), least_rows)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leaves = shipped.value.visited(np.array(x), sizes, wanted)
                packed, n = np.array(x, kind).tobytes(), len(leaves)
                yield batch_of(probe, [[t for t, _ in leaves], [leaf for _, leaf in leaves], [query_id] * n, [packed] * n])

    probe = schema_of("tree int, leaf int, query_id bigint, q binary")
    probes = stored(queries.mapInArrow(search, probe), "vector-probes")
    visits = {(r.tree, r.leaf): r["count"] for r in probes.groupBy("tree", "leaf").count().collect()}
    parts = [(r.tree, r.leaf, -(-r.rows // CHUNK), -(-visits.get((r.tree, r.leaf), 0) // CHUNK)) for r in held]

    def dealt(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Rows with the part of their own side, once for each part of the other."""
        numbers = rows.sparkSession.createDataFrame(parts, "tree int, leaf int, row_parts int, query_parts int")
        met = side.join(F.broadcast(numbers), ["tree", "leaf"]).where("query_parts > 0")
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_parts")).cast("int")
        return met.select(
            *side.columns,
            mine.alias(f"{own}_part"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(f"{other}_part"),
        )

    key = ["tree", "leaf", "row_part", "query_part"]
    best = schema_of("query_id bigint, ids array<bigint>, scores array<double>")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([batch_of(best, [[], [], []])])
        ids = np.array(left["vec_id"].to_pylist())
        x, q = _packed(left["v"], width, kind), _packed(right["q"], width, kind)
        own = right["query_id"].to_pylist()
        rough = q @ x.T
        rough[np.array(own)[:, None] == ids[None, :]] = -np.inf
        # rows of one vec_id are one candidate, so the k-th is counted over the best of each
        by_id = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(ids[by_id]) != 0))
        best_of = rough if len(heads) == len(ids) else np.maximum.reduceat(rough[:, by_id], heads, axis=1)
        at = max(0, len(heads) - k)
        kth = np.partition(best_of, at, axis=1)[:, at]
        out: list[tuple] = []
        for row, query_id in enumerate(own):
            # the product of matrices rounds by position: what is as near as the k-th is computed anew, alike everywhere
            near = np.flatnonzero((rough[row] >= kth[row] - 1e-9 * (1 + abs(kth[row]))) & np.isfinite(rough[row]))
            exact = (x[near] * q[row]).sum(1)
            order = np.lexsort((ids[near], -exact))
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][: 2 * k]
            out.append((query_id, ids[near][order].tolist(), exact[order].tolist()))
        return pa.Table.from_batches([batch_of(best, list(zip(*out, strict=True)))])

    found = (
        dealt(index, "vec_id", "row", "query").groupBy(*key)
        .cogroup(dealt(probes, "query_id", "query", "row").groupBy(*key))
        .applyInArrow(compare, best)
    )

    def merge(group: pa.Table) -> pa.Table:
        ids = np.concatenate([np.array(x, np.int64) for x in group["ids"].to_pylist()])
        scores = np.concatenate([np.array(x, float) for x in group["scores"].to_pylist()])
        order = np.lexsort((-scores, ids))
        ids, scores = ids[order], scores[order]
        first = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
        ids, scores = ids[first], scores[first]
        top = np.lexsort((ids, -scores))[:k]
        n = len(top)
        query_id = group["query_id"][0].as_py()
        return pa.Table.from_batches([batch_of(fields, [[query_id] * n, range(1, n + 1), ids[top], scores[top]])])

    # a query's group has a few numbers for each leaf that it visits
    return found.groupBy("query_id").applyInArrow(merge, fields)
