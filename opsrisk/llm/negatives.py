"""Hard negatives: candidates in blocks along a Hilbert curve, whose zone maps tell which blocks an anchor's windows must read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.llm.common import batch_of, schema_of, stored

#: Rows of a block; anchors and zones that one task bounds at once; anchors that one task compares with a block at once.
BLOCK, ANCHORS, ZONES, MET = 512, 1024, 4096, 1024
#: The curve runs through this many dimensions, those that vary most, in 2**BITS cells each.
DIMENSIONS, BITS = 12, 4
#: Rows, chosen by a hash, that dimensions and cells are learned from.
FIT_ROWS = 8192

BLOCKS = schema_of("block bigint, label int, low binary, high binary, ids binary, v binary, anchor_at binary, floors binary")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (rows by dimensions, below ``2**bits``) on the Hilbert curve.

    The published way over transposed axes (Skilling 2004), for all rows at once:
    undo the rotations from the highest bit down, take the Gray code, and
    interleave the bits.
    """
    axes = cells.T.astype(np.int64)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in range(len(axes)):
            high = (axes[axis] >> bit) & 1 == 1
            swapped = np.where(high, 0, (axes[0] ^ axes[axis]) & below)
            axes[0] ^= np.where(high, below, swapped)
            axes[axis] ^= swapped
    for axis in range(1, len(axes)):
        axes[axis] ^= axes[axis - 1]
    turned = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    axes ^= turned
    place = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | (axis >> bit) & 1
    return place


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (``vec_id``, ``label``, ``x``) of rows with an id, a label and a vector of finite numbers only.

    Where ``vec_id`` is divisible by 7 the label is the next one, modulo 10.
    Vectors of another length than most take no part: they have no inner product
    with the others.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (usual.n if usual else 0)).distinct()


def _array(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _matrix(column: pa.Array) -> np.ndarray:
    return _array(column).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _best(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` largest finite scores of each row, ties to the column before."""
    columns = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    rows = np.repeat(np.arange(len(scores)), columns.shape[1])
    columns = columns.ravel()
    finite = np.isfinite(scores[rows, columns])
    return rows[finite], columns[finite]


def blocks(vectors: DataFrame, every: int, wanted: int) -> DataFrame:
    """The candidates as a table of blocks, one Parquet row each, written.

    A block has up to ``BLOCK`` rows of one label that follow each other on the
    curve, in the order of their ids, and the least and greatest value of each dimension. Anchors (ids
    divisible by ``every``) have their places in the block noted, with the
    ``wanted``-th best score that the block itself holds for them.
    """
    rows = stored(usable(vectors), "negative-rows")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("x").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], BLOCKS)
    known = np.floor(256 * np.array([row.x for row in sample], float).reshape(len(sample), -1))
    spread = known / max(1.0, np.abs(known).max(initial=0))
    chosen = np.argsort(-spread.var(0), kind="stable")[:DIMENSIONS]
    cuts = np.quantile(known[:, chosen], np.arange(1, 1 << BITS) / (1 << BITS), axis=0) if len(chosen) else None
    placed_as = schema_of("label int, curve bigint, vec_id bigint, v binary")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.floor(256 * batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                curve = np.zeros(len(x), np.int64)
                if cuts is not None:
                    cells = [np.searchsorted(cuts[:, k], x[:, axis], "right") for k, axis in enumerate(chosen)]
                    curve = hilbert(np.stack(cells, 1), BITS)
                yield batch_of(placed_as, [batch.column(1), curve, batch.column(0), [v.tobytes() for v in x]])

    placed = rows.mapInArrow(place, placed_as).withColumn("row", F.monotonically_increasing_id())
    along = placed.repartitionByRange("label", "curve", "vec_id", "row").sortWithinPartitions("label", "curve", "vec_id", "row")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held).combine_chunks()
            labels = table["label"].to_numpy()
            start = 0
            while start < len(labels):
                end = min(start + BLOCK, int(np.searchsorted(labels, labels[start], "right")))
                if end == len(labels) and end - start < BLOCK:
                    break  # its block may go on in the next batch
                yield _block(number, table.slice(start, end - start), every, wanted)
                number, start = number + 1, end
            held = [table.slice(start)] if start < len(labels) else []
        if held:
            yield _block(number, pa.concat_tables(held), every, wanted)

    return stored(along.drop("row").mapInArrow(cut, BLOCKS), "negative-blocks")


def _block(number: int, rows: pa.Table, every: int, wanted: int) -> pa.RecordBatch:
    ids, x = rows["vec_id"].to_numpy(), _matrix(rows["v"])
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    anchors = np.flatnonzero(ids % every == 0)
    scores = x[anchors] @ x.T
    scores[ids[anchors][:, None] == ids[None, :]] = -np.inf
    floors = np.full(len(anchors), -np.inf)
    if len(ids) >= wanted:
        floors = np.partition(scores, len(ids) - wanted, axis=1)[:, len(ids) - wanted]
    row = [number, rows["label"][0].as_py(), x.min(0), x.max(0), ids, x, anchors.astype(np.int64), floors]
    return batch_of(BLOCKS, [[v.tobytes() if isinstance(v, np.ndarray) else v] for v in row])


def anchors_of(blocks: DataFrame) -> DataFrame:
    """The anchors that lie in the blocks: ``anchor`` (a number of its own), ``anchor_id``, ``label``, ``q`` and ``floor``."""
    fields = schema_of("anchor bigint, anchor_id bigint, label int, q binary, floor double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["anchor_at"], "<i8")
                if len(at):
                    ids = np.frombuffer(row["ids"], "<i8")
                    x = np.frombuffer(row["v"], "<f8").reshape(len(ids), -1)[at]
                    n = len(at)
                    # a block has fewer rows than BLOCK + 1, so numbers of blocks and places don't meet
                    yield batch_of(
                        fields,
                        [row["block"] * (BLOCK + 1) + at, ids[at], [row["label"]] * n, [q.tobytes() for q in x],
                         np.frombuffer(row["floors"], "<f8")],
                    )

    held = blocks.where("length(anchor_at) > 0").select("block", "label", "ids", "v", "anchor_at", "floors")
    # few rows at once: a block is some hundred kilobytes
    return held.mapInArrow(_sliced(run), fields)


def _sliced(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    return lambda batches: run(batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64))


Rule = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray]


def must_read(anchors: DataFrame, blocks: DataFrame, rule: Rule) -> DataFrame:
    """(``block``, ``anchor``): the blocks that an anchor must read, by interval arithmetic on their zone maps.

    The inner product of an anchor with any row of a block lies between the sums,
    over the dimensions, of the least and of the greatest product that the
    dimension's range allows. ``rule`` gets anchors, zones and both bounds
    (anchors by zones) and tells which are needed. The anchors, in chunks, meet
    all zone maps, in chunks; neither is held whole by any task.
    """
    zones = blocks.select("block", "label", "low", "high")
    of_anchors, of_zones = -(-anchors.count() // ANCHORS), -(-zones.count() // ZONES)
    fields = schema_of("block bigint, anchor bigint")

    def chunked(side: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        numbered = side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(max(n, 1))))
        return numbered.withColumn(other, F.explode(F.expr(f"sequence(0L, {max(m, 1) - 1}L)")))

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([batch_of(fields, [[], []])])
        q, low, high = _matrix(left["q"]), _matrix(right["low"]), _matrix(right["high"])
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        needed = rule(left, right, up @ low.T + down @ high.T, up @ high.T + down @ low.T)
        own, met = np.nonzero(needed)
        return pa.Table.from_batches([batch_of(fields, [right["block"].to_numpy()[met], left["anchor"].to_numpy()[own]])])

    left = chunked(anchors, "anchor", "a", of_anchors, "z", of_zones)
    right = chunked(zones, "block", "z", of_zones, "a", of_anchors)
    return stored(left.groupBy("a", "z").cogroup(right.groupBy("a", "z")).applyInArrow(bound, fields), "negative-reads")


def _read(reads: DataFrame, anchors: DataFrame, blocks: DataFrame, compare, fields) -> DataFrame:
    """``compare`` on each block with the anchors that read it, a bounded number of them at a time."""
    wanted = reads.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("parts"))
    wanted = stored(wanted, "negative-parts")
    left = reads.join(wanted, "block").join(anchors, "anchor").withColumn("part", F.pmod(F.xxhash64("anchor"), "parts").cast("int"))
    right = blocks.select("block", "ids", "v").join(wanted, "block").select(
        "block", "ids", "v", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")
    )

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return pa.Table.from_batches([batch_of(fields, [[] for _ in fields])])
        ids = np.frombuffer(block["ids"][0].as_buffer(), "<i8")
        x = np.frombuffer(block["v"][0].as_buffer(), "<f8").reshape(len(ids), -1)
        return pa.Table.from_batches([batch_of(fields, compare(some, ids, _matrix(some["q"]) @ x.T))])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, fields)


def mined(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components count as ``floor(256 * x)``, scores are inner products of these.
    Anchors are rows whose ``vec_id`` is divisible by ``every``; positives the
    first ``positives`` other rows of the same label, negatives the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high``
    percent of the positive's. Higher scores come first, ties to the smaller id.

    Scores are exact as long as they fit 53 bits. Every block is read that a zone
    map doesn't rule out, so the result is the same as that of comparing all rows;
    how much is ruled out depends on the data, and on vectors without structure it is little.

    Rows that ``usable`` leaves out take no part; equal rows count once; rows of the
    anchor's own id are never its positives. Anchors without positives or without
    negatives in a window have no rows for them. Other columns are ignored. An
    empty table gives an empty one.
    """
    held = blocks(vectors, every, positives)
    anchors = stored(anchors_of(held), "negative-anchors")

    def alike(some: pa.Table, zones: pa.Table, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        same = some["label"].to_numpy()[:, None] == zones["label"].to_numpy()[None, :]
        return same & (most >= some["floor"].to_numpy()[:, None])

    found_as = schema_of("anchor bigint, anchor_id bigint, positive_id bigint, score double")

    def best_alike(some: pa.Table, ids: np.ndarray, scores: np.ndarray) -> list:
        own = some["anchor_id"].to_numpy()
        scores[own[:, None] == ids[None, :]] = -np.inf
        rows, columns = _best(scores, positives)
        return [some["anchor"].to_numpy()[rows], own[rows], ids[columns], scores[rows, columns]]

    near = _read(must_read(anchors, held, alike), anchors, held, best_alike, found_as)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    pairs = stored(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives).drop("k"), "negative-pairs")

    # a window per positive score; negative scores have none, as low percent of them is more than high percent
    windows = pairs.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("tops"))
    seeking = stored(anchors.drop("floor").join(windows, "anchor"), "negative-windows")

    def reaching(some: pa.Table, zones: pa.Table, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        tops = some["tops"].to_pylist()
        needed = np.zeros(least.shape, bool)
        for row, own in enumerate(tops):
            for top in own:
                needed[row] |= (100 * most[row] >= low * top) & (100 * least[row] <= high * top)
        return needed & (some["label"].to_numpy()[:, None] != zones["label"].to_numpy()[None, :])

    negative_as = schema_of("anchor bigint, score double, negative_id bigint, negative_score double")

    def best_other(some: pa.Table, ids: np.ndarray, scores: np.ndarray) -> list:
        own, tops, out = some["anchor"].to_numpy(), some["tops"].to_pylist(), []
        for k in range(positives):
            rows = np.flatnonzero([len(x) > k for x in tops])
            top = np.array([tops[row][k] for row in rows], float)[:, None]
            inside = (low * top <= 100 * scores[rows]) & (100 * scores[rows] <= high * top)
            any_ = inside.any(1)
            rows, top, inside = rows[any_], top[any_, 0], inside[any_]
            at, columns = _best(np.where(inside, scores[rows], -np.inf), negatives)
            out.append((own[rows[at]], top[at], ids[columns], scores[rows[at], columns]))
        return [np.concatenate(column) for column in zip(*out, strict=True)]

    far = _read(must_read(seeking, held, reaching), seeking, held, best_other, negative_as)
    order = Window.partitionBy("anchor", "score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return pairs.join(ranked, ["anchor", "score"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        "negative_id",
        F.col("score").cast("bigint").alias("positive_score"),
        F.col("negative_score").cast("bigint").alias("negative_score"),
    )
