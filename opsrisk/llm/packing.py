"""Packing token sequences: a configuration linear program over the histogram of lengths, by multiplicative weights, then rounded."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.llm.common import batch_of, schema_of, stored
from opsrisk.llm.piece_codes import chunks, codes, with_end

#: Columns taken from one pricing, and columns of the program.
BATCH, COLUMNS = 16, 4000
#: How fast a length's price falls with its coverage, and how far ahead of the others it may be covered at all.
RATE, AHEAD = 5.0, 0.5
#: Shares of the program's sequences that are rounded from its columns: the one that gives fewest sequences is taken. What
#: is left has all lengths, so it packs well.
ROUNDED = (0.8, 0.6, 0.4, 0.2)

Configuration = tuple[tuple[int, int], ...]


@dataclass
class Plan:
    """Which configurations (lengths, longest first, and how often each) fill how many sequences."""

    size: int
    configurations: list[Configuration] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)

    def add(self, configuration: Configuration, copies: int) -> None:
        self.configurations.append(configuration)
        self.copies.append(copies)

    @property
    def sequences(self) -> int:
        return sum(self.copies)

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of slots in the order of their length: the pieces of a length take them one after the other.

        ``first`` is the first slot of a run, counted over all lengths; each copy
        of its configuration has ``each`` slots of ``length`` from ``offset`` on.
        """
        rows = []
        sequence = 0
        for configuration, copies in zip(self.configurations, self.copies, strict=True):
            offset = 0
            for length, each in configuration:
                rows.append((length, each, offset, sequence, each * copies))
                offset += length * each
            sequence += copies
        length, each, offset, sequences, held = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        first = np.cumsum(held) - held
        return {"length": length, "each": each, "offset": offset, "sequence": sequences, "first": first}


def _priced(prices: np.ndarray, size: int) -> np.ndarray:
    """The most that items of these prices (by length, minus infinity for none) are worth in each room up to ``size``."""
    best = np.zeros(size + 1)
    turned = np.zeros(size + 1)  # best, from behind: slices of it need no copy
    for room in range(1, size + 1):
        found = (prices[1 : room + 1] + turned[size + 1 - room : size + 1]).max()
        best[room] = turned[size - room] = max(best[room - 1], found)
    return best


def _column(prices: np.ndarray, best: np.ndarray, size: int, left: np.ndarray) -> Configuration:
    """The items of a full room that are worth most, as the table of worths tells, none more often than ``left``.

    Of items worth the same the longest goes first.
    """
    taken: dict[int, int] = {}
    prices, room = prices.copy(), size
    while room:
        worth = prices[1 : room + 1] + best[room - 1 :: -1]
        top = worth.max()
        if top == -np.inf:
            break
        length = int(np.flatnonzero(worth >= top * (1 - 1e-9))[-1]) + 1
        taken[length] = taken.get(length, 0) + 1
        if taken[length] >= left[length]:
            prices[length] = -np.inf
        room -= length
    return tuple(sorted(taken.items(), reverse=True))


def fractional(counts: np.ndarray, size: int) -> dict[Configuration, float]:
    """About the fewest sequences, in fractions, of configurations that together hold ``counts[length]`` pieces of each length.

    Multiplicative weights. A length is worth what it fills, times a weight that
    falls with the share of its pieces that the columns so far hold; a knapsack
    table finds the configurations worth most at these prices; each gets a step
    that holds a small share of its scarcest length, and the weights follow.
    Steps are the smaller, the fewer lengths there are.
    """
    demand, present = counts.astype(float), counts > 0
    volume = demand * np.arange(size + 1)
    volume /= volume.sum()
    part = min(0.1, max(0.002, present.sum() / 20_000))
    covered = np.zeros(size + 1)
    found: dict[Configuration, float] = {}
    for _ in range(0, COLUMNS, BATCH):
        mean = covered @ volume
        if mean >= 1:
            break
        prices = np.where(present, np.arange(size + 1) / size * np.exp(-RATE * (covered - mean)), -np.inf)
        prices[covered > mean + AHEAD] = -np.inf
        best = _priced(prices, size)
        for _ in range(BATCH):
            column = _column(prices, best, size, counts)
            if not column:
                break
            lengths, each = np.array(column).T
            step = part * (demand[lengths] / each).min()
            found[column] = found.get(column, 0.0) + step
            gain = step * each / demand[lengths]
            covered[lengths] += gain
            prices[lengths] *= np.exp(-RATE * gain)
            prices[lengths[covered[lengths] > mean + AHEAD]] = -np.inf
    return {column: x / (covered @ volume) for column, x in found.items()}


def packed_plan(counts: np.ndarray, size: int) -> Plan:
    """Sequences of at most ``size`` for ``counts[length]`` pieces of each length, rounded from the linear program.

    The fullest configurations are rounded up and taken first, others down, up to
    a share of the program's sequences and never more than there are pieces for.
    What is left goes best-fit, longest first. Of the shares in ``ROUNDED`` the
    best one counts.
    """
    counts = counts.astype(np.int64)
    whole = int(counts[size])
    counts[size] = 0
    columns = fractional(counts, size) if counts.any() else {}
    plans = [_rounded(counts, size, columns, share) for share in (ROUNDED if columns else (0.0,))]
    plan = min(plans, key=lambda one: one.sequences)
    if whole:
        plan.add(((size, 1),), whole)
    return plan


def _rounded(counts: np.ndarray, size: int, columns: dict[Configuration, float], share: float) -> Plan:
    left, plan = counts.copy(), Plan(size)
    filled = {column: sum(length * each for length, each in column) for column in columns}
    wanted = share * sum(columns.values())
    for column, x in sorted(columns.items(), key=lambda one: (-filled[one[0]], -one[1], one[0])):
        if wanted <= 0:
            break
        most = int(np.ceil(x)) if filled[column] == size else int(x)
        copies = min(most, *(int(left[length]) // each for length, each in column))
        if copies:
            plan.add(column, copies)
            wanted -= copies
            for length, each in column:
                left[length] -= each * copies
    _best_fit(left, plan)
    return plan


def _best_fit(left: np.ndarray, plan: Plan) -> None:
    """Place what is left, longest first, where least room stays; equal sequences are one entry, however many."""
    open_: dict[tuple[int, Configuration], int] = {}  # (room, contents): copies
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            room, contents = min((key for key in open_ if key[0] >= length), default=(plan.size, ()))
            copies = open_.pop((room, contents), None)
            if copies is None:
                # new sequences, each as full of this length as it goes
                each = min(plan.size // length, count)
                copies, rest = divmod(count, each) if each else (count, 0)
                key = (plan.size - each * length, ((length, each),))
                open_[key] = open_.get(key, 0) + copies
                count = rest
                continue
            used = min(copies, count)
            if copies > used:
                open_[(room, contents)] = copies - used
            held = dict(contents)
            held[length] = held.get(length, 0) + 1
            key = (room - length, tuple(sorted(held.items(), reverse=True)))
            open_[key] = open_.get(key, 0) + used
            count -= used
    for (_, contents), copies in sorted(open_.items()):
        plan.add(contents, copies)


PIECES = schema_of("doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, place bigint")


def _pieces(df: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """The pieces of each text, with the task that cut them and their number among those of their length there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), codes(tokenizer)
        seen = np.zeros(size + 1, np.int64)
        for batch in chunks(batches, 1):
            flat, n = with_end(*coder.encode(batch.column(1)), end_id)
            # the first piece of a text may be shorter than the others
            several = -(-n // size)
            row = np.repeat(np.arange(len(n)), several)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(several) - several, several)
            head = n - (several - 1) * size
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
            length = np.where(piece == 0, head[row], size)
            order = np.argsort(length, kind="stable")
            by_length = length[order]
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.searchsorted(by_length, by_length) + seen[by_length]
            seen += np.bincount(length, minlength=size + 1)
            cuts = np.append(np.cumsum(length) - length, len(flat)) * flat.itemsize
            binary = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)]
            ).cast(pa.binary())
            yield batch_of(
                PIECES,
                [batch.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, binary,
                 np.full(len(row), part, np.int32), place],
            )

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def packed(df: DataFrame, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """Encode ``text`` of every row, append ``end_id``, and pack the ids into as few sequences of ``size`` as it can.

    Returns per piece ``doc_id``, ``piece`` (from 0), ``start`` (ids of its row
    before it), ``length``, ``ids`` (little-endian, two bytes each if the
    vocabulary allows, else four), ``sequence_id`` and ``offset``, its place there.
    Rows of more than ``size`` ids are cut into pieces of ``size``, of which the
    first may be shorter; no other row is cut, and sequences have no gaps.

    Only the histogram of lengths, ``size`` numbers, comes to the driver. The
    plan made from it holds runs of equal sequences, some thousands at most
    however many rows there are, and is broadcast. A piece finds its slot by its number among the
    pieces of its length: its number in its task plus those of the tasks before.

    A null or empty text gives the end id alone. Rows with null or equal doc_ids
    are separate rows; equal rows are packed each. Very long texts are encoded and
    cut like others. Other columns are ignored; an empty table gives an empty one.
    Which pieces meet in a sequence depends on how the rows are dealt to tasks.
    """
    pieces = stored(_pieces(df, tokenizer, end_id, size), "packing-pieces")
    held = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-lengths")
    counts = np.zeros(size + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = df.sparkSession.createDataFrame(_runs(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the bases are joined without a hint: Spark broadcasts them by their size, or shuffles
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.expr("base + place"))
    # the ids stay in the JVM: there is no memory for more Python workers beside those that remember words
    return numbered.join(F.broadcast(plan), "length").where("number >= first AND number < last").selectExpr(
        *["doc_id", "piece", "start", "length", "ids"],
        "sequence + (number - first) DIV each AS sequence_id",
        "at + (number - first) % each * length AS offset",
    )


def _runs(counts: np.ndarray, size: int) -> pa.Table:
    """The runs of slots of the plan for ``counts``; ``first`` and ``last`` (the one after) are counted within their length."""
    slots = packed_plan(counts, size).slots()
    before = (np.cumsum(counts) - counts)[slots["length"]]
    last = np.append(slots["first"][1:], counts.sum())[: len(before)]
    found = {"length": slots["length"], "first": slots["first"] - before, "last": last - before}
    return pa.table(found | {"each": slots["each"], "at": slots["offset"], "sequence": slots["sequence"]})


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_tokens``, and the ``ids`` of its pieces in a row (at most ``size``)."""
    fields = schema_of("sequence_id bigint, n_tokens bigint, ids binary")

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["offset"].to_numpy())
        ids = group["ids"].to_pylist()
        row = [group["sequence_id"][0].as_py(), int(group["length"].to_numpy().sum()), b"".join(ids[k] for k in order)]
        return pa.Table.from_batches([batch_of(fields, [[x] for x in row])])

    return pieces.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInArrow(run, fields)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of their ids."""
    fields = schema_of("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids, length in zip(batch.column("ids"), batch.column("length").to_pylist(), strict=True):
                packed_ids = ids.as_buffer()
                found.append(zlib.crc32(np.frombuffer(packed_ids, f"<u{packed_ids.size // length}").astype("<u4")))
            columns = [batch.column(name) if name != "ids_crc32" else pa.array(found, pa.int64()) for name in fields.names]
            yield batch_of(fields, columns)

    return pieces.mapInArrow(run, fields)
