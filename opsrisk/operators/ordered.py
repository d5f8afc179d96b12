"""Ranks, quantiles and running totals over any numbers, without ordering all rows in one place."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from opsrisk.session import checkpointed

#: Parts that an interval of values is cut into by one pass, and distinct values that are listed instead.
PARTS, LISTED = 4096, 20_000


def _known(value: str) -> str:
    return f"`{value}` IS NOT NULL AND NOT isnan(`{value}`)"


def in_order(rows: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """Per distinct value its counts, and their totals over smaller values of the same ``part``.

    Equal values are merged first, so a value that many rows have is one row.
    Then values are dealt to partitions by range: a partition is a ``part``, and
    all values of a smaller part are smaller.
    """
    merged = rows.filter(_known(value)).groupBy(value).agg(*(F.sum(c).alias(c) for c in counts))
    ranged = merged.select(F.col(value).cast("double").alias(value), *counts).repartitionByRange(value).sortWithinPartitions(value)
    fields = T.StructType(
        [
            T.StructField(value, T.DoubleType()),
            *(T.StructField(name, T.LongType()) for c in counts for name in (c, f"{c}_before")),
            T.StructField("part", T.IntegerType()),
        ]
    )

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, part = dict.fromkeys(counts, 0), TaskContext.get().partitionId()
        for frame in frames:
            out = {value: frame[value], "part": np.full(len(frame), part, np.int32)}
            for c in counts:
                ends = seen[c] + frame[c].to_numpy(np.int64).cumsum()
                out[c], out[f"{c}_before"] = frame[c], ends - frame[c].to_numpy(np.int64)
                seen[c] = int(ends[-1]) if len(ends) else seen[c]
            yield pd.DataFrame(out)[fields.names]

    return ranged.mapInPandas(run, fields)


def _bases(parts: DataFrame, counts: list[str]) -> DataFrame:
    """Totals of the parts before each part; a part is one row, and there are as many as partitions."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in counts))


def cumulative_counts(rows: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """Per distinct value: each count, its total over smaller values, and its grand total.

    ``counts`` are whole-number columns to add up. Null and NaN values are left out.
    """
    ordered = checkpointed(in_order(rows, value, counts))
    parts = ordered.groupBy("part").agg(*(F.sum(c).alias(c) for c in counts))
    everything = Window.partitionBy()
    bases = _bases(parts, counts).select(
        "part", *(f"{c}_base" for c in counts), *(F.sum(c).over(everything).alias(f"{c}_total") for c in counts)
    )
    return ordered.join(bases, "part").select(
        value,
        *counts,
        *((F.col(f"{c}_before") + F.col(f"{c}_base")).alias(f"{c}_before") for c in counts),
        *(f"{c}_total" for c in counts),
    )


def ranked_pairs(rows: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """One row: ``won``, twice the pairs of a ``low`` with a ``high`` of larger value, ties once, and both totals.

    Each part of the order is reduced to four numbers before parts are put together.
    """
    won = F.col(high).cast("double") * (2 * F.col(f"{low}_before") + F.col(low))
    parts = in_order(rows, value, [low, high]).groupBy("part").agg(
        F.sum(low).alias(low), F.sum(high).alias(high), F.sum(won).alias("inside")
    )
    over = F.col("inside") + 2.0 * F.col(high) * F.col(f"{low}_base")
    return _bases(parts, [low]).agg(F.sum(over).alias("won"), F.sum(low).alias(low), F.sum(high).alias(high))


def values_at(
    rows: DataFrame, value: str, wanted: dict[int | None, list[int]], by: str | None = None
) -> dict[tuple[int | None, int], float]:
    """The values at the given ranks (from 0) of each group, exactly: {(group, rank): value}.

    Radix selection. A pass counts the values of an interval in ``PARTS`` equal
    parts, with the least and greatest value of each; only the parts that hold a
    wanted rank are read again, cut anew from their least to their greatest
    value. When few values are left they are listed, and parts of one value need
    no further pass. So passes send counts, nothing is sorted, and their number
    grows with the logarithm of the rows.

    ``by`` is a column of whole numbers; without it the group is None. Null, NaN and infinite values are left out;
    ranks outside a group have no value.
    """
    group = F.lit(None).cast("bigint") if by is None else F.col(by).cast("bigint")
    held = rows.select(group.alias("g"), F.col(value).cast("double").alias("v")).filter(
        "v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')"
    )
    ends = held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    found: dict[tuple[int | None, int], float] = {}
    left = []
    for end in ends:
        ranks = {r: r for r in wanted.get(end["g"], []) if 0 <= r < end["n"]}
        left.append((end["g"], end["n"], end["low"], end["high"], ranks))
    while left := [one for one in left if one[4]]:
        for g, _, low, high, ranks in left:
            if low == high:
                found |= {(g, rank): low for rank in ranks}
        left = [one for one in left if one[2] < one[3]]
        few = [one for one in left if one[1] <= LISTED]
        found |= _listed(held, few)
        left = [part for one in _counted(held, [one for one in left if one[1] > LISTED]) for part in one]
    return found


def _within(one: tuple, k: int) -> str:
    g, _, low, high, _ = one
    same = "g IS NULL" if g is None else f"g = {g!r}"
    return f"WHEN {same} AND v >= double('{low!r}') AND v <= double('{high!r}') THEN {k}"


def _listed(held: DataFrame, intervals: list[tuple]) -> dict[tuple[int | None, int], float]:
    """The wanted values of intervals of few values, which are listed."""
    if not intervals:
        return {}
    cases = " ".join(_within(one, k) for k, one in enumerate(intervals))
    rows = held.select(F.expr(f"CASE {cases} END").alias("k"), "v").filter("k IS NOT NULL").groupBy("k", "v").count().collect()
    found = {}
    for k, (g, _, _, _, ranks) in enumerate(intervals):
        values = sorted((row["v"], row["count"]) for row in rows if row["k"] == k)
        ends = np.cumsum([n for _, n in values])
        for rank, place in ranks.items():
            found[g, rank] = values[int(np.searchsorted(ends, place, "right"))][0]
    return found


def _share(low: float, high: float) -> str:
    """How far ``v`` is on the way from ``low`` to ``high``; by halves, if their difference is too large for a double."""
    if math.isinf(high - low):
        return f"(v / 2 - double('{low / 2!r}')) / double('{high / 2 - low / 2!r}')"
    return f"(v - double('{low!r}')) / double('{high - low!r}')"


def _counted(held: DataFrame, intervals: list[tuple]) -> Iterator[list[tuple]]:
    """For each interval its parts that hold wanted ranks, each with its own least and greatest value."""
    if not intervals:
        return
    cases = " ".join(_within(one, k) for k, one in enumerate(intervals))
    places = " ".join(f"WHEN {k} THEN floor({_share(low, high)} * {PARTS})" for k, (_, _, low, high, _) in enumerate(intervals))
    parts = (
        held.select(F.expr(f"CASE {cases} END").alias("k"), "v")
        .filter("k IS NOT NULL")
        .withColumn("part", F.expr(f"least({PARTS - 1}, CASE k {places} END)"))
        .groupBy("k", "part")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()
    )
    for k, (g, _, _, _, ranks) in enumerate(intervals):
        own = sorted((row["part"], row["n"], row["low"], row["high"]) for row in parts if row["k"] == k)
        before, kept = 0, []
        for _, n, low, high in own:
            inside = {rank: place - before for rank, place in ranks.items() if before <= place < before + n}
            if inside:
                kept.append((g, n, low, high, inside))
            before += n
        yield kept


def exact_quantiles(rows: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row with the linearly interpolated quantiles, one column each; null if there are no values."""
    n = rows.filter(_known(value) + f" AND abs(`{value}`) < double('infinity')").count()
    places = {name: (n - 1) * float(q) for name, q in quantiles.items()}
    ranks = sorted({end for place in places.values() for end in (math.floor(place), math.ceil(place))}) if n else []
    at = values_at(rows, value, {None: ranks})
    found = []
    for place in places.values():
        low, high = (at.get((None, end)) for end in (math.floor(place), math.ceil(place)))
        found.append(None if low is None or high is None else low + (place - math.floor(place)) * (high - low))
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in quantiles])
    return rows.sparkSession.createDataFrame([tuple(found)], schema)
