"""Label, feature matrix and train/test split for the delay classifier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.constants import DELAY_LABEL_THRESHOLD, LEAK_COLUMNS
from opsrisk.functions.rates import binary_label
from opsrisk.operators.ordered import values_at

LABEL = "high_delay"


def with_label(rows: DataFrame, threshold: float = DELAY_LABEL_THRESHOLD) -> DataFrame:
    return rows.withColumn(LABEL, binary_label(F.col("delay_rate"), threshold))


def model_matrix(labelled: DataFrame, target: str = LABEL) -> DataFrame:
    """The numeric columns, by schema, without the target and what gives it away."""
    numeric = [f.name for f in labelled.schema if isinstance(f.dataType, T.NumericType)]
    return labelled.select(*numeric).drop(target, *LEAK_COLUMNS)


def _digest(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def with_split(rows: DataFrame, keys: list[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_train``: a fixed draw per row key, the same share in every class.

    The first 32 bits of a digest of key and seed are compared with the cut, so
    the draw needs no sort and no shuffle and stays the same however the rows
    are partitioned.
    """
    cut = format(int((1.0 - test_fraction) * 2**32), "08x")
    return rows.withColumn("is_train", F.substring(_digest(keys, seed), 1, 8) < F.lit(cut))


def with_exact_split(
    rows: DataFrame, keys: list[str], test_fraction: float = 0.2, seed: int = 42, label: str = LABEL
) -> DataFrame:
    """Add ``is_train`` so that both classes give exactly their part of the test rows.

    The test rows are the fraction of all rows, rounded up; each class gives its
    part rounded down and the class with the larger remainder one more. Every
    row draws a number in [0, 1) from the digest of its key, and the smallest
    draws of a class are its test rows. Only the greatest of these is looked for,
    by counting, so nothing is sorted and no row moves.
    """
    # 52 bits are a whole number a double holds exactly
    draw = F.conv(F.substring(_digest(keys, seed), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    drawn = rows.withColumn("_draw", draw)
    totals = dict.fromkeys((0, 1), 0) | {
        row[label]: row["n"] for row in rows.groupBy(label).agg(F.count("*").alias("n")).collect() if row[label] in (0, 1)
    }
    limits = {}
    for c, quota in _test_quotas(totals, test_fraction).items():
        limits[c] = [quota - 1] if quota else []
    at = values_at(drawn.select(label, "_draw"), "_draw", limits, by=label)
    last = {c: at.get((c, ranks[0]), 1.0) if ranks else -1.0 for c, ranks in limits.items()}
    limit = F.when(F.col(label) == 1, last[1]).otherwise(last[0])
    return drawn.withColumn("is_train", F.col("_draw") > limit).drop("_draw")


def _test_quotas(totals: dict[int, int], test_fraction: float) -> dict[int, int]:
    """How many test rows each class gives."""
    n = sum(totals.values())
    if not n:
        return dict.fromkeys(totals, 0)
    tests = math.ceil(n * test_fraction)
    share = {c: total * float(tests) / n for c, total in totals.items()}
    parts = {c: math.floor(x) for c, x in share.items()}
    spared = 1 if share[1] - parts[1] >= share[0] - parts[0] else 0
    parts[spared] += tests - sum(parts.values())
    return parts
