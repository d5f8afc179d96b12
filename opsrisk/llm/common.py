"""What the operators of this subpackage share: tables, cuts in the lineage, hashing of words, output batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.session import scratch_path

#: Python's white space of one byte, as the word contracts name it.
BLANKS = b" \t\n\x0b\x0c\r"

#: Where stored() notes the folders it makes, if somebody asked; each thread has its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts the lineage on storage that outlives executors: a lost executor costs
    the tasks of one step, never the steps before it.
    """
    path = scratch_path(df.sparkSession, name)
    if (noting := _made.get()) is not None:
        noting.append(path)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


#: Whether Spark removes the shuffles of a write with its end, not when the driver's memory happens to be cleaned.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and the shuffles that made it are removed: for large ones that no later step reads."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)


def dropped(*tables: DataFrame) -> None:
    """Remove tables of stored(), whose readers are all written by now."""
    released(tables[0].sparkSession, [table.stored_at for table in tables])


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Note in ``paths`` the folders that stored() makes inside, in this thread."""
    outer = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(outer)


def released(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of stored(), once all results that were made from them are written elsewhere."""
    while paths:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without its columns of these names, whatever their case: an operator's own columns replace them."""
    taken = {name.lower() for name in names}
    return df.select(*(F.col(f"`{name}`") for name in df.columns if name.lower() not in taken))


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "boolean": T.BooleanType(),
}


def schema_of(fields: str) -> T.StructType:
    """A schema from "name type, name array<type>", without needing a session."""
    schema = T.StructType()
    for name, kind in (field.split() for field in fields.split(", ")):
        inner = _TYPES[kind.removeprefix("array<").removesuffix(">")]
        schema.add(name, T.ArrayType(inner) if kind.startswith("array<") else inner)
    return schema


def batch_of(fields: T.StructType, columns: Sequence[Any]) -> pa.RecordBatch:
    """A record batch of plain columns, typed as Spark expects them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(fields)
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, schema.types, strict=True)],
        schema=schema,
    )


class WordIds(dict):
    """64-bit ids of words as bytes; a bounded memory of the words met so far."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_ids(text: str | None, ids: WordIds) -> np.ndarray:
    """Ids of the words of a text: A-Z lower-cased, cut at ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` words in a row; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out
