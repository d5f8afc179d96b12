"""Token ids as flat binary files with 64-bit document offsets, written by Spark tasks and read back memory-mapped."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.llm.common import batch_of, schema_of, stored
from opsrisk.llm.piece_codes import chunks, codes, with_end

#: Stands for a null doc_id in the files.
NO_ID = -(2**63)
#: Words a Python worker remembers, about 200 MB: with half as many it has twice as many to learn again.
REMEMBERED = 1_000_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if uri.startswith("/") or urlparse(uri).scheme == "file":
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def mapped(uri: str, kind: str, start: int = 0, count: int = -1) -> np.ndarray:
    """Elements of a flat file: memory-mapped where the folder is mounted, else read from their place in the store."""
    store, path = opened(uri)
    size = np.dtype(kind).itemsize
    if isinstance(store, fs.LocalFileSystem):
        held = os.path.getsize(path) // size
        count = held - start if count < 0 else count
        return np.memmap(path, kind, "r", start * size, (count,)) if count else np.empty(0, kind)
    with store.open_input_file(path) as file:
        count = file.size() // size - start if count < 0 else count
        return np.frombuffer(file.read_at(count * size, start * size), kind)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, added: bool = True) -> DataFrame:
    """Encode ``text`` of every row, append ``end_id``, and write flat id files in ascending ``doc_id`` order.

    Each partition of the order is a file of ids, a file of 64-bit offsets (first
    id of each document counted over all files, and one more for the end) and a
    file of 64-bit document ids. The bases of the partitions are prefix sums of
    their numbers of ids. Returns the index, one row per partition: ``part``,
    ``base``, ``n_docs``, ``width`` and the three files.

    Strings of added tokens, as ``<|endoftext|>``, get their ids, as the library's
    ``encode`` gives them; without ``added`` they are ordinary text.

    A null text is empty and gives the end id alone. Null doc_ids come first and
    are stored as the smallest 64-bit integer. Rows of equal doc_id are ordered
    by a hash of their text, equal rows in any order; both may span partitions.
    Other columns are ignored. An empty table gives an empty index. A task that
    runs again writes files of a new name, and only the index names files, so
    lost executors leave nothing but files that nobody reads.
    """
    ordered = (
        df.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.xxhash64("text").alias("tie"),
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange("doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
    )
    noted = schema_of("part int, place bigint, doc_id bigint, n_tokens bigint, ids_file string, width string")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = f"{folder}/ids-{part:06d}-{uuid4().hex}.bin"
        coder, out, place = codes(tokenizer, added, REMEMBERED), None, 0
        for batch in chunks(batches, 1):
            if out is None:
                store, path = opened(file)
                store.create_dir(os.path.dirname(path), recursive=True)
                out = store.open_output_stream(path)
            flat, sizes = with_end(*coder.encode(batch.column(1)), end_id)
            out.write(pa.py_buffer(flat))
            n = batch.num_rows
            yield batch_of(
                noted, [[part] * n, range(place, place + n), batch.column(0), sizes, [file] * n, [flat.dtype.str] * n]
            )
            place += n
        if out is not None:
            out.close()

    notes = stored(ordered.mapInArrow(write, noted), "token-notes")
    parts = notes.groupBy("part", "ids_file", "width").agg(
        F.sum("n_tokens").alias("n_ids"), F.count(F.lit(1)).alias("n_docs")
    )
    # One row per partition of the order: the running sum has as many rows as there are files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select(
            "part", "base", "n_docs", "ids_file", "width"
        ),
        "token-bases",
    )
    flat = (
        notes.drop("part", "width")
        .join(bases.drop("n_docs"), "ids_file")
        .withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        .repartition("ids_file")
        .sortWithinPartitions("ids_file", "place")
    )

    def offsets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Offsets | None = None
        for batch in batches:
            for ids_file, rows in batch.to_pandas().groupby("ids_file", sort=False):
                if own is None or own.ids_file != ids_file:
                    if own is not None:
                        yield own.close()
                    own = _Offsets(folder, rows.iloc[0])
                own.add(rows.n_tokens.to_numpy(), rows.doc_id.to_numpy())
        if own is not None:
            yield own.close()

    return stored(flat.mapInArrow(offsets, INDEX), "token-index")


INDEX = schema_of(
    "part int, base bigint, n_docs bigint, width string, ids_file string, offsets_file string, doc_ids_file string"
)


class _Offsets:
    """The offsets and document ids of one partition, written as they come."""

    def __init__(self, folder: str, first):
        self.ids_file, self.part, self.base, self.width = first.ids_file, int(first.part), int(first.base), first.width
        self.names = [f"{folder}/{kind}-{self.part:06d}-{uuid4().hex}.bin" for kind in ("offsets", "docs")]
        self.starts, self.docs = (store.open_output_stream(path) for store, path in map(opened, self.names))
        self.end, self.n_docs = self.base, 0
        self.starts.write(np.array([self.base], "<u8").tobytes())

    def add(self, n_tokens: np.ndarray, doc_ids: np.ndarray) -> None:
        ends = self.end + np.cumsum(n_tokens, dtype=np.int64)
        self.starts.write(ends.astype("<u8").tobytes())
        self.docs.write(doc_ids.astype("<i8").tobytes())
        self.end, self.n_docs = int(ends[-1]), self.n_docs + len(doc_ids)

    def close(self) -> pa.RecordBatch:
        self.starts.close()
        self.docs.close()
        row = [self.part, self.base, self.n_docs, self.width, self.ids_file, *self.names]
        return batch_of(INDEX, [[x] for x in row])


def read_token_files(index: DataFrame) -> DataFrame:
    """One row per document of the files that ``index`` names: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over
    the ids as little-endian unsigned 32-bit integers. Files are memory-mapped
    and one document is looked at after the other.
    """
    fields = schema_of("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = mapped(row["offsets_file"], "<u8").astype(np.int64)
                docs = mapped(row["doc_ids_file"], "<i8")
                ids = mapped(row["ids_file"], row["width"])
                local = starts - row["base"]
                for at in range(0, len(docs), 5000):
                    n = min(5000, len(docs) - at)
                    yield batch_of(
                        fields,
                        [
                            [None if x == NO_ID else x for x in docs[at : at + n].tolist()],
                            starts[at : at + n].tolist(),
                            np.diff(starts[at : at + n + 1]).tolist(),
                            [zlib.crc32(ids[local[k] : local[k + 1]].astype("<u4").tobytes()) for k in range(at, at + n)],
                        ],
                    )

    # as many tasks as files: by their bytes, the rows of the index would all go to one
    return index.repartition(max(1, index.count())).mapInArrow(read, fields)
