"""Byte-level BPE with the tiktoken library and a local rank file: encoding, and decoding to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import batch_of, schema_of, without

#: Texts longer than this are encoded in pieces, cut at the next safe boundary.
PIECE_CHARS = 50_000

# The split pattern starts a new match wherever white space follows something else, and looks only ahead.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 bytes and rank per line), built once per Python worker."""
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where no match of the split pattern can span, at the first such place after ``size`` characters.

    A text without such places stays whole: its one match has to be merged as one.
    """
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to each row.

    A null text counts as empty and gives no ids. The strings of special tokens
    are ordinary text. Columns of ``df`` named ``ids`` or ``n_tokens`` are
    replaced, all others stay. Rows are independent: repeated rows and ties give
    equal results, an empty table gives none.
    """
    new = schema_of("ids binary, n_tokens bigint")
    kept = without(df, new.names)
    at = kept.columns.index(next(c for c in kept.columns if c.lower() == text.lower()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks, pattern)
        for batch in batches:
            ids, sizes = [], []
            for value in batch.column(at):
                found = [
                    np.array(coder.encode_ordinary(piece), "<u4").tobytes() for piece in pieces(value.as_py() or "")
                ]
                ids.append(b"".join(found))
                sizes.append(len(ids[-1]) // 4)
            added = batch_of(new, [ids, sizes])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added.columns], schema=pa.schema([*batch.schema, *added.schema])
            )

    return kept.mapInArrow(run, type(new)([*kept.schema.fields, *new.fields]))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the raw bytes of each row's ids. Null ids decode to nothing, unknown ids fail."""
    new = schema_of("decoded binary")
    kept = without(df, new.names)
    at = kept.columns.index(next(c for c in kept.columns if c.lower() == ids.lower()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks, pattern)
        for batch in batches:
            found = [coder.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(at)]
            added = batch_of(new, [found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added.columns], schema=pa.schema([*batch.schema, *added.schema])
            )

    return kept.mapInArrow(run, type(new)([*kept.schema.fields, *new.fields]))


def digests(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode and decode ``text``: per row ``doc_id``, ``n_tokens``, and the SHA-256 of the ids and of the decoded bytes."""
    coded = encode(df.select("doc_id", "text"), ranks, pattern)
    ids = coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    return decode(ids, ranks, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
