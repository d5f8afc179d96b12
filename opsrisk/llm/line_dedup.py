"""Lines that many documents share: two Bloom filters name the suspects, only suspects are shuffled and confirmed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import BLANKS, batch_of, schema_of, stored, without

#: Bits of a filter are merged in blocks of this many; positions in a block fit 16 bits.
BLOCK = 1 << 16
#: Hashes that a task gathers before it sends their bits.
FLUSH = 500_000


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    """Distinct keys of a text's lines that have at least ``min_chars`` code points."""
    return {key for line in (text or "").encode().split(b"\n") if _long(key := line_key(line), min_chars)}


def filter_bits(documents: int, lines_per_document: int, most: int) -> int:
    """Eight bits for each line expected, as a power of two between one block and ``most``."""
    return min(max(BLOCK, 1 << max(0, 8 * documents * lines_per_document - 1).bit_length()), most)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places in a filter for each hash, a row each."""
    return np.stack([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)])


def _packed(places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Block by block the set bits: 16-bit positions, or a bitmap where that is shorter."""
    places = np.unique(places)
    blocks, starts = np.unique(places >> np.uint64(16), return_index=True)
    for block, own in zip(blocks, np.split(places, starts[1:]), strict=True):
        inside = (own & np.uint64(BLOCK - 1)).astype("<u2")
        if 2 * len(inside) >= BLOCK // 8:
            bitmap = np.zeros(BLOCK, np.uint8)
            bitmap[inside] = 1
            yield int(block), np.packbits(bitmap).tobytes()
        else:
            yield int(block), inside.tobytes()


def _bitmap(packed: bytes) -> np.ndarray:
    if len(packed) == BLOCK // 8:
        return np.frombuffer(packed, np.uint8)
    bitmap = np.zeros(BLOCK, np.uint8)
    bitmap[np.frombuffer(packed, "<u2")] = 1
    return np.packbits(bitmap)


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """The twice-seen filter of all documents' keys as rows (``block``, ``seen``).

    Each task fills both filters for its own documents and sends the blocks that
    have bits. Merging, a bit counts as seen twice if one part has it so or if
    two parts have it once; a repeated key therefore always has all its bits.
    """
    sent = schema_of("block bigint, twice boolean, packed binary")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush() -> pa.RecordBatch:
            hashes, counts = np.unique(np.array(held, np.uint64), return_counts=True)
            held.clear()
            rows = [
                (block, twice, packed)
                for twice, own in ((False, hashes), (True, hashes[counts > 1]))
                if len(own)
                for block, packed in _packed(_places(own, bits).ravel())
            ]
            return batch_of(sent, list(zip(*rows, strict=True)))

        for batch in batches:
            for text in batch.column(0):
                held.extend(map(xxhash.xxh3_64_intdigest, keys_of(text.as_py(), min_chars)))
                if len(held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    merged = schema_of("block bigint, seen binary")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, twice, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                new = _bitmap(packed)
                once, repeated = blocks.setdefault(block, [np.zeros(BLOCK // 8, np.uint8) for _ in range(2)])
                if twice:
                    repeated |= new
                else:
                    repeated |= once & new
                    once |= new
        for block, (_, repeated) in blocks.items():
            if repeated.any():
                yield batch_of(merged, [[block], [repeated.tobytes()]])

    # a task holds the blocks dealt to it, whatever the number of parts that are merged into them
    return docs.select("text").mapInArrow(fill, sent).repartition("block").mapInArrow(merge, merged)


def _loaded(docs: DataFrame, min_chars: int, bits: int) -> Broadcast:
    """The filter in every executor: ``bits`` bits at most, however many documents there are."""
    whole = np.zeros(bits // 8, np.uint8)
    for row in twice_filter(docs, min_chars, bits).collect():
        whole[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(row.seen, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(whole)


def suspects(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(``doc_id``, ``key``) of each key that the twice-seen filter holds, once per row of ``docs``."""
    loaded = _loaded(docs, min_chars, bits)
    fields = schema_of("doc_id bigint, key binary")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = loaded.value
        for batch in batches:
            ids, keys, hashes = [], [], []
            for doc_id, text in zip(*batch.columns, strict=True):
                own = keys_of(text.as_py(), min_chars)
                ids.extend([doc_id.as_py()] * len(own))
                keys.extend(own)
                hashes.extend(map(xxhash.xxh3_64_intdigest, own))
            places = _places(np.array(hashes, np.uint64), bits)
            hit = np.flatnonzero(
                ((bitmap[places >> np.uint64(3)] >> (np.uint8(7) - (places & np.uint64(7)).astype(np.uint8))) & 1).all(0)
            )
            yield batch_of(fields, [[ids[k] for k in hit], [keys[k] for k in hit]])

    return docs.select("doc_id", "text").mapInArrow(look, fields)


def dropped_keys(docs: DataFrame, min_chars: int, min_docs: int, bits: int) -> DataFrame:
    """Per document the keys whose lines it loses: (``doc_id``, ``keys``).

    Exact: suspected keys are counted as they are, over distinct documents.
    """
    found = stored(suspects(docs, min_chars, bits), "line-suspects")
    # the largest doc_id keeps its lines; a null doc_id counts as one document that is smaller than all others
    shared = stored(
        found.select("key", "doc_id")
        .distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs),
        "line-shared",
    )
    # one row per shared line, of known size: sent to the suspects if it is small, so that no line's holders meet in a
    # task; else Spark joins by key and splits the tasks of frequent lines
    return (
        found.join(shared, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_shared_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    lines_per_document: int = 16,
    max_filter_bits: int = 1 << 27,
) -> DataFrame:
    """``docs`` with the lines removed that at least ``min_docs`` documents share, and ``n_lines``, ``n_dropped``.

    Texts are split at newlines. A line's key is the line without ASCII white
    space at its ends and with A-Z lower-cased. A key of at least ``min_chars``
    code points that is found in at least ``min_docs`` documents loses all its
    lines, except in the largest ``doc_id`` that holds it, which keeps all of
    them. The other lines stay as they are. A null or empty text has one empty
    line and comes out empty. Rows of one doc_id count as one document; null
    doc_ids count as one that is smaller than all others. All columns stay,
    ``n_lines`` (before) and ``n_dropped`` replace columns of these names. An
    empty table gives an empty one.

    A filter has eight bits per expected line up to ``max_filter_bits`` (16 MB),
    which bounds what is broadcast; a filter that is too small for the table only
    makes more suspects, never another result.
    """
    own = without(docs, ["n_lines", "n_dropped"])
    bits = filter_bits(docs.count(), lines_per_document, max_filter_bits)
    keys = dropped_keys(docs.select("doc_id", "text"), min_chars, min_docs, bits).select(
        F.col("doc_id").alias("_of"), F.col("keys").alias("_keys")
    )
    new = schema_of("n_lines bigint, n_dropped bigint")
    names, at = own.columns, next(k for k, c in enumerate(own.columns) if c.lower() == "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, dropped = [], [], []
            for text, keys in zip(batch.column(at), batch.column(len(names)), strict=True):
                value, drop = text.as_py() or "", set(keys.as_py() or ())
                lines = value.encode().split(b"\n")
                stay = [line for line in lines if line_key(line) not in drop] if drop else lines
                texts.append(value if len(stay) == len(lines) else b"\n".join(stay).decode())
                before.append(len(lines))
                dropped.append(len(lines) - len(stay))
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(texts, batch.schema.types[at])
            added = batch_of(new, [before, dropped])
            yield pa.RecordBatch.from_arrays(
                [*columns, *added.columns], schema=pa.schema([*list(batch.schema)[: len(names)], *added.schema])
            )

    joined = own.join(keys, own["doc_id"].eqNullSafe(keys["_of"]), "left").drop("_of")
    return joined.mapInArrow(cut, type(new)([*own.schema.fields, *new.fields]))


def digests(docs: DataFrame) -> DataFrame:
    """Per document ``n_lines``, ``n_dropped`` and the SHA-256 of the text that stays."""
    return drop_shared_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
