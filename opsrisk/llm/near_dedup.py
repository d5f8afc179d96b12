"""Near-duplicate documents by min-max hashing of word shingles, banding, and confirmation on the full sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import WordIds, batch_of, dropped, mixed, schema_of, stored, window_hashes, word_ids
from opsrisk.llm.components import components

#: Each permutation gives two values, so 300 values cost 150 hashes of a shingle. With 50 bands of six a pair at a
#: similarity of 0.8 shares no band with a probability of 3e-7.
PERMUTATIONS, ROWS = 150, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Pairs whose signatures agree in a share that is smaller than the similarity asked for by this much are not looked at
#: further: five standard deviations of 300 values.
MARGIN = 0.12
#: Buckets of up to so many unsettled members are compared pair by pair, larger ones as blocks of so many members.
PAIRWISE, BLOCK = 64, 2048

_SEEDS = (mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None]
_CHUNK = 512


def shingles(text: str | None, size: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of each ``size`` words in a row; of all words, if there are fewer; none without words."""
    words = word_ids(text, ids)
    if 0 < len(words) < size:
        return window_hashes(words, len(words))
    return np.unique(window_hashes(words, size))


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), _CHUNK):
        x = short[None, start : start + _CHUNK] ^ _SEEDS
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def _bands(values: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    """Texts with what finds them again: ``doc_id`` and a hash of the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """Per row ``doc_id``, ``text_hash``, ``n``, ``key`` (128 bits that name the set), ``bands`` and ``sketch``.

    Sets are some times larger than that and are not kept; those that are
    compared are made again by ``_sets``.
    """
    fields = schema_of("doc_id bigint, text_hash bigint, n bigint, key binary, bands array<bigint>, sketch binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(at, 500)
                for text in part.column(1):
                    own = shingles(text.as_py(), size, ids)
                    if len(own):
                        signed = signature(own)
                        sketch = (signed & np.uint32(255)).astype(np.uint8).tobytes()
                        rows.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), _bands(signed), sketch))
                    else:
                        rows.append((0, None, None, None))
                yield batch_of(fields, [part.column(0), part.column(2), *zip(*rows, strict=True)])

    return _named(docs).mapInArrow(run, fields)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(``node``, ``shingles``) of the wanted rows (``node``, ``doc_id``, ``text_hash``), written.

    Texts and wanted rows meet by a sort-merge join at every size.
    """
    fields = schema_of("node bigint, shingles binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield batch_of(fields, [part.column(0), [shingles(text.as_py(), size, ids).tobytes() for text in part.column(1)]])

    rows, ids = _named(docs), wanted.select("node", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))
    found = stored(rows.join(ids.hint("merge"), same).select("node", "text").mapInArrow(run, fields), "near-sets")
    if found.count() == wanted.count():
        return found
    # equal rows were found for one node
    single = stored(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")
    dropped(found)
    return single


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose sketches don't rule them out, by the share of values that agree."""
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch"))
    both = pairs.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v")
    fields = schema_of("u bigint, v bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                near = pa.array((a == b).mean(1) >= percent / 100 - MARGIN)
                yield batch_of(fields, [batch.column(0).filter(near), batch.column(1).filter(near)])

    return both.select("u", "v", "u_sketch", "v_sketch").mapInArrow(run, fields)


def _linked(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, written."""
    near = stored(_near(pairs, nodes, percent), "near-pairs")
    wanted = stored(near.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-wanted")
    full = stored(_full(sets, wanted), "near-sets")
    of = lambda side: full.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
    fields = schema_of("u bigint, v bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[bool] = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                # both are sorted and distinct: a value of both sets appears twice in a row
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                links.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch_of(fields, [batch.column(k).filter(pa.array(links, pa.bool_())) for k in (0, 1)])

    both = near.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v").select("u", "v", "u_set", "v_set")
    links = stored(both.mapInArrow(run, fields), "near-links")
    dropped(near, wanted, full)
    return links


def _full(full: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the wanted nodes. This join and others of sets or sketches are sort-merge joins at every size."""
    return full.join(wanted.hint("merge"), "node", "left_semi")


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between members of different groups in a bucket, found without listing pairs, written.

    A bucket is dealt into blocks; each two of them are one task's work, of a
    bounded number of sets, and only links come out.
    """
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    dealt = members.select("bucket", "node", "root", blocks.alias("of"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    every = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    every = every.select("bucket", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = every.join(_full(sets, members.select("node").distinct()), "node")
    fields = schema_of("u bigint, v bigint")

    def run(group: pa.Table) -> pa.Table:
        nodes, roots = group["node"].to_pylist(), np.array(group["root"].to_pylist())
        own = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        sizes = np.array([len(x) for x in own])
        values, columns = np.unique(np.concatenate(own), return_inverse=True)
        rank = np.repeat(np.arange(len(own)), sizes)
        common = np.zeros((len(own), len(own)), np.float32)
        order = np.argsort(columns, kind="stable")
        columns, rank = columns[order], rank[order]
        for start in range(0, len(values), 4096):
            low, high = np.searchsorted(columns, [start, start + 4096])
            held = np.zeros((len(own), 4096), np.float32)
            held[rank[low:high], columns[low:high] - start] = 1
            common += held @ held.T
        union = sizes[:, None] + sizes[None, :] - common
        linked = (100 * common >= percent * union) & (roots[:, None] < roots[None, :])
        found = np.argwhere(linked)
        return pa.Table.from_batches(
            [batch_of(fields, [[min(nodes[a], nodes[b]) for a, b in found], [max(nodes[a], nodes[b]) for a, b in found]])]
        )

    return stored(rows.groupBy("bucket", "i", "j").applyInArrow(run, fields).distinct(), "near-links")


def _own(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(``node``, ``own``): how many shingles a member shares with no other member; they are in no intersection."""
    fields = schema_of("node bigint, shingle bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                values = np.frombuffer(packed, np.int64)
                yield batch_of(fields, [[node] * len(values), pa.array(values)])

    each = _full(sets, members.select("node").distinct()).mapInArrow(run, fields)
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _unsettled(members: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` of the buckets that still hold several groups, with each node's ``root`` and ``own``."""
    labelled = members.select("bucket", "node", "n").join(groups, "node", "left")
    labelled = stored(labelled.withColumn("root", F.coalesce("root", "node")), "near-labels")
    several = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    left = stored(labelled.join(several.select("bucket"), "bucket", "left_semi"), "near-members")
    found = stored(left.join(_own(sets, left), "node", "left").na.fill(0, ["own"]), "near-members")
    dropped(labelled, left)
    return found


def _possible(a: str, b: str, percent: int) -> str:
    """Whether sets of these sizes, without the shingles that are theirs alone, can be similar enough."""
    common = f"least({a}n - {a}own, {b}n - {b}own)"
    return f"100 * {common} >= {percent} * ({a}n + {b}n - {common})"


def _pairs(some: DataFrame, others: DataFrame, which: str, percent: int) -> DataFrame:
    """Distinct pairs (``u``, ``v``) of a bucket's nodes that may be linked and are in different groups."""
    both = F.expr(f"a.bucket = b.bucket AND {which} AND a.root <> b.root AND {_possible('a.', 'b.', percent)}")
    met = some.alias("a").join(others.alias("b"), both)
    return met.select(F.expr("least(a.node, b.node)").alias("u"), F.expr("greatest(a.node, b.node)").alias("v")).distinct()


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set has its distinct shingles of ``size`` words (its whole
    sequence of words as one, if it has fewer). Documents are linked if 100 times
    the size of the intersection is at least ``percent`` times that of the union;
    ``component_id`` is the smallest ``doc_id`` reachable over links. ``kept``
    marks the rows of that document.

    Candidates share a band of their min-max signatures; every link is confirmed
    on the full sets. Taken as independent values, those of a pair at a similarity
    of exactly 0.8 share no band with a probability of 3e-7, and agree in too few
    places to be looked at further with one of 6e-7; both fall quickly above it. Equal sets are one node, whatever the number of copies. In a
    bucket each node is compared with a leader. Then nodes are compared with each
    other, but only those that no chain of links joins yet and that have enough
    shingles that others have, too.

    Null and wordless texts have no shingles and stand alone. Rows of one doc_id
    may differ; each has its own set. Rows without a doc_id link others, belong
    to the class of the smallest id (null, if there is none) and are kept. Equal
    rows are kept or not together. Very long texts are shingled whole. Other
    columns, also of the result's names, are ignored. An empty table gives an empty one.
    """
    sets = stored(_signed(docs, size).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    # a set is known by the first of its rows
    nodes = stored(
        sets.where("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.min("row").alias("node"),
            F.min("doc_id").alias("least_id"),
            F.min_by(F.struct("doc_id", "text_hash"), "row").alias("at"),
            *(F.first(name).alias(name) for name in ("n", "bands", "sketch")),
        ),
        "near-nodes",
    )
    rows = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    every = stored(
        rows.join(shared.select("bucket"), "bucket", "left_semi").selectExpr("*", "node AS root", "0L AS own"), "near-members"
    )
    members = every
    # of the sets, only those that share a bucket are ever compared
    compared = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "at.*")
    full = _sets(docs, stored(compared, "near-compared"), size)

    leaders = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n", "own", "root")).alias("x"))
    led = stored(_pairs(members, leaders.select("bucket", "x.*"), "a.node <> b.node", percent), "near-tried")
    groups = components(_linked(led, full, nodes, percent))
    # from here on a group is its star: what follows adds to that and doesn't find it again
    stars = groups.where("node <> root").selectExpr("node AS u", "root AS v")

    members = _unsettled(members, groups, full)
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    blocks = _within(members.join(counts.where(f"k > {PAIRWISE}"), "bucket"), full, percent)
    small = stored(members.join(counts.where(f"k <= {PAIRWISE}").select("bucket"), "bucket"), "near-members")
    met = stored(_pairs(small, small, "a.node < b.node", percent).join(led, ["u", "v"], "left_anti"), "near-tried")
    links = stars.unionByName(blocks).unionByName(_linked(met, full, nodes, percent))
    groups = nodes.select("node", "least_id").join(components(links), "node", "left")
    dropped(every, members, small, led, met, full)
    groups = groups.withColumn("root", F.coalesce("root", "node"))
    of_root = groups.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_key = groups.join(of_root, "root").join(nodes.select("node", "key"), "node").select("key", "component_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(of_key, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each class left, all columns kept; a doc_id stays if any row of it does."""
    gone = classes(docs, size, percent).groupBy("doc_id").agg(F.max("kept").alias("any")).where("NOT any")
    gone = gone.select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
