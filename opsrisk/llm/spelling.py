"""Spelling variants: words one edit apart, found as neighbours in the sorted rotations of all words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.llm.common import batch_of, schema_of, stored

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}

#: Distinct words that a task counts before it sends them on.
HELD = 500_000

WORDS = schema_of("word string, n bigint")


def words(df: DataFrame, drop_every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(``word``, ``n``): distinct words of at least ``least_length`` code points and how often they occur, ``least_count`` times at least.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, with
    A-Z lower-cased. A run whose checksum, CRC-32 of ``<doc_id>:<run>``, is
    divisible by ``drop_every`` loses the code point that the checksum picks. A
    null doc_id counts as empty, a null or empty text has no words; repeated rows
    count again; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            found = {w: n for w, n in held.items() if len(w) >= least_length}
            held.clear()
            return batch_of(WORDS, [list(found), list(found.values())])

        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                own = Counter(_RUN.findall((text.as_py() or "").translate(_LOWER)))
                mark = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word in [w for w in own if zlib.crc32(w.encode(), mark) % drop_every == 0]:
                    at = zlib.crc32(word.encode(), mark) % len(word)
                    held[word[:at] + word[at + 1 :]] += own.pop(word)
                held.update(own)
                if len(held) > HELD:
                    yield sent()
        yield sent()

    counted = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, WORDS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """The prefixes under which one edit brings words together: (``prefix``, ``edited``, ``drops``, ``word``, ``n``).

    A word with a terminator is turned to each of its places. The whole rotation
    is a prefix, with no character edited. If it ends in a character of the word,
    that is the one skipped: the rotation without it is a prefix of all words that
    differ there, and the whole rotation of the word that lacks it. ``drops``
    tells whether the skipped character is the last of a run of equal ones, so
    that leaving out any of the run counts once.
    """
    marked = words.select("word", "n", F.concat("word", F.lit("$")).alias("m"), F.length("word").alias("size"))
    turned = marked.select("word", "n", "m", "size", F.explode(F.expr("sequence(0, size)")).alias("at"))
    # the rotation that begins after the first ``at`` characters ends with the character before
    rotation = F.expr("concat(substring(m, at + 1), substring(m, 1, at))")
    whole = F.struct(rotation.alias("prefix"), F.lit(False).alias("edited"), F.lit(False).alias("drops"))
    skipped = F.struct(
        F.expr("concat(substring(m, at + 1), substring(m, 1, at - 1))").alias("prefix"),
        F.lit(True).alias("edited"),
        F.expr("substring(m, at, 1) <> substring(m, at + 1, 1)").alias("drops"),
    )
    both = F.when(F.col("at") > 0, F.array(whole, skipped)).otherwise(F.array(whole))
    return turned.select("word", "n", F.inline(both))


def near_words(words: DataFrame) -> DataFrame:
    """Per word that has any: ``word``, ``n_near`` (words one edit away) and ``best``, of those the most frequent, as (-n, word).

    Rotations are sorted by prefix and scanned. A group has the words that differ
    in one place, at most one for each character of the alphabet, and the one
    word that lacks it. Each word needs from its group only how many others there
    are and the first or second of them, so no pairs are listed.
    """
    found = _rotations(words).withColumn("rank", F.struct((-F.col("n")).alias("minus_n"), "word"))
    group = Window.partitionBy("prefix")
    sorted_ = Window.partitionBy("prefix").orderBy(F.desc("edited"), "rank")
    scanned = found.select(
        "word",
        "edited",
        "drops",
        "rank",
        F.count_if("edited").over(group).alias("others"),
        F.count_if("drops").over(group).alias("droppers"),
        F.min(F.when(~F.col("edited"), F.col("rank"))).over(group).alias("shorter"),
        F.min(F.when(F.col("drops"), F.col("rank"))).over(group).alias("longer"),
        F.first("rank").over(sorted_).alias("first"),
        F.lead("rank").over(sorted_).alias("next"),
    )
    has_shorter = F.col("drops") & F.col("shorter").isNotNull()
    replaced = F.when(F.col("others") > 1, F.when(F.col("first") == F.col("rank"), F.col("next")).otherwise(F.col("first")))
    near = scanned.select(
        "word",
        F.when(F.col("edited"), F.col("others") - 1 + has_shorter.cast("bigint")).otherwise(F.col("droppers")).alias("k"),
        F.when(F.col("edited"), F.least(replaced, F.when(has_shorter, F.col("shorter")))).otherwise(F.col("longer")).alias("rank"),
    )
    return near.where("k > 0").groupBy("word").agg(F.sum("k").alias("n_near"), F.min("rank").alias("best"))


def _rooted(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) of (``word``, ``form``): forms followed to the last, by doubling.

    A form is at least twice as frequent as its word, so chains are short and
    have no rings: as many rounds as the logarithm of their length.
    """
    known = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(
            known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        known = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return known


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """Per row of (``word``, ``n``): ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    Two words are near if one inserted, deleted or replaced code point makes them
    equal. A word's ``form`` is its most frequent near word (ties: the smallest in
    code-point order) if that is at least ``factor`` times as frequent, else null.
    ``root`` is the last of the forms that follow from it, or the word itself.

    Words have to be distinct and free of ``$``. Words without near words have
    ``n_near`` 0; an empty table gives an empty one. No word is left out, however
    common or long.
    """
    words = stored(words, "spelling-words")
    joined = words.join(near_words(words), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.minus_n") >= factor * F.col("n"), F.col("best")).alias("best"),
    )
    near = stored(
        joined.select("word", F.col("best.word").alias("form"), "n", "n_near", (-F.col("best.minus_n")).alias("form_n")), "spelling-forms"
    )
    roots = _rooted(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
