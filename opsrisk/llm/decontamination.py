"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders. DataFrame operations alone.

Beside the templates, whose names are known by their capitals, words are compared
as they stand but for case, so that copies are found however they are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.llm.common import stored

#: Placeholders: no letters, so case leaves them alone.
NUMBER, NAME, UNIT = "⓪", "①", "②"

_BLANK = r"[ \t\n\x0B\f\r]"
BLANKS = " \t\n\x0b\x0c\r"
PLACEHOLDER = f"[{NUMBER}{NAME}{UNIT}]"
#: What a word loses at its ends, and where it is cut from the next.
MARKS = ".,;:!?\"'()*"
_CUT = rf"[{MARKS}]*{_BLANK}+[{MARKS}]*"

# Units of measure that count as such after a number.
UNITS = (
    "mm cm dm m km mg g kg t ml cl dl l s min h ms hz khz mhz ghz w kw mw kwh v a n j kj pa kpa bar "
    "inch inches foot feet yard yards mile miles ounce ounces pound pounds gallon gallons "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters "
    "litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees"
).split()

# Words for numbers, which count as these.
NUMBER_WORDS = dict(
    zip(
        (
            "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
            "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
        ).split(),
        [*range(21), 30, 40, 50, 60, 70, 80, 90, 100, 1000, 1_000_000],
        strict=True,
    )
)

#: Items of fewer words than this occur everywhere and say nothing.
LEAST_WORDS = 3

# A word has its capital from its place if a sentence ends before it; capitals and small letters are those of the
# Latin-1 alphabet. Repeated groups are possessive: Java repeats others by recursion, and a text with thousands of
# names or numbers in a row overflows the stack, which ends the executor.
_PROPER = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
NAMES = rf"([^.!?: \t\n\x0B\f\r]{_BLANK}+)({_PROPER}(?:{_BLANK}{_PROPER})*+)"
NUMBERS = r"[0-9]+(?:[.,:/][0-9]+)*+"
UNITS_AFTER = rf"({NUMBER}{_BLANK}?)({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})($|[^a-zß-öø-ÿ0-9])"


def template(text: Column) -> Column:
    """A text with placeholders for names, numbers and units after numbers, in lower case.

    A name is one or more capitalised words in a row that don't begin a sentence.
    Few texts have numbers; the others are spared two passes.
    """
    named = F.lower(F.regexp_replace(text, NAMES, f"$1{NAME}"))
    typed = F.regexp_replace(F.regexp_replace(named, NUMBERS, NUMBER), UNITS_AFTER, f"$1{UNIT}$3")
    return F.when(text.rlike("[0-9]"), typed).otherwise(named)


def _text() -> Column:
    return F.btrim(F.col("text"), F.lit(BLANKS + MARKS))


def with_words(rows: DataFrame) -> DataFrame:
    """``_words``: the template of ``text`` cut at ASCII white space and the punctuation beside it."""
    return rows.withColumn("_words", F.split(template(_text()), _CUT))


def windows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(``key``, ``place``, ``hash``) of each ``size`` template words in a row of ``text``."""
    words = with_words(rows.select(key, "text")).select(key, "_words")
    # the outer form: for the other, Spark asks first whether there are any words, and finds them twice
    places = F.explode_outer(F.when(F.size("_words") >= size, F.sequence(F.lit(0), F.size("_words") - size)))
    at = words.select(key, "_words", places.alias("place")).where("place IS NOT NULL")
    return at.select(key, "place", F.xxhash64(*(F.get("_words", F.col("place") + k) for k in range(size))).alias("hash"))


def _distinctive(items: DataFrame, key: str, size: int, literal: int) -> DataFrame:
    """Windows of the benchmark that have at least ``literal`` words besides placeholders."""
    words = with_words(items.select(key, "text")).select(key, "_words").where(F.size("_words") >= size)
    at = words.select(key, "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - size)).alias("place"))
    own = F.filter(F.slice("_words", F.col("place") + 1, size), lambda w: ~w.rlike(PLACEHOLDER))
    return windows(items, key, size).join(at.where(F.size(own) >= literal).select(key, "place"), [key, "place"], "left_semi")


def with_plain_words(rows: DataFrame) -> DataFrame:
    """``_words``: the lower-cased ``text`` cut like a template, with words for numbers as numbers."""
    numbers = F.create_map(*(F.lit(x) for word, n in NUMBER_WORDS.items() for x in (word, str(n))))
    words = F.split(F.lower(_text()), _CUT)
    # few words have the length of a word for a number and are looked up
    longest = max(map(len, NUMBER_WORDS))
    return rows.withColumn(
        "_words",
        F.transform(words, lambda w: F.when(F.length(w).between(3, longest), F.coalesce(F.element_at(numbers, w), w)).otherwise(w)),
    )


def plain_windows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(``key``, ``place``, ``hash``) of each ``size`` plain words in a row of ``text``; the hash is another one for each size."""
    words = with_plain_words(rows.select(key, "text")).select(key, "_words")
    places = F.explode_outer(F.when(F.size("_words") >= size, F.sequence(F.lit(0), F.size("_words") - size)))
    at = words.select(key, "_words", places.alias("place")).where("place IS NOT NULL")
    own = F.xxhash64(F.lit(-size), *(F.get("_words", F.col("place") + k) for k in range(size)))
    return at.select(key, "place", own.alias("hash"))


def _plain_known(items: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
    """The items' windows of plain words, of ``size`` words or, if an item has fewer, of all its words; and the sizes there are."""
    counted = with_plain_words(items).select("item_id", "text", F.least(F.size("_words"), F.lit(size)).alias("_n")).where(F.col("_n") >= LEAST_WORDS)
    sizes = list(range(LEAST_WORDS, size + 1))
    parts = [plain_windows(counted.where(F.col("_n") == n), "item_id", n) for n in sizes]
    held = [row["_n"] for row in counted.select("_n").distinct().collect()]
    return reduce(DataFrame.unionByName, parts), [n for n in sizes if n in held]


def leaks(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    literal: int = 3,
    min_coverage: float = 0.8,
    min_consistent: float = 0.8,
    slack: int = 16,
) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units, or in other case.

    One row per ``doc_id`` and ``item_id``: ``n_windows`` of the item, how many
    of them the document has in the right order within ``slack`` words
    (``n_found``, ``coverage``), ``n_slots`` (places in the found windows where a
    placeholder stands) and ``n_consistent``, those where equal values of the item
    stand for equal values of the document and the other way round. A pair counts
    from ``min_coverage`` of the windows and ``min_consistent`` of the slots on.

    An item is looked for in two ways. Its template windows need ``size`` words,
    ``literal`` of them ordinary ones. Its plain windows are lower-cased words with
    words for numbers as numbers; an item of fewer than ``size`` words is one window.
    Pairs that only the plain way finds have no slots.

    Items of fewer than three words are not looked for. Null and empty texts hold and are
    nothing; rows of null ids are left out. Rows of one id, in either table,
    count as one text that holds what any of them holds. Very long texts are
    looked through whole. Other columns are ignored. Empty tables give an empty result.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    items = items.where("item_id IS NOT NULL").select("item_id", "text")
    plain, sizes = _plain_known(items, size)
    of_template = _distinctive(items, "item_id", size, literal).withColumn("kind", F.lit(0))
    known = stored(
        of_template.unionByName(plain.withColumn("kind", F.lit(1))).select("item_id", "kind", F.col("place").alias("item_place"), "hash"),
        "benchmark-windows",
    )
    # found places go two ways into bands of 2 * slack diagonals, so that each pair of near diagonals shares a band
    shift = F.col("place") - F.col("item_place")
    bands = F.explode(F.array(F.floor(shift / (2 * slack)) * 2, F.floor((shift + slack) / (2 * slack)) * 2 + 1))
    looked = reduce(
        DataFrame.unionByName,
        [windows(docs, "doc_id", size).withColumn("kind", F.lit(0))]
        + [plain_windows(docs, "doc_id", n).withColumn("kind", F.lit(1)) for n in sizes],
    )
    matches = stored(looked.join(known, ["hash", "kind"]).drop("hash"), "benchmark-matches")
    pair = ["doc_id", "item_id"]
    per_band = matches.select("*", bands.alias("band")).groupBy(*pair, "kind", "band").agg(
        F.countDistinct("item_place").alias("n_found")
    )
    per_item = known.groupBy("item_id", "kind").agg(F.countDistinct("item_place").alias("n_windows"))
    best = (
        per_band.groupBy(*pair, "kind")
        .agg(F.max(F.struct("n_found", -F.col("band"))).alias("_best"))
        .select(*pair, "kind", F.col("_best.n_found").alias("n_found"), (-F.col("_best.col2")).alias("band"))
        .join(per_item, ["item_id", "kind"])
        .withColumn("coverage", F.col("n_found") / F.col("n_windows"))
        .where(F.col("coverage") >= min_coverage)
    )
    found = stored(best, "benchmark-found")
    typed = found.where("kind = 0")
    slots = _slots(docs, items, typed, matches.where("kind = 0").select("*", bands.alias("band")), size)
    columns = [*pair, "n_windows", "n_found", "coverage", "n_slots", "n_consistent"]
    consistent = stored(
        typed.join(slots, pair, "left")
        .na.fill(0, ["n_slots", "n_consistent"])
        .where((F.col("n_slots") == 0) | (F.col("n_consistent") >= min_consistent * F.col("n_slots")))
        .select(*columns),
        "benchmark-consistent",
    )
    none = F.lit(0).cast("bigint")
    others = found.where("kind = 1").join(consistent.select(*pair), pair, "left_anti")
    return consistent.unionByName(others.withColumns({"n_slots": none, "n_consistent": none}).select(*columns))


def _slots(docs: DataFrame, items: DataFrame, found: DataFrame, matches: DataFrame, size: int) -> DataFrame:
    """Per found pair the places with a placeholder, and how many of them agree with the most frequent partner of their value."""
    places = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    covered = (
        matches.join(found.select("doc_id", "item_id", "band"), ["doc_id", "item_id", "band"], "left_semi")
        .select("doc_id", "item_id", "place", "item_place", places.alias("_k"))
        .select("doc_id", "item_id", (F.col("place") + F.col("_k")).alias("at"), (F.col("item_place") + F.col("_k")).alias("item_at"))
        .distinct()
    )

    def values(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
        """The texts that the placeholders of a word stand for: the n-th placeholder of a kind is the n-th match.

        Words and matches go in rows of their own: a word that took all matches of
        its text along would make the square of a long text's names.
        """
        text = _text()
        named = F.lower(F.regexp_replace(text, NAMES, f"$1{NAME}"))
        counted = F.regexp_replace(named, NUMBERS, NUMBER)
        matches = {
            NAME: F.regexp_extract_all(text, F.lit(NAMES), F.lit(2)),
            NUMBER: F.regexp_extract_all(named, F.lit(NUMBERS), F.lit(0)),
            UNIT: F.regexp_extract_all(counted, F.lit(UNITS_AFTER), F.lit(2)),
        }

        def numbered(of: Column, kind: str) -> Column:
            return F.transform(of, lambda x, n: F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n"), x.alias("value")))

        # the join first: behind distinct() Spark leaves it, unless it is broadcast, and all texts are shuffled whole
        wanted = rows.join(found.select(key).distinct(), key, "left_semi").distinct().withColumn("_of", F.xxhash64("text"))
        parts = F.concat(numbered(F.col("_words"), ""), *(numbered(of, kind) for kind, of in matches.items()))
        # the outer form, as above
        every = with_words(wanted).select(key, "_of", F.explode_outer(parts).alias("_part")).select(key, "_of", "_part.*")
        every = stored(every.where((F.col("kind") != "") | F.col("value").rlike(PLACEHOLDER)), "benchmark-values")
        own = F.array(*(F.struct(F.lit(k).alias("kind"), F.length("value") - F.length(F.replace("value", F.lit(k), F.lit("")))) for k in matches))
        marked = (
            every.where("kind = ''").select(key, "_of", F.col("n").alias(at), F.explode(own).alias("_own"))
            .select(key, "_of", at, F.col("_own.kind").alias("kind"), F.col("_own.col2").alias("_many")).where("_many > 0")
        )
        before = Window.partitionBy(key, "_of", "kind").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        ends = marked.withColumn("_end", F.sum("_many").over(before))
        places = ends.select(key, "_of", at, "kind", F.explode(F.sequence(F.col("_end") - F.col("_many"), F.col("_end") - 1)).alias("n"))
        rank = F.when(F.col("kind") == NAME, 0).when(F.col("kind") == NUMBER, 1).otherwise(2)
        said = places.join(every.where("kind <> ''"), [key, "_of", "kind", "n"], "left").groupBy(key, "_of", at).agg(
            F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "n", "value"))).alias("_said")
        )
        return said.select(key, at, F.lower(F.concat_ws(" ", "_said.value")).alias(value))

    pairs = (
        covered.join(values(items, "item_id", "item_at", "_theirs"), ["item_id", "item_at"])
        .join(values(docs, "doc_id", "at", "_ours"), ["doc_id", "at"])
        .groupBy("doc_id", "item_id", "_theirs", "_ours")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pair = ["doc_id", "item_id"]
    theirs = pairs.groupBy(*pair, "_theirs").agg(F.max(F.struct("n", "_ours")).alias("_a"))
    ours = pairs.groupBy(*pair, "_ours").agg(F.max(F.struct("n", "_theirs")).alias("_b"))
    agrees = (F.col("_a._ours") == F.col("_ours")) & (F.col("_b._theirs") == F.col("_theirs"))
    return (
        pairs.join(theirs, [*pair, "_theirs"])
        .join(ours, [*pair, "_ours"])
        .groupBy(*pair)
        .agg(F.sum("n").alias("n_slots"), F.sum(F.when(agrees, F.col("n")).otherwise(0)).alias("n_consistent"))
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without the documents that hold a benchmark item; rows without a doc_id stay."""
    held = leaks(docs, items, **options).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs["doc_id"] == held["_held"], "left_anti")
