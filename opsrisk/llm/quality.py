"""Document quality by regularised quadratic discriminant analysis over transformed text statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import batch_of, schema_of, stored, without

#: Statistics of a text, each transformed so that a class is closer to a normal distribution.
STATISTICS = (
    "word_length line_length upper digits sentence_marks shout_marks bars symbols non_ascii blanks "
    "distinct_words distinct_lines top_word short_words compressed"
).split()
SIZE = len(STATISTICS)

#: Every statistic is taken as if ordinary prose of so many bytes, words and lines had come before the text, so that
#: short texts are near the middle and not scattered at random.
PRIOR_BYTES, PRIOR_WORDS, PRIOR_LINES = 120, 20, 3

_UPPER = np.arange(ord("A"), ord("Z") + 1)
_LOWER = np.arange(ord("a"), ord("z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)
_SENTENCE = np.frombuffer(b".,;:'\"()-?", np.uint8)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)
_BLANKS = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; those of a null or empty text are the prior's."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line]
    seen = Counter(words)
    n, n_words, n_lines = len(data) + PRIOR_BYTES, len(words) + PRIOR_WORDS, len(lines) + PRIOR_LINES
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + PRIOR_BYTES

    def share(which, usual: float = 0.0, of: float = n) -> float:
        return ((counts[which].sum() + usual * PRIOR_BYTES) / of) ** 0.5

    short = sum(seen[w] for w in seen if len(w) <= 3)
    return [
        np.log(n / n_words),
        np.log(n / n_lines),
        share(_UPPER, 0.03, letters),
        share(_DIGITS),
        share(_SENTENCE, 0.03),
        share([ord("!")]),
        share([ord("|")]),
        share(_SYMBOLS),
        share(slice(128, 256), 0.03),
        share(_BLANKS, 0.16),
        np.log((len(seen) + PRIOR_WORDS) / n_words),
        np.log((len(set(lines)) + PRIOR_LINES) / n_lines),
        ((max(seen.values(), default=0) + 1) / n_words) ** 0.5,
        ((short + 0.4 * PRIOR_WORDS) / n_words) ** 0.5,
        np.log(((len(zlib.compress(data, 1)) if data else 0) + 0.4 * PRIOR_BYTES) / n),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``x``): the statistics of each row's text."""
    fields = schema_of("doc_id bigint, x array<double>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(fields, [batch.column(0), [statistics(text.as_py()) for text in batch.column(1)]])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, fields)


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the class covariances, and log priors; rows are classes 0 and 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``, from the difference of the two log densities."""
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.log_priors, strict=True):
            whitened = np.linalg.solve(factor, (z - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (whitened**2).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def moments(rows: DataFrame, label: str) -> np.ndarray:
    """Per class the count, the sums and the sums of products of ``x``: all learning rows, two rows of numbers.

    Tasks sum their own rows, the sums of tasks are added by Spark.
    """
    fields = schema_of("label int, k int, value double")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + SIZE + SIZE * SIZE))
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, SIZE)
            labels = np.array(batch.column(0).to_pylist(), int)
            for c in (0, 1):
                own = x[labels == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c in (0, 1):
            if sums[c, 0]:
                yield batch_of(fields, [[c] * sums.shape[1], range(sums.shape[1]), sums[c].tolist()])

    out = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    parts = rows.select(F.col(label).cast("int"), "x").mapInArrow(add, fields)
    for row in parts.groupBy("label", "k").agg(F.sum("value").alias("value")).collect():
        out[row.label, row.k] = row.value
    return out


def fitted(sums: np.ndarray, shrink: float, pool: float) -> Discriminant | None:
    """The discriminant from the moments of both classes, or None if a class has fewer than two rows.

    Values are standardised over all learning rows first. A class covariance is
    drawn by ``pool`` towards that of both classes and by ``shrink`` towards a
    multiple of the unit matrix of the same trace.
    """
    n = sums[:, 0]
    if n.min() < 2:
        return None
    means = sums[:, 1 : 1 + SIZE] / n[:, None]
    scatters = [s.reshape(SIZE, SIZE) / k - np.outer(m, m) for s, k, m in zip(sums[:, 1 + SIZE :], n, means, strict=True)]
    weights = n / n.sum()
    centre = weights @ means
    within = sum(w * s for w, s in zip(weights, scatters, strict=True))
    spread = sum(w * np.outer(m - centre, m - centre) for w, m in zip(weights, means, strict=True))
    scale = np.sqrt(np.maximum(np.diag(within + spread), 1e-8))
    between = np.outer(scale, scale)
    factors = []
    for scatter in scatters:
        own = (1 - pool) * scatter / between + pool * within / between
        target = max(np.trace(own) / SIZE, 1e-3)
        factors.append(np.linalg.cholesky((1 - shrink) * own + (shrink * target + 1e-6) * np.eye(SIZE)))
    return Discriminant(centre, scale, (means - centre) / scale, np.array(factors), np.log(weights))


def held_out(doc_id: str, parts: int, part: int):
    """Whether a document is kept from learning; one without an id is not, and has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def scored(
    docs: DataFrame,
    labels: DataFrame,
    parts: int = 4,
    part: int = 2,
    shrink: float = 0.05,
    pool: float = 0.1,
    threshold: float = 0.7,
) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Learns ``quality`` from all labelled documents that are not held out, from
    the text alone. A document labelled more than once counts once, as 1 if any
    label says so; null ids and labels teach nothing. Null texts count as empty
    and are scored. Repeated rows each get their score. Without two learning rows
    of either class every score is 0.5. An empty table gives an empty one.
    """
    x = stored(with_statistics(docs), "quality-statistics").withColumn("held_out", held_out("doc_id", parts, part))
    truth = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
    )
    model = fitted(moments(x.where("NOT held_out").join(truth, "doc_id"), "quality"), shrink, pool)
    fields = schema_of("doc_id bigint, held_out boolean, score double, predicted int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column(2).to_pylist(), float).reshape(-1, SIZE)
            score = model.score(values) if model else np.full(len(values), 0.5)
            yield batch_of(
                fields, [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            )

    return x.select("doc_id", "held_out", "x").mapInArrow(run, fields)


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose documents are predicted good, with all their columns.

    Rows of one doc_id with different texts stand or fall together: they stay if
    any of them is good. Rows without a doc_id can't be told apart and are kept.
    """
    good = scored(docs, labels, **options).where("predicted = 1").select(F.col("doc_id").alias("_good")).distinct()
    rows = without(docs, ["_good"])
    return rows.join(good, rows["doc_id"] == good["_good"], "left").where("_good IS NOT NULL OR doc_id IS NULL").drop("_good")
