"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from labels of documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import batch_of, schema_of
from opsrisk.llm.quality import held_out

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has words."""
    for found in _SENTENCE.finditer(text):
        words = _WORD.findall(found.group().lower())
        if words:
            yield found.start(), found.end(), words


def marked(words: Iterable[str]) -> str:
    """Whole words with their ends marked, as the groups of characters see them."""
    return "".join([f"^{w}$" for w in words])


def features(word: str) -> list[str]:
    """The groups of three to five characters of a marked word, and the whole."""
    own = marked([word])
    return [own[k : k + n] for n in (3, 4, 5) for k in range(len(own) - n + 1)] + [own] * (len(own) > 5)


class Evidence:
    """Sums the weights of all features of a sentence in one pass over it."""

    def __init__(self, weights: dict[str, float]):
        self.found = ahocorasick.Automaton()
        for group, weight in weights.items():
            self.found.add_word(group, weight)
        if weights:
            self.found.make_automaton()

    def of(self, words: Iterable[str]) -> float:
        return sum(weight for _, weight in self.found.iter(marked(words))) if len(self.found) else 0.0


def _learn(texts: list[list[set[str]]], y: np.ndarray, weight: np.ndarray, rounds: int, ridge: float) -> tuple[dict[str, float], float]:
    """Weights of features and the bias that maximise the noisy-or likelihood of the documents' labels (Adam, all documents each round).

    Weights are not negative: harmless words around an insult don't excuse it.
    So only features are learned that toxic documents have more often than others.
    """
    ids: dict[str, int] = {}
    known: dict[str, np.ndarray] = {}
    for own in texts:
        for w in set().union(*own):
            if w not in known:
                known[w] = np.array([ids.setdefault(g, len(ids)) for g in features(w)], np.int64)
    size = len(ids)
    counts = np.zeros((2, size))
    for own, label in zip(texts, y, strict=True):
        if own:
            counts[label, np.unique(np.concatenate([known[w] for w in set().union(*own)]))] += 1
    rates = (counts + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    useful = (rates[1] > 2 * rates[0]) & (counts[1] > 1)
    known = {w: kept for w, f in known.items() if len(kept := f[useful[f]])}
    number = {w: k for k, w in enumerate(known)}
    words, of_sentence, of_document = [], [], []
    for document, own in enumerate(texts):
        for sentence in own:
            found = [number[w] for w in sentence if w in number]
            words += found
            of_sentence += [len(of_document)] * len(found)
            of_document.append(document)
    of_word, of_sentence, of_document = (np.array(x, np.int64) for x in (words, of_sentence, of_document))
    places = np.concatenate([*known.values(), np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(known)), [len(f) for f in known.values()])
    theta, bias = np.zeros(size), -5.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        of_words = np.bincount(owner, theta[places], len(known))
        z = np.clip(np.bincount(of_sentence, of_words[of_word], len(of_document)) + bias, -30, 30)
        missed = np.bincount(of_document, np.logaddexp(0, z), len(texts))  # -log P(no sentence is toxic)
        missed = np.clip(missed, 1e-12, 50)
        slope = weight * np.where(y == 1, -1 / np.expm1(missed), 1.0)
        by_sentence = slope[of_document] / (1 + np.exp(-z))
        by_word = np.bincount(of_word, by_sentence[of_sentence], len(known))
        gradient = np.append(np.bincount(places, by_word[owner], size) + ridge * theta, by_sentence.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        theta, bias = np.maximum(0, theta - move[:-1]), float(np.clip(bias - move[-1], -15, 0))
    return {g: float(theta[k]) for g, k in ids.items() if theta[k] > 0.02}, bias


def fit(docs: DataFrame, labels: DataFrame, parts: int, part: int, per_class: int, most_chars: int, rounds: int, ridge: float):
    """Weights and bias from a sample of the learning rows, or None if a class has no learning row.

    The sample is bounded: of each class the first ``per_class`` documents in an
    order given by a hash of their ids, among those of up to ``most_chars``
    characters. It is all that comes to the driver. Classes are weighted to their
    shares among all learning rows.
    """
    truth = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out("doc_id", parts, part))
    )
    shares = {row.toxic: row["count"] for row in truth.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return None
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        F.length("text").between(1, most_chars)
    )
    rows = []
    for toxic in (0, 1):
        # a document may be in more rows than one: a few more ids are taken than rows are wanted
        ids = truth.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        rows += known.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class).collect()
    texts = [[set(words) for _, _, words in sentences(row.text)] for row in rows]
    y = np.array([row.toxic for row in rows])
    if len(set(y.tolist())) < 2 or not any(texts):
        return None
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    return _learn(texts, y, weight / weight.mean(), rounds, ridge)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    parts: int = 5,
    part: int = 0,
    threshold: float = 0.5,
    per_class: int = 1500,
    most_chars: int = 10_000,
    rounds: int = 120,
    ridge: float = 0.02,
) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score``, ``predicted`` and ``sentences``.

    Every whole text is scored, by its text alone. A sentence runs to the next
    full stop, question mark, exclamation mark or newline; a document is toxic
    unless all its sentences are not. ``sentences`` lists start, end and score of
    the sentences that alone reach ``threshold``.

    A null, empty or wordless text has no sentence and the score 0. A document
    labelled more than once counts once, as toxic if any label says so; null ids
    and labels teach nothing. Repeated rows each get their score. Without learning
    rows of both classes every text scores 0. An empty table gives an empty one.
    """
    model = fit(docs, labels, parts, part, per_class, most_chars, rounds, ridge)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    fields = schema_of("doc_id bigint, held_out boolean, score double, predicted int, starts array<int>, ends array<int>, scores array<double>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shipped.value or ({}, -np.inf)
        evidence = Evidence(weights)
        for batch in batches:
            score, starts, ends, scores = [], [], [], []
            for text in batch.column(2):
                found = [(a, b, bias + evidence.of(set(words))) for a, b, words in sentences(text.as_py() or "")]
                z = np.array([x[2] for x in found])
                score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                own = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                hit = np.flatnonzero(own >= threshold)
                starts.append([found[k][0] for k in hit])
                ends.append([found[k][1] for k in hit])
                scores.append(own[hit].tolist())
            yield batch_of(
                fields,
                [batch.column(0), batch.column(1), score, [int(s >= threshold) for s in score], starts, ends, scores],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", parts, part).alias("held_out"), "text")
    return rows.mapInArrow(run, fields).select(
        "doc_id", "held_out", "score", "predicted", F.arrays_zip("starts", "ends", "scores").alias("sentences")
    )
