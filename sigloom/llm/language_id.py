"""Language identification by words first, then by ever shorter character n-grams.

``fit`` counts words per language, and from them the n-grams of words (with their edges), over a
bounded sample of labelled documents. ``predict`` adds, for each language, the log frequency of
every known word; a word that no language knows falls back to its longest n-grams of which at
least one is known, then counts as one word with their mean log frequency. The language with the
largest sum wins (ties: the first by name).

Bounds: ``MAX_DOCS`` documents are learned from (those with the smallest hash of their id), and
each language keeps its ``TOP_WORDS`` and, for each length, ``TOP_GRAMS`` most frequent entries,
so the model that travels with the tasks does not grow with the data.

Defined results: ``und`` with score 0 for null text, text without a letter, or nothing to learn
from; rows with null lang are predicted but not learned from; equal rows get equal results; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import held_out

MAX_DOCS = 20_000
TOP_WORDS = 20_000
TOP_GRAMS = 10_000
LONGEST = 5
SMOOTH = 0.5
UNKNOWN = "und"

LETTERS = r"\p{L}+"  # the same letters where words are counted and where they are predicted

_word = regex.compile(LETTERS)


def labelled(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(lang, text) of at most max_docs documents that may be learned from."""
    usable = docs.where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    at = F.xxhash64("doc_id")
    chosen = (
        usable.select(at.alias("at"), "doc_id", "lang")
        .orderBy("at", "doc_id", "lang")
        .limit(max_docs)
        .agg(F.max("at"))
        .collect()[0][0]
    )
    if chosen is None:
        return usable.select("lang", "text").limit(0)
    return usable.where(at <= chosen).select("lang", "text")


@dataclass
class Model:
    """Log frequencies by language: a row of ``words`` or ``grams`` for each known entry."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    gram_logs: np.ndarray | None = None

    def fallback(self, word: str) -> np.ndarray | None:
        """Mean log frequencies of the longest known n-grams of a word; None if none is known."""
        edged = f"_{word}_"
        known = self.grams
        for n in range(min(LONGEST, len(edged)), 0, -1):
            rows = [
                known[g]
                for g in [edged[i : i + n] for i in range(len(edged) - n + 1)]
                if g in known
            ]
            if rows:
                return self.gram_logs[rows].mean(axis=0)
        return None

    def predict(self, text: str | None) -> tuple[str, float]:
        found = _word.findall(text.lower()) if text else []
        if not found or not self.langs:
            return UNKNOWN, 0.0
        rows = list(map(self.words.get, found))
        known = [r for r in rows if r is not None]
        total = self.word_logs[known].sum(axis=0)
        if len(known) < len(rows):
            longest: list[int] = []
            share: list[float] = []
            grams = self.grams
            for w, r in zip(found, rows, strict=True):
                if r is None:
                    edged = f"_{w}_"
                    n = min(LONGEST, len(edged))
                    own = [
                        grams[g]
                        for g in [edged[i : i + n] for i in range(len(edged) - n + 1)]
                        if g in grams
                    ]
                    if own:
                        longest += own
                        share += [1 / len(own)] * len(own)
                    else:
                        mean = self.fallback(w)
                        if mean is not None:
                            total = total + mean
            if longest:
                total = total + np.asarray(share) @ self.gram_logs[longest]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _logs(entries: list, langs: list[str], totals: dict[str, int]) -> tuple[dict, np.ndarray]:
    """Entry -> row, and the smoothed log frequency in each language."""
    names = sorted({e for _, e, _ in entries})
    rows = {e: i for i, e in enumerate(names)}
    counts = np.zeros((len(names), len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    for lang, e, n in entries:
        counts[rows[e], at[lang]] = n
    below = np.array([totals.get(x, 0) for x in langs]) + SMOOTH * max(1, len(names))
    return rows, np.log((counts + SMOOTH) / below)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model of the labelled documents; counted by Spark, and bounded as said above."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), F.lit(1))
    counted = (
        labelled(docs, max_docs)
        .select("lang", F.explode(words).alias("entry"))
        .groupBy("lang", "entry")
        .agg(F.count("*").alias("n"))
        .cache()
    )
    edged = F.concat(F.lit("_"), "entry", F.lit("_"))

    def cut(size):
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(edged) - size + 1, F.lit(1))),
            lambda i: F.struct(F.lit(size).alias("size"), F.substring(edged, i, size).alias("g")),
        )

    grams = (
        counted.select(
            "lang", "n", F.explode(F.concat(*[cut(k) for k in range(1, LONGEST + 1)])).alias("e")
        )
        .where(F.length("e.g") == F.col("e.size"))
        .groupBy("lang", F.col("e.g").alias("entry"))
        .agg(F.sum("n").alias("n"))
    )

    def top(frame: DataFrame, most: int, *by: F.Column) -> tuple[list, dict[str, int]]:
        totals = {r[0]: r[1] for r in frame.groupBy("lang").agg(F.sum("n")).collect()}
        ranked = frame.withColumn(
            "r", F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "entry"))
        )
        return [tuple(x) for x in ranked.where(F.col("r") <= most).drop("r").collect()], totals

    try:
        word_entries, word_totals = top(counted, TOP_WORDS)
        gram_entries, gram_totals = top(grams, TOP_GRAMS, F.length("entry"))
    finally:
        counted.unpersist()
    model = Model(sorted(word_totals))
    model.words, model.word_logs = _logs(word_entries, model.langs, word_totals)
    model.grams, model.gram_logs = _logs(gram_entries, model.langs, gram_totals)
    return model


def predict(docs: DataFrame, model: Model, name: str = "language", text: str = "text") -> DataFrame:
    """docs with a struct column ``name``: lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf(T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()))
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            rows = [own.predict(t) for t in batch.to_pylist()]
            yield pa.array([{"lang_pred": a, "score": b} for a, b in rows], kind)

    return docs.withColumn(name, predicted(F.col(text)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = predict(docs.select("doc_id", "text"), fit(docs), "language")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
