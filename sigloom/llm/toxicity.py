"""Toxicity from a learned lexicon, its misspellings, and the context of each hit.

``fit`` learns from a bounded sample of labelled documents: words, and stems that many words
start with, which stand in toxic documents far more often than in others, form the lexicon. Its
trie is intersected with Levenshtein automata (one edit, of which a swap of neighbours is one, for
terms of ``EDIT_FROM`` letters or more, also those that start with a stem, unless a word that close
to them is common in harmless documents); the product is made deterministic as words are read, so
that most words leave it after a few letters. Where a digit or sign parts two words that are no hits
themselves ("m0ron"), all three are read as one word too. Each hit is weighed by a window of words around it: in quotation marks or after a
word of reporting it counts ``QUOTED`` of a hit, since it is then mentioned rather than meant. A
logistic regression turns counts of hits into a score.

Bounds: ``MAX_DOCS`` labelled documents (those with the smallest hash of their id), and
``MAX_TERMS`` terms of each kind; so the model does not grow with the data.

Defined results: null and empty texts are scored by the intercept alone; labels that are null or
without a document are ignored; a document with two labels is learned from twice; without any
label all scores are 0; equal rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import held_out, stored

MAX_DOCS = 10_000
MAX_TERMS = 2_000
LEAST_DOCS = 5
PRECISION = 0.9
STEM = (4, 5, 6, 7, 8)  # letters
STEM_WORDS = 5
EDIT_FROM = 5
WINDOW = 5
QUOTED = 0.2
THRESHOLD = 0.3

# Quotation marks, and words that report what was said.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset(
    "said says say saying wrote writes called calls quote quoted quotes word words term cited "
    "sagte sagt schrieb nannte wort zitat "
    "dit disait écrit appelé mot citation "
    "dijo dice escribió llamó palabra cita".split()
)

_token = re.compile(rf"[^\W\d_]+|[{QUOTES}\n]")
# A word, a digit or sign behind it, and the word behind that.
_masked = re.compile(rf"(?<![^\W\d_])([^\W\d_]+)(?=((?:[\d_]|[^\w\s{QUOTES}]))([^\W\d_]+))")


class Matcher:
    """Words within the edits of a lexicon: a trie and Levenshtein automata, made deterministic.

    A state is a set of (trie node, edits used); reading a letter matches, replaces, inserts, drops
    or swaps. Amid a swap, the letter that has to follow stands in place of the edits. Transitions
    are worked out once and remembered.
    """

    EXACT, CLOSE, STEMMED = 1, 2, 3

    def __init__(self, words: list[str], stems: list[str], edited: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.editable = [False]  # whether a term that may be misspelled is at or below a node
        self.word_at: set[int] = set()
        self.edited_at: dict[int, str] = {}
        self.stem_at: set[int] = set()
        for term in words:
            self.word_at.add(self._insert(term, False))
        for term in edited:
            self.edited_at[self._insert(term, True)] = term
        for term in stems:
            self.stem_at.add(self._insert(term, False))
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _insert(self, term: str, editable: bool) -> int:
        node = 0
        self.editable[0] |= editable
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.editable.append(False)
            node = self.children[node][letter]
            self.editable[node] |= editable
        return node

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With letters of the term that the word lacks: one edit each."""
        more = {
            (child, 1)
            for node, edits in state
            if edits == 0 and self.editable[node]
            for child in self.children[node].values()
        }
        return frozenset(state | more)

    def _state(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.numbers[state]

    def _move(self, state: int, letter: str) -> int:
        out: set[tuple[int, int | str]] = set()
        for node, edits in self.states[state]:
            if isinstance(edits, str):
                if letter == edits:
                    out.add((node, 1))
                continue
            child = self.children[node].get(letter)
            if child is not None:
                out.add((child, edits))
            if edits == 0 and self.editable[node]:
                out.add((node, 1))  # a letter too many
                for first, c in self.children[node].items():
                    out.add((c, 1))  # another letter
                    swapped = self.children[c].get(letter)
                    if swapped is not None and first != letter and self.editable[swapped]:
                        out.add((swapped, first))
        to = self._state(self._closed(out)) if out else -1
        self.moves[state][letter] = to
        return to

    def match(self, word: str) -> int:
        """EXACT, CLOSE, STEMMED, or 0."""
        state, moves = self.start, self.moves
        stem = False
        for letter in word:
            to = moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                return self.STEMMED if stem else 0
            if not stem and any(e == 0 and n in self.stem_at for n, e in self.states[state]):
                stem = True
        state = self.states[state]
        if any(e == 0 and n in self.word_at for n, e in state):
            return self.EXACT
        return self.STEMMED if stem else self.CLOSE if self._edited(state) else 0

    def _edited(self, state: frozenset) -> list[str]:
        return [self.edited_at[n] for n, e in state if n in self.edited_at and not isinstance(e, str)]

    def close_terms(self, word: str) -> list[str]:
        """Terms that the word is an edit away from."""
        state = self.start
        for letter in word:
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                return []
        return sorted({t for t in self._edited(self.states[state]) if t != word})


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    edited: list[str] = field(default_factory=list)  # words that may be misspelled
    weights: np.ndarray | None = None  # intercept first
    _matcher: Matcher | None = None
    _known: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.edited, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems, self.edited, self.weights = state
        self._matcher, self._known = None, {}

    def kinds(self, tokens: list[str]) -> list[int]:
        """Kind of match of each token; short tokens recur and are remembered."""
        if self._matcher is None:
            self._matcher = Matcher(self.words, self.stems, self.edited)
        match, known = self._matcher.match, self._known
        out = []
        for t in tokens:
            kind = known.get(t)
            if kind is None:
                kind = match(t)
                if len(t) <= 6 and len(known) < 100_000:
                    known[t] = kind
            out.append(kind)
        return out

    def masked(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, word) of words with a digit or sign in them, no part of which is a hit."""
        for m in _masked.finditer(text):
            if not any(self.kinds([m[1], m[3]])):
                yield m.start(), m[1] + m[2] + m[3]

    def features(self, text: str | None) -> list[float]:
        """1, then logs of the weighed exact, close and stemmed hits, and of hits per 100 words."""
        text = text.lower() if text else ""
        tokens = _token.findall(text)
        kinds = self.kinds(tokens)
        for at, word in self.masked(text):
            if kind := self.kinds([word])[0]:
                kinds[len(_token.findall(text[:at]))] = kind
        sums = [0.0, 0.0, 0.0, 0.0]
        if any(kinds):
            quoted, marks = False, []
            for t in tokens:
                if t in QUOTES:
                    quoted = not quoted
                elif t == "\n":
                    quoted = False
                marks.append(quoted)
            for i, kind in enumerate(kinds):
                if kind:
                    before = tokens[max(0, i - WINDOW) : i]
                    mentioned = marks[i] or not REPORTING.isdisjoint(before)
                    sums[kind] += QUOTED if mentioned else 1.0
        return [1.0, *np.log1p(sums[1:]).tolist(), float(np.log1p(100 * sum(sums) / max(20, len(tokens))))]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(toxic, text) of at most max_docs labelled documents that may be learned from."""
    usable = labels.where(
        ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
    )
    chosen = (
        usable.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_docs)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def lexicon(rows: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Words and stems that stand in toxic documents far more often than in others, and those of
    the words whose misspellings do not stand in harmless documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    numbered = rows.select("toxic", F.monotonically_increasing_id().alias("d"), F.explode(words).alias("w"))
    numbered = stored(rows.sparkSession, numbered.where(F.length("w") >= STEM[0]), "words")
    toxic = F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("n1")

    def precise(frame: DataFrame, least: int) -> DataFrame:
        return frame.where((F.col("n1") >= least) & (F.col("n1") >= PRECISION * F.col("n")))

    def top(frame: DataFrame) -> list[str]:
        ordered = frame.orderBy(F.desc("n1"), "term").limit(MAX_TERMS)
        return [r["term"] for r in ordered.collect()]

    counted = numbered.groupBy(F.col("w").alias("term")).agg(toxic, F.count("*").alias("n"))
    own = top(precise(counted, LEAST_DOCS))
    cut = F.explode(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEM]))
    parts = (
        numbered.select("toxic", "d", "w", cut.alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term", "d", "toxic")
        .agg(F.count("*").alias("k"), F.min("w").alias("lo"), F.max("w").alias("hi"))
        .groupBy("term")
        .agg(toxic, F.count("*").alias("n"), F.sum("k").alias("k"))
    )
    candidates = precise(parts, 2 * LEAST_DOCS)
    kinds = (
        numbered.select("w").distinct().select(cut.alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= STEM_WORDS)
    )
    stems: list[str] = []
    for s in sorted(top(candidates.join(kinds, "term")), key=lambda s: (len(s), s)):
        if not s.startswith(tuple(stems)):
            stems.append(s)
    words = [w for w in own if not w.startswith(tuple(stems))]
    every = Model(words, stems, [w for w in own if len(w) >= EDIT_FROM])
    matcher = Matcher(every.words, every.stems, every.edited)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def close(batch: pa.Array) -> pa.Array:
        return pa.array([matcher.close_terms(w) for w in batch.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def masked(batch: pa.Array) -> pa.Array:
        found = [{w for _, w in every.masked((t or "").lower())} for t in batch.to_pylist()]
        return pa.array([sorted(x) for x in found], pa.list_(pa.string()))

    harmless = numbered.where(F.col("toxic") == 0).groupBy("w").agg(F.count("*").alias("n"))
    signed = rows.where(F.col("toxic") == 0).select(F.explode(masked("text")).alias("w"))
    harmless = harmless.unionByName(signed.groupBy("w").agg(F.count("*").alias("n")))
    near = harmless.select("n", F.explode(close("w")).alias("term")).groupBy("term").agg(F.sum("n").alias("n"))
    common = {r["term"] for r in near.where(F.col("n") >= LEAST_DOCS).collect()}
    return words, stems, sorted(set(matcher.edited_at.values()) - common)


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w
        )
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    rows = stored(docs.sparkSession, sample(docs, labels, max_docs), "labelled")
    model = Model(*lexicon(rows))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.features(t) for t in batch.to_pylist()], pa.list_(pa.float64()))

    found = rows.select(F.col("toxic").cast("double"), features("text").alias("x")).collect()
    if found:
        x, y = np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found])
        order = np.lexsort((*x.T, y))  # sums do not depend on the order of rows
        model.weights = _regression(x[order], y[order])
        # Few misspellings are seen in the sample: one counts half of the term at least.
        model.weights[2] = max(model.weights[2], model.weights[1] / 2)
    return model


def scored(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.score(t) for t in batch.to_pylist()], pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
