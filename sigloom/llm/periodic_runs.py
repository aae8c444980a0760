"""Runs: stretches of words that repeat with a period, found with a dictionary of basic factors.

The dictionary names, for each power of two m, the factors of m words: two places of a text get
the same name at m if the same m words start there. Names of 2m come from pairs of names of m, and
only places whose factors occur twice go on.

A run of smallest period q holds, for the m with m <= q < 2m, a factor that occurs again q words
later. Occurrences at most m/2 apart form an arithmetic progression, whose difference is the
period of the factor. If the later occurrence is the first of its progression, it is found from
the first place of the run; if not, both progressions end inside the run, and their last members
are q apart. So among the occurrences from m to 2m - 1 words after each place, the first and last
of each progression (there are two at most) propose all periods. Proposals that touch are one;
what is left is extended both ways by comparing names, from long factors to short ones, and of
equal stretches the least period stays. All steps are arrays over the texts of a block; a text
only meets itself, since its words are named apart from those of other texts.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results: null or empty text, or text without words, has
no runs and nothing collapsed (empty text); rows that repeat are judged each; an empty table gives
an empty table; other columns stay, and a result whose name is taken gets underscores added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import free_name

LEAST = 12  # words of a run
BLOCK = 200_000  # words looked at together; a longer text is a block of its own

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of n places, and whether they repeat; a place that is alone has a name below zero."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[number] > 1
    names, repeats = -1 - np.arange(n + 1), np.zeros(n + 1, bool)
    names[places[again]] = number[again]
    repeats[places[again]] = True
    return names, repeats


def basic_factors(words: np.ndarray) -> list[np.ndarray]:
    """names[k][i]: the name of the 2**k words from i; as long as any factor occurs twice."""
    n = len(words)
    names, repeats = _named(words, np.arange(n), n)
    found = [names]
    while repeats.any():
        m = 1 << (len(found) - 1)
        places = np.flatnonzero(repeats[:-m] & repeats[m:])
        keys = names[places] * (n + 1) + names[places + m]
        names, repeats = _named(keys, places, n)
        found.append(names)
    return found


def proposals(names: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for periods from m to 2m - 1, one for each stretch of touching factors."""
    n = len(names)
    at = np.flatnonzero(names >= 0)
    stride = n + 2 * m
    line = np.sort(names[at] * stride + at)  # by name, then place
    place = line % stride
    gap = np.append(np.diff(line), stride)
    ends = np.where(2 * gap > m, np.arange(len(line)), len(line))  # last of a progression
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    near = np.flatnonzero(gap < 2 * m)
    low = np.searchsorted(line, line[near] + m)
    high = np.searchsorted(line, line[near] + 2 * m) - 1
    some = low <= high
    near, low, high = place[near[some]], low[some], high[some]
    inner = ends[low] < high
    last = ends[low[inner]]
    start = np.concatenate([near, near, near[inner], near[inner]])
    later = np.concatenate([place[low], place[high], place[last], place[last + 1]])
    both = np.unique((later - start) * stride + start)
    period, start = both // stride, both % stride
    fresh = np.ones(len(both), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (start[1:] - start[:-1] > m)
    return start[fresh], period[fresh]


def runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence of numbers, by start, then period."""
    names = basic_factors(words)
    found = [proposals(level, 1 << k) for k, level in enumerate(names)]
    start = np.concatenate([s for s, _ in found])
    period = np.concatenate([q for _, q in found])
    left, right = start.copy(), start.copy()
    for k in range(len(names) - 1, -1, -1):
        level, m = names[k], 1 << k
        right += m * (level[right] == level[right + period])
        back = np.maximum(left - m, 0)
        left -= m * ((left >= m) & (level[back] == level[back + period]))
    end = right + period
    long = end - left >= np.maximum(least, 2 * period)
    left, end, period = left[long], end[long], period[long]
    order = np.lexsort((period, end, left))
    left, end, period = left[order], end[order], period[order]
    fresh = np.ones(len(left), bool)
    fresh[1:] = (left[1:] != left[:-1]) | (end[1:] != end[:-1])
    left, end, period = left[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, left))
    return left[order], end[order], period[order]


def _block(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[dict], str]]:
    """Runs and collapsed text of each list of words."""
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.cumsum(sizes) - sizes
    ids = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for words in texts for w in words),
        np.int64,
        int(sizes.sum()),
    )
    owner = np.repeat(np.arange(len(texts)), sizes)
    left, end, period = runs(owner * (len(numbers) + 1) + ids, least)
    # A word goes if it lies in a run after its first period.
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, left + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone) == 0
    cuts = np.searchsorted(left, np.append(firsts, len(ids)))
    for i, words in enumerate(texts):
        at, own = int(firsts[i]), slice(cuts[i], cuts[i + 1])
        spans = zip((left[own] - at).tolist(), (end - left)[own].tolist(), period[own].tolist())
        listed = [{"start": s, "length": k, "period": q} for s, k, q in spans]
        if listed:
            words = [words[j] for j in np.flatnonzero(kept[at : at + len(words)])]
        yield listed, b" ".join(words).decode("utf-8", "surrogatepass")


def with_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST, keep: list[str] | None = None
) -> DataFrame:
    """docs (of them the columns ``keep``) with `runs`, a list of (start, length, period) in words,
    and `collapsed`, the words that lie in no run after its first period, joined by one space."""
    keep = docs.columns if keep is None else keep
    first = free_name(keep, "runs")
    second = free_name([*keep, first], "collapsed")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, n = [], [], 0
            for value in batch.column(0):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                if held and n + len(words) > BLOCK:
                    out += _block(held, least)
                    held, n = [], 0
                held.append(words)
                n += len(words)
            out += _block(held, least) if held else []
            found = pa.array([r for r, _ in out], pa.list_(_RUN)), pa.array([c for _, c in out], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *found], names=[*keep, first, second]
            )

    fields = [docs.schema[c] for c in keep]
    kind = T.StructType(fields).add(first, RUNS).add(second, T.StringType())
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(searched, kind)


def planted(doc_id: Column, text: Column) -> Column:
    """text, or in a tenth of the documents a text whose words repeat from some word on: with
    h = crc32(doc_id) and g = h // 10, those with h % 10 = 0, from word a = g % n, with a period
    of 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, text)
    words = F.filter(F.split(chosen, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(state: Column) -> Column:
        own, n, g = state.w, F.size(state.w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(
            F.sequence(a, n - F.lit(1).cast("long")), lambda i: F.get(own, (a + (i - a) % p).cast("int"))
        )
        return F.array_join(F.concat(F.slice(own, F.lit(1), a.cast("int")), tail), " ")

    made = F.transform(F.array(F.struct(words.alias("w"))), repeated)[0]
    return F.when((h % 10 == 0) & (F.size(words) > 0), made).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest (ties: least start, then period), and digests
    of all runs and of the collapsed text; over the planted texts."""
    texts = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.expr(
        "array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))"
    )
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (
        with_runs(texts, keep=["doc_id"])
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("best.s").alias("start"),
            (-F.col("best.l")).alias("length"),
            F.col("best.p").alias("period"),
            F.expr("floor(-1000 * best.l / best.p)").alias("exponent_milli"),
            F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
