"""Quality rules with thresholds that follow each language and source.

Every document gets integer signals (in thousandths). Their values are counted per
(lang, source, signal, bucket) on a grid of bounded relative error: exact up to 1,023, then the
top ten bits. Such counts are a quantile sketch that merges by addition: they are combined
before the shuffle, so that a hot source moves a few thousand rows at most, and the sketches of
a language and of all documents are sums of those of its sources. Only documents that pass the
base rule are counted, since only of these a fence decides.

A sketch proposes the upper quartile plus ``SPREAD`` times the distance of the quartiles as a
fence; where the values hardly differ, a small distance of its signal stands in. The corpus takes
what its sketch proposes. A language, and then each of its sources, is pulled towards the fence
above it as if ``PRIOR`` more documents had proposed that one; so a fence follows its own
documents the more of them there are, without a step at any count. A proposal counts as ``LIFT``
times the fence above it at most: a source that is mostly junk cannot lift its own fence far.
Fences are joined to the documents; what lies above one goes.

Defined results: null text has no words and fails; null lang and null source are groups of their
own; equal rows are judged alike; an empty table gives an empty table; columns of the input keep
their names and values, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import free_name, stored

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*CONTRACT, "n_lines", "n_upper", "n_letters")

#: Signal: (numerator, denominator, least distance of its quartiles in thousandths).
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", 4),
    "dup_lines": ("n_dup_lines", "n_lines", 40),
    "repeats": ("n_repeat_words", "n_words", 30),
    "upper": ("n_upper", "n_letters", 4),
}
SPREAD = 10
PRIOR = 200
LIFT = 2

_fields = [pa.field(c, pa.int64()) for c in FEATURES]
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_letters = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def measure(text: str | None) -> tuple[int, ...]:
    """The values of FEATURES of one whole text."""
    if not text:
        return (0,) * len(FEATURES)
    words = text.encode("utf-8", "surrogatepass").split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        reach = 0  # end of the words counted so far
        for at, w in enumerate(windows):
            if seen[w] > 1:
                repeated += at + 3 - max(at, reach)
                reach = at + 3
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(len, _upper.findall(text))),
        sum(map(len, _letters.findall(text))),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in FEATURES]))
def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [measure(t) for t in batch.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(FEATURES)
        yield pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], fields=_fields
        )


def with_features(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with a struct column ``name`` of FEATURES."""
    return docs.withColumn(name, _measured(F.col(text)))


def _signal(name: str, of: str) -> Column:
    above, below, _ = SIGNALS[name]
    # Exact for counts under 2**43: a quotient of such whole numbers is not rounded up to the next.
    share = F.floor(F.col(f"{of}.{above}") * 1000 / F.col(f"{of}.{below}"))
    return F.when(F.col(f"{of}.{below}") > 0, share).otherwise(0).cast("long")


def _bucket(value: Column) -> Column:
    bits = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def _base_failed(of: str) -> Column:
    words, repeated = F.col(f"{of}.n_words"), F.col(f"{of}.n_repeat_words")
    return (words < 50) | (100 * repeated > 50 * words)


def sketches(featured: DataFrame, of: str) -> DataFrame:
    """Counts (lang, source, signal, bucket, n) of the documents that pass the base rule."""
    values = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("signal"), _bucket(_signal(s, of)).alias("bucket"))
                for s in SIGNALS
            ]
        )
    ).alias("v")
    return (
        featured.where(~_base_failed(of))
        .select("lang", "source", values)
        .groupBy("lang", "source", "v.signal", "v.bucket")
        .agg(F.count("*").alias("n"))
    )


def _proposals(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, one fence per signal): merges the sketches by ``by`` and reads their quartiles."""
    merged = counts.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "signal")
    ranked = merged.withColumn(
        "upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("all", F.sum("n").over(group))

    def quantile(k: int, signal: str) -> Column:  # of k quarters
        return F.min(
            F.when((F.col("signal") == signal) & (F.col("upto") * 4 >= F.col("all") * k), F.col("bucket"))
        )

    def fence(signal: str) -> Column:
        q1, q3 = quantile(1, signal), quantile(3, signal)
        return (q3 + SPREAD * F.greatest(q3 - q1, F.lit(SIGNALS[signal][2]))).cast("long")

    return ranked.groupBy(*by).agg(F.max("all").alias("n"), *[fence(s).alias(s) for s in SIGNALS])


def _pulled(n: Column, own: Column, above: Column, prior: int) -> Column:
    """The fence of n documents that propose ``own``, under the fence ``above``."""
    return F.floor((n * F.least(own, LIFT * above) + prior * above) / (n + prior))


def thresholds(featured: DataFrame, of: str, prior: int = PRIOR) -> DataFrame:
    """(lang, source, a fence per signal) for every group of the documents."""
    counts = sketches(featured, of)
    every = _proposals(counts.withColumn("every", F.lit(1)), ["every"]).alias("c")
    lang = (
        _proposals(counts, ["lang"])
        .alias("b")
        .join(every, F.col("c.every") == F.lit(1))
        .select(
            "b.lang",
            *[_pulled(F.col("b.n"), F.col(f"b.{s}"), F.col(f"c.{s}"), prior).alias(s) for s in SIGNALS],
        )
        .alias("l")
    )
    return (
        _proposals(counts, ["lang", "source"])
        .alias("a")
        .join(lang, F.col("a.lang").eqNullSafe(F.col("l.lang")))
        .select(
            "a.lang",
            "a.source",
            *[_pulled(F.col("a.n"), F.col(f"a.{s}"), F.col(f"l.{s}"), prior).alias(s) for s in SIGNALS],
        )
    )


def judge(featured: DataFrame, of: str, name: str, prior: int = PRIOR) -> DataFrame:
    """Adds struct ``name``: base_failed and kept. ``featured`` is written once to the shared
    folder, as both the sketches and the verdicts read it."""
    held = stored(featured.sparkSession, featured, "quality")
    fences = thresholds(held, of, prior).alias("f")
    d = held.alias("d")
    base = _base_failed(f"d.{of}")
    fine = F.lit(True)
    for s in SIGNALS:
        fine = fine & (_signal(s, f"d.{of}") <= F.col(f"f.{s}"))
    same = F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(
        F.col("f.source")
    )
    # A group without fences has no document that passes the base rule.
    verdict = F.struct(base.alias("base_failed"), (~base & F.coalesce(fine, F.lit(True))).alias("kept"))
    return d.join(fences, same, "left").select("d.*", verdict.alias(name))


def keep_good(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    of = free_name(docs.columns, "features")
    name = free_name([*docs.columns, of], "verdict")
    judged = judge(with_features(docs, of), of, name, prior)
    return judged.where(F.col(f"{name}.kept")).select(*docs.columns)


def report(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, the measured features, base_failed and kept of every document."""
    plain = docs.select("doc_id", "lang", "source", "text")
    featured = with_features(plain, "features").drop("text")
    judged = judge(featured, "features", "verdict", prior)
    return judged.select("doc_id", *[f"features.{c}" for c in CONTRACT], "verdict.*")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
hit AS (
  SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, x) > 1),
cover AS (
  SELECT k, count(DISTINCT i + o) AS n
  FROM (SELECT k, i, unnest([0, 1, 2]) AS o FROM hit) GROUP BY k),
f AS (
  SELECT d.k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS BIGINT) AS n_letters
  FROM d LEFT JOIN cover ON d.k = cover.k),
s AS (
  SELECT *, {", ".join(f"CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END AS {s}" for s, (a, b, _) in SIGNALS.items())}
  FROM f),
ok AS (SELECT * FROM s WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
u AS ({" UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {v[2]} AS least, {s} AS v FROM ok" for s, v in SIGNALS.items())}),
lv AS (
  SELECT 1 AS lvl, lang, source, signal, least, v FROM u UNION ALL
  SELECT 2, lang, NULL, signal, least, v FROM u UNION ALL
  SELECT 3, NULL, NULL, signal, least, v FROM u),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lvl, lang, source, signal ORDER BY v) AS i,
    count(*) OVER (PARTITION BY lvl, lang, source, signal) AS n FROM lv),
q AS (
  SELECT lvl, lang, source, signal, max(n) AS n, min(v) FILTER (4 * i >= 3 * n)
    + {SPREAD} * greatest(min(v) FILTER (4 * i >= 3 * n) - min(v) FILTER (4 * i >= n), max(least)) AS own
  FROM r GROUP BY lvl, lang, source, signal),
l AS (
  SELECT b.lang, b.signal,
    (b.n * least(b.own, {LIFT} * c.own) + {PRIOR} * c.own) // (b.n + {PRIOR}) AS fence
  FROM q b JOIN q c ON b.lvl = 2 AND c.lvl = 3 AND b.signal = c.signal),
g AS (
  SELECT a.lang, a.source, a.signal,
    (a.n * least(a.own, {LIFT} * l.fence) + {PRIOR} * l.fence) // (a.n + {PRIOR}) AS fence
  FROM q a JOIN l ON a.lvl = 1 AND a.signal = l.signal AND a.lang IS NOT DISTINCT FROM l.lang),
p AS (
  SELECT lang, source, {", ".join(f"max(fence) FILTER (signal = '{s}') AS f_{s}" for s in SIGNALS)}
  FROM g GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND coalesce({" AND ".join(f"{s} <= f_{s}" for s in SIGNALS)}, true) AS kept
FROM s LEFT JOIN p ON s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source
"""
