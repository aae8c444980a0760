"""Benchmark decontamination with DataFrame operations only.

Texts are reduced to words (A-Z lowered). Each benchmark item gives its windows of ``WINDOW``
words, or itself if it is shorter. The distinct windows are the n-gram set; each is filed under
its longest word. The scan of the documents is one pass without a shuffle: words that are filed
are found by a hash-set test, and only around those are document windows cut out, looked up in
the broadcast set and verified word by word. What is broadcast is cut into blocks of
``BLOCK_BYTES`` by the hash of the window, and a larger benchmark takes more blocks, not larger
ones. Contaminated documents can be dropped, or lose the words inside hits.

Defined results: null text has no words and is clean, and so is an item without words; documents
that share an id but not the text are judged each by its own text; equal rows get equal results;
an empty table, or an empty benchmark, is clean; columns of the input keep their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import free_name, stored

WINDOW = 10
BLOCK_BYTES = 8_000_000
BREAKS = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Words of a text in their own case; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, gram, n, filed, at): a window as text, its words, its longest word and place."""
    cut = benchmark.select("item_id", F.transform(words(F.col("text")), lowered).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    grams = (
        cut.where(F.size("w") > 0)
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("g"))
    )
    longest = F.array_max(
        F.transform("g", lambda w, i: F.struct(F.length(w).alias("l"), w.alias("w"), i.alias("i")))
    )
    return grams.select(
        "item_id",
        F.array_join("g", " ").alias("gram"),
        F.size("g").alias("n"),
        longest["w"].alias("filed"),
        longest["i"].alias("at"),
    )


def _around(filed: list[str], size: int) -> Column:
    """For each word of ``w`` that is filed: its place, and it with its neighbours, lowered."""

    def near(i: Column) -> Column:
        first = F.greatest(i - (size - 1), F.lit(0))
        return F.struct(
            i.alias("i"),
            first.alias("first"),
            F.transform(F.slice("w", first + 1, i - first + size), lowered).alias("near"),
        )

    places = F.filter(
        F.transform("w", lambda w, i: F.when(F.lower(w).isin(filed), i)), lambda i: i.isNotNull()
    )
    return F.transform(places, near)


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple:
    """(documents, hits), both from one stored pass over the texts for each block.

    documents: doc_id, text_hash, n_words, one row each; hits: doc_id, text_hash, gram, and the
    first word and the end of a window that occurs (0 is the first word).
    """
    windows = stored(docs.sparkSession, benchmark_windows(benchmark, size), "windows")
    distinct = windows.groupBy("gram").agg(
        F.min("n").alias("n"), F.min("filed").alias("filed"), F.min("at").alias("at")
    )
    total = distinct.agg(F.sum(F.octet_length("gram") * 2 + 64)).collect()[0][0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    hits, documents = [], None
    for b in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        filed = [r[0] for r in block.select(F.lower("filed")).distinct().orderBy(F.lower("filed")).collect()]
        found = stored(
            docs.sparkSession,
            docs.select(*key, words(F.col("text")).alias("w")).select(
                "doc_id",
                "text_hash",
                F.size("w").cast("long").alias("n_words"),
                _around(filed or [""], size).alias("places"),
            ),
            "scan",
        )
        documents = documents or found
        place = found.select("doc_id", "text_hash", F.explode("places").alias("p"))
        word = F.element_at("p.near", F.col("p.i") - F.col("p.first") + 1)
        probe = place.withColumn("filed", word).join(F.broadcast(block), "filed")
        start = F.col("p.i") - F.col("at")
        cut = F.slice("p.near", start - F.col("p.first") + 1, F.col("n"))
        hits.append(
            probe.where(
                (start >= 0) & (F.array_join(F.when(start >= 0, cut), " ") == F.col("gram"))
            ).select("doc_id", "text_hash", "gram", start.alias("first"), (start + F.col("n")).alias("end"))
        )
    return (
        documents.select("doc_id", "text_hash", "n_words"),
        reduce(DataFrame.unionByName, hits),
        windows.select("item_id", "gram"),
    )


def _covered(spans: str) -> Column:
    """Words inside sorted spans, each counted once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def add(a: Column, s: Column) -> Column:
        more = F.greatest(s["end"] - F.greatest(s["first"], a["reach"]), F.lit(0))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, zero, add)["n"].cast("long")


def judge(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, spans of hits, n_hit, items (sorted as text), one row each."""
    documents, hits, items = scanned(docs, benchmark, size)
    by = ["doc_id", "text_hash"]
    spans = hits.groupBy(*by).agg(
        F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans")
    )
    named = (
        hits.select(*by, "gram")
        .distinct()
        .join(items.distinct(), "gram")
        .groupBy(*by)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = spans.alias("s").join(
        named.alias("n"),
        F.col("s.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("s.text_hash") == F.col("n.text_hash")),
        "left",
    ).select("s.*", F.coalesce("n.items", F.array().cast("array<string>")).alias("items"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (
        F.col("d.text_hash") == F.col("f.text_hash")
    )
    return (
        documents.alias("d")
        .join(found.alias("f"), same, "left")
        .select(
            "d.*",
            "f.spans",
            F.coalesce(_covered("f.spans"), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _contaminated(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    own = docs.select("doc_id", "text")
    return judge(own, benchmark, size).where(F.col("n_hit") > 0).dropDuplicates(["doc_id", "text_hash"])


def drop_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without a hit, with the columns of docs."""
    bad = _contaminated(docs, benchmark, size).select("doc_id", "text_hash").alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (
        F.xxhash64("d.text") == F.col("b.text_hash")
    )
    return docs.alias("d").join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs whose texts lack the words inside hits, and the breaks after those words."""
    bad = _contaminated(docs, benchmark, size).select("doc_id", "text_hash", "spans").alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (
        F.xxhash64("d.text") == F.col("b.text_hash")
    )
    text = F.col("d.text")
    pieces = F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+" + BREAKS[:-1] + "*)"), F.lit(1))
    left = F.filter(
        pieces,
        lambda _, i: ~F.exists(F.col("b.spans"), lambda s: (i >= s["first"]) & (i < s["end"])),
    )
    lead = F.regexp_extract(text, "^" + BREAKS[:-1] + "*", 0)
    shorter = F.when(F.col("b.spans").isNull(), text).otherwise(
        F.concat(lead, F.array_join(left, ""))
    )
    name = free_name(docs.columns, "shorter")
    joined = docs.alias("d").join(bad, same, "left").select("d.*", shorter.alias(name))
    return joined.select(*[F.col(name).alias("text") if c == "text" else c for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), benchmark, size)
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), "
    f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
)
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n,
    array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
hit AS (SELECT k, s, win.n, item_id FROM win JOIN g ON win.n = g.n AND win.gram = g.gram),
cover AS (
  SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT k, s, n FROM hit)) GROUP BY k),
item AS (
  SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.k = cover.k LEFT JOIN item ON d.k = item.k
"""
