"""Licence scan of paragraphs (lines) with DataFrame operations only.

A multinomial logistic regression over word 1- and 2-grams, with an L1 penalty that leaves few of
them, is trained on notices of each family (alone and between lines of the corpus), on notices of
other licences (class "unknown"), and on a bounded sample of lines and near misses (class
"none"). Its temperature is calibrated on rows that it was not trained on, so that a
probability below ``SURE`` for every family can be read as unknown.

The scan: each n-gram can raise a class over "none" by a known amount, which is filed under its
longest word. In one pass over the texts, the amounts of the words of a line are added up inside
the row; where the sum and the intercepts leave no class above "none", the line is none. The
n-grams of the other lines are joined to the weights (a few hundred rows, as many as the training
rows give) and summed. A predicted family is confirmed by comparison with
its notices: the share of the 2-grams of the smaller of both that the other has too.

Bounds: ``SAMPLE`` lines are learned from, those with the smallest hash; notices are fixed.

Defined results: null or empty text has no paragraph and no licence; rows that share an id are
judged each by its text; equal rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import stored
from sigloom.llm.license_texts import NEAR_MISSES, TEMPLATES, UNKNOWN

SAMPLE = 1_500
AROUND = 12  # lines that each notice is put next to
FIT_TASKS = 6
SURE = 0.5
CONFIRMED = 0.6
CLASSES = ["none", "unknown", *TEMPLATES]


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    return F.zip_with(
        w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def two_grams(w: Column) -> Column:
    return F.filter(pairs(w), lambda g: g.isNotNull())


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    return F.array_distinct(F.concat(w, two_grams(w)))


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table of constants, as part of the plan."""
    shape = f"array<struct<{schema}>>"
    return spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(values)), shape))
    )


def lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, line, held): notices alone and with lines of the corpus around them, and lines."""
    spark = docs.sparkSession
    cue = r"(?i)licen[cs]|copyright|rights reserved|redistribut|\bgnu\b|creative commons|public domain|\bcc by"
    fit_lines = lines(docs).where(~F.col("line").rlike(cue) & (F.length("line") <= 2_000))
    hashed = fit_lines.withColumn("h", F.xxhash64("line"))
    # The least hashes are found first, so that no more lines than needed are shuffled.
    top = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).collect()[0][0]
    plain = hashed.where(F.col("h") <= top if top is not None else F.lit(False)).distinct()
    plain = stored(spark, plain, "lines")
    label = {c: i for i, c in enumerate(CLASSES)}
    notices = [{"label": label[c], "notice": t} for c, some in TEMPLATES.items() for t in some]
    notices += [{"label": label["unknown"], "notice": t} for t in UNKNOWN]
    notices = [n | {"n": i} for i, n in enumerate(notices)]
    table = _rows(spark, notices, "label int, notice string, n int")
    # Each notice meets the lines whose hash falls to it: an equi-join on a small number.
    met = plain.select("line", "h", F.explode(F.sequence(F.lit(0), F.lit(len(notices) - 1))).alias("n")).where(
        F.pmod(F.xxhash64("h", "n"), F.lit(max(1, sample // AROUND))) == 0
    )
    around = met.join(F.broadcast(table), "n").select(
        "label",
        F.when(F.col("h") % 2 == 0, F.concat("line", F.lit(" "), "notice"))
        .otherwise(F.concat("notice", F.lit(" "), "line"))
        .alias("line"),
        (F.pmod("h", F.lit(5)) == 0).alias("held"),
    )
    alone = table.select("label", F.col("notice").alias("line"), F.explode(F.array_repeat(F.lit(False), 6)).alias("held"))
    none = plain.select(F.lit(0).alias("label"), "line", (F.pmod("h", F.lit(5)) == 0).alias("held"))
    near = _rows(spark, [{"line": t} for t in NEAR_MISSES], "line string").select(
        F.lit(0).alias("label"), "line", F.explode(F.array_repeat(F.lit(False), 6)).alias("held")
    )
    return reduce(DataFrame.unionByName, [around, alone, none, near])


@dataclass
class Model:
    """Weights by n-gram and class, intercepts, and the temperature of the probabilities."""

    weights: dict[str, list[float]]
    intercepts: list[float]
    temperature: float

    def gains(self) -> dict[str, float]:
        """Word -> the most that n-grams filed under it can raise a class over none.

        Of a pair, it is the word that is longer (ties: the later one): the rarer as a rule.
        """
        found: dict[str, float] = {}
        for gram, w in self.weights.items():
            gain = max(w[1:]) - w[0]
            if gain > 0:
                word = max(gram.split(" "), key=lambda x: (len(x), x))
                found[word] = found.get(word, 0.0) + gain
        return found

    def start(self) -> float:
        """The most that a class is above none without any n-gram."""
        return max(self.intercepts[1:]) - self.intercepts[0]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    # A few thousand rows, read once for each step of the regression: in few tasks.
    coded = training_rows(docs, sample).select("label", "held", grams(words(F.col("line"))).alias("g"))
    rows = stored(spark, coded.coalesce(FIT_TASKS), "train")
    counter = CountVectorizer(inputCol="g", outputCol="x", binary=True, minDF=3, vocabSize=20_000)
    learned = rows.where(~F.col("held")).coalesce(FIT_TASKS)
    vocabulary = counter.fit(learned)
    found = LogisticRegression(
        featuresCol="x", labelCol="label", family="multinomial", regParam=5e-4,
        elasticNetParam=1.0, maxIter=60, standardization=False,
    ).fit(vocabulary.transform(learned).select("x", "label"))
    matrix = found.coefficientMatrix.toArray()
    matrix = np.vstack([matrix, np.zeros((len(CLASSES) - len(matrix), matrix.shape[1]))])
    intercepts = np.concatenate(
        [found.interceptVector.toArray(), np.full(len(CLASSES) - found.numClasses, -50.0)]
    )
    used = np.flatnonzero(np.abs(matrix).max(axis=0) > 1e-6)
    weights = {vocabulary.vocabulary[i]: matrix[:, i].round(6).tolist() for i in used}
    model = Model(weights, intercepts.round(6).tolist(), 1.0)
    held = [
        (r["label"], r["s"])
        for r in scores(
            rows.where("held").select(F.monotonically_increasing_id().alias("row"), "label", "g"), model, ["row", "label"]
        ).select("label", "s").collect()
    ]
    return Model(weights, model.intercepts, _temperature(held))


def _temperature(rows: list[tuple[int, list[float]]]) -> float:
    """The temperature with the least loss on rows (label, scores)."""
    if not rows:
        return 1.0
    s = np.array([r[1] for r in rows])
    y = np.array([r[0] for r in rows])

    def loss(t: float) -> float:
        z = s / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    return min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: (round(loss(t), 9), t))


def scores(rows: DataFrame, model: Model, by: list[str]) -> DataFrame:
    """(by, s): scores of the classes. rows: by, and g, the n-grams of a line."""
    table = F.broadcast(
        _rows(
            rows.sparkSession,
            [{"gram": g, "w": w} for g, w in sorted(model.weights.items())],
            "gram string, w array<double>",
        )
    )
    known = F.filter("g", lambda g: g.isin(sorted(model.weights) or [""]))
    found = rows.select(*by, F.explode_outer(known).alias("gram")).join(table, "gram", "left")
    sums = found.groupBy(*by).agg(
        *[
            (F.round(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)), 6) + model.intercepts[k]).alias(f"s{k}")
            for k in range(len(CLASSES))
        ]
    )
    return sums.select(*by, F.array(*[f"s{k}" for k in range(len(CLASSES))]).alias("s"))


def scan(docs: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(documents, paragraphs): documents have doc_id, text_hash, n_paragraphs; paragraphs have
    doc_id, text_hash, line number, predicted class, probability, share and confirmed."""
    spark = docs.sparkSession
    gains = model.gains() or {"": 0.0}
    gain = F.create_map(*[F.lit(x) for pair in sorted(gains.items()) for x in pair])
    every = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("i"), x.alias("line")),
    )
    full = F.filter(every, lambda x: F.trim(x["line"]) != "")

    def raised(line: Column) -> Column:
        filed = F.filter(words(line), lambda w: w.isin(sorted(gains)))
        return F.aggregate(
            F.array_distinct(filed),
            F.lit(model.start()),
            lambda a, w: a + F.coalesce(F.element_at(gain, w), F.lit(0.0)),
        )

    # Rounded sums: a little is added so that no line on the edge is passed over.
    cued = F.filter("full", lambda x: raised(x["line"]) > -1e-3)
    found = stored(
        spark,
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), full.alias("full")).select(
            "doc_id", "text_hash", F.size("full").cast("long").alias("n_paragraphs"), cued.alias("cued")
        ),
        "cued",
    )
    by = ["doc_id", "text_hash", "i"]
    # Rows of one id and text are equal here; they count once.
    candidates = (
        found.select("doc_id", "text_hash", F.inline("cued"))
        .dropDuplicates(by)
        .select(*by, words(F.col("line")).alias("w"))
    )
    candidates = stored(spark, candidates, "candidates")
    scored = scores(candidates.select(*by, grams(F.col("w")).alias("g")), model, by)
    top = F.array_max("s")
    exp = F.aggregate(
        "s", F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max("s")) / model.temperature)
    )
    at = F.array_position("s", top).cast("int")
    names = F.array(*map(F.lit, CLASSES))
    predicted = scored.select(
        *by, F.element_at(names, at).alias("first"), F.round(1 / exp, 6).alias("probability")
    ).select(
        *by,
        F.when((F.col("first") != "none") & (F.col("probability") < SURE), "unknown")
        .otherwise(F.col("first"))
        .alias("family"),
        "probability",
    ).where(F.col("family") != "none")
    templates = _rows(
        spark,
        [{"family": f, "notice": t} for f, some in TEMPLATES.items() for t in some],
        "family string, notice string",
    ).groupBy("family").agg(F.collect_list(two_grams(words(F.col("notice")))).alias("notices"))
    compared = (
        predicted.join(F.broadcast(templates), "family", "left")
        .alias("p")
        .join(
            candidates.alias("c"),
            F.col("p.doc_id").eqNullSafe(F.col("c.doc_id"))
            & (F.col("p.text_hash") == F.col("c.text_hash"))
            & (F.col("p.i") == F.col("c.i")),
        )
    )
    own = F.array_distinct(two_grams(F.col("c.w")))
    shares = F.transform(
        "p.notices",
        lambda n: F.size(F.array_intersect(own, n)) / F.greatest(F.least(F.size(own), F.size(F.array_distinct(n))), F.lit(1)),
    )
    share = F.round(F.coalesce(F.array_max(shares), F.lit(0.0)), 6)
    paragraphs = compared.select(
        "p.doc_id", "p.text_hash", "p.i", "p.family", "p.probability", share.alias("share"),
        (share >= CONFIRMED).alias("confirmed"),
    )
    return found.select("doc_id", "text_hash", "n_paragraphs"), paragraphs


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_predicted, n_confirmed, families, n_unknown, of every document."""
    own = docs.select("doc_id", "text")
    documents, paragraphs = scan(own, model or fit(own))
    per = paragraphs.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_predicted"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.array_join(
            F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ","
        ).alias("families"),
    ).alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    return documents.alias("d").join(per, same, "left").select(
        "d.doc_id",
        "d.n_paragraphs",
        *[F.coalesce(f"p.{c}", F.lit(0)).cast("long").alias(c) for c in ("n_predicted", "n_confirmed", "n_unknown")],
        F.coalesce("p.families", F.lit("")).alias("families"),
    )
