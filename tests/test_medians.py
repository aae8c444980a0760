"""Exact medians by histograms, against sorted lists."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sigloom.operators import generate, medians
from sigloom.operators.medians import medians as selected

INF, NAN = float("inf"), float("nan")


def plain(values):
    """NaN is larger than all."""
    own = sorted(values, key=lambda x: (math.isnan(x), x))
    return own[(len(own) - 1) // 2] * 0.5 + own[len(own) // 2] * 0.5


def groups():
    rng = random.Random(8)
    yield "even", [rng.gauss(0, 1) for _ in range(400)]
    yield "odd", [rng.gauss(0, 1) for _ in range(401)]
    yield "ties", [float(rng.randrange(3)) for _ in range(500)]
    yield "one value", [2.5] * 300
    yield "two values", [1.0, 2.0] * 100
    yield "single", [7.0]
    yield "pair", [7.0, 9.0]
    yield "small", [rng.random() * 10.0 ** -rng.randrange(300) for _ in range(300)]
    yield "outliers", [rng.random() for _ in range(300)] + [1e308, -1e308, 1e300]
    yield "close", [1.0 + k * 2.0**-52 for k in range(300)]
    yield "denormal", [k * 5e-324 for k in range(-100, 200)]
    yield "octaves", [(-1) ** k * 2.0 ** -(k * 3) for k in range(300)]
    yield "infinities", [INF] * 90 + [-INF] * 90 + [rng.gauss(0, 9) for _ in range(120)]
    yield "mostly infinite", [INF] * 200 + [1.0] * 60
    yield "nan", [NAN] * 40 + [rng.random() for _ in range(160)]
    yield "mostly nan", [NAN] * 150 + [1.0] * 30
    yield "zeros", [0.0, -0.0] * 60 + [1.0] * 20


@pytest.mark.parametrize("buffer, broadcast", [(1, 200_000), (40, 200_000), (40, 0), (10_000, 200_000)])
def test_medians_are_exact(spark, monkeypatch, buffer, broadcast):
    monkeypatch.setattr(medians, "BROADCAST_GROUPS", broadcast)
    expected = {name: plain(values) for name, values in groups()}
    rows = [(name, 1, x) for name, values in groups() for x in values] + [("even", 1, None), ("null", 1, None)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "name string, k int, x double").repartition(4)
    found = {r.name: r.median for r in selected(frame, ["name", "k"], "x", buffer).collect()}
    assert found.keys() == expected.keys()
    for name, median in expected.items():
        assert found[name] == median or math.isnan(found[name]) and math.isnan(median), name
    assert expected["odd"] == statistics.median(dict(groups())["odd"])


def test_few_values_come_together(spark, monkeypatch):
    """Of 40,000 values, a few rounds leave less than the buffer."""
    x = F.rand(3) * F.rand(4)
    frame = spark.range(40_000).select(F.lit(1).alias("k"), x.alias("x")).cache()
    kept = []
    real = medians._bounded

    def watched(named, groups, keys):
        kept.append(groups.agg(F.max("inside")).first()[0] or 0)
        return real(named, groups, keys)

    monkeypatch.setattr(medians, "_bounded", watched)
    found = selected(frame, ["k"], "x", 100).first().median
    assert found == plain([r.x for r in frame.collect()])
    assert kept[0] == 40_000 and min(kept) <= 100 and kept[-1] <= 100 and len(kept) <= 8


def test_no_groups(spark):
    empty = spark.createDataFrame([], "k int, x double")
    assert selected(empty, ["k"], "x").collect() == []


def test_signatures_by_selection(wide_values, monkeypatch):
    db, genes = wide_values
    some = F.struct("profile.t", F.transform("profile.t", lambda t: 1 / (1 + t * t)).alias("p"), "profile.r")
    db = db.withColumn("profile", F.when(~F.col("id").endswith("5"), some))
    samples = db.filter("cell = 'HOT'").select("id")
    ids = [r.id for r in samples.collect()]
    expected = generate.generate_signature(db, genes, ids, 0.3).collect()
    assert generate.generate_signature(db, genes, samples.union(samples), 0.3).collect() == expected
    monkeypatch.setattr(medians, "BUFFER", 7)
    assert generate.generate_signature(db, genes, samples, 0.3).collect() == expected
    assert len(expected) > 5
    with pytest.raises(ValueError, match="lack the column id"):
        generate.generate_signature(db, genes, samples.withColumnRenamed("id", "name"))


@pytest.mark.parametrize("buffer", [1, 40, 10_000])
@pytest.mark.parametrize("chunk", [1, 4_000_000])
def test_medians_of_vectors_are_exact(spark, monkeypatch, buffer, chunk):
    monkeypatch.setattr(medians, "CHUNK", chunk)
    own = [values for _, values in groups()] + [[]]
    rng = random.Random(2)
    rows = []
    for k in range(max(map(len, own))):
        t = [values[k] if k < len(values) else None for values in own]
        # The second column has shorter, longer and no vectors.
        rows.append((t, rng.choice([None, t[:3], [*t, 5.0], t])))
    frame = spark.createDataFrame(rows, "t array<double>, p array<double>").repartition(3)
    found = {r["index"]: r for r in medians.vector_medians(frame, len(own), buffer).collect()}
    assert sorted(found) == list(range(1, len(own)))
    for column in (0, 1):
        for index, row in found.items():
            values = [r[column][index - 1] for r in rows if r[column] is not None and len(r[column]) >= index]
            values = [x for x in values if x is not None]
            median = row["tp"[column]]
            if not values:
                assert median is None
            else:
                assert median == plain(values) or math.isnan(median) and math.isnan(plain(values)), index
    assert medians.vector_medians(frame.limit(0), len(own)).collect() == []


def test_many_samples_are_not_made_into_rows(spark, wide_values, monkeypatch):
    """Neither a row for each value nor a join: vectors go to the tasks as they are."""
    db, genes = wide_values
    taken = []
    real = medians.vector_medians

    def watched(vectors, length):
        taken.append(vectors._jdf.queryExecution().executedPlan().toString())
        return real(vectors, length)

    monkeypatch.setattr(medians, "BUFFER", 7)
    monkeypatch.setattr(medians, "vector_medians", watched)
    cells = sorted(r.cell for r in db.select("cell").distinct().collect() if r.cell)
    ids = [r.id for r in db.filter(F.col("cell") == cells[0]).collect()]
    by_filter = generate.generate_signature(db, genes, pvalue=1.0, filters={"cell": cells[:1]}).collect()
    assert len(taken) == 1 and "Join" not in taken[0] and "Generate" not in taken[0]
    monkeypatch.setattr(medians, "BUFFER", 10_000)
    assert generate.generate_signature(db, genes, ids, 1.0).collect() == by_filter
    with pytest.raises(ValueError):
        generate.generate_signature(db, genes)
