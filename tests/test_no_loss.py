"""Nothing is lost or added up in silence; both settings of ANSI mode; pruning at any size."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigloom.functions.arguments import ArgumentError
from sigloom.operators import histograms, lookup, prepare, scoring
from sigloom.operators.signatures import parse_signature
from sigloom.sources import layouts, perturbations
from sigloom.sources.genes import load_genes


@pytest.fixture(params=["true", "false"])
def ansi(request, spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_missing_profiles_in_either_mode(ansi, db, unranked, genes):
    ranked = {r.id: r.profile for r in prepare.rank_vectors(unranked, genes).collect()}
    assert ranked["C"] is None and ranked["D"].r == [-5.0, 4.0, -3.0, 2.0, -1.0]
    found = {r.id: r.n_significant for r in scoring.select_features(db, "id n_significant").collect()}
    assert found["C"] == 0 and found["D"] == 0 and found["A"] == 3
    scores = {r.id for r in scoring.zhang_score(db, genes, "MELK").collect()}
    assert scores == {"A", "B", "D", "E", "F"}
    rows = lookup.treatment_to_perturbations(db, "ibuprofen").collect()
    assert [r.n_significant for r in rows] == [0]


def test_profiles_without_ranks_fail(unranked, db, genes):
    mixed = db.filter("id < 'C'").unionByName(unranked.filter("id >= 'C'"))
    with pytest.raises(PySparkException, match="no ranks"):
        scoring.zhang_score(mixed, genes, "MELK").collect()


def test_datasets_stay_ranked_or_not(spark, unranked, db, genes, tmp_path):
    path = f"{tmp_path}/db"
    layouts.write_db(unranked, path, genes=genes)
    with pytest.raises(ArgumentError, match="some profiles have ranks"):
        layouts.write_db(unranked, path, mode="append")
    with pytest.raises(ArgumentError, match="some profiles have ranks"):
        layouts.write_db(db.unionByName(unranked), f"{tmp_path}/other")
    layouts.write_db(unranked, path, genes=genes, mode="append")
    assert spark.read.parquet(path).count() == 12


def test_repeated_ids_in_gene_major_fail(spark, db, genes, tmp_path):
    twice = perturbations.union_dbs(db, db)
    with pytest.raises(ArgumentError, match="unique ids"):
        layouts.write_db(twice, f"{tmp_path}/ranks", layout="gene_major")
    ranks = layouts.gene_major(db)
    with pytest.raises(PySparkException, match="twice"):
        scoring.zhang_score(db, genes, "MELK", ranks=ranks.union(ranks)).collect()
    assert scoring.zhang_score(twice, genes, "MELK").count() == 10


def test_build_db_refuses_unrelated_and_repeated_rows(spark):
    t = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, values array<double>")
    relations = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, trt_id string")
    notes = spark.createDataFrame([("x", "n"), ("y", "m")], "trt_id string, trt_name string")
    assert prepare.build_db(t, t, relations, notes).count() == 2
    for message, arguments in (
        ("no relation for the sample b", (t, t, relations.filter("id = 'a'"), notes)),
        ("t_stats repeat id a", (t.union(t.filter("id = 'a'")), t, relations, notes)),
        ("relations repeat id b", (t, t, relations.union(relations.filter("id = 'b'")), notes)),
        ("annotations repeat trt_id x", (t, t, relations, notes.union(notes.filter("trt_id = 'x'")))),
    ):
        with pytest.raises(PySparkException, match=message):
            prepare.build_db(*arguments).collect()


def test_unpaired_signatures_fail(spark, db, genes):
    def table(*names):
        return spark.createDataFrame([(n, 1, "MELK") for n in names], "sig_id string, pos int, token string")

    assert {r.sig_id for r in histograms.correlation(db, genes, table("a", "b"), table("b", "a")).collect()} == {"a", "b"}
    for one, two in ((table("a", "b"), table("a", "c")), ("MELK", table("a"))):
        with pytest.raises(Exception, match="pair up"):
            histograms.correlation(db, genes, one, two).collect()


def test_gene_order_is_named_and_unique(spark):
    rows = [(k, f"P{k}", f"G{k}", True, True, k % 2) for k in range(1, 13)]
    raw = spark.createDataFrame(rows, "place int, gene_id string, gene_symbol string, landmark boolean, best_inferred boolean, half int")
    with pytest.raises(ArgumentError):
        load_genes(raw)
    in_order = load_genes(raw, "place")
    assert {r["id"]: r["index"] for r in in_order.collect()} == {f"P{k}": k for k in range(1, 13)}
    assert [r.idx for r in parse_signature(in_order, "P10 G2").collect()] == [10, 2]
    for order, frame in (("half", raw), ("place", raw.withColumn("place", F.when(F.col("place") > 1, F.col("place"))))):
        with pytest.raises(PySparkException, match="uniquely ordered"):
            load_genes(frame, order).collect()


@pytest.mark.parametrize("genes_used", [5, 11, 100])
def test_gene_major_prunes_at_any_size(spark, tmp_path, genes_used):
    """Scanned rows of a file sorted by gene follow the genes in use."""
    n_genes, n_rows = 400, 500
    path = f"{tmp_path}/ranks"
    (
        spark.range(n_genes * n_rows)
        .select(
            (F.col("id") / n_rows + 1).cast("int").alias("idx"),
            F.concat(F.lit("X"), F.col("id") % n_rows).alias("id"),
            F.lit(1.0).alias("r"),
        )
        .coalesce(1)
        .sortWithinPartitions("idx", "id")
        .write.option("parquet.page.row.count.limit", n_rows)
        .parquet(path)
    )
    used = [1 + 3 * k for k in range(genes_used)]
    found = layouts.read_gene_major(spark, path).filter(scoring.is_one_of("idx", used))
    run = found._jdf.queryExecution()
    assert run.toRdd().count() == genes_used * n_rows
    scan = run.executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == genes_used * n_rows
