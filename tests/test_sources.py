import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigloom.functions.arguments import ArgumentError
from sigloom.operators.prepare import build_db, rank_vectors
from sigloom.plans.engine import load
from sigloom.schema import PERTURBATION
from sigloom.sources.genes import load_genes, map_gene_datatypes
from sigloom.sources.inventory import input_inventory, probe_versions, select_version
from sigloom.sources.layouts import gene_major, read_gene_major, write_db
from sigloom.sources.perturbations import read_db, replicate_db, union_dbs, with_meta


@pytest.fixture(scope="module")
def folder(unranked, raw_genes, tmp_path_factory):
    """Datasets of several versions, one without meta, one empty, and the gene table."""
    root = tmp_path_factory.mktemp("old.parquet+dir") / "data here"
    versions = {"one.parquet": ("1.0", "2023-01-01"), "two.parquet": ("2.0", "2024-01-01"),
                "two-one.parquet": ("2.1", "2024-06-01")}
    for name, (version, date) in versions.items():
        with_meta(unranked, {"version": version, "processingDate": date}).write.parquet(
            str(root / name)
        )
    bare = unranked.withColumn("meta", F.filter("meta", lambda m: F.lit(False)))
    bare.drop("cell").withColumn("more", F.lit(1)).write.parquet(str(root / "bare.parquet"))
    unranked.limit(0).write.parquet(str(root / "empty.parquet"))
    raw_genes.write.parquet(str(root / "genes" / "genes.parquet"))
    return str(root)


def test_inventory_of_a_folder(spark, folder):
    rows = {r.dataset.rsplit("/", 1)[1]: r.n_rows for r in input_inventory(spark, folder).collect()}
    assert rows == {"one.parquet": 6, "two.parquet": 6, "two-one.parquet": 6, "bare.parquet": 6,
                    "empty.parquet": 0}


def test_inventory_of_single_datasets(spark, folder):
    paths = [f"{folder}/one.parquet", f"{folder}/two.parquet/"]
    found = {r.dataset.rsplit("/", 1)[1] for r in input_inventory(spark, paths).collect()}
    assert found == {"one.parquet", "two.parquet"}


def test_probe_versions(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in probe_versions(spark, folder).collect()}
    assert rows["two-one.parquet"] == (2, 1, datetime.date(2024, 6, 1))
    assert rows["one.parquet"] == (1, 0, datetime.date(2023, 1, 1))
    assert rows["bare.parquet"] == (0, 0, datetime.date(1, 1, 1))
    assert rows["empty.parquet"] == (0, 0, datetime.date(1, 1, 1))


def rows_read(spark, action):
    """The largest number of rows that any operator of the queries of an action put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    found = [0]
    executions = store.executionsList(int(before), 100)
    for i in range(executions.size()):
        execution = executions.apply(i)
        values = store.executionMetrics(execution.executionId())
        for j in range(execution.metrics().size()):
            metric = execution.metrics().apply(j)
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                found.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return max(found)


def test_probing_reads_a_batch_at_most(spark, unranked, tmp_path):
    for name, k in (("small", 1), ("large", 20_000)):
        many = replicate_db(with_meta(unranked, {"version": "3.1"}), k).select("id", "meta")
        many.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    read = {
        name: rows_read(spark, lambda: probe_versions(spark, str(tmp_path / f"{name}.parquet")).collect())
        for name in ("small", "large")
    }
    assert 1 <= read["small"] <= 6 and read["large"] <= 4096
    found = probe_versions(spark, str(tmp_path)).collect()
    assert [tuple(r)[1:3] for r in found] == [(3, 1), (3, 1)]


def test_probing_a_stamped_dataset_reads_no_row(spark, unranked, tmp_path):
    path = str(tmp_path / "stamped.parquet")
    write_db(unranked, path, meta={"version": "4.2", "processingDate": "2025-02-03"})
    assert rows_read(spark, lambda: probe_versions(spark, path).collect()) <= 1  # the list of files
    assert tuple(probe_versions(spark, path).first())[1:] == (4, 2, datetime.date(2025, 2, 3))
    # Other entries, written over what was read with its metadata, replace the stamp.
    again = str(tmp_path / "again.parquet")
    write_db(spark.read.parquet(path), again, meta={"version": "5.0"})
    plain = str(tmp_path / "plain.parquet")
    with_meta(spark.read.parquet(path), {"version": "6.0"}).write.parquet(plain)
    found = [tuple(r)[1:3] for r in probe_versions(spark, [again, plain]).collect()]
    assert found == [(5, 0), (6, 0)]


@pytest.mark.parametrize(
    "version, names",
    [("latest", {"two.parquet", "two-one.parquet"}), (1, {"one.parquet"}), ("v1", {"one.parquet"})],
)
def test_select_version(spark, folder, version, names):
    chosen = select_version(probe_versions(spark, folder), version)
    assert {r.path.rsplit("/", 1)[1] for r in chosen.collect()} == names


@pytest.mark.parametrize("version", [7, "newest"])
def test_select_version_without_match(spark, folder, version):
    with pytest.raises(ArgumentError):
        select_version(probe_versions(spark, folder), version)


def test_read_db_with_other_columns(spark, folder):
    db = read_db(spark, [f"{folder}/bare.parquet", f"{folder}/one.parquet"])
    assert db.schema == PERTURBATION
    assert db.count() == 12
    assert db.filter("cell is null").count() == 7


def test_union_dbs_keeps_duplicates_and_conforms(spark, folder, unranked):
    other = unranked.drop("cell").withColumn("trt", F.col("trt").dropFields("smiles"))
    both = union_dbs(unranked, other.withColumn("more", F.lit(1)))
    assert both.columns == PERTURBATION.names
    assert both.count() == 12
    assert both.filter("cell is null and trt.smiles is null").count() == 7
    assert both.filter("profile is null").count() == 2


def test_replicate_db(unranked):
    assert replicate_db(unranked).count() == 6
    copies = replicate_db(unranked, 3, "replica")
    per_id = copies.groupBy("id").agg(F.count_distinct("replica").alias("n"))
    assert {r.n for r in per_id.collect()} == {3}
    assert copies.count() == 18
    with pytest.raises(ArgumentError):
        replicate_db(unranked, 0)


def test_load_genes(genes):
    rows = genes.orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[2].id == "200814_at" and rows[2].symbol == ["PSME1"]
    assert [r.dataType for r in rows] == ["1-1", "0-1", "0-0", "1-0", "1-1"]
    assert rows[0].entrezid is None and rows[0].name is None
    assert "gene_description" not in genes.columns


def test_load_genes_keeps_given_identifiers_and_null_flags(raw_genes):
    more = raw_genes.withColumn("entrezid", F.lit("77")).withColumn("landmark", F.lit(None).cast("boolean"))
    row = load_genes(more, "gene_id").first()
    assert row.entrezid == ["77"] and row.dataType is None


def test_load_genes_reports_all_missing_columns(raw_genes):
    with pytest.raises(ArgumentError) as error:
        load_genes(raw_genes.drop("landmark", "gene_symbol"), "gene_id")
    assert len(error.value.problems) == 2


def test_map_gene_datatypes(genes):
    named = map_gene_datatypes(genes, {"1-1": "L1000", "0-1": "BING"})
    types = [r.dataType for r in named.orderBy("index").collect()]
    assert types == ["L1000", "BING", "0-0", "1-0", "L1000"]


def test_rank_vectors(db):
    ranks = {r.id: r.r for r in db.select("id", "profile.r").collect()}
    assert ranks == {
        "A": [1.0, -2.0, 3.0, -4.0, 5.0],
        "B": [3.5, -3.5, 2.0, 0.0, 5.0],
        "C": None,
        "D": [-5.0, 4.0, -3.0, 2.0, -1.0],
        "E": [3.0] * 5,
        "F": [5.0, 4.0, 3.0, 2.0, 1.0],
    }


def test_rank_of_missing_and_empty_vectors(spark):
    nan = float("nan")
    rows = [([1.0, -1.0, 1.0, nan, None],), ([],), ([0.0, -0.0],), ([float("inf"), -7.0],)]
    frame = spark.createDataFrame(rows, "t array<double>").select(
        F.struct("t", F.lit(None).cast("array<double>").alias("p")).alias("profile")
    )
    found = [r.r for r in rank_vectors(frame).select("profile.r").collect()]
    assert found == [[4.0, -4.0, 4.0, 0.0, 0.0], [], [0.0, 0.0], [2.0, -1.0]]


def test_vectors_must_fit_the_genes(unranked, genes):
    with pytest.raises(PySparkException, match="5 entries, genes: 4"):
        rank_vectors(unranked, genes.filter("index < 5")).collect()


def _matrices(unranked):
    vectors = unranked.filter("profile is not null")
    t = vectors.select("id", F.col("profile.t").alias("values"))
    p = vectors.filter("profile.p is not null").select("id", F.col("profile.p").alias("values"))
    relations = unranked.select(
        "id", "cell", "trt_type", F.col("trt.id").alias("trt_id"), F.col("trt.dose").alias("dose")
    )
    annotations = unranked.select(
        F.col("trt.id").alias("trt_id"),
        F.col("trt.name").alias("trt_name"),
        F.col("trt.smiles").alias("smiles"),
        F.col("trt.targets").alias("targets"),
    ).distinct()
    return t, p, relations, annotations


def _long(matrix):
    return matrix.select("id", F.posexplode("values").alias("at", "value")).select(
        "id", (F.col("at") + 1).alias("idx"), "value"
    )


@pytest.mark.parametrize("shape", [lambda m: m, _long])
def test_build_db_restores_the_database(unranked, shape):
    t, p, relations, annotations = _matrices(unranked)
    meta = {"version": "1.0", "processingDate": "2024-01-01"}
    built = build_db(shape(t), shape(p), relations, annotations, meta)
    assert built.schema.names == PERTURBATION.names
    assert built.exceptAll(unranked).count() == 0
    assert unranked.exceptAll(built).count() == 0


def test_build_db_refuses_gaps_and_empty_ids(unranked):
    t, p, relations, annotations = _matrices(unranked)
    with pytest.raises(PySparkException, match="not 1..N"):
        build_db(_long(t).filter("idx <> 2"), p, relations).collect()
    nameless = relations.withColumn("id", F.when(F.col("id") == "A", "").otherwise(F.col("id")))
    with pytest.raises(PySparkException, match="no id"):
        build_db(t, p, nameless).collect()


def test_build_db_reports_all_missing_arguments():
    with pytest.raises(ArgumentError) as error:
        build_db(None, None, None)
    assert len(error.value.problems) == 3


def test_write_both_layouts(spark, unranked, genes, db, tmp_path):
    wide, ranks = str(tmp_path / "wide"), str(tmp_path / "ranks")
    write_db(unranked, wide, genes=genes, meta={"version": "3.1"}, partitions=2)
    stored = read_db(spark, wide)
    assert stored.select("id", "profile").exceptAll(db.select("id", "profile")).count() == 0
    assert stored.filter(F.exists("meta", lambda m: m.value == "3.1")).count() == 6
    assert stored.filter(F.size("meta") == 2).count() == 6
    write_db(stored, ranks, layout="gene_major")
    back = read_gene_major(spark, ranks)
    assert back.count() == 25
    assert back.exceptAll(gene_major(db)).count() == 0


def test_write_db_checks_arguments(db):
    with pytest.raises(ArgumentError) as error:
        write_db(db, "", layout="tall", partitions=0)
    assert len(error.value.problems) == 3


def test_load(spark, folder):
    engine = load(
        spark, folder, f"{folder}/genes/genes.parquet", version=2, multiplicity=2,
        gene_data_types={"1-1": "L1000"}, gene_order="probe_set_id",
        storage_level="MEMORY_AND_DISK",
    )
    assert {r.metric: r.value for r in engine.statistics().collect()} == {
        "samples": 24,
        "genes": 5,
        "compounds": 4,
    }
    assert engine.check_signature("MELK").first().data_type == "L1000"
    assert engine.top_table("MELK", head=3).first().id == "F"
    engine.db.unpersist()


def test_load_accepts_one_path(spark, folder):
    engine = load(
        spark, f"{folder}/one.parquet", f"{folder}/genes/genes.parquet", gene_order="gene_id"
    )
    assert engine.counts().collect() == [("db", 6), ("flatdb", 6)]


def test_load_deals_out_rows(spark, folder):
    engine = load(
        spark, f"{folder}/one.parquet", f"{folder}/genes/genes.parquet", gene_order="gene_id", partitions=6
    )
    assert engine.db.rdd.getNumPartitions() == 6 and engine.db.count() == 6


def test_load_reports_all_problems(spark):
    with pytest.raises(ArgumentError) as error:
        load(spark, multiplicity=0, storage_level="MEMORY_ONLY_1")
    assert len(error.value.problems) == 5


def test_gene_major_rows_are_not_sorted(spark, db, tmp_path):
    """Lists of ranks are sorted, not a row with an id for each gene; vectors may differ in length."""
    from sigloom.sources.layouts import gene_major_by_gene

    short = db.limit(1).select(F.lit("Z").alias("id"), *db.columns[1:]).withColumn(
        "profile", F.col("profile").withField("r", F.array(F.lit(7.0)))
    )
    both = db.unionByName(short).coalesce(1)
    rows = gene_major_by_gene(both)
    assert rows.exceptAll(gene_major(both)).count() == 0
    assert gene_major(both).exceptAll(rows).count() == 0
    found = [r.idx for r in rows.collect()]
    assert found == sorted(found)


def test_rows_in_order_are_not_moved(spark, db, genes, tmp_path):
    write_db(db.coalesce(1).sortWithinPartitions("id"), f"{tmp_path}/wide", in_order=True)
    assert spark.read.parquet(f"{tmp_path}/wide").count() == db.count()
    assert spark.read.parquet(f"{tmp_path}/wide").rdd.getNumPartitions() == 1
    with pytest.raises(ArgumentError):
        write_db(db, f"{tmp_path}/ranks", layout="gene_major", in_order=True)


def test_build_db_leaves_rows_that_are_parted_by_id_in_place(unranked):
    rows = unranked.repartition(4, "id")
    t, p = (
        rows.filter(F.col(f"profile.{k}").isNotNull()).select("id", F.col(f"profile.{k}").alias("values"))
        for k in ("t", "p")
    )
    relations = rows.select("id", F.col("trt.id").alias("trt_id"))
    plan = build_db(t, p, relations)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(" in line and "REPARTITION_BY" not in line]
    assert len(moved) <= 2  # of ids alone, to find those without a relation
