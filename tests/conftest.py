import pytest
from pyspark.sql import functions as F

from sigloom.operators.prepare import rank_vectors
from sigloom.schema import PERTURBATION
from sigloom.sources.genes import load_genes
from workload.session import session

META = [("version", "1.0"), ("processingDate", "2024-01-01")]

GENES = [
    ("201_at", "MELK", True, True),
    ("202_at", "BRCA1", False, True),
    ("200814_at", "PSME1", False, False),
    ("204_at", "TP53", True, False),
    ("205_at", "EGFR", True, True),
]


def perturbation(id, cell, trt_type, trt, t, p):
    profile = None if t is None else (t, p, None)
    return (id, META, cell, trt_type, trt, profile)


ASPIRIN = ("C1", "aspirin", "10", "CCO", ["BRCA1", "TP53"])
OTHER_ASPIRIN = ("C2", "aspirin", "5", "CCN", ["TP53"])
IBUPROFEN = ("C3", "ibuprofen", None, None, [])
OVEREXPRESSION = ("G1", "TP53 up", "1", None, ["TP53"])

# A plain row, a tie and a zero in t, no profile, no p, no cell and no compound, and a
# second compound with the same name.
ROWS = [
    perturbation("A", "MCF7", "trt_cp", ASPIRIN, [1.0, -2.0, 3.0, -4.0, 5.0], [0.9, 0.5, 0.04, 0.05, 0.001]),
    perturbation("B", "MCF7", "trt_cp", ASPIRIN, [2.0, -2.0, 1.0, 0.0, 3.0], [0.06, 0.5, 0.7, 0.8, 0.9]),
    perturbation("C", "PC3", "trt_cp", IBUPROFEN, None, None),
    perturbation("D", "PC3", "trt_cp", OTHER_ASPIRIN, [-5.0, 4.0, -3.0, 2.0, -1.0], None),
    perturbation("E", None, "trt_oe", OVEREXPRESSION, [0.5] * 5, [0.5] * 5),
    perturbation("F", "PC3", "trt_cp", OTHER_ASPIRIN, [5.0, 4.0, 3.0, 2.0, 1.0], [0.01] * 5),
]


@pytest.fixture(scope="session")
def spark():
    return session(memory="4g", **{"spark.sql.shuffle.partitions": "3"})


@pytest.fixture(scope="session")
def raw_genes(spark):
    rows = [(*gene, "text", f"{i}") for i, gene in enumerate(GENES, 1)]
    return spark.createDataFrame(
        rows,
        "gene_id string, gene_symbol string, landmark boolean, best_inferred boolean,"
        " gene_description string, probe_set_id string",
    )


@pytest.fixture(scope="session")
def genes(raw_genes):
    return load_genes(raw_genes, order_by="probe_set_id").cache()


@pytest.fixture(scope="session")
def unranked(spark):
    return spark.createDataFrame(ROWS, PERTURBATION).repartition(3, "id")


@pytest.fixture(scope="session")
def db(unranked, genes):
    return rank_vectors(unranked, genes).cache()


@pytest.fixture(scope="session")
def wide_values(spark):
    """300 perturbations over 40 genes with many ties, and their gene table."""
    n = 40
    i = F.col("i")
    t = F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda g: ((F.xxhash64(i, g) % 50) / 7.0).cast("double"),
    )
    raw = spark.range(1, n + 1).select(
        F.format_string("P%02d", "id").alias("gene_id"),
        F.format_string("S%02d", "id").alias("gene_symbol"),
        (F.col("id") % 2 == 0).alias("landmark"),
        (F.col("id") % 3 == 0).alias("best_inferred"),
    )
    genes = load_genes(raw, order_by="gene_id")
    rows = spark.range(300).withColumnRenamed("id", "i")
    # A third of all rows are samples of one compound in one cell.
    hot = i % 3 == 0
    unranked = rows.select(
        F.format_string("X%04d", i).alias("id"),
        F.array(
            F.struct(F.lit("version").alias("key"), F.lit("1.0").alias("value"))
        ).alias("meta"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("cell"), i % 7)).alias("cell"),
        F.when(hot, "trt_cp").otherwise("trt_sh").alias("trt_type"),
        F.struct(
            F.when(hot, "C0").otherwise(F.concat(F.lit("C"), i % 50 + 1)).alias("id"),
            F.concat(F.lit("name"), i % 5).alias("name"),
            (i % 4).cast("string").alias("dose"),
            F.lit("smiles").alias("smiles"),
            F.array(F.concat(F.lit("S"), i % 9)).alias("targets"),
        ).alias("trt"),
        F.struct(
            t.alias("t"),
            F.lit(None).cast("array<double>").alias("p"),
            F.lit(None).cast("array<double>").alias("r"),
        ).alias("profile"),
    )
    return rank_vectors(unranked, genes).cache(), genes.coalesce(1).cache()
