"""Schemas of the perturbation database and its derived tables."""

from pyspark.sql import types as T

META_ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

TREATMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("dose", T.StringType()),
        T.StructField("smiles", T.StringType()),
        T.StructField("targets", T.ArrayType(T.StringType())),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("t", T.ArrayType(T.DoubleType())),
        T.StructField("p", T.ArrayType(T.DoubleType())),
        T.StructField("r", T.ArrayType(T.DoubleType())),
    ]
)

# One row per experiment. The kind of treatment is a tag (`trt_type`) next to one
# `trt` struct; a perturbation without measurements has a null `profile`.
PERTURBATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("meta", T.ArrayType(META_ENTRY)),
        T.StructField("cell", T.StringType()),
        T.StructField("trt_type", T.StringType()),
        T.StructField("trt", TREATMENT),
        T.StructField("profile", PROFILE),
    ]
)

GENE = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("symbol", T.ArrayType(T.StringType())),
        T.StructField("entrezid", T.ArrayType(T.StringType())),
        T.StructField("ensemblid", T.ArrayType(T.StringType())),
        T.StructField("name", T.ArrayType(T.StringType())),
        T.StructField("geneFamily", T.ArrayType(T.StringType())),
        T.StructField("dataType", T.StringType()),
    ]
)

# Gene-major copy of the rank vectors: one row per (gene, perturbation).
GENE_RANK = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("r", T.DoubleType()),
    ]
)

SIGNATURE = T.StructType(
    [
        T.StructField("sig_id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("token", T.StringType()),
    ]
)

# The treatment tag that stands for compounds, the text for a missing
# scalar, and the p-value at which a gene counts as changed.
COMPOUND = "trt_cp"
NOT_AVAILABLE = "N/A"
SIGNIFICANT = 0.05

# Block layout: the ranks of one gene in one block, in the order of the block's members. The
# row of gene 0 has the ids of the members.
MEMBERS = T.ArrayType(T.StringType())
BLOCK_LIST = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("ranks", T.ArrayType(T.DoubleType())),
        T.StructField("ids", MEMBERS),
    ]
)

# Under this name the column `meta` carries, in the footers of a dataset, the entries that all of
# its rows have.
STAMP = "entries"
