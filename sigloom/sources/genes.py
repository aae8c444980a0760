"""Gene annotations: one row per position of the profile vectors."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.arguments import Arguments

# Text columns of the annotation files that hold one identifier each.
OPTIONAL_IDENTIFIERS = ("entrezid", "ensemblid", "name", "geneFamily")


def _identifier_set(raw: DataFrame, name: str) -> Column:
    """Array column `name`, wrapped from a plain column if needed; null if absent."""
    if name not in raw.columns:
        return F.lit(None).cast("array<string>").alias(name)
    if raw.schema[name].dataType.typeName() == "array":
        return F.col(name).cast("array<string>").alias(name)
    text = F.col(name).cast("string")
    return F.when(text.isNotNull(), F.array(text)).alias(name)


def load_genes(raw: DataFrame, order_by: str | list[str] | None = None) -> DataFrame:
    """Gene table from raw annotations (gene_id, gene_symbol, landmark, best_inferred).

    Other columns are dropped. `index` is the 1-based position of the gene in every profile
    vector. It follows `order_by`, which has to be named: a wrong order gives wrong scores,
    not errors. The job fails if those columns have nulls or repeat. The numbering runs in
    one task: a gene table has as many rows as a single vector has entries.
    """
    args = Arguments()
    columns = args.words("order_by", order_by)
    for name in ("gene_id", "gene_symbol", "landmark", "best_inferred", *columns):
        args.require(name in raw.columns, f"gene annotations lack the column {name}")
    args.done()
    data_type = F.concat(
        F.col("landmark").cast("int").cast("string"),
        F.lit("-"),
        F.col("best_inferred").cast("int").cast("string"),
    )
    in_order = Window.orderBy(*columns)
    this = F.struct(*columns)
    unfit = this.eqNullSafe(F.lag(this).over(in_order))
    for name in columns:
        unfit = unfit | F.col(name).isNull()
    index = F.when(
        unfit, F.raise_error(F.lit(f"genes are not uniquely ordered by {', '.join(columns)}")).cast("int")
    ).otherwise(F.row_number().over(in_order))
    identifiers = {n: _identifier_set(raw, n) for n in OPTIONAL_IDENTIFIERS}
    return raw.select(
        index.alias("index"),
        F.col("gene_id").alias("id"),
        F.array("gene_symbol").alias("symbol"),
        *identifiers.values(),
        data_type.alias("dataType"),
    )


def map_gene_datatypes(genes: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Replace each `dataType` found in `names`, keep the others."""
    if not names:
        return genes
    pairs = F.create_map(*[F.lit(text) for pair in names.items() for text in pair])
    return genes.withColumn(
        "dataType", F.coalesce(F.try_element_at(pairs, F.col("dataType")), F.col("dataType"))
    )


def read_genes(
    spark: SparkSession,
    path: str,
    names: dict[str, str] | None = None,
    order_by: str | list[str] | None = None,
) -> DataFrame:
    """Read Parquet gene annotations and shape them with the two steps above."""
    return map_gene_datatypes(load_genes(spark.read.parquet(path), order_by), names)
