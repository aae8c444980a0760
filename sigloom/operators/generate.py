"""Deriving a signature from chosen samples."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.arguments import Arguments
from sigloom.functions.vectors import aligned_sql
from sigloom.operators import medians
from sigloom.operators.flat import apply_filters
from sigloom.operators.prepare import with_gene_count
from sigloom.operators.signatures import SINGLE
from sigloom.schema import SIGNIFICANT


def generate_signature(
    db: DataFrame, genes: DataFrame, samples=None, pvalue: float = SIGNIFICANT, filters=None
) -> DataFrame:
    """(sig_id, pos, token): genes changed over the samples, strongest first, `-` for down.

    The result is a signature as all scores take it. `samples` are ids, or a table with a column
    `id` for any number of them; with `filters`, only samples that pass count, and without
    `samples` all that pass, which needs no join.

    A gene is kept if its median p-value is at most `pvalue` and its median t is not 0.
    A sample without p-values still counts for the medians of t. Medians of more samples than
    `medians.BUFFER` are selected without bringing the values of a gene together.
    """
    args = Arguments()
    everything = samples is None and bool(filters)
    listed = not everything and not isinstance(samples, DataFrame)
    if listed:
        ids = args.words("samples", samples)
    elif not everything:
        args.require("id" in samples.columns, "samples lack the column id")
    args.number("pvalue", pvalue)
    args.done()
    chosen = apply_filters(db, filters).filter(F.col("profile.t").isNotNull())
    if listed:
        chosen = chosen.filter(F.col("id").isin(ids))
    elif not everything:
        chosen = chosen.join(samples.select("id").distinct(), "id", "left_semi")
    t = F.expr(aligned_sql("profile.t", "_n_genes"))
    vectors = with_gene_count(chosen, genes).select(t.alias("t"), F.col("profile.p").alias("p"))
    if chosen.count() <= medians.BUFFER:
        no_p = F.array().cast("array<double>")
        entries = F.arrays_zip("t", F.coalesce("p", no_p).alias("p"))
        values = vectors.select(F.posexplode(entries).alias("at", "entry"))
        index = (F.col("at") + 1).alias("index")
        middle = values.groupBy(index).agg(F.median("entry.t").alias("t"), F.median("entry.p").alias("p"))
    else:
        middle = medians.vector_medians(vectors, genes.count())
    kept = middle.filter((F.col("p") <= F.lit(float(pvalue))) & (F.col("t") != 0))
    symbol = F.get("symbol", F.lit(0))
    # One row per gene at most: numbering them in one task is cheap.
    order = Window.orderBy(F.abs("t").desc(), "index")
    return (
        kept.join(genes.select("index", symbol.alias("symbol")), "index")
        .select(
            F.lit(SINGLE).alias("sig_id"),
            F.row_number().over(order).alias("pos"),
            F.concat(F.when(F.col("t") < 0, "-").otherwise(""), "symbol").alias("token"),
        )
        .orderBy("pos")
    )

