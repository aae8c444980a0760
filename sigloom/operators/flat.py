"""The flat view of a database, filters over it, and counts."""

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.arguments import Arguments
from sigloom.functions.vectors import is_informative
from sigloom.schema import COMPOUND, NOT_AVAILABLE, SIGNIFICANT

# The dimensions users can filter on.
DIMENSIONS = ("cell", "dose", "trt_type", "informative")


def flat_db(db: DataFrame, threshold: float = SIGNIFICANT) -> DataFrame:
    """Six plain columns per perturbation; the dose is known for compounds only."""
    return db.select(
        "id",
        F.coalesce("cell", F.lit(NOT_AVAILABLE)).alias("cell"),
        F.coalesce(
            F.when(F.col("trt_type") == COMPOUND, F.col("trt.dose")), F.lit(NOT_AVAILABLE)
        ).alias("dose"),
        "trt_type",
        F.col("trt.name").alias("trt_name"),
        is_informative(F.col("profile.p"), threshold).alias("informative"),
    )


def informative(db: DataFrame, threshold: float = SIGNIFICANT) -> DataFrame:
    """(id, informative): whether any gene has a p-value not above `threshold`."""
    args = Arguments()
    args.number("threshold", threshold)
    args.done()
    return db.select("id", is_informative(F.col("profile.p"), threshold).alias("informative"))


def db_counts(db: DataFrame) -> DataFrame:
    """(dataset, n) for the database and its flat view, from one aggregate."""
    return db.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(F.lit("db"), F.lit("flatdb"))).alias("dataset"), "n"
    )


def filter_values(flat: DataFrame) -> DataFrame:
    """(dimension, value): all values a filter can name, from one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in DIMENSIONS
        ]
    )
    return flat.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()


def statistics(db: DataFrame, genes: DataFrame) -> DataFrame:
    """(metric, value) for samples, genes and compounds."""
    counted = db.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("trt.id").alias("compounds"),
    )
    n_genes = genes.agg(F.count(F.lit(1))).scalar()
    return counted.select("samples", n_genes.alias("genes"), "compounds").select(
        F.stack(
            F.lit(3),
            F.lit("samples"), F.col("samples"),
            F.lit("genes"), F.col("genes"),
            F.lit("compounds"), F.col("compounds"),
        ).alias("metric", "value")
    )


def _words(values) -> list[str]:
    """Filter values as text; truth values as Spark prints them."""
    return [str(v).lower() if isinstance(v, bool) else v for v in values]


def _accepts(flat: bool, dimension: str, values: list[str]) -> Column:
    """Predicate on the flat view or, with the same meaning, on the stored columns.

    On the stored columns a plain comparison is kept wherever one is possible, so that
    the filter reaches the Parquet scan.
    """
    if dimension == "informative":
        column = F.col("informative") if flat else is_informative(F.col("profile.p"))
        wanted = [v for v in (True, False) if str(v).lower() in values]
        return column.isin(wanted) if wanted else F.lit(False)
    if flat or dimension == "trt_type":
        return F.col(dimension).isin(values)
    missing = NOT_AVAILABLE in values
    if dimension == "cell":
        found = F.col("cell").isin(values)
        return found | F.col("cell").isNull() if missing else found
    compound = F.col("trt_type") == COMPOUND
    found = compound & F.col("trt.dose").isin(values)
    if not missing:
        return found
    no_dose = F.col("trt.dose").isNull() | F.col("trt_type").isNull() | ~compound
    return found | no_dose


def apply_filters(frame: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """Keep the rows whose dimensions have one of the listed values.

    Works on a database and on its flat view. Values of a dimension are alternatives,
    dimensions must all hold; an empty list, or a value that is no list, sets no limit.
    """
    args = Arguments()
    args.require(
        filters is None or isinstance(filters, Mapping), "filters must map dimensions to lists"
    )
    args.done()
    lists = {k: list(v) for k, v in (filters or {}).items() if isinstance(v, (list, tuple, set))}
    for name in filters or {}:
        args.require(name in DIMENSIONS, f"unknown filter dimension {name}")
    for name, values in lists.items():
        args.require(
            all(isinstance(v, (str, bool)) for v in values), f"filter {name} must list texts"
        )
    args.done()
    flat = "trt" not in frame.columns
    wanted = [_accepts(flat, name, _words(values)) for name, values in lists.items() if values]
    return frame.filter(reduce(and_, wanted)) if wanted else frame
