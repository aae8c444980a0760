"""Searching compounds, treatments, targets and perturbations."""

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.arguments import Arguments
from sigloom.functions.patterns import matches, matches_any
from sigloom.functions.vectors import count_at_most, is_informative
from sigloom.schema import COMPOUND, SIGNIFICANT

DEFAULT_LIMIT = 10

TRT_ID = "trt.id"
TRT_NAME = "trt.name"


def _first_distinct(frame: DataFrame, limit: int) -> DataFrame:
    """The first `limit` distinct rows in the order of the columns."""
    return frame.distinct().orderBy(*frame.columns).limit(limit)


def _id_or_name(query: str) -> Column:
    return matches(F.col(TRT_ID), query) | matches(F.col(TRT_NAME), query)


def compounds(db: DataFrame, query: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(trt_id, trt_name) of the compounds whose id or name matches."""
    args = Arguments()
    args.text("query", query)
    args.positive("limit", limit)
    args.done()
    found = db.filter((F.col("trt_type") == COMPOUND) & _id_or_name(query))
    return _first_distinct(
        found.select(F.col(TRT_ID).alias("trt_id"), F.col(TRT_NAME).alias("trt_name")), limit
    )


def treatments(
    db: DataFrame,
    query: str | None = None,
    limit: int = DEFAULT_LIMIT,
    like=(),
    trt_type=(),
) -> DataFrame:
    """(trt_type, trt_id, trt_name) of the treatments whose id or name matches.

    `trt_type` lists the types to search, `like` patterns of which one must match the
    name; either may be empty.
    """
    args = Arguments()
    args.text("query", query)
    args.positive("limit", limit)
    names = args.words("like", like, optional=True)
    types = args.words("trt_type", trt_type, optional=True)
    args.done()
    found = db.filter(_id_or_name(query))
    if types:
        found = found.filter(F.col("trt_type").isin(types))
    if names:
        found = found.filter(matches_any(F.col(TRT_NAME), names))
    return _first_distinct(
        found.select(
            "trt_type", F.col(TRT_ID).alias("trt_id"), F.col(TRT_NAME).alias("trt_name")
        ),
        limit,
    )


def targets(db: DataFrame, query: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(target, n_compounds) of the targets that match, in order of target."""
    args = Arguments()
    args.text("query", query)
    args.positive("limit", limit)
    args.done()
    found = F.filter("trt.targets", lambda target: matches(target, query))
    return (
        db.select(F.col(TRT_ID).alias("trt_id"), F.explode(found).alias("target"))
        .groupBy("target")
        .agg(F.count_distinct("trt_id").alias("n_compounds"))
        .orderBy("target")
        .limit(limit)
    )


def target_to_compounds(db: DataFrame, targets=None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(trt_id, trt_name, matched) of the compounds with any of the targets."""
    args = Arguments()
    names = args.words("targets", targets)
    args.positive("limit", limit)
    args.done()
    wanted = F.array(*[F.lit(name) for name in names])
    matched = F.array_join(
        F.array_sort(F.array_intersect(F.col("trt.targets"), wanted)), ","
    )
    found = db.filter(F.arrays_overlap("trt.targets", wanted))
    return _first_distinct(
        found.select(
            F.col(TRT_ID).alias("trt_id"),
            F.col(TRT_NAME).alias("trt_name"),
            matched.alias("matched"),
        ),
        limit,
    )


def treatment_to_perturbations(
    db: DataFrame,
    treatments=None,
    pvalue: float = SIGNIFICANT,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """The perturbations of the treatments that match by name or id.

    (trt_name, id, cell, dose, trt_type, n_significant, informative), where n_significant
    counts the genes with a p-value of at most `pvalue`; `informative` is the flag of the
    flat view.
    """
    args = Arguments()
    queries = args.words("treatments", treatments)
    args.number("pvalue", pvalue)
    args.positive("limit", limit)
    args.done()
    found = matches_any(F.col(TRT_NAME), queries) | matches_any(F.col(TRT_ID), queries)
    p = F.col("profile.p")
    return (
        db.filter(found)
        .select(
            F.col(TRT_NAME).alias("trt_name"),
            "id",
            "cell",
            F.col("trt.dose").alias("dose"),
            "trt_type",
            count_at_most(p, pvalue).alias("n_significant"),
            is_informative(p).alias("informative"),
        )
        .orderBy("trt_name", "id")
        .limit(limit)
    )


def compound_to_samples(
    db: DataFrame,
    compounds=None,
    pvalue: float = SIGNIFICANT,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Former name of `treatment_to_perturbations`."""
    warnings.warn(
        "compound_to_samples is now treatment_to_perturbations", DeprecationWarning, stacklevel=2
    )
    return treatment_to_perturbations(db, compounds, pvalue, limit)


def perturbation_details(db: DataFrame, perturbation: str | None = None) -> DataFrame:
    """All metadata of one perturbation, without its vectors; empty if unknown."""
    args = Arguments()
    args.text("perturbation", perturbation)
    args.done()
    p = F.col("profile.p")
    return db.filter(F.col("id") == perturbation).select(
        "id",
        "meta",
        "cell",
        "trt_type",
        F.col(TRT_ID).alias("trt_id"),
        F.col(TRT_NAME).alias("trt_name"),
        F.col("trt.dose").alias("dose"),
        F.col("trt.smiles").alias("smiles"),
        F.col("trt.targets").alias("targets"),
        F.col("profile").isNotNull().alias("has_profile"),
        is_informative(p).alias("informative"),
    )
