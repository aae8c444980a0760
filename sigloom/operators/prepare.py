"""Preparing a perturbation database from matrices of statistics."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.arguments import Arguments
from sigloom.functions.vectors import aligned_sql
from sigloom.sources.perturbations import conform, with_meta


# Entries of vectors that are ranked at a time.
CELLS = 1_000_000


def gene_count(genes: DataFrame) -> Column:
    """Number of genes as a value usable in another frame's expressions."""
    return genes.agg(F.count(F.lit(1))).scalar()


def with_gene_count(frame: DataFrame, genes: DataFrame, name: str = "_n_genes") -> DataFrame:
    """`frame` with the number of genes as a column.

    A column of its own, since array expressions do not take a subquery.
    """
    return frame.withColumn(name, gene_count(genes))


def signed_ranks(t: np.ndarray) -> np.ndarray:
    """Ranks of |t| along each row, ties their average, with the signs of t; 0 stays 0."""
    t = np.nan_to_num(t, nan=0.0)
    size = np.abs(t)
    order = np.argsort(size, axis=1)
    ordered = np.take_along_axis(size, order, axis=1)
    place = np.broadcast_to(np.arange(t.shape[1]), t.shape)
    new = np.ones(t.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    ends = np.ones(t.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.where(ends, place, t.shape[1])[:, ::-1]
    last = np.minimum.accumulate(last, axis=1)[:, ::-1]
    ranks = np.empty(t.shape)
    np.put_along_axis(ranks, order, (first + last) / 2 + 1, axis=1)
    return np.sign(t) * ranks + 0.0  # adding 0 turns -0.0 into plain 0.0


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _ranks(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in vectors:
        offsets = batch.offsets.to_numpy()
        first, last = (offsets[0], offsets[-1]) if len(offsets) else (0, 0)
        t = batch.values[first:last].fill_null(0.0).to_numpy(zero_copy_only=False)
        starts, lengths = offsets[:-1] - first, np.diff(offsets)
        ranks = np.zeros(len(t))
        for n in np.unique(lengths[lengths > 0]):
            rows = starts[lengths == n]
            # Some vectors at a time, so that memory does not follow the size of a batch.
            for at in range(0, len(rows), max(1, CELLS // n)):
                cells = rows[at : at + max(1, CELLS // n), None] + np.arange(n)
                ranks[cells] = signed_ranks(t[cells])
        yield pa.ListArray.from_arrays(
            pa.array((offsets - first).astype(np.int32)), pa.array(ranks), mask=batch.is_null()
        )


def rank_vectors(db: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Fill `profile.r` with the signed ranks of `profile.t`.

    The smallest |t| has rank 1, the largest N, ties their average; a zero, null or NaN
    gets 0. With `genes`, a vector of another length than the gene table fails the job.

    Every vector is ranked inside its row, in Arrow batches: map-only, whatever the number
    of rows.
    """
    t = "profile.t"
    counted = db
    if genes is not None:
        counted = with_gene_count(db, genes)
        t = aligned_sql(t, "_n_genes")
    ranked = counted.withColumn("_r", _ranks(F.expr(t)))
    profile = F.struct("profile.t", "profile.p", F.col("_r").alias("r"))
    return ranked.withColumn("profile", F.when(F.col("profile").isNotNull(), profile)).select(
        *db.columns
    )


def _unique(frame: DataFrame, key: str, what: str) -> DataFrame:
    """`frame`, grouped by a key that the next join needs; the job fails if one repeats."""
    rest = [c for c in frame.columns if c != key]
    grouped = frame.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), F.first(F.struct(F.lit(1).alias("_one"), *rest)).alias("_row")
    )
    repeated = F.raise_error(F.concat(F.lit(f"{what} repeat {key} "), F.col(key).cast("string")))
    # A filter, since a key that is computed anew would be shuffled again.
    checked = grouped.filter(F.when(F.col("_rows") > 1, repeated.cast("boolean")).otherwise(True))
    return checked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _vectors(matrix: DataFrame, name: str) -> DataFrame:
    """(id, vector) from a sample-major matrix, given as arrays or one value per row."""
    if "values" in matrix.columns:
        vectors = matrix.select("id", F.col("values").cast("array<double>").alias(name))
        return _unique(vectors, "id", f"{name}_stats")
    entry = F.struct("idx", F.col("value").cast("double").alias("value"))
    gathered = matrix.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    in_order = F.forall(
        F.transform("entries", lambda e, k: e["idx"] == k + 1), lambda is_next: is_next
    )
    return gathered.select(
        "id",
        F.when(in_order, F.transform("entries", lambda e: e["value"]))
        .otherwise(
            F.raise_error(F.concat(F.lit(f"{name}: positions of "), "id", F.lit(" are not 1..N")))
        )
        .alias(name),
    )


def build_db(
    t_stats: DataFrame,
    p_stats: DataFrame,
    relations: DataFrame,
    annotations: DataFrame | None = None,
    meta: dict[str, str] | None = None,
) -> DataFrame:
    """Perturbation database from two matrices and a sample-compound relation.

    Matrices: (id, values array) or long (id, idx, value) with idx from 1. `relations`:
    one row per sample with id, trt_id, and optionally trt_type, cell, dose, trt_name,
    smiles, targets. `annotations`: one row per trt_id, with any of the last three.

    The annotations are joined while rows are narrow, so a compound with very many
    samples costs little to split; vectors are then joined on the sample id. The job fails
    if an id or an annotated trt_id repeats, or if a sample of a matrix has no relation:
    filter the matrices to leave samples out.
    """
    args = Arguments()
    for what, frame, columns in (
        ("t_stats", t_stats, ("id",)),
        ("p_stats", p_stats, ("id",)),
        ("relations", relations, ("id", "trt_id")),
    ):
        if args.require(frame is not None, f"{what} is not provided"):
            for name in columns:
                args.require(name in frame.columns, f"{what} lacks the column {name}")
    if annotations is not None:
        args.require("trt_id" in annotations.columns, "annotations lack the column trt_id")
    args.done()

    nameless = F.raise_error(F.lit("a sample has no id")).cast("boolean")
    named = relations.filter(F.when(F.coalesce("id", F.lit("")) == "", nameless).otherwise(True))
    samples = _unique(named, "id", "relations")
    described = ("trt_name", "smiles", "targets")
    if annotations is not None:
        extra = [c for c in described if c in annotations.columns]
        described_by = _unique(annotations.select("trt_id", *extra), "trt_id", "annotations")
        samples = samples.drop(*extra).join(described_by, "trt_id", "left")

    def optional(name, alias=None):
        column = F.col(name) if name in samples.columns else F.lit(None)
        return column.alias(alias or name)

    # Left joins keep the parting by id, which full ones lose; what they miss are ids only.
    t, p = _vectors(t_stats, "t"), _vectors(p_stats, "p")
    related = samples.withColumn("_related", F.lit(True)).join(t, "id", "left").join(p, "id", "left")
    ids = t_stats.select("id").unionAll(p_stats.select("id"))
    stray = ids.join(relations.select("id"), "id", "left_anti")
    joined = related.unionByName(stray, allowMissingColumns=True)
    sample_id = (
        F.when(F.coalesce("id", F.lit("")) == "", F.raise_error(F.lit("a sample has no id")))
        .when(
            F.col("_related").isNull(),
            F.raise_error(F.concat(F.lit("no relation for the sample "), "id")),
        )
        .otherwise(F.col("id"))
    )
    db = conform(
        joined.select(
            sample_id.alias("id"),
            F.lit(None).alias("meta"),
            optional("cell"),
            optional("trt_type"),
            F.struct(
                F.col("trt_id").alias("id"),
                optional("trt_name", "name"),
                optional("dose"),
                optional("smiles"),
                optional("targets"),
            ).alias("trt"),
            F.when(
                F.col("t").isNotNull(), F.struct("t", "p", F.lit(None).alias("r"))
            ).alias("profile"),
        )
    )
    return with_meta(db, meta) if meta else db
