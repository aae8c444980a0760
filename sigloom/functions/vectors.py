"""Expressions over per-gene vectors; each works inside one row, without a shuffle."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.schema import SIGNIFICANT


def count_at_most(p: Column, threshold: float) -> Column:
    """Number of p-values not above `threshold`; 0 without a vector."""
    # Without ANSI mode, the size of null is -1.
    found = F.size(F.filter(p, lambda x: x <= F.lit(float(threshold))))
    return F.when(p.isNotNull(), found).otherwise(F.lit(0))


def is_informative(p: Column, threshold: float = SIGNIFICANT) -> Column:
    """Whether some p-value is not above `threshold`; false without a vector."""
    return F.coalesce(F.exists(p, lambda x: x <= F.lit(float(threshold))), F.lit(False))


def score_sql(ranks: str, signature: str) -> str:
    """Connection score of a rank vector for a resolved (weights, c_max) signature, as SQL.

    `aggregate` keeps the expression the same size for any number of genes; a sum of one
    term per gene overflows the planner's stack at a few hundred. Adding 0 turns -0.0 into
    plain 0.0.
    """
    return (
        f"aggregate({signature}.weights, 0D,"
        f" (total, w) -> total + element_at({ranks}, w.idx) * w.weight)"
        f" / {signature}.c_max + 0D"
    )


def aligned_sql(vector: str, n_genes: str) -> str:
    """`vector` itself; the query fails if its length is not the number of genes."""
    return (
        f"if({vector} IS NOT NULL AND size({vector}) <> {n_genes}, raise_error(concat("
        f"'a vector has ', size({vector}), ' entries, genes: ', {n_genes})), {vector})"
    )


def score_bin(score: Column, bins: int) -> Column:
    """Bin 0 .. bins-1 of a score in [-1, 1], closed at the upper end."""
    return F.least(F.floor((score + 1.0) / 2.0 * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
