"""Conditions in a form that reaches the Parquet scan."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Spark pushes an IN of up to this many values to Parquet as single values; of a
# longer one only the smallest and largest reach the scan.
PUSHED_VALUES = 10


def is_one_of(column: str, values: list) -> Column:
    """column IN values, in parts that all reach the scan, joined as a flat tree of ORs."""
    values = sorted(values)
    parts = [
        F.col(column).isin(values[at : at + PUSHED_VALUES])
        for at in range(0, len(values), PUSHED_VALUES)
    ] or [F.lit(False)]
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2])
        parts = [a | b for a, b in pairs] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]
