"""The search rule shared by all lookups: a regular expression or a prefix."""

from functools import reduce
from operator import or_

from pyspark.sql import Column

# A query with one of these characters is a regular expression.
REGEX_MARKS = ".*+?[](){}|^$\\"


def matches(column: Column, query: str) -> Column:
    """Whole-value regex match if `query` looks like a regex, else a prefix match.

    The choice falls while the plan is built, so that a prefix reaches the Parquet
    scan as a pushed `StringStartsWith`.
    """
    if any(mark in query for mark in REGEX_MARKS):
        return column.rlike(f"^(?:{query})$")
    return column.startswith(query)


def matches_any(column: Column, queries: list[str]) -> Column:
    return reduce(or_, (matches(column, query) for query in queries))
