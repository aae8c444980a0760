"""How the queries' tables are derived from the given ones."""

import pytest
from pyspark.sql import functions as F

from workload import queries, tables

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_line_items_move_once(spark):
    shuffles = [line for line in physical(tables.described(spark, SF_DIR)).splitlines() if "hashpartitioning(l_" in line]
    assert len(shuffles) == 1 and "hashpartitioning(l_partkey" in shuffles[0]


def test_vectors_are_ranked_once(spark):
    """What is ranked lies below the join: no line item stands under it."""
    lines = plan(tables.db(spark, SF_DIR)).splitlines()
    at = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    depth = lines[at].index("ArrowEvalPython")
    below = []
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)


def test_targets_of_words_of_any_number(spark):
    rows = spark.createDataFrame(
        [([(0, 1 | -(2**63)), (1, 2)],), (None,), ([(2, 1)],)], "words array<struct<word:long,bits:long>>"
    )
    found = [r.names for r in rows.select(tables._target_names("words").alias("names")).collect()]
    assert found == [["GENE01", "GENE64", "GENE66"], None, ["GENE129"]]


@pytest.mark.parametrize("name", ["top_table_head", "binned_zhang", "filter_values", "zhang_score_nations"])
def test_targets_are_made_for_queries_that_show_them(spark, name):
    """A profile that an expression above the join makes kept the columns from being merged."""
    assert "getbit" not in physical(queries.QUERIES[name](spark, SF_DIR))


def test_targets_are_made_once_for_each_part(spark):
    """What makes the names stands below the join with the line items."""
    text = physical(queries.annotated_ids_without_signature(spark, SF_DIR))
    makes = [line for line in text.splitlines() if "getbit" in line]
    assert makes and not any("l_orderkey" in line or "number" in line for line in makes)


def test_profiles_in_three_forms(spark):
    """Profiles are whole, without p or absent by the number of the line, as an expression has them."""
    rows = tables.described(spark, SF_DIR)
    numbers = rows.select("id", "number", "l_partkey")
    vectors = tables.vectors(spark, SF_DIR)
    n = vectors.agg(F.max("vec_id") + 1).first()[0]
    own = F.struct(
        "profile.t", F.when(F.col("number") % 40 != 39, F.col("profile.p")).alias("p"), "profile.r"
    )
    expected = numbers.join(vectors, F.col("number") % n == F.col("vec_id")).select(
        "id", F.when(F.col("number") % 50 != 49, own).alias("profile")
    )
    for named in (False, True):
        found = tables.with_vectors(tables.described(spark, SF_DIR, named), vectors).select("id", "profile")
        assert found.exceptAll(expected).isEmpty() and found.count() == expected.count()
    assert expected.filter("profile IS NULL").count() and expected.filter("profile.t IS NOT NULL AND profile.p IS NULL").count()


def test_stored_rows_lie_in_order_of_their_vectors(spark):
    """Every row is kept, and each task has equal vectors next to each other, without a shuffle more."""
    rows = tables.described(spark, SF_DIR, named=True)
    ordered = tables.by_vector(spark, SF_DIR, rows)
    n = tables.vectors(spark, SF_DIR).agg(F.max("vec_id") + 1).first()[0]
    parts = [[number % n for number in part] for part in ordered.rdd.map(lambda r: r.number).glom().collect()]
    assert all(part == sorted(part) for part in parts) and any(len(set(part)) < len(part) for part in parts)
    assert ordered.exceptAll(rows).isEmpty() and ordered.count() == rows.count()
    assert "hashpartitioning(l_" in physical(ordered) and "rangepartitioning" not in physical(ordered)
