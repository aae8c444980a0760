"""The nested layout: an optional struct for each kind of treatment."""

import re

import pytest
from pyspark.sql import functions as F

from sigloom.functions.arguments import ArgumentError
from sigloom.operators import flat
from sigloom.schema import PERTURBATION
from sigloom.sources.nested import read_nested
from sigloom.sources.perturbations import read_db
from workload.tables import ALL_KINDS, FOUR_KINDS, nested


def rows(db):
    return sorted(map(str, db.withColumn("profile", F.col("profile").dropFields("r")).collect()))


@pytest.fixture(scope="module")
def folder(unranked, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('nested')}"
    nested(unranked, FOUR_KINDS).write.parquet(f"{path}/four.parquet")
    nested(unranked, ALL_KINDS).write.parquet(f"{path}/all.parquet")
    unranked.write.parquet(f"{path}/flat.parquet")
    return path


def test_four_and_fourteen_kinds_give_the_same_db(spark, folder, unranked):
    four, every = (read_db(spark, f"{folder}/{name}.parquet") for name in ("four", "all"))
    assert four.schema.simpleString() == every.schema.simpleString() == PERTURBATION.simpleString()
    assert rows(four) == rows(every) == rows(unranked)
    both = read_db(spark, [f"{folder}/{n}.parquet" for n in ("four", "all", "flat")])
    assert both.count() == 3 * unranked.count()
    assert rows(flat.flat_db(four).withColumn("profile", F.struct(F.lit(1).alias("r"), F.lit(2).alias("p")))) == rows(
        flat.flat_db(unranked).withColumn("profile", F.struct(F.lit(1).alias("r"), F.lit(2).alias("p")))
    )


def test_files_with_more_kinds_can_be_appended(spark, folder, unranked):
    path = f"{folder}/appended.parquet"
    nested(unranked, FOUR_KINDS).write.parquet(path)
    nested(unranked, ALL_KINDS).write.mode("append").parquet(path)
    assert rows(read_db(spark, path)) == sorted(2 * rows(unranked))


def read_schema(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"ReadSchema: (struct<.*)", plan)


def test_only_what_is_asked_for_is_read(spark, folder):
    db = read_db(spark, f"{folder}/all.parquet")
    (read,) = read_schema(db.select("trt.name"))
    assert "name" in read and "trtType" in read
    assert not re.search("smiles|dose|targets|profile|meta", read)
    (read,) = read_schema(db.select("id", "profile.p"))
    assert read == "struct<id:string,profiles:struct<profile:struct<p:array<double>>>>"
    (read,) = read_schema(db.select("cell"))
    assert read == "struct<cellDetails:array<string>>"


KIND = "struct<id:string,name:string>"


def test_kinds_without_a_tag(spark, tmp_path):
    path = f"file://{tmp_path}/untagged.parquet"
    schema = f"id string, trt struct<trt_cp:{KIND},trt_sh:struct<trtName:string,dose:int>>"
    found = [("a", (("C1", "one"), None)), ("b", (None, ("two", 3))), ("c", (None, None)), ("d", None)]
    spark.createDataFrame(found, schema).write.parquet(path)
    got = read_db(spark, path).select("id", "trt_type", "trt.id", "trt.name", "trt.dose", "profile")
    assert sorted(map(tuple, got.collect())) == [
        ("a", "trt_cp", "C1", "one", None, None),
        ("b", "trt_sh", None, "two", "3", None),
        ("c", None, None, None, None, None),
        ("d", None, None, None, None, None),
    ]


def test_the_tag_decides(spark, tmp_path):
    path = f"file://{tmp_path}/tagged.parquet"
    schema = f"id string, trtType string, trt struct<trt_cp:{KIND},trt_sh:{KIND}>"
    both = (("C1", "one"), ("S1", "two"))
    found = [("a", "trt_sh", both), ("b", "trt_cp", both), ("c", "other", (None, ("S1", "two")))]
    spark.createDataFrame(found, schema).write.parquet(path)
    got = read_db(spark, path).select("id", "trt_type", "trt.name").collect()
    assert sorted(map(tuple, got)) == [("a", "trt_sh", "two"), ("b", "trt_cp", "one"), ("c", "other", "two")]
    spark.createDataFrame([("d", None, both)], schema).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="several treatments and no type"):
        read_db(spark, path).select("trt_type").collect()


@pytest.mark.parametrize(
    "schema", ["id string, trt string", f"id string, trt struct<id:string,trt_cp:{KIND}>", "id string, trt struct<what:int>"]
)
def test_unknown_layouts_are_errors(spark, tmp_path, schema):
    path = f"file://{tmp_path}/unknown.parquet"
    spark.createDataFrame([], schema).write.parquet(path)
    with pytest.raises(ArgumentError, match="layout of the column trt"):
        read_db(spark, path)


def test_places_can_be_named(spark, tmp_path, folder):
    path = f"file://{tmp_path}/places.parquet"
    schema = f"sample string, cell struct<details:array<string>>, kind string, trt struct<trt_cp:{KIND}>"
    spark.createDataFrame([("a", (["MCF7", "x"],), "trt_cp", (("C1", "one"),))], schema).write.parquet(path)
    places = {"id": "sample", "cell": "cell.details", "tag": "kind"}
    row = read_nested(spark, path, places).first()
    assert (row.id, row.cell, row.trt_type, row.trt.name) == ("a", "MCF7", "trt_cp", "one")
    with pytest.raises(ArgumentError, match="there is no cell.name"):
        read_nested(spark, path, {"cell": "cell.name"})
    with pytest.raises(ArgumentError, match="no kinds"):
        read_nested(spark, f"{folder}/flat.parquet")
