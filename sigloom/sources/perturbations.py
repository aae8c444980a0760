"""Reading and combining perturbation databases."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.arguments import Arguments
from sigloom.schema import PERTURBATION
from sigloom.sources.nested import kinds_of, read_nested


def read_db(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read datasets with the fixed schema: missing columns are null, others ignored.

    A look at one footer of each dataset tells its layout. Those with a struct for each kind of
    treatment (see `nested`) are folded into the fixed schema; an unknown layout is an error.
    """
    args = Arguments()
    found = args.words("paths", [paths] if isinstance(paths, str) else paths)
    args.done()
    nested = [path for path in found if kinds_of(spark.read.parquet(path).schema, path)]
    flat = [path for path in found if path not in nested]
    parts = [spark.read.schema(PERTURBATION).parquet(*flat)] if flat else []
    parts += [read_nested(spark, path) for path in nested]
    return reduce(DataFrame.unionByName, parts)


def _shaped(column: Column, has: T.DataType, wanted: T.DataType) -> Column:
    """`column` with the fields of `wanted`; fields it lacks are null."""
    if not isinstance(wanted, T.StructType) or not isinstance(has, T.StructType):
        return column.cast(wanted)
    fields = [
        (
            _shaped(column[f.name], has[f.name].dataType, f.dataType)
            if f.name in has.names
            else F.lit(None).cast(f.dataType)
        ).alias(f.name)
        for f in wanted.fields
    ]
    return F.when(column.isNotNull(), F.struct(*fields))


def conform(db: DataFrame) -> DataFrame:
    """Project any frame with perturbation columns onto the fixed schema."""
    return db.select(
        *[
            (
                _shaped(F.col(f.name), db.schema[f.name].dataType, f.dataType)
                if f.name in db.columns
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in PERTURBATION.fields
        ]
    )


def union_dbs(*dbs: DataFrame) -> DataFrame:
    """Bag union of databases whose columns may differ."""
    args = Arguments()
    args.require(dbs, "no database is given")
    args.done()
    shaped = [db if db.schema == PERTURBATION else conform(db) for db in dbs]
    return reduce(DataFrame.unionByName, shaped)


def replicate_db(db: DataFrame, k: int = 1, replica: str | None = None) -> DataFrame:
    """Every row `k` times, from one scan; `replica` names a column for the copy number."""
    args = Arguments()
    args.positive("k", k)
    args.done()
    copies = F.explode(F.sequence(F.lit(1), F.lit(k))).alias(replica or "_replica")
    copied = db.select("*", copies)
    return copied if replica else copied.drop("_replica")


def with_meta(db: DataFrame, entries: dict[str, str]) -> DataFrame:
    """Set (key, value) entries in `meta`, replacing those with the same keys."""
    added = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in entries.items()]
    )
    empty = F.array().cast(PERTURBATION["meta"].dataType)
    kept = F.filter(F.coalesce("meta", empty), lambda entry: ~entry["key"].isin(list(entries)))
    return db.withColumn("meta", F.concat(kept, added))
