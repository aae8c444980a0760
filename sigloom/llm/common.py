"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores added until no column is called so (case does not count)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents from which no label may be learned; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    That is spark.checkpoint.dir. Only a local master may do without the setting; it then gets
    a temporary folder, since its executors run in the driver's process.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and (
            spark.sparkContext.master != "local"
        ):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, so that lost executors cost no more
    than the tasks that read it and nothing above it runs twice."""
    path = work_folder(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_in = path
    return kept


def discard(kept: DataFrame) -> None:
    """Removes the table that stored() wrote, once what was made from it is stored as well."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.stored_in)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
