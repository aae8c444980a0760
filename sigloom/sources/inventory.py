"""Which perturbation datasets lie under a list of paths, and in which version."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.arguments import ArgumentError, Arguments
from sigloom.functions.metadata import iso_date, meta_value, version_part
from sigloom.schema import PERTURBATION, STAMP


def _read_arguments(paths: str | list[str]) -> list[str]:
    args = Arguments()
    found = args.words("paths", [paths] if isinstance(paths, str) else paths)
    args.done()
    return [path.rstrip("/") for path in found]


def _is_dataset(path: str) -> bool:
    return ".parquet" in path.rsplit("/", 1)[-1]


def _scan_paths(paths: list[str]) -> list[str]:
    """Datasets as they are; of any other directory, the entries named like a dataset."""
    return [path if _is_dataset(path) else f"{path}/*.parquet*" for path in paths]


def _dataset(paths: list[str]) -> Column:
    """Dataset a scanned file belongs to: an input path, or an entry of an input directory.

    Spark reports file paths URL-encoded, though with a plain `+`.
    """
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    file_path = F.url_decode(encoded)
    found = F.lit(None).cast("string")
    for path in sorted(paths, key=len):
        bare = re.sub(r"^[a-zA-Z][\w+.-]*:/*(?=/)", "", path)
        tail = "" if _is_dataset(path) else "/[^/]+"
        pattern = f"^(.*{re.escape(bare)}{tail})(?:/.*)?$"
        part = F.regexp_extract(file_path, pattern, 1)
        found = F.when(part != "", part).otherwise(found)
    return found


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every file of the inputs, listed without opening one."""
    listing = spark.read.format("binaryFile").load(_scan_paths(paths))
    return listing.select(_dataset(paths).alias("dataset"))


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    scan = spark.read.schema(PERTURBATION).parquet(*_scan_paths(paths))
    return scan.withColumn("dataset", _dataset(paths))


def input_inventory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(dataset, n_rows) of all inputs; an input without rows counts 0."""
    paths = _read_arguments(paths)
    datasets = _files(spark, paths).distinct()
    counts = _rows(spark, paths).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    return datasets.join(counts, "dataset", "left").select(
        "dataset", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")
    )


def _meta_entries(spark: SparkSession, dataset: str) -> list[tuple[str, str]] | None:
    """The entries of `meta` in a dataset's first row, as a list or null.

    A dataset that `write_db` has stamped tells them in the footer of a file, and no row is read.
    Of any other, Spark reads the first batch of the column in the first partition that has rows.
    """
    footer = spark.read.parquet(dataset).schema
    if "meta" in footer.names and STAMP in footer["meta"].metadata:
        return list(footer["meta"].metadata[STAMP].items())
    only = T.StructType([PERTURBATION["meta"]])
    first = spark.read.schema(only).parquet(dataset).head(1)
    return [tuple(e) for e in first[0].meta or [] if e is not None] if first else None


def probe_versions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, version_major, version_minor, processing_date) of each dataset, from its first row.

    What is read for a dataset does not grow with it: a footer, and a batch of rows at most.
    """
    paths = _read_arguments(paths)
    datasets = sorted(row.dataset for row in _files(spark, paths).distinct().collect())
    probed = spark.createDataFrame(
        [(dataset, _meta_entries(spark, dataset)) for dataset in datasets],
        T.StructType([T.StructField("dataset", T.StringType()), PERTURBATION["meta"]]),
    )
    version = meta_value(F.col("meta"), "version")
    return probed.select(
        F.col("dataset").alias("path"),
        version_part(version, 1).alias("version_major"),
        version_part(version, 2).alias("version_minor"),
        iso_date(meta_value(F.col("meta"), "processingDate")).alias("processing_date"),
    )


def select_version(probed: DataFrame, version: str | int = "latest") -> DataFrame:
    """Keep all inputs of one major version: `latest`, or a number such as 2 or "v2"."""
    if version == "latest":
        newest = probed.agg(F.max("version_major")).scalar()
        chosen = probed.filter(F.col("version_major") == newest)
    else:
        number = re.fullmatch(r"v?(\d+)(?:\.\d+)?", str(version))
        if not number:
            raise ArgumentError([f"version must be latest or a number, not {version!r}"])
        chosen = probed.filter(F.col("version_major") == int(number[1]))
    if chosen.isEmpty():
        raise ArgumentError([f"no input has the version {version}"])
    return chosen
