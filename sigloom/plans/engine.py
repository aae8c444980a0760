"""A loaded database with every operator as a method."""

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.arguments import Arguments
from sigloom.operators import flat, generate, histograms, lookup, scoring
from sigloom.operators.prepare import rank_vectors
from sigloom.operators.signatures import check_signature, parse_signature
from sigloom.schema import SIGNIFICANT
from sigloom.sources.blocks import Blocks, read_blocks
from sigloom.sources.genes import read_genes
from sigloom.sources.inventory import probe_versions, select_version
from sigloom.sources.layouts import read_gene_major
from sigloom.sources.perturbations import read_db, replicate_db, union_dbs

# Storage levels by the names Spark gives them.
STORAGE_LEVELS = (
    "MEMORY_ONLY",
    "MEMORY_ONLY_2",
    "MEMORY_AND_DISK",
    "MEMORY_AND_DISK_2",
    "DISK_ONLY",
    "DISK_ONLY_2",
)


@dataclass(frozen=True)
class Engine:
    """`db` with its gene table and, optionally, its gene-major copy `ranks` and its `blocks`."""

    db: DataFrame
    genes: DataFrame
    ranks: DataFrame | None = None
    blocks: Blocks | None = None

    @cached_property
    def flat(self) -> DataFrame:
        return flat.flat_db(self.db)

    def filters(self) -> DataFrame:
        return flat.filter_values(self.flat)

    def statistics(self) -> DataFrame:
        return flat.statistics(self.db, self.genes)

    def counts(self) -> DataFrame:
        return flat.db_counts(self.db)

    def informative(self, threshold: float = SIGNIFICANT) -> DataFrame:
        return flat.informative(self.db, threshold)

    def apply_filters(self, filters=None) -> DataFrame:
        return flat.apply_filters(self.db, filters)

    def select_features(self, features=".*") -> DataFrame:
        return scoring.select_features(self.db, features)

    def parse_signature(self, signatures, ordered: bool = False) -> DataFrame:
        return parse_signature(self.genes, signatures, ordered)

    def check_signature(self, signatures=".*") -> DataFrame:
        return check_signature(self.genes, signatures)

    def compounds(self, query=None, **options) -> DataFrame:
        return lookup.compounds(self.db, query, **options)

    def treatments(self, query=None, **options) -> DataFrame:
        return lookup.treatments(self.db, query, **options)

    def targets(self, query=None, **options) -> DataFrame:
        return lookup.targets(self.db, query, **options)

    def target_to_compounds(self, targets=None, **options) -> DataFrame:
        return lookup.target_to_compounds(self.db, targets, **options)

    def treatment_to_perturbations(self, treatments=None, **options) -> DataFrame:
        return lookup.treatment_to_perturbations(self.db, treatments, **options)

    def compound_to_samples(self, compounds=None, **options) -> DataFrame:
        return lookup.compound_to_samples(self.db, compounds, **options)

    def perturbation_details(self, perturbation=None) -> DataFrame:
        return lookup.perturbation_details(self.db, perturbation)

    def zhang_score(self, signatures, **options) -> DataFrame:
        return scoring.zhang_score(self.db, self.genes, signatures, ranks=self.ranks, **options)

    def top_table(self, signature=None, **options) -> DataFrame:
        return scoring.top_table(
            self.db, self.genes, signature, ranks=self.ranks, blocks=self.blocks, **options
        )

    def annotated_ids(self, signature=".*", **options) -> DataFrame:
        return scoring.annotated_ids(self.db, self.genes, signature, **options)

    def binned_zhang(self, signature=None, **options) -> DataFrame:
        return histograms.binned_zhang(
            self.db, self.genes, signature, ranks=self.ranks, **options
        )

    def correlation(self, signature1=None, signature2=None, **options) -> DataFrame:
        return histograms.correlation(
            self.db, self.genes, signature1, signature2, ranks=self.ranks, **options
        )

    def correlation_coefficient(self, signature1=None, signature2=None, **options) -> DataFrame:
        return histograms.correlation_coefficient(
            self.db, self.genes, signature1, signature2, ranks=self.ranks, **options
        )

    def generate_signature(self, samples=None, **options) -> DataFrame:
        return generate.generate_signature(self.db, self.genes, samples, **options)


def _has_ranks(spark: SparkSession, path: str) -> bool:
    """Whether a dataset stores rank vectors: looks at the file schema and one profile.

    `write_db` stores the ranks of all profiles or of none.
    """
    stored = spark.read.parquet(path).schema
    if "profile" not in stored.names or "r" not in stored["profile"].dataType.names:
        return False
    profiles = read_db(spark, path).filter("profile.t IS NOT NULL")
    found = profiles.select(F.col("profile.r").isNotNull().alias("ranked")).first()
    return found is None or found.ranked


def open_ranked(spark: SparkSession, paths: list[str], genes: DataFrame) -> DataFrame:
    """One database from all paths; ranks are computed only where none are stored."""
    stored = [path for path in paths if _has_ranks(spark, path)]
    missing = [path for path in paths if path not in stored]
    parts = [read_db(spark, stored)] if stored else []
    if missing:
        parts.append(rank_vectors(read_db(spark, missing), genes))
    return union_dbs(*parts)


def load(
    spark: SparkSession,
    paths: str | list[str] | None = None,
    gene_annotations: str | None = None,
    version: str | int = "latest",
    gene_data_types: dict[str, str] | None = None,
    multiplicity: int = 1,
    storage_level: str | None = None,
    ranks_path: str | None = None,
    gene_order: str | list[str] | None = None,
    partitions: int | None = None,
    blocks_path: str | None = None,
) -> Engine:
    """Find the inputs, keep those of one version, and open them with the gene table.

    `gene_order` names the columns whose order the vectors follow. Nothing but the choice of
    inputs runs now. Data without stored ranks are ranked as
    they are read; `storage_level` keeps the opened database cached between queries, and
    `partitions` deals its rows out evenly first.
    """
    args = Arguments()
    args.words("paths", [paths] if isinstance(paths, str) else paths)
    args.text("gene_annotations", gene_annotations)
    args.words("gene_order", gene_order)
    args.positive("multiplicity", multiplicity)
    for path, layout in ((ranks_path, "gene-major"), (blocks_path, "blocks")):
        args.require(multiplicity == 1 or path is None, f"a {layout} copy needs multiplicity 1")
    if partitions is not None:
        args.positive("partitions", partitions)
    if storage_level is not None:
        args.one_of("storage_level", storage_level, STORAGE_LEVELS)
    args.done()
    chosen = select_version(probe_versions(spark, paths), version)
    # One short row per input dataset, as long as the list of paths that a read takes.
    found = [row.path for row in chosen.select("path").collect()]
    genes = read_genes(spark, gene_annotations, gene_data_types, gene_order)
    db = replicate_db(open_ranked(spark, found, genes), multiplicity)
    if partitions is not None:
        db = db.repartition(partitions)
    if storage_level is not None:
        db = db.persist(getattr(StorageLevel, storage_level))
    ranks = None if ranks_path is None else read_gene_major(spark, ranks_path)
    blocks = None if blocks_path is None else read_blocks(spark, blocks_path)
    return Engine(db, genes, ranks, blocks)
