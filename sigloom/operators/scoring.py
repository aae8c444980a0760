"""Connection scores of every perturbation for one or many signatures.

The score is that of Zhang & Gant (BMC Bioinformatics 9:258, 2008). Ranks are multiples
of one half and weights whole numbers, so sums are exact in double precision and scores
do not depend on the order of summation.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.arguments import Arguments
from sigloom.functions.patterns import matches_any
from sigloom.functions.vectors import aligned_sql, count_at_most, is_informative, score_sql
from sigloom.operators.flat import apply_filters
from sigloom.operators.prepare import CELLS, with_gene_count
from sigloom.operators.pushdown import is_one_of
from sigloom.operators.signatures import (
    INLINE_TOKENS,
    as_lists,
    block_count,
    signature_blocks,
    signature_weights,
)
from sigloom.operators.threshold import best_by_threshold
from sigloom.schema import SIGNIFICANT
from sigloom.sources.blocks import Blocks

# Columns a report can show, apart from the score.
FEATURES = {
    "id": "id",
    "cell": "cell",
    "trt_type": "trt_type",
    "trt_id": "trt.id",
    "trt_name": "trt.name",
    "dose": "trt.dose",
    "smiles": "trt.smiles",
    "targets": "array_join(trt.targets, ',')",
}
# Those that need the p-values; they are computed for the rows of the report only.
P_FEATURES = {
    "n_significant": lambda: count_at_most(F.col("_p"), SIGNIFICANT),
    "informative": lambda: is_informative(F.col("_p")),
}
# The compound number under its traditional name.
OTHER_NAMES = {"jnjs": "trt_id"}
SCORE = "zhang"
ALL = ".*"


def feature_names(features, args: Arguments, scored: bool = True) -> list[str]:
    """Requested column names without repeats, `.*` standing for all."""
    known = [*([SCORE] if scored else []), *FEATURES, *P_FEATURES]
    wanted = []
    for name in args.words("features", features):
        wanted.extend(known if name == ALL else [name])
    wanted = list(dict.fromkeys(wanted))
    for name in wanted:
        args.require(name in known or name in OTHER_NAMES, f"unknown feature {name}")
    return wanted


def _feature_inputs(db: DataFrame, wanted: list[str], *more) -> DataFrame:
    """The columns the features need, under plain names, so that nothing else is read."""
    named = {OTHER_NAMES.get(name, name) for name in wanted} | {"id"}
    columns = [F.expr(sql).alias(name) for name, sql in FEATURES.items() if name in named]
    if not named.isdisjoint(P_FEATURES):
        columns.append(F.col("profile.p").alias("_p"))
    return db.select(*columns, *more)


def _feature_columns(frame: DataFrame, wanted: list[str]) -> DataFrame:
    columns = []
    for name in wanted:
        source = OTHER_NAMES.get(name, name)
        column = P_FEATURES[source]() if source in P_FEATURES else F.col(source)
        columns.append(column.alias(name))
    return frame.select(*[c for c in ("sig_id",) if c in frame.columns], *columns)


def select_features(db: DataFrame, features=ALL) -> DataFrame:
    """Columns of a database by feature name, in the order asked for."""
    args = Arguments()
    wanted = feature_names(features, args, scored=False)
    args.done()
    return _feature_columns(_feature_inputs(db, wanted), wanted)


def resolve(genes: DataFrame, block: DataFrame, ordered: bool, name: str) -> DataFrame:
    """(sig_id, `name`): the weights and largest sum of each signature, in one struct."""
    weights = signature_weights(genes, block, ordered)
    return weights.select("sig_id", F.struct("weights", "c_max").alias(name))


def score_vectors(frame: DataFrame, genes: DataFrame, resolved: DataFrame) -> DataFrame:
    """`frame` with its rank vectors `_ranks` replaced by sig_id and scores.

    One row for each row with ranks and each row of `resolved`; every column of that but
    sig_id gives a score under its name. `resolved` is reduced to one array, which the
    tasks get as a constant.
    """
    keep = [name for name in frame.columns if name != "_ranks"]
    names = [name for name in resolved.columns if name != "sig_id"]
    entries = resolved.agg(F.collect_list(F.struct(*resolved.columns))).scalar()
    ready = with_gene_count(frame, genes).withColumn("_signatures", entries)
    fields = ", ".join(f"{score_sql('r', f's.{name}')} AS {name}" for name in names)
    # The one-element array gives the checked vector a name inside the expression.
    scored = ready.select(
        *keep,
        F.expr(
            f"""
            transform(array({aligned_sql("_ranks", "_n_genes")}), r ->
              if(r IS NULL, NULL, transform(_signatures, s -> struct(s.sig_id, {fields})))
            )[0]
            """
        ).alias("_scores"),
    )
    # For a plain `inline` the optimizer adds a filter on its input, which would compute
    # all scores a second time.
    unfolded = scored.select(*keep, F.inline_outer("_scores").alias("sig_id", *names))
    return unfolded.filter("sig_id IS NOT NULL")


def score_products(frame: DataFrame, genes: DataFrame, resolved: DataFrame) -> DataFrame:
    """The rows of `score_vectors`, for many signatures, as products of blocks.

    The signatures of a part, inverted by gene, and their ids reach the tasks as arrays of the
    size that `block_count` bounds. A task multiplies some vectors, restricted to the genes in
    use, with the dense weights of some signatures at a time; neither factor nor the product has
    more than CELLS numbers, whatever the size of a batch, the table or the vectors.
    """
    keep = [name for name in frame.columns if name != "_ranks"]
    names = [name for name in resolved.columns if name != "sig_id"]
    signatures = resolved.orderBy("sig_id").toArrow().combine_chunks()
    weights = {name: _Weights(signatures[name].combine_chunks()) for name in names}
    ids = signatures["sig_id"].combine_chunks()

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            if not len(there) or not len(ids):
                continue
            offsets = vectors.offsets.to_numpy()
            n_genes = int(offsets[there[0] + 1] - offsets[there[0]])
            flat = vectors.values.to_numpy(zero_copy_only=False)
            others = pa.RecordBatch.from_arrays(batch.columns[1:], names=keep)
            used = max(1, *(len(w.genes) for w in weights.values()))
            rows = max(1, min(CELLS // max(n_genes, used), len(there)))
            width = max(1, min(CELLS // max(used, rows), len(ids)))
            for at in range(0, len(there), rows):
                own = there[at : at + rows]
                ranks = flat[offsets[own][:, None] + np.arange(n_genes)]
                for first in range(0, len(ids), width):
                    last = min(first + width, len(ids))
                    scores = [w.scores(ranks, first, last) for w in weights.values()]
                    n = last - first
                    repeated = others.take(pa.array(np.repeat(own, n)))
                    sig_ids = ids.take(pa.array(np.tile(np.arange(first, last), len(own))))
                    yield pa.RecordBatch.from_arrays(
                        [*repeated.columns, sig_ids, *[pa.array(s.ravel()) for s in scores]],
                        names=[*keep, "sig_id", *names],
                    )

    ready = with_gene_count(frame, genes)
    vectors = F.expr(aligned_sql("_ranks", "_n_genes"))
    kind = T.StructType([frame.schema[name] for name in keep]).add("sig_id", T.StringType())
    for name in names:
        kind = kind.add(name, T.DoubleType())
    return ready.select(vectors.alias("_ranks"), *keep).mapInArrow(multiplied, kind)


class _Weights:
    """Weights of signatures by gene: places among the genes in use, signatures, weights."""

    def __init__(self, column: pa.StructArray):
        entries = column.field("weights")
        offsets = entries.offsets.to_numpy()
        flat = entries.values
        idx = flat.field("idx").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.arange(offsets[0], offsets[-1])
        self.genes, self.place = np.unique(idx[order] - 1, return_inverse=True)
        self.weight = flat.field("weight").to_numpy(zero_copy_only=False)[order]
        self.starts = offsets - offsets[0]
        self.c_max = column.field("c_max").to_numpy(zero_copy_only=False)

    def scores(self, ranks: np.ndarray, first: int, last: int) -> np.ndarray:
        """Scores of rows with the signatures from first to last; sums of exact terms."""
        dense = np.zeros((len(self.genes), last - first))
        own = slice(self.starts[first], self.starts[last])
        signature = np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1]))
        dense[self.place[own], signature] = self.weight[own]
        return ranks[:, self.genes] @ dense / self.c_max[first:last] + 0.0


def score_genes(ranks: DataFrame, resolved: DataFrame) -> DataFrame:
    """The same scores from gene-major ranks, as (sig_id, id, scores), for unique ids.

    Reads only the genes needed. The ranks of one perturbation lie in one file, so most
    of a sum is formed before the shuffle. The job fails if an id repeats.
    """
    names = [name for name in resolved.columns if name != "sig_id"]

    def terms_of(name):
        others = ", ".join(f"{'w.weight' if n == name else '0D'} AS {n}" for n in names)
        return f"transform({name}.weights, w -> struct(w.idx AS idx, {others}, 0 AS _n))"

    # A zero weight on the first gene, where every perturbation has one row, gives a score
    # of 0 to signatures without genes, and counts the perturbations of an id.
    nothing = f"array(struct(1 AS idx, {', '.join(f'0D AS {n}' for n in names)}, 1 AS _n))"
    terms = resolved.select(
        "sig_id",
        *[F.col(f"{name}.c_max").alias(f"c_{name}") for name in names],
        F.inline(F.expr(f"concat({nothing}, {', '.join(map(terms_of, names))})")),
    )
    # A block of signatures has about a bounded number of weights (block_count). They are
    # resolved once: the genes in use let the scan skip all others, the rest is broadcast,
    # unless a block has come out larger than it should.
    rows = terms.toArrow()
    used = rows["idx"].unique().to_pylist()
    weights = ranks.sparkSession.createDataFrame(rows)
    if rows.num_rows <= 2 * INLINE_TOKENS:
        weights = F.broadcast(weights)
    sums = [
        (F.sum(F.col("r") * F.col(n)) / F.first(f"c_{n}") + F.lit(0.0)).alias(n) for n in names
    ]
    summed = (
        ranks.filter(is_one_of("idx", used))
        .join(weights, "idx")
        .groupBy("sig_id", "id")
        .agg(*sums, F.sum("_n").alias("_ones"))
    )
    repeated = F.raise_error(F.concat(F.lit("gene-major ranks have an id twice: "), "id"))
    return summed.select(
        "sig_id", F.when(F.col("_ones") > 1, repeated).otherwise(F.col("id")).alias("id"), *names
    )


def rank_column() -> Column:
    """The rank vectors; the job fails at a profile without one, which would go unscored.

    Whether there is a profile shows in the same column, so that nothing else is read.
    """
    unranked = F.raise_error(F.lit("a profile has no ranks: rank the database first"))
    return F.when(
        F.col("profile").isNotNull() & F.col("profile.r").isNull(), unranked
    ).otherwise(F.col("profile.r")).alias("_ranks")


def with_scores(frame: DataFrame, genes: DataFrame, signatures, ordered: bool = False) -> DataFrame:
    """`frame` with `sig_id` and `zhang` in place of its rank vectors `_ranks`.

    Map-only: the resolved signatures reach each task as one value of bounded size, and
    every vector is read once for all of them. Larger signature tables are scored block
    by block. The few signatures of a list are scored in expressions, those of a table in
    products.
    """
    args = Arguments()
    lists = as_lists(signatures, args)
    args.flag("ordered", ordered)
    args.done()
    score = score_products if lists is None else score_vectors
    blocks = signature_blocks(frame.sparkSession, signatures, block_count(signatures))
    scored = [score(frame, genes, resolve(genes, block, ordered, SCORE)) for block in blocks]
    return reduce(DataFrame.unionAll, scored)


def gene_major_scores(
    ranks: DataFrame, genes: DataFrame, signatures, ordered: bool = False
) -> DataFrame:
    """(sig_id, id, zhang) from the gene-major layout; equal to `zhang_score` on the wide."""
    args = Arguments()
    as_lists(signatures, args)
    args.flag("ordered", ordered)
    args.done()
    blocks = signature_blocks(ranks.sparkSession, signatures, block_count(signatures))
    scored = [score_genes(ranks, resolve(genes, block, ordered, SCORE)) for block in blocks]
    return reduce(DataFrame.unionAll, scored)


def only_filtered(scores: DataFrame, db: DataFrame, filters) -> DataFrame:
    """Scores of the perturbations that pass the filters."""
    if not filters:
        return scores
    return scores.join(apply_filters(db, filters).select("id"), "id", "left_semi")


def zhang_score(
    db: DataFrame,
    genes: DataFrame,
    signatures,
    ordered: bool = False,
    filters=None,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """(sig_id, id, zhang) for all perturbations with a profile that pass the filters.

    With `ranks`, the gene-major copy of `db`, scores come from there.
    """
    if ranks is None:
        vectors = apply_filters(db, filters).select("id", rank_column())
        return with_scores(vectors, genes, signatures, ordered).select("sig_id", "id", SCORE)
    scores = gene_major_scores(ranks, genes, signatures, ordered)
    return only_filtered(scores, db, filters).select("sig_id", "id", SCORE)


def best_rows(scored: DataFrame, signatures, n: int, highest: bool = True) -> DataFrame:
    """The first `n` rows per signature by score, ties by id.

    For one signature a plain ordered limit; for several each task first keeps its own
    `n` rows per signature, so few rows are shuffled however uneven they are.
    """
    by_score = [F.col("zhang").desc() if highest else F.col("zhang").asc(), F.col("id").asc()]
    lists = as_lists(signatures, Arguments())
    if lists is not None and len(lists) == 1:
        return scored.orderBy(*by_score).limit(n)
    place = F.row_number().over(Window.partitionBy("sig_id").orderBy(*by_score))
    kept = scored.withColumn("place", place).filter(F.col("place") <= n)
    return kept.orderBy("sig_id", "place").drop("place")


def _looked_up(db: DataFrame, chosen: DataFrame, wanted: list[str]) -> DataFrame:
    """The chosen rows of one signature, at most n, with the columns the features need: their
    ids let the scan of db, which is ordered by id, skip the rest."""
    found = chosen.toArrow()
    rows = db.filter(is_one_of("id", found["id"].to_pylist()))
    return _feature_inputs(rows, wanted).join(db.sparkSession.createDataFrame(found), "id")


def top_table(
    db: DataFrame,
    genes: DataFrame,
    signature=None,
    head: int = 0,
    tail: int = 0,
    features=ALL,
    filters=None,
    ordered: bool = False,
    ranks: DataFrame | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """The `head` best or the `tail` worst matches of a signature, with chosen columns.

    With `ranks`, the gene-major copy of `db`, only the chosen rows are looked up in `db`. With
    `blocks`, its block layout, a single signature is also matched without reading all ranks.
    """
    args = Arguments()
    as_lists(signature, args)
    counts = [args.is_integer("head", head), args.is_integer("tail", tail)]
    if all(counts):
        args.require((head > 0) != (tail > 0), "exactly one of head and tail must be above 0")
    wanted = feature_names(features, args)
    args.flag("ordered", ordered)
    args.done()
    highest, n = head > 0, head if head > 0 else tail
    lists = as_lists(signature, Arguments())
    single = lists is not None and len(lists) == 1
    found = None
    if blocks is not None and single:
        found = best_by_threshold(db, genes, blocks, signature, n, highest, ordered, filters)
    if found is not None:
        scored = _looked_up(db, found[0], wanted)
    elif ranks is None:
        inputs = _feature_inputs(apply_filters(db, filters), wanted, rank_column())
        scored = with_scores(inputs, genes, signature, ordered)
    else:
        scores = zhang_score(db, genes, signature, ordered, filters, ranks)
        chosen = best_rows(scores, signature, n, highest)
        if single:
            scored = _looked_up(db, chosen, wanted)
        else:
            scored = _feature_inputs(db, wanted).join(chosen, "id")
    return _feature_columns(best_rows(scored, signature, n, highest), wanted)


def top_table_head(db, genes, signature=None, n: int = 0, features=ALL, filters=None, **options):
    """The `n` highest scores, in descending order."""
    return top_table(db, genes, signature, n, 0, features, filters, **options)


def top_table_tail(db, genes, signature=None, n: int = 0, features=ALL, filters=None, **options):
    """The `n` lowest scores, in ascending order."""
    return top_table(db, genes, signature, 0, n, features, filters, **options)


def annotated_ids(
    db: DataFrame,
    genes: DataFrame,
    signature=ALL,
    ids=ALL,
    limit: int = 10,
    features=ALL,
    ordered: bool = False,
) -> DataFrame:
    """Scores and annotations of the perturbations whose id matches one of `ids`."""
    args = Arguments()
    as_lists(signature, args)
    patterns = args.words("ids", ids)
    args.positive("limit", limit)
    wanted = feature_names(features, args)
    args.done()
    asked = db.filter(matches_any(F.col("id"), patterns))
    scored = with_scores(_feature_inputs(asked, wanted, rank_column()), genes, signature, ordered)
    return _feature_columns(best_rows(scored, signature, limit), wanted)
