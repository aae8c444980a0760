"""Gene signatures: from tokens to weighted positions in the rank vectors.

Signatures form a table (sig_id, pos, token), so one job serves one signature or many.
"""

from collections.abc import Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.arguments import Arguments

# What a plain signature argument is called in the `sig_id` column.
SINGLE = "signature"

# Tokens up to which signatures travel to the tasks as one value. A token becomes at most
# one 24-byte (idx, weight) entry, so the value stays below about 25 MB.
INLINE_TOKENS = 1_000_000


def as_lists(signatures, args: Arguments, name: str = "signature") -> dict[str, list[str]] | None:
    """Signature arguments as {sig_id: tokens}; None for a signature table."""
    if isinstance(signatures, DataFrame):
        for column in ("sig_id", "pos", "token"):
            args.require(column in signatures.columns, f"{name} lacks the column {column}")
        return None
    if isinstance(signatures, Mapping):
        args.require(signatures, f"{name} is empty")
        return {str(k): args.words(f"{name} {k}", v) for k, v in signatures.items()}
    return {SINGLE: args.words(name, signatures)}


def signature_table(spark: SparkSession, signatures) -> DataFrame:
    """(sig_id, pos, token) from a string, a list, a {sig_id: tokens} map, or such a table."""
    args = Arguments()
    lists = as_lists(signatures, args)
    args.done()
    if lists is None:
        return signatures.select(
            F.col("sig_id").cast("string"), F.col("pos").cast("int"), F.col("token").cast("string")
        )
    rows = [(s, pos, word) for s, words in lists.items() for pos, word in enumerate(words, 1)]
    ids, positions, tokens = zip(*rows)
    return spark.createDataFrame(
        pa.table(
            {
                "sig_id": pa.array(ids, pa.string()),
                "pos": pa.array(positions, pa.int32()),
                "token": pa.array(tokens, pa.string()),
            }
        )
    )


def block_count(signatures, limit: int | None = None) -> int:
    """Into how many parts to split signatures so that a part is small enough for a task.

    1 for at most `limit` tokens; counting the tokens of a table is a job.
    """
    lists = as_lists(signatures, Arguments())
    tokens = signatures.count() if lists is None else sum(map(len, lists.values()))
    blocks = ceil(tokens / (limit or INLINE_TOKENS))
    # Twice as many as needed on average, since a hash does not split evenly.
    return 1 if blocks <= 1 else 2 * blocks


def signature_blocks(spark: SparkSession, signatures, blocks: int) -> list[DataFrame]:
    """Signature tables that together are `signatures`, split by hash of sig_id.

    One signature cannot make a block large however many tokens it has, since it keeps
    at most one weight per gene.
    """
    table = signature_table(spark, signatures)
    if blocks == 1:
        return [table]
    block = F.pmod(F.xxhash64("sig_id"), F.lit(blocks))
    return [table.filter(block == b) for b in range(blocks)]


def gene_lookup(genes: DataFrame) -> DataFrame:
    """(name, idx, symbol, data_type): every identifier a token may use.

    A name shared by several genes means the one with the lowest index.
    """
    return genes.sparkSession.sql(
        """
        WITH named AS (
          SELECT explode(concat(
                   array(id), coalesce(symbol, array()),
                   coalesce(entrezid, array()), coalesce(ensemblid, array())
                 )) AS name,
                 struct(index AS idx, get(symbol, 0) AS symbol, dataType AS data_type) AS gene
          FROM {genes}
        ),
        lowest AS (SELECT name, min(gene) AS gene FROM named WHERE name IS NOT NULL GROUP BY name)
        SELECT name, gene.* FROM lowest
        """,
        genes=genes,
    )


# A token split into direction and gene name.
SIGNED_TOKENS = """
    SELECT sig_id, pos, token, startswith(token, '-') AS down,
           if(startswith(token, '-'), substring(token, 2), token) AS name
    FROM {signatures}
"""


def check_signature(genes: DataFrame, signatures=".*") -> DataFrame:
    """(sig_id, pos, query, found, symbol, data_type), one row per token."""
    spark = genes.sparkSession
    return spark.sql(
        f"""
        SELECT sig_id, pos, token AS query, idx IS NOT NULL AS found,
               coalesce(symbol, '') AS symbol, coalesce(data_type, '') AS data_type
        FROM ({SIGNED_TOKENS}) LEFT JOIN {{lookup}} USING (name)
        """,
        signatures=signature_table(spark, signatures),
        lookup=gene_lookup(genes),
    )


def _numbered(genes: DataFrame, signatures: DataFrame, ordered: bool) -> DataFrame:
    """(sig_id, pos, idx, sign, weight), ending with a null `idx` if tokens are unknown.

    Of several tokens for one gene the first counts. They are reduced to one before the
    numbering, so no task numbers more rows of a signature than there are genes. Position
    and sign share one number, as a minimum of a number keeps the aggregation hash-based.
    """
    weight = "sign * (m - pos + 1)" if ordered else "sign"
    return genes.sparkSession.sql(
        f"""
        WITH firsts AS (
          SELECT sig_id, idx, min(pos * 2L + if(down, 0, 1)) AS place
          FROM ({SIGNED_TOKENS}) LEFT JOIN {{lookup}} USING (name)
          GROUP BY sig_id, idx
        ),
        numbered AS (
          SELECT sig_id, idx, if(pmod(place, 2) = 0, -1, 1) AS sign,
                 row_number() OVER (
                   PARTITION BY sig_id ORDER BY idx IS NULL, shiftright(place, 1), idx
                 ) AS pos,
                 count(idx) OVER (PARTITION BY sig_id) AS m
          FROM firsts
        )
        SELECT sig_id, pos, idx, sign, double({weight}) AS weight FROM numbered
        """,
        signatures=signatures,
        lookup=gene_lookup(genes),
    )


def parse_signature(genes: DataFrame, signatures, ordered: bool = False) -> DataFrame:
    """(sig_id, pos, idx, sign, weight) of the genes found, renumbered from 1."""
    args = Arguments()
    args.flag("ordered", ordered)
    args.done()
    table = signature_table(genes.sparkSession, signatures)
    return _numbered(genes, table, ordered).filter("idx IS NOT NULL")


def signature_weights(genes: DataFrame, signatures: DataFrame, ordered: bool = False) -> DataFrame:
    """(sig_id, weights, c_max): one row per signature, also if no gene was found.

    `c_max` is the largest sum of weighted ranks the signature can reach.
    """
    return genes.sparkSession.sql(
        """
        SELECT sig_id,
               collect_list(if(idx IS NULL, NULL, struct(idx, weight))) AS weights,
               coalesce(
                 sum(abs(weight) * ((SELECT count(*) FROM {genes}) - pos + 1))
                   FILTER (WHERE idx IS NOT NULL),
                 1D
               ) AS c_max
        FROM {numbered} GROUP BY sig_id
        """,
        genes=genes,
        numbered=_numbered(genes, signatures, ordered),
    )
