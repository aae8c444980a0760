"""Shards from a weighted hash tree: a row descends from region to rack to shard.

On each level every child draws a straw, ln(u) / weight, where u in (0, 1] is a hash of the row's
key and the child's path; the longest straw (nearest to 0) wins, so a child wins in proportion to
its weight. A straw depends on nothing but key, path and weight. So if weights change, a child
whose weight grew can only win rows and one whose weight shrank only lose them: rows move within
or between subtrees whose weights change, and nowhere else. A shard that is added brings a region
of its own; all other weights stay, and the rows that move go into it.

Slots number the rows of a shard from 0. Rows are written once, sorted by shard within each task;
a row's slot is its place in its file plus an offset for the file and shard, so only counts for
each file and shard are brought together, however uneven shards are.

Defined results: a null key is a key like any other, so all rows with it share a shard; a null
text has no bytes (size 8, crc32 0); rows that repeat each get a slot; an empty table gives an
empty table; other columns stay, and a result whose name is taken gets underscores added.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import free_name, stored

RACK, REGION = 4, 2  # shards of a rack, racks of a region, as first built
BROADCAST_OFFSETS = 100_000  # rows of some 100 bytes: 10 MB


class Shard(NamedTuple):
    region: int
    rack: int  # within its region
    shard: int
    weight: float = 1.0


def even_tree(n: int) -> tuple[Shard, ...]:
    """n equal shards in racks of RACK, in regions of REGION racks."""
    if n < 1:
        raise ValueError("there must be a shard at least")
    per_region = RACK * REGION
    return tuple(Shard(s // per_region, s % per_region // RACK, s) for s in range(n))


def with_one_more(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a region of its own: rows move only into that shard."""
    return (
        *tree,
        Shard(1 + max(s.region for s in tree), 0, 1 + max(s.shard for s in tree), weight),
    )


def _checked(tree: tuple[Shard, ...]) -> None:
    if len({s.shard for s in tree}) != len(tree):
        raise ValueError("a shard stands in the tree twice")
    if not all(0 <= s.weight < float("inf") for s in tree) or not any(s.weight for s in tree):
        raise ValueError("weights must be finite, not below 0, and not all 0")


def _children(tree: tuple[Shard, ...]) -> tuple[list, list, list]:
    """Of regions, racks and shards: (number of the group of their children, path, weight), where
    a group holds the children of one node; the number of a shard is its own."""
    regions: dict[int, dict[int, list[Shard]]] = {}
    for s in tree:
        if s.weight:
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    top, middle, bottom = [], [], []
    for region, racks in sorted(regions.items()):
        top.append((len(middle), f"{region}", sum(s.weight for own in racks.values() for s in own)))
        group = []
        for rack, own in sorted(racks.items()):
            group.append((len(bottom), f"{region}/{rack}", sum(s.weight for s in own)))
            bottom.append([(s.shard, f"{region}/{rack}/{s.shard}", s.weight) for s in own])
        middle.append(group)
    return top, middle, bottom


def _literal(nodes: list) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(number).alias("number"),
                F.lit(path).alias("path"),
                F.lit(float(weight)).alias("weight"),
            )
            for number, path, weight in nodes
        ]
    )


def _longest(key: Column, nodes: Column) -> Column:
    """The number of the child with the longest straw; of equal straws the larger number."""

    def straw(node: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, node["path"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.ln(u) / node["weight"]).alias("straw"), node["number"].alias("number"))

    return F.array_max(F.transform(nodes, straw))["number"]


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of a key in a tree: one draw a child on the way down."""
    _checked(tree)
    key = key.cast("string")
    top, middle, bottom = _children(tree)
    rack = _longest(key, F.get(F.array(*map(_literal, middle)), _longest(key, _literal(top))))
    return _longest(key, F.get(F.array(*map(_literal, bottom)), rack))


def with_shard(
    docs: DataFrame, tree: tuple[Shard, ...], key: str = "doc_id", name: str = "shard"
) -> DataFrame:
    return docs.withColumn(free_name(docs.columns, name), shard_of(F.col(key), tree))


def with_slot(docs: DataFrame, shard: str = "shard", name: str = "slot") -> DataFrame:
    """docs with a number for each row, gapless from 0 within its shard."""
    slot, file, place = (free_name(docs.columns, x) for x in (name, "file_", "place_"))
    kept = stored(docs.sparkSession, docs.sortWithinPartitions(shard), "sharded")
    placed = kept.withColumn(file, F.col("_metadata.file_path")).withColumn(
        place, F.col("_metadata.row_index")
    )
    counts = placed.groupBy(file, shard).agg(F.min(place).alias("first_"), F.count("*").alias("n_"))
    before = Window.partitionBy(shard).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        docs.sparkSession,
        counts.select(
            F.col(file).alias("of_file_"),
            F.col(shard).alias("of_shard_"),
            (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("offset_"),
        ),
        "offsets",
    )
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    same = (placed[file] == offsets["of_file_"]) & placed[shard].eqNullSafe(offsets["of_shard_"])
    return placed.join(offsets, same).select(
        *docs.columns, (F.col(place) + F.col("offset_")).alias(slot)
    )


def write_shards(docs: DataFrame, path: str, tree: tuple[Shard, ...], key: str = "doc_id") -> None:
    """docs as Parquet with a folder for each shard."""
    name = free_name(docs.columns, "shard")
    with_shard(docs, tree, key, name).write.partitionBy(name).parquet(path)


def report(docs: DataFrame, n: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): in n shards, and in one more."""
    tree = even_tree(n)
    text = F.coalesce("text", F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), with_one_more(tree)).alias("grown_shard"),
    )
    return with_slot(placed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
