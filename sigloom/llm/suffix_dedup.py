"""Removal of repeated byte strings, found with suffix arrays over shards.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else. The windows of
that length are dealt to shards by content: a window belongs to the place, in its first
``LENGTH - KEY`` + 1 bytes, whose 32-byte hash is least, and to the ``KEY`` bytes there. Equal
windows have equal keys. The windows of one place form a segment, so a text of n bytes has about
n/120 of them, and only numbers are shuffled until it is known which keys occur again.

Segments of such keys that are the same text are one, with a count. Where all segments of a key
are the same, all their windows repeat. For the other keys, the text of each different segment is
sent to a shard: the shard's suffix array is built by induced sorting, permuted common prefixes
give the runs of suffixes that share ``LENGTH`` bytes, and a run (or one segment that counts more
than once) is a repeated window. The windows of a key with more than ``HOT`` different segments are
parted in two, by how many of their bytes come before the key's place. All windows of a half share
more bytes with it, which are its new key; segments alone with theirs go, equal ones become one, and
halves whose key is still too common are parted again. At last a half is one window, and its key the
window itself, so this ends.

Defined results: null is empty text; texts shorter than ``LENGTH`` lose nothing; equal rows are
each other's repeats; rows that share an id are treated each by its text; empty table, empty
result; columns of the input keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import free_name, stored
from sigloom.llm.hashing import between, mixed, prefixes
from sigloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
KEY = 160
GRAM = 32
HOT = 4_000  # different segments of one key, which lie in one shard: 2 MB of text at most
SHARD_BYTES = 600_000
SPREAD = 10_000  # rows of one key or segment that meet in one task of a join
BROADCAST_BYTES = 64_000_000


def segments(data: bytes) -> tuple[np.ndarray, ...]:
    """First window, number of windows, hash of the key and of the text of each segment."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    sums = prefixes(np.frombuffer(data, np.uint8))
    at = np.arange(n - KEY + 1)
    # The hash above, the place below: of equal hashes, the first place is least.
    least = (between(sums, at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    reach, width = 1, LENGTH - KEY + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    count = np.diff(first, append=len(place))
    key = between(sums, place[first], place[first] + KEY)
    text = between(sums, first, first + count - 1 + LENGTH)
    return first, count, key.astype(np.int64), mixed(text + count.astype(np.uint64)).astype(np.int64)


def segment_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, windows, key, segment) from (doc_id, text_hash, bytes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(b) for b in batch.column("bytes").to_pylist()]
            counts = [len(f[0]) for f in found]
            owner = pa.array(np.repeat(np.arange(len(found)), counts))
            parts = [np.concatenate([f[i] for f in found]) if found else [] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(owner),
                    batch.column("text_hash").take(owner),
                    pa.array(parts[0], pa.int32()),
                    pa.array(parts[1], pa.int32()),
                    pa.array(parts[2], pa.int64()),
                    pa.array(parts[3], pa.int64()),
                ],
                names=["doc_id", "text_hash", "first", "windows", "key", "segment"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        rows,
        f"doc_id {kind}, text_hash long, first int, windows int, key long, segment long",
    )


def halves(pieces: DataFrame) -> DataFrame:
    """(segment, at, key, part, windows, n, place, low, high, bytes): the windows of each segment in
    two parts with longer keys; ``at`` is the first window of a part.

    pieces: (segment, windows, n, place, low, high, bytes). A window begins ``low`` to ``high`` bytes
    before the place of the key (null: not known yet).
    """

    def parted(r: dict) -> Iterator[tuple]:
        data, windows, low, high = r["bytes"], r["windows"], r["low"], r["high"]
        sums = prefixes(np.frombuffer(data, np.uint8))
        place = r["place"]
        if place is None:
            at = np.arange(LENGTH - KEY + 1)
            place = int(np.argmin(between(sums, at, at + GRAM) >> np.uint64(32)))
        middle = (low + high + 1) // 2
        first = min(windows, max(0, place - middle + 1))
        for at, n, lo, hi in ((0, first, middle, high), (first, windows - first, low, middle - 1)):
            if n:
                ends = at + n - 1 + LENGTH
                here, text = between(
                    sums, np.array([place - lo, at]), np.array([place - hi + LENGTH, ends])
                )
                key, part = mixed(np.array([here + np.uint64(lo), text + np.uint64(n)])).astype(np.int64)
                yield r["segment"], at, int(key), int(part), n, r["n"], place - at, lo, hi, data[at:ends]

    names = ("segment", "at", "key", "part", "windows", "n", "place", "low", "high", "bytes")
    kinds = (*(pa.int64(), pa.int32()), *[pa.int64()] * 2, pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in batch.to_pylist() for x in parted(r)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names)
            )

    return pieces.mapInArrow(
        rows,
        "segment long, at int, key long, part long, windows int, n long, place int, low int, high int,"
        " bytes binary",
    )


def repeated_windows(pieces: list[bytes], windows: list[int], counts: list[int]):
    """The runs of equal windows in a shard: arrays of run, piece and place, and each run's count.

    Only runs that count twice or more are of interest; a window that stands alone is a run of one.
    """
    joined = b"\xff".join(pieces)  # no UTF-8 text has this byte
    s = np.frombuffer(joined, np.uint8)
    s = np.where(s == 255, 1, s + 2).astype(np.uint8)
    s = np.append(s, np.uint8(0))
    sa = suffix_array(s)
    shared = common_prefixes(s, sa)
    starts = np.cumsum([0, *[len(p) + 1 for p in pieces[:-1]]])
    piece = np.searchsorted(starts, sa, side="right") - 1
    place = sa - starts[piece]
    valid = place < np.array(windows)[piece]
    # Suffixes that share LENGTH bytes stand together, and are windows if one of them is.
    run = np.cumsum(shared[sa] < LENGTH)[valid]
    piece, place = piece[valid], place[valid]
    run = np.unique(run, return_inverse=True)[1]
    return run, piece, place, np.bincount(run, np.array(counts)[piece]).astype(np.int64)


def _spans(piece: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each piece, the stretches of consecutive places: (first, number)."""
    order = np.lexsort((place, piece))
    piece, place = piece[order], place[order]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=len(piece))
    out: dict[int, list] = {}
    for h, n in zip(heads.tolist(), sizes.tolist(), strict=True):
        out.setdefault(int(piece[h]), []).append((int(place[h]), n))
    yield from out.items()


_span_list = T.ArrayType(T.StructType().add("at", T.IntegerType()).add("n", T.IntegerType()))
_span_arrow = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def shard_runs(pieces: DataFrame) -> DataFrame:
    """(segment, spans): the repeated windows of segments.

    pieces: (key, segment, windows, n, bytes), with the rows of a key together.
    """

    def solved(held: list[dict]) -> pa.RecordBatch:
        run, piece, place, count = repeated_windows(
            [r["bytes"] for r in held], [r["windows"] for r in held], [r["n"] for r in held]
        )
        again = count[run] > 1
        found = dict(_spans(piece[again], place[again]))
        spans = [[{"at": a, "n": n} for a, n in x] for x in found.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[p]["segment"] for p in found], pa.int64()), pa.array(spans, _span_arrow)],
            names=["segment", "spans"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if size >= SHARD_BYTES and r["key"] != last:
                    yield solved(held)
                    held, size = [], 0
                last = r["key"]
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield solved(held)

    schema = T.StructType().add("segment", T.LongType()).add("spans", _span_list)
    return pieces.mapInArrow(rows, schema)


def _parted(spark, pieces: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The pieces without a key of more than HOT segments, with those that have one parted until none
    has; and (part, segment, at) of each round: the segments that hold a part, and where."""
    told = ("key", "segment", "windows", "n", "bytes")
    pieces = stored(
        spark,
        pieces.select(
            "*",
            F.lit(None).cast("int").alias("place"),
            F.lit(0).alias("low"),
            F.lit(LENGTH - KEY).alias("high"),
        ),
        "pieces",
    )
    cold, hot, rounds = pieces.where("NOT hot").select(*told), pieces.where("hot"), []
    while hot.head(1):
        parts = stored(spark, halves(hot.select("segment", "windows", "n", "place", "low", "high", "bytes")), "parts")
        counts = parts.groupBy("key", "part").agg(F.sum("n").alias("n"))
        size = counts.groupBy("key").agg(F.count("*").alias("of_key"), F.sum("n").alias("total"))
        kept = counts.join(size.where("total > 1"), "key").select(
            "key", "part", "n", (F.col("of_key") > HOT).alias("hot")
        )
        one = parts.drop("segment", "at", "n").dropDuplicates(["key", "part"])
        pieces = stored(spark, one.join(kept, ["key", "part"]).withColumnRenamed("part", "segment"), "pieces")
        own = parts.select("part", "segment", "at")
        if rounds:
            held = rounds[-1].select(F.col("part").alias("of"), F.col("segment").alias("whole"), F.col("at").alias("from"))
            own = own.join(held, own["segment"] == held["of"]).select(
                "part", F.col("whole").alias("segment"), (F.col("from") + F.col("at")).alias("at")
            )
        rounds.append(stored(spark, own.distinct(), "places"))
        cold, hot = cold.unionByName(pieces.where("NOT hot").select(*told)), pieces.where("hot")
    return cold, rounds


def _named(texts: DataFrame, hashes: DataFrame, how: str) -> DataFrame:
    """The texts whose hash is among the distinct ones, or (left_anti) the others: before texts
    are shuffled, by a broadcast of hashes as far as its counted size is bounded."""
    small = hashes.count() * 16 <= BROADCAST_BYTES
    return texts.join(F.broadcast(hashes) if small else hashes, "text_hash", how)


def _spread(many: DataFrame, one: DataFrame, on: str, often: DataFrame) -> DataFrame:
    """many.join(one, on), with the rows of a value that has more than SPREAD of them dealt to
    several tasks, each with its own copy of the row of ``one``.

    often: (on, n), how many rows of ``many`` have a value. Values of more than SPREAD rows are at
    most one for SPREAD rows, so they are broadcast.
    """
    tasks = F.ceil(F.col("n") / SPREAD).cast("int").alias("tasks")
    wide = F.broadcast(often.where(F.col("n") > SPREAD).select(on, tasks))
    tasks = F.coalesce("tasks", F.lit(1))
    dealt = many.join(wide, on, "left").withColumn("task", F.pmod(F.xxhash64("doc_id", "first"), tasks).cast("int"))
    copied = one.join(wide, on, "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt.drop("tasks").join(copied.drop("tasks").hint("merge"), [on, "task"]).drop("task")


def removed_spans(texts: DataFrame) -> DataFrame:
    """(text_hash, spans): sorted stretches of bytes to remove, of texts that have any.

    texts: (doc_id, text_hash, bytes).
    """
    spark = texts.sparkSession
    rows = stored(spark, segment_rows(texts), "segments")
    keys = stored(
        spark,
        rows.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("segment").alias("a"), F.max("segment").alias("b"))
        .where("n > 1")
        .select("key", "n", (F.col("a") != F.col("b")).alias("differ")),
        "keys",
    )
    again = stored(spark, _spread(rows, keys.drop("n"), "key", keys), "again")

    whole = again.where("NOT differ").select(
        "text_hash", F.array(F.struct(F.lit(0).alias("at"), F.col("windows").alias("n"))).alias("spans"), "first"
    )
    mixed_ = again.where("differ")
    one = F.struct("doc_id", "text_hash", "first", "windows")
    distinct = stored(
        spark,
        mixed_.groupBy("key", "segment").agg(F.count("*").alias("n"), F.min(one).alias("one")),
        "distinct",
    )
    size = distinct.groupBy("key").agg(F.count("*").alias("of_key"))
    wanted = (
        distinct.join(size, "key")
        .select(
            "one.doc_id",
            "one.text_hash",
            F.struct(
                "key",
                (F.col("of_key") > HOT).alias("hot"),
                "segment",
                F.col("one.first").alias("first"),
                F.col("one.windows").alias("windows"),
                "n",
            ).alias("s"),
        )
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("s").alias("wanted"))
    )
    wanted = stored(spark, wanted, "wanted")
    own = _named(texts, wanted.select("text_hash").distinct(), "left_semi").alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (
        F.col("t.text_hash") == F.col("f.text_hash")
    )
    pieces = (
        own.join(wanted.hint("merge").alias("f"), same)
        .select("t.bytes", F.explode("f.wanted").alias("s"))
        .select(
            "s.key",
            "s.hot",
            "s.segment",
            "s.windows",
            "s.n",
            F.substring("bytes", F.col("s.first") + 1, F.col("s.windows") + (LENGTH - 1)).alias("bytes"),
        )
        .dropDuplicates(["key", "segment"])
    )
    rounds = []
    if size.where(F.col("of_key") > HOT).head(1):
        pieces, rounds = _parted(spark, pieces)
    pieces = pieces.drop("hot").repartition("key").sortWithinPartitions("key")
    found = stored(spark, shard_runs(pieces), "runs")
    if rounds:
        places = reduce(DataFrame.unionByName, rounds).where("part != segment").distinct()
        moved = F.transform("spans", lambda s: s.withField("at", s["at"] + F.col("at")))
        of_parts = found.withColumnRenamed("segment", "part").join(places, "part")
        found = (
            found.union(of_parts.select("segment", moved.alias("spans")))
            .groupBy("segment")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"))
        )
    parts = _spread(mixed_, found, "segment", distinct).select("text_hash", "spans", "first")
    stretch = F.explode(
        F.transform(
            "spans",
            lambda s: F.struct(
                (F.col("first") + s["at"]).alias("start"),
                (F.col("first") + s["at"] + s["n"] + (LENGTH - 1)).alias("end"),
            ),
        )
    ).alias("s")
    return (
        whole.unionByName(parts)
        .select("text_hash", stretch)
        .groupBy("text_hash")
        .agg(F.sort_array(F.collect_set("s")).alias("spans"))
    )


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of data without the sorted spans, and the number of maximal runs removed."""
    kept, at, runs, end = [], 0, 0, -1
    for s in spans or []:
        if s["start"] > end:
            runs += 1
            kept.append(data[max(at, 0) : s["start"]])
        end = max(end, s["end"])
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("bytes")
    )


@F.arrow_udf(
    T.StructType()
    .add("n_removed", T.LongType())
    .add("n_spans", T.LongType())
    .add("kept_sha256", T.StringType())
)
def _digest(data: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for b, s in zip(data.to_pylist(), spans.to_pylist(), strict=True):
        kept, runs = cut(b, s)
        rows.append(
            {"n_removed": len(b) - len(kept), "n_spans": runs, "kept_sha256": sha256(kept).hexdigest()}
        )
    return pa.array(
        rows,
        pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]),
    )


@F.arrow_udf(T.StringType())
def _cut_text(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array(
        [
            # A removed string can start or end inside a character: its other bytes go as well.
            t if not s else cut(t.encode(), s)[0].decode("utf-8", "ignore")
            for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)
        ],
        pa.string(),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings cut out of ``text``."""
    spans = stored(docs.sparkSession, removed_spans(_texts(docs)), "spans")
    hashes = spans.select("text_hash")
    name = free_name([*docs.columns, "text_hash", "spans"], "whole")
    hashed = docs.select(
        F.struct(*docs.columns).alias(name), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    cut_ = _named(hashed, hashes, "left_semi").join(spans.hint("merge"), "text_hash")
    text = _cut_text(F.col(f"{name}.text"), F.col("spans"))
    return (
        cut_.withColumn("text", F.when(F.col(f"{name}.text").isNotNull(), text))
        .select(*[F.col(c) if c == "text" else F.col(f"{name}.{c}") for c in docs.columns])
        .unionByName(_named(hashed, hashes, "left_anti").select(f"{name}.*"))
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    texts = _texts(docs)
    spans = stored(docs.sparkSession, removed_spans(texts), "spans")
    hashes = spans.select("text_hash")
    cut_ = _named(texts, hashes, "left_semi").join(spans.hint("merge"), "text_hash")
    n_bytes = F.octet_length("bytes").cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    return (
        cut_.select("doc_id", n_bytes, _digest("bytes", "spans").alias("d"))
        .select("doc_id", "n_bytes", "d.*")
        .unionByName(
            _named(texts, hashes, "left_anti").select(
                "doc_id",
                n_bytes,
                zero.alias("n_removed"),
                zero.alias("n_spans"),
                F.sha2("bytes", 256).alias("kept_sha256"),
            )
        )
    )
