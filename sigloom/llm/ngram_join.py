"""Set-similarity self-join of documents on word n-grams, with PartEnum signatures.

A document's set are its distinct word shingles, as 64-bit hashes. Sizes fall into bands such
that similar sets lie in one band or in neighbouring ones, so each set takes part in its own band
and in the next. For a band whose largest set has r members, similar sets differ in at most
k = 2r(1 - t)/(1 + t) members. The hash domain is parted into n parts, more than k/2, so some parts
hold one difference of similar sets or none. Each part is parted again into three, and each pair of
these gives a signature: of the three pairs of such a part, one is equal in both sets. Sets A and B
differ in at most (|A| + |B|)(1 - t)/(1 + t) members, so n - (|A| + |B|)(1 - t)/(2 + 2t) such parts
there are at least. Each set leaves out half of what its own size leaves of n - 1: its thinnest signatures,
which stand for few shingles or none and would collide by chance. One equal signature at least
remains that both sets keep.

Links are found without listing the pairs of a signature. Documents with equal sets are one
class. In LEADS rounds each class is compared with one other: a centre, drawn anew each round, of
the largest signature on which it meets another component. Verified links form components, and
signatures on which one component is left are done, which settles large groups of near copies.
Then the least class of each signature is compared with the others; sizes and sketches rule
pairs out, and exact intersections of the sets decide the rest.
The least class then leaves its signature, and where different components still meet on it, the
next least class is compared with those of other components, and so on; only what is left after
STARS rounds is compared pair by pair, where sizes and parities of the sets allow; of the signatures
that a pair shares, it is listed on the least, if that is among the FIRST least of both. Pairs inside
a component cannot change it.

Defined results: null or empty text, or text without words, has an empty set and is linked with
nothing; texts with fewer words than a shingle have one shingle, all their words; equal texts are
linked; rows that share an id are judged each by its text; rows with a null id are linked only
through other rows, and a class of such rows alone has a null component; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import discard, stored
from sigloom.llm.components import components
from sigloom.llm.hashing import between, mixed, prefixes

BROADCAST_IDS = 200_000  # 1.6 MB; the driver holds several times that for each broadcast
SKETCH = 128  # bytes: members of a set by 128 parts of the hash domain, up to 254 each
SPARE = 0.05  # parts to spare for signatures left out, in differing members of a band
SLICE = 200_000  # signature rows of an Arrow batch
SETS = 500  # sets of an Arrow batch
PARITY = 8  # words of 64 bits: whether a part of the hash domain has an odd number of members
LEADS = 2  # rounds in which each class is compared with one centre
STARS = 3  # centres of a signature that are compared before what is left is listed in pairs
FIRST = 32  # least signatures of a class by which a pair is listed once, not on each that it shares


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(size, len(words))
    sums = prefixes(np.frombuffer(joined, np.uint8))
    return np.unique(between(sums, starts[: len(words) - n + 1], ends[n - 1 :]))


def set_id(members: np.ndarray) -> int:
    """One number for a set: equal for equal sets."""
    total = mixed(members + np.uint64(len(members))).sum(dtype=np.uint64)
    return int(mixed(np.array([total]))[0].astype(np.int64))


class Bands:
    """Sizes in bands, and the parts of each band, for a similarity of percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [0]

    @cache  # noqa: B019  one object for each task
    def of(self, size: int) -> tuple[tuple[int, int, int], ...]:
        """(band, parts, signatures left out) of the two bands of a set of this size."""
        while self.tops[-1] < size or len(self.tops) < 3:
            self.tops.append(100 * (self.tops[-1] + 1) // self.percent)
        band = int(np.searchsorted(self.tops, size))
        if band + 1 >= len(self.tops):
            self.tops.append(100 * (self.tops[-1] + 1) // self.percent)
        found = []
        for b in (band, band + 1):
            k = 2 * self.tops[b] * (100 - self.percent) // (100 + self.percent)
            if k:  # with k = 0, only equal sets are similar, and they are one class
                parts = k // 2 + 1 + 2 * round(SPARE * k)
                # Two similar sets differ in (1 - t)/(1 + t) of their sizes together at most. Half
                # of what is then spared is left out by each, by its own size; nothing, if that is
                # less than nothing, as k is rounded down.
                spared = (parts - 1) * (100 + self.percent) - (100 - self.percent) * size
                found.append((b, parts, max(0, spared // (2 * (100 + self.percent)))))
        return tuple(found)


def signatures(members: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a set in both of its bands."""
    out = []
    high = mixed(members ^ np.uint64(0x5851F42D4C957F2D))
    pieces = [((high >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.float64) for s in (0, 21, 42)]
    top = high >> np.uint64(32)
    for band, parts, thin in bands.of(len(members)):
        third = ((top * np.uint64(3 * parts)) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(third, minlength=3 * parts)
        # Sums of 21-bit pieces are exact in doubles.
        code = np.full(3 * parts, band, np.uint64)
        for piece in (*[np.bincount(third, p, 3 * parts) for p in pieces], counts, np.arange(3 * parts)):
            code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64))
        code, counts = code.reshape(parts, 3), counts.reshape(parts, 3)
        following = np.roll(code, -1, axis=1)
        pairs = mixed(code * np.uint64(0xD6E8FEB86659FD93) + following).ravel()
        if thin:
            held = (counts + np.roll(counts, -1, axis=1)).ravel()
            pairs = pairs[np.argsort(held, kind="stable")[thin:]]
        out.append(pairs)
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def classes(docs: DataFrame, size: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, n_shingles, class, sketch, parity): class is the number of the document's
    set; it, the sketch and the parity are null if the set is empty."""
    names = ("n_shingles", "class", "sketch", "parity")
    kind = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))))
    returned = T.StructType()
    for name, t in zip(names, (T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.LongType()))):
        returned = returned.add(name, t)

    @F.arrow_udf(returned)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch:
                own = shingles(text.as_py(), size)
                some = (set_id(own), sketch(own), parity(own)) if len(own) else (None,) * 3
                out.append(dict(zip(names, (len(own), *some))))
            yield pa.array(out, kind)

    found = docs.select("doc_id", *also, measured(F.col("text")).alias("m"))
    return found.select("doc_id", *also, "m.*")


def signature_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(signature, class): a task names a class once, however many copies it reads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held, n = Bands(percent), set(), [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([s for s, _ in held])),
                    pa.array(np.concatenate([np.full(len(s), c) for s, c in held])),
                ],
                names=["signature", "class"],
            )

        for batch in batches:
            for text in batch.column(0):
                members = shingles(text.as_py(), size)
                if not len(members) or (own := set_id(members)) in seen:
                    continue
                seen.add(own)
                held.append((signatures(members, bands), own))
                n += len(held[-1][0])
                if n >= SLICE:
                    yield flushed()
                    held, n = [], 0
        if n:
            yield flushed()

    return docs.select("text").mapInArrow(rows, "signature long, class long")


def sets_of(docs: DataFrame, members: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, members) of the wanted classes, from the text of one document of each."""
    ids = (
        members.where(F.col("doc_id").isNotNull())
        .join(wanted, "class", "left_semi")
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc_id"))
        .select("doc_id")
        .distinct()
    )
    ids = stored(docs.sparkSession, ids, "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SETS):
                found = [shingles(t.as_py(), size) for t in batch.column(0)[at : at + SETS]]
                found = [s for s in found if len(s)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate([np.empty(0, np.uint64), *found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_id(s) for s in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    ],
                    names=["class", "members"],
                )

    return (
        docs.select("doc_id", "text")
        .join(ids, "doc_id", "left_semi")
        .select("text")
        .mapInArrow(held, "class long, members array<long>")
        .join(wanted, "class", "left_semi")
        .dropDuplicates(["class"])
    )


def sketch(members: np.ndarray) -> bytes:
    """Members in each part of the hash domain; 255 stands for 255 or more."""
    part = (mixed(members ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(57)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def parity(members: np.ndarray) -> list[int]:
    """PARITY words: whether each part of the hash domain holds an odd number of members."""
    bits = np.uint64(64 - (64 * PARITY - 1).bit_length())
    part = (mixed(members ^ np.uint64(0x9FB21C651E98DF25)) >> bits).astype(np.int64)
    odd = (np.bincount(part, minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _not_far(a: str, b: str, percent: int) -> Column:
    """Whether sets of columns n and parity can be similar: each part whose parity differs holds
    a member of one set only, and similar sets have few of them."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    far = sum(
        (
            F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i]))
            for i in range(PARITY)
        ),
        F.lit(0),
    )
    near = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return near & (far * (100 + percent) <= (n + m) * (100 - percent))


def _at_most(percent: int):
    """Whether two sets, of which the sketches and sizes are given, can be similar at all: they
    share no more than the smaller count of each part."""

    @F.arrow_udf(T.BooleanType())
    def can(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        a, b = (
            np.frombuffer(b"".join(z.to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int64)
            for z in (x, y)
        )
        full = 1 << 40  # a part that is full in both sets bounds nothing
        both = np.minimum(np.where(a == 255, full, a), np.where(b == 255, full, b)).sum(axis=1)
        sizes = n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False)
        return pa.array(100 * both >= percent * (sizes - both))

    return can


def possible(pairs: DataFrame, forms: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out: no set is read yet.

    The sketches are shuffled to the pairs: broadcast, they would pass through the driver, where a
    table of them took more memory than all else, twice in each round.
    """
    left, right = (
        forms.select(
            F.col("class").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}")
        )
        for c in ("a", "b")
    )
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(near)
    return joined.where(_at_most(percent)("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


class Verifier:
    """Exact tests of pairs of classes; reads the sets of those that sketches leave."""

    def __init__(self, docs: DataFrame, members: DataFrame, forms: DataFrame, size: int, percent: int):
        self.docs, self.members, self.forms = docs, members, forms
        self.size, self.percent = size, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar, stored."""
        spark = self.docs.sparkSession
        kept = stored(spark, possible(pairs, self.forms, self.percent), "pairs")
        ends = F.explode(F.array("a", "b")).alias("class")
        wanted = stored(spark, kept.select(ends).distinct(), "wanted")
        sets = stored(spark, sets_of(self.docs, self.members, wanted, self.size), "sets")
        left = sets.select(F.col("class").alias("a"), F.col("members").alias("left"))
        right = sets.select(F.col("class").alias("b"), F.col("members").alias("right"))
        similar = _similar(F.col("left"), F.col("right"), self.percent)
        found = kept.join(right, "b").join(left, "a").where(similar).select("a", "b")
        found = stored(spark, found, "links")
        for done in (kept, wanted, sets):
            discard(done)
        return found


def _rerooted(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows with their roots replaced where (node, root) of moves says so."""
    to = moves.select(F.col("node").alias("root"), F.col("root").alias("to"))
    others = [c for c in rows.columns if c != "root"]
    return rows.join(to, "root", "left").select(*others, F.coalesce("to", "root").alias("root"))


def _still_meeting(rows: DataFrame) -> DataFrame:
    """The rows (signature, class, root) of signatures on which different components meet."""
    meet = rows.groupBy("signature").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    return rows.join(meet.where("x < y").select("signature"), "signature", "left_semi")


def _outer(rows: DataFrame) -> DataFrame:
    """The rows of signatures that are not contained in another one: all pairs of a signature are
    pairs of the larger signature that holds all of its classes.

    Each class names its largest signature (ties: the greatest number). If the classes of a
    signature all name the same other one, they all lie in that one.
    """
    sizes = rows.groupBy("signature").agg(F.count("*").alias("m"))
    largest = (
        rows.select("signature", "class")
        .join(sizes, "signature")
        .groupBy("class")
        .agg(F.max(F.struct("m", "signature"))["signature"].alias("largest"))
    )
    held = (
        rows.select("signature", "class")
        .join(largest, "class")
        .groupBy("signature")
        .agg(F.min("largest").alias("x"), F.max("largest").alias("y"))
    )
    outer = held.where((F.col("x") != F.col("y")) | (F.col("x") == F.col("signature")))
    return rows.join(outer.select("signature"), "signature", "left_semi")


def _left_pairs(rows: DataFrame, forms: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes of different components that meet on a signature of the rows
    (signature, class, root) and can be similar by sizes and parities.

    A pair that shares some of the FIRST least signatures of both is listed on the least of those
    only; another one is listed on each signature that it shares.
    """
    firsts = rows.groupBy("class").agg(
        F.slice(F.sort_array(F.collect_list("signature")), 1, FIRST).alias("firsts")
    )
    marked = rows.join(forms.select("class", "n", "parity"), "class").join(firsts, "class")
    a, b = marked.alias("a"), marked.alias("b")
    apart = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.root") < F.col("b.root"))
    least = F.array_min(F.array_intersect("a.firsts", "b.firsts"))
    here = F.coalesce(least == F.col("a.signature"), F.lit(True))
    return a.join(b, apart & _not_far("a", "b", percent) & here).select(
        F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b")
    )


def linked(
    docs: DataFrame, size: int = 4, percent: int = 85, also: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the columns ``also`` of docs, n_shingles, class and component_id (the least doc_id
    reachable by links)."""
    spark = docs.sparkSession
    sketched = stored(spark, classes(docs, size, also), "classes")
    members = sketched.drop("sketch", "parity")
    named = members.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
    forms = (
        sketched.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.max("n_shingles").alias("n"),
            F.max("sketch").alias("sketch"),
            F.max("parity").alias("parity"),
        )
    )
    forms = stored(spark, forms, "forms")
    verifier = Verifier(docs, members, forms, size, percent)

    group = Window.partitionBy("signature")
    shared = (
        signature_rows(docs, size, percent)
        .withColumn("least", F.min("class").over(group))
        .withColumn("most", F.max("class").over(group))
        .where(F.col("least") < F.col("most"))
        .select("signature", "class")
        .join(forms.select("class"), "class", "left_semi")
        .distinct()
        .select("signature", "class", F.col("class").alias("root"))
    )
    whole = stored(spark, shared, "shared")
    open_ = stored(spark, _outer(whole), "open")
    discard(whole)
    roots = forms.select("class", F.col("class").alias("root"))

    # Leads: each class is compared with one centre of another component. Stars: in each signature
    # the least class is compared with those of other components, and leaves. What still meets on a
    # signature goes on with the next least class.
    for turn in range(LEADS + STARS + 1):
        if not open_.head(1):
            break
        if turn < LEADS:
            drawn = F.struct(F.xxhash64("class", F.lit(turn)).alias("draw"), "class", "root")
            centres = open_.groupBy("signature").agg(
                F.min(drawn).alias("centre"), F.count("*").alias("m")
            )
            choice = F.struct("m", "signature", F.col("centre.class").alias("centre"))
            pairs = (
                open_.join(centres, "signature")
                .where(F.col("root") != F.col("centre.root"))
                .groupBy("class")
                .agg(F.max(choice).alias("choice"))
                .select(
                    F.least("class", "choice.centre").alias("a"),
                    F.greatest("class", "choice.centre").alias("b"),
                )
            )
            rest = open_
        elif turn < LEADS + STARS:
            centres = open_.groupBy("signature").agg(F.min(F.struct("class", "root")).alias("centre"))
            with_centre = open_.join(centres, "signature")
            pairs = with_centre.where(F.col("root") != F.col("centre.root")).select(
                F.col("centre.class").alias("a"), F.col("class").alias("b")
            )
            rest = with_centre.where(F.col("class") != F.col("centre.class")).select(*open_.columns)
        else:  # few signatures are left: all pairs of their components that can be similar
            pairs = _left_pairs(open_, forms, percent)
            rest = None
        links = verifier.links(pairs.distinct())
        found = bool(links.head(1))
        if found:
            ends = [roots.select(F.col("class").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
            edges = links.join(ends[0], "a").join(ends[1], "b")
            moves = components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
            roots = stored(spark, _rerooted(roots, moves), "roots")
        if rest is None:
            break
        if found:
            rest = _rerooted(rest, moves)
        before, meeting = open_, stored(spark, _still_meeting(rest), "meeting")
        open_ = stored(spark, _outer(meeting), "open")
        discard(before)
        discard(meeting)

    lows = named.groupBy("class").agg(F.min("doc_id").alias("low"))
    of_class = lows.join(roots, "class")
    low = of_class.groupBy("root").agg(F.min("low").alias("component_id"))
    final = of_class.join(low, "root").select(F.col("class").alias("c"), "component_id")
    return members.join(final, F.col("class") == F.col("c"), "left").select(
        "doc_id",
        *also,
        "n_shingles",
        "class",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are linked, directly or not, with a document of a smaller id.

    Rows that share an id are judged each by its text (its 64-bit hash): of rows with one id and
    one text, all stay or none; a row with a null id stays.
    """
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    extra = stored(
        docs.sparkSession,
        linked(own, size, percent, ("text_hash",))
        .where(F.col("component_id") < F.col("doc_id"))
        .select("doc_id", "text_hash")
        .distinct(),
        "extra",
    )
    if extra.count() <= BROADCAST_IDS // 2:  # two numbers a row
        extra = F.broadcast(extra)
    d, e = docs.alias("d"), extra.alias("e")
    same = (F.col("d.doc_id") == F.col("e.doc_id")) & (F.xxhash64("d.text") == F.col("e.text_hash"))
    return d.join(e, same, "left_anti").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    found = linked(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
