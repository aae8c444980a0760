"""Hard negatives: for each anchor and each of its positives, the best rows of other labels whose
score lies in a window under the positive's score. Scores are integer inner products.

Anchors are dealt to trees of some hundred. A tree is a least spanning tree of its anchors and the
origin, made in a task. The score of a candidate c at an anchor differs from that at its parent by
|c| times the length of the edge at most; at the origin it is 0. So a candidate walks down the
tree with a lower and an upper bound for each anchor, and is scored again only where the bounds
overlap a window that it could still enter; there they become exact, and tighter for all below.

Every row is a candidate for every anchor (a stated query set against all rows). The trees of a
pass, a bounded number of anchors, go to all tasks, which stream their candidates and keep the
best of each window. Candidates come in slices by a hash of their id, each some 16 times the one
before: what the smaller slices found is the floor of the windows in the next, which makes bounds
decide more and keeps the rows that tasks return in proportion to the anchors.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; rows that repeat in id, label and vector count once, other rows that share
an id are each a row, but none is compared with an anchor of its own id; vectors are compared with
those of their length only; ties in score go to the smaller id; an anchor without a positive, or a
positive without a row in its window, gives no row; an empty table gives an empty table; other
columns are not read. A component of 65,536 or more in size is an error, since scores would leave
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import stored

TREE = 512  # anchors of a tree
PASS = 32  # trees that go to all tasks at once: 8 MB at 64 components
FIRST = 5_000  # candidates of the first slice, about
GROWTH = 16  # candidates of a slice, in those of all slices before it
STRIP = 4_096  # candidates that walk down a tree together
MOST = 1 << 24  # size of a component

LOWEST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "tree long, dim int, at int, window int, score long, vec_id long"
SLOT = ("tree", "dim", "at", "window")


def rows_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: labels and components as compared."""
    x = F.col("embedding")
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    )
    label = F.col("label").cast("long")
    large = F.raise_error(F.lit("a component is too large for exact scores"))

    def scaled(v):
        y = F.lit(256.0) * v.cast("double")
        return F.when(F.abs(y) >= MOST, large).otherwise(F.floor(y)).cast("int")

    return (
        embeddings.where(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & finite)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            F.transform(x, scaled).alias("vector"),
        )
        .dropDuplicates(["vec_id", "label", "vector"])
    )


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): vectors in the order in which the least spanning tree takes them up
    from the origin, the place of each one's parent in that order (-1: the origin), and lengths."""
    x = vectors.astype(np.float64)
    n = len(x)
    near = np.sqrt((x * x).sum(axis=1))
    parent = np.full(n, -1)
    order, parents, edges = [], [], []
    left = np.ones(n, bool)
    for k in range(n):
        i = int(np.argmin(np.where(left, near, np.inf)))
        left[i] = False
        order.append(i)
        parents.append(parent[i])
        edges.append(near[i])
        apart = x - x[i]
        apart = np.sqrt((apart * apart).sum(axis=1))
        closer = left & (apart < near)
        near[closer], parent[closer] = apart[closer], k
    return np.array(order, int), np.array(parents, int), np.array(edges, float)


def trees_of(anchors: DataFrame, trees: int) -> DataFrame:
    """A row for each tree and vector length: ids, labels and vectors in the order of the tree."""

    def grown(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group["vector"].to_numpy()).astype(np.int64).reshape(len(group), -1)
        order, parent, edge = spanning_tree(vectors)
        return pd.DataFrame(
            {
                "tree": [key[0]],
                "dim": [key[1]],
                "ids": [group["vec_id"].to_numpy()[order].tolist()],
                "labels": [group["label"].to_numpy()[order].tolist()],
                "vectors": [vectors[order].tobytes()],
                "parent": [parent.tolist()],
                "edge": [edge.tolist()],
            }
        )

    tree = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(trees))
    kind = (
        "tree long, dim int, ids array<long>, labels array<long>, vectors binary,"
        " parent array<int>, edge array<double>"
    )
    dealt = anchors.withColumn("tree", tree).withColumn("dim", F.size("vector"))
    return dealt.groupBy("tree", "dim").applyInPandas(grown, kind)


class Tree:
    """A tree and its windows, with the best rows of each window that a task has seen."""

    def __init__(self, row, windows: int, keep: int, same: bool):
        self.key = (row["tree"], row["dim"])
        self.ids, self.labels = np.array(row["ids"]), np.array(row["labels"])
        n = len(self.ids)
        self.whole = np.frombuffer(row["vectors"], np.int64).reshape(n, row["dim"])
        self.vectors = self.whole.astype(np.float64)
        self.most = int(np.abs(self.whole).max(initial=0))
        self.parent, self.edge = row["parent"], row["edge"]
        self.keep, self.same = keep, same
        # An empty window: nothing lies between its ends.
        self.low = np.full((n, windows), LAST)
        self.high = np.full((n, windows), LOWEST)
        # The floor: a row must come before this one.
        self.score, self.id = np.full((n, windows), LOWEST), np.full((n, windows), LAST)
        self.best: list[list] = [[None] * windows for _ in range(n)]

    def walk(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Lets candidates of the tree's length walk down it."""
        x = vectors.astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9) + 1e-9
        exact = vectors.shape[1] * self.most * int(np.abs(vectors).max(initial=0)) < 1 << 53
        n = len(self.ids)
        low, high = np.zeros((n + 1, len(ids))), np.zeros((n + 1, len(ids)))  # last: the origin
        for i in range(n):
            up, reach = self.parent[i], (self.edge[i] * (1 + 1e-9) + 1e-9) * norm
            reach += 1e-9 * (np.abs(low[up]) + np.abs(high[up]))  # beyond any rounding
            np.subtract(low[up], reach, out=low[i])
            np.add(high[up], reach, out=high[i])
            wanted = ((labels == self.labels[i]) == self.same) & (ids != self.ids[i])
            least = np.maximum(self.low[i], self.score[i])
            open_ = np.zeros(len(ids), bool)
            for a, b in zip(least.tolist(), self.high[i].tolist()):
                if a <= b:
                    open_ |= (high[i] >= a) & (low[i] <= b)
            at = np.flatnonzero(wanted & open_)
            if not len(at):
                continue
            if exact:
                found = (x @ self.vectors[i])[at] if 4 * len(at) > len(ids) else x[at] @ self.vectors[i]
                found = found.astype(np.int64)
            else:
                found = (vectors[at].astype(np.int64) * self.whole[i]).sum(axis=1)
            low[i, at] = high[i, at] = found
            for w in range(len(least)):
                if least[w] <= self.high[i, w]:
                    in_ = (found >= least[w]) & (found <= self.high[i, w])
                    if in_.any():
                        self.add(i, w, found[in_], ids[at[in_]])

    def add(self, i: int, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ahead = (scores > self.score[i, w]) | ((scores == self.score[i, w]) & (ids < self.id[i, w]))
        scores, ids = scores[ahead], ids[ahead]
        if self.best[i][w] is not None:
            scores = np.concatenate([self.best[i][w][0], scores])
            ids = np.concatenate([self.best[i][w][1], ids])
        order = np.lexsort((ids, -scores))[: self.keep]
        self.best[i][w] = scores[order], ids[order]
        if len(order) == self.keep:
            self.score[i, w], self.id[i, w] = scores[order[-1]], ids[order[-1]]

    def found(self) -> Iterator[pa.RecordBatch]:
        for i, windows in enumerate(self.best):
            for w, best in enumerate(windows):
                if best is not None and len(best[0]):
                    n = len(best[0])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, self.key[0])),
                            pa.array(np.full(n, self.key[1], np.int32)),
                            pa.array(np.full(n, i, np.int32)),
                            pa.array(np.full(n, w, np.int32)),
                            pa.array(best[0]),
                            pa.array(best[1]),
                        ],
                        names=["tree", "dim", "at", "window", "score", "vec_id"],
                    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=100_000)


def _walked(candidates: DataFrame, rows: list, limits: list, floors: list, keep: int, same: bool):
    """The best rows of each window among the candidates of each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {}
        for row in rows:
            trees[row["tree"], row["dim"]] = Tree(row, 1 + max(x[3] for x in limits), keep, same)
        for tree, dim, at, window, low, high in limits:
            trees[tree, dim].low[at, window] = low
            trees[tree, dim].high[at, window] = high
        for tree, dim, at, window, score, vec_id in floors:
            trees[tree, dim].score[at, window] = score
            trees[tree, dim].id[at, window] = vec_id
        for batch in batches:
            for start in range(0, len(batch), STRIP):
                part = batch.slice(start, STRIP)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                ends = np.cumsum(sizes)
                for dim in {d for _, d in trees}:
                    at = np.flatnonzero(sizes == dim)
                    if not len(at):
                        continue
                    own = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                    for (_, d), tree in trees.items():
                        if d == dim:
                            tree.walk(ids[at], labels[at], own)
        for tree in trees.values():
            yield from _merged(tree.found())

    return candidates.select("vec_id", "label", "vector").mapInArrow(search, FOUND)


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first `keep` rows of each window, with their place from 1."""
    order = Window.partitionBy(*SLOT).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def slices(candidates: DataFrame, n: int) -> list[DataFrame]:
    """The candidates in slices by a hash of their id, the first of FIRST rows at most or about."""
    parts = 1
    while n / parts > FIRST:
        parts *= GROWTH
    place = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    out = [candidates.where(place == 0).repartition(2)]
    while parts > 1:
        parts //= GROWTH
        out.append(candidates.where((place % parts == 0) & (place % (parts * GROWTH) != 0)))
    return out


def _searched(candidates: DataFrame, n: int, rows: list, limits: list, keep: int, same: bool):
    """The best rows of each window (tree, dim, at, window, low, high) among all candidates."""
    spark, floors, before = candidates.sparkSession, [], None
    for part in slices(candidates, n):
        found = _walked(part, rows, limits, floors, keep, same)
        if before is not None:
            found = found.unionByName(before.drop("rank"))
        before = stored(spark, _best(found, keep), "best")
        last = before.where(F.col("rank") == keep).select(*SLOT, "score", "vec_id")
        floors = [tuple(r) for r in last.collect()]  # one row for each window of the pass
    return before


def mined(
    embeddings: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 3,
    high: int = 9,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; a window goes from ``low`` to
    ``high`` tenths of the positive's score.
    """
    spark = embeddings.sparkSession
    rows = stored(spark, rows_of(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, n_anchors = rows.count(), anchors.count()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = spark.createDataFrame([], kind)
    n_trees = -(-n_anchors // TREE)
    if not n_trees:
        return result
    trees = stored(spark, trees_of(anchors, n_trees), "trees")
    for start in range(0, n_trees, PASS):
        own = trees.where((F.col("tree") >= start) & (F.col("tree") < start + PASS))
        held = [r.asDict() for r in own.collect()]  # PASS trees
        whole = [(r["tree"], r["dim"], at, 0, LOWEST, LAST) for r in held for at in range(len(r["ids"]))]
        if not whole:
            continue
        nearest = _searched(rows, n, held, whole, positives, True)
        limits = [
            (r.tree, r.dim, r.at, r.rank - 1, -(-low * r.score // 10), high * r.score // 10)
            for r in nearest.collect()  # `positives` for each anchor of the pass
        ]
        if not limits:
            continue
        found = _searched(rows, n, held, limits, negatives, False)
        ids = own.select("tree", "dim", F.posexplode("ids").alias("at", "anchor_id"))
        pairs = nearest.select(
            "tree",
            "dim",
            "at",
            (F.col("rank") - 1).alias("window"),
            F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        result = result.unionByName(
            found.join(pairs, [*SLOT])
            .join(ids, ["tree", "dim", "at"])
            .select(
                "anchor_id",
                "positive_id",
                F.col("rank").cast("int").alias("rank"),
                F.col("vec_id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
    return result


def report(embeddings: DataFrame) -> DataFrame:
    return mined(embeddings)
