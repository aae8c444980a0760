"""Sharding, hard negatives and periodic runs against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import hard_negatives, periodic_runs, sharding
from sigloom.llm.sharding import Shard
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string"


# Sharding

TREE = (
    Shard(0, 0, 0), Shard(0, 0, 1, 2.0), Shard(0, 1, 2), Shard(1, 0, 3, 0.5), Shard(1, 0, 4),
    Shard(1, 1, 5, 3.0), Shard(2, 0, 6, 0.0), Shard(2, 0, 7),
)


def placed(spark, tree, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    return {r.doc_id: r.shard for r in sharding.with_shard(rows, tree).collect()}


def test_shards_equal_plain_descent(spark):
    keys = [None, *range(-5, 600)]
    found = placed(spark, TREE, keys)
    assert found == {k: brute.shard(k, TREE) for k in keys}
    assert 6 not in found.values()


def test_rows_move_only_where_weights_change(spark):
    keys = range(3000)
    before = placed(spark, TREE, keys)
    heavier = tuple(s._replace(weight=9.0) if s.shard == 4 else s for s in TREE)
    region, rack = {s.shard: s.region for s in TREE}, {s.shard: s[:2] for s in TREE}
    moved = [(before[k], b) for k, b in placed(spark, heavier, keys).items() if before[k] != b]
    assert moved
    for a, b in moved:
        # Into the region that grew, into its rack that grew, or into the shard itself.
        assert region[a] != region[b] == 1 or rack[a] != rack[b] == (1, 0) or b == 4
    for n in (1, 5, 24, 25):
        tree = sharding.even_tree(n)
        more = sharding.with_one_more(sharding.with_one_more(tree))
        first, second = placed(spark, tree, keys), placed(spark, more[:-1], keys)
        assert {b for k, b in second.items() if first[k] != b} == {n}
        third = placed(spark, more, keys)
        assert {b for k, b in third.items() if second[k] != b} == {n + 1}


def test_shards_follow_weights(spark):
    share = Counter(placed(spark, TREE, range(20000)).values())
    total = sum(s.weight for s in TREE)
    for s in TREE:
        assert abs(share[s.shard] / 20000 - s.weight / total) < 0.02


@pytest.mark.parametrize("limit", [100_000, 0])
def test_sharding_report(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "BROADCAST_OFFSETS", limit)
    texts = [None, "", "é", "word " * 5000, "same", "same", "same"] * 40
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts)]
    rows += [(7, "same")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.report(docs.withColumn("slot", F.lit(1))).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        assert r.shard == brute.shard(r.doc_id, sharding.even_tree(24))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    data = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
        (i, len(b) + 8, zlib.crc32(b)) for i, b in data
    )
    assert sharding.report(docs.limit(0)).count() == 0
    numbered = sharding.with_slot(sharding.with_shard(docs.withColumn("slot", F.lit("x")), TREE))
    assert numbered.columns == ["doc_id", "text", "slot", "shard", "slot_"]


def test_shards_are_folders(spark, tmp_path):
    docs = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("own"))
    sharding.write_shards(docs, f"file://{tmp_path}/out", TREE)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {r.doc_id: r.shard_ for r in back.collect()} == placed(spark, TREE, range(200))


@pytest.mark.parametrize("tree", [(), (Shard(0, 0, 1), Shard(0, 1, 1)), (Shard(0, 0, 1, -1.0),)])
def test_bad_trees(tree):
    with pytest.raises(ValueError):
        sharding._checked(tree)


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, dim=6, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        center = i % 5
        v = [rng.gauss(1.0 if j == center else 0.2, 0.3) for j in range(dim)]
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    rows += [rows[3]] * 30 + [(n + i, rows[17][1], i % 4) for i in range(60)]  # copies, ties
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[1][1], 1), (1000, None, 1), (1001, rows[1][1], None), (1100, [nan] * dim, 1)]
    rows += [(1200, [inf] * dim, 1), (1300, [0.5, None, 0.5, 0.1, 0.1, 0.1], 1), (1400, [], 2)]
    rows += [(1500, [1.0, 2.0], 1), (1501, [1.0, 2.5], 1), (1502, [0.5, 1.0], 2), (1600, [0.0] * dim, 3)]
    return [*rows, (200, [-x for x in rows[0][1]], 9), (300, rows[300][1], 3)]


@pytest.mark.parametrize("first, tree", [(5000, 512), (20, 3)])
def test_hard_negatives_equal_plain_version(spark, monkeypatch, first, tree):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    monkeypatch.setattr(hard_negatives, "PASS", 2 if tree == 3 else 32)
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("own")).repartition(4)
    every = 100 if first == 5000 else 40
    found = sorted(map(tuple, hard_negatives.mined(frame, every=every).collect()))
    expected = brute.hard_negatives(rows, every, 5, 10)
    assert found == expected and len(expected) > 50


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.report(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], VECTORS)
    assert hard_negatives.report(alone).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.report(spark.createDataFrame([(100, [1e30], 1)], VECTORS)).count()


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-60000, 60000) for _ in range(9)], i % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, hard_negatives.mined(frame, every=20).collect()))
    assert found == brute.hard_negatives(rows, 20, 5, 10)


def test_trees_span_and_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (40, 5))
    order, parent, edge = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[0] == -1
    own = x[order].astype(float)
    for i, (p, e) in enumerate(zip(parent, edge)):
        assert p < i and np.isclose(e, np.linalg.norm(own[i] - (own[p] if p >= 0 else 0)))


# Periodic runs


def texts(seed=9):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "a", "a " * 40, "a b " * 30, "x\x0by\x0cz " * 9, "é è " * 7, "a\xa0b " * 20]
    for _ in range(120):
        k, n = rng.choice([1, 2, 3, 30]), rng.randrange(1, 90)
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        if rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append(rng.choice([" ", "  ", "\n"]).join(w * rng.choice([1, 1, 3])))
    return out


def test_runs_of_all_short_words():
    for n in range(1, 13):
        for code in range(2**n):
            words = [code >> i & 1 for i in range(n)]
            found = [(a, b - a, q) for a, b, q in zip(*map(np.ndarray.tolist, periodic_runs.runs(np.array(words), 2)))]
            assert found == brute.periodic_runs(words, 2)


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    left, end, period = periodic_runs.runs(np.array(b), 2)
    assert list(zip(left, end - left, period)) == brute.periodic_runs(b, 2)


@pytest.mark.parametrize("block", [200_000, 1])
def test_report_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rows = [(i, t, None, "s") for i, t in enumerate(texts())]
    rows += [rows[6], rows[6], (None, "a b " * 20, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    expected = []
    for doc_id, text, *_ in rows:
        words = brute.planted_words(doc_id, text)
        found = brute.periodic_runs(words, 12)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        best = min(((-n, a, q) for a, n, q in found), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found).encode()
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        expected.append((doc_id, len(found), *longest, brute.sha(lines), brute.sha(left)))
    found = [tuple(r) for r in periodic_runs.report(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(e[1] > 0 for e in expected) > 30
    assert periodic_runs.report(docs.limit(0)).count() == 0


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "own", 2)], "doc_id long, text string, runs string, n int")
    row = periodic_runs.with_runs(docs).first()
    assert row.runs == "own" and row.n == 2 and row.collapsed == "a b"
    assert [tuple(r) for r in row.runs_] == [(0, 16, 2)]
