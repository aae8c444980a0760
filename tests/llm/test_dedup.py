"""Suffix-array dedup, n-gram join, decontamination and quality rules against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import components, decontaminate, ngram_join, quality_rules, suffix_array
from sigloom.llm import suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(seed=7):
    """Copies, near copies, shared passages, odd and empty texts, and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 260)) for _ in range(24)]
    passage = prose(rng, 120)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, k) for k in (10, 30, 50)]
    texts += [texts[0], texts[0], texts[1] + " more", texts[2].replace("w1 ", "w2 ", 1)]
    texts += [None, "", " ", "one", "two words", "one", "é" * 500, "é" * 700, "x" * 900, "\n" * 450]
    texts += [passage * 3, "ÄÖ " + passage + "\0end", "Ab cD ef gh ij", "ab cd EF gh ij"]
    texts += [prose(rng, 30) + "\n" + "SHOUT LOUD " * 60, "a b c d e f. " * 40]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


def test_suffix_arrays():
    rng = random.Random(3)
    for k in (1, 2, 3, 26):
        for n in (1, 2, 5, 60, 170):
            for small in (512, 0):
                data = [rng.randint(1, k) for _ in range(n)]
                data = (data[: n // 4 + 1] * 9)[:n] if n % 2 else data
                s = np.array([*data, 0], np.uint8)
                suffix_array.SMALL_ALPHABET = small
                sa = suffix_array.suffix_array(s)
                suffix_array.SMALL_ALPHABET = 512
                b = bytes(s)
                assert sa.tolist() == sorted(range(n + 1), key=lambda i: b[i:])
                shared = suffix_array.common_prefixes(s, sa)
                for x, y in zip(sa[:-1], sa[1:]):
                    lcp = next((i for i in range(n + 1) if b[x + i : x + i + 1] != b[y + i : y + i + 1]))
                    assert shared[y] == lcp


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_equal_plain_version(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = documents()
    plain = brute.repeated_bytes([r[1] for r in rows], 400)
    expected = sorted(
        (r[0], len((r[1] or "").encode()), gone, runs, brute.sha(kept))
        for r, (kept, gone, runs) in zip(rows, plain)
    )
    assert sorted(map(tuple, suffix_dedup.report(docs).collect())) == expected
    assert sum(e[2] > 0 for e in expected) > 8


def test_windows_around_a_common_passage_make_no_rows(spark, monkeypatch):
    rng = random.Random(11)
    passage = prose(rng, 60)[:240]
    texts = [prose(rng, 150) + " " + passage + " " + prose(rng, 150) for _ in range(60)]
    texts += [texts[0][90:], texts[1][:-80]]
    made = []

    def counted(pieces, runs=suffix_dedup.shard_runs):
        made.append(runs(pieces).count())
        return runs(pieces)

    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    monkeypatch.setattr(suffix_dedup, "shard_runs", counted)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.report(frame).collect()}
    plain = brute.repeated_bytes(texts, 400)
    assert all(
        (found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (gone, runs, brute.sha(kept))
        for i, (kept, gone, runs) in enumerate(plain)
    )
    assert found[0]["n_removed"] and made[0] < 40


def test_rows_of_a_very_common_segment_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPREAD", 2)
    many = spark.createDataFrame([(i, 0, 7 if i < 60 else i) for i in range(80)], "doc_id long, first int, segment long")
    one = spark.createDataFrame([(7, "a"), (61, "b"), (200, "c")], "segment long, spans string")
    often = many.groupBy("segment").count().withColumnRenamed("count", "n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = suffix_dedup._spread(many, one, "segment", often).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r["doc_id"], r["spans"]) for r in rows) == [*[(i, "a") for i in range(60)], (61, "b")]
    assert len({r["p"] for r in rows if r["segment"] == 7}) > 1
    texts = ["x" * 500 + "y" * i for i in range(9)] + ["q" * 450] * 9 + ["short", None]
    found = suffix_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ours = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in found.collect()}
    monkeypatch.setattr(suffix_dedup, "SPREAD", 10_000)
    found = suffix_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert ours == {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in found.collect()}


def test_repeats_are_cut_from_texts_and_columns_kept(spark):
    text = "é" * 200 + "-" + "x" * 10
    rows = [(1, text, 5, 9), (2, "b" + text, 6, 9), (None, None, 7, 9), (4, "short", 8, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int, shorter int")
    found = {r["spans"]: r for r in suffix_dedup.dedup(frame).collect()}
    assert suffix_dedup.dedup(frame).columns == frame.columns
    assert found[5]["text"] == "" and found[6]["text"] == "b"
    assert found[7]["text"] is None and found[8]["text"] == "short"


def test_links_equal_plain_version(docs):
    rows = documents()
    expected = sorted(
        (r[0], len(brute.shingle_set(r[1], 4)), c)
        for r, c in zip(rows, brute.component_ids([r[:2] for r in rows], 4, 85))
    )
    assert sorted(map(tuple, ngram_join.report(docs).collect())) == expected


@pytest.mark.parametrize("percent", [85, 80])
def test_similar_sets_share_a_signature(percent):
    """Every two sizes and numbers of shared members that just meet the threshold."""
    rng, bands = np.random.default_rng(percent), ngram_join.Bands(percent)
    members = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    for n in (*range(1, 90), 120, 150):
        for m in range(n, 100 * n // percent + 1):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared > n or shared == n == m:
                continue
            drawn = rng.permutation(members)[: n + m - shared]
            a, b = drawn[:n], np.concatenate([drawn[:shared], drawn[n:]])
            found = [ngram_join.signatures(np.sort(own), bands) for own in (a, b)]
            assert np.intersect1d(*found).size, (n, m)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    """Links that are not transitive, many sizes, and pairs that only share a signature."""
    rng = random.Random(seed)
    rows = []
    for size in (3, 7, 11, 25, 60, 130, 300):
        words = [f"v{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words = words[:]
            for _ in range(max(1, size // 60)):
                words[rng.randrange(size)] = f"v{rng.randrange(10_000)}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.report(frame).collect()}
    assert [found[i] for i, _ in rows] == brute.component_ids(rows, 4, 85)
    assert len(set(found.values())) < len(rows) - 10


def test_pairs_that_share_many_signatures_are_listed_once(spark):
    meets = [(s, c, c) for c in range(40) for s in (range(20) if c < 30 else range(c, c + 80))]
    rows = spark.createDataFrame(meets, "signature long, class long, root long")
    forms = spark.createDataFrame(
        [(c, 100, [0] * ngram_join.PARITY) for c in range(40)], "class long, n long, parity array<long>"
    )
    found = [tuple(r) for r in ngram_join._left_pairs(rows, forms, 85).collect()]
    plain = {(a, b) for s, a, _ in meets for t, b, _ in meets if s == t and a < b}
    assert set(found) == plain and len(found) == len(plain)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"q{i}" for i in range(200))
    rows = [(3, text, 1), (1, text + " z", 2), (2, "other words here", 3), (None, text, 4), (5, None, 5), (6, "", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class int")
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["class"] for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_other_text_under_a_linked_id_stays(spark):
    text = " ".join(f"q{i}" for i in range(200))
    rows = [(1, text, 1), (3, text + " z", 2), (3, "clean words of its own", 3), (3, text + " z", 4), (3, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["text_hash"] for r in kept.collect()) == [1, 3, 5]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert {found[n] for n in (1, 2, 3, 9)} == {1} and found[5] == found[6] == 5
    assert {found[n] for n in range(100, 141)} == {100}


def test_sketches_do_not_pass_through_the_driver(spark):
    sets = [np.arange(20, dtype=np.uint64), np.arange(1, 21, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    rows = [(i, len(s), bytearray(ngram_join.sketch(s))) for i, s in enumerate(sets)]
    forms = spark.createDataFrame(rows, "class long, n long, sketch binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    found = ngram_join.possible(pairs, forms, 85)
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stars_need_no_round(spark, monkeypatch):
    rounds = []
    step = components._towards_least
    monkeypatch.setattr(components, "_towards_least", lambda *a, **k: rounds.append(1) or step(*a, **k))
    for edges, most in (([(1, 2), (1, 3), (4, 9)], 0), ([(1, 2), (2, 3), (4, 9)], 2)):
        rounds.clear()
        found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4}
        assert len(rounds) <= most


def test_quality_equals_plain_version(docs):
    rows = documents()
    plain = brute.quality([(r[2], r[3], r[1]) for r in rows], prior=8)
    expected = sorted(
        (r[0], *[f[c] for c in quality_rules.CONTRACT], base, kept)
        for r, (f, base, kept) in zip(rows, plain)
    )
    assert sorted(map(tuple, quality_rules.report(docs, prior=8).collect())) == expected
    kept = [r[0] for r, p in zip(rows, plain) if p[2]]
    found = quality_rules.keep_good(docs.withColumn("Features", docs.doc_id), prior=8)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(kept)
    assert found.columns == [*docs.columns, "Features"]


def test_fences_follow_the_documents():
    """A junk source does not lift its fence far, and a strict one lowers its own."""
    rng = random.Random(5)
    calm = [("en", "calm", prose(rng, 80)) for _ in range(90)]
    loud = [("en", "loud", " ".join(f"w{rng.randrange(400)}A#" for _ in range(80))) for _ in range(20)]
    odd = [("en", "calm", prose(rng, 80) + " " + "Upper Case Words Here Too " * 2)]
    verdicts = [kept for *_, kept in brute.quality([*calm, *loud, *odd], 20)]
    assert all(verdicts[:90]) and not any(verdicts[90:])


def test_measures():
    m = dict(zip(quality_rules.FEATURES, quality_rules.measure("a b c\x0b a b c\n\n a b c\n#$ x y\n#$ x y")))
    assert m["n_words"] == 13 and m["n_dup_lines"] == 1 and m["n_symbols"] == 4
    assert m["n_repeat_words"] == 9 and m["word_chars"] == 19
    overlap = dict(zip(quality_rules.FEATURES, quality_rules.measure("a a a a")))
    assert overlap["n_repeat_words"] == 4


ITEMS = [
    (10, "The quick Brown fox, jumps over the lazy dog and runs away fast"),
    (2, "the quick brown fox jumps over the lazy dog and"),
    (3, "short item"),
    (4, None),
    (5, "..."),
    (6, "Ünder the bridge"),
    (7, "short item"),
]
LEAKS = [
    (1, "x The QUICK brown-fox jumps over the lazy dog and runs away fast y"),
    (1, "nothing here"),
    (2, "a short\nitem and a short item; short items"),
    (3, None),
    (4, ""),
    (5, "ünder the bridge, Ünder the bridge"),
    (None, "short item"),
    (6, "the quick brown fox jumps over the lazy dog"),
    (2, "a short\nitem and a short item; short items"),
]


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_decontamination_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(LEAKS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = []
    for doc_id, text in LEAKS:
        n, hit, found = brute.contaminated(text, ITEMS)
        expected.append((doc_id, n, hit, len(found), brute.sha(",".join(found).encode()), hit > 0))
    got = [tuple(r) for r in decontaminate.report(docs, items).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_contaminated_documents_and_spans_go(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(LEAKS)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.drop_documents(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["n_hit"] for r in left.collect()) == [1, 3, 4, 7]
    cut = {r["n_hit"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[0] == "x y" and cut[1] == "nothing here" and cut[2] == "a and a short items"
    assert cut[3] is None and len(cut) == len(LEAKS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for found in (
        suffix_dedup.report(none),
        suffix_dedup.dedup(none),
        ngram_join.report(none),
        quality_rules.report(none),
        decontaminate.report(none, items),
    ):
        assert found.count() == 0
    docs = spark.createDataFrame(LEAKS, "doc_id long, text string")
    clean = decontaminate.report(docs, items.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(LEAKS)
