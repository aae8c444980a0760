"""Scores of signature tables, as products of blocks, against those in expressions."""

import pytest
from pyspark.sql import functions as F

from sigloom.operators import scoring
from sigloom.operators.scoring import resolve, score_products, score_vectors


@pytest.fixture(scope="module")
def signatures(spark):
    """60 signatures with unknown tokens, repeated genes, and none that is known in one."""
    k, j = F.col("k"), F.explode(F.sequence(F.lit(1), F.col("k") % 9 + 1))
    rows = spark.range(60).withColumnRenamed("id", "k").select("k", j.alias("pos"))
    gene = F.pmod(F.xxhash64(k, "pos"), F.lit(43))
    sign = F.when(gene % 3 == 0, "-").otherwise("")
    name = F.when(k == 7, "NotKnown").otherwise(F.concat(sign, F.format_string("S%02d", gene)))
    return rows.select(F.format_string("sig%02d", k).alias("sig_id"), F.col("pos").cast("int").alias("pos"), name.alias("token"))


def vectors(db):
    return db.select("id", F.struct("cell", "trt.targets").alias("more"), scoring.rank_column())


def rows(frame):
    return sorted((r.id, r.sig_id, r.zhang.hex(), str(r.more)) for r in frame.collect())


@pytest.mark.parametrize("cells", [1_000_000, 100, 1])
@pytest.mark.parametrize("ordered", [False, True])
def test_products_are_bitwise_equal(wide_values, signatures, monkeypatch, cells, ordered):
    monkeypatch.setattr(scoring, "CELLS", cells)
    db, genes = wide_values
    # Some rows without a profile, and few rows where each of them is a product of its own.
    db = db.withColumn("profile", F.when(~F.col("id").endswith("3"), F.col("profile")))
    db = db if cells > 100 else db.filter("id < 'X0020'")
    resolved = resolve(genes, signatures, ordered, "zhang")
    expected = rows(score_vectors(vectors(db), genes, resolved))
    found = rows(score_products(vectors(db), genes, resolved))
    assert found == expected
    assert len(found) == 60 * db.filter("profile IS NOT NULL").count()


def test_signature_tables_use_products(wide_values, signatures):
    db, genes = wide_values
    scored = scoring.zhang_score(db, genes, signatures)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()
    as_lists = {
        s: [r.token for r in sorted(own, key=lambda r: r.pos)]
        for s, own in _by_signature(signatures.collect()).items()
    }
    listed = scoring.zhang_score(db, genes, as_lists)
    assert sorted(scored.collect()) == sorted(listed.collect())


def _by_signature(rows):
    found = {}
    for r in rows:
        found.setdefault(r.sig_id, []).append(r)
    return found


def test_several_blocks_of_signatures(wide_values, signatures, monkeypatch):
    db, genes = wide_values
    whole = sorted(scoring.zhang_score(db, genes, signatures).collect())
    monkeypatch.setattr("sigloom.operators.signatures.INLINE_TOKENS", 50)
    assert sorted(scoring.zhang_score(db, genes, signatures).collect()) == whole


def test_empty_tables(wide_values, signatures):
    db, genes = wide_values
    assert scoring.zhang_score(db, genes, signatures.limit(0)).count() == 0
    assert scoring.zhang_score(db.limit(0), genes, signatures).count() == 0


def test_a_vector_of_another_length_fails(wide_values, signatures):
    db, genes = wide_values
    with pytest.raises(Exception, match="a vector has 40 entries"):
        scoring.zhang_score(db, genes.filter("index < 9"), signatures).count()
