import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigloom.functions.arguments import ArgumentError
from sigloom.operators import histograms, scoring, signatures
from sigloom.operators.generate import generate_signature
from sigloom.sources.layouts import gene_major

SIGNATURE = "MELK -BRCA1"
UNORDERED = {"A": 3 / 9, "B": 7 / 9, "D": -1.0, "E": 0.0, "F": 1 / 9}
ORDERED = {"A": 4 / 14, "B": 0.75, "D": -1.0, "E": 3 / 14, "F": 6 / 14}


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def scores(frame):
    return {(r.sig_id, r.id): r.zhang for r in frame.collect()}


def same(one, two):
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


@pytest.mark.parametrize("ordered, expected", [(False, UNORDERED), (True, ORDERED)])
def test_zhang_score(db, genes, ordered, expected):
    found = scores(scoring.zhang_score(db, genes, SIGNATURE, ordered))
    assert found == {("signature", id): score for id, score in expected.items()}


def test_parse_signature(genes):
    tokens = "-EGFR nothing MELK -201_at EGFR 200814_at"
    found = signatures.parse_signature(genes, tokens, ordered=True)
    assert rows(found.orderBy("pos")) == [
        ("signature", 1, 5, -1, -3.0),
        ("signature", 2, 1, 1, 2.0),
        ("signature", 3, 3, 1, 1.0),
    ]


def test_lowest_gene_wins_a_shared_name(genes):
    shared = genes.withColumn("symbol", F.array(F.lit("SAME")))
    assert signatures.parse_signature(shared, "SAME").first().idx == 1


def test_signature_without_genes_scores_zero(db, genes):
    many = {"none": ".*", "some": SIGNATURE, "odd": "x y"}
    found = scores(scoring.zhang_score(db, genes, many))
    assert len(found) == 15
    assert {v for (sig_id, _), v in found.items() if sig_id != "some"} == {0.0}
    by_gene = scoring.zhang_score(db, genes, many, ranks=gene_major(db))
    assert scores(by_gene) == found


def test_empty_inputs(db, genes):
    assert rows(scoring.zhang_score(db.limit(0), genes, SIGNATURE)) == []
    none = signatures.signature_table(db.sparkSession, SIGNATURE).limit(0)
    assert rows(scoring.zhang_score(db, genes, none)) == []
    assert rows(histograms.binned_zhang(db.limit(0), genes, SIGNATURE)) == []


def test_ranks_must_fit_the_genes(db, genes):
    with pytest.raises(PySparkException, match="5 entries, genes: 3"):
        scoring.zhang_score(db, genes.filter("index < 4"), SIGNATURE).collect()


def test_layouts_agree(wide_values):
    db, genes = wide_values
    ranks = gene_major(db).cache()
    many = {"a": "S01 -S02 S39", "b": "-P07 S08", "c": "nothing"}
    for ordered in (False, True):
        wide = scoring.zhang_score(db, genes, many, ordered)
        assert wide.count() == 900
        assert same(wide, scoring.zhang_score(db, genes, many, ordered, ranks=ranks))
    filters = {"cell": ["HOT"]}
    wide = scoring.zhang_score(db, genes, many, filters=filters)
    assert wide.count() == 300
    assert same(wide, scoring.zhang_score(db, genes, many, filters=filters, ranks=ranks))
    pair = (many["a"], many["b"])
    wide = histograms.correlation(db, genes, *pair, filters=filters)
    assert same(wide, histograms.correlation(db, genes, *pair, filters=filters, ranks=ranks))
    options = {"features": "zhang id trt_name n_significant", "filters": filters}
    head = rows(scoring.top_table_head(db, genes, many["a"], 7, **options))
    assert head == rows(scoring.top_table_head(db, genes, many["a"], 7, ranks=ranks, **options))
    assert len(head) == 7


def test_score_properties(wide_values):
    db, genes = wide_values
    found = scoring.zhang_score(db, genes, {"up": "S01 -S02 S03", "down": "-S01 S02 -S03"})
    assert found.filter("abs(zhang) > 1").isEmpty()
    sides = found.groupBy("id").pivot("sig_id", ["up", "down"]).agg(F.first("zhang"))
    assert sides.filter("up <> -down").isEmpty()


@pytest.mark.parametrize("ordered", [False, True])
def test_own_strongest_genes_score_one(db, genes, ordered):
    # The genes of A from the largest |t| on.
    own = scoring.zhang_score(db, genes, "EGFR -TP53 PSME1", ordered).filter("id = 'A'")
    assert own.first().zhang == 1.0


def test_many_signatures_in_blocks(wide_values, monkeypatch):
    db, genes = wide_values
    many = {f"sig{i}": f"S{i:02d} -S{i + 1:02d} nothing" for i in range(1, 9)}
    table = signatures.signature_table(db.sparkSession, many)
    expected = scoring.zhang_score(db, genes, many)
    pairs = histograms.correlation_coefficient(db, genes, table, table)
    monkeypatch.setattr(signatures, "INLINE_TOKENS", 12)
    assert signatures.block_count(many) == signatures.block_count(table) == 4
    assert same(expected, scoring.zhang_score(db, genes, many))
    assert same(expected, scoring.zhang_score(db, genes, table, ranks=gene_major(db)))
    assert same(pairs, histograms.correlation_coefficient(db, genes, table, table))
    by_gene = histograms.correlation_coefficient(db, genes, table, table, ranks=gene_major(db))
    assert same(pairs, by_gene)
    assert pairs.filter("n <> 300 or pearson <> 1").isEmpty()


def test_one_signature_with_most_tokens(wide_values):
    """Repeated tokens of one signature add nothing."""
    db, genes = wide_values
    plain = {"hot": "S01 -S02 S03", "other": "S05"}
    repeated = {"hot": ("S01 -S02 S03 " * 500 + "-S01 P02"), "other": "S05"}
    assert same(
        scoring.zhang_score(db, genes, plain, True), scoring.zhang_score(db, genes, repeated, True)
    )


def test_top_table(db, genes):
    head = scoring.top_table(db, genes, SIGNATURE, head=2, features="zhang jnjs id smiles")
    assert head.columns == ["sig_id", "zhang", "jnjs", "id", "smiles"]
    assert rows(head) == [
        ("signature", 7 / 9, "C1", "B", "CCO"),
        ("signature", 3 / 9, "C1", "A", "CCO"),
    ]
    tail = scoring.top_table_tail(db, genes, SIGNATURE, 2, "id")
    assert rows(tail) == [("signature", "D"), ("signature", "E")]
    all_features = scoring.top_table_head(db, genes, SIGNATURE, 1).first()
    assert (all_features.targets, all_features.n_significant, all_features.informative) == (
        "BRCA1,TP53",
        0,
        False,
    )


def test_top_table_filters(db, genes):
    found = scoring.top_table_head(
        db, genes, SIGNATURE, 9, "id", {"cell": ["PC3", "N/A"], "informative": ["true"]}
    )
    assert rows(found) == [("signature", "F")]


def test_head_of_negated_is_tail(wide_values):
    db, genes = wide_values
    head = scoring.top_table_head(db, genes, "-S01 S02", 20, "id")
    tail = scoring.top_table_tail(db, genes, "S01 -S02", 20, "id")
    assert rows(head) == rows(tail)


def test_top_table_of_many_signatures(wide_values):
    db, genes = wide_values
    many = {"a": "S01 -S02", "b": "S03"}
    found = rows(scoring.top_table_head(db, genes, many, 5, "id zhang"))
    alone = [
        (name, *row[1:])
        for name, words in many.items()
        for row in rows(scoring.top_table_head(db, genes, words, 5, "id zhang"))
    ]
    assert found == alone


TEN = "HSPA1A DNAJB1 BAG3 P4HA2 HSPA8 TMEM97 SPR DDIT4 HMOX1 -TSEN2"


def test_top_table_arguments(db, genes):
    features = "zhang jnjs id smiles"
    assert scoring.top_table(db, genes, TEN, head=14, features=features).count() == 5
    for bad in ({}, {"head": "yes"}, {"head": 14, "tail": 5}, {"head": -1}):
        with pytest.raises(ArgumentError):
            scoring.top_table(db, genes, TEN, features=features, **bad)
    with pytest.raises(ArgumentError) as error:
        scoring.top_table(db, genes, features="zhang colour")
    assert len(error.value.problems) == 3


def test_annotated_ids(db, genes):
    found = rows(scoring.annotated_ids(db, genes, SIGNATURE, features="id zhang"))
    assert [r[1] for r in found] == ["B", "A", "F", "E", "D"]
    limited = scoring.annotated_ids(db, genes, SIGNATURE, "A [DE]", 2, "id")
    assert rows(limited) == [("signature", "A"), ("signature", "E")]
    first = scoring.annotated_ids(db, genes, limit=1, features="zhang id")
    assert rows(first) == [("signature", 0.0, "A")]


def test_select_features(db):
    found = scoring.select_features(db, "smiles jnjs id trt_id id")
    assert found.columns == ["smiles", "jnjs", "id", "trt_id"]
    assert scoring.select_features(db).count() == 6
    with pytest.raises(ArgumentError):
        scoring.select_features(db, "zhang")


def test_binned_zhang(db, genes):
    found = histograms.binned_zhang(db, genes, SIGNATURE, 5, 2).orderBy("x_bin")
    assert [r[1:] for r in rows(found)] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 1)]
    coarse = histograms.binned_zhang(db, genes, SIGNATURE, 2, 1).orderBy("x_bin")
    assert [r[1:] for r in rows(coarse)] == [(0, 0, 3), (1, 0, 2)]


@pytest.mark.parametrize("bins_x, bins_y", [(1, 1), (7, 13), (20, 20), (301, 4), (1000, 3)])
def test_binned_zhang_equals_numbering(wide_values, bins_x, bins_y):
    db, genes = wide_values
    many = {"a": "S01 -S02 S39", "none": "nothing"}
    found = histograms.binned_zhang(db, genes, many, bins_x, bins_y)
    assert {r[1] for r in rows(found.groupBy("sig_id").agg(F.sum("n")))} == {300}
    listed = sorted(rows(scoring.zhang_score(db, genes, many)), key=lambda r: (r[0], -r[2], r[1]))
    expected = {}
    for i, (sig_id, _, zhang) in enumerate(listed):
        x = (i % 300) * bins_x // 300
        y = min(int((zhang + 1) / 2 * bins_y), bins_y - 1)
        expected[sig_id, x, y] = expected.get((sig_id, x, y), 0) + 1
    assert {r[:3]: r[3] for r in rows(found)} == expected


def test_correlation(db, genes):
    found = histograms.correlation(db, genes, SIGNATURE, "-MELK BRCA1", bins=2)
    # Bins of the two scores: A, B, F high and low; D low and high; E (0, 0) high twice.
    assert sorted(r[1:] for r in rows(found)) == [(0, 1, 1), (1, 0, 3), (1, 1, 1)]
    assert rows(histograms.correlation_coefficient(db, genes, SIGNATURE, "-MELK BRCA1")) == [
        ("signature", 5, -1.0)
    ]


def test_correlation_arguments(db, genes):
    with pytest.raises(ArgumentError) as error:
        histograms.correlation(db, genes, bins=0)
    assert len(error.value.problems) == 3
    with pytest.raises(ArgumentError):
        histograms.correlation(db, genes, {"a": "MELK"}, {"b": "MELK"})


def test_generate_signature(db, genes):
    assert rows(generate_signature(db, genes, "A", 0.05)) == [
        ("signature", 1, "EGFR"), ("signature", 2, "-TP53"), ("signature", 3, "PSME1"),
    ]
    # Medians over A, D and F; D has no p-values but a say in t.
    found = generate_signature(db, genes, ["A", "D", "F", "C"], 0.26)
    assert [r.token for r in found.collect()] == ["BRCA1", "PSME1", "TP53", "EGFR"]
    assert rows(generate_signature(db, genes, "E", 0.05)) == []
    with pytest.raises(ArgumentError):
        generate_signature(db, genes)


def test_generated_signature_can_be_scored(db, genes):
    made = generate_signature(db, genes, "A", 0.05)
    assert scores(scoring.zhang_score(db, genes, made))["signature", "A"] == 1.0
