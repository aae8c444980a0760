import pytest

from sigloom.functions.arguments import ArgumentError
from sigloom.operators import lookup
from sigloom.operators.signatures import check_signature


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_check_signature(genes):
    found = check_signature(genes, "MELK BRCA1 NotKnown 00000_at 200814_at -TP53")
    assert rows(found.orderBy("pos").select("query", "found", "symbol", "data_type")) == [
        ("MELK", True, "MELK", "1-1"),
        ("BRCA1", True, "BRCA1", "0-1"),
        ("NotKnown", False, "", ""),
        ("00000_at", False, "", ""),
        ("200814_at", True, "PSME1", "0-0"),
        ("-TP53", True, "TP53", "1-0"),
    ]


def test_check_signature_default_and_many(genes):
    assert rows(check_signature(genes)) == [("signature", 1, ".*", False, "", "")]
    many = check_signature(genes, {"a": "MELK", "b": ["EGFR", "MELK"]})
    assert sorted(r[:3] for r in rows(many)) == [("a", 1, "MELK"), ("b", 1, "EGFR"), ("b", 2, "MELK")]


def test_compounds_exact_prefix_regex(db):
    assert rows(lookup.compounds(db, "C1")) == [("C1", "aspirin")]
    assert rows(lookup.compounds(db, "asp")) == [("C1", "aspirin"), ("C2", "aspirin")]
    assert rows(lookup.compounds(db, ".*")) == [
        ("C1", "aspirin"),
        ("C2", "aspirin"),
        ("C3", "ibuprofen"),
    ]
    # A regular expression must match the whole value, and case matters.
    assert rows(lookup.compounds(db, "[i]bu")) == []
    assert rows(lookup.compounds(db, "ASP")) == []
    assert rows(lookup.compounds(db, "C.", limit=2)) == [("C1", "aspirin"), ("C2", "aspirin")]


def test_default_limit(wide_values):
    db, _ = wide_values
    assert lookup.treatments(db, ".*").count() == 10
    assert lookup.treatments(db, ".*", limit=5).count() == 5


@pytest.mark.parametrize("query, limit, problems", [(None, 10, 1), ("", 0, 2), (3, "x", 2)])
def test_search_arguments(db, query, limit, problems):
    with pytest.raises(ArgumentError) as error:
        lookup.compounds(db, query, limit=limit)
    assert len(error.value.problems) == problems


def test_treatments(db):
    assert rows(lookup.treatments(db, "TP53")) == [("trt_oe", "G1", "TP53 up")]
    assert rows(lookup.treatments(db, ".*", trt_type="trt_oe trt_sh")) == [("trt_oe", "G1", "TP53 up")]
    assert rows(lookup.treatments(db, "C", like=["ibu", ".*53.*"])) == [("trt_cp", "C3", "ibuprofen")]


def test_targets(db):
    assert rows(lookup.targets(db, ".*")) == [("BRCA1", 1), ("TP53", 3)]
    assert rows(lookup.targets(db, "TP")) == [("TP53", 3)]
    assert rows(lookup.targets(db, "X")) == []


def test_target_to_compounds(db):
    assert rows(lookup.target_to_compounds(db, "TP53 BRCA1")) == [
        ("C1", "aspirin", "BRCA1,TP53"),
        ("C2", "aspirin", "TP53"),
        ("G1", "TP53 up", "TP53"),
    ]
    assert rows(lookup.target_to_compounds(db, ["BRCA1"], limit=1)) == [("C1", "aspirin", "BRCA1")]


def test_treatment_to_perturbations(db):
    found = rows(lookup.treatment_to_perturbations(db, "aspirin G1", pvalue=0.5))
    assert found == [
        ("TP53 up", "E", None, "1", "trt_oe", 5, False),
        ("aspirin", "A", "MCF7", "10", "trt_cp", 4, True),
        ("aspirin", "B", "MCF7", "10", "trt_cp", 2, False),
        ("aspirin", "D", "PC3", "5", "trt_cp", 0, False),
        ("aspirin", "F", "PC3", "5", "trt_cp", 5, True),
    ]
    assert len(rows(lookup.treatment_to_perturbations(db, ["asp"], limit=2))) == 2


def test_compound_to_samples_is_deprecated(db):
    with pytest.warns(DeprecationWarning):
        found = lookup.compound_to_samples(db, "aspirin", 0.5)
    assert rows(found) == rows(lookup.treatment_to_perturbations(db, "aspirin", 0.5))


def test_perturbation_details(db):
    row = lookup.perturbation_details(db, "C").first()
    assert (row.trt_name, row.cell, row.has_profile, row.informative) == (
        "ibuprofen",
        "PC3",
        False,
        False,
    )
    assert lookup.perturbation_details(db, "nobody").count() == 0
