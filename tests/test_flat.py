import pytest

from sigloom.functions.arguments import ArgumentError
from sigloom.operators.flat import (
    apply_filters,
    db_counts,
    filter_values,
    flat_db,
    informative,
    statistics,
)


def test_flat_db(db):
    rows = {r.id: tuple(r)[1:] for r in flat_db(db).collect()}
    assert rows == {
        "A": ("MCF7", "10", "trt_cp", "aspirin", True),
        "B": ("MCF7", "10", "trt_cp", "aspirin", False),
        "C": ("PC3", "N/A", "trt_cp", "ibuprofen", False),
        "D": ("PC3", "5", "trt_cp", "aspirin", False),
        "E": ("N/A", "N/A", "trt_oe", "TP53 up", False),
        "F": ("PC3", "5", "trt_cp", "aspirin", True),
    }


@pytest.mark.parametrize("threshold, ids", [(0.001, "A"), (0.0009, ""), (0.06, "ABF"), (1, "ABEF")])
def test_informative(db, threshold, ids):
    found = informative(db, threshold).filter("informative").orderBy("id").collect()
    assert "".join(r.id for r in found) == ids


def test_counts_and_statistics(db, genes):
    assert db_counts(db).collect() == [("db", 6), ("flatdb", 6)]
    assert statistics(db, genes).collect() == [("samples", 6), ("genes", 5), ("compounds", 4)]


def test_empty_database(db, genes):
    empty = db.limit(0)
    assert db_counts(empty).collect() == [("db", 0), ("flatdb", 0)]
    assert statistics(empty, genes.limit(0)).collect() == [("samples", 0), ("genes", 0), ("compounds", 0)]
    assert filter_values(flat_db(empty)).count() == 0


def test_filter_values(db):
    found = {tuple(r) for r in filter_values(flat_db(db)).collect()}
    assert found == {
        ("cell", "MCF7"), ("cell", "PC3"), ("cell", "N/A"),
        ("dose", "10"), ("dose", "5"), ("dose", "N/A"),
        ("trt_type", "trt_cp"), ("trt_type", "trt_oe"),
        ("informative", "true"), ("informative", "false"),
    }


FILTERS = [
    (None, "ABCDEF"),
    ({}, "ABCDEF"),
    ({"cell": []}, "ABCDEF"),
    ({"cell": "no list"}, "ABCDEF"),
    ({"cell": ["PC3", "N/A"]}, "CDEF"),
    ({"cell": ["PC3"], "dose": ["5"]}, "DF"),
    ({"dose": ["N/A"]}, "CE"),
    ({"dose": ["N/A", "10"]}, "ABCE"),
    ({"trt_type": ["trt_oe"]}, "E"),
    ({"informative": ["true"]}, "AF"),
    ({"informative": [False]}, "BCDE"),
    ({"informative": ["true", "false"]}, "ABCDEF"),
    ({"informative": ["maybe"]}, ""),
    # One bad value does not shift the lists of the other dimensions.
    ({"cell": 3, "dose": ["10"]}, "AB"),
]


@pytest.mark.parametrize("filters, ids", FILTERS)
def test_apply_filters(db, filters, ids):
    for frame in (db, flat_db(db)):
        found = apply_filters(frame, filters).orderBy("id").collect()
        assert "".join(r.id for r in found) == ids


def test_apply_filters_reports_unknown_dimensions(db):
    with pytest.raises(ArgumentError) as error:
        apply_filters(db, {"color": ["red"], "size": ["1"]})
    assert len(error.value.problems) == 2
