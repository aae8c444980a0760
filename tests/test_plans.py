"""Plans over a stored database are what a cluster needs: pruned, pushed, no detours."""

import re

import pytest

from sigloom.operators import flat, generate, histograms, lookup, scoring, signatures
from sigloom.sources.layouts import read_gene_major, write_db
from sigloom.sources.perturbations import read_db


@pytest.fixture(scope="module")
def stored(spark, unranked, genes, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    write_db(unranked, f"{root}/db", genes=genes, partitions=2)
    db = read_db(spark, f"{root}/db")
    write_db(db, f"{root}/ranks", layout="gene_major")
    return db, read_gene_major(spark, f"{root}/ranks")


def plan(frame) -> str:
    """The main plan, without the subqueries that resolve signatures."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    lines, skipped = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :+-*"))
        if skipped is not None and indent > skipped:
            continue
        skipped = indent if re.match(r"[ :+\-]*(Reused)?Subquery", line) else None
        if skipped is None:
            lines.append(line)
    return "\n".join(lines)


def scan(frame) -> str:
    """Pushed filters and read schema of the database scan."""
    node = frame._jdf.queryExecution().executedPlan()
    found = re.findall(r"FileScan parquet.*?ReadSchema: \S+", node.toString())
    return "\n".join(line for line in found if "/db]" in line or "/ranks]" in line)


SIGNATURE = "MELK -BRCA1"


def test_no_python_in_any_plan(stored, genes):
    db, ranks = stored
    frames = [
        scoring.top_table_head(db, genes, SIGNATURE, 3),
        scoring.zhang_score(db, genes, SIGNATURE, ranks=ranks),
        histograms.binned_zhang(db, genes, SIGNATURE),
        histograms.correlation(db, genes, SIGNATURE, "EGFR"),
        generate.generate_signature(db, genes, "A B"),
        flat.filter_values(flat.flat_db(db)),
        lookup.targets(db, "T"),
    ]
    for frame in frames:
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scoring_is_one_stage_over_ranks_only(stored, genes):
    db, _ = stored
    top = scoring.top_table_head(db, genes, SIGNATURE, 3, "zhang jnjs id")
    assert "TakeOrderedAndProject" in plan(top)
    assert "Exchange" not in plan(top) and "Join" not in plan(top)
    assert "trt:struct<id:string>,profile:struct<r:array<double>>" in scan(top)
    scored = scoring.zhang_score(db, genes, SIGNATURE)
    assert "Exchange" not in plan(scored)
    assert scan(scored).endswith("struct<id:string,profile:struct<r:array<double>>>")


def test_scores_are_computed_once(stored, genes):
    """No filter repeats the score expression."""
    db, _ = stored
    assert plan(scoring.zhang_score(db, genes, SIGNATURE)).count("aggregate(") == 1


def test_filters_are_pushed(stored, genes):
    db, _ = stored
    filters = {"trt_type": ["trt_cp"], "cell": ["PC3", "MCF7"]}
    text = scan(scoring.top_table_head(db, genes, SIGNATURE, 3, "id", filters))
    assert "EqualTo(trt_type,trt_cp)" in text and "In(cell, [MCF7,PC3])" in text


def test_searches_are_pushed(stored):
    db, _ = stored
    text = scan(lookup.compounds(db, "C1"))
    assert "StringStartsWith(trt.id,C1)" in text
    assert text.endswith("struct<trt_type:string,trt:struct<id:string,name:string>>")
    assert "EqualTo(id,A)" in scan(lookup.perturbation_details(db, "A"))
    assert "TakeOrderedAndProject" in plan(lookup.compounds(db, "C1"))


def test_gene_major_reads_only_genes_in_use(stored, genes):
    db, ranks = stored
    frame = scoring.zhang_score(db, genes, SIGNATURE, ranks=ranks)
    assert re.search(r"PushedFilters: \[In\(idx, \[1,2\]\)", scan(frame))
    assert "BroadcastHashJoin" in plan(frame)


def test_gene_major_is_written_without_shuffle(stored):
    from sigloom.sources.layouts import gene_major

    db, _ = stored
    assert "Exchange" not in plan(gene_major(db).sortWithinPartitions("idx", "id"))


def test_tops_of_many_signatures_shuffle_few_rows(stored, genes):
    db, _ = stored
    frame = scoring.top_table_head(db, genes, {"a": "MELK", "b": "EGFR"}, 3, "id zhang")
    assert re.search(r"WindowGroupLimit .* 3, Partial", plan(frame))


def test_no_sort_for_bins(stored, genes):
    """Windows run over counts per bin, never over rows."""
    db, _ = stored
    text = plan(histograms.binned_zhang(db, genes, SIGNATURE))
    assert text.index("Window") < text.index("HashAggregate")
    assert "SinglePartition" not in text and "rangepartitioning" not in text


def test_filter_values_read_no_t(stored):
    db, _ = stored
    text = scan(flat.filter_values(flat.flat_db(db)))
    assert text.endswith("trt:struct<dose:string>,profile:struct<p:array<double>>>")


def test_samples_are_pushed(stored, genes):
    db, _ = stored
    assert "In(id, [A,B])" in scan(generate.generate_signature(db, genes, "A B"))


def test_signatures_resolve_by_hash(genes, stored):
    db, _ = stored
    table = db.selectExpr("trt_type AS sig_id", "1 AS pos", "cell AS token")
    text = plan(signatures.parse_signature(genes, table))
    assert "HashAggregate(keys=[sig_id" in text
