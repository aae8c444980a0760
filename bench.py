"""Times of the headline queries over a stored database; prints one line of JSON.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (cores). The database is prepared once, as
an ingest would do; each query then runs once to warm up and twice to be timed.
"""

import json
import os
import time

from sigloom.operators import flat, generate, histograms, lookup, scoring, signatures
from sigloom.plans.shared import shared_folder
from sigloom.sources.genes import load_genes
from sigloom.sources.layouts import read_gene_major, write_db
from sigloom.sources.perturbations import read_db, replicate_db
from workload import tables
from workload.queries import FEATURES, LINE_FILTERS, MANY, S1, S2, first_ids
from workload.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(frame):
    frame.write.format("noop").mode("overwrite").save()


def main():
    spark = session(CPUS)
    folder = shared_folder(spark, "bench")
    times = {}

    raw = f"{folder}/genes"
    tables.raw_genes(spark, SF_DIR).coalesce(1).write.parquet(raw)
    genes = load_genes(spark.read.parquet(raw), "gene_id")
    samples = first_ids(spark, SF_DIR, 4)
    hundred = " ".join(f"{'-' * (k % 3 == 0)}GENE{k % 64 + 1:02d}" for k in range(100))
    unranked = tables.unranked_db(spark, SF_DIR)
    times["prepare_wide"] = seconds(
        lambda: write_db(unranked, f"{folder}/db", genes=genes, partitions=int(CPUS))
    )
    db = read_db(spark, f"{folder}/db")
    times["prepare_gene_major"] = seconds(
        lambda: write_db(db, f"{folder}/ranks", layout="gene_major")
    )
    ranks = read_gene_major(spark, f"{folder}/ranks")
    lines = tables.flat_big(spark, SF_DIR)
    orders = tables.order_signatures(spark, SF_DIR)
    nations = tables.nation_signatures(spark, SF_DIR)

    def scores_at(k):
        many = replicate_db(db, k)
        return {
            f"top_table_head_x{k}": lambda: scoring.top_table_head(many, genes, S1, 14, FEATURES),
            f"binned_zhang_x{k}": lambda: histograms.binned_zhang(many, genes, S1),
            f"correlation_x{k}": lambda: histograms.correlation(many, genes, S1, S2),
        }

    queries = {
        **scores_at(1),
        **scores_at(4),
        "zhang_score_many": lambda: scoring.zhang_score(db, genes, MANY),
        "zhang_score_nations": lambda: scoring.zhang_score(db, genes, nations),
        "zhang_score_100_genes_gene_major": lambda: scoring.zhang_score(
            db, genes, hundred, ranks=ranks
        ),
        "top_table_head_gene_major": lambda: scoring.top_table_head(
            db, genes, S1, 14, FEATURES, ranks=ranks
        ),
        "binned_zhang_gene_major": lambda: histograms.binned_zhang(db, genes, S1, ranks=ranks),
        "generate_signature": lambda: generate.generate_signature(db, genes, samples, 0.3),
        "check_signature_orders": lambda: signatures.check_signature(genes, orders),
        "parse_signature_orders": lambda: signatures.parse_signature(genes, orders),
        "filter_values_lines": lambda: flat.filter_values(lines),
        "apply_filters_lines": lambda: flat.apply_filters(lines, LINE_FILTERS),
        "flat_db": lambda: flat.flat_db(db),
        "statistics": lambda: flat.statistics(db, genes),
        "compounds": lambda: lookup.compounds(db, "CMP_0001"),
        "targets": lambda: lookup.targets(db, "GENE0"),
        "treatment_to_perturbations": lambda: lookup.treatment_to_perturbations(
            db, "CMP_00007 blue.*"
        ),
        "perturbation_details": lambda: lookup.perturbation_details(db, samples[0]),
    }
    for name, query in queries.items():
        run(query())
        times[name] = min(seconds(lambda: run(query())) for _ in range(2))

    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
