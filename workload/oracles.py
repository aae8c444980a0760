"""DuckDB SQL for every registered query, over the same tables."""

from workload import queries as q

# The gene table, the database with one row per perturbation, and its long form.
BASE = """
raw_genes AS (
  SELECT i::int AS i, printf('P%03d', i) AS gene_id, printf('GENE%02d', i) AS gene_symbol,
         (i % 4 <> 0)::int::varchar || '-' || (i % 5 <> 0)::int::varchar AS data_type
  FROM (SELECT unnest(range(1, max(len(embedding)) + 1)) AS i FROM embeddings)
),
part_genes AS (
  SELECT (row_number() OVER (ORDER BY p_partkey))::int AS i, printf('P%06d', p_partkey) AS gene_id,
         p_name AS gene_symbol, p_type AS family,
         (p_size % 4 <> 0)::int::varchar || '-' || (p_size % 5 <> 0)::int::varchar AS data_type
  FROM part
),
lookup AS (
  SELECT gene_id AS name, i AS idx, gene_symbol AS symbol, data_type FROM raw_genes
  UNION ALL
  SELECT gene_symbol, i, gene_symbol, data_type FROM raw_genes
),
part_targets AS (
  SELECT l_partkey AS key,
         list_sort(list(DISTINCT printf('GENE%02d', l_suppkey % (SELECT count(*) FROM raw_genes) + 1)))
           AS targets
  FROM lineitem GROUP BY l_partkey
),
lines AS (
  SELECT *, concat_ws('_', 'PERT', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         l_orderkey * 31 + l_linenumber * 7 + l_partkey * 3 + l_suppkey AS number
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
),
db AS MATERIALIZED (
  SELECT id,
         '1.0' AS version,
         CASE WHEN number % 33 <> 32 THEN n_name END AS cell,
         CASE p_type WHEN 'ECONOMY' THEN 'trt_cp' WHEN 'STANDARD' THEN 'trt_cp'
                     WHEN 'LARGE' THEN 'trt_oe' WHEN 'MEDIUM' THEN 'trt_sh'
                     WHEN 'PROMO' THEN 'trt_lig' WHEN 'SMALL' THEN 'ctl_vehicle' END AS trt_type,
         printf('CMP_%05d', p_partkey) AS trt_id,
         p_name AS trt_name,
         p_size::varchar AS dose,
         p_brand AS smiles,
         coalesce(targets, []::varchar[]) AS targets,
         vec_id,
         CASE WHEN number % 50 <> 49 THEN len(embedding)::int END AS n_t,
         number % 50 <> 49 AND number % 40 <> 39 AS has_p
  FROM lines
  JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  JOIN embeddings ON vec_id = number % (SELECT max(vec_id) + 1 FROM embeddings)
  LEFT JOIN part_targets ON key = p_partkey
),
vectors AS (
  SELECT vec_id, idx, t, 1.0::double / (1.0::double + 300.0::double * t * t) AS p
  FROM (
    SELECT vec_id, unnest(range(1, len(embedding) + 1))::int AS idx,
           unnest(embedding)::double AS t
    FROM embeddings
  )
),
vals AS (
  SELECT id, idx, t, CASE WHEN has_p THEN p END AS p
  FROM db JOIN vectors USING (vec_id) WHERE n_t IS NOT NULL
),
vector_counts AS (
  SELECT vec_id, count(*) FILTER (p <= 0.05) AS n05, count(*) FILTER (p <= 0.03) AS n03,
         count(*) FILTER (p <= 0.02) AS n02
  FROM vectors GROUP BY vec_id
),
significant AS (
  SELECT id, CASE WHEN has_p THEN n05 ELSE 0 END AS n05, CASE WHEN has_p THEN n03 ELSE 0 END AS n03,
         CASE WHEN has_p THEN n02 ELSE 0 END AS n02
  FROM db JOIN vector_counts USING (vec_id) WHERE n_t IS NOT NULL
),
flat AS (
  SELECT db.id, coalesce(cell, 'N/A') AS cell,
         coalesce(CASE WHEN trt_type = 'trt_cp' THEN dose END, 'N/A') AS dose,
         trt_type, trt_name, coalesce(n05 > 0, false) AS informative
  FROM db LEFT JOIN significant USING (id)
),
vector_ranks AS (
  SELECT vec_id, idx,
         (sign(t) * (rank() OVER (PARTITION BY vec_id ORDER BY abs(t))
                     + (count(*) OVER (PARTITION BY vec_id, abs(t)) - 1) / 2.0::double))::double AS r
  FROM vectors
),
ranks AS (
  SELECT id, idx, r FROM db JOIN vector_ranks USING (vec_id) WHERE n_t IS NOT NULL
)
"""

FLAT_BIG = """
flat_big AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         n_name AS cell, l_quantity::int::varchar AS dose,
         CASE p_type WHEN 'ECONOMY' THEN 'trt_cp' WHEN 'STANDARD' THEN 'trt_cp'
                     WHEN 'LARGE' THEN 'trt_oe' WHEN 'MEDIUM' THEN 'trt_sh'
                     WHEN 'PROMO' THEN 'trt_lig' WHEN 'SMALL' THEN 'ctl_vehicle' END AS trt_type,
         p_name AS trt_name, l_discount <= 0.05 AS informative
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)
"""

ORDER_TOKENS = """
tokens AS (
  SELECT l_orderkey::varchar AS sig_id, l_linenumber AS pos,
         CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END
         || CASE WHEN l_partkey % 17 = 0 THEN 'NotKnown'
                 WHEN l_linenumber % 2 = 0 THEN printf('P%03d', l_suppkey % (SELECT count(*) FROM raw_genes) + 1)
                 ELSE printf('GENE%02d', l_suppkey % (SELECT count(*) FROM raw_genes) + 1) END AS token
  FROM lineitem
)
"""

NATION_TOKENS = """
tokens AS (
  SELECT 'nation' || s_nationkey::varchar AS sig_id, s_suppkey::int AS pos,
         CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END
         || printf('GENE%02d', s_suppkey % (SELECT count(*) FROM raw_genes) + 1) AS token
  FROM supplier
)
"""


def tokens(signatures) -> str:
    if isinstance(signatures, str):
        signatures = {"signature": signatures}
    rows = [
        f"('{sig_id}', {pos}, '{token}')"
        for sig_id, words in signatures.items()
        for pos, token in enumerate(words.split(), 1)
    ]
    return f"tokens AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(sig_id, pos, token))"


def parsed(ordered: bool = False) -> str:
    weight = "sign * (m - pos + 1)" if ordered else "sign"
    return f"""
resolved AS (
  SELECT sig_id, pos, CASE WHEN token LIKE '-%' THEN -1 ELSE 1 END AS sign, idx
  FROM tokens JOIN lookup ON name = CASE WHEN token LIKE '-%' THEN substr(token, 2) ELSE token END
),
firsts AS (
  SELECT sig_id, idx, pos AS old_pos, sign FROM resolved
  QUALIFY row_number() OVER (PARTITION BY sig_id, idx ORDER BY pos, sign) = 1
),
numbered AS (
  SELECT sig_id, idx, sign, row_number() OVER (PARTITION BY sig_id ORDER BY old_pos, idx) AS pos,
         count(*) OVER (PARTITION BY sig_id) AS m
  FROM firsts
),
parsed AS (SELECT sig_id, pos::int AS pos, idx, sign, ({weight})::double AS weight FROM numbered)
"""


def scores(ordered: bool = False, where: str = "true") -> str:
    """`scores`: (sig_id, id, zhang) of all signatures and profiles that pass a filter."""
    return (
        parsed(ordered)
        + f""",
reach AS (
  SELECT sig_id, sum(((SELECT count(*) FROM raw_genes) - pos + 1) * abs(weight)) AS c_max FROM parsed GROUP BY sig_id
),
vector_scores AS (
  SELECT sig_id, vec_id, sum(weight * r) / any_value(c_max) AS zhang
  FROM parsed JOIN vector_ranks USING (idx) JOIN reach USING (sig_id) GROUP BY sig_id, vec_id
),
scores AS (
  SELECT s.sig_id, d.id, coalesce(z.zhang, 0.0::double) AS zhang
  FROM (SELECT DISTINCT sig_id FROM tokens) AS s
  CROSS JOIN (SELECT id, vec_id FROM db WHERE n_t IS NOT NULL AND {where}) AS d
  LEFT JOIN vector_scores AS z ON z.sig_id = s.sig_id AND z.vec_id = d.vec_id
)
"""
    )


def sql(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *[part.strip() for part in parts]]) + "\n" + select


def y_bin(score: str, bins: int) -> str:
    return f"least(floor(({score} + 1.0::double) / 2.0::double * {bins}::double), {bins} - 1)::int"


def binned(bins_x: int, bins_y: int) -> str:
    """The plain form: number all rows, then bin them."""
    return f"""
SELECT sig_id, x_bin, y_bin, count(*) AS n FROM (
  SELECT sig_id,
         (((row_number() OVER (PARTITION BY sig_id ORDER BY zhang DESC, id) - 1) * {bins_x})
          // count(*) OVER (PARTITION BY sig_id))::int AS x_bin,
         {y_bin('zhang', bins_y)} AS y_bin
  FROM scores
) GROUP BY sig_id, x_bin, y_bin"""


def top(order: str, n: int) -> str:
    return f"""
SELECT sig_id, zhang, trt_id AS jnjs, id, smiles FROM scores JOIN db USING (id)
ORDER BY zhang {order}, id LIMIT {n}"""


PAIRS = """
pairs AS (
  SELECT id, max(zhang) FILTER (sig_id = 'one') AS one, max(zhang) FILTER (sig_id = 'two') AS two
  FROM scores GROUP BY id
)
"""



def grid(bins: int) -> str:
    return f"""
SELECT 'signature' AS sig_id, {y_bin('one', bins)} AS x_bin, {y_bin('two', bins)} AS y_bin,
       count(*) AS n
FROM pairs GROUP BY ALL"""


ANNOTATED = """
SELECT id, {version} AS version, {cell} AS cell, trt_type, trt_id, trt_name, dose,
       {smiles} AS smiles, array_to_string(targets, ',') AS targets, n_t,
       CASE WHEN has_p THEN n_t END AS n_p, {n_r} AS n_r
FROM db"""


def annotated(version="version", cell="cell", smiles="smiles", n_r="n_t") -> str:
    return ANNOTATED.format(version=version, cell=cell, smiles=smiles, n_r=n_r)


DELIVERED = annotated(
    version="""CASE trt_type WHEN 'trt_cp' THEN '1.0' WHEN 'trt_lig' THEN 'v2.1'
               WHEN 'ctl_vehicle' THEN NULL ELSE '2.0' END""",
    cell="CASE WHEN trt_type <> 'ctl_vehicle' THEN cell END",
    smiles="CASE WHEN trt_type <> 'trt_lig' THEN smiles END",
    n_r="NULL::int",
)

DATASET = """CASE trt_type WHEN 'trt_cp' THEN 'compounds_v1.0.parquet'
  WHEN 'trt_lig' THEN 'ligands_v2.1.parquet' WHEN 'ctl_vehicle' THEN 'controls.parquet'
  ELSE 'genetic_v2.0.parquet' END"""

VERSIONS = f"""
SELECT {DATASET} AS path,
       CASE trt_type WHEN 'trt_cp' THEN 1 WHEN 'ctl_vehicle' THEN 0 ELSE 2 END AS version_major,
       CASE trt_type WHEN 'trt_lig' THEN 1 ELSE 0 END AS version_minor,
       CASE trt_type WHEN 'trt_cp' THEN '2023-05-01' WHEN 'ctl_vehicle' THEN '0001-01-01'
                     WHEN 'trt_lig' THEN '2024-06-30' ELSE '2024-01-15' END AS processing_date
FROM db {{where}} GROUP BY ALL"""


def gene_rows(data_type: str) -> str:
    empty = ", ".join(f"NULL::varchar AS {name}" for name in ("entrezid", "ensemblid", "name"))
    return f"""
SELECT i AS index, gene_id AS id, gene_symbol AS symbol, {empty}, family AS "geneFamily",
       {data_type} AS "dataType"
FROM part_genes"""


MAPPED = "CASE data_type WHEN '1-1' THEN 'L1000' WHEN '0-1' THEN 'BING' WHEN '0-0' THEN 'AIG' WHEN '1-0' THEN 'INVALID' ELSE data_type END"

FILTER_VALUES = """
SELECT DISTINCT dimension, value FROM (
  SELECT 'cell' AS dimension, cell AS value FROM {flat}
  UNION ALL SELECT 'dose', dose FROM {flat}
  UNION ALL SELECT 'trt_type', trt_type FROM {flat}
  UNION ALL SELECT 'informative', informative::varchar FROM {flat}
) WHERE value IS NOT NULL"""


def to_perturbations(n: str, limit: int) -> str:
    return f"""
SELECT db.trt_name, db.id, db.cell, db.dose, db.trt_type, coalesce({n}, 0)::int AS n_significant,
       flat.informative
FROM db JOIN flat USING (id) LEFT JOIN significant USING (id)
WHERE starts_with(db.trt_name, 'CMP_00007') OR regexp_full_match(db.trt_name, 'blue.*')
   OR starts_with(trt_id, 'CMP_00007') OR regexp_full_match(trt_id, 'blue.*')
ORDER BY db.trt_name, db.id LIMIT {limit}"""


FIRST_FOUR = "SELECT id FROM lines ORDER BY id LIMIT 4"


def generated(p_value: float, ids: str = FIRST_FOUR) -> str:
    return f"""
SELECT 'signature' AS sig_id, row_number() OVER (ORDER BY abs(t) DESC, idx)::int AS pos,
       CASE WHEN t < 0 THEN '-' ELSE '' END || gene_symbol AS token
FROM (
  SELECT idx, median(t) AS t, median(p) AS p FROM vals
  WHERE id IN ({ids}) GROUP BY idx
) JOIN raw_genes ON i = idx
WHERE p <= {p_value} AND t <> 0"""


ORACLES = {
    "input_inventory": sql(f"SELECT {DATASET} AS dataset, count(*) AS n_rows FROM db GROUP BY ALL"),
    "probe_versions": sql(VERSIONS.format(where="")),
    "select_version": sql(VERSIONS.format(where="WHERE trt_type IN ('trt_oe', 'trt_sh', 'trt_lig')")),
    "select_version_v1": sql(VERSIONS.format(where="WHERE trt_type = 'trt_cp'")),
    "read_db": sql(DELIVERED),
    "read_db_nested": sql(annotated(n_r="NULL::int")),
    "union_dbs": sql(DELIVERED),
    "replicate_db": sql("SELECT id, 3::bigint AS copies FROM db"),
    "initialize": sql(
        """
SELECT 'samples' AS metric, 2 * count(*) AS value FROM chosen
UNION ALL SELECT 'genes', count(*) FROM raw_genes
UNION ALL SELECT 'compounds', count(DISTINCT trt_id) FROM chosen""",
        "chosen AS (SELECT * FROM db WHERE trt_type IN ('trt_oe', 'trt_sh', 'trt_lig'))",
    ),
    "load_genes": sql(gene_rows("data_type")),
    "map_gene_datatypes": sql(gene_rows(MAPPED)),
    "build_db": sql(annotated(n_r="NULL::int")),
    "build_db_long": sql("SELECT id, idx, t, p FROM vals"),
    "rank_vectors": sql("SELECT id, idx, r FROM ranks"),
    "write_db": sql("SELECT idx, id, r FROM ranks"),
    "write_db_wide": sql(annotated()),
    "flat_db": sql("SELECT * FROM flat"),
    "informative": sql("""
SELECT id, coalesce(n03 > 0, false) AS informative FROM db LEFT JOIN significant USING (id)"""),
    "db_counts": sql("""
SELECT 'db' AS dataset, count(*) AS n FROM db UNION ALL SELECT 'flatdb', count(*) FROM flat"""),
    "statistics": sql("""
SELECT 'samples' AS metric, count(*) AS value FROM db
UNION ALL SELECT 'genes', count(*) FROM raw_genes
UNION ALL SELECT 'compounds', count(DISTINCT trt_id) FROM db"""),
    "filter_values": sql(FILTER_VALUES.format(flat="flat")),
    "filter_values_lines": sql(FILTER_VALUES.format(flat="flat_big"), FLAT_BIG),
    "apply_filters": sql(
        annotated()
        + """ WHERE id IN (SELECT id FROM flat WHERE informative
          AND cell IN ('N/A', 'FRANCE', 'CHINA', 'BRAZIL') AND dose IN ('N/A', '5', '12', '31'))"""
    ),
    "apply_filters_lines": sql(
        """SELECT * FROM flat_big WHERE trt_type IN ('trt_cp', 'trt_sh')
           AND dose IN ('7', '21') AND NOT informative""",
        FLAT_BIG,
    ),
    "check_signature": sql(
        """
SELECT sig_id, pos, token AS query, idx IS NOT NULL AS found, coalesce(symbol, '') AS symbol,
       coalesce(data_type, '') AS data_type
FROM tokens
LEFT JOIN lookup ON name = CASE WHEN token LIKE '-%' THEN substr(token, 2) ELSE token END""",
        ORDER_TOKENS,
    ),
    "compounds": sql("""
SELECT DISTINCT trt_id, trt_name FROM db
WHERE trt_type = 'trt_cp' AND (starts_with(trt_id, 'CMP_0001') OR starts_with(trt_name, 'CMP_0001'))
ORDER BY trt_id, trt_name LIMIT 10"""),
    "compounds_by_name": sql("""
SELECT DISTINCT trt_id, trt_name FROM db
WHERE trt_type = 'trt_cp'
  AND (regexp_full_match(trt_id, 'blue.*') OR regexp_full_match(trt_name, 'blue.*'))
ORDER BY trt_id, trt_name LIMIT 5"""),
    "treatments": sql("""
SELECT DISTINCT trt_type, trt_id, trt_name FROM db
WHERE trt_type IN ('trt_sh', 'trt_oe')
  AND (regexp_full_match(trt_id, 'CMP_.*') OR regexp_full_match(trt_name, 'CMP_.*'))
ORDER BY trt_type, trt_id, trt_name LIMIT 10"""),
    "treatments_like": sql("""
SELECT DISTINCT trt_type, trt_id, trt_name FROM db
WHERE regexp_full_match(trt_name, 'blue.*') OR starts_with(trt_name, 'large')
ORDER BY trt_type, trt_id, trt_name LIMIT 20"""),
    "targets": sql("""
SELECT target, count(DISTINCT trt_id) AS n_compounds
FROM (SELECT trt_id, unnest(targets) AS target FROM db)
WHERE starts_with(target, 'GENE0') GROUP BY target ORDER BY target LIMIT 10"""),
    "target_to_compounds": sql("""
SELECT DISTINCT trt_id, trt_name,
       array_to_string(list_sort(list_intersect(targets, ['GENE03', 'GENE07'])), ',') AS matched
FROM db WHERE list_has_any(targets, ['GENE03', 'GENE07'])
ORDER BY trt_id, trt_name LIMIT 10"""),
    "treatment_to_perturbations": sql(to_perturbations("n05", 10)),
    "compound_to_samples": sql(to_perturbations("n02", 15)),
    "perturbation_details": sql("""
SELECT id, 'version=1.0,processingDate=2024-01-01' AS meta, db.cell, db.trt_type, trt_id,
       db.trt_name, db.dose, smiles, array_to_string(targets, ',') AS targets,
       n_t IS NOT NULL AS has_profile, informative
FROM db JOIN flat USING (id) WHERE id = (SELECT min(id) FROM lines)"""),
    "parse_signature": sql("SELECT * FROM parsed", ORDER_TOKENS, parsed()),
    "parse_signature_ordered": sql("SELECT * FROM parsed", ORDER_TOKENS, parsed(True)),
    "zhang_score": sql("SELECT * FROM scores", tokens(q.MANY), scores()),
    "zhang_score_ordered": sql("SELECT * FROM scores", tokens(q.MANY), scores(True)),
    "zhang_score_nations": sql("SELECT * FROM scores", NATION_TOKENS, scores()),
    "zhang_score_gene_major": sql("SELECT * FROM scores", tokens(q.MANY), scores()),
    "top_table_head": sql(top("DESC", 14), tokens(q.S1), scores()),
    "top_table_head_filtered": sql(
        top("DESC", 14), tokens(q.S1), scores(where="trt_type = 'trt_cp'")
    ),
    "top_table_head_gene_major": sql(
        top("DESC", 14), tokens(q.S1), scores(where="trt_type = 'trt_cp'")
    ),
    "top_table_head_threshold": sql(top("DESC", 14), tokens(q.S1), scores()),
    "top_table_tail_threshold": sql(
        top("ASC", 14), tokens(q.S1), scores(where="trt_type = 'trt_cp'")
    ),
    "top_table_head_nations": sql(
        """
SELECT sig_id, id, zhang, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY zhang DESC, id) AS place FROM scores
) JOIN db USING (id) WHERE place <= 5""",
        NATION_TOKENS,
        scores(),
    ),
    "top_table_tail": sql(top("ASC", 14), tokens(q.S1), scores()),
    "annotated_ids": sql(
        """
SELECT sig_id, zhang, id, db.cell, db.trt_type, trt_id, db.trt_name, db.dose, smiles,
       array_to_string(targets, ',') AS targets,
       (CASE WHEN has_p THEN n05 ELSE 0 END)::int AS n_significant, informative
FROM scores JOIN db USING (id) JOIN flat USING (id) JOIN significant USING (id)
WHERE starts_with(id, 'PERT_1_') OR regexp_full_match(id, 'PERT_2_.*')
ORDER BY zhang DESC, id LIMIT 10""",
        tokens(q.S1),
        scores(),
    ),
    "annotated_ids_without_signature": sql("""
SELECT 'signature' AS sig_id, 0.0::double AS zhang, id, db.cell, db.trt_type, trt_id, db.trt_name,
       db.dose, smiles, array_to_string(targets, ',') AS targets,
       (CASE WHEN has_p THEN n05 ELSE 0 END)::int AS n_significant, informative
FROM db JOIN flat USING (id) JOIN significant USING (id) ORDER BY id LIMIT 3"""),
    "select_features": sql("""
SELECT smiles, trt_id AS jnjs, id, coalesce(n05, 0)::int AS n_significant,
       array_to_string(targets, ',') AS targets
FROM db LEFT JOIN significant USING (id)"""),
    "binned_zhang": sql(binned(20, 20), tokens(q.S1), scores()),
    "binned_zhang_7x13": sql(binned(7, 13), tokens(q.MANY), scores(where="trt_type = 'trt_cp'")),
    "correlation": sql(grid(20), tokens({"one": q.S1, "two": q.S2}), scores(), PAIRS),
    "correlation_gene_major": sql(
        grid(10), tokens({"one": q.S1, "two": q.S2}), scores(where="trt_type = 'trt_cp'"), PAIRS
    ),
    "correlation_coefficient": sql(
        """
SELECT 'signature' AS sig_id, count(*) AS n, round(corr(one, two), 6) AS pearson FROM pairs""",
        tokens({"one": q.S1, "two": q.S2}),
        scores(),
        PAIRS,
    ),
    "generate_signature": sql(generated(0.3)),
    "generate_signature_strict": sql(generated(0.05)),
    "generate_signature_compounds": sql(
        generated(0.35, "SELECT id FROM db WHERE trt_type = 'trt_cp'")
    ),
    "generated_then_scored": sql(
        """
SELECT sig_id, id, zhang FROM scores ORDER BY zhang DESC, id LIMIT 14""",
        f"tokens AS ({generated(0.3)})",
        scores(),
    ),
}
