"""Splits and samples, matrix aggregation, text functions, joins, sets and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.functions import scalar
from rankforge.operators import contracts, matching, matrix, sampling
from rankforge.operators.ranking import position
from rankforge.plans.base import (
    CELLS, CONTEXTS, CUTOFF, END, PAIRS, RAW_LABELS, SAMPLES, SCORED, UNIVERSE,
    cells, contexts, pairs, query, raw_label, raw_label_sql, samples, scored, universe,
)
from rankforge.session import rounded, table

# splits and samples

DIGEST = "sha256('{seed}|' || CAST({key} AS VARCHAR))"


@query("p03_at_risk_universe", f"WITH {UNIVERSE} SELECT segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(popularity) AS BIGINT) AS popularity FROM universe GROUP BY 1")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    return universe(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.sum("popularity").alias("popularity"))


@query("p04_landmark_labels", f"WITH {PAIRS} SELECT part, segment, pre, post FROM pairs")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("part", "segment", "pre", "post")


_SPLIT = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {digest}) - 1 AS position, count(*) OVER (PARTITION BY {label}) AS size FROM {table}
), split AS (SELECT *, position < floor(size * 0.7::DOUBLE + 0.5) AS is_train FROM ranked)"""


@query(
    "m01_temporal_split",
    f"WITH {SCORED}, {_SPLIT.format(label='y', digest=DIGEST.format(seed=5, key='ord'), table='scored')} SELECT ord, y, is_train FROM split",
)
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(scored(spark, sf), "ord", "y", 5).select("ord", "y", "is_train")


@query(
    "m02_leaky_random_split",
    f"""WITH {PAIRS}, either AS (SELECT part, segment, part || '|' || segment AS key, greatest(pre, post) AS label FROM pairs),
{_SPLIT.format(label='label', digest=DIGEST.format(seed=6, key='key'), table='either')} SELECT part, segment, label, is_train FROM split""",
)
def m02(spark: SparkSession, sf: str) -> DataFrame:
    either = pairs(spark, sf).select("part", "segment", F.concat_ws("|", "part", "segment").alias("key"), F.greatest("pre", "post").alias("label"))
    return sampling.stratified_split(either, "key", "label", 6).select("part", "segment", "label", "is_train")


@query(
    "m03_capped_subset",
    f"""WITH {SCORED}, n AS (SELECT count(*) FILTER (y = 0) AS positives FROM scored), r AS (
  SELECT ord, y, row_number() OVER (PARTITION BY y ORDER BY {DIGEST.format(seed=3, key='ord')}) AS rn FROM scored
) SELECT ord, 1 - y AS label FROM r, n WHERE y = 0 OR rn <= positives""",
)
def m03(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("ord", (1 - F.col("y")).alias("label"))
    return sampling.capped_subset(rows, "ord", "label", 2 * rows.where("label = 1").count(), 3)


_STRATA = """filled AS (
  SELECT event_id, coalesce(event_type, 'unknown') AS event_type, CAST(user_id % 7 AS VARCHAR) AS cohort FROM events
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY event_type, cohort) AS n, row_number() OVER (PARTITION BY event_type, cohort ORDER BY {digest}, event_id) AS rn FROM filled
)"""


@query("m04_context_sample", f"WITH {_STRATA.format(digest=DIGEST.format(seed=20, key='event_id'))} SELECT event_id, event_type, cohort FROM counted WHERE n >= 40 AND rn <= 60")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("cohort"))
    return sampling.stratum_sample(rows, "event_id", ["event_type", "cohort"], 40, 60, 20)


@query("m05_protocol_selection", f"WITH {_STRATA.format(digest=DIGEST.format(seed=20250701, key='event_id'))} SELECT event_id, event_type, cohort FROM counted WHERE n >= 4 AND rn <= 32")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("cohort"))
    return sampling.stratum_sample(rows, "event_id", ["event_type", "cohort"], 4, 32, 20250701)


@query(
    "w03_first_n_by_hash",
    f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {DIGEST.format(seed=1, key='event_id')}, event_id) AS rn FROM events) WHERE rn <= 10",
)
def w03(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratum_sample(table(spark, sf, "events").select("event_id", "event_type"), "event_id", ["event_type"], 1, 10, 1)


@query(
    "w04_cover_then_fill",
    f"""WITH r AS (SELECT event_id, event_type, {DIGEST.format(seed=2, key='event_id')} AS d, row_number() OVER (PARTITION BY event_type ORDER BY {DIGEST.format(seed=2, key='event_id')}, event_id) AS rn FROM events)
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY (rn > 1)::INTEGER, d, event_id) AS place FROM r) WHERE place <= 50""",
)
def w04(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cover_then_fill(table(spark, sf, "events").select("event_id", "event_type"), "event_id", ["event_type"], 50, 2)


@query(
    "w05_donor_capped",
    f"""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY {DIGEST.format(seed=4, key='event_id')}, event_id) AS place FROM r WHERE rn <= 5) WHERE place <= 300""",
)
def w05(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.donor_capped(table(spark, sf, "events").select("event_id", "user_id"), "event_id", F.col("user_id"), 5, 300, 4)


@query(
    "w06_balanced_quota",
    f"""WITH g AS (SELECT 203 // count(DISTINCT event_type) AS quota FROM events), r AS (
  SELECT event_id, event_type, {DIGEST.format(seed=8, key='event_id')} AS d, row_number() OVER (PARTITION BY event_type ORDER BY {DIGEST.format(seed=8, key='event_id')}, event_id) AS rn FROM events)
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY (rn > quota)::INTEGER, d, event_id) AS place FROM r, g) WHERE place <= 203""",
)
def w06(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_subset(table(spark, sf, "events").select("event_id", "event_type"), "event_id", ["event_type"], 203, 8)


@query(
    "w09_first_by_order",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
)
def w09(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


# scalar functions

_LAST = "'0x' || substr(sha256({key}), {at}, 8)"


def _horner(key: str, modulus: int) -> str:
    out = "0"
    for at in range(1, 65, 8):
        out = f"(({out}) * {(1 << 32) % modulus} + CAST('0x' || substr(sha256({key}), {at}, 8) AS BIGINT)) % {modulus}"
    return out


@query(
    "f01_hash_folds",
    f"""SELECT p_partkey, CAST(CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 16) AS UBIGINT) % 5 AS INTEGER) AS prefix_fold,
       CAST({_horner("'audit-v1|' || p_partkey", 10)} AS INTEGER) AS salted_fold, sha256('7|' || p_partkey) AS digest, substr(sha256(p_name), 1, 16) AS short_name FROM part""",
)
def f01(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", scalar.prefix_fold(key, 5).alias("prefix_fold"), scalar.salted_fold(key, "audit-v1", 10).alias("salted_fold"),
        scalar.order_digest(key, 7).alias("digest"), F.substring(F.sha2("p_name", 256), 1, 16).alias("short_name"),
    )


@query(
    "f02_math",
    """SELECT p_partkey, round(ln(1 + p_retailprice), 9) AS log1p_price, round(log2(p_size + 1.0::DOUBLE) - log2(11.0::DOUBLE), 9) AS ratio, round(1 / (1 + exp(-p_size / 50.0::DOUBLE)), 9) AS squashed,
       least(greatest(p_size, 10), 40) AS clipped, round(tanh(p_size / 25.0::DOUBLE), 9) AS tanh_size, sign(p_size - 25) = sign(p_retailprice - 1000) AS concordant,
       round(sqrt(abs(p_size * p_retailprice)), 9) AS geometric FROM part""",
)
def f02(spark: SparkSession, sf: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", rounded(F.log1p(price)).alias("log1p_price"), rounded(scalar.log2_ratio(size, F.lit(10.0))).alias("ratio"), rounded(scalar.sigmoid(size / 50.0)).alias("squashed"),
        F.greatest(F.least(size, F.lit(40)), F.lit(10)).alias("clipped"), rounded(F.tanh(size / 25.0)).alias("tanh_size"),
        scalar.concordant(size - 25, price - 1000).alias("concordant"), rounded(scalar.geometric_mean(size, price)).alias("geometric"),
    )


_Q = "(SELECT quantile_cont(p_size, {0}) FROM part)"


@query(
    "f03_scaling",
    f"""SELECT p_partkey, round((p_size - {_Q.format(0.5)}) / CASE WHEN {_Q.format(0.75)} = {_Q.format(0.25)} THEN 1 ELSE {_Q.format(0.75)} - {_Q.format(0.25)} END, 9) AS robust_z,
       round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 9) AS z FROM part""",
)
def f03(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    stats = rows.agg(F.percentile("p_size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("p_size").alias("mean"), F.stddev_pop("p_size").alias("sd"))
    q = F.col("q")
    return rows.join(stats).select("p_partkey", rounded(scalar.robust_z(F.col("p_size"), q[0], q[1], q[2])).alias("robust_z"), rounded((F.col("p_size") - F.col("mean")) / F.col("sd")).alias("z"))


_CLEAN = "CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in scalar.SPELLINGS.items()) + " ELSE {t} END"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace({_CLEAN.format(t=f'''lower(trim(coalesce({x}, 'unknown')))''')}, '[^a-z0-9]+', '_', 'g'), '_')"


def _raw(key: str) -> str:
    return raw_label_sql(key)


@query("p11_clean_label", f"SELECT vec_id, {clean_sql(_raw('vec_id'))} AS cleaned FROM embeddings")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", scalar.clean_label(raw_label("vec_id")).alias("cleaned"))


def _any(x: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


COMPARTMENT_SQL = f"""CASE WHEN v = 'unknown' THEN v WHEN contains(v, 'cd8') THEN 'cd8_t' WHEN {_any('v', 'cd4', 'treg')} THEN 'cd4_t' WHEN contains(v, 'nk') THEN 'nk'
  WHEN starts_with(v, 't_') OR v = 't' OR contains(v, 't_cell') THEN 't_other' WHEN contains(v, 'b_cell') OR starts_with(v, 'b_') OR v = 'b' THEN 'b'
  WHEN {_any('v', 'mono', 'macro', 'myeloid', 'dc', 'dendritic')} THEN 'myeloid' WHEN {_any('v', 'tumor', 'malignant', 'melanoma', 'epithelial')} THEN 'tumour'
  WHEN {_any('v', 'fibro', 'strom', 'endo', 'pericyte')} THEN 'stromal' ELSE v END"""


@query("p10_compartment", f"WITH c AS (SELECT vec_id, {clean_sql(_raw('vec_id'))} AS v FROM embeddings) SELECT vec_id, {COMPARTMENT_SQL} AS compartment FROM c")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", scalar.compartment(raw_label("vec_id")).alias("compartment"))


@query(
    "p12_response",
    f"""WITH t AS (SELECT vec_id, trim(regexp_replace(upper(trim({_raw('vec_id')})), '[^A-Z0-9]+', ' ', 'g')) AS t FROM embeddings)
SELECT vec_id, CASE WHEN t IN ('NR', 'N', 'NO') THEN 'Non-responder' WHEN t IN ('R', 'Y', 'YES') THEN 'Responder'
  WHEN regexp_matches(t, 'NON ?RESP|NO RESPONSE|PROGRESSIVE DISEASE|\\bPD\\b|PROGRESSOR') THEN 'Non-responder'
  WHEN regexp_matches(t, 'COMPLETE RESPONSE|PARTIAL RESPONSE|\\bCR\\b|\\bPR\\b|\\bRESPONDER\\b') THEN 'Responder' END AS response FROM t""",
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", scalar.response(raw_label("vec_id")).alias("response"))


def _contains_sql(column: str, terms: tuple[str, ...]) -> str:
    return _any(f"lower(trim(coalesce({column}, 'unknown')))", *terms)


def view_sql() -> dict[str, str]:
    out = {"all": "TRUE", "melanoma": "lower(trim(coalesce(disease, 'unknown'))) = 'melanoma'", "nsclc": "lower(trim(coalesce(disease, 'unknown'))) = 'nsclc'"}
    for name, (column, terms, unless) in scalar.VIEW_TERMS.items():
        out[name] = _contains_sql(column, terms) + (f" AND NOT {_contains_sql(column, unless)}" if unless else "")
    return out


@query("p09_context_views", f"WITH {CONTEXTS} SELECT vec_id, " + ", ".join(f'({s}) AS "{n}"' for n, s in view_sql().items()) + " FROM contexts")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    return contexts(spark, sf).select("vec_id", *[c.alias(n) for n, c in scalar.views().items()])


_IDS = "CASE p_partkey % 6 WHEN 0 THEN 'P0' || p_partkey || '.post.0' || (p_partkey % 4 + 1) WHEN 1 THEN ' p00' || p_partkey WHEN 2 THEN 'P' || p_partkey || '.PRE.2' WHEN 3 THEN 'X-' || p_partkey WHEN 4 THEN 'Post-treatment_ ' || p_partkey ELSE 'Tumour  Lymph  NODE' END"


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr(_IDS).alias("raw"))


@query(
    "f04_identifiers",
    rf"""WITH r AS (SELECT p_partkey, {_IDS} AS raw FROM part), t AS (SELECT *, trim(raw) AS t FROM r)
SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)^P0*(\d+)\.(pre|post)\.0*(\d+)$') THEN 'P' || regexp_extract(t, '(?i)^P0*(\d+)\.', 1) || '.' || lower(regexp_extract(t, '(?i)\.(pre|post)\.', 1)) || '.' || regexp_extract(t, '\.0*(\d+)$', 1)
  WHEN regexp_matches(t, '(?i)^P0*(\d+)$') THEN 'P' || regexp_extract(t, '(?i)^P0*(\d+)$', 1) || '.pre' ELSE t END AS sample,
  CASE WHEN regexp_matches(t, '(?i)^P0*(\d+)$') THEN 'P' || regexp_extract(t, '(?i)^P0*(\d+)$', 1) ELSE t END AS patient,
  trim(regexp_replace(replace(lower(t), 'tumour', 'tumor'), '\s+', ' ', 'g')) AS site,
  trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(t), 'pretreatment', 'pre'), 'pre-treatment', 'pre'), 'posttreatment', 'post'), 'post-treatment', 'post'), '[_\-/\s]+', '.', 'g'), '\.+', '.', 'g'), '.') AS sample_key
FROM t""",
)
def f04(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    return _messy(spark, sf).select("p_partkey", scalar.sample_id(raw).alias("sample"), scalar.patient_id(raw).alias("patient"), scalar.site(raw).alias("site"), scalar.sample_key(raw).alias("sample_key"))


@query(
    "f05_snapshot_dates",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CAST(date_trunc('month', day) + INTERVAL 3 MONTH AS DATE) + CAST(least(day(day), 28) - 1 AS INTEGER) AS next_snapshot FROM d""",
)
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scalar.add_months_capped(F.to_date("o_orderdate"), 3).alias("next_snapshot"))


@query("f06_json_path", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, abs(value - round(value, 6)) <= 5e-7 AS close FROM events")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), scalar.close(value, F.round(value, 6)).alias("close"))


@query("f07_lenient_cast", "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS number, TRY_CAST(p_type AS DOUBLE) IS NULL AS failed FROM part")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("double")
    return table(spark, sf, "part").select("p_partkey", number.alias("number"), F.col("p_type").try_cast("double").isNull().alias("failed"))


@query(
    "p05_finite_filter",
    "SELECT event_id, value, CASE WHEN value > 50 THEN NULL ELSE value END AS kept, coalesce(CASE WHEN value > 50 THEN NULL ELSE value END, 0) AS zeroed FROM events WHERE value IS NOT NULL AND isfinite(value)",
)
def p05(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    sparse = F.when(value > 50, F.lit(float("inf"))).otherwise(value)
    rows = table(spark, sf, "events").where(scalar.finite(value))
    return rows.select("event_id", "value", F.when(scalar.finite(sparse), sparse).alias("kept"), scalar.finite_or_zero(sparse).alias("zeroed"))


@query("p07_membership", "SELECT count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_returnflag IN ('A', 'R')")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).join(parts, "l_partkey", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 6).alias("quantity"))


@query(
    "p13_status_columns",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Responder' WHEN 'O' THEN 'Non-responder' END AS mapped, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'MAPPED' ELSE 'UNMAPPED' END AS status, 'NOT_COMPUTED' AS target_status FROM orders",
)
def p13(spark: SparkSession, sf: str) -> DataFrame:
    mapped = F.create_map(F.lit("F"), F.lit("Responder"), F.lit("O"), F.lit("Non-responder"))[F.col("o_orderstatus")]
    rows = table(spark, sf, "orders").select("o_orderkey", mapped.alias("mapped"))
    return rows.withColumn("status", F.when(F.col("mapped").isNotNull(), "MAPPED").otherwise("UNMAPPED")).withColumn("target_status", F.lit("NOT_COMPUTED"))


# matrix aggregation


@query("a01_pseudobulk", f"WITH {CELLS} SELECT gene, sample, round(sum(value), 6) AS total FROM cells GROUP BY 1, 2")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.group_sums(cells(spark, sf), ["sample"]).select("gene", "sample", rounded("total", 6).alias("total"))


_STATUS = """statuses AS (SELECT o_orderkey AS cell, o_orderstatus AS grp FROM orders), sizes AS (SELECT grp, count(*) AS n_cells FROM statuses GROUP BY 1)"""


def _status_cells(spark: SparkSession, sf: str, column: str = "o_orderstatus") -> tuple[DataFrame, DataFrame]:
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), F.col(column).alias("grp"))
    return cells(spark, sf).join(groups, "cell"), groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"))


@query("a03_group_mean_with_zeros", f"WITH {CELLS}, {_STATUS} SELECT gene, grp, round(sum(value) / any_value(n_cells), 9) AS mean FROM cells JOIN statuses USING (cell) JOIN sizes USING (grp) GROUP BY 1, 2")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    grouped, sizes = _status_cells(spark, sf)
    return matrix.group_means(grouped, sizes, ["grp"]).select("gene", "grp", rounded("mean").alias("mean"))


@query(
    "a04_fraction_positive",
    f"WITH {CELLS} SELECT gene, round(count(*) FILTER (value > 0) / (SELECT count(*) FROM orders)::DOUBLE, 9) AS fraction_positive, round(sum(value) / (SELECT count(*) FROM orders), 9) AS mean_per_cell FROM cells GROUP BY 1",
)
def a04(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").count()
    out = matrix.cell_summary(cells(spark, sf), F.lit(n))
    return out.select("gene", rounded("fraction_positive").alias("fraction_positive"), rounded("mean_per_cell").alias("mean_per_cell"))


_CPM = """sums AS (SELECT gene, sample, sum(value) AS total FROM cells GROUP BY 1, 2),
cpm AS (SELECT *, total / greatest(sum(total) OVER (PARTITION BY sample), 1) * 1000000 AS cpm FROM sums)"""


@query("a05_library_cpm_log", f"WITH {CELLS}, {_CPM} SELECT gene, sample, round(cpm, 6) AS cpm, round(ln(1 + cpm), 9) AS log_cpm FROM cpm")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    out = matrix.cpm(matrix.group_sums(cells(spark, sf), ["sample"]))
    return out.select("gene", "sample", rounded("cpm", 6).alias("cpm"), rounded("log_cpm").alias("log_cpm"))


@query(
    "a06_group_contrast",
    f"""WITH {CELLS}, {SAMPLES}, {_CPM}, n AS (SELECT count(*) FILTER (region = 'ASIA') AS na, count(*) FILTER (region = 'EUROPE') AS ne FROM samples)
SELECT gene, round(CASE WHEN any_value(na) > 0 THEN coalesce(sum(ln(1 + cpm)) FILTER (region = 'ASIA'), 0) / any_value(na) END - CASE WHEN any_value(ne) > 0 THEN coalesce(sum(ln(1 + cpm)) FILTER (region = 'EUROPE'), 0) / any_value(ne) END, 9) AS delta
FROM cpm JOIN samples USING (sample), n GROUP BY 1""",
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    meta = samples(spark, sf)
    sizes = meta.groupBy().agg(F.count_if(F.col("region") == "ASIA").alias("na"), F.count_if(F.col("region") == "EUROPE").alias("ne")).first()
    logged = matrix.cpm(matrix.group_sums(cells(spark, sf), ["sample"])).join(meta, "sample")
    out = matrix.contrast(logged, F.col("region") == "ASIA", F.col("region") == "EUROPE", F.lit(sizes["na"]), F.lit(sizes["ne"]))
    return out.select("gene", rounded("delta").alias("delta"))


@query(
    "a07_log2_ratio_of_means",
    f"""WITH {CELLS}, {_STATUS}, m AS (SELECT gene, grp, sum(value) / any_value(n_cells) AS mean FROM cells JOIN statuses USING (cell) JOIN sizes USING (grp) GROUP BY 1, 2)
SELECT gene, round(log2(coalesce(max(mean) FILTER (grp = 'F'), 0) + 1) - log2(coalesce(max(mean) FILTER (grp = 'O'), 0) + 1), 9) AS ratio FROM m GROUP BY 1""",
)
def a07(spark: SparkSession, sf: str) -> DataFrame:
    grouped, sizes = _status_cells(spark, sf)
    side = lambda g: F.coalesce(F.max(F.when(F.col("grp") == g, F.col("mean"))), F.lit(0.0))
    return matrix.group_means(grouped, sizes, ["grp"]).groupBy("gene").agg(rounded(scalar.log2_ratio(side("F"), side("O"))).alias("ratio"))


@query(
    "a08_specificity",
    f"""WITH {CELLS}, statuses AS (SELECT o_orderkey AS cell, o_orderpriority AS grp FROM orders), sizes AS (SELECT grp, count(*) AS n_cells FROM statuses GROUP BY 1),
m AS (SELECT gene, grp, sum(value) / any_value(n_cells) AS mean FROM cells JOIN statuses USING (cell) JOIN sizes USING (grp) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mean DESC, grp) AS rn FROM m)
SELECT gene, round(max(mean) / greatest(sum(mean), 1e-12), 9) AS specificity, max(grp) FILTER (rn = 1) AS dominant FROM r GROUP BY 1""",
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    grouped, sizes = _status_cells(spark, sf, "o_orderpriority")
    out = matrix.specificity(matrix.group_means(grouped, sizes, ["grp"]), "grp")
    return out.select("gene", rounded("specificity").alias("specificity"), "dominant")


@query(
    "a09_first_size_nunique",
    "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_types, arg_min(event_type, event_id) AS first_type FROM events GROUP BY 1",
)
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_types"), F.min_by("event_type", "event_id").alias("first_type"))


@query("a10_joined_strings", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types FROM events GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("event_type"))).alias("types"))


@query("a11_mean_over_repeats", f"WITH {CELLS}, {SAMPLES}, {_CPM} SELECT gene, region, round(avg(log2(cpm + 1)), 9) AS mean FROM cpm JOIN samples USING (sample) GROUP BY 1, 2")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    logged = matrix.cpm(matrix.group_sums(cells(spark, sf), ["sample"]), log="log2").join(samples(spark, sf), "sample")
    return logged.groupBy("gene", "region").agg(rounded(F.avg("log_cpm")).alias("mean"))


@query("a14_value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


_EDGES_SQL = """e AS (SELECT DISTINCT least('p' || l_partkey, 's' || l_suppkey) AS a, greatest('p' || l_partkey, 's' || l_suppkey) AS b FROM lineitem),
deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1)"""


@query(
    "a22_degree_centrality",
    f"WITH {_EDGES_SQL} SELECT 'p' || p_partkey AS node, round(coalesce(degree / ((SELECT count(*) FROM deg) - 1)::DOUBLE, 0), 9) AS centrality FROM part LEFT JOIN deg ON node = 'p' || p_partkey",
)
def a22(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return matrix.degree_centrality(edges, nodes).select("node", rounded("centrality").alias("centrality"))


# joins and sets


@query(
    "j01_one_to_one",
    "SELECT a.p_partkey, a.p_size AS p_size_x, b.p_size + 1 AS p_size_y FROM part a JOIN part b ON a.p_partkey = b.p_partkey WHERE b.p_size > 25",
)
def j01(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return matching.one_to_one(parts, parts.where("p_size > 25").select("p_partkey", (F.col("p_size") + 1).alias("p_size")), ["p_partkey"])


@query("j02_covered_left_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return matching.require_unique(suppliers, ["s_suppkey"]).join(matching.require_unique(nations, ["n_nationkey"]), "n_nationkey", "left").select("s_suppkey", "n_name")


_LAYERS = """a AS (SELECT l_partkey AS gene, round(avg(l_quantity), 9) AS mean_counts FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey AS gene, round(avg(l_extendedprice), 6) AS mean_tpm FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


@query("j03_full_outer", f"WITH {_LAYERS} SELECT coalesce(a.gene, b.gene) AS gene, mean_counts, mean_tpm FROM a FULL JOIN b ON a.gene = b.gene")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "gene")
    a = lines.where("l_returnflag = 'A'").groupBy("gene").agg(rounded(F.avg("l_quantity")).alias("mean_counts"))
    b = lines.where("l_returnflag = 'R'").groupBy("gene").agg(rounded(F.avg("l_extendedprice"), 6).alias("mean_tpm"))
    return a.join(b, "gene", "full")


@query("j04_lookup_default", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON c_nationkey = n_nationkey")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").where("n_nationkey % 3 > 0").withColumnRenamed("n_nationkey", "c_nationkey")
    out = matching.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name", F.lit("none"))
    return out.select("c_custkey", "n_name")


@query("j05_two_hop_lookup", "SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select(F.col("sample").alias("s_suppkey"), F.col("region").alias("r_name"))


@query("j06_semi_join", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(lines, "p_partkey", "left_semi")


@query("j07_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(lines, "p_partkey", "left_anti")


@query(
    "j08_ordered_alignment",
    """SELECT bool_and(k = r) AS by_balance, bool_and(k = n) AS by_name
FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS k, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, row_number() OVER (ORDER BY s_name, s_suppkey) AS n FROM supplier)""",
)
def j08(spark: SparkSession, sf: str) -> DataFrame:
    """Whether suppliers in the order of their balances, and of their names, are in the order of their keys."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", "s_name")
    listed = lambda *order: position(rows, [], order).select(F.col("position").alias("ord"), "id")
    got = [matching.same_order(listed("id"), listed(c, "id")).select(F.col("aligned").alias(name)) for c, name in (("s_acctbal", "by_balance"), ("s_name", "by_name"))]
    return got[0].join(got[1])


_WANTED = """wanted AS (SELECT s_suppkey AS wanted_id, s_nationkey AS patient, row_number() OVER (ORDER BY s_suppkey) AS i,
  'S' || CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey WHEN s_suppkey % 7 = 0 THEN s_suppkey - 7 WHEN s_suppkey % 11 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS normal_id FROM supplier),
available AS (SELECT 'S' || s_suppkey AS sample, s_nationkey AS patient FROM supplier WHERE s_suppkey % 8 <> 4)"""


@query(
    "j09_entity_resolution",
    f"""WITH RECURSIVE {_WANTED}, pool AS (SELECT patient, list(sample) AS samples FROM available GROUP BY 1),
rows AS MATERIALIZED (SELECT w.*, coalesce(samples, []) AS samples, normal_id IN (SELECT sample FROM available) AS there FROM wanted w LEFT JOIN pool USING (patient)),
loop AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS wanted_id, NULL::VARCHAR AS sample, '' AS status, []::VARCHAR[] AS used
  UNION ALL
  SELECT i, wanted_id, sample, status, CASE WHEN sample IS NULL THEN used ELSE list_append(used, sample) END FROM (
    SELECT r.i, r.wanted_id, l.used,
           CASE WHEN r.there AND NOT list_contains(l.used, r.normal_id) THEN r.normal_id
                WHEN len(list_filter(r.samples, lambda s: NOT list_contains(l.used, s))) = 1 THEN list_filter(r.samples, lambda s: NOT list_contains(l.used, s))[1] END AS sample,
           CASE WHEN r.there AND NOT list_contains(l.used, r.normal_id) THEN 'EXACT_NORMALISED_ID'
                WHEN len(list_filter(r.samples, lambda s: NOT list_contains(l.used, s))) = 1 THEN 'FALLBACK_UNIQUE_UNMATCHED_PATIENT_TIMEPOINT' ELSE 'UNRESOLVED' END AS status
    FROM loop l JOIN rows r ON r.i = l.i + 1
  )
)
SELECT wanted_id, sample, status FROM loop WHERE i > 0""",
)
def j09(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that ask for their own sample, a lost one, an earlier supplier's or a later one's."""
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier")
    asked = F.when(key % 4 == 0, -key).when(key % 7 == 0, key - 7).when(key % 11 == 0, key + 1).otherwise(key)
    sample = lambda k: F.concat(F.lit("S"), k.cast("string"))
    wanted = rows.select(key.alias("wanted_id"), key.alias("ord"), F.col("s_nationkey").alias("patient"), sample(asked).alias("normal_id"))
    return matching.resolve_entities(wanted, rows.where(key % 8 != 4).select(sample(key).alias("sample"), F.col("s_nationkey").alias("patient")))


_METHODS = "m AS (SELECT l_suppkey AS replicate, l_returnflag AS method, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def _method_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("replicate"), F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("value"))


@query(
    "j10_method_pairs",
    f"WITH {_METHODS} SELECT a.method AS first, b.method AS second, round(avg(a.value - b.value), 9) AS mean_difference, count(*) AS n FROM m a JOIN m b ON a.replicate = b.replicate AND a.method < b.method GROUP BY 1, 2",
)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    values = _method_values(spark, sf)
    b = values.select("replicate", F.col("method").alias("second"), F.col("value").alias("other"))
    both = values.join(b, "replicate").where(F.col("method") < F.col("second"))
    return both.groupBy(F.col("method").alias("first"), "second").agg(rounded(F.avg(F.col("value") - F.col("other"))).alias("mean_difference"), F.count(F.lit(1)).alias("n"))


@query("j11_against_reference", f"WITH {_METHODS} SELECT a.method, round(avg(a.value - r.value), 9) AS excess FROM m a JOIN m r ON a.replicate = r.replicate AND r.method = 'N' GROUP BY 1")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    values = _method_values(spark, sf)
    reference = values.where("method = 'N'").select("replicate", F.col("value").alias("base"))
    return values.join(reference, "replicate").groupBy("method").agg(rounded(F.avg(F.col("value") - F.col("base"))).alias("excess"))


@query(
    "j12_leave_one_group_out",
    """WITH cents AS (SELECT p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)
SELECT g.p_brand, (SELECT CAST(sum(c) AS DOUBLE) / count(c) FROM cents r WHERE r.p_brand <> g.p_brand) / 100 AS mean_without FROM (SELECT DISTINCT p_brand FROM part) g""",
)
def j12(spark: SparkSession, sf: str) -> DataFrame:
    """Prices are summed as whole cents: sums of doubles in another order differ where a mean lies between two printed digits."""
    cents = table(spark, sf, "part").select("p_brand", F.round(F.col("p_retailprice") * 100).cast("long").alias("c"))
    return matching.leave_one_out(cents, "p_brand", "c").select("p_brand", (F.col("mean_without") / 100).alias("mean_without"))


@query("a17_conflicts", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return matching.conflicts(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query(
    "a25_identifier_overlap",
    """WITH a AS (SELECT DISTINCT lower(trim(p_type)) AS k FROM part), b AS (SELECT DISTINCT lower(trim(' ' || p_type || ' ')) AS k FROM part WHERE p_size > 48 UNION SELECT 'other')
SELECT (SELECT count(*) FROM a) AS left, (SELECT count(*) FROM b) AS right, (SELECT count(*) FROM a JOIN b USING (k)) AS shared""",
)
def a25(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    b = parts.where("p_size > 48").select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("id")).union(spark.range(1).select(F.lit("other").alias("id")))
    return matching.normal_overlap(parts.select(F.col("p_type").alias("id")), b)


@query(
    "u01_set_operations",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT 'union_all' AS op, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""",
)
def u01(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    a, b = (lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k")).distinct() for flag in ("A", "R"))
    sized = lambda name, df: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    out = sized("union_all", a.unionByName(b)).union(sized("intersect", a.intersect(b))).union(sized("except", a.subtract(b)))
    return out.union(sized("symmetric", a.exceptAll(b).union(b.exceptAll(a))))


@query(
    "u06_pivot",
    "SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1",
)
def u06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(rounded(F.sum("l_quantity"), 6))


# gates and contracts

_THRESHOLDS = {"positive_pairs": 20, "positive_genes": 10, "indications_with_positive": 3, "holdout_positive_pairs": 5, "holdout_positive_genes": 1_000_000}


@query(
    "a12_power_gate",
    f"""WITH {PAIRS}, p AS (SELECT part, segment, part % 10 AS fold, post FROM pairs), v AS (
  SELECT count(*) FILTER (post = 1) AS positive_pairs, count(DISTINCT part) FILTER (post = 1) AS positive_genes, count(DISTINCT segment) FILTER (post = 1) AS indications_with_positive,
         count(*) FILTER (post = 1 AND fold = 9) AS holdout_positive_pairs, count(DISTINCT part) FILTER (post = 1 AND fold = 9) AS holdout_positive_genes FROM p
), f AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {n} < {t} THEN '{n}' END" for n, t in _THRESHOLDS.items())}) AS failures FROM v)
SELECT *, CASE WHEN failures = '' THEN 'PASS' ELSE 'WAIT' END AS gate FROM f""",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).select("part", "segment", (F.col("part") % 10).alias("fold"), "post")
    return contracts.power_gate(rows, "part", "segment", "fold", "post", 9, _THRESHOLDS)


@query(
    "c01_table_contract",
    """SELECT 'label_is_binary' AS name, count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) AS bad_rows, 'PASS' AS status FROM labels UNION ALL
SELECT 'toxic_is_zero', count(*) FILTER (toxic <> 0), CASE WHEN count(*) FILTER (toxic <> 0) = 0 THEN 'PASS' ELSE 'WARNING' END FROM labels UNION ALL
SELECT 'unique_key', CAST(count(*) - count(DISTINCT doc_id) AS BIGINT), 'PASS' FROM labels""",
)
def c01(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    contracts.require_columns(labels, ["doc_id", "quality", "toxic"])
    rules = {"label_is_binary": F.col("quality").isNull() | ~F.col("quality").isin(0, 1), "toxic_is_zero": F.col("toxic") != 0}
    return contracts.judged(contracts.violations(labels, rules).union(contracts.repeats(labels, ["doc_id"])), ["toxic_is_zero"])


_CANDIDATES = f"""{PAIRS}, candidates AS (
  SELECT CASE WHEN part % 113 > 0 THEN CAST(part AS VARCHAR) ELSE '0' END AS gene_id, ['biology_signal', 'popularity_only', 'noise', 'other'][CASE WHEN part % 211 = 0 THEN 4 ELSE part % 3 + 1 END] AS planted_group,
         CASE WHEN part % 131 > 0 THEN CAST(year(entry) AS INTEGER) END AS entry_year, pre AS label_pre_cutoff, CASE WHEN part % 89 = 0 THEN 1 ELSE post END AS label_post_cutoff,
         popularity AS publication_count_pre_cutoff, popularity + part % 5 - 1 AS publication_count_all_time, p_retailprice AS price, p_size AS size
  FROM pairs JOIN part ON p_partkey = part WHERE segment = 'BUILDING'
)"""
_CANDIDATE_RULES = {
    "gene_is_named": ("gene_id IS NULL", "FAIL"), "numbers_are_finite": ("NOT isfinite(price)", "FAIL"), "labels_are_binary": ("label_post_cutoff NOT IN (0, 1)", "FAIL"),
    "labels_do_not_overlap": ("label_pre_cutoff = 1 AND label_post_cutoff = 1", "FAIL"), "labels_follow_entry": ("label_pre_cutoff + label_post_cutoff = 1 AND entry_year IS NULL", "FAIL"),
    "group_is_known": ("planted_group = 'other'", "FAIL"), "popularity_only_never_enters": ("planted_group = 'popularity_only' AND label_post_cutoff = 1", "FAIL"),
    "class_is_binary": ("size % 7 > 1 AND size = 50", "FAIL"), "cutoff_before_end": ("FALSE", "FAIL"), "counts_are_not_negative": ("publication_count_all_time < 0", "WARNING"),
    "counts_grow": ("publication_count_all_time < publication_count_pre_cutoff", "WARNING"), "shares_in_range": ("size > 48", "WARNING"),
}


@query(
    "c01_candidate_contract",
    f"""WITH {_CANDIDATES}, bad AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({rule}) AS bad_rows, '{worst}' AS worst FROM candidates" for n, (rule, worst) in _CANDIDATE_RULES.items())}
UNION ALL SELECT 'gene_is_unique', count(*) - count(DISTINCT gene_id), 'FAIL' FROM candidates) SELECT name, bad_rows, CASE WHEN bad_rows = 0 THEN 'PASS' ELSE worst END AS status FROM bad""",
)
def c01_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The 17-column contract over candidates made of the parts of one segment, with faults planted by their keys."""
    part, key = table(spark, sf, "part"), F.col("part")
    rows = pairs(spark, sf).where("segment = 'BUILDING'").join(part, F.col("part") == F.col("p_partkey"))
    group = F.when(key % 211 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, contracts.PLANTED)), (key % 3 + 1).cast("int")))
    size, price, share = F.col("p_size"), F.col("p_retailprice"), F.col("p_size") / 48.0
    made = rows.select(
        F.when(key % 113 > 0, key.cast("string")).otherwise("0").alias("gene_id"), group.alias("planted_group"), F.when(key % 131 > 0, F.year("entry")).alias("entry_year"),
        F.col("pre").alias("label_pre_cutoff"), F.when(key % 89 == 0, 1).otherwise(F.col("post")).alias("label_post_cutoff"),
        F.col("popularity").alias("publication_count_pre_cutoff"), (F.col("popularity") + key % 5 - 1).alias("publication_count_all_time"),
        price.alias("mean_expression_id"), (price * 1.1).alias("mean_expression_ood"), (size - 25.0).alias("differential_expression_id"), (size - 24.0).alias("differential_expression_ood"),
        share.alias("cell_type_specificity_id"), (share / 2).alias("cell_type_specificity_ood"), (share / 3).alias("network_centrality"),
        F.when(size == 50, size % 7).otherwise(size % 2).alias("druggable_class"), F.lit(1996).alias("cutoff_year"), F.lit(1997).alias("evaluation_end_year"),
    )
    return contracts.candidate_contract(made)


_CONTEXT_ROWS = f"""{CONTEXTS}, idx AS (
  SELECT vec_id AS row, 'g' || CAST(CASE WHEN vec_id % 101 = 0 THEN 1 ELSE vec_id END AS VARCHAR) AS gene_id, coalesce(disease, 'unknown') AS disease, 'c' AS cell_compartment, 't' || CAST(vec_id % 3 AS VARCHAR) AS treatment_state,
         'r' AS response_state, vec_id % 50 AS n_cells, vec_id % 4 + 1 AS n_samples FROM contexts
)"""


@query(
    "c04_context_artefact",
    f"""WITH {_CONTEXT_ROWS}, bad AS (
SELECT unnest(['index_exists', 'pretrained_exists', 'random_exists', 'index_hash', 'pretrained_hash', 'random_hash', 'protocol_hash', 'index_schema', 'matrix_shape_match', 'finite_embeddings', 'nondegenerate_pretrained', 'nondegenerate_random', 'context_count']) AS name,
       unnest([0, 0, 0, 0, 0, 1, 0, 0, 1, 0, (SELECT CAST(var_pop(x) <= 0 AS INTEGER) FROM (SELECT unnest(embedding) AS x FROM embeddings)), 0,
               (SELECT CAST(abs(count(*) - 12) AS INTEGER) FROM (SELECT DISTINCT disease, treatment_state FROM idx))]) AS bad
UNION ALL SELECT 'positive_support_counts', count(*) FILTER (n_cells <= 0 OR n_samples <= 0) FROM idx
UNION ALL SELECT 'multi_sample_support', count(*) FILTER (n_samples < 2) FROM idx
UNION ALL SELECT 'unique_gene_context_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT gene_id, disease, treatment_state FROM idx)) FROM idx
) SELECT name, CAST(bad AS BIGINT) AS bad, CASE WHEN bad = 0 THEN 'PASS' WHEN name = 'multi_sample_support' THEN 'WARNING' ELSE 'FAIL' END AS status FROM bad""",
)
def c04_artefact(spark: SparkSession, sf: str) -> DataFrame:
    """16 invariants of an artefact whose random control lost a row after it was sealed; 12 contexts are declared."""
    from rankforge.plans.io import _folder
    from rankforge.sources import sinks

    folder, key = _folder(spark), F.col("vec_id")
    source = contexts(spark, sf)
    index = source.select(
        key.alias("row"), F.concat(F.lit("g"), F.when(key % 101 == 0, F.lit(1)).otherwise(key).cast("string")).alias("gene_id"), F.coalesce("disease", F.lit("unknown")).alias("disease"), F.lit("c").alias("cell_compartment"),
        F.concat(F.lit("t"), (key % 3).cast("string")).alias("treatment_state"), F.lit("r").alias("response_state"), (key % 50).alias("n_cells"), (key % 4 + 1).alias("n_samples"),
    )
    vectors = source.select(key.alias("row"), "embedding")
    control = source.select(key.alias("row"), F.transform("embedding", lambda x: x + 100).alias("embedding"))
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    for name, df in (("index", index), ("pretrained", vectors), ("random", control)):
        sinks.seal(df.select([c if t != "array<float>" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]), f"{folder}/{name}", name)
        df.write.mode("overwrite").parquet(f"{folder}/{name}/vectors")
    least = vectors.agg(F.min("row")).first()[0]
    lost = spark.read.parquet(f"{folder}/random/vectors").where(F.col("row") != least)
    sinks.write_table(lost.select("row", F.col("embedding").cast("string").alias("embedding")), f"{folder}/random/data")
    intact = {name: not sinks.verify_seal(spark, f"{folder}/{name}") for name in ("index", "pretrained", "random")}
    manifest = {"rows": n, "width": width, "contexts": 12, "protocol_sha256": "ab"}
    return contracts.context_artefact(index, spark.read.parquet(f"{folder}/pretrained/vectors"), lost, manifest, intact, "ab")


@query(
    "c03_leakage_status",
    """WITH n AS (SELECT DISTINCT lower(trim(text)) AS k FROM benchmark), s AS (SELECT source, count(DISTINCT k) AS shared, count(*) AS n FROM documents LEFT JOIN n ON k = lower(trim(text)) GROUP BY 1)
SELECT source, shared, CASE WHEN source = 'src0' THEN 'UNRESOLVED' WHEN shared > 0 THEN 'OVERLAP' ELSE 'CLEAN' END AS status FROM s""",
)
def c03(spark: SparkSession, sf: str) -> DataFrame:
    rows = matching.overlap_by_group(table(spark, sf, "documents").select("source", "text"), table(spark, sf, "benchmark").select("text"), "source")
    return rows.withColumn("status", contracts.leakage_status(F.col("shared"), F.col("source") != "src0"))


@query(
    "c04_vector_audit",
    """SELECT 'finite' AS name, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS bad_rows, 'PASS' AS status FROM embeddings UNION ALL
SELECT 'one_width', (SELECT count(DISTINCT len(embedding)) - 1 FROM embeddings), 'PASS' UNION ALL SELECT 'unique_key', (SELECT count(*) - count(DISTINCT vec_id) FROM embeddings), 'PASS'""",
)
def c04(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    widths = rows.agg(F.lit("one_width").alias("name"), (F.count_distinct(F.size("embedding")) - 1).alias("bad_rows"))
    return contracts.judged(contracts.violations(rows, {"finite": ~finite}).union(widths).union(contracts.repeats(rows, ["vec_id"])))


@query(
    "c10_status_roll_up",
    """SELECT CASE WHEN (SELECT count(*) FROM labels WHERE toxic <> 0) > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
       2::BIGINT + ((SELECT count(*) FROM labels WHERE toxic <> 0) = 0)::BIGINT AS n_pass, ((SELECT count(*) FROM labels WHERE toxic <> 0) > 0)::BIGINT AS n_warning, 0::BIGINT AS n_fail""",
)
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.overall(c01(spark, sf))


@query(
    "k09_content_seal",
    """WITH h AS (SELECT CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR) || chr(31) || p_name || chr(31) || p_brand || chr(31) || CAST(p_size AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM part)
SELECT count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h""",
)
def k09(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.content_seal(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_size"])


@query(
    "x01_rollup_extension",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def x01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 6).alias("quantity"))
