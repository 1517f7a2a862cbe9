"""Smaller operators: projections, array blocks, weighted counts, header and JSON checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import scalar
from rankforge.operators import contracts, matching
from rankforge.plans.base import CONTEXTS, SCORED, contexts, query, scored
from rankforge.session import rounded, table
from rankforge.sources import readers


@query("p01_projection", "SELECT p_partkey AS gene_id, p_name AS gene_symbol, p_size * 2 AS doubled FROM part")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumnsRenamed({"p_partkey": "gene_id", "p_name": "gene_symbol"}).withColumn("doubled", F.col("p_size") * 2).select("gene_id", "gene_symbol", "doubled")


@query(
    "p02_templated_columns",
    "SELECT p_retailprice AS mean_expression_ood, p_size + 1 AS differential_expression_ood, p_size + 2 AS cell_type_specificity_ood, p_size + 3 AS network_centrality, p_size % 2 AS druggable_class FROM part",
)
def p02(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    wide = table(spark, sf, "part").select(
        F.col("p_retailprice").alias("mean_expression_ood"), (size + 1).alias("differential_expression_ood"), (size + 2).alias("cell_type_specificity_ood"),
        (size + 3).alias("network_centrality"), (size % 2).alias("druggable_class"), size.alias("mean_expression_id"), size.alias(scalar.POPULARITY),
    )
    return wide.select(*scalar.feature_columns("ood", popularity=False))


@query("p06_infinite_to_zero", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS cleaned FROM events")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 8 == 0, F.lit(float("-inf"))).when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", scalar.finite_or_zero(odd).alias("cleaned"))


@query("p08_contains_any", "SELECT doc_id, contains(lower(trim(coalesce(source, 'unknown'))), 'c1') OR contains(lower(trim(coalesce(source, 'unknown'))), 'rc7') AS hit FROM documents")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", scalar.contains_any(F.col("source"), ("c1", "rc7")).alias("hit"))


@query("p15_concordance", f"WITH {SCORED} SELECT ord, sign(score - 4) = sign(alt - 3000) AS concordant, round(sqrt(abs((score - 4) * (alt - 3000))), 9) AS strength FROM scored")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("score") - 4, F.col("alt") - 3000
    return scored(spark, sf).select("ord", scalar.concordant(a, b).alias("concordant"), rounded(scalar.geometric_mean(a, b)).alias("strength"))


@query("a02_weighted_counts", "SELECT l_suppkey, l_returnflag, round(sum(l_quantity * (1 - l_discount)), 6) AS weight FROM lineitem GROUP BY 1, 2")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(rounded(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 6).alias("weight"))


@query("u04_set_equality", "SELECT c_nationkey, count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer) AS same FROM customer GROUP BY 1")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    """Which nations' customers have the same set of segments as all customers."""
    customers = table(spark, sf, "customer")
    every = customers.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("every"))
    own = customers.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("own"))
    return own.crossJoin(F.broadcast(every)).select("c_nationkey", (F.col("own") == F.col("every")).alias("same"))


@query(
    "u05_column_blocks",
    f"""WITH {CONTEXTS}, b AS (SELECT vec_id, list_concat(embedding[len(embedding) // 2 + 1:len(embedding)], embedding[1:len(embedding) // 2]) AS v FROM contexts)
SELECT vec_id, len(v) AS width, list_transform(v, lambda x: round(x::DOUBLE, 6)) AS vector FROM b""",
)
def u05(spark: SparkSession, sf: str) -> DataFrame:
    """Both halves of every vector, the second one first."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    both = F.concat(F.slice("embedding", half + 1, F.size("embedding") - half), F.slice("embedding", F.lit(1), half))
    return contexts(spark, sf).select("vec_id", F.size(both).alias("width"), F.transform(both, lambda x: rounded(x.cast("double"), 6)).alias("vector"))


@query("s04_header_alignment", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM customer)")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.read.parquet(f"{sf}/customer.parquet").columns
    readers.check_alignment(names, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("k04_canonical_json_digest", "SELECT n_nationkey, sha256('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}') AS digest FROM nation")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))), 256).alias("digest"))


@query(
    "c06_gate_input_guard",
    "SELECT 'score_like_columns' AS name, 0::BIGINT AS bad_rows, 'PASS' AS status UNION ALL SELECT 'unique_pair', (SELECT count(*) - count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem), 'FAIL'",
)
def c06(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    contracts.refuse_columns(pairs)
    named = spark.range(1).select(F.lit("score_like_columns").alias("name"), F.lit(0).cast("long").alias("bad_rows"))
    return contracts.judged(named.union(contracts.repeats(pairs, ["l_partkey", "l_suppkey"], "unique_pair")))


@query("c07_frozen_pairs_alignment", "SELECT TRUE AS aligned, count(*) FILTER (s_acctbal < 0) = 0 AS after_change FROM supplier")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen pairs against the same rows in another layout, and after the ids of suppliers in debt have changed."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("id"), "s_acctbal")
    changed = rows.withColumn("id", F.when(F.col("s_acctbal") < 0, F.upper("id")).otherwise(F.col("id"))).select("ord", "id")
    rows = rows.select("ord", "id")
    return matching.same_order(rows, rows.repartition(3)).join(matching.same_order(rows, changed).select(F.col("aligned").alias("after_change")))
