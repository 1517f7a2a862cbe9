"""Registration of queries, and the frames that bind the audit's concepts to the driver tables.

Bindings: a gene is a part, an indication a market segment, an entry the first
order of a part from a segment; a count matrix is (part, order) with quantities,
a sample a supplier; cells with contexts are events; labels are documents'
quality marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators.sampling import at_risk, landmark_labels
from rankforge.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CUTOFF, END = "1996-01-01", "1997-01-01"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """ord, y, context, score (coarse, with ties), alt (fine), p (in [0, 1])."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    joined = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")
    n = F.col("n_chars")
    return joined.select(
        F.col("doc_id").alias("ord"), F.col("quality").alias("y"), F.col("lang").alias("context"), F.floor(n / 500).cast("double").alias("score"),
        n.cast("double").alias("alt"), F.least(F.lit(1.0), n / 5000.0).alias("p"),
    )


SCORED = """scored AS (
  SELECT l.doc_id AS ord, l.quality AS y, d.lang AS context, CAST(floor(d.n_chars / 500) AS DOUBLE) AS score, CAST(d.n_chars AS DOUBLE) AS alt,
         least(1.0::DOUBLE, d.n_chars / 5000.0::DOUBLE) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """part, segment, entry, pre, post, popularity, ord: one row per part and segment."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    dated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    # one aggregation of the joined lines: the first entry into each segment, and how many lines came before the cutoff
    early = F.count_if(F.col("o_orderdate") < F.to_timestamp(F.lit(CUTOFF)))
    by_segment = dated.groupBy(F.col("l_partkey").alias("part"), F.col("c_mktsegment").alias("segment")).agg(F.min("o_orderdate").alias("entry"), early.alias("n"))
    by_part = by_segment.groupBy("part").agg(F.sum("n").alias("popularity"), F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "entry"))).alias("entries"))
    segments = customers.where("c_mktsegment IS NOT NULL").groupBy().agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    known = table(spark, sf, "part").select(F.col("p_partkey").alias("part")).join(by_part, "part", "left").crossJoin(F.broadcast(segments))
    grid = known.select("part", F.coalesce("popularity", F.lit(0)).alias("popularity"), F.map_from_entries(F.coalesce("entries", F.array().cast("array<struct<segment:string,entry:timestamp>>"))).alias("entries"), F.explode("segments").alias("segment"))
    full = grid.select("part", "segment", F.try_element_at("entries", F.col("segment")).alias("entry"), "popularity")
    pre, post = landmark_labels(F.col("entry"), F.to_timestamp(F.lit(CUTOFF)), F.to_timestamp(F.lit(END)))
    return full.select("part", "segment", "entry", pre.alias("pre"), post.alias("post"), "popularity", F.col("part").alias("ord"))


PAIRS = f"""dated AS (
  SELECT l_partkey, o_orderdate, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), popular AS (
  SELECT l_partkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '{CUTOFF}' GROUP BY 1
), entries AS (
  SELECT l_partkey, c_mktsegment, min(o_orderdate) AS entry FROM dated GROUP BY 1, 2
), pairs AS (
  SELECT p.p_partkey AS part, s.c_mktsegment AS segment, e.entry,
         CAST(coalesce(e.entry < TIMESTAMP '{CUTOFF}', FALSE) AS INTEGER) AS pre,
         CAST(coalesce(e.entry >= TIMESTAMP '{CUTOFF}' AND e.entry < TIMESTAMP '{END}', FALSE) AS INTEGER) AS post,
         coalesce(n, 0) AS popularity, p.p_partkey AS ord
  FROM part p CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
  LEFT JOIN entries e ON e.l_partkey = p.p_partkey AND e.c_mktsegment = s.c_mktsegment
  LEFT JOIN popular o ON o.l_partkey = p.p_partkey
)"""


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs at risk at the cutoff, with y and score."""
    return pairs(spark, sf).where(at_risk(F.col("pre"), F.col("entry"), F.col("post"))).withColumns({"y": F.col("post"), "score": F.col("popularity").cast("double")})


UNIVERSE = PAIRS + """, universe AS (
  SELECT *, post AS y, CAST(popularity AS DOUBLE) AS score FROM pairs WHERE pre = 0 AND (entry IS NULL OR post = 1)
)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """gene, cell, sample, value: the non-zeros of the count matrix."""
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("sample")).agg(F.sum("l_quantity").alias("value"))


CELLS = """cells AS (
  SELECT l_partkey AS gene, l_orderkey AS cell, l_suppkey AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3
)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """sample, region of every supplier; the small tables join as dimensions."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    out = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("s_suppkey").alias("sample"), F.col("r_name").alias("region"))


SAMPLES = """samples AS (
  SELECT s_suppkey AS sample, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

#: Raw spellings that the text operators are shown, picked by an id.
RAW_LABELS = (
    "Responder", "non-responder", "NON RESPONDER", " CR ", "PD", "progressive disease", "untreated", "treatment.naive", "Post.treatment",
    "baseline", "T cell CD8", "CD4 Treg", "NK", "B_cell", "Macrophage", "melanoma", "fibroblast", "unknown", "n/a", "", "No Response", "partial-response", "?", "t_other", "R", "nr",
)
RAW_LIST = "[" + ", ".join(f"'{x}'" for x in RAW_LABELS) + "]"


def raw_label(key: str, step: int = 1, shift: int = 0):
    return F.element_at(F.array(*map(F.lit, RAW_LABELS)), ((F.col(key) * step + shift) % len(RAW_LABELS) + 1).cast("int"))


def raw_label_sql(key: str, step: int = 1, shift: int = 0) -> str:
    return f"{RAW_LIST}[CAST(({key} * {step} + {shift}) % {len(RAW_LABELS)} + 1 AS INTEGER)]"


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """gene_id, sample, embedding and four context columns of raw labels, from the embeddings."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 23).alias("gene_id"), (F.col("vec_id") % 5).alias("sample"), "vec_id", "embedding",
        F.when(F.col("label") < 4, "melanoma").when(F.col("label") < 7, "NSCLC ").otherwise(None).alias("disease"),
        raw_label("vec_id").alias("cell_compartment"), raw_label("vec_id", 3, 1).alias("treatment_state"), raw_label("vec_id", 7, 2).alias("response_state"),
    )


CONTEXTS = f"""contexts AS (
  SELECT vec_id % 23 AS gene_id, vec_id % 5 AS sample, vec_id, embedding,
         CASE WHEN label < 4 THEN 'melanoma' WHEN label < 7 THEN 'NSCLC ' END AS disease,
         {raw_label_sql("vec_id")} AS cell_compartment, {raw_label_sql("vec_id", 3, 1)} AS treatment_state, {raw_label_sql("vec_id", 7, 2)} AS response_state
  FROM embeddings
)"""
