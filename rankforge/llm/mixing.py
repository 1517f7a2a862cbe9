"""Mixing sources to target weights by capped water-filling.

Every source asks for the share weight / sum of weights of the mix; a source
whose share exceeds `max_epochs` times its size is clamped there and the excess
is shared by weight among the others, until none is above.  With c = cap /
weight per source the fixed point is a level L with target = min(cap, weight *
L); in order of c, the clamped sources are a prefix, so the level comes from
prefix sums over one row per source.

A source's epochs = target / size.  The whole part repeats every document; the
rest is a seeded sample of whole documents: documents are ordered by a hash of
id, source and text, and those before the word quota get one more repetition
(the document on the boundary goes to the nearer side).  Repeated rows have one
hash; where they lie on the boundary, as many of them are taken as come nearest.
So a source's taken words miss its target by half of one document at most, and
reruns agree.

The quota's place is found without sorting a source in one task: sizes are
summed by (source, slice of the hash), the sums are accumulated per source (at
most SLICES rows each), and only the slice that holds the quota is looked into.
The result is one threshold per source; documents meet it in a map-side join.

Defined cases: null and white-space-only texts have size 0 and take nothing; texts
of any length are counted and hashed whole; a
null source is a source of its own, last in order; sources without words get
target 0; repeated rows are separate documents with equal decisions; extra
columns never clash, because `mix` keeps the rows of its input in a struct; an
empty table gives an empty mix.  If every source together cannot fill the mix
(share above max_epochs), all are clamped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.common import settle, small, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"

#: The hash has 60 bits; its first 12 name the slice.
_SLICE_BITS = 48
_LAST = (1 << 60) - 1


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: str, doc_id: Column, source: Column, text: Column) -> Column:
    """60 bits that depend on the row's id, source and whole text only."""
    blank = F.lit("")
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), blank), F.coalesce(source, blank), F.md5(F.coalesce(text, blank).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    The windows run over one row per source.  `weights` repeat over the sources
    in code-point order, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    asked = sizes.select(
        "source", "source_size", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    filled = (
        asked.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
        # the first source in this order that its share does not exceed sets the level
        .withColumn("free_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    share_of = F.col("weight") * F.col("free_level")
    target = F.when(F.col("free_level").isNull() | (share_of >= F.col("cap")), F.col("cap")).otherwise(share_of)
    return filled.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, size, u) -> source, source_size, target, whole, cut, edge, fit: one row per source.

    A document is repeated `whole` times, and once more if u <= cut; of repeated
    rows with u = edge, `fit` are.
    """
    slices = settle(slim.groupBy("source", F.shiftright("u", _SLICE_BITS).alias("slice")).agg(F.sum("size").alias("words")))
    goal = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = settle(goal.withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")))
    side = small(goal)

    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = (
        before.join(side.select(F.col("source").alias("name"), "quota"), F.col("source").eqNullSafe(F.col("name")))
        .where((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("words") > F.col("quota")))
        .select("source", "slice", F.col("before").alias("slice_before"), "quota")
    )
    edge = settle(edge)
    inside = Window.partitionBy("name").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        small(edge.withColumnRenamed("source", "name").withColumnRenamed("slice", "part"))
        .join(slim, F.col("source").eqNullSafe(F.col("name")) & (F.shiftright("u", _SLICE_BITS) == F.col("part")))
        .groupBy("name", "slice_before", "quota", "u")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        .withColumn("before", F.col("slice_before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .where((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("words") > F.col("quota")))
        .select("name", F.col("u").alias("at"), "rows", F.least("rows", F.floor((F.col("quota") - F.col("before")) * F.col("rows") / F.col("words") + 0.5)).alias("fit"))
    )
    joined = goal.join(edges, F.col("source").eqNullSafe(F.col("name")), "left")
    cut = F.when(F.col("quota") <= 0, F.lit(-1)).when(F.col("at").isNull(), F.lit(_LAST)).otherwise(F.col("at") - (F.col("fit") < F.col("rows")).cast("long"))
    split = (F.col("quota") > 0) & (F.col("fit") > 0) & (F.col("fit") < F.col("rows"))
    return settle(joined.select("source", "source_size", "target", "whole", cut.cast("long").alias("cut"), F.when(split, F.col("at")).alias("edge"), F.when(split, F.col("fit")).alias("fit")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc (the input row as a struct), size, source_size, target, copies, taken."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    source = F.col("doc.source").cast("string")
    rows = rows.withColumn("source", source).withColumn("size", n_words(F.col("doc.text"))).withColumn("u", order_hash(seed, F.col("doc.doc_id"), source, F.col("doc.text")))
    goal = plan(settle(rows.select("source", "size", "u")), weights, share, max_epochs)
    goal = small(goal.withColumnRenamed("source", "name"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("name")))
    copies = F.col("whole") + (F.col("u") <= F.col("cut")).cast("long")
    shape = ["doc", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")]
    if goal.where("edge IS NOT NULL").isEmpty():
        return rows.select(*shape)
    # repeated rows on a boundary are numbered: partitions by their counts, rows inside of their partition
    apart = F.coalesce(F.col("u") == F.col("edge"), F.lit(False))
    equal = settle(rows.where(apart).withColumn("number", F.monotonically_increasing_id())).withColumn("part", F.shiftright("number", 33))
    upto = Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = equal.groupBy(F.col("edge").alias("of"), F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    counts = small(settle(counts.select("of", "of_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))))
    place = F.col("before") + F.row_number().over(Window.partitionBy("edge", "part").orderBy("number"))
    equal = equal.join(counts, (F.col("edge") == F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("cut", F.when(place <= F.col("fit"), F.col("u")).otherwise(F.lit(-1)))
    return rows.where(~apart).select(*shape).unionByName(equal.select(*shape))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each input row as often as it was taken."""
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH slim AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS u
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source
), asked AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM sizes
), filled AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM asked
), levels AS (
  SELECT *, (total - caps_before) / weights_left AS level FROM filled
), free AS (
  SELECT arg_min(level, ratio) AS free_level FROM levels WHERE level <= ratio
), goal AS (
  SELECT source, source_size,
         CASE WHEN free_level IS NULL OR weight * free_level >= cap THEN cap ELSE weight * free_level END AS target
  FROM levels LEFT JOIN free ON TRUE
), ranked AS (
  SELECT doc_id, size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slim s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
