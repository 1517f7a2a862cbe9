"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by its content (SHA-256 of the text).  A
ledger, a Parquet folder that only grows, says for each blob which rules in which
version have been applied and what they found.  A scan looks up which pairs of blob
and rule version it hasn't seen, reads one text of each such blob, applies only the
missing rules, adds the result to the ledger and joins the findings back to all
versions, seen before or not.  DataFrame functions only.

Positions come from `regexp_extract_all` with the gap before each match: the
lengths of gaps and matches, summed up match by match, are the places.  The sums are
windows over one text's matches.  Texts meet their unseen blobs by (blob, path), so
copies of one text spread; a blob that many versions share is dealt over several
tasks when findings are joined back.

Defined cases: a null text is the empty text, without findings; a text is scanned
whole; repeated rows are versions each, scanned once; overlapping findings of
different kinds all stay; a null path is a path; columns that aren't in `path` are
not carried; an empty table gives an empty result and leaves the ledger as it was.
A run that fails leaves the ledger without its rows; two runs at once may both add
the same rows, which count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.common import is_written, join_counted, settle, shared_folder, table


class Rule(NamedTuple):
    kind: str
    #: Changes whenever pattern, group or least do.
    version: int
    #: Without groups but for `group`.
    pattern: str
    #: The group whose length counts, 0 for the whole match.
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """The word in upper, lower and mixed ASCII case, as a pattern."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed values of the contract: kinds in order, patterns and least lengths.
_ASSIGN = "(?:" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (Rule("assign", 1, _ASSIGN, 1, 12), Rule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18), Rule("hex", 1, "[0-9a-f]{16,}", 0, 16))

SPAN = "struct<start: int, place: int, stop: int>"
_LEDGER = "blob binary, rules array<string>, spans array<struct<rule: string, start: int, stop: int>>"


def content_address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    if is_written(spark, folder):
        return spark.read.schema(_LEDGER).parquet(folder)
    return spark.createDataFrame([], _LEDGER)


def _units(text: Column, rule: Rule) -> Column:
    """Lengths of each match with the gap before it, of the gap, and of what counts of the match."""
    head = rf"(?s)^(.*?)(?:{rule.pattern})"

    def measured(unit: Column) -> Column:
        counted = F.char_length(F.regexp_extract(unit, head, 1 + rule.group)) if rule.group else F.lit(rule.least)
        return F.struct(F.char_length(unit).alias("whole"), F.char_length(F.regexp_extract(unit, head, 1)).alias("gap"), counted.alias("counted"))

    # \G: a search that finds nothing more isn't begun anew at every place
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{rule.pattern})"), F.lit(0)), measured)


def _matches(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, rule, start, stop for (blob, missing, text) rows; several rows of a blob give the same findings again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<whole: int, gap: int, counted: int>>")
    found = [F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("missing", r.name), _units(text, r)).otherwise(none).alias("units")) for r in rules]
    least = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.least)]), F.col("rule"))
    listed = texts.select("blob", F.monotonically_increasing_id().alias("copy"), F.explode(F.array(*found)).alias("of"))
    listed = listed.select("blob", "copy", "of.rule", F.posexplode("of.units").alias("at", "unit"))
    upto = Window.partitionBy("blob", "copy", "rule").orderBy("at")
    placed = listed.withColumn("stop", F.sum("unit.whole").over(upto).cast("int"))
    return placed.where(F.col("unit.counted") >= least).select("blob", "rule", (F.col("stop") - F.col("unit.whole") + F.col("unit.gap")).alias("start"), "stop")


def scan(versions: DataFrame, ledger: str, path: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """The columns of `path` and spans (start, place of the kind among `rules`, stop) for every row of `versions`.

    `ledger` is a folder that all executors share.  A path column may be of any type that has an order.
    """
    spark = versions.sparkSession
    named = versions.select(F.struct(*[F.col(f"`{c}`") for c in path]).alias("path"), content_address(F.col("text")).alias("blob"), "text")
    keys = settle(named.select("path", "blob"))
    counted = keys.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("pick"))
    seen = read_ledger(spark, ledger)
    past = seen.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    missing = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    counted = settle(counted.join(past, "blob", "left").select("blob", "n", "pick", missing.alias("missing")))
    todo = counted.where(F.size("missing") > 0).select("blob", "pick", "missing")
    if not todo.isEmpty():
        # the hash of the path lets copies of one text go to many tasks
        own = named.select(F.xxhash64(F.to_json("path")).alias("spot"), "path", "blob", "text")
        wanted = todo.select(F.col("blob").alias("want"), "pick", "missing", F.xxhash64(F.to_json("pick")).alias("at"))
        same = (F.col("blob") == F.col("want")) & (F.col("spot") == F.col("at")) & F.col("path").eqNullSafe(F.col("pick"))
        found = _matches(own.join(wanted.hint("shuffle_hash"), same).select("blob", "missing", "text"), rules)
        span = F.struct("rule", "start", "stop").alias("span")
        found = found.groupBy("blob").agg(F.collect_set(span).alias("spans"))
        none = F.array().cast("array<struct<rule: string, start: int, stop: int>>")
        added = todo.join(found, "blob", "left").select("blob", F.col("missing").alias("rules"), F.coalesce("spans", none).alias("spans"))
        added.write.mode("append").parquet(ledger)
    names = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    spans = read_ledger(spark, ledger).select("blob", F.explode("spans").alias("s")).select("blob", F.col("s.start").alias("start"), F.try_element_at(names, F.col("s.rule")).alias("place"), F.col("s.stop").alias("stop"))
    # what several runs have found is there once
    spans = spans.where("place IS NOT NULL").groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "place", "stop"))).alias("spans"))
    found = settle(spans.join(counted.select("blob", "n"), "blob"))
    joined = join_counted(keys.withColumn("spot", F.xxhash64(F.to_json("path"))), found, "blob", "n", "spot")
    return joined.select("path.*", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def spans_text(spans: str, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end of each span, in order, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(spans: str, place: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["place"] == place)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger)
    count = [_count("spans", k).alias(f"n_{r.kind}") for k, r in enumerate(RULES)]
    # the method adds no spans of its own
    found = found.select("doc_id", *count, spans_text("spans").alias("spans"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


_QUOTED = _ASSIGN.replace("'", "''")
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), units AS (
  SELECT row, 0 AS place, unnest(regexp_extract_all(t, '(?s).*?(?:{_QUOTED})')) AS u, generate_subscripts(regexp_extract_all(t, '(?s).*?(?:{_QUOTED})'), 1) AS i FROM d
  UNION ALL
  SELECT row, 1, unnest(regexp_extract_all(t, '(?s).*?AKIA[A-Z0-9]+')), generate_subscripts(regexp_extract_all(t, '(?s).*?AKIA[A-Z0-9]+'), 1) FROM d
  UNION ALL
  SELECT row, 2, unnest(regexp_extract_all(t, '(?s).*?[0-9a-f]+')), generate_subscripts(regexp_extract_all(t, '(?s).*?[0-9a-f]+'), 1) FROM d
), placed AS (
  SELECT row, place, sum(length(u)) OVER (PARTITION BY row, place ORDER BY i) AS stop,
         CASE place WHEN 0 THEN length(regexp_extract(u, '(?s)^.*?({_QUOTED})', 1)) WHEN 1 THEN length(regexp_extract(u, 'AKIA[A-Z0-9]+$')) ELSE length(regexp_extract(u, '[0-9a-f]+$')) END AS size,
         CASE WHEN place = 0 THEN length(regexp_extract(u, '(?s)^.*?{_QUOTED}', 1)) ELSE 0 END AS secret
  FROM units
), kept AS (
  SELECT row, place, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
  WHERE (place = 0 AND secret >= 12) OR (place = 1 AND size >= 18) OR (place = 2 AND size >= 16)
), listed AS (
  SELECT row, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex'][place + 1] || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM kept GROUP BY row
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed ON d.row = listed.row
"""
