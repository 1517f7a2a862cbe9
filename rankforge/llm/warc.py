"""WARC records, and resolving not-modified revisits.

`read_records` and `write_records` convert between WARC files and rows.
`resolve_revisits` gives every revisit record with the server-not-modified
profile the response that it stands for: the latest earlier full response (200,
not itself a revisit) with the same canonical url.  The resolution checks the
validators (a strong ETag on both sides must be equal; without one on both, a
Last-Modified on both must be equal) and merges headers: those that the 304
carries replace the stored ones, except those that describe the stored body or
the connection, which a 304 may not change.

The as-of join needs no window over a whole url: all records are range
partitioned by (url, time, record), so a hot url spans as many partitions as its
rows fill; every (partition, url) hands its last response on, these few rows are
accumulated per url over partition numbers, and come back as what a partition's
rows find before its own first response.

Defined cases: "earlier" is by (date, record_id), a null date before all
others, so ties in date go by record_id; a null url has no response; a response
that repeats exactly is one of several equal candidates; header names compare
without case, a repeated name keeps the last value, null headers are none; a
revisit of another profile is returned as it is, as `not_applicable`; urls and
headers of any length are used whole, bodies are not read; extra columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.common import settle, small, table

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Header fields of a 304 that do not replace stored ones.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Rows of a range partition.
ROWS = 200_000
RECORD = "record_id string, record_type string, url string, date string, profile string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Scheme and "www." dropped, host in lower case, default port, fragment and a trailing slash removed."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), r"/+$", "")
    return F.concat(host, path)


def _lower_names(headers: Column) -> Column:
    """Lower-case names; the last of a repeated name stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, rows_per_part: int = ROWS) -> DataFrame:
    """One row per revisit: record_id, url, date, state, response_id, response_date, headers.

    state is resolved, validator_mismatch, no_response or not_applicable; only
    resolved rows have merged headers.
    """
    is_full = (F.col("record_type") == "response") & (F.col("status") == 200)
    is_revisit = F.col("record_type") == "revisit"
    slim = records.where(is_full | is_revisit).select(
        canonical_url(F.col("url")).alias("canon"), "url", "date", F.col("record_id").alias("id"), is_full.alias("full"),
        F.coalesce(F.col("profile") == NOT_MODIFIED, F.lit(False)).alias("not_modified"), _lower_names(F.col("headers")).alias("headers"),
    )
    slim = settle(slim)
    parts = max(1, -(-slim.count() // rows_per_part))
    placed = settle(slim.repartitionByRange(parts, "canon", "date", "id").withColumn("part", F.spark_partition_id()))

    response = F.when(F.col("full"), F.struct("id", "date", "headers"))
    within = Window.partitionBy("part", "canon").orderBy(F.col("date").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where("full AND canon IS NOT NULL").groupBy("part", "canon").agg(F.max(F.struct(F.col("date").isNotNull().alias("dated"), "date", "id")).alias("m"))
    crossing = placed.where("canon IS NOT NULL").groupBy("canon").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    spread = placed.select("part", "canon").distinct().join(crossing.select("canon"), "canon").join(last, ["part", "canon"], "left")
    over = Window.partitionBy("canon").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(spread.select("part", "canon", F.last("m", ignorenulls=True).over(over).alias("m")).where("m IS NOT NULL"))
    # headers of the few responses that are carried into a later partition, before repetitions are dropped
    keys = settle(carried.select(F.col("canon").alias("kc"), F.col("m.date").alias("kd"), F.col("m.id").alias("ki")).distinct())
    asked = (F.col("canon") == F.col("kc")) & F.col("date").eqNullSafe(F.col("kd")) & F.col("id").eqNullSafe(F.col("ki"))
    stored = placed.where("full").join(small(keys), asked, "left_semi")
    stored = stored.select(F.col("canon").alias("c"), F.col("date").alias("d"), F.col("id").alias("i"), "headers").dropDuplicates(["c", "d", "i"])
    on = (F.col("canon") == F.col("c")) & F.col("m.date").eqNullSafe(F.col("d")) & F.col("m.id").eqNullSafe(F.col("i"))
    carried = carried.join(stored, on).select("part", "canon", F.struct(F.col("m.id").alias("id"), F.col("m.date").alias("date"), "headers").alias("before"))

    found = placed.withColumn("own", F.last(response, ignorenulls=True).over(within)).where("NOT full")
    found = found.join(carried, ["part", "canon"], "left")
    match = F.when(F.col("canon").isNotNull(), F.coalesce("own", "before"))
    found = found.withColumn("match", match)

    def validator(name: str) -> tuple[Column, Column]:
        return F.col("headers")[name], F.col("match.headers")[name]

    etag, stored_etag = validator("etag")
    changed, stored_changed = validator("last-modified")
    strong = etag.isNotNull() & stored_etag.isNotNull() & ~etag.startswith("W/") & ~stored_etag.startswith("W/")
    dated = changed.isNotNull() & stored_changed.isNotNull()
    fits = F.when(strong, etag == stored_etag).when(dated, changed == stored_changed).otherwise(F.coalesce(etag == stored_etag, F.lit(False)))
    state = (
        F.when(~F.col("not_modified"), "not_applicable").when(F.col("match").isNull(), "no_response").when(fits, "resolved").otherwise("validator_mismatch")
    )
    permitted = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_FIELDS))
    merged = F.map_concat(F.map_filter(F.col("match.headers"), lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    sure = F.col("state").isin("resolved", "validator_mismatch")
    return found.withColumn("state", state).select(
        F.col("id").alias("record_id"), "url", "date", "state", F.when(sure, F.col("match.id")).alias("response_id"),
        F.when(sure, F.col("match.date")).alias("response_date"), F.when(F.col("state") == "resolved", merged).alias("headers"),
    )


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one WARC file, gzipped by record or as a whole, or plain.

    A record cut off at the end of the file is left out.
    """
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    try:
        while True:
            line = source.readline()
            while line in (b"\r\n", b"\n"):
                line = source.readline()
            if not line.startswith(b"WARC/"):
                return
            named = _fields(source)
            length = int(named.get("content-length", "0"))
            block = source.read(length)
            if len(block) < length:
                return
            record = {
                "record_id": named.get("warc-record-id"), "record_type": named.get("warc-type"), "url": named.get("warc-target-uri"), "date": named.get("warc-date"),
                "profile": named.get("warc-profile"), "status": None, "headers": {}, "body": block,
            }
            if named.get("content-type", "").replace(" ", "").startswith("application/http") and block.startswith(b"HTTP/"):
                http = io.BufferedReader(io.BytesIO(block))
                word = http.readline().split()
                record["status"] = int(word[1]) if len(word) > 1 and word[1].isdigit() else None
                record["headers"] = _fields(http)
                record["body"] = http.read()
            yield record
    except EOFError:
        return


def _fields(source: io.BufferedReader) -> dict[str, str]:
    fields: dict[str, str] = {}
    name = None
    while (line := source.readline()) not in (b"", b"\r\n", b"\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded line continues its field
            fields[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def render_warc(record: dict) -> bytes:
    """One record as a gzip member."""
    block = record.get("body") or b""
    kind = "application/octet-stream"
    if record.get("status") is not None:
        lines = "".join(f"{k}: {v}\r\n" for k, v in (record.get("headers") or {}).items())
        block = f"HTTP/1.1 {record['status']} \r\n{lines}\r\n".encode() + block
        kind = "application/http"
    named = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "url"), ("WARC-Date", "date"), ("WARC-Profile", "profile")]
    head = "".join(f"{name}: {record[key]}\r\n" for name, key in named if record.get(key) is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below `path`; a file is one task's work, as gzip demands."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for record in parse_warc(content):
                    rows.append(record)
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows).astype({"status": "Int32"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows).astype({"status": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, RECORD)


def as_warc(records: DataFrame) -> DataFrame:
    """record_id and the record's gzip member; members put one after another are a WARC file."""

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            for row in rows:
                row["headers"] = dict(row["headers"] or {})
                row["status"] = None if pd.isna(row["status"]) else int(row["status"])
            yield pd.DataFrame({"record_id": batch["record_id"], "member": [render_warc(r) for r in rows]})

    return records.mapInPandas(render, "record_id string, member binary")


def captures(pages: DataFrame) -> DataFrame:
    """The crawl that `pages` stands for: every page is fetched in full, and asked for again 12 hours later.

    Fetches are an hour of page_id apart.  The second answer is a 304 with the
    validators of the first, but every seventh page's has a new ETag, and every
    fifth's has only a Last-Modified.  It changes Cache-Control, and claims a
    Content-Length that must not count.
    """
    hour = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)) * 3600)
    later = hour + F.expr("INTERVAL 12 HOURS")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    fifth, seventh = F.col("page_id") % 5 == 0, F.col("page_id") % 7 == 0
    full = F.struct(
        F.concat(F.lit("a"), key).alias("record_id"), F.lit("response").alias("record_type"), F.col("url"), stamp(hour).alias("date"),
        F.lit(None).cast("string").alias("profile"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), stamp(hour), F.lit("Content-Length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"),
                     F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    own = F.when(fifth, F.create_map(F.lit("Last-Modified"), stamp(hour))).otherwise(F.create_map(F.lit("ETag"), F.when(seventh, F.lit('"new"')).otherwise(tag)))
    again = F.struct(
        F.concat(F.lit("b"), key).alias("record_id"), F.lit("revisit").alias("record_type"), F.regexp_replace("url", "^https://", "http://").alias("url"), stamp(later).alias("date"),
        F.lit(NOT_MODIFIED).alias("profile"), F.lit(304).alias("status"),
        F.map_concat(own, F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600"))).alias("headers"),
    )
    return pages.select(F.explode(F.array(full, again)).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per revisit: its state, the response it stands for, and three of the merged headers."""
    found = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    header = F.col("headers")
    return found.select(
        "record_id", "date", "state", "response_id", "response_date", header["etag"].alias("etag"), header["content-length"].alias("content_length"), header["cache-control"].alias("cache_control")
    )


ORACLE_SQL = r"""
WITH times AS (
  SELECT page_id, url, html, epoch_ms((1704067200 + page_id * 3600) * 1000) AS t, '"' || md5(html) || '"' AS tag FROM pages
), keyed AS (
  SELECT *, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(t + INTERVAL 12 HOURS, '%Y-%m-%dT%H:%M:%SZ') AS later,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM times
), canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*(.*)$', 1), '/+$', '') AS canon
  FROM keyed
), matched AS (
  SELECT b.page_id, b.later, b.tag AS own_tag, b.d AS own_d, a.page_id AS from_id, a.d AS from_d, a.tag AS from_tag, strlen(a.html) AS bytes
  FROM canon b ASOF LEFT JOIN canon a ON a.canon = b.canon AND b.later >= a.d
), judged AS (
  SELECT *, CASE WHEN from_id IS NULL THEN 'no_response'
                 WHEN page_id % 5 = 0 THEN CASE WHEN own_d = from_d THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN page_id % 7 = 0 THEN 'validator_mismatch'
                 WHEN own_tag = from_tag THEN 'resolved' ELSE 'validator_mismatch' END AS state
  FROM matched
)
SELECT 'b' || page_id AS record_id, later AS date, state, 'a' || from_id AS response_id, from_d AS response_date,
       CASE WHEN state = 'resolved' THEN from_tag END AS etag,
       CASE WHEN state = 'resolved' THEN CAST(bytes AS VARCHAR) END AS content_length,
       CASE WHEN state = 'resolved' THEN 'max-age=600' END AS cache_control
FROM judged
"""
