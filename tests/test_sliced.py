"""Sliced containers: round trips, slices that filters skip, failed writes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from rankforge.sources import sliced


def _cells(spark):
    rng = np.random.default_rng(3)
    places = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 300, 4000), rng.integers(0, 50, 4000), strict=True)} | {(7, 1000 + k) for k in range(900)})
    return places, spark.createDataFrame([(r, c, float(r * 1000 + c)) for r, c in places[::-1]], sliced.SCHEMA).repartition(5)


def test_round_trip_and_skipped_slices(spark, tmp_path):
    places, cells = _cells(spark)
    path = str(tmp_path / "c")
    sliced.write_sliced(cells, path, slice_rows=16, part_rows=1500)
    back = spark.read.format("sliced_csr").load(path)
    assert sorted((r["row"], r["col"], r["value"]) for r in back.collect()) == [(r, c, float(r * 1000 + c)) for r, c in places]
    index = json.loads((tmp_path / "c" / "index.json").read_text())
    assert len(index) >= 300 // 16 and sum(s["cells"] for s in index) == len(places)
    assert all(a["last"] < b["first"] for a, b in zip(index, index[1:]))  # no row is cut, that of 900 cells neither
    some = back.where("row BETWEEN 40 AND 90 AND col > 10")
    assert sorted((r["row"], r["col"]) for r in some.collect()) == [(r, c) for r, c in places if 40 <= r <= 90 and c > 10]
    assert some.rdd.getNumPartitions() == sum(s["last"] >= 40 and s["first"] <= 90 for s in index) < len(index) / 3
    assert back.where("row = 100000").count() == 0


def test_pushed_bounds(spark, tmp_path):
    _, cells = _cells(spark)
    sliced.write_sliced(cells, str(tmp_path / "c"), slice_rows=16)
    every = len(sliced.SlicedReader(str(tmp_path / "c")).partitions())
    for filters, low, high in (([EqualTo(("row",), 5)], 5, 5), ([GreaterThan(("row",), 250), EqualTo(("col",), 1)], 251, 10**9), ([LessThanOrEqual(("row",), 20)], 0, 20), ([In(("row",), (30, 60))], 30, 60), ([EqualTo(("col",), 5)], 0, 10**9)):
        reader = sliced.SlicedReader(str(tmp_path / "c"))
        assert list(reader.pushFilters(filters)) == filters
        left = reader.partitions()
        assert left and all(s.last >= low and s.first <= high for s in left) and (len(left) < every or filters[0].attribute == ("col",))


def test_empty_and_failed_writes(spark, tmp_path):
    _, cells = _cells(spark)
    path = str(tmp_path / "c")
    sliced.write_sliced(cells.limit(0), path)
    assert spark.read.format("sliced_csr").load(path).count() == 0
    sliced.write_sliced(cells, path)
    n = cells.count()
    broken = cells.withColumn("value", F.when(F.col("row") == 299, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("sliced_csr").mode("append").save(path)
    assert spark.read.format("sliced_csr").load(path).count() == n  # a write that fails is in no index
