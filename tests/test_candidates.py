"""The candidate table: columns, literals, and that nothing after the cutoff reaches a feature."""

from pyspark.sql import functions as F

from rankforge.operators import candidates, contracts

RECORD = "gene_id string, year int, ood boolean, grp int, place int, is_case boolean, is_entry boolean, value double, level double"
GENES = "gene_id string, druggable_class int"


def _rows(spark):
    records = [
        ("a", 2000, False, 1, 1, True, False, 4.0, 0.5), ("a", 2001, False, 2, 2, False, False, 8.0, 0.2), ("a", 2001, True, 1, 2, True, True, 3.0, 0.1), ("a", 2005, False, 1, 9, True, False, 99.0, 9.0),
        ("b", 2004, False, 1, 3, True, True, 7.0, 0.4), ("b", 2002, False, 1, 3, False, False, 1.0, 0.3), ("c", 2009, True, 1, 1, True, True, 2.0, 0.4),
    ]
    return spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 1)], GENES), spark.createDataFrame(records, RECORD)


def test_literals(spark):
    got = {r["gene_id"]: r for r in candidates.candidate_table(*_rows(spark), 2002, 2005).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert set(a.asDict()) == {*contracts.CANDIDATE_NUMBERS, *contracts.CANDIDATE_OTHERS} and len(a) == 17
    assert [(r["entry_year"], r["label_pre_cutoff"], r["label_post_cutoff"]) for r in (a, b, c, d)] == [(2001, 1, 0), (2004, 0, 1), (2009, 0, 0), (None, 0, 0)]
    assert (a["publication_count_pre_cutoff"], a["publication_count_all_time"], a["mean_expression_id"], a["mean_expression_ood"]) == (3, 4, 6.0, 3.0)
    assert abs(a["differential_expression_id"] - 0.3) < 1e-12 and a["differential_expression_ood"] == 0.0
    assert (a["cell_type_specificity_id"], a["cell_type_specificity_ood"], a["network_centrality"]) == (8 / 12, 1.0, 2 / 4)
    assert (b["mean_expression_id"], b["cell_type_specificity_ood"], d["network_centrality"], d["druggable_class"]) == (1.0, 0.0, 0.0, 1)
    assert all(r["status"] != "FAIL" for r in contracts.candidate_contract(candidates.candidate_table(*_rows(spark), 2002, 2005)).collect())


def test_no_look_ahead(spark):
    """Later records may move labels and the all-time count, and nothing else; a place only seen later counts among all places."""
    entities, records = _rows(spark)
    free = {"label_pre_cutoff", "label_post_cutoff", "entry_year", "publication_count_all_time"}
    before = {r["gene_id"]: r.asDict() for r in candidates.candidate_table(entities, records, 2002, 2005).collect()}
    later = records.withColumns({"value": F.when(F.col("year") > 2002, -F.col("value")).otherwise(F.col("value")), "grp": F.when(F.col("year") > 2002, 77).otherwise(F.col("grp")), "is_case": F.col("is_case") & (F.col("year") <= 2002)})
    after = {r["gene_id"]: r.asDict() for r in candidates.candidate_table(entities, later.unionByName(later.where("year > 2002")), 2002, 2005).collect()}
    assert all(before[g][c] == after[g][c] for g in before for c in before[g] if c not in free)
    assert candidates.candidate_table(entities.limit(0), records, 2002, 2005).count() == 0
    assert candidates.candidate_table(entities, records.limit(0), 2002, 2005).count() == 4


def test_places_may_come_from_elsewhere(spark):
    entities, records = _rows(spark)
    places = spark.createDataFrame([(k % 8,) for k in range(20)], "place int")
    got = {r["gene_id"]: r["network_centrality"] for r in candidates.candidate_table(entities, records, 2002, 2005, places).collect()}
    assert got == {"a": 2 / 8, "b": 1 / 8, "c": 0.0, "d": 0.0}


def test_lines_without_an_order_count_as_places_as_in_sql(spark, tmp_path):
    import duckdb

    from rankforge.plans import registry

    con, tables = duckdb.connect(), {
        "part": "SELECT range AS p_partkey, CAST(5 * range AS INTEGER) AS p_size FROM range(4)",
        "orders": "SELECT range AS o_orderkey, TIMESTAMP '1995-03-01' + to_years(CAST(range AS INTEGER)) AS o_orderdate FROM range(6)",
        "lineitem": "SELECT range % 9 AS l_orderkey, range % 3 AS l_partkey, range AS l_suppkey, CAST(30 + range AS DOUBLE) AS l_quantity, range / 100.0::DOUBLE AS l_discount, CASE WHEN range % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(27)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = registry.queries()["m18_candidate_table"](spark, str(tmp_path))
    columns = ", ".join(got.columns)
    want = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()['m18_candidate_table']}) ORDER BY gene_id").fetchall()
    assert [tuple(r) for r in got.orderBy("gene_id").collect()] == want
