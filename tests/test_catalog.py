"""Every query of the catalog against DuckDB on the smallest tables."""

import pytest

from veldra.plans import catalog, catalog_evidence, catalog_review

MODULES = (catalog, catalog_evidence, catalog_review)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_every_query_names_what_it_covers():
    assert {k for m in MODULES for k in m.COVERS} == set(QUERIES)
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_diverse_allocation_keeps_its_caps(spark):
    df = catalog.QUERIES["diversity_allocation"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = df.join(docs, df["id"] == docs["doc_id"])
    assert got.groupBy("source").count().agg({"count": "max"}).first()[0] <= 2
    assert got.groupBy("lang").count().agg({"count": "max"}).first()[0] <= 12


@pytest.mark.parametrize("name, nulls", [("track_mapping", True), ("track_mapping", False), ("track_inventory_gaps", False), ("adjacent_transitions", True)])
def test_nulls_and_long_spans_as_in_sql(spark, tmp_path, name, nulls):
    """Tracks of 5,120 hours, whose shares may end in half a digit; a null track, null times and values. No track has its highest value twice."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"""COPY (SELECT row_number() OVER (ORDER BY u, i) - 1 AS event_id,
        CASE WHEN NOT ({nulls} AND (u = 5 OR i % 7 = 3)) THEN TIMESTAMP '2024-01-01' + (CASE WHEN i = u - 1 AND u > 7 THEN 5119 ELSE i END) * INTERVAL 1 HOUR END AS ts,
        CASE WHEN NOT ({nulls} AND u = 4) THEN u END AS user_id, 'click' AS event_type,
        CASE WHEN NOT ({nulls} AND i % 5 = 2) THEN u * 1000.0::DOUBLE - (i - 3) * (i - 3) - i / 7 END AS value, '{{}}' AS props
        FROM range(1, 180) a(u), range(180) b(i) WHERE i < u AND (u < 9 OR u % 8 = 1)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name]).select(*df.columns).fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))
