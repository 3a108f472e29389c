"""Every query of the reference's operators against its SQL in DuckDB, over the smallest tables."""

import datetime
import decimal

import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}" if v else "0"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


ODD = {
    "missing source": "SELECT i * 57 % 450 AS doc_id, 't' || chr((97 + i % 26)::INT) AS text, CASE WHEN i % 4 > 0 THEN 's' || i % 3 END AS source FROM range(600) r(i)",
    "days before the lookback": "SELECT i * 57 % 900 - 450 AS doc_id, 't' || chr((97 + i % 26)::INT) || chr((97 + i // 26 % 5)::INT) AS text, 's' || i % 3 AS source FROM range(600) r(i)",
    "capital I with a dot": "SELECT i * 57 % 450 AS doc_id, 'İstanbul ABİDE' AS text, 's' || i AS source FROM range(3) r(i)",
}


@pytest.mark.parametrize("kind", ODD)
@pytest.mark.parametrize("name", ["signals_and_network", "weak_signals", "term_window_presence"])
def test_odd_documents(spark, tmp_path, name, kind):
    """Sources that are missing, days before the lookback, a letter whose lower case is two in Spark: as SQL has them."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY ({ODD[kind]}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    rows = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert rows and sorted(tuple(plain(r[c]) for c in names) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == rows
