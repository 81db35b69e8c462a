import __spark_entry__ as entry
from tessera.plans import registry


def test_registry_and_oracles_line_up():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 60
    assert set(sql) <= set(qs)
    missing = sorted(set(registry.all_queries()) - set(sql))
    assert missing == [], f"queries without an oracle: {missing}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "id", "score", "nlq", "sql"]
