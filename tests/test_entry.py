import __spark_entry__ as E
from codemap.plans import catalog


def test_contract_keys_align():
    q, s = E.queries(), E.oracle_sql()
    assert set(catalog.QUERIES) <= set(s) <= set(q)
    assert set(q) - set(catalog.QUERIES) == set(E._llm()[0])


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 21  # 20 repositories and the hot one
    assert set(df.columns) >= {"repo_id", "total_files", "graph_edges", "top_central_files"}
