import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and df.columns == ["model", "n", "MAE", "RMSE", "R2", "MAPE", "n_zero_actual"]
    assert rows[0].n > 0


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    own = [k for k in q if not k.startswith(("op", "pipeline"))]
    assert len(own) >= 88 and len(set(own) & set(s)) >= 71
