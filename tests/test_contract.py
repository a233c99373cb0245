import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 100
    assert df.columns == ["token", "n"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    assert all(callable(f) for f in q.values())


def test_small_queries_run(spark):
    q = entry.queries()
    for name in ["general_clean", "seq_pad_fixed", "logits_top_k", "qa_prompts"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
