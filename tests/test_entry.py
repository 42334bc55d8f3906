"""Driver contract: entry runs, every query has an oracle, names are unique."""

import __spark_entry__ as E


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["k"])] == [10, 20, 50, 100]
    assert all(0.0 <= r["accuracy"] <= 100.0 for r in rows)


def test_every_query_has_oracle():
    from passagekit.plans.catalog import CATALOG
    from passagekit.plans.oracle import ORACLE
    assert set(CATALOG) == set(ORACLE) and set(CATALOG) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_small_queries_run(spark):
    qs = E.queries()
    for name in ("doc_ids", "collapse_2", "sentence_split", "corpus_level_2", "augment"):
        df = qs[name](spark, "/root/testdata/sf0.001")
        assert df.count() >= 0 and df.columns
