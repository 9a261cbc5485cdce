"""Spark queries against their DuckDB SQL at sf0.001 (the driver runs all of them at sf0.01)."""
import duckdb
import pytest

import __spark_entry__ as E
from tests.oracle_check import TABLES, rows_of, type_diffs

SF = "/root/testdata/sf0.001"
KEYS = ["clean_tokens", "normalize_name", "eligible_offers", "sampled_positives",
        "cluster_similarity", "similar_clusters", "sampled_negatives", "label_noise_grid",
        "stratified_folds", "surrogate_keys", "pairs_from_tables", "vocabulary",
        "word_cooccurrence", "pair_features", "per_class_metrics", "vector_abs_diff"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[key])
    b, bc = rows_of([d[0] for d in res.description], res.fetchall())
    assert ac == bc
    assert not type_diffs(df, con, E.oracle_sql()[key])
    assert a == b


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["cluster_id", "id_left", "id_right", "label"]
    assert df.count() >= 0
