"""Registered queries against their DuckDB oracles on the smallest tables."""
import pytest

from tools.oracle_check import norm

SF = "/root/testdata/sf0.001"
NAMES = ["v03_vocabulary", "v05_tfidf_transform", "m01_multinomial_nb", "e02_macro_prf", "x01_group_split",
         "x02_multilabel_split", "t07_sentences", "d10_d11_parse_transcripts", "d12_d13_record_entries",
         "j07_fine_to_coarse", "a14_overlapping_windows", "c01_pack_sentences", "e04_roc_auc", "m06_knn_cosine",
         "x05_balanced_negatives", "s17_wide_predictions"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    srows = df.collect()
    scols = df.columns
    rel = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    S = sorted((tuple(norm(r[scols.index(c)]) for c in order) for r in srows), key=repr)
    D = sorted((tuple(norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    assert S == D


def test_entry_smoke(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["f1"] <= 1
