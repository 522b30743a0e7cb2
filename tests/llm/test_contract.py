"""Every query of the subpackage: its columns, and its rows against SQL where there is some."""

import duckdb
import pytest

from blotter.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_sentencepiece": "doc_id ids",
    "op4_ngram_join": "doc_id n_shingles component_id",
    "op5_top_k": "query_id rank vec_id score",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_line_dedup": "doc_id text",
    "op10_language_id": "doc_id language kept",
    "op11_source_divergence": "lang source part item value rank",
    "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}


def test_all_operators_are_registered():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    whole = {"op5_top_k": 500, "op7_html_extraction": 50, "op8_packing": None}
    whole = (whole | {"op11_source_divergence": None, "op12_filter_audit": 2400}).get(name, 200)
    if whole:
        assert out.count() == whole


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    mine = QUERIES[name](spark, SMALL)
    theirs = db.sql(SQL[name])
    order = sorted(mine.columns)
    rows = sorted(tuple(r[c] for c in order) for r in mine.collect())
    assert rows == sorted(theirs.select(*order).fetchall())
