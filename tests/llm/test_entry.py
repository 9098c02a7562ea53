"""The registered queries on small tables: schemas, whole tables, and SQL where there is some."""

import glob
import os

import duckdb
import pytest

from gradeloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op3_": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5_": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7_": {"doc_id", "size", "source_size", "target", "taken"},
    "op8_": {"doc_id", "fingerprint", "component_id"},
    "op9_": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op10_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_document_is_in_the_result(spark, name):
    frame = queries.queries()[name](spark, SF)
    prefix = name.split("_")[0] + "_"
    assert COLUMNS.get(prefix, {"doc_id"}) <= set(frame.columns)
    ids = {r.doc_id for r in frame.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert all(t in ("bigint", "string", "boolean", "double", "int") or "array" in t for _, t in frame.dtypes)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = queries.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in frame.collect())
    found = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
