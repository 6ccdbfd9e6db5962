"""The registered queries and the pipeline on small tables."""
import brute
import numpy as np
import pyspark.sql.functions as F
import pytest

import corpus_pipeline as P
from gridloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op7_simhash_near_dedup"])
def test_queries_match_brute_force(spark, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES[name](spark, SF)
    if name.startswith("op2"):
        got, want = got.select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring(rows)
    else:
        want = brute.simhash(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["op1_lm_score", "op3_language_id", "op8_token_counts", "op10_toxicity"])
def test_queries_return_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert got.count() == docs.count() and got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in ("score", "_text", "sig", "row", "name", "c0", "doc")})
    more = spark.createDataFrame([(None, "the and of to", None, None, None), (None, None, "en", "src0", 0), (9001, "", "en", None, 0), (9002, "123 456", "en", "src1", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    docs = docs.unionByName(docs.filter("doc_id = 5"))
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, P.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().exceptAll(before.select("doc_id").distinct()).count() == 0
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            comp = {c for _, _, c in brute.simhash(rows)}
            assert {r.doc_id for r in docs.collect()} - {None} == comp - {None}
        if name == "substring_dedup":
            rows = {(r.doc_id, r.text) for r in before.collect()}
            changed = [r for r in docs.collect() if (r.doc_id, r.text) not in rows]
            assert changed and all(r.n_chars == len(r.text) for r in changed)
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {d for d, _, _ in brute.decontaminate([(r.doc_id, r.text) for r in before.collect()], items)}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == hit
    assert counts[0] - 4 <= counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in pieces)
    first = docs.limit(0)
    for _, stage in P.STAGES:
        first = stage(spark, first, SF)
    assert first.count() == 0


def test_pipeline_runs_whole(spark):
    assert P.run(spark, SF).count() > 0 and P.ORACLE_SQL is None
