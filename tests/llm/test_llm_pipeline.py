"""The corpus pipeline stage by stage, and the registered queries against their DuckDB texts."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_file
import corpus_pipeline
from playbill.llm import decontaminate, line_dedup, minhash_dedup, quality, queries
from playbill.session import cut_lineage
from tools import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], FOLDER)))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [s.columns for s in stages[1:-1]] == [stages[0].columns] * 4
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_every_decision_takes_effect(spark, stages):
    docs, good, lines, one, clean, last = stages
    scored = quality.classify(docs, queries.table(spark, FOLDER, "labels"))
    assert ids(good) == ids(scored.filter("predicted = 1"))
    report = {r["doc_id"]: r for r in line_dedup.line_report(good).collect()}
    assert ids(lines) == sorted(i for i, r in report.items() if r["n_kept"] or not r["n_lines"])
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    assert ids(one) == ids(minhash_dedup.near_duplicates(lines, 5).filter("kept"))
    assert ids(clean) == ids(decontaminate.report(one, queries.table(spark, FOLDER, "benchmark")).filter("not contaminated"))
    assert ids(last) == ids(clean)


def test_run_gives_the_last_stage(spark, stages):
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[-1].collect())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    duck = check.connect(FOLDER)
    status, note, _ = check.compare(spark, duck, FOLDER, name, queries.queries()[name], queries.oracle_sql().get(name))
    assert status in ("ok", "rows-only"), note


def test_registered():
    assert {*queries.queries(), "pipeline"} <= set(entry_file.queries())
    assert [s for s, _ in corpus_pipeline.STAGES] and set(queries.oracle_sql()) <= set(entry_file.oracle_sql())


def test_tokens_take_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    found = corpus_pipeline.tokens(spark, docs, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {1: 2, 2: 0}
