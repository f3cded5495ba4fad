import re

import corpus_pipeline
from tessergraph.llm import queries
from tessergraph.llm.common import materialize

from .test_operators import WORD, near_groups, secrets

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    first = stages[0](spark, docs, SMALL)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {k for k, t in before.items() if any(c.isalpha() for c in t)}
    second = stages[1](spark, docs, SMALL)
    assert second.columns == columns and {r["doc_id"] for r in second.collect()} == {c for c, _ in near_groups(before).values()}
    third = stages[2](spark, docs, SMALL)
    assert third.columns == columns
    for r in third.collect():
        spans = secrets(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == before[r["doc_id"]]) == (not spans) and not secrets(re.sub(r"\[(assign|access|hex|random)\]", " ", r["text"]))
    fourth = stages[3](spark, docs, SMALL)
    assert fourth.columns == columns and all(before[r["doc_id"]].startswith(r["text"]) for r in fourth.collect())
    words = sum(len(WORD.findall(r["text"])) for r in fourth.collect())
    assert abs(words - sum(len(WORD.findall(t)) for t in before.values())) <= 20
    assert stages[4](spark, docs, SMALL).where("round_trip").count() == len(before)


def test_stages_on_messy_and_empty_tables(spark, messy, empty):
    for table in (messy, messy.union(messy), empty):
        docs, n = table, []
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SMALL), "test-stage")
            n.append(docs.count())
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert docs.columns == table.columns
        # 13 rows; without letters are 4, 5, 6, 8; near copies of 1 are 2 and both rows of 3, and all rows that come twice
        times = table.count() // 13
        assert n[0] == 9 * times and n[1] == 6 * min(times, 1) and n[2] == n[1] and n[4] == n[3]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 100 and "ids" in rows.columns


def test_every_operator_is_registered():
    assert {re.match(r"op(\d+)_", q)[1] for q in queries.queries()} == {str(k) for k in range(1, 11)}
