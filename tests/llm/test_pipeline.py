import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_lines_and_rules import brute as brute_lines
from test_near_dedup import brute as brute_near
from test_pii import base
from test_tokens import check_packing

import corpus_pipeline as pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_and_kept_rows(steps):
    for before, after in zip(steps, steps[1:-1], strict=False):
        assert after.columns == steps[0].columns and after.count() <= before.count()


def test_toxic_documents_go(spark, steps):
    model = toxicity.train(steps[0], toxicity.learning(spark.read.parquet(f"{SF}/labels.parquet")))
    low = {r.doc_id for r in toxicity.score(steps[0], model).where("score < 0.5").collect()}
    assert {r.doc_id for r in steps[1].collect()} == low


def test_repeated_lines_go(steps):
    import hashlib

    want = {d: h for d, _, _, h in brute_lines([(r.doc_id, r.text) for r in steps[1].collect()])}
    for r in steps[2].collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] and r.n_chars == len(r.text)


def test_one_of_each_group_stays(steps):
    found = brute_near([(r.doc_id, r.text) for r in steps[2].collect()], 5, 80)
    assert {r.doc_id for r in steps[3].collect()} == {d for d, (_, c) in found.items() if c == d}


def test_no_personal_data_stays(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    for r in steps[4].collect():
        assert not base(r.text) and (r.text == before[r.doc_id] or base(before[r.doc_id]) or "[TERM]" in r.text or len(r.text) < len(before[r.doc_id]))


def test_all_is_packed(steps):
    n, total = check_packing(steps[5].collect(), [(r.doc_id, r.text) for r in steps[4].collect()])
    assert n <= 1.05 * -(-total // 1024) + 1
    assert P.path("byte_bpe_50k.json")


def test_run_and_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "call +1 (017) 555-7713 now", "en", "s", 26), (3, "plain words only", None, None, 16), (3, "plain words only", None, None, 16)]
    for name, data in (("full", rows), ("empty", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == len(data)
    assert re.match("[a-z_]+$", pipeline.STAGES[0][0]) and len(pipeline.STAGES) == 5


def test_driver_stays_small(spark, steps, monkeypatch):
    """The toxicity scorer is fitted in a task, not in the driver, and the driver's Java process gives its allocator's memory back with each table."""
    from tidemark.llm import common, linear

    want = toxicity.train(steps[0], toxicity.learning(spark.read.parquet(f"{SF}/labels.parquet")))
    monkeypatch.setattr(linear.Ftrl, "fit", None)  # of this process alone: workers import their own
    got = toxicity.train(steps[0], toxicity.learning(spark.read.parquet(f"{SF}/labels.parquet")))
    assert got.weights and got.weights == want.weights and got.bias == want.bias
    said = []
    monkeypatch.setattr(common, "driver_gives_back", lambda s, of=common.driver_gives_back: said.append(of(s)))
    staged(spark.range(3), "small")
    assert len(said) == 1 and "rim native heap" in said[0]
