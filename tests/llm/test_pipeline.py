"""The pipeline: each stage against what it should keep, on clean, repeated, odd and empty documents."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabloom.llm import toxicity
from tabloom.llm.queries import ORACLES
from tests.conftest import DATA
from tests.llm.test_operators import ODD, SCHEMA, brute_groups


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_copies", "pii", "mixing", "sentencepiece"]


def in_duckdb(frame, path, sql):
    """Rows of SQL over a frame as documents, as dicts."""
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return [dict(zip(names, row, strict=True)) for row in result.fetchall()]


def plainly_redacted(text, spans):
    """The text with its spans (kind:start:end) replaced, overlapping ones as one by the first's kind."""
    out, end = [], 0
    for start, back, kind in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, -back)
    return "".join(out) + text[end:]


def test_stages_against_brute_force(spark, docs, tmp_path):
    sf, names = "/root/testdata/sf0.01", docs.columns
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    clean = pipeline.drop_toxic(spark, docs, sf).cache()
    assert clean.columns == names
    scores = {r.doc_id: r.predicted for r in toxicity.add_toxicity(docs, toxicity.trained(spark, docs, sf)).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}
    single = pipeline.drop_near_copies(spark, clean, sf).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups}) and single.columns == names
    hidden = pipeline.redact_pii(spark, single, sf).cache()
    assert hidden.count() == single.count() and hidden.columns == names and hidden.where("n_chars <> char_length(text)").count() == 0
    texts = {r.doc_id: r.text for r in single.collect()}
    spans = {r["doc_id"]: r["spans"] for r in in_duckdb(single, f"{tmp_path}/single", ORACLES["op3_pii"])}
    assert {r.doc_id: r.text for r in hidden.collect()} == {i: plainly_redacted(t or "", spans[i]) for i, t in texts.items()} and any(spans.values())
    mixed = pipeline.mix_sources(spark, hidden, sf).cache()
    mix = in_duckdb(hidden, f"{tmp_path}/hidden", ORACLES["op4_mixing"])
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["taken"] // r["size"] for r in mix if r["taken"]}
    assert mixed.distinct().count() == mixed.select("doc_id").distinct().count() and mixed.join(hidden, hidden.columns, "left_anti").isEmpty()
    assert mixed.columns == names and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    last = pipeline.to_ids(spark, mixed, sf)
    assert last.count() == mixed.count() and last.where("not round_trip").count() == 0


def test_run(spark, docs):
    out = pipeline.run(spark, DATA)
    assert 0 < out.count() <= 3 * docs.count()


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_odd_and_empty(spark, name, stage):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("__n", "__m", "__id", "m", "n", "k", "size", "digest", "copies", "score", "predicted", "pii", "in_text", "key", "mark", "w")})
    out = stage(spark, odd, DATA)
    rows = out.collect()
    assert rows
    if name != "sentencepiece":
        assert out.columns == odd.columns and {r["m"] for r in rows} == {"clash"}
    if name == "near_copies":
        assert len(rows) == len(ODD) - 1
    if name in ("pii", "sentencepiece"):
        assert len(rows) == len(ODD)
    assert stage(spark, odd.limit(0), DATA).count() == 0
