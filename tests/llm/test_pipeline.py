import corpus_pipeline
import pytest
from quire.llm import queries

from .conftest import EDGES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        before, result = docs, stage(spark, docs, SMALL)
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "near_duplicates", "decontaminate", "personal_data", "byte_bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_decisions_take_effect(spark, stages):
    kept = {name: ({r.doc_id for r in b.collect()}, {r.doc_id for r in a.collect()}) for name, b, a in stages}
    scored = queries.op3_toxicity(spark, SMALL)
    assert kept["toxicity"][1] == {r.doc_id for r in scored.where("predicted = 0").collect()}
    before = next(b for name, b, _ in stages if name == "near_duplicates")
    groups = queries.neardup.near_duplicates(before)
    assert kept["near_duplicates"][1] == {r.doc_id for r in groups.where("kept").collect()}
    before, after = next((b, a) for name, b, a in stages if name == "decontaminate")
    leaks = queries.decontaminate.leaks(before, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert kept["decontaminate"][1] == kept["decontaminate"][0] - {r.doc_id for r in leaks.collect()}
    before, after = next((b, a) for name, b, a in stages if name == "personal_data")
    assert kept["personal_data"][0] == kept["personal_data"][1]
    assert after.where("text rlike '[a-z]@mail[0-9]'").count() == 0
    assert after.where("n_chars <> char_length(text)").count() == 0


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stages[-1][2].select(rows.columns).collect()))


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) <= set(names) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def documents(spark, rows):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("int").alias("n_chars"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_edges_of_each_stage(spark, name, stage):
    docs = documents(spark, EDGES)
    found = stage(spark, docs, SMALL)
    rows = found.collect()
    key = lambda r: str(r.doc_id)
    # None of these is toxic, a near copy of another, from the benchmark or personal data.
    assert sorted(map(key, rows)) == sorted(str(i) for i, _ in EDGES)
    if name == "byte_bpe":
        assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    else:
        assert found.dtypes == docs.dtypes
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    assert stage(spark, documents(spark, []), SMALL).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_clashing_columns_of_each_stage(spark, table, name, stage):
    frame = table([(1, "plain words of a text"), (2, None), (2, "")]).drop("decoded")
    found = stage(spark, frame, SMALL)
    assert found.columns == frame.columns and found.count() == 3
    own = {"toxicity": {"score"}, "personal_data": {"spans"}}.get(name, set())
    for r in found.collect():
        assert all(r[c] == v for c, v in {"ids": 1, "keys": 2, "kept": 5, "rep": "z", "unit": "u"}.items() if c not in own)


def test_repeated_rows_share_a_decision(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(7, text), (7, text), (3, text), (9, None), (9, None)]
    kept = queries.stage_near_duplicates(spark, documents(spark, rows), SMALL)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "9"]
    hidden = queries.stage_personal_data(spark, documents(spark, [(1, "at 10.0.0.1"), (1, "at 10.0.0.1")]), SMALL)
    assert [(r.text, r.n_chars) for r in hidden.collect()] == [("at <IP>", 7)] * 2
