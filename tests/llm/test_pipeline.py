import pytest

import corpus_pipeline
from crashgrid.llm.bpe import token_digests
from crashgrid.llm.decontaminate import find_contamination
from crashgrid.llm.queries import tokenizer_path
from crashgrid.llm.secret_scan import find_secrets
from crashgrid.llm.simhash import simhash_components
from crashgrid.llm.toxicity import score_toxicity, train_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's stored result, by name, and the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_each_stage_keeps_what_its_operator_says(spark, stages):
    names = ["documents", *(n for n, _ in corpus_pipeline.STAGES)]
    for name in names[1:-1]:
        assert stages[name].columns == stages["documents"].columns
    docs = stages["documents"]
    scored = score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(stages["toxicity"]) == ids(scored.where("predicted = 0"))
    classes = simhash_components(stages["toxicity"])
    assert ids(stages["simhash_near_dedup"]) == ids(classes.where("doc_id = component_id"))
    leaks = find_contamination(stages["simhash_near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(stages["benchmark_decontamination"]) == ids(leaks.where("not contaminated"))
    assert ids(stages["secret_scan"]) == ids(stages["benchmark_decontamination"])
    assert find_secrets(stages["secret_scan"]).where("n_assign + n_access + n_hex > 0").count() == 0
    changed = stages["secret_scan"].join(stages["benchmark_decontamination"].withColumnRenamed("text", "before"), "doc_id")
    assert changed.where("text <> before").count() == find_secrets(
        stages["benchmark_decontamination"]).where("spans <> ''").count()
    assert stages["secret_scan"].where("n_chars <> length(text)").count() == 0
    final = sorted(map(tuple, stages["bpe"].collect()))
    assert final == sorted(map(tuple, token_digests(stages["secret_scan"], tokenizer_path()).collect()))


def test_run_gives_the_last_stage(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages["bpe"])


def test_edge_rows_pass_through_every_stage(spark, documents):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "One text here", "en", "s", 13),
                                  (3, "One text here", "en", "s", 13), (None, "no id text", None, None, 10),
                                  (4, "password=abcdefghijklmnop", "en", "s", 25)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert set(rows) == {1, 3, 4, None} and docs.count() == 4
