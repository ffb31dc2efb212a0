import hashlib
import subprocess
import sys

import pytest

import corpus_pipeline
from tessera.llm import sentencepiece_codec, simhash
from helpers_llm import TEXT

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark, tmp_path, corpus):
    rows = [(i, t, lang or "en", "s", len(t or "")) for i, t, lang, _, _ in corpus]
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows += [(600, f"{corpus[9][1]} {item} {corpus[10][1]}", "en", "s", 1), (601, f"{' '.join(corpus[k][1] for k in range(40, 59))} token = \"0123456789abcdef0123456789abcdef\"", "en", "s", 1),
             (602, "!!".join(corpus[12][1].upper().split()), "en", "s", 1)]
    spark.createDataFrame(rows, TEXT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {name: [r.doc_id for r in got] for name, got in seen.items()}
    assert 602 not in ids["quality_classifier"] and {600, 601, 0, 59, 100} <= set(ids["quality_classifier"])
    kept = [i for i in ids["simhash_dedup"] if i is not None]
    assert 100 in kept and not set(range(101, 132)) & set(kept)
    assert kept.count(5) == 2  # one id, two texts; the repeated row went
    assert set(ids["simhash_dedup"]) - set(ids["benchmark_decontamination"]) == {600}
    text = {r.doc_id: r for r in seen["secret_scan"]}
    assert "0123456789abcdef" not in text[601].text and "[SECRET]" in text[601].text and text[601].n_chars == len(text[601].text)
    assert text[0].text == corpus[0][1]
    codec = sentencepiece_codec.Codec(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    for r in seen["sentencepiece_encoding"]:
        if r.doc_id in (0, 601):
            assert r.ids_sha256 == hashlib.sha256(codec.spell(codec.encode(text[r.doc_id].text)).encode()).hexdigest()


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and len({r.doc_id for r in got}) == len(got)


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", TEXT), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_registered():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_licenses", "op3_decontamination", "op5_secrets"])
def test_sql(spark, name):
    import harness
    got = harness.compare(spark, harness.duck(SF), name, SF)
    assert got["status"] == "ok", got


def test_entry_without_the_subpackage(tmp_path):
    """The rest works with the subpackage and the pipeline file gone."""
    import os
    import shutil
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/tessera", f"{tmp_path}/tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'count_value' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
