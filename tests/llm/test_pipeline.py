"""The pipeline's stages against their operators, each on its own input."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import packing, quality, simhash, toxicity
from loam.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, given = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {}
    for name, function in corpus_pipeline.STAGES:
        out[name] = function(spark, given, SF)
        if name != "packing":
            assert out[name].columns == docs.columns
            out[name] = spark.createDataFrame(out[name].collect(), docs.schema)
        given = out[name]
    ids = {n: Counter(r.doc_id for r in out[n].collect()) for n in names}
    toxic = {r.doc_id for r in toxicity.classify(docs, labels).collect() if r.predicted}
    assert set(ids["toxicity"]) == {r.doc_id for r in docs.collect()} - toxic
    bad = {r.doc_id for r in quality.classify(out["toxicity"], labels).collect() if not r.predicted}
    assert set(ids["quality"]) == set(ids["toxicity"]) - bad
    assert set(ids["near_dedup"]) == {r.component_id for r in simhash.similar_groups(out["quality"]).collect()}
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and max(ids["mixing"].values()) <= 3
    pieces = Counter(r.doc_id for r in packing.pack_documents(out["mixing"]).collect())
    assert ids["packing"] == pieces


def test_run_leaves_no_staged_table_but_its_last(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    packed = corpus_pipeline.run(spark, SF)
    assert all(len(r.ids) == r.length for r in packed.collect())
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before if p.name.startswith("loam-")}
    assert "mixing" in left and not left & {"toxicity", "quality", "near_dedup", "rows", "fingerprints", "edges", "ranges"}


@pytest.mark.parametrize("function", [corpus_pipeline.drop_toxic, corpus_pipeline.keep_good])
def test_stages_without_labelled_documents_fail(spark, function):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", -F.col("doc_id") - 1)
    with pytest.raises(ValueError, match="0 labelled documents"):
        function(spark, docs, SF)
