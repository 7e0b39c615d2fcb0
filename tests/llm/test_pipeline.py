"""Every stage of the corpus pipeline against its operator's plain form."""

import corpus_pipeline
from ipaloom.llm import util

from .test_documents import brute_groups

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = util.read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        docs = util.materialize(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(after) <= set(before)
        if name == "quality classifier":
            bad = {r["doc_id"] for r in util.read(spark, SF, "labels").where("quality = 0").collect()}
            assert len(bad & set(after)) <= 0.1 * len(bad) and len(after) > 0.8 * (len(before) - len(before) * 0.14)
        if name == "near duplicates":
            assert set(after) == set(brute_groups(before, 5, 80).values())
        if name == "secret scan":
            assert set(after) == set(before) and not any("token = " in (t or "") for t in after.values())
        if name == "packing":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
