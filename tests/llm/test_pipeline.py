"""The stages on a small corpus with planted cases, each judged on its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millwright.llm.common import staged, table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, passage = prose(30), prose(60)
    rows = {i: prose(80) for i in range(200)}
    toxic = set(range(0, 200, 10))
    for i in toxic:
        rows[i] = f"{prose(20)} vilewretch {prose(15)} vilewretches {prose(20)}"
    base = rows[1].split()
    base[40] = "changed"
    rows |= {300: rows[2], 301: " ".join(base), 302: f"{prose(50)} {item} {prose(40)}"}
    rows |= {303: f"{prose(70)} {passage} {prose(90)}", 304: f"{prose(80)} {passage} {prose(100)}"}
    folder = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "s", len(t)) for i, t in rows.items()]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic, passage


def test_stages(spark, corpus):
    folder, rows, toxic, passage = corpus
    docs, kept = table(spark, folder, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    assert set(rows) - set(kept["toxicity"]) == toxic
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {300, 301}
    cut = kept["substrings"]
    assert set(cut) == set(kept["near_duplicates"]) and passage in cut[303].text and passage[10:-10] not in cut[304].text
    assert all(r.text == rows[i] for i, r in cut.items() if i != 304) and all(r.n_chars == len(r.text) for r in cut.values())
    assert set(cut) - set(kept["decontamination"]) == {302}
    assert set(kept["packing"]) == set(kept["decontamination"])
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.collect()} == set(kept["packing"])


def test_empty_and_null_documents(spark, corpus):
    folder = corpus[0]
    docs = table(spark, folder, "documents")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    odd = odd.unionByName(docs.limit(1).select(F.lit(5000).cast("long").alias("doc_id"), F.lit("").alias("text"), "lang", "source", "n_chars"))
    for start in (docs.limit(0), odd):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = staged(stage(spark, at, folder), name)
        assert at.count() == start.count()
