"""The whole pipeline against a plain version of each stage, and the list of registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from exposura.llm.queries import vocabulary_path
from exposura.llm.secrets import find_secrets
from tests.llm.test_corpus_operators import contained, jaccard_groups, prose


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(20, 80)) for _ in range(220)]
    for i in range(0, 220, 4):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "worthless"
        texts[i] = " ".join(words)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(8)]
    texts += [f"{prose(rng, 30)} {items[i % 8][1]} {prose(rng, 30)}" for i in range(10)]  # contaminated
    texts += [texts[i] + " tail" for i in (1, 2, 3)] + [texts[5]] * 3  # near and exact copies
    texts += [f"{prose(rng, 15)} token=abcdefghijkl12 {prose(rng, 15)}", None, ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[7])
    labels = [(i, 1, int(i % 4 == 0)) for i in range(220)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), rows, items


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    path, rows, items = folder
    kept = {r[0]: r[1] for r in rows if "worthless" not in (r[1] or "").split()}
    groups = jaccard_groups(list(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    hit = {d for d, _ in contained(list(kept.items()), items)}
    assert hit
    library = Tokenizer.from_file(vocabulary_path())
    expected = {}
    for doc, text in kept.items():
        if doc in hit:
            continue
        spans, out, at = find_secrets(text or "")[1], "", 0
        for start, _, end in spans:
            out += (text[at:start] + "[SECRET]") if start >= at else ""
            at = max(at, end)
        expected[doc] = out + (text or "")[at:]
    assert any("[SECRET]" in t for t in expected.values())
    result = corpus_pipeline.run(spark, path).collect()
    assert len(result) == len(expected)
    for r in result:
        assert r.ids == library.encode(expected[r.doc_id], add_special_tokens=False).ids and r.round_trip and r.n_tokens == len(r.ids)


def test_stages_keep_columns_and_empty_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty.withColumn("score", F.lit("x")), path)
        assert out.collect() == []
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == [*docs.columns, "score"]


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated])
def test_stages_shuffle_no_text_that_stays(spark, folder, stage):
    """to drop a few documents, all texts were shuffled; now those that a bitmap of the dropped ids names."""
    path, _, _ = folder
    out = stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftAnti" in line)
    assert "Union" in "".join(plan[:at]) and "_bits#" in "".join(plan[at:at + 6])  # the bitmap is asked before the join


def test_every_operator_has_a_query():
    names = entry_points.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entry_points.oracle_sql()) <= set(names)
