from __future__ import annotations

import corpus_pipeline
import pytest
from llm_helpers import awkward, words
from test_llm_text import check_packing, plain_quality, plain_spans

from trailmark.llm import quality
from trailmark.llm.tables import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What went into and came out of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, sf_dir), "stage")
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_return_documents(stages):
    for docs, made in list(stages.values())[:-1]:
        assert made.schema == docs.schema


def test_quality_stage(stages, spark, sf_dir):
    docs, made = stages["quality rules"]
    kept = {r.doc_id for r in made.collect()}
    judged = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert kept == {r.doc_id for r in judged if r.score >= quality.THRESHOLD and not plain_quality(docs_text(docs)[r.doc_id])[-1]}
    assert len(kept) < docs.count()


def test_quality_stage_keeps_clean_documents(spark):
    """Over the next larger table: the smallest has too few trusted documents for its multinomial."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).select("doc_id").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    short = {r.doc_id for r in docs.collect() if plain_quality(r.text)[-1]}
    assert len(clean - short - kept) <= 0.02 * len(clean)


def docs_text(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_language_stage(stages):
    docs, made = stages["language id"]
    assert made.count() >= 0.99 * docs.count()


def plain_groups(texts, width=5):
    """Components of texts whose sets of shingles share 80 %, every pair compared; texts without words are alone."""
    sets = [frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset() for w in map(words, texts)]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[a] if x == label[b] else x for x in label]
    return label


def test_duplicate_stage(stages):
    docs, made = stages["near duplicates"]
    rows = docs.select("doc_id", "text").collect()
    first = {}
    for row, group in zip(rows, plain_groups([r.text for r in rows])):
        first[group] = min(row.doc_id, first.get(group, row.doc_id))
    assert sorted(r.doc_id for r in made.collect()) == sorted(first.values())


def test_duplicate_stage_keeps_different_texts(spark, sf_dir):
    """A copy with 15 % more text and one cut short go; shared and missing ids cost no text."""
    base = " ".join(f"w{k * k % 1009}" for k in range(300))
    added, cut, other = base + " " + " ".join(f"x{k}" for k in range(45)), " ".join(base.split()[:255]), " ".join(f"y{k}" for k in range(60))
    rows = [(2, base, "en", "s"), (1, added, "en", "s"), (3, cut, "en", "s"), (None, other, "en", "s"), (None, other + " z", "en", "s"),
            (9, "one text here", "en", "s"), (9, "and another one", "en", "s"), (9, "one text here", "en", "s"), (None, None, "en", "s"), (None, "", "en", "s")]
    docs = awkward(spark, rows).withColumn("_row", corpus_pipeline.F.lit(7))
    made = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert made.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in made.collect()]
    assert len(kept) == 6 and {(1, added), (9, "one text here"), (9, "and another one"), (None, None), (None, "")} <= set(kept)
    assert {t for _, t in kept} & {other, other + " z"}


@pytest.mark.parametrize("bits", [7, 24])
def test_only_rows_that_may_go_are_moved(spark, monkeypatch, bits):
    """Right with a filter that is nearly full as with one that is nearly empty."""
    monkeypatch.setattr(corpus_pipeline, "FILTER_BITS", bits)
    rows = spark.range(1000).selectExpr("id as k", "id % 7 as word", "cast(id as string) as bits", "1 as `a.b`")
    gone = spark.range(0, 1000, 3).selectExpr("id as k")
    left = corpus_pipeline.without(rows, gone, "k")
    assert left.columns == rows.columns
    assert sorted(map(tuple, left.collect())) == [(k, k % 7, str(k), 1) for k in range(1000) if k % 3]
    assert corpus_pipeline.without(rows, gone.limit(0), "k").count() == 1000
    assert corpus_pipeline.without(rows, rows.select("k"), "k").count() == 0


def test_secret_stage(stages):
    docs, made = stages["secret scan"]
    before, after = docs_text(docs), docs_text(made)
    assert before.keys() == after.keys()
    assert not any(plain_spans(t) for t in after.values())
    assert all(after[k] == t for k, t in before.items() if not plain_spans(t))


def test_packing_stage_and_run(stages, spark, sf_dir):
    docs, made = stages["packing"]
    used, least = check_packing(made.collect(), docs_text(docs).items())
    assert used <= least + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(columns).collect())) == sorted(map(tuple, made.select(columns).collect()))


def test_stages_take_awkward_documents(spark, sf_dir):
    for rows in (None, []):
        docs = awkward(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), "awkward")
        assert docs.count() >= 0
