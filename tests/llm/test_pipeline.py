"""The pipeline on nulls, repeats, clashing columns and empty tables, and what the near-duplicate stage keeps."""

from __future__ import annotations

import corpus_pipeline

from orthoquilt.llm import simhash

NAMES = "doc_id long, text string, lang string, source string, n_chars long, label string, root long, h long, n int, fp string, __doc long, __mark string, score double"


def test_a_row_goes_only_for_its_own_text(spark, word_soup):
    a, b, c = word_soup(80), word_soup(80), word_soup(80)
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (None, a, "n"), (7, c, "r"), (7, c, "r"), (None, word_soup(80), "only"), (None, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = sorted((r["doc_id"] or -1, r["text"] or "", r["tag"]) for r in simhash.kept_documents(docs).collect())
    assert kept == sorted([(3, a, "x"), (5, b, "z"), (7, c, "r"), (-1, rows[6][1], "only"), (9, "", "f")])


def test_a_hot_fingerprint_is_looked_up(spark, monkeypatch, word_soup):
    monkeypatch.setattr(simhash, "HOT", 5)
    texts = [word_soup(60) for _ in range(4)]
    docs = spark.createDataFrame([(i, texts[0] if i % 2 else texts[i % 4]) for i in range(60)], "doc_id long, text string")
    found = simhash.near_duplicates(simhash.fingerprints(docs)).collect()
    assert len(found) == 60 and {r["component_id"] for r in found} == {0, 2}
    assert {r["doc_id"] for r in simhash.kept_documents(docs).collect()} == {0, 2}


def world(spark, tmp_path, rows, labels):
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, NAMES).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_edge_cases(spark, tmp_path, tricky, word_soup):
    more = lambda k: ("en", f"s{k % 2}", 1, "l", 2, 3, 4, "f", 5, "m", 0.5)
    long = word_soup(300_000)
    texts = [*tricky, word_soup(200), long]
    rows = [(i, t, *more(i)) for i, t in enumerate(texts)] + [(None, word_soup(100), *[None] * 11), (20, texts[20], *more(20))]
    path = world(spark, tmp_path, rows, [(1, None, None), (None, 1, 1)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, path).columns == docs.columns
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p["doc_id"] for p in pieces} >= {None, 20, 21}
    assert len({p["start"] for p in pieces if p["doc_id"] == 20}) == sum(p["doc_id"] == 20 for p in pieces)


def test_empty_tables(spark, tmp_path):
    path = world(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
