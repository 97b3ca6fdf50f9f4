"""Operators 8 and 10: held-out accuracy and edge cases; the pipeline against brute force."""

from __future__ import annotations

import math
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from test_tokenising import check_packing

from orthoquilt.llm import quality_classifier, quality_rules, simhash, toxicity
from orthoquilt.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def outcome(spark, name, label, of, held):
    found = QUERIES[name](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    out = [r for r in rows if r["held_out"]]
    return sum(r["predicted"] == r[label] for r in out) / len(out)


def test_toxicity_held_out(spark):
    assert outcome(spark, "op8_toxicity", "toxic", 4, 2) > 0.95


def test_quality_held_out(spark):
    assert outcome(spark, "op10_quality_classifier", "quality", 5, 0) > 0.97


def test_toxicity_finds_the_sentence(spark):
    clean = ["the weather was fine. we went home early.", "a long walk. nothing more to say here."]
    rows = [(i, f"{clean[i % 2]} you rotten fool number {i}. {clean[i // 2 % 2]}" if i % 3 == 0 else clean[i % 2] * 3) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert model.score(rows[0][1]) > 0.9 > 0.1 > model.score(clean[0] * 2000)
    (begin, end, p), *rest = model.offences(rows[0][1])
    assert not rest and p > 0.9 and "rotten fool" in rows[0][1][begin:end]
    assert toxicity.located(docs, model).select("doc_id").distinct().count() == 40


def test_noisy_or_by_hand(spark):
    """Scores from the weights by the formula; long sentences are one sentence, and where a text ends does not matter."""
    model = toxicity.Model({"bad": 4.0, "rotte*": 3.0, "fool": 6.5})
    quiet = 1 / (1 + math.exp(5))

    def chance(z):  # of a sentence, less that of one without evidence
        return 1 - (1 - 1 / (1 + math.exp(5 - z))) / (1 - quiet)

    def by_hand(*sums):
        good = math.exp(-0.001)
        for z in sums:
            good *= 1 - chance(z)
        return 1 - good

    filler = " ".join(f"word{k}" for k in range(100))
    cases = {
        "": by_hand(), "nothing here. at all": by_hand(), "a bad day": by_hand(4), "bad bad BAD": by_hand(4), "bad. Rottenness! you fool": by_hand(4, 3, 6.5),
        "bad rotten fool": by_hand(13.5), f"bad {filler} fool": by_hand(10.5), f"bad {filler}. fool": by_hand(4, 6.5),
    }
    for text, want in cases.items():
        assert abs(model.score(text) - want) < 1e-9, text
    text = f"Fine. İ am a rotten {filler} fool! bad"
    ((begin, end, p),) = model.offences(text)
    assert text[begin:end].strip().startswith("İ am") and abs(p - chance(9.5)) < 1e-9
    found = toxicity.with_scores(spark.createDataFrame([(text, 1, "x")], "text string, score int, offences string"), model, offences="offences").first()
    assert found["offences"] == [(begin, end, p)] and abs(found["score"] - by_hand(9.5, 4)) < 1e-9


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    rows = [(i, f"rotten fool {i}" if i % 2 else f"fine day {i}") for i in range(200)] + [(200, "fine " + " ".join(f"w{k}" for k in range(5000)))]
    model = toxicity.learned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert model.score("rotten fool") > 0.5 > model.score("fine day")


def plain_statistics(text):
    """The statistics one by one, from their definitions."""
    text = text or ""
    words, n = text.split(), len(text.split())
    size = max(1, len(text.encode()))
    count = lambda chars: sum(c in chars for c in text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda a, b: math.log(0.002 + a / max(1, b))
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log(1 + n), math.log(1 + size / max(1, n)), math.log(max(1, n) / max(1, len(set(words)))) / (1 + math.log(1 + n)),
        share(count(upper), count(upper + lower)), share(count("#$%&*"), size), share(count("!?"), size), share(count("<>|"), size),
        share(count(",."), n), share(count("0123456789"), size), math.log(0.002 + (1 - len(set(windows)) / len(windows) if windows else 0)),
        share(sum(words[i] == words[i + 1] for i in range(n - 1)), n), math.log(0.002 + (1 - len(set(lines)) / len(lines) if lines else 0)),
        share(max((words.count(w) for w in set(words)), default=0), n),
    ]


def test_statistics_by_definition(tricky, word_soup):
    for text in [*tricky, word_soup(200), "a a a b\nx y\nx y\n", "WHAT?! $5 <b> a,b. c|d 12"]:
        assert np.allclose(quality_classifier.statistics(text), plain_statistics(text)), text


def test_toxicity_edge_cases(spark, documents, no_documents):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20)], "doc_id long, toxic int")
    none = toxicity.learned(documents, labels.where("toxic = 1"))
    assert none.weight == {} and none.score("anything") == none.score(None) < 0.01
    kept = toxicity.kept_documents(documents, labels.where("false"))
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert toxicity.kept_documents(no_documents, labels).count() == 0
    assert toxicity.with_scores(documents, toxicity.learned(documents, labels)).count() == documents.count()


def test_quality_edge_cases(spark, documents, no_documents, tricky):
    for t in tricky:
        assert len(quality_classifier.statistics(t)) == len(quality_classifier.FEATURES)
    stats = quality_classifier.with_statistics(documents)
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, None), (None, 0), (2, 0)], 0.0)):
        model = quality_classifier.learned(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["score"] for r in quality_classifier.scored(stats, model).collect()} == {want}
    mixed = spark.createDataFrame([(i, i % 2) for i in range(18)], "doc_id long, quality int")
    model = quality_classifier.learned(stats, mixed)
    scores = [r["score"] for r in quality_classifier.scored(stats, model).collect()]
    assert len(scores) == documents.count() and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.scored(quality_classifier.with_statistics(no_documents), model).count() == 0


def test_discriminant_equals_the_density(spark):
    rng = np.random.default_rng(1)
    k = len(quality_classifier.FEATURES)
    x, y = rng.normal(size=(400, k)), rng.integers(0, 2, 400)
    x[y == 1] *= 1.5
    model = quality_classifier.model_of(
        {c: float((y == c).sum()) for c in (0, 1)}, {c: x[y == c].sum(0) for c in (0, 1)}, {c: x[y == c].T @ x[y == c] for c in (0, 1)}
    )
    logs = []
    for m, inverse, det, prior in model.classes:
        cov = np.linalg.inv(inverse.T @ inverse)
        d = x - m
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + prior)
    assert np.allclose(model.differences(x), logs[1] - logs[0])
    slope, shift = quality_classifier.curve(np.arange(-3.0, 4), np.array([9, 8, 6, 5, 3, 1, 0.0]), np.array([0, 1, 3, 5, 6, 8, 9.0]))
    assert slope > 0 and abs(shift) < 0.1


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    (_, toxic), (_, rules), (_, near), (_, packed) = corpus_pipeline.STAGES
    model = toxicity.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = toxic(spark, docs, sf)
    assert first.columns == docs.columns
    assert ids(first) == {d for d, t in rows.items() if model.score(t) < 0.3}
    second = rules(spark, first, sf)
    assert second.columns == docs.columns
    assert ids(second) == {r["doc_id"] for r in quality_rules.judged_documents(first).where("kept").collect()}
    third = near(spark, second, sf)
    assert third.columns == docs.columns
    classes = simhash.near_duplicates(simhash.fingerprints(second))
    assert ids(third) == {r["component_id"] for r in classes.collect()}
    pieces = corpus_pipeline.run(spark, sf)
    assert ids(pieces) == ids(third)
    from tokenizers import Tokenizer

    from orthoquilt.llm.common import tokenizer_file

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    raw = {d: np.array([*library.encode(rows[d] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for d in ids(third)}
    check_packing(pieces.collect(), {(d, len(b) // 4): b for d, b in raw.items()})


LEAN = """
import random, re
import numpy as np, pyarrow as pa
from orthoquilt.llm import toxicity
r = random.Random(3)
words = [f"word{i * 7919}" for i in range(60_000)]
def bag(k):
    return [[r.choice(words) for _ in range(12)] + (["vile"] if k % 2 and x == 0 else []) for x in range(40)]
bags = [pa.concat_arrays([pa.array([bag(k) for k in range(n, n + 100)], pa.list_(pa.list_(pa.string()))) for n in range(0, 3000, 100)])]
label = np.arange(3000) % 2
size = bags[0].nbytes
held = lambda what: int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) * 1024
open("/proc/self/clear_refs", "w").write("5")
before = held("VmRSS")
model = toxicity.fit(bags.pop(), label, np.ones(3000))
assert model.weight["vile"] > 1
print((held("VmHWM") - before) / size)
"""


def test_the_fit_takes_little_of_the_drivers_memory():
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", LEAN], cwd=top, env=os.environ | {"PYTHONPATH": top}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 4, done.stdout  # times the sample's own bytes


def test_a_fit_without_words():
    bags = pa.array([[], []], pa.list_(pa.list_(pa.string())))
    assert toxicity.fit(bags, np.array([0, 1]), np.ones(2)).weight == {}
