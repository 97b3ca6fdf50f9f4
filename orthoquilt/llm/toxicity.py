"""Toxicity (operator 8) by multiple-instance learning.

A text is a bag of sentences, a sentence a set of features: its lower-case words and their beginnings, so that
other endings of a word are known too. A sentence's chance of being toxic is logistic in its features, whose
weights are not negative, less the chance of a sentence without any. A text's is the noisy-or of its sentences' and a small
leak: 1 - (1 - leak) prod(1 - p). So sentences without evidence add nothing, however many. Only texts have labels; the
gradient of the noisy-or hands each label to the sentences that explain it, so the fitted sentence scores also say where the offence is.

The model is fitted on the driver by proximal gradient steps on a bounded sample: at most `SAMPLE` labelled
texts of each label and `SAMPLE_BYTES` of their words, chosen by a hash of their ids over all labels, weighted back to the labels' true
shares. Every text is scored whole.

Null and blank texts have no sentences and score the leak; very long texts and sentences are scored whole; repeated rows get a row each, equal
texts equal scores; labels that repeat for an id count once, as toxic if any says so, null labels not at all; an empty table gives no rows;
without labels of both kinds every score is the leak; extra columns are ignored (and `kept_documents` hands them on). A score at the limit is toxic.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.llm.common import fold, give_back, small_batches, stored, table

#: Labelled texts of each label that the model is fitted on, at most (about: they are drawn by hash).
SAMPLE = 3000
#: Bytes of the sample's words of each label, at most (one text at least).
SAMPLE_BYTES = 16 << 20
#: Texts of the sample in which a feature must occur to get a weight, and the price of a weight.
LEAST_TEXTS, PRICE = 3, 0.3
#: A feature may get a weight if the toxic share of its texts is so many times that of all.
LIFT = 2.0
STEPS = 150
#: Log odds of a sentence without evidence, and the leak of a text.
QUIET, LEAK = -5.0, 0.001
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: Words whose features a worker remembers.
CACHED = 500_000
#: Score from which a text is toxic.
LIMIT = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


@dataclass
class Model:
    weight: dict[str, float]
    of_word: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def known(self, words: set[str]) -> set[str]:
        """The features of the words that have a weight."""
        cache, found = self.of_word, set()
        for w in words:
            own = cache.get(w)
            if own is None:
                own = tuple(f for f in features(w) if f in self.weight)
                if len(cache) < CACHED:
                    cache[w] = own
            if own:
                found.update(own)
        return found

    def evidence(self, words: set[str]) -> float:
        """-log(1 - p) of a sentence."""
        own = self.known(words)
        return soft(QUIET + sum(map(self.weight.get, sorted(own)))) - soft(QUIET) if own else 0.0

    def judged(self, text: str | None, limit: float = LIMIT) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text, and (begin, end, chance) of the sentences that are toxic by themselves, in its code points."""
        total, found, text = LEAK, [], text or ""
        if self.weight and self.known(set(WORD.findall(text.lower()))):
            for m in SENTENCE.finditer(text):
                own = self.evidence(set(WORD.findall(m[0].lower())))
                if own:
                    total += own
                    p = -math.expm1(-own)
                    if p >= limit:
                        found.append((m.start(), m.end(), p))
        return -math.expm1(-total), found

    def score(self, text: str | None) -> float:
        return self.judged(text)[0]

    def offences(self, text: str | None, limit: float = LIMIT) -> list[tuple[int, int, float]]:
        return self.judged(text, limit)[1]


def soft(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def sentences(text: str | None) -> list[list[str]]:
    """The distinct words of each sentence that has any, lower-case."""
    found = (sorted(set(WORD.findall(x.lower()))) for x in SENTENCE.findall(text or ""))
    return [x for x in found if x]


def distinct(high: np.ndarray, base: int, low: np.ndarray) -> np.ndarray:
    """The distinct values of high * base + low in order, sorted in place."""
    key = high.astype(np.int64)
    key *= base
    key += low
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def fit(bags: pa.Array, label: np.ndarray, importance: np.ndarray) -> Model:
    """A model of texts given as lists of sentences of distinct words."""
    sentences = bags.flatten()
    texts, many = len(bags), max(1, len(sentences))
    text_of = np.repeat(np.arange(texts, dtype=np.int32), bags.value_lengths().fill_null(0).to_numpy())
    sentence_of = np.repeat(np.arange(len(sentences), dtype=np.int32), sentences.value_lengths().to_numpy())
    coded = sentences.flatten().dictionary_encode()
    word, words = coded.indices.to_numpy(), coded.dictionary
    del bags, sentences, coded
    toxic = label == 1
    rate = (importance * toxic).sum() / importance.sum()
    names: list[str] = []
    pairs: list[np.ndarray] = []  # (feature, sentence) of the features chosen, as one number
    for k in (0, *BEGINNINGS):  # words, then beginnings of each length
        begun = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "*", "") if k else words
        kind = (pc.if_else(pc.greater_equal(pc.utf8_length(words), k), begun, None) if k else words).dictionary_encode()
        of_word = kind.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        own = of_word[word]
        at = sentence_of[own >= 0]
        own = own[own >= 0]
        within, of_text = np.divmod(distinct(own, texts, text_of[at]), texts)
        size = len(kind.dictionary)
        every = np.bincount(within, importance[of_text], minlength=size)
        bad = np.bincount(within, (importance * toxic)[of_text], minlength=size)
        chosen = (np.bincount(within, minlength=size) >= LEAST_TEXTS) & (bad >= min(LIFT * rate, (1 + rate) / 2) * every)
        del within, of_text
        use = chosen[own]
        number = np.cumsum(chosen) - 1 + len(names)
        pairs.append(distinct(number[own[use]], many, at[use]))
        names += kind.dictionary.filter(pa.array(chosen)).to_pylist()
    del word, words, own, at, use
    feature, sentence_of = np.divmod(np.concatenate(pairs), many)
    # sentences without a feature add nothing
    own, sentence_of = np.unique(sentence_of, return_inverse=True)
    text_of, n = text_of[own], len(own)
    each = importance / importance.mean()
    weight, seen = np.full(len(names), 0.5), np.full(len(names), 1e-8)
    for _ in range(STEPS):
        z = QUIET + np.bincount(sentence_of, weight[feature], minlength=n)
        softened = np.logaddexp(0, z)
        total = LEAK + np.bincount(text_of, softened - soft(QUIET), minlength=texts)
        push = np.where(toxic, -1 / np.expm1(np.clip(total, 0.01, 50)), 1.0) * each
        g = np.bincount(feature, (push[text_of] * np.exp(z - softened))[sentence_of], minlength=len(names))
        seen += g * g
        pace = 0.5 / np.sqrt(seen)
        weight = np.maximum(weight - pace * (g + PRICE), 0)
    return Model({w: float(x) for w, x in zip(names, weight, strict=True) if x > 1e-3})


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))), "labels")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # a row for each label
    nothing = Model({})
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    part = {k: min(1.0, sample / n) for k, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, F.lit(part[1])).otherwise(F.lit(part[0])) * (1 << 30)
    chosen = F.broadcast(known.where(F.col("h") < limit).select("doc_id", "toxic", "h"))  # at most about two samples of ids
    small_batches(docs.sparkSession)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sentences(t.as_py()) for t in batch.column(1)]
            held = pa.array([sum(len(w) + 8 for x in own for w in x) for own in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.list_(pa.string()))), held, *batch.columns[2:]], ["doc_id", "bag", "held", "toxic", "h"]
            )

    bags = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(bag, "doc_id long, bag array<array<string>>, held long, toxic int, h long")
    bags = stored(bags, "bags")
    upto, seen = {0: 0, 1: 0}, {0: 0, 1: 0}
    by_hash = bags.select("toxic", "h", "held").groupBy("toxic", "h").agg(F.sum("held").alias("held"), F.count("*").alias("n"))  # about two samples of rows
    for k, h, size, _ in sorted(by_hash.collect(), key=lambda r: r["h"]):
        if k in upto and (seen[k] + size <= SAMPLE_BYTES or not seen[k]):
            upto[k] = h + 1
        seen[k] += size  # once full, no later text gets in
    mine = F.when(F.col("toxic") == 1, F.col("h") < upto[1]).otherwise(F.col("h") < upto[0])
    share = {k: min(part[k], upto[k] / (1 << 30)) for k in (0, 1)}  # hashes are even
    model = fitted(bags.where(mine).select("doc_id", "bag", "toxic").toArrow(), share)
    give_back()
    return model


def fitted(got: pa.Table, share: dict[int, float]) -> Model:
    """The model of the rows (doc_id, bag, toxic) of a sample that holds such a share of each label."""
    got = got.sort_by("doc_id")
    label = got["toxic"].to_numpy()
    if len(set(label.tolist()) & {0, 1}) < 2:
        return Model({})
    bags = [got["bag"].combine_chunks()]
    del got
    # handed over, so the words go once they are numbered
    return fit(bags.pop(), label, np.where(label == 1, 1 / share[1], 1 / share[0]))


OFFENCES = "array<struct<begin: int, end: int, score: double>>"


def with_scores(df: DataFrame, model: Model, score: str = "score", text: str = "text", offences: str | None = None) -> DataFrame:
    """df with the chance that its text is toxic and, if a name is given for them, the sentences that are toxic by themselves."""
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    made = [T.StructField(score, T.DoubleType())]
    if offences:
        made.append(T.StructField(offences, T._parse_datatype_string(OFFENCES)))
    names = [f.name for f in made]
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *made])
    at = df.columns.index(text)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n not in names]
            found = [model.judged(t.as_py()) for t in batch.column(at)]
            columns = [pa.array([x for x, _ in found], pa.float64())]
            if offences:
                columns.append(pa.array([[dict(zip(("begin", "end", "score"), x, strict=True)) for x in own] for _, own in found], kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], [*(batch.schema.names[i] for i in keep), *names])

    return df.mapInArrow(run, schema)


def located(df: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id and the offending sentences (begin, end, score) of df's doc_id and text; texts without any give no row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in model.offences(t.as_py(), limit)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "begin", "end", "score"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, end long, score double")


def kept_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """docs without the toxic ones, all columns as they were."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return with_scores(docs, learned(docs, labels), name).where(F.col(name) < limit).select(docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of `documents` and locates the offending sentences; labels of the held-out quarter are not used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held)
    found = with_scores(docs, learned(docs, labels), offences="offences").drop("text")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "offences")
