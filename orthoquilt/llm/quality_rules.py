"""Quality rules (operator 7), in DataFrame functions only: rules for each document, then for each host.

A document itself goes if it is too short or repeats itself too much. These two rules and three more (`RULES`: symbols, repeated lines,
odd word lengths) are also counted by host. For each rule the hosts' failure rates are shrunk by a beta prior that is fitted to all hosts: its mean is
the overall rate m, and its strength follows from the correlation r of failures within a host (the moments of a beta-binomial, which take out what
chance alone spreads the rates), so a host's shrunk rate of f failures in n documents is (r f + (1 - r) m) / (r n + 1 - r). No bound is put on the strength: at
r = 0 hosts do not differ and all have the rate m, at r = 1 each has its own. The documents of a host of which any shrunk rate is over `HOST_LIMIT` go with
it. A host is what the column `source` names.

Null texts have no words, so they fail; very long texts are taken whole; repeated rows are judged one by one;
rows without a host form one; an empty table gives no rows; extra columns are ignored (and
`kept_documents` hands them on). A rate at the limit exactly is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.llm.common import bounded_or_shuffled, let, stored, table

LEAST_WORDS = 50
MOST_REPEATED = 50
#: Shrunk failure rate over which a host's documents go.
HOST_LIMIT = 0.5
#: The rules that are counted by host, over the struct of statistics.
RULES: dict[str, Callable[[Column], Column]] = {
    "short": lambda s: s["n_words"] < LEAST_WORDS,
    "repeated": lambda s: 100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"],
    "symbols": lambda s: 10 * s["n_symbols"] > s["n_words"],
    "equal_lines": lambda s: 100 * s["n_dup_lines"] > 30 * s["n_lines"],
    "odd_words": lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 12 * s["n_words"]),
}
#: Either fails the document itself.
BASE = ("short", "repeated")
_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_INNER = {"__t", "__w", "__s", "__p", "__l"}


def with_statistics(df: DataFrame, name: str = "__rules", text: str = "text") -> DataFrame:
    """df with a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), base_failed and `failed`, a struct of the rules."""
    own = df.columns
    if _INNER & set(own):  # work beside columns of our names
        away = {c: f"own{c}" for c in own}
        return with_statistics(df.withColumnsRenamed(away), name, away[text]).withColumnsRenamed({v: k for k, v in away.items()})
    out = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    out = let(out, "__w", F.array_remove(F.split("__t", _BLANKS), ""))
    windows = F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    hashed = F.transform(
        windows, lambda x, i: F.struct(F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i"))
    )
    out = let(out, "__s", F.sort_array(hashed))
    twice = F.filter(
        "__s",
        lambda x, i: F.coalesce(x["h"] == F.get("__s", i + 1)["h"], F.lit(False))
        | ((i > 0) & F.coalesce(x["h"] == F.get("__s", F.greatest(i - 1, F.lit(0)))["h"], F.lit(False))),
    )
    out = let(out, "__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window's words that the next such window does not begin with
    covers = F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    out = let(out, "__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(_WORD)))
    n_words, repeated = F.size("__w").cast("long"), F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        *own,
        F.struct(
            n_words.alias("n_words"),
            F.length(F.regexp_replace("__t", _BLANKS, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
        ).alias(name),
    ).withColumn(
        name,
        F.col(name)
        .withField("base_failed", reduce(Column.__or__, (RULES[r](F.col(name)) for r in BASE)))
        .withField("failed", F.struct(*(rule(F.col(name)).alias(r) for r, rule in RULES.items()))),
    )


def rejected_hosts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The hosts (`host`) of judged (host, failed: a struct of booleans) of which any rule's shrunk failure rate is over the limit."""
    rules = judged.schema["failed"].dataType.names
    counts = (F.sum(F.col("failed")[r].cast("double")).alias(f"f_{r}") for r in rules)
    hosts = stored(judged.groupBy("host").agg(F.count("*").cast("double").alias("n"), *counts), "hosts")
    sums = [x for r in rules for x in (F.sum(f"f_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")))]
    total, size, squares, *of_rules = hosts.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("n")), *sums).first()  # one row
    if not size:
        return hosts.select("host")
    tests = []
    for rule, failures, spread in zip(rules, of_rules[::2], of_rules[1::2], strict=True):
        m = failures / total
        by_chance = m * (1 - m)
        inside = by_chance * (total - squares / total - (size - 1))
        r = min(1.0, max(0.0, (spread - total * m * m - by_chance * (size - 1)) / inside)) if inside > 1e-9 else 0.0
        tests.append(F.round((r * F.col(f"f_{rule}") + (1 - r) * m) / (r * F.col("n") + (1 - r)), 9) > limit)
    return hosts.where(reduce(Column.__or__, tests)).select("host")


def judged_documents(df: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of df's doc_id, text and source."""
    stats = with_statistics(df.select("doc_id", "text", F.col("source").alias("host"))).select("doc_id", "host", "__rules.*")
    stats = stored(stats, "statistics")
    bad = bounded_or_shuffled(rejected_hosts(stats.select("host", "failed")))
    bad = bad.select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    return stats.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns as they were. The statistics are computed once and written beside the documents."""
    own, name, host = docs.columns, "__rules", "__bad_host"
    while name in own:
        name += "_"
    while host in own:
        host += "_"
    found = stored(with_statistics(docs, name), "judged")
    bad = bounded_or_shuffled(rejected_hosts(found.select(F.col("source").alias("host"), F.col(name)["failed"].alias("failed")))).withColumnRenamed("host", host)
    good = found.where(~F.col(name)["base_failed"])
    return good.join(bad, F.col("source").eqNullSafe(F.col(host)), "left_anti").select(own)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the rules to all `documents`."""
    return judged_documents(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with w as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
places as (select doc_id, w, unnest(range(1, len(w) - 1)) i from w),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from places),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from windows) where c > 1),
repeated as (select doc_id, count(distinct p) r from (select doc_id, unnest([i, i + 1, i + 2]) p from twice) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) line from w),
doubles as (select doc_id, count(*) k, count(*) - count(distinct line) d from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
stats as (
  select w.doc_id, source host, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(d, 0)::bigint n_dup_lines, coalesce(r, 0)::bigint n_repeat_words, coalesce(k, 0) k
  from w left join repeated using (doc_id) left join doubles using (doc_id)),
failed as (select *, n_words < 50 short, 100 * n_repeat_words > 50 * n_words much, short or much base_failed from stats),
long as (select host, unnest(['short', 'repeated', 'symbols', 'lines', 'words']) rule, unnest([
  short, much, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * k, word_chars < 2 * n_words or word_chars > 12 * n_words]) hit from failed),
hosts as (select rule, host, count(*)::double n, sum(hit::int)::double f from long group by rule, host),
moments as (select rule, sum(n) t, count(*) h, sum(n * n) n2, sum(f) / sum(n) m, sum(f * f / n) q from hosts group by rule),
prior as (select rule, m, case when m * (1 - m) * (t - n2 / t - (h - 1)) > 1e-9
  then least(1.0, greatest(0.0, (q - t * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (t - n2 / t - (h - 1))))) else 0.0 end r from moments),
bad as (select distinct host from hosts join prior using (rule) where round((r * f + (1 - r) * m) / (r * n + 1 - r), 9) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from bad where bad.host is not distinct from failed.host) kept
from failed
"""
