"""URL filter (operator 6), in DataFrame functions only: rules first, then a path-template tree for each host.

The tree's levels are the path segments, all of them. Digits and long hexadecimal runs within a segment are variable by their form. From the
root down, a node is variable if over `MANY` of its segments are rare (fewer than `RARE` pages or one in `RARE_SHARE` of the node's)
and these are at least half of its segments, whatever the others hold; the rare ones become a wildcard. Then, again from the root down,
sibling branches whose children are spread alike (a chi-squared test against their pool) and that lie on the same side of purity (blocked,
allowed, or without labels) merge into a wildcard. Each round first walks what all paths of a node have in common, so the rounds
grow with the branchings of a path, not with its length.

The labels are the rules' verdicts. A template's purity is the share of blocked pages among its labelled ones, smoothed by
`HOST_WEIGHT` pages of its host's rate (the same share over the host, smoothed towards `PRIOR`) and `PRIOR_WEIGHT` pages of `PRIOR`; over a half, the
template is rejected. Unlabelled pages count for neither side. The weights are chosen so that a host alone can reject
nothing (4 * 1 + 6 * 0.1 = 4.6 of 10): a rule on a host's `/de/` says nothing on its `/en/`. On a host that is otherwise blocked one labelled page
of a template suffices, on a host that is otherwise allowed nine.

All counts are taken on distinct (host, path form) leaves, after partial aggregation: no host's pages meet in one task.

Null urls and urls without `://` have an empty host and path and fall under no rule; very long urls are
taken whole; repeated rows count and are judged one by one; an empty table gives no rows; extra columns
are ignored. At a purity of exactly one half a template stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.llm.common import bounded_or_shuffled, stored, table

#: A node is variable from more than so many rare segments on; a rare one has fewer than so many pages, or under one in so many of the node's.
MANY, RARE, RARE_SHARE = 10, 5, 1000
#: Pages that smoothing counts for the host's rate and for the prior, and the prior share of blocked pages.
HOST_WEIGHT, PRIOR_WEIGHT, PRIOR = 4.0, 6.0, 0.1
REJECT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def parsed(df: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule and label (the rule's verdict)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    out = df.withColumn("__rest", rest).withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0))
    out = out.withColumn("host", F.translate("__host", _UPPER, _LOWER))
    name = label = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest stands outermost
        fits = r.fits(F.col("host"), F.col("path"))
        name, label = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(label)
    return out.withColumn("rule", name).withColumn("label", label).drop("__rest", "__host")


def segments(path: Column) -> Column:
    """The forms of all segments of a path."""
    low = F.translate(path, _UPPER, _LOWER)
    # a long hexadecimal run is a whole segment; runs of digits are replaced anywhere
    low = F.regexp_replace(low, "(?<=/)[0-9a-f-]{16,}(?=/|$)", "{id}")
    return F.slice(F.split(F.regexp_replace(low, "[0-9]+", "{n}"), "/"), 2, 1 << 30)


def stripped(live: DataFrame, least: int) -> DataFrame:
    """live (host, at, rest, ...) with what all rests of a node (host, at) begin with moved to `at`; all of them, if the node has fewer rows than `least`."""
    pair = F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi")))
    # the least and the greatest of a set of sequences share what all share
    common = F.aggregate(
        F.when((F.size("lo") > 0) & (F.size("hi") > 0), pair).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.get("lo", i - 1) == F.get("hi", i - 1)), i).otherwise(k),
    )
    ends = live.groupBy("host", "at").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.count("*").alias("rows"))
    ends = ends.select("host", "at", F.when(F.col("rows") >= least, common).alias("k"))
    found = live.join(ends, ["host", "at"]).withColumn("k", F.coalesce("k", F.size("rest")))
    moved = {"at": F.concat("at", F.slice("rest", F.lit(1), F.col("k"))), "rest": F.slice("rest", F.col("k") + 1, F.size("rest"))}
    return found.withColumns(moved).drop("k")


def grown(leaves: DataFrame, wild_of: Callable[[DataFrame], DataFrame], least: int) -> DataFrame:
    """leaves (host, rest, ...) with the path `at` to which rest leads: node by node from the root down, the
    branches (host, at, seg) that wild_of gives take the segment `wild` that it gives for them. Nodes of fewer leaves than
    `least` cannot have any such branch below them, so they are not walked. A round is one job; its joins
    broadcast a side only if it has turned out small at run time."""
    live, done = leaves.withColumn("at", F.array().cast("array<string>")), []
    while True:
        live = stripped(live, least).withColumn("seg", F.get("rest", F.lit(0)))
        found = live.join(wild_of(live.where("seg is not null")), ["host", "at", "seg"], "left")
        seg = F.coalesce("wild", "seg")
        at = F.when(seg.isNull(), F.col("at")).otherwise(F.concat("at", F.array(seg)))
        found = found.withColumns({"at": at, "rest": F.slice("rest", F.lit(2), F.size("rest")), "over": F.col("seg").isNull()})
        found = stored(found.drop("seg", "wild"), "tree")
        done.append(found.where("over"))
        live = found.where("not over").drop("over")
        if not live.take(1):
            return reduce(DataFrame.unionByName, done).drop("rest", "over")


def variable(live: DataFrame) -> DataFrame:
    """The rare branches of variable nodes. No segment of a path holds a slash, so wildcards do."""
    branch = live.groupBy("host", "at", "seg").agg(F.sum("n").alias("m"))
    node = branch.groupBy("host", "at").agg(F.sum("m").alias("s"), F.count("*").alias("d")).where(F.col("d") > MANY)
    rare = branch.join(node, ["host", "at"]).where((F.col("m") < RARE) | (F.col("m") * RARE_SHARE < F.col("s")))
    wide = rare.groupBy("host", "at").agg(F.count("*").alias("r"), F.first("d").alias("d")).where((F.col("r") > MANY) & (2 * F.col("r") >= F.col("d")))
    return rare.join(wide.select("host", "at"), ["host", "at"]).select("host", "at", "seg", F.lit("/*").alias("wild"))


def alike(live: DataFrame) -> DataFrame:
    """The branches that are spread like the pool of their node's branches on the same side, if at least two are."""
    node = ["host", "at"]
    cells = live.groupBy(*node, "seg", F.slice("rest", F.lit(2), F.size("rest")).alias("below")).agg(
        F.sum("n").alias("o"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    side = F.when(F.sum("bad") + F.sum("good") == 0, "/?").when(F.sum("bad") > F.sum("good"), "/-").otherwise("/+")
    branch = cells.groupBy(*node, "seg").agg(F.sum("o").alias("m"), side.alias("side"))
    several = branch.groupBy(*node, "side").agg(F.count("*").alias("k")).where("k > 1").select(*node, "side")
    cells = stored(cells.join(branch.join(several, [*node, "side"]), [*node, "seg"]), "cells")
    pool = cells.groupBy(*node, "side", "below").agg(F.sum("o").alias("p"))
    all_of = pool.groupBy(*node, "side").agg(F.sum("p").alias("total"), (F.count("*") - 1).alias("df"))
    # sum of (o - e)^2 / e over all cells is the sum of o^2 / e over those that occur, less the branch's pages
    test = (
        cells.join(pool, [*node, "side", "below"]).join(all_of, [*node, "side"])
        .groupBy(*node, "seg", "side", "m", "df").agg(F.sum(F.col("o") * F.col("o") * F.col("total") / (F.col("p") * F.col("m"))).alias("x"))
        .where(F.round(F.col("x") - F.col("m"), 6) <= F.col("df") + 3 * F.sqrt(2.0 * F.col("df")))
    )
    groups = test.groupBy(*node, "side").agg(F.count("*").alias("k")).where("k > 1").select(*node, "side")
    return test.join(groups, [*node, "side"]).select(*node, "seg", F.col("side").alias("wild"))


def templates(pages: DataFrame) -> DataFrame:
    """host, leaf, and the template and purity of each leaf of pages (host, leaf, label)."""
    of = lambda label: F.sum(F.when(F.col("label") == label, 1.0).otherwise(0.0))
    leaves = pages.groupBy("host", "leaf").agg(F.count("*").cast("double").alias("n"), of("block").alias("bad"), of("allow").alias("good"))
    leaves = stored(leaves, "leaves")
    wild = grown(leaves.withColumn("rest", F.col("leaf")), variable, MANY + 1).withColumnRenamed("at", "rest")
    found = stored(grown(wild, alike, 2).withColumnRenamed("at", "template"), "templates")
    share = lambda weight, prior: (F.sum("bad") + weight * prior) / (F.sum("bad") + F.sum("good") + weight)
    hosts = found.groupBy("host").agg(share(PRIOR_WEIGHT, PRIOR).alias("rate"))
    counts = found.groupBy("host", "template").agg(F.sum("bad").alias("bad"), (F.sum("bad") + F.sum("good")).alias("known"))
    smoothed = (F.col("bad") + HOST_WEIGHT * F.col("rate") + PRIOR_WEIGHT * PRIOR) / (F.col("known") + HOST_WEIGHT + PRIOR_WEIGHT)
    pure = counts.join(hosts, "host").select("host", "template", F.round(smoothed, 9).alias("purity"))
    return found.select("host", "leaf", "template").join(pure, ["host", "template"])


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of df's page_id and url."""
    pages = parsed(df.select("page_id", "url"), rules)
    pages = pages.select("page_id", "host", "path", "rule", "label", segments(F.col("path")).alias("leaf"))
    gone = bounded_or_shuffled(templates(pages).where(F.col("purity") > REJECT).select("host", "leaf", F.lit("block").alias("gone")))
    return pages.join(gone, ["host", "leaf"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("label", "gone", F.lit("allow")).alias("verdict")
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of `pages`."""
    return judged(table(spark, sf_dir, "pages"))


#: Levels that the SQL is written out for; the paths of the tables have at most three segments. The operator has no such bound.
SQL_DEPTH = 5


def _sql() -> str:
    fits = " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    )
    label = " ".join(f"when '{r.name}' then '{r.verdict}'" for r in RULES)
    steps, last = [], "leaves"
    every = [f"g{k + 1}" for k in range(SQL_DEPTH)]
    for i, g in enumerate(every):
        above = ", ".join(["host", *every[:i]])
        steps.append(f"""
wb{i} as (select {above}, {g}, sum(n) m from {last} where {g} is not null group by all),
wn{i} as (select {above}, sum(m) s, count(*) d from wb{i} group by all),
wr{i} as (select {above}, {g}, d from wb{i} join wn{i} using ({above}) where m < {RARE} or m * {RARE_SHARE} < s),
ww{i} as (select {above} from wr{i} group by all having count(*) > {MANY} and 2 * count(*) >= any_value(d)),
wl{i} as (select {above}, {g}, '/*' wild from wr{i} semi join ww{i} using ({above})),
w{i} as (select * exclude (wild) replace (coalesce(wild, {g}) as {g}) from {last} left join wl{i} using ({above}, {g}))""")
        last = f"w{i}"
    for i, g in enumerate(every):
        above = ", ".join(["host", *every[:i]])
        below = "[" + ", ".join(every[i + 1 :]) + "]::varchar[]"
        steps.append(f"""
mb{i} as (select {above}, {g}, sum(n) m, case when sum(bad) + sum(good) = 0 then '/?' when sum(bad) > sum(good) then '/-' else '/+' end side
  from {last} where {g} is not null group by all),
mc{i} as (select * from (select {above}, {g}, {below} below, sum(n) o from {last} where {g} is not null group by all) join mb{i} using ({above}, {g})),
mp{i} as (select {above}, side, below, sum(o) p from mc{i} group by all),
ma{i} as (select {above}, side, sum(p) total, count(*) - 1 df from mp{i} group by all),
mt{i} as (select {above}, {g}, side from mc{i} join mp{i} using ({above}, side, below) join ma{i} using ({above}, side)
  group by {above}, {g}, side, m, df having round(sum(o * o * total / (p * m)) - m, 6) <= df + 3 * sqrt(2.0 * df)),
mg{i} as (select {above}, side from mt{i} group by all having count(*) > 1),
ml{i} as (select {above}, {g}, side wild from mt{i} semi join mg{i} using ({above}, side)),
m{i} as (select * exclude (wild) replace (coalesce(wild, {g}) as {g}) from {last} left join ml{i} using ({above}, {g}))""")
        last = f"m{i}"
    tree = ", ".join(every)
    own = ", ".join(f"s[{k + 1}] g{k + 1}" for k in range(SQL_DEPTH))
    form = f"regexp_replace(regexp_replace(translate(path, '{_UPPER}', '{_LOWER}'), '/[0-9a-f-]{{16,}}(/|$)', '/{{id}}\\1', 'g'), '[0-9]+', '{{n}}', 'g')"
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') h from a),
c as (select page_id, translate(h, '{_UPPER}', '{_LOWER}') host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') path from b),
d as (select *, case {fits} end rule, string_split({form}, '/')[2:] s from c),
e as (select page_id, host, path, rule, case rule {label} end label, s from d),
leaves as (select host, s, {own}, count(*)::double n, sum(if(label = 'block', 1, 0))::double bad, sum(if(label = 'allow', 1, 0))::double good from e group by host, s),{",".join(steps)},
hosts as (select host, (sum(bad) + {PRIOR_WEIGHT * PRIOR}) / (sum(bad) + sum(good) + {PRIOR_WEIGHT}) rate from {last} group by host),
marked as (select host, s, round((sum(bad) over w + {HOST_WEIGHT} * rate + {PRIOR_WEIGHT * PRIOR}) / (sum(bad + good) over w + {HOST_WEIGHT + PRIOR_WEIGHT}), 9) purity
  from {last} join hosts using (host) window w as (partition by host, {tree})),
gone as (select host, s, 'block' gone from marked where purity > {REJECT})
select page_id, host, path, rule, coalesce(label, gone, 'allow') verdict from e left join gone using (host, s)
"""


OP6_SQL = _sql()
