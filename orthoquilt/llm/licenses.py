"""Licence scan (operator 5), in DataFrame functions only.

A line of a file (a header) and a file as a whole (a licence file) are compared with licence notices by the cosine of
sparse TF-IDF vectors: a term weighs its inverse document frequency among the notices, a term that no notice has weighs most.
A line can reach the least cosine `LIKE` only if at least LIKE squared of its distinct terms are notices' terms (no term
weighs more than an unknown one), so all others are left out at once, exactly.

Full licence texts (`licence_texts`) and headers of several lines (`HEADERS`) are templates of their own, with their own weights. The
whole file, and sliding runs of its lines and of its sentences, are compared with them in the same way. A file holds a run that reaches
`LIKE` only if its terms hold `LIKE` squared of the weight of a template, so all other files are left out at once, exactly.
Runs have the lengths of `RUNS`, the same from each line or sentence on. A run that reaches `LIKE` holds a telling term of a template (those without which
its other terms weigh too little), so runs without one are not looked at; lines and sentences that deny a licence are no part of runs.
Vectors are sparse and binary in the term counts: licences differ in which terms they have, not in how often they say "the".

A file's own licence is that of the full text that it matches as a whole; else its SPDX tag (an expression is kept as it stands); else that of
its best line or run. A file that matches a full text, or of which matching lines hold at least half of the terms, is a licence
file: it stands for its directory, and files without a licence of their own inherit from the nearest directory
above them that has one. Directories are joined with their ancestors by path, so documents move once, against a table of directories.

Null texts have no licence of their own; very long texts are taken whole; ties go to the licence that comes first in
`NOTICES`; repeated rows are judged one by one; files with a null path inherit nothing; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.llm.common import bounded_or_shuffled, let, stored, table

LIKE = 0.75
#: Share of a file's terms in matching lines from which it is a licence file.
WHOLE = 0.5
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
)
#: Full texts, by the names of their files.
FULL = tuple((p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")))
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by "
    "the Free Software Foundation, {1}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have "
    "received a copy of the GNU {0} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
#: Headers that licences prescribe for source files.
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format("", "either version 2 of the License, or (at your option) any later version")),
    ("GPL-3.0", _GNU.format("", "either version 3 of the License, or (at your option) any later version")),
    ("LGPL-2.1", _GNU.format("Lesser", "either version 2.1 of the License, or (at your option) any later version")),
    ("LGPL-3.0", _GNU.format("Lesser", "either version 3 of the License, or (at your option) any later version")),
    ("AGPL-3.0", _GNU.format("Affero", "either version 3 of the License, or (at your option) any later version")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)
#: How many lines or sentences a run has.
RUNS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
_SPDX = r"SPDX-License-Identifier:[ \t]*([(A-Za-z0-9][A-Za-z0-9.+() -]*[A-Za-z0-9.+)])"
#: A line or sentence with this in its terms says that something does not fall under a licence.
_DENIED = r"\b(not|never|no longer)( be| been)? (licensed|released|governed|distributed|covered|available|subject)\b"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = "[a-z0-9]+"


def weights(notices=NOTICES) -> tuple[dict[str, float], float, list[tuple[str, list[str], float]]]:
    """Squared weight of each term, that of an unknown one, and (licence, terms, squared length) of the notices."""
    terms = [(name, sorted(set(re.findall(_TERM, text.lower())))) for name, text in notices]
    square = lambda df: (math.log((1 + len(notices)) / (1 + df)) + 1) ** 2
    known = {t: square(sum(t in own for _, own in terms)) for t in sorted({t for _, own in terms for t in own})}
    return known, square(0), [(name, own, sum(known[t] for t in own)) for name, own in terms]


def telling(rows: list[tuple[str, list[str], float]], known: dict[str, float], like: float) -> list[str]:
    """The fewest heaviest terms of each template without which `like` cannot be reached: the others weigh under `like` squared of it."""
    found: set[str] = set()
    for _, own, size in rows:
        rest = size
        for t in sorted(own, key=lambda t: (-known[t] * len(t), t)):  # long words are rare in other texts
            if rest < like * like * size * (1 - 1e-9):
                break
            found.add(t)
            rest -= known[t]
    return sorted(found)


def among(value: Column, terms: list[str]) -> Column:
    """Whether value is one of the terms; `isin`, with one call to the JVM instead of one for each of thousands of terms."""
    jvm = SparkContext._active_spark_context._jvm
    words = jvm.java.util.Collections.list(jvm.java.util.StringTokenizer(" ".join(terms)))
    return type(value)(value._jc.isInCollection(words))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def denied(terms: Column) -> Column:
    return F.exists(terms, lambda t: t.isin("not", "never", "longer")) & F.array_join(terms, " ").rlike(_DENIED)


def with_templates(df: DataFrame, text: str, lines: str, like: float = LIKE) -> DataFrame:
    """df with __full and __run: (cosine, k, licence) of the best full text for the whole file, and of the best template for a run; null below `like`."""
    columns = df.columns
    known, unknown, rows = weights(FULL + NOTICES + HEADERS)
    classes = [(w, [t for t in known if known[t] == w]) for w in sorted(set(known.values()))]
    held = lambda terms: F.array_distinct(F.filter(terms, lambda t: among(t, list(known))))

    def weighed(hits: Column) -> Column:
        def one(t: Column) -> Column:
            s = F.lit(unknown)
            for w, terms in classes:
                s = F.when(among(t, terms), w).otherwise(s)
            return F.struct(t.alias("t"), s.alias("s"))

        return F.transform(hits, one)

    total = lambda hits: F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["s"])
    dot = lambda hits, own: total(F.filter(hits, lambda x: among(x["t"], own)))

    def best(x: Column, first: int, last: int) -> Column:
        """x: (h, n), the weighed known terms and the number of all distinct terms."""
        length = total(x["h"]) + F.lit(unknown) * (x["n"] - F.size(x["h"]))
        every = [
            F.struct(F.round(dot(x["h"], own) / F.sqrt(length * F.lit(size)), 6).alias("cosine"), F.lit(-k).alias("k"), F.lit(name).alias("licence"))
            for k, (name, own, size) in list(enumerate(rows))[first:last]
        ]
        return F.array_max(F.array(*every))

    bound = like * like
    heaviest = max(known.values())
    full, small = rows[: len(FULL)], rows[len(FULL) :]
    telling_small, telling_full = telling(small, known, like), telling(full, known, like)
    reach = lambda hits: [
        F.when(F.size(hits) * heaviest < bound * size, False).otherwise(dot(hits, own) >= bound * size) for _, own, size in rows
    ]
    some = lambda tests: F.exists(F.array(*tests), lambda x: x)
    summary = lambda d: F.struct(weighed(held(d)).alias("h"), F.size(d).alias("n"))
    out = let(df, "__h", held(F.flatten(lines)))
    # most files hold neither a telling term of a short template nor enough terms of a full text
    hopeful = F.exists("__h", lambda t: among(t, telling_small)) | (F.size("__h") * heaviest >= bound * min(size for *_, size in full))
    out = let(out, "__w", F.when(hopeful, weighed(F.col("__h"))))
    tests = reach(F.col("__w"))
    out = let(out, "__v", F.when(F.col("__w").isNull(), False).otherwise(some(tests[: len(FULL)])))
    out = let(out, "__g", F.when(F.col("__w").isNull(), False).otherwise(F.col("__v") | some(tests[len(FULL) :])))
    whole = F.struct(F.col("__w").alias("h"), F.size(F.array_distinct(F.flatten(lines))).alias("n"))
    out = let(out, "__f", F.when(F.col("__g"), F.transform(F.array(whole), lambda x: best(x, 0, len(FULL)))[0]))

    def runs(units: Column) -> Column:
        """The best of all runs. Lengths are a lambda's variable and what is used twice is bound by one, so the long lists of terms stand here once."""
        telling_at = F.filter(
            F.transform(units, lambda u, i: F.when(F.exists(u, lambda t: among(t, telling_small) | (F.col("__v") & among(t, telling_full))), i + 1)), F.isnotnull
        )
        last = lambda k: F.greatest(F.lit(1), F.size(units) - k + 1)
        # a run without a telling term reaches nothing, so runs begin where one is at hand
        begins = lambda at, k: F.array_distinct(
            F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(1), F.least(p - k + 1, last(k))), F.least(p, last(k)))))
        )
        of = lambda at, k: F.filter(
            F.transform(F.transform(begins(at, k), lambda s: F.array_distinct(F.flatten(F.slice(units, s, k)))), summary),
            lambda x: (x["n"] > 0) & (F.size(x["h"]) >= bound * x["n"]),
        )
        found = F.transform(F.array(telling_at), lambda at: F.flatten(F.transform(F.array(*map(F.lit, RUNS)), lambda k: of(at, k))))[0]
        return F.array_max(F.transform(found, lambda x: best(x, 0, len(rows))))

    sentences = F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?;:]) "), _terms)
    full_of = lambda units: F.filter(units, lambda x: (F.size(x) > 0) & ~denied(x))
    out = let(out, "__u", F.when(F.col("__g"), F.array(full_of(F.col(lines)), full_of(sentences))))
    out = let(out, "__r", F.when(F.col("__g"), F.array_max(F.transform("__u", runs))))
    enough = lambda c: F.when(F.col(c)["cosine"] >= like, F.col(c))
    return out.select(*columns, enough("__f").alias("__full"), enough("__r").alias("__run"))


def with_own(df: DataFrame, text: str = "text", like: float = LIKE, notices=NOTICES) -> DataFrame:
    """df with own_licence, own_cosine (null: none) and licence_file."""
    columns = df.columns
    known, unknown, rows = weights(notices)
    vocabulary = list(known)
    out = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    out = let(out, "__l", F.transform(F.split("__t", "\n"), _terms))
    out = let(out, "__n", F.aggregate("__l", F.lit(0), lambda a, x: a + F.size(x)))
    hit = lambda own: F.size(F.filter(own, lambda t: among(t, vocabulary)))
    near = F.filter("__l", lambda x: (F.size(x) > 0) & (hit(F.array_distinct(x)) >= F.lit(like * like) * F.size(F.array_distinct(x))) & ~denied(x))
    out = let(out, "__c", F.transform(near, lambda x: F.struct(F.array_distinct(x).alias("d"), F.size(x).alias("n"))))
    table_of = F.create_map(*(x for t, w in known.items() for x in (F.lit(t), F.lit(w))))
    weigh = lambda own: F.aggregate(own, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(table_of, t), F.lit(unknown)))

    def best(x: Column) -> Column:
        every = [
            F.struct(
                F.round(weigh(F.array_intersect(x["d"], F.array(*map(F.lit, own)))) / F.sqrt(weigh(x["d"]) * F.lit(length)), 6).alias("cosine"),
                F.lit(-k).alias("k"), F.lit(name).alias("licence"), x["n"].alias("n"),
            )
            for k, (name, own, length) in enumerate(rows)
        ]
        return F.array_max(F.array(*every))

    out = let(out, "__b", F.filter(F.transform("__c", best), lambda x: x["cosine"] >= like))
    out = with_templates(out, "__t", "__l", like)
    line = F.array_max("__b")
    tag = F.nullif(F.regexp_replace(F.trim(F.regexp_extract("__t", _SPDX, 1)), "-(only|or-later)\\b", ""), F.lit(""))
    as_top = lambda c: F.struct(c["cosine"].alias("cosine"), c["licence"].alias("licence"))
    run = F.col("__run")
    top = (
        F.when(F.col("__full").isNotNull(), as_top(F.col("__full"))).when(tag.isNotNull(), F.struct(F.lit(1.0).alias("cosine"), tag.alias("licence")))
        .when(run.isNotNull() & (line.isNull() | (run["cosine"] > line["cosine"])), as_top(run)).when(line.isNotNull(), as_top(line))
    )
    covered = F.aggregate("__b", F.lit(0), lambda a, x: a + x["n"])
    return out.select(
        *columns, top["licence"].alias("own_licence"), top["cosine"].alias("own_cosine"),
        (F.col("__full").isNotNull() | ((F.size("__b") > 0) & (covered >= F.lit(WHOLE) * F.col("__n")))).alias("licence_file"),
    )


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """licence, cosine, origin and origin_dir of files (path, own_licence, own_cosine, licence_file), other columns kept."""
    columns = [c for c in files.columns if c not in ("own_licence", "own_cosine", "licence_file")]
    files = stored(files.withColumn("__dir", directory(F.col("path"))), "files")
    declared = (
        files.where("licence_file and __dir is not null").groupBy("__dir")
        .agg(F.max(F.struct(F.col("own_cosine").alias("c"), F.col("own_licence").alias("l"))).alias("d"))
        .select(F.col("__dir").alias("above"), "d.c", "d.l")
    )
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ladders = files.where("__dir is not null").select("__dir").distinct().select("__dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = (
        ladders.join(bounded_or_shuffled(declared), "above").groupBy("__dir")
        .agg(F.max(F.struct(F.length("above").alias("n"), F.col("above"), F.col("l"), F.col("c"))).alias("d"))
        .select("__dir", F.col("d.above").alias("up"), "d.l", "d.c")
    )
    own = F.col("own_licence").isNotNull()
    return files.join(bounded_or_shuffled(nearest), "__dir", "left").select(
        *columns,
        F.coalesce("own_licence", "l").alias("licence"),
        F.when(own, F.col("own_cosine")).otherwise(F.col("c")).alias("cosine"),
        F.when(own, "own").when(F.col("l").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("__dir")).otherwise(F.col("up")).alias("origin_dir"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every whole text of `documents`, as files source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id")).alias("path"), "text"
    )
    return inherited(with_own(docs).drop("text"))


def _sql() -> str:
    known, unknown, rows = weights()
    words = ", ".join(f"'{t}'" for t in known)
    cells = ", ".join(f"('{t}', {w!r}::double)" for t, w in known.items())
    notices = ", ".join(f"({k}, '{n}', '{t}', {length!r}::double)" for k, (n, own, length) in enumerate(rows) for t in own)
    return f"""
with files as (select row_number() over () r, doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), doc_id) path, coalesce(text, '') t from documents),
lines as (select r, unnest(string_split(t, chr(10))) line from files),
terms as (select row_number() over () i, r, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '{_TERM}') w from lines),
total as (select r, sum(len(w)) n from terms group by r),
near as (select i, r, len(w) n, list_distinct(w) d from terms where len(w) > 0 and len(list_intersect(w, [{words}])) >= {LIKE * LIKE!r} * len(list_distinct(w))
  and not regexp_matches(array_to_string(w, ' '), '{_DENIED}')),
known(t, s) as (values {cells}),
notice(k, licence, t, length) as (values {notices}),
spread as (select i, r, n, unnest(d) t from near),
weighed as (select i, r, n, t, coalesce(s, {unknown!r}) s from spread left join known using (t)),
size as (select i, sum(s) s from weighed group by i),
dots as (select i, any_value(r) r, any_value(n) n, k, licence, sum(s) dot, any_value(length) length from weighed join notice using (t) group by i, k, licence),
scores as (select i, r, n, k, licence, round(dot / sqrt(s * length), 6) c from dots join size using (i)),
best as (select i, any_value(r) r, any_value(n) n, max(row(c, -k, licence)) b from scores group by i),
own as (select r, sum(best.n) covered, max(b) b from best where (b)[1] >= {LIKE} group by r),
judged as (select files.r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') dir, (b)[3] licence, (b)[1] c, coalesce(covered >= {WHOLE} * n, false) licence_file
  from files left join own on files.r = own.r left join total on files.r = total.r),
declared as (select dir above, max(row(c, licence)) d from judged where licence_file group by dir),
ladders as (select dir, unnest(list_distinct([array_to_string(string_split(dir, '/')[1:k], '/') for k in range(0, len(string_split(dir, '/')) + 1)])) above from (select distinct dir from judged)),
nearest as (select dir, max(row(length(above), above, (d)[2], (d)[1])) u from ladders join declared using (above) group by dir)
select doc_id, path, coalesce(licence, (u)[3]) licence, case when licence is not null then c else (u)[4] end cosine,
  case when licence is not null then 'own' when u is not null then 'inherited' else 'none' end origin,
  case when licence is not null then dir else (u)[2] end origin_dir
from judged left join nearest using (dir)
"""


OP5_SQL = _sql()
