"""Operators 5, 6 and 7 against SQL and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import assert_same, connect

from orthoquilt.llm import licenses, quality_rules, url_filter
from orthoquilt.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), n < 50 or 100 * len(twice) > 50 * n


def test_rule_statistics(documents, no_documents):
    found = quality_rules.with_statistics(documents).collect()
    assert len(found) == documents.count()
    for r in found:
        assert tuple(r["__rules"])[:5] + (r["__rules"]["base_failed"],) == plain_rules(r["text"]), r["text"]
    assert quality_rules.judged_documents(no_documents).count() == 0
    assert quality_rules.kept_documents(no_documents).count() == 0


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark, word_soup):
    good = lambda: word_soup(120)
    rows = [(i, good() if i % 20 else "too short", "fine") for i in range(200)]
    rows += [(1000 + i, good() if i % 10 == 0 else "too short", "spam") for i in range(100)]
    rows += [(2000, good(), None), (2001, "short", "single"), (2002, good(), "fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r["doc_id"]: r for r in quality_rules.judged_documents(docs).collect()}
    assert not judged[1000]["base_failed"] and not judged[1000]["kept"]
    assert judged[1]["kept"] and judged[2000]["kept"] and not judged[2001]["kept"]
    kept = {r["doc_id"] for r in quality_rules.kept_documents(docs).collect()}
    assert kept == {d for d, r in judged.items() if r["kept"]}


def plain_hosts(rows):
    """Hosts that go, of (host, failures by rule): the rates under a beta prior, whose strength is found by the moments of a beta-binomial."""
    hosts = defaultdict(list)
    for host, failed in rows:
        hosts[host].append(failed)
    gone = set()
    for k in range(len(rows[0][1]) if rows else 0):
        n = np.array([len(x) for x in hosts.values()], float)
        p = np.array([np.mean([f[k] for f in x]) for x in hosts.values()])
        mean = np.average(p, weights=n)
        free = 1 - n / n.sum()
        above = (n * (p - mean) ** 2).sum() - mean * (1 - mean) * free.sum()
        most = mean * (1 - mean) * ((n * free).sum() - free.sum())
        inside = min(1, max(0, above / most)) if most > 1e-9 else 0
        for host, size, own in zip(hosts, n, p):
            if inside == 0:
                rate = mean
            else:  # mean of the beta posterior
                strength = 1 / inside - 1
                alpha, beta = mean * strength + own * size, (1 - mean) * strength + (1 - own) * size
                rate = alpha / (alpha + beta)
            if round(rate, 9) > 0.5:
                gone.add(host)
    return gone


def test_host_rates_equal_the_posterior(spark):
    r = random.Random(8)
    rows = []
    for h in range(60):
        bad = [r.random() ** 3 if k != 2 else 0.2 for k in range(4)] if h < 50 else [0.95 * (k == h % 4) for k in range(4)]
        rows += [(f"h{h}" if h else None, tuple(r.random() < x for x in bad)) for _ in range(r.choice([1, 2, 5, 40]))]
    df = spark.createDataFrame(rows, "host string, failed struct<a: boolean, b: boolean, c: boolean, d: boolean>")
    found = {x["host"] for x in quality_rules.rejected_hosts(df).collect()}
    assert found == plain_hosts(rows) and 3 < len(found) < 40
    single = [(f"h{k}", (k % 3 == 0,)) for k in range(30)]  # one document a host says nothing of hosts
    df = spark.createDataFrame(single, "host string, failed struct<a: boolean>")
    assert quality_rules.rejected_hosts(df).count() == 0 == len(plain_hosts(single))


def test_each_rule_can_reject_a_host(spark, word_soup):
    good = lambda: word_soup(120)
    bad = {
        "symbols": lambda: word_soup(100) + " # $ %" * 8,
        "equal_lines": lambda: "\n".join(f"{a}\n{a}" for a in (word_soup(20) for _ in range(6))),
        "odd_words": lambda: " ".join("x" * 9 + w * 3 for w in word_soup(100).split()),
    }
    rows = [(f"ok{i % 5}", good()) for i in range(100)]
    rows += [(name, make()) for name, make in bad.items() for _ in range(30)] + [(name, good()) for name in bad for _ in range(3)]
    docs = spark.createDataFrame([(i, t, h, "own", 1.5) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, __t string, __rules double")
    judged = {r["doc_id"]: r for r in quality_rules.judged_documents(docs).collect()}
    assert {rows[d][0] for d, r in judged.items() if not r["kept"]} == set(bad)
    assert all(not r["kept"] for d, r in judged.items() if rows[d][0] in bad)
    assert not any(r["base_failed"] for d, r in judged.items() if d >= len(rows) - 9)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in judged.items() if r["kept"]}


def urls():
    r = random.Random(2)
    out = [None, "", "no scheme", "://", "http://", "https://a.NET", "http://Example.net/en/1", "http://x.example.net/EN/1", "http://net/x"]
    out += ["http://a.org/fr/", "http://a.org/fr", "http://org/fr/1?x=/y#z", "ftp://example.com:80/de/1", "http://sub.example.com/de/1#/en/", "x://h?q://z/de/"]
    out += ["http://notexample.com/de/9", "http://examplenet/en/1", "http://ÄB.net/ä", "http://example.com/de/" + "deep/" * 500]
    out += [f"http://shop.test/{r.choice('abcdef')}{r.randrange(10**6)}-{w}/item" for w in "abcdefghijklmnopqrstuvwxyz" * 3]
    out += [f"http://news.test/{x}/{r.randrange(999)}{e}" for x in ("en", "de", "fr") for e in ("", ".html", "/") for _ in range(20)]
    out += [f"http://www.example.com/{x}/{r.randrange(999)}{e}" for x in ("en", "de", "fr") for e in ("", ".html") for _ in range(15)]
    return out + out[:9]


def test_urls(spark):
    import pyarrow as pa

    rows = [(i, u) for i, u in enumerate(urls())]
    found = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"))
    con = connect("/nowhere", pages=pa.table({"page_id": [i for i, _ in rows], "url": [u for _, u in rows]}))
    assert_same(found, con, url_filter.OP6_SQL)
    by_url = {rows[r["page_id"]][1]: r for r in found.collect()}
    get = lambda u: tuple(by_url[u][k] for k in ("host", "path", "rule", "verdict"))
    assert get(None) == get("") == get("no scheme") == ("", "", None, "allow")
    assert get("http://Example.net/en/1") == ("example.net", "/en/1", "example.net/en/", "allow")
    assert get("http://x.example.net/EN/1") == ("x.example.net", "/EN/1", "net/", "block")
    assert get("http://net/x") == ("net", "/x", "net/", "block")
    assert get("http://org/fr/1?x=/y#z") == ("org", "/fr/1", "org/fr/", "allow")
    assert get("http://notexample.com/de/9")[2:] == (None, "allow")
    assert get("ftp://example.com:80/de/1")[2] is None
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_a_template_of_blocked_pages_is_rejected(spark):
    """A rule blocks most of a host's numbered pages; the rest of that template goes, others of the host stay."""
    rules = (url_filter.Rule("bad.test", "/x/1", "block"), url_filter.Rule("bad.test", "/x/2", "block"))
    rows = [(i, f"http://bad.test/x/{k}{i}") for k in (1, 2, 3) for i in range(100, 140)] + [(i, f"http://bad.test/about/p{i}") for i in range(500, 540)]
    found = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert all(r["verdict"] == "block" for r in found if r["path"].startswith("/x/3"))
    assert all(r["verdict"] == "allow" for r in found if r["path"].startswith("/about"))


def plain_wild(items):
    """leaf -> path with wildcards, of (leaf, rest, pages), by recursion."""
    out, branches = {}, defaultdict(list)
    for leaf, rest, n in items:
        if rest:
            branches[rest[0]].append((leaf, rest[1:], n))
        else:
            out[leaf] = ()
    pages = {s: sum(n for *_, n in own) for s, own in branches.items()}
    rare = {s for s, n in pages.items() if n < 5 or 1000 * n < sum(pages.values())}
    if len(rare) <= 10 or 2 * len(rare) < len(branches):
        rare = set()
    merged = defaultdict(list)
    for s, own in branches.items():
        merged["/*" if s in rare else s] += own
    for s, own in merged.items():
        out |= {leaf: (s, *rest) for leaf, rest in plain_wild(own).items()}
    return out


def plain_alike(items):
    """leaf -> template, of (leaf, rest, pages, blocked, allowed), by recursion and the test as textbooks have it."""
    out, branches = {}, defaultdict(list)
    for leaf, rest, *counts in items:
        if rest:
            branches[rest[0]].append((leaf, rest[1:], *counts))
        else:
            out[leaf] = ()
    sides = defaultdict(list)
    for s, own in branches.items():
        bad, good = sum(x[3] for x in own), sum(x[4] for x in own)
        sides["/?" if bad + good == 0 else "/-" if bad > good else "/+"].append(s)
    name = {}
    for side, own in sides.items():
        seen = {s: Counter() for s in own}
        for s in own:
            for _, below, n, *_ in branches[s]:
                seen[s][below] += n
        pool = sum(seen.values(), Counter())
        df, total = len(pool) - 1, sum(pool.values())
        fits = []
        for s in own:
            m = sum(seen[s].values())
            x = sum((seen[s][b] - p * m / total) ** 2 / (p * m / total) for b, p in pool.items())
            if round(x, 6) <= df + 3 * (2 * df) ** 0.5:
                fits.append(s)
        if len(fits) > 1:
            name |= dict.fromkeys(fits, side)
    merged = defaultdict(list)
    for s, own in branches.items():
        merged[name.get(s, s)] += own
    for s, own in merged.items():
        out |= {leaf: (s, *rest) for leaf, rest in plain_alike(own).items()}
    return out


def plain_rejected(pages):
    """(host, leaf) of rejected templates of pages (host, leaf, label)."""
    gone = set()
    for host in {h for h, *_ in pages}:
        leaves = defaultdict(lambda: [0, 0, 0])
        for h, leaf, label in pages:
            if h == host:
                leaves[leaf][0] += 1
                leaves[leaf][1] += label == "block"
                leaves[leaf][2] += label == "allow"
        wild = plain_wild([(leaf, leaf, c[0]) for leaf, c in leaves.items()])
        found = plain_alike([(leaf, wild[leaf], *c) for leaf, c in leaves.items()])
        bad, good = (sum(c[k] for c in leaves.values()) for k in (1, 2))
        rate = (bad + 0.6) / (bad + good + 6)
        for t in set(found.values()):
            own = [leaves[leaf] for leaf in leaves if found[leaf] == t]
            b, known = sum(c[1] for c in own), sum(c[1] + c[2] for c in own)
            if (b + 4 * rate + 0.6) / (known + 10) > 0.5:
                gone |= {(host, leaf) for leaf in leaves if found[leaf] == t}
    return gone


def test_templates_equal_the_plain_tree(spark):
    """Templates that mix labelled and unlabelled pages, slugs, deep common paths, alike branches on each side."""
    r = random.Random(4)
    slug = lambda: "".join(r.choice("bcdfghjkl") for _ in range(7))
    pages = [(h, ("shop", slug(), e), label) for h, label in (("a", "block"), ("a", None), ("b", "allow"), ("b", None)) for e in ("view", "buy") for _ in range(30)]
    pages += [("a", (s, f"p{k}"), r.choice(x)) for s, x in (("x", ["block"]), ("y", ["block", None]), ("z", [None]), ("w", ["allow"])) for k in range(4) for _ in range(12)]
    pages += [("c", ("deep",) * 200 + (str(k % 3), "{n}"), "block" if k % 3 else None) for k in range(90)]
    pages += [("d", (f"s{k % 40}",), r.choice(["block", "allow", None])) for k in range(4000)] + [("d", (), None), ("d", ("s1", "x"), "block"), ("", (), None)]
    pages += [("e", ("hot",), None)] * 500 + [("e", (slug(),), "block" if k < 15 else None) for k in range(30)]
    r.shuffle(pages)
    df = spark.createDataFrame([(h, list(leaf), label) for h, leaf, label in pages], "host string, leaf array<string>, label string")
    found = url_filter.templates(df).collect()
    assert len(found) == len({(h, leaf) for h, leaf, _ in pages})
    want = plain_rejected(pages)
    assert {(x["host"], tuple(x["leaf"])) for x in found if x["purity"] > 0.5} == want
    unlabelled = {(h, leaf) for h, leaf, _ in pages} - {(h, leaf) for h, leaf, label in pages if label}
    assert want & unlabelled and unlabelled - want  # labels reach unlabelled pages of their templates, and no others


def test_licences(spark):
    files = spark.createDataFrame(
        [
            ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
            ("a/b/c/deep.py", "nothing"),
            ("a/b/own.py", "some code\n# Released under the MIT License.\nmore and more code words here to be long " * 3),
            ("a/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            ("a/d/e/f.txt", None),
            ("z/top.txt", ""),
            ("plain", "no directory"),
            (None, "Licensed under CC BY-NC 4.0."),
            (None, "no path"),
            ("z/long", "license " * 50_000),
            ("z/near", "LICENSED UNDER the apache license version 2.0"),
        ],
        "path string, text string",
    ).selectExpr("*", "'x' as licence_name", "1 as n")
    rows = [r.asDict() for r in licenses.inherited(licenses.with_own(files)).collect()]
    by = {r["path"]: (r["licence"], r["origin"], r["origin_dir"]) for r in rows if r["path"]}
    assert len(rows) == 11
    assert by["a/LICENSE"] == ("Apache-2.0", "own", "a")
    assert by["a/b/c/deep.py"] == ("Apache-2.0", "inherited", "a")
    assert by["a/b/own.py"][:2] == ("MIT", "own")
    assert by["a/d/e/f.txt"] == ("GPL-3.0", "inherited", "a/d")
    assert by["plain"] == (None, "none", None)
    assert by["z/near"][0] == "Apache-2.0"
    assert {(r["licence"], r["origin"]) for r in rows if r["path"] is None} == {("CC-BY-NC-4.0", "own"), (None, "none")}
    assert licenses.inherited(licenses.with_own(files.where("false"))).count() == 0


def test_full_texts_headers_and_tags(spark):
    """A whole licence text declares its directory; a header over several comment lines, one within a line and an SPDX tag are found."""
    texts = dict(licenses.FULL)
    code = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(300))
    apache = dict(licenses.HEADERS)["Apache-2.0"].split(" ")
    header = "\n".join("# " + " ".join(apache[i : i + 9]) for i in range(0, len(apache), 9))
    rows = [(f"{name}/LICENSE", "Copyright (c) 2020 Some One\n\n" + text) for name, text in texts.items()]
    rows += [(f"{name}/src/deep/a.py", "nothing of note") for name in texts]
    rows += [
        ("x/header.py", header + "\n" + code),
        ("x/inline.py", "first words of another kind here. Released under the MIT License. other things follow after that sentence"),
        ("x/tag.c", "/* SPDX-License-Identifier: GPL-2.0-only */\n" + code),
        ("x/two.c", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + code),
        ("x/none.py", code),
        ("x/gpl2.py", "This work is licensed under the GNU General Public License, version 2.\n" + code),
        ("x/gpl3.py", "# This work is licensed under the GNU General Public License, version 3\n" + code),
        ("x/lgpl.c", "This library is licensed under the GNU Lesser General Public License, version 2.1.\n" + code),
        ("x/denied.py", "This work is not licensed under the GNU General Public License, version 3.\n" + code),
        ("x/late.py", code + "\n" + header + "\n" + code),
    ]
    found = {r["path"]: r for r in licenses.inherited(licenses.with_own(spark.createDataFrame(rows, "path string, text string"))).collect()}
    for name in texts:
        assert found[f"{name}/LICENSE"]["licence"] == name
        assert tuple(found[f"{name}/src/deep/a.py"][k] for k in ("licence", "origin", "origin_dir")) == (name, "inherited", name)
    own = {p: r["licence"] for p, r in found.items() if p.startswith("x/")}
    assert own == {"x/header.py": "Apache-2.0", "x/inline.py": "MIT", "x/tag.c": "GPL-2.0", "x/two.c": "(MIT OR Apache-2.0)", "x/none.py": None} | {
        "x/gpl2.py": "GPL-2.0", "x/gpl3.py": "GPL-3.0", "x/lgpl.c": "LGPL-2.1", "x/denied.py": None, "x/late.py": "Apache-2.0"}
