import random
import re

from kinscribe.llm.license_rules import rules
from kinscribe.llm.license_scan import BASE, license_scan
from kinscribe.llm.url_filters import url_filter


def test_urls(spark):
    rows = [
        (1, "https://a.example.com/en/5", None), (2, "https://A.EXAMPLE.com/en/71?x", None), (3, "http://x.net/de/", ""), (4, "http://b.example.net/de/81", "x"),
        (5, None, None), (6, "nothing", None), (7, "http://notcom/en/", None), (8, "http://com/en/", None), (9, "://example.org", None), (10, "http://h.org/es/1#y://z", None),
        # aliases of a blocked one; 21 by 20, 22 by redirect; 30 has an allowed alias
        (20, "http://one.fr/a", '<link rel="canonical" href="http://s.example.com/en/1">'), (21, "http://two.fr/b", "<LINK href='http://one.fr/a' REL='canonical'/>"), (22, "https://three.fr/c", '<meta http-equiv="refresh" content="0; url=http://two.fr/b">'),
        (30, "http://four.fr/d", '<link rel="canonical" href="http://s.example.com/en/2"><link rel=canonical href="http://k.net/de/1">'), (31, "http://five.fr/e", '<link rel="canonical" href="/f">'), (32, "http://one.fr/a#frag", None), (32, "http://one.fr/a#frag", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as node")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter(df).collect()}
    assert got[1] == ("a.example.com", "/en/5", "com/en/", "block") and got[2] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("notcom", "/en/", None, "allow") and got[8][2] == "com/en/"
    assert got[9] == ("example.org", "", None, "allow") and got[10][2:] == ("org/es/", "block")
    assert {k: got[k][3] for k in (20, 21, 22, 30, 31, 32)} == {20: "block", 21: "block", 22: "block", 30: "allow", 31: "allow", 32: "block"}
    assert url_filter(df).count() == len(rows) and url_filter(df.limit(0)).count() == 0


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    base = ",".join(sorted(labels))
    norm, found = "  " + "".join(w + "  " for w in words), []
    for i, label, priority, keyword, pattern in rules():
        if keyword in norm:
            found += [(m.start(), m.end(), priority, i, label) for m in re.finditer(pattern, norm)]
    left = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3])) for e in found)]
    labels |= {d[4] for d in left}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels))


def test_licenses_against_brute_force(spark):
    r = random.Random(7)
    parts = ["under the MIT license", "Apache License, Version 2", "CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.", "Released under the BSD license", "the", "mit", "license", "Über", "x2", "cc by nc cc by nc", "all rights reserved", "SPDX-License-Identifier: MIT", "under the terms of the", "public domain", "\x00", "\n"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(0, 25)))) for i in range(60)] + [(100, None), (101, ""), (102, "under the mit license"), (103, "nothing to see"), (104, "word " * 20000 + "cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as norm", "2 as score")
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) for x in license_scan(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert len(rules()) > 200 and license_scan(df.limit(0)).count() == 0
