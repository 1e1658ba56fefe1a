import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from featurespark.llm.license_texts import LICENSE_TEXTS
from featurespark.llm.licenses import BASE_PHRASES, TEMPLATES, Automaton, Scanner, op2_license_scan, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places = WORD.findall(low), []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=5), st.lists(st.integers(1, 4), max_size=25))
def test_matching_statistics(sequences, text):
    auto, v, n = Automaton(sequences), 0, 0
    occurs = {}
    for k, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                occurs.setdefault(tuple(s[i:j]), set()).add((k, j))
    for i, c in enumerate(text):
        while v and c not in auto.next[v]:
            v = auto.link[v]
            n = auto.len[v]
        if c in auto.next[v]:
            v, n = auto.next[v][c], n + 1
        want = max((m for m in range(i + 2) if m == 0 or tuple(text[i + 1 - m : i + 1]) in occurs))
        assert n == want
        if n:
            assert set(auto.ends[v]) == occurs[tuple(text[i + 1 - n : i + 1])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=4), st.text("abcd", max_size=25))
def test_anchors_are_all_matches_that_cannot_grow(templates, text):
    scanner, got = Scanner({}, [("x", " ".join(t)) for t in templates], 2, 4, 0.5), defaultdict(list)
    places, at = [], 0
    for run in re.split("([^" + "".join(set("".join(templates))) + "]+)", text):
        if ids := [scanner.vocab.get(c.encode(), 0) for c in run]:
            if all(ids):
                scanner._stream(ids, at, places, got)
        at += len(run)
    for k, t in enumerate(templates):
        want = set()
        for i in range(len(text)):
            for j in range(len(t)):
                if i and j and text[i - 1] == t[j - 1]:
                    continue
                m = 0
                while i + m < len(text) and j + m < len(t) and text[i + m] == t[j + m]:
                    m += 1
                if m >= 2:
                    want.add((i, j, m))
        assert set(got[k]) == want and len(got[k]) == len(want)


def best_cover(anchors, gap):
    """Most words that a chain can cover, by trying all chains."""
    anchors = sorted(set(anchors))

    def on(i):
        start, inner, n = anchors[i]
        most = n
        for j in range(i + 1, len(anchors)):
            s, q, m = anchors[j]
            cut = max(start + n - s, inner + n - q, 0)
            if s - start - n <= gap and cut < m and q + cut - inner - n <= gap:
                most = max(most, n - cut + on(j))
        return most

    return max(map(on, range(len(anchors))), default=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14), st.integers(1, 5)), min_size=1, max_size=7), st.integers(0, 5))
def test_chains_cover_most(anchors, gap):
    scanner = Scanner({}, [("x", " ".join(map(str, range(40))))], 1, gap, 0.0)
    best = max(share for *_, share in scanner._chains(0, anchors))
    assert round(best * 40) == best_cover(anchors, gap)


def test_a_later_anchor_can_follow_an_earlier_chain():
    scanner = Scanner({}, [("x", " ".join(map(str, range(10))))], 1, 4, 0.5)
    assert scanner._chains(0, [(8, 5, 2), (10, 9, 1), (12, 7, 3)]) == [("x", 8, 15, 0.5)]


def test_whole_licences(spark):
    """Each licence text is known by its label alone, also with a word in twenty changed and inside a very long text."""
    rows = []
    for label, text in LICENSE_TEXTS:
        words = text.split()
        edited = " ".join(w if i % 20 != 19 else "XYZ" for i, w in enumerate(words))
        rows += [(label, "Some words before. " + text), (label, "lorem ipsum " * 100_000 + edited + " dolor" * 50)]
    got = scan_licenses(spark.createDataFrame(rows, "label string, text string")).collect()
    for r in got:
        also = {"bsd-2-clause": {"bsd"}, "bsd-3-clause": {"bsd"}}.get(r.label, set())
        assert r.label in r.labels.split(",") and set(r.labels.split(",")) <= {r.label} | also
    assert len(got) == 2 * len(LICENSE_TEXTS)


def test_gnu_family_and_identifiers(spark):
    """Notices that differ in few words have one label each."""
    notice = (
        "/* Copyright (C) 2004 Someone\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {0} as published by\n"
        " * the Free Software Foundation; either version {1} of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n"
        " * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU {0} for more details. */"
    )
    gpl, lgpl, agpl = "General Public License", "Lesser General Public License", "Affero General Public License"
    want = {
        notice.format(gpl, "2"): "gpl-2-or-later", notice.format(gpl, "3"): "gpl-3-or-later", notice.format(lgpl, "2.1"): "lgpl-2.1-or-later", notice.format(lgpl, "3"): "lgpl-3-or-later",
        notice.format(agpl, "3"): "agpl-3-or-later", notice.format(gpl, "9"): "gpl", notice.format("Lesser  " + gpl, "2.1").replace("program", "library"): "lgpl-2.1-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2-only",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "under the terms of the GNU Lesser General Public License, version 3": "lgpl-3",
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "gpl-2-or-later", "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2-only", "# SPDX-License-Identifier: LGPL-2.1\n": "lgpl-2.1",
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: AGPL-3.0-or-later": "agpl-3-or-later",
        "the GNU project and the general public": "", "SPDX license list": "", "under the terms of the GNU licence of the public": "",
    }
    rows = [(t, v) for t, v in want.items()] + [("filler words " * 5000 + t, v) for t, v in want.items()]
    for r in scan_licenses(spark.createDataFrame(rows, "text string, want string")).collect():
        assert r.labels == r.want, (r.text[-200:], r.labels, r.found)


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if "GNU General Public License, version 3" in texts[r.doc_id]:
            assert "gpl-3" in r.labels.split(",")


def test_chains_and_edges(spark):
    bsd = dict(TEMPLATES)["bsd"].split()
    edited = " ".join(bsd[:9] + ["XX", "ÿ"] + bsd[10:])
    texts = [
        None, "", "!!", "Under the MIT license, under_the-mit LICENSE. CC-BY-NC apache license, version 2",
        "x " * 500 + edited + " y", " ".join(bsd[:6]), "cc by cc by nc by nc", "of the and in the of a copy of this", edited + " " + edited,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as score", "2 as keep")
    got = {r.doc_id: r for r in scan_licenses(df.union(df.limit(2))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert r.keep == 2
    assert got[4].labels == "bsd" and got[4].found == f"bsd:500:{500 + len(edited.split())}" and got[4].score > 0.9
    assert got[5].labels == "" and got[7].labels == "" and got[1].score == 0
    assert got[8].found.count("bsd") == 2
    assert scan_licenses(df.limit(0)).count() == 0
