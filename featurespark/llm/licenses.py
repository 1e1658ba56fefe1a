"""Licence scan with a generalised suffix automaton of licence words (operator 2).

All templates, word by word, form one suffix automaton. A text is streamed through it once, which gives the matching
statistics: for each word the longest suffix read so far that occurs in some template. Its suffix links name the shorter
suffixes that occur in further templates, so each match of ``least_match`` words or more that can't grow in its template
on either side is an anchor. Per template, anchors in the same order in both texts and at most ``gap`` words apart are
chained so that most words are covered; a chain that covers ``cover`` of its template is a finding with the template's
label, unless it lies inside a finding that covers its own template better or whose label goes on from its own (``gpl``
inside ``gpl-2-or-later``). Words of a template in brackets must stand unbroken in the text: they tell licences apart that
differ in few words. Base phrases are templates too: the automaton marks the states that hold a whole phrase, so every place of a
phrase is seen in the same pass.

The automaton depends on the templates alone and is sent to each task; documents are neither shuffled nor gathered.

Defined results: null, empty and wordless text has no words, places or labels (empty strings, score 0, null positions);
rows are scanned one by one, so repeated rows repeat; texts of any length are streamed as a whole; other columns pass
through unless they bear a name of the result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, alnum_words, names
from .license_texts import GNU_NOTICES, LICENSE_TEXTS, SPDX_LINES

BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Words by which licences are known.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    *LICENSE_TEXTS,
    *GNU_NOTICES,
    *SPDX_LINES,
]
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "found string"
)


class Automaton:
    """Generalised suffix automaton of word sequences; keeps, by state, where its longest string ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for n, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c, ends)
                ends[last].append((n, i + 1))
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):  # a suffix ends where the longer one does
            ends[self.link[v]] += ends[v]
        self.ends = [sorted(set(x)) for x in ends]

    def _new(self, length: int, link: int, following: dict[int, int], ends: list) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.len.append(length)
        ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int, ends: list) -> int:
        """The state for the part of q that follows p."""
        clone = self._new(self.len[p] + 1, self.link[q], self.next[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:  # another sequence has been here
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q, ends)
        new, p = self._new(self.len[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q, ends)
        return new


class Scanner:
    def __init__(
        self, phrases: dict[str, str], templates: list[tuple[str, str]], least_match: int, gap: int, cover: float
    ):
        self.least, self.gap, self.cover = least_match, gap, cover
        texts = [alnum_words(x.encode()) for x in [*phrases, *[t for _, t in templates]]]
        self.labels = [*phrases.values(), *[x for x, _ in templates]]
        self.sizes, self.n_phrases = [len(x) for x in texts], len(phrases)
        self.musts = [_brackets(x) for x in [*phrases, *[t for _, t in templates]]]
        self.vocab: dict[bytes, int] = {}
        self.words = [[*(self.vocab.setdefault(w, len(self.vocab) + 1) for w in x), -1] for x in texts]  # -1: the end
        self.auto = Automaton([x[:-1] for x in self.words])
        self.phrases: list[set[tuple[int, int]]] = [set() for _ in self.auto.len]  # by state: phrases that may end here
        for v in sorted(range(1, len(self.auto.len)), key=lambda v: self.auto.len[v]):
            up, whole = self.auto.link[v], [x for x in self.auto.ends[v] if x[0] < self.n_phrases and x[1] == self.sizes[x[0]]]
            own = {(n, size) for n, size in whole if self.auto.len[up] < size <= self.auto.len[v]}
            self.phrases[v] = own | self.phrases[up]
        self.matches = self._matches()
        self.shortest = min([least_match, *self.sizes[: self.n_phrases]])

    def _matches(self) -> list[list[tuple[int, int, int]]]:
        """By state (template, end, longest): where the state or one it links to ends, with the longest match there."""
        link, length, ends = self.auto.link, self.auto.len, self.auto.ends
        out: list[list[tuple[int, int, int]]] = [[] for _ in length]
        for v in sorted(range(1, len(length)), key=lambda v: length[v]):
            if length[v] >= self.least:
                own = {x for x in ends[v] if x[0] >= self.n_phrases}
                out[v] = [(t, to, length[v]) for t, to in sorted(own)]
                out[v] += [x for x in out[link[v]] if x[:2] not in own]
        return out

    def scan(self, words: list[bytes]) -> tuple:
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).view(np.int8)))
        places: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), a, places, anchors)
        found = _outer([x for n, own in anchors.items() for x in self._chains(n, own)])
        base = {self.labels[n] for n, _ in places}
        starts = [s for _, s in places]
        labels = sorted(base | {label for label, *_ in found})
        score = 1.0 if base else max([x for *_, x in found], default=0.0)
        spans = ",".join(f"{label}:{s}:{e}" for label, s, e, _ in sorted(found, key=lambda x: (x[1], x[2], x[0])))
        ends = (min(starts), max(starts)) if starts else (None, None)
        return (len(words), len(places), *ends, ",".join(sorted(base)), ",".join(labels), score, spans)

    def _stream(self, ids: list[int], at: int, places: list, anchors: dict) -> None:
        """Matching statistics of a run of known words, and the matches that end where the next word differs."""
        following, link, length = self.auto.next, self.auto.link, self.auto.len
        v = n = 0
        for i, c in enumerate(ids, 1):
            while v and c not in following[v]:
                v = link[v]
                n = length[v]
            if c in following[v]:
                v, n = following[v][c], n + 1
            for phrase, size in self.phrases[v]:
                if n >= size:
                    places.append((phrase, at + i - size))
            if n >= self.least:
                after = ids[i] if i < len(ids) else 0
                for template, to, longest in self.matches[v]:
                    if self.words[template][to] != after:
                        m = min(n, longest)
                        anchors[template].append((at + i - m, to - m, m))

    def _chains(self, template: int, anchors: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of a template that cover enough of it: (label, start, end, cover).

        Each anchor (start, start in template, words) goes on from the chain that with it covers most; words that overlap
        in either text count once. Only chains that ended at most ``gap`` words before are looked at.
        """
        live: list[tuple[int, int, int, int]] = []  # start, end, end in template, words covered
        found: dict[tuple[int, int], float] = {}
        for start, inner, n in sorted(set(anchors)):
            live = [x for x in live if start - x[1] <= self.gap]
            first, most = start, 0
            for begin, end, to, covered in live:
                cut = max(end - start, to - inner, 0)
                if cut < n and inner + cut - to <= self.gap and covered - cut > most:
                    first, most = begin, covered - cut
            live.append((first, start + n, inner + n, n + most))
            share = (n + most) / self.sizes[template]
            if share >= self.cover:
                found[first, start + n] = max(share, found.get((first, start + n), 0.0))
        out: list[tuple[str, int, int, float]] = []
        for (start, end), share in sorted(found.items(), key=lambda x: (-x[1], x[0])):  # the best of those that overlap
            inside = [(i, i + n) for s, i, n in anchors if start <= s and s + n <= end] if self.musts[template] else []
            if any(all(a > low or b < high for a, b in inside) for low, high in self.musts[template]):
                continue
            if all(end <= s or start >= e for _, s, e, _ in out):
                out.append((self.labels[template], start, end, share))
        return out


def _brackets(template: str) -> list[tuple[int, int]]:
    """Ranges of words in brackets."""
    out, at = [], 0
    for i, part in enumerate(template.replace("]", "[").split("[")):
        n = len(alnum_words(part.encode()))
        out += [(at, at + n)] * (i % 2)
        at += n
    return out


def _outer(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Findings but those inside another of a greater share; those of one template are apart, so few are open at once."""
    out, live = [], []
    for x in sorted(found, key=lambda x: (x[1], -x[2], -x[3])):
        live = [o for o in live if o[2] > x[1]]
        if not any(o[2] >= x[2] and (o[3] > x[3] or o[0].startswith(f"{x[0]}-")) for o in live):
            out.append(x)
        live.append(x)
    return out


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = BASE_PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    least_match: int = 3,
    gap: int = 12,
    cover: float = 0.7,
) -> DataFrame:
    """docs with the columns of RESULT; found lists label:start:end of covered template spans, in words."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, least_match, gap, cover))

    def fn(texts: list[bytes | None]) -> list[tuple]:
        return [scanner.value.scan(alnum_words(t)) for t in texts]

    return add_columns(docs, [docs["text"].cast("binary")], fn, RESULT)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *names(RESULT))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
