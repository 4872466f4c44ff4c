"""Licence scans with a generalised suffix automaton of licence tokens.

All templates and base phrases are one generalised suffix automaton over words. A text's words are streamed
through it, which gives the matching statistics: at each word the longest run ending there that stands in
some template. Runs of at least ``MIN_MATCH`` words that cannot be extended are chained, template by
template, where both sides advance by at most ``GAP`` words, into covered spans. A base phrase stands at a
word exactly when the phrase is a suffix of the run there, which the automaton's links tell.

Runs of two words or more lie within stretches whose neighbouring word pairs all occur in some template, so
only those stretches are streamed; the rest of a text is dismissed as arrays.

Words are runs of digits, a-z (A-Z lowered) and characters beyond ASCII.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowconf import bound_batches
from .decontaminate import Lookup

MIN_MATCH, GAP = 3, 6
#: A span counts when it covers this share of its template, or this many words of it.
SHARE, WORDS = 0.75, 25

# Phrases and labels that the scan's contract names.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices as the licences' own texts recommend them.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "licensed under the bsd license",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
        "published under cc by 4 0",
    ],
    "cc-by-sa": ["published under cc by sa 4 0", "licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["copyright all rights reserved"],
}

SCHEMA = (
    "doc_id long, n_words long, phrases array<struct<label:string,start:long,end:long>>, "
    "spans array<struct<label:string,start:long,end:long,covered:long,share:double>>"
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list] = [[]]  # (sequence, words so far) that end in a state's runs
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, w)
                self.ends[last].append((k, i + 1))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        """The state of p's run followed by w, where q stands for longer runs as well."""
        c = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: str) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return cur


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.words = [_WORD.findall(p) for p in phrases]
        self.labels = list(phrases.values())
        self.base = len(self.words)
        for label, texts in templates.items():
            for t in texts:
                self.words.append(_WORD.findall(t))
                self.labels.append(label)
        self.auto = a = Automaton(self.words)
        # the phrases that are suffixes of a state's longest run
        self.suffix: list[list] = [[] for _ in a.len]
        for k in range(self.base):
            s = 0
            for w in self.words[k]:
                s = a.next[s][w]
            for t in range(1, len(a.len)):
                up = t
                while up > 0 and up != s:
                    up = a.link[up]
                if up == s and a.len[t] >= len(self.words[k]):
                    self.suffix[t].append((k, len(self.words[k])))
        pairs = {(x, y) for ws in self.words for x, y in zip(ws, ws[1:])}
        self.find = Lookup(np.array([tb.chain(np.array([tb.hash_word(x), tb.hash_word(y)], np.uint64), 2)[0] for x, y in pairs], np.uint64))

    def stretch(self, words: list[str], at: int, phrases: list, matches: list) -> None:
        """Streams words that begin at word ``at``; adds (phrase, start) and (template, start, end, template start)."""
        nxt, link, length = self.auto.next, self.auto.link, self.auto.len
        s = l = 0
        for i, w in enumerate([*words, None]):
            t = nxt[s].get(w)
            if t is None and l >= MIN_MATCH:  # the run cannot be extended to the right
                e = at + i
                for k, end in self.auto.ends[s]:
                    if end >= l:
                        matches.append((k, e - l, e, end - l))
            while t is None and s:
                s = link[s]
                l = length[s]
                t = nxt[s].get(w)
            if t is None:
                continue
            s, l = t, l + 1
            for k, n in self.suffix[s]:
                if n <= l:
                    phrases.append((self.labels[k], at + i + 1 - n, at + i + 1))

    def chained(self, matches: list) -> list:
        """(label, start, end, covered, share) of the spans that count."""
        out, live = [], {}

        def close(k, c):
            share = c[2] / len(self.words[k])
            if share >= SHARE or c[2] >= WORDS:
                out.append((self.labels[k], c[0], c[1], c[2], min(1.0, share)))

        for k, start, end, tpl in sorted(matches, key=lambda m: (m[0], m[1], m[2])):
            mine = live.setdefault(k, [])
            for c in [c for c in mine if c[1] + GAP < start]:
                mine.remove(c)
                close(k, c)
            n = end - start
            best = None
            for c in mine:  # [start, end, covered, template end]
                skip = max(0, c[1] - start, c[3] - tpl)
                if skip < n and tpl + n > c[3] and -GAP <= c[3] - tpl <= n and c[1] > c[0] and (best is None or c[2] - skip > best[0][2] - best[1]):
                    best = (c, skip)
            if best:
                c, skip = best
                c[1], c[2], c[3] = end, c[2] + n - skip, tpl + n
            else:
                mine.append([start, end, n, tpl + n])
        for k, mine in live.items():
            for c in mine:
                close(k, c)
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))

    def __call__(self, block: tb.Block):
        """(phrases, spans) of each text of a block, words counted from 0."""
        h = block.hashes()
        hit = self.find(tb.chain(h, 2))
        of = np.searchsorted(block.first, hit, "right") - 1
        inside = hit + 1 < block.first[of + 1] if len(hit) else np.empty(0, bool)
        hit, of = hit[inside], of[inside]
        phrases, matches = {}, {}
        if len(hit):
            cutat = np.flatnonzero((np.diff(hit) != 1) | (np.diff(of) != 0)) + 1
            for lo, hi in zip([0, *cutat.tolist()], [*cutat.tolist(), len(hit)]):
                r, a, b = int(of[lo]), int(hit[lo]), int(hit[hi - 1]) + 2
                words = [block.word(x).decode() for x in range(a, b)]
                self.stretch(words, a - int(block.first[r]), phrases.setdefault(r, []), matches.setdefault(r, []))
        return [(phrases.get(r, ()), self.chained(m) if (m := matches.get(r)) else ()) for r in range(len(block.counts))]


def _run(templates, phrases):
    def run(batches):
        scan = Scanner(templates, phrases)
        kinds = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            n, ps, ss = [], [], []
            for _, _, block in tb.blocks(batch.column(1), tb.ALNUM):
                n += block.counts.tolist()
                for p, s in scan(block):
                    ps.append([dict(zip(("label", "start", "end"), x)) for x in p])
                    ss.append([dict(zip(("label", "start", "end", "covered", "share"), x)) for x in s])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ps, kinds), pa.array(ss, spans)], ["doc_id", "n_words", "phrases", "spans"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, places of the phrases, covered template spans.

    Positions are word positions from 0, ends exclusive. Null texts have no words. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_run(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases), SCHEMA)


def license_report(docs: DataFrame) -> DataFrame:
    """Labels and a score per document: 1 where a phrase stands whole, else the largest covered share of a template."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    found = license_spans(docs)
    score = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        joined("phrases.label").alias("base_labels"),
        joined(F.concat("phrases.label", "spans.label")).alias("labels"),
        score.alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
