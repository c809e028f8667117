"""License scans by conditional compression.

Lines and sentences with a word that licenses use are joined to candidate
blocks. Every block is compressed alone and with each template as a raw
dictionary; the share by which the template shortens it ranks the templates.
The best few are then compared word for word with the block, and the first
whose wording agrees in four fifths of the words wins: ``exact`` if nothing
differs, ``modified`` with the differing words otherwise. A block without such
a template is no finding.

Notices are often wrapped at a line's end or commented out, and some of their
lines have no cue. So every template is also laid over all words near a cue,
as far as the longest template reaches on both sides and whatever breaks or marks lie between; where four
fifths of its words can be, the stretch that agrees best is a block of its own. It takes
the place of findings that it overlaps if it explains more words than they do.

One pass without a shuffle; equal blocks are compared once per task. A null
or empty text has no block. Long texts are read whole: a sentence of more than
``PIECE`` characters is cut into pieces at blanks, and each piece is a sentence.
Repeated rows are reported each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import parts_of

# Usual wordings of license notices.
TEMPLATES = {
    "Apache-2.0 (notice)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                           "compliance with the License. You may obtain a copy of the License at "
                           "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT (permission)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                        'associated documentation files (the "Software"), to deal in the Software without restriction, '
                        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                        "subject to the following conditions:",
    "MIT": "Released under the MIT License.",
    "BSD (redistribution)": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                            "provided that the following conditions are met:",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                        "or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights.",
    "All rights reserved": "Copyright. All rights reserved.",
}
CUES = re.compile(r"licen[cs]|copyright|redistribut|warrant|permission\s+is|free\s+software|public\s+domain|rights\s+reserved", re.I)
CUE = CUES.search
CUE_WORDS = ("licen", "copyright", "redistribut", "warrant", "permission", "free", "public", "reserved")
CUE_STEMS = ("licen", "copyright", "redistribut", "warrant", "permission is", "free software", "public domain", "rights reserved")
SENTENCES = re.compile(r"[^\n]*?[.!?:](?=\s+[^\s\d]|\s*$)|[^\n]+").finditer
WORD = re.compile(r"\w+(?:[.\-+/]\w+)*")
WORDS = WORD.findall
PIECE, GAP, BEST = 2_000, 1, 3


def sentences(text: str):
    """(begin, end) of sentences and of pieces of overlong ones."""
    for match in SENTENCES(text):
        at, end = match.span()
        while end - at > PIECE:
            cut = text.rfind(" ", at + 1, at + PIECE)
            cut = cut if cut > 0 else at + PIECE
            yield at, cut
            at = cut
        yield at, end


def candidate_blocks(text: str) -> list[tuple[int, str]]:
    """Where blocks begin, and their texts: sentences with a cue, joined over ``GAP`` others at most."""
    low = text.lower()
    if not any(stem in low for stem in CUE_STEMS):
        return []
    blocks, since = [], GAP + 1
    for begin, end in sentences(text):
        if CUE(text, begin, end):
            if since <= GAP and end - blocks[-1][0] <= 2 * PIECE:
                blocks[-1][1] = end
            else:
                blocks.append([begin, end])
            since = 0
        else:
            since += 1
    return [(b, text[b:e]) for b, e in blocks]


class Scanner:
    """Templates as dictionaries."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.names = sorted(templates)
        self.words = {n: self.normal(templates[n]) for n in self.names}
        as_dict = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = {"level": 9, "write_content_size": False}
        self.plain = zstandard.ZstdCompressor(**options)
        self.given = {n: zstandard.ZstdCompressor(dict_data=as_dict(" ".join(self.words[n])), **options) for n in self.names}
        self.longest = max(map(len, self.words.values()), default=0)
        self.frame = len(self.plain.compress(b""))
        self.seen: dict[str, list] = {}
        self.laid: dict[str, list] = {}

    @staticmethod
    def normal(text: str) -> list[str]:
        return WORDS(text.lower())

    def ranked(self, words: list[str]) -> list[tuple[float, str]]:
        """(share of the block's size that the template saves, name), best first."""
        data = " ".join(words).encode()
        alone = max(1, len(self.plain.compress(data)) - self.frame)
        saved = [(1 - (len(self.given[n].compress(data)) - self.frame) / alone, n) for n in self.names]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def _confirm(self, words: list[str]):
        for rank, (saved, name) in enumerate(self.ranked(words)[:BEST], 1):
            template = self.words[name]
            missing, added, equal = [], [], 0
            steps = SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
            # Words before and behind the notice are no part of it.
            steps = [s for i, s in enumerate(steps) if not (s[0] == "insert" and i in (0, len(steps) - 1))]
            for kind, a, b, c, d in steps:
                if kind == "equal":
                    equal += b - a
                else:
                    missing += template[a:b]
                    added += words[c:d]
            if 10 * equal >= 8 * max(len(template), equal + len(added)):
                return name, rank, round(saved, 4), equal, missing, added
        return None

    def findings(self, block: str) -> list[tuple]:
        """(offset, length, name, rank, saved, equal, missing, added) of the block or of its sentences, whichever explains more words."""
        if block not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            tried = lambda spans: [(a, b - a, *found) for a, b in spans if (found := self._confirm(self.normal(block[a:b])))]
            whole, single = tried([(0, len(block))]), tried(s for s in sentences(block) if CUE(block, *s))
            words = lambda findings: sum(f[5] for f in findings)
            self.seen[block] = whole if words(whole) >= words(single) else single
        return self.seen[block]

    def _best_stretch(self, template: list[str], words: list[str]) -> tuple[int, int]:
        """Where in ``words`` the template agrees best: 1 an equal word, -1 a differing one."""
        best, score, begin, span = 0, 0, 0, (0, 0)
        for kind, a, b, c, d in SequenceMatcher(None, template, words, autojunk=False).get_opcodes():
            if score <= 0:
                score, begin = 0, c
            score += b - a if kind == "equal" else -max(b - a, d - c)
            if score > best:
                best, span = score, (begin, d)
        return span

    def _wrapped(self, words: list[str]) -> list[tuple]:
        """(first word, end, found) of notices among the words, wherever lines and sentences end."""
        out, counts = [], Counter(words)
        for name in self.names:
            template = self.words[name]
            there = sum(min(n, counts[w]) for w, n in Counter(template).items())
            waiting = [(0, len(words))] if 10 * there >= 8 * len(template) else []
            while waiting:
                low, high = waiting.pop()
                begin, end = (low + at for at in self._best_stretch(template, words[low:high]))
                if 10 * (end - begin) < 8 * len(template):
                    continue
                found = self._confirm(words[begin:end])
                if found:
                    out.append((begin, end, found))
                waiting += [(low, begin), (end, high)]
        return out

    def notices(self, text: str) -> list[tuple]:
        """What ``findings`` gives for all blocks and for the words near cues, offsets in the text."""
        base = [(at + a, *rest) for at, block in candidate_blocks(text) for a, *rest in self.findings(block)]
        low = text.lower()
        if not any(stem in low for stem in CUE_WORDS):
            return base
        places = [m.span() for m in WORD.finditer(text)]
        begins, reach, windows = [a for a, _ in places], 2 * self.longest, []
        for cue in CUES.finditer(text):
            at = bisect_right(begins, cue.start())
            if windows and at - reach <= windows[-1][1]:
                windows[-1][1] = at + reach
            else:
                windows.append([max(0, at - reach), at + reach])
        more = []
        for first, last in windows:
            own = [text[a:b].lower() for a, b in places[first:last]]
            key = " ".join(own)
            if key not in self.laid:
                if len(self.laid) > 2_000:
                    self.laid.clear()
                self.laid[key] = self._wrapped(own)
            for a, b, found in self.laid[key]:
                begin = places[first + a][0]
                more.append((begin, places[first + b - 1][1] - begin, *found))
        for new in sorted(more, key=lambda f: (-f[5], len(f[6]) + len(f[7]), f[0])):
            over = [f for f in base if f[0] < new[0] + new[1] and new[0] < f[0] + f[1]]
            if new[5] > sum(f[5] for f in over):
                base = [f for f in base if f not in over] + [new]
        return sorted(base, key=lambda f: f[:3])


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def license_findings(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, begin, length, license, verdict, rank, saved, equal, missing, added, wording) of every notice found.

    ``begin`` and ``length`` count characters of the text; missing and added are the differing words.
    """
    import pyarrow as pa

    known = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "begin", "length", "license", "verdict", "rank", "saved", "equal", "missing", "added", "wording"]

    def scan(batches):
        scanner = _scanner(known)
        for batch in batches:
            for part in parts_of(batch):
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for begin, size, name, rank, saved, equal, missing, added in scanner.notices(text or ""):
                        verdict = "modified" if missing or added else "exact"
                        out.append((doc_id, begin, size, name, verdict, rank, saved, equal, missing, added,
                                    text[begin:begin + size]))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64(), pa.int64()] + [
                    pa.list_(pa.string())] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(scan, "doc_id long, begin long, length long, license string, verdict string, rank long, "
                                 "saved double, equal long, missing array<string>, added array<string>, wording string")
