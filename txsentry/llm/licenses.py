"""Licence scan: MinHash bands over overlapping windows, then exact containment.

Words are ``\\w+`` in lower case, shingles five words.  Templates are put into
classes by their number of shingles (each class at most half as long again as
its shortest).  A text is cut into blocks of the class's longest template, and
every two adjacent blocks are a window: a passage of a template's length lies
in some window whole.  A window and a template share a candidate when they
agree on one band of MinHashes; ``band_settings`` chooses as many bands as a
match of ``SIMILARITY`` containment needs to collide with probability
``CERTAINTY``.  A candidate is a match if the window holds at least
``SIMILARITY`` of the template's shingles, counted on the words themselves.

Templates are a bounded parameter and travel with the tasks; texts are read
once and not shuffled.

Versions and relatives of a notice share most of their words.  Of those that
``related`` puts in one set and that are found in overlapping windows of a text,
only the one with the most shingles held is reported (a tie: all of them).  The
registered query scans for ``NOTICES`` with ``RELATED``.

Defined cases: templates below five words are left out; null or short texts match nothing; a text matches a template
once, with its best window (ties: the first); rows repeated with one id are
all scanned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txsentry.llm.common import col
from txsentry.llm.minhash import mix, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
CERTAINTY = 0.999
CHUNK_WORDS = 300_000
WORD = re.compile(r"\w+")

# Notices as they stand in files, by licence identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
               " MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
                " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
                " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
                " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
}
# The same with the usual headers of source files.
NOTICES = TEMPLATES | {
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-only-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License"
                           " version 2 as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
           " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
GRANT = ("you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation,"
         " either version {} of the License, or (at your option) any later version")
NOTICES |= {f"{name}-{version}-header": GRANT.format(title, version) for name, title, version in (
    ("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"),
    ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3"),
    ("AGPL", "Affero General Public License", "3"))}
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
       " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
       " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
       " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
       " with the distribution.")
NOTICES |= {"BSD-2-Clause-text": BSD,
            "BSD-3-Clause-text": BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be"
                                       " used to endorse or promote products derived from this software without specific"
                                       " prior written permission."}
RELATED = [{"GPL-2.0", "GPL-3.0"}, {k for k in NOTICES if k.endswith("-header")}, {"BSD-2-Clause-text", "BSD-3-Clause-text"}]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)}


def band_settings(jaccard: float, certainty: float = CERTAINTY, rows: int = 1) -> int:
    """Bands of ``rows`` MinHashes so that a pair of that Jaccard similarity
    agrees on one of them with probability ``certainty`` at least."""
    return math.ceil(math.log(1 - certainty) / math.log(1 - jaccard ** rows))


class Class:
    """Templates of similar length: block size, bands and their MinHashes."""

    def __init__(self, size: int, templates: dict[str, list[str]]):
        self.size = size
        self.sets = {k: shingles(w) for k, w in templates.items()}
        least = min(len(s) for s in self.sets.values())
        shared = math.ceil(SIMILARITY * least)
        self.bands = band_settings(shared / (2 * size + least - shared))
        hashes = {k: shingle_hashes([x.encode() for x in w], WORDS) for k, w in templates.items()}
        self.values = [{k: mix(h ^ _seed(b)).min() for k, h in hashes.items()} for b in range(self.bands)]


def _seed(band: int) -> np.uint64:
    return np.uint64((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64))


def classes(templates: dict[str, str]) -> list[Class]:
    """Classes over the templates of at least one shingle."""
    sized = sorted((len(words_of(t)) - WORDS + 1, k) for k, t in templates.items())
    sized = [(n, k) for n, k in sized if n > 0]
    out: list[list] = []
    for n, k in sized:
        if out and n <= 1.5 * out[-1][0][0]:
            out[-1].append((n, k))
        else:
            out.append([(n, k)])
    return [Class(g[-1][0], {k: words_of(templates[k]) for _, k in g}) for g in out]


def find(docs: list[list[str]], known: list[Class]) -> list[tuple[int, str, int, int, float]]:
    """(doc, template, first word, end word, containment) per doc and template."""
    hashes = [shingle_hashes([x.encode("utf-8", "surrogatepass") for x in w], WORDS) if len(w) >= WORDS
              else np.zeros(0, np.uint64) for w in docs]
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if len(docs) else np.zeros(0, np.uint64)
    if not len(flat):
        return []
    begin = np.cumsum(sizes) - sizes
    best: dict[tuple[int, str], tuple] = {}
    for c in known:
        blocks = -(-sizes // c.size)
        doc = np.repeat(np.arange(len(docs)), blocks)
        first = np.cumsum(blocks) - blocks
        start = begin[doc] + (np.arange(len(doc)) - first[doc]) * c.size
        joins = np.append(doc[1:] == doc[:-1], False)      # the next block is of the same text
        for b in range(c.bands):
            low = np.minimum.reduceat(mix(flat ^ _seed(b)), start)
            window = np.where(joins, np.minimum(low, np.append(low[1:], low[-1:])), low)
            for name, value in c.values[b].items():
                for at in np.flatnonzero(window == value).tolist():
                    d, a = int(doc[at]), int(start[at] - begin[doc[at]])
                    end = min(a + 2 * c.size, int(sizes[d])) + WORDS - 1
                    held, want = shingles(docs[d][a:end]), c.sets[name]
                    share = len(held & want) / len(want)
                    if share >= SIMILARITY:
                        key = (d, name)
                        best[key] = min(best.get(key, (0.0,)), (-share, a, end))
    return [(d, name, a, end, -share) for (d, name), (share, a, end) in sorted(best.items())]


def without_relatives(found: list[tuple], sizes: dict[str, int], related: list[set[str]]) -> list[tuple]:
    """``found`` without matches that a relative in an overlapping window explains better."""
    by_doc: dict[int, list[tuple]] = {}
    for f in found:
        by_doc.setdefault(f[0], []).append(f)

    def better(f: tuple, g: tuple) -> bool:
        return (g[2] < f[3] and f[2] < g[3] and round(g[4] * sizes[g[1]]) > round(f[4] * sizes[f[1]])
                and any(f[1] in r and g[1] in r for r in related))

    return [f for f in found if not any(better(f, g) for g in by_doc[f[0]])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", related: list[set[str]] | None = None) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment): one row per text and template found in it."""
    notices = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes(notices)
        sizes = {k: len(s) for c in known for k, s in c.sets.items()}

        def done(ids, texts):
            found = without_relatives(find(texts, known), sizes, related or [])
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
                 pa.array([f[4] for f in found], pa.float64())],
                names=["doc_id", "license", "first_word", "end_word", "containment"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(words_of(t.as_py()))
                size += len(texts[-1])
                if size >= CHUNK_WORDS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
        yield done(ids, texts)

    return (docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, license string, first_word long, end_word long, containment double"))
