"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines of a text (headers) and texts that are nothing but a license (license
files) are compared with license templates.  Rows without a license of their own
take that of the license file in the nearest directory above them, found by
joining directories with their ancestors.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (SPDX identifier, statement)
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
#: Licenses whose full texts, in license_texts, whole texts are compared with.
FILES = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
#: Counts only where no license matches: texts under any license say so too.
CLAIM = "Proprietary"
#: Least cosine of a line with a template, and of a whole text that counts as a license file.
LINE, WHOLE = 0.75, 0.7
#: Terms of a header at most that is wrapped over several lines.
HEADER_TERMS = 64
#: Directories whose licenses are broadcast at most, and characters of their names.
BROADCAST_DIRECTORIES, BROADCAST_CHARS = 20_000, 4_000_000
#: Digits of a cosine: scores that differ in rounding only are ties.
DIGITS = 9

_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class FileMatcher:
    """TF-IDF vectors of full license texts; counts are damped, or the articles of any long text would be most of its vector."""

    def __init__(self, names: list[str] = FILES, whole: float = WHOLE):
        self.names = names
        bags = [Counter(terms(pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode())) for n in names]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in df.items()}
        self.unseen = 1 + math.log(1 + len(bags))
        self.postings: dict[str, list[tuple[int, float]]] = {}
        #: distinct words of a template that a text needs at least, by Cauchy and Schwarz
        self.least = len(df)
        for i, b in enumerate(bags):
            weights = {w: (1 + math.log(c)) * self.idf[w] for w, c in b.items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            rest, need = whole * whole, 0
            for x in sorted(weights.values(), reverse=True):
                if rest <= 0:
                    break
                rest, need = rest - (x / norm) ** 2, need + 1
            self.least = min(self.least, need)
            for w, x in weights.items():
                self.postings.setdefault(w, []).append((i, x / norm))

    def best(self, text: str) -> tuple[float, str | None]:
        """(cosine, license) of the nearest text, (0, None) where too few words are shared for any."""
        found = terms(text)
        if len(self.postings.keys() & (distinct := set(found))) < self.least:
            return 0.0, None
        bag, score, total = Counter(found), [0.0] * len(self.names), 0.0
        for w in distinct:
            x = (1 + math.log(bag[w])) * self.idf.get(w, self.unseen)
            total += x * x
            for i, y in self.postings.get(w, ()):
                score[i] += x * y
        i = max(range(len(score)), key=lambda k: (score[k], -k))
        return round(score[i] / math.sqrt(total), DIGITS), self.names[i]


class Matcher:
    """TF-IDF vectors of templates, and the cosine of other texts with them."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, line: float = LINE, whole: float = WHOLE):
        self.files = FileMatcher(whole=whole)
        self.names, self.line, self.whole = [n for n, _ in templates], line, whole
        bags = [Counter(terms(t)) for _, t in templates]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in df.items()}
        self.unseen = 1 + math.log(1 + len(bags))
        self.postings: dict[str, list[tuple[int, float]]] = {}
        cues: set[str] = set()
        for i, b in enumerate(bags):
            norm = math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in b.items()))
            weights = {w: c * self.idf[w] / norm for w, c in b.items()}
            for w, x in weights.items():
                self.postings.setdefault(w, []).append((i, x))
            # the cosine with a text that lacks the cues is at most the norm of the rest, by Cauchy and Schwarz
            rest = 1.0
            for w, x in sorted(weights.items(), key=lambda t: (-t[1], t[0])):
                if math.sqrt(max(rest, 0)) < min(line, whole):
                    break
                cues.add(w)
                rest -= x * x
        self.cue = re.compile("|".join(sorted(map(re.escape, cues), key=lambda w: (-len(w), w))))

    def best(self, text: str) -> tuple[float, int]:
        """(cosine, template) of the nearest template; of equals the first."""
        bag = Counter(terms(text))
        norm = math.sqrt(sum((c * self.idf.get(w, self.unseen)) ** 2 for w, c in bag.items()))
        score = [0.0] * len(self.names)
        for w, c in bag.items():
            for i, x in self.postings.get(w, ()):
                score[i] += c * self.idf[w] * x
        i = max(range(len(score)), key=lambda k: (score[k], -k))
        return (round(score[i] / norm, DIGITS) if norm else 0.0), i

    def wrapped(self, lines: list[str], cued: list[int], top: tuple) -> tuple:
        """top, or a better (cosine, template, first line) of a header that goes over several lines, one of them in cued."""
        found: dict[int, list[str]] = {}

        def of(k: int) -> list[str]:
            if k not in found:
                found[k] = terms(lines[k])
            return found[k]

        starts: set[int] = set()
        for k in cued:
            a, size = k, 0
            while a >= 0 and (size := size + len(of(a))) <= HEADER_TERMS and (a == k or a not in starts):
                starts.add(a)
                a -= 1
        for a in sorted(starts):
            if not any(w in self.postings for w in of(a)):
                continue  # without this line the cosine is no smaller
            bag: dict[str, int] = {}
            score, norm, size, blank = [0.0] * len(self.names), 0.0, 0, 0
            for b in range(a, len(lines)):
                own = of(b)
                size += len(own)
                blank = 0 if own else blank + 1
                if size > HEADER_TERMS or blank > 1:
                    break
                hit = False
                for w in own:
                    c = bag.get(w, 0)
                    bag[w] = c + 1
                    norm += (2 * c + 1) * self.idf.get(w, self.unseen) ** 2
                    for i, x in self.postings.get(w, ()):
                        hit = True
                        score[i] += self.idf[w] * x
                if b > a and hit:
                    i = max(range(len(score)), key=lambda k: (score[k], -k))
                    s = round(score[i] / math.sqrt(norm), DIGITS)
                    if s >= self.line and s > top[0] and self.names[i] != CLAIM:
                        top = (s, i, a)
        return top

    def scan(self, text: str) -> tuple[str | None, float, int | None, bool]:
        """(license, cosine, line number from 0, whether the text is a license file) of the line that matches best."""
        top: tuple = (0.0, 0, None)
        claim: tuple = (0.0, 0, None)
        file = self.files.best(text)
        cue = self.cue.search(text.lower())
        if not cue and file[0] < self.whole:
            return None, 0.0, None, False
        lines = text.split("\n") if cue else []
        cued = [k for k, line in enumerate(lines) if self.cue.search(line.lower())]
        for k in cued:
            s, i = self.best(lines[k])
            if s >= self.line:
                if self.names[i] == CLAIM:
                    claim = max(claim, (s, i, k), key=lambda x: x[0])
                elif s > top[0]:
                    top = (s, i, k)
        top = self.wrapped(lines, cued, top)
        s, i = self.best(text) if cue else (0.0, 0)
        if file[0] >= self.whole and (file[0] >= s or self.names[i] == CLAIM):
            return file[1], file[0], top[2], True
        if s >= self.whole and (self.names[i] != CLAIM or top[2] is None):
            return self.names[i], s, (claim if self.names[i] == CLAIM else top)[2], True
        top = top if top[2] is not None else claim
        return (self.names[top[1]], top[0], top[2], False) if top[2] is not None else (None, 0.0, None, False)


_FOUND = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("license", pa.string()), ("score", pa.float64()), ("line", pa.int64()), ("is_file", pa.bool_())])
_FOUND_DDL = "doc_id long, path string, license string, score double, line long, is_file boolean"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = Matcher()
    for b in batches:
        rows = [m.scan(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), *(pa.array(x, f.type) for x, f in zip(cols, list(_FOUND)[2:]))], schema=_FOUND)


def scan_licenses(docs: DataFrame, path) -> DataFrame:
    """doc_id, license, score, line, found_in (own, inherited or none), directory; a row per row of docs.

    path: a Column, the place of a text in a tree, segments separated by "/"; a
    null path has no directories above it.  Of the license files of a directory
    the one of the highest score, then smallest doc_id, then smallest license,
    holds for what is below.
    Null and empty texts have no license of their own but inherit; texts of any
    length are compared as a whole.  Other columns are ignored.  Repeated rows
    and null doc_ids are scanned like any other; an empty table gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(), path.cast("string").alias("path")).mapInArrow(_scan, _FOUND_DDL)
    found = C.materialize(found.withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "licenses")
    files = found.where("is_file and path is not null").groupBy("directory").agg(F.min_by("license", F.struct(-F.col("score"), F.coalesce("doc_id", F.lit(2**63 - 1)), "license")).alias("inherited"))
    files = files.select(F.col("directory").alias("ancestor"), "inherited")
    directories = found.where("path is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = directories.select("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("ancestor"))
    nearest = above.join(files, "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "inherited"), F.length("ancestor")).alias("near"))
    nearest = C.materialize(nearest.select("directory", "near.ancestor", "near.inherited"), "directories")
    rows, chars = nearest.agg(F.count("*"), F.coalesce(F.sum(F.length("directory") + F.length("ancestor")), F.lit(0))).first()
    side = F.broadcast(nearest) if rows <= BROADCAST_DIRECTORIES and chars <= BROADCAST_CHARS else nearest
    out = found.join(side, "directory", "left")
    own = F.col("license").isNotNull()
    how = F.when(own, "own").when(F.col("inherited").isNotNull() & F.col("path").isNotNull(), "inherited").otherwise("none")
    return out.withColumn("found_in", how).select(
        "doc_id", F.when(F.col("found_in") == "inherited", F.col("inherited")).otherwise(F.col("license")).alias("license"), "score", "line", "found_in",
        F.when(F.col("found_in") == "inherited", F.col("ancestor")).alias("directory"),
    )
