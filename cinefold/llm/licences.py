"""Licence scanning: TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Template words are weighed by how few documents have them; a word that no template has weighs as much as the rarest.
A line is looked at if it has a template word that is not an ``ORDINARY`` one, whatever its share of the documents. A document's headers are the runs of such
lines, and up to ``WINDOW`` neighbours of a run; each is a sparse vector, compared with every template. The best one of ``HEADER`` or more names the document's own licence. A document that is like a template as a whole
(``FILE`` or more) is a licence file, and the licence of its directory. A document without its own takes that of the nearest directory above it
that has one: directories, not documents, are joined with all their ancestors.

Defined cases: null and empty texts have no header. A null path is in no directory. Ties between templates go to the first in code point order, between
licence files of a directory to the most alike, then the smallest path. Repeated rows get the same answer. An empty table gives no rows.
Only ``doc_id``, ``path`` and ``text`` are looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import slices
from cinefold.session import step_table

HEADER = 0.6
FILE = 0.6
WINDOW = 6  # neighbouring lines that are compared together, besides whole runs
#: Template words that tell of no licence; all other template words do, however many documents have them.
ORDINARY = frozenset("2 3 a and any are as be by can either following in is it may not of or that the this to under v with without you".split())
TERM = re.compile(r"\w+(?:[.-]\w+)*")
#: The usual notices, by SPDX identifier.
TEMPLATES: dict[str, Sequence[str]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def _terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def document_counts(docs: DataFrame, templates: Mapping[str, Sequence[str]]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that have each template word; one row per template word comes to the driver."""
    vocabulary = {t for texts in templates.values() for text in texts for t in _terms(text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total[""] += batch.num_rows
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    if text:
                        total.update(vocabulary.intersection(_terms(text)))
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {row["term"]: row["n"] for row in rows}
    return found.pop("", 0), found


class Matcher:
    """Templates as unit vectors over weighed words."""

    def __init__(self, templates: Mapping[str, Sequence[str]], n: int, found: Mapping[str, int]):
        weigh = lambda df: math.log((1 + n) / (1 + df)) + 1
        names = {t for texts in templates.values() for text in texts for t in _terms(text)}
        self.weight, self.other = {t: weigh(found.get(t, 0)) for t in names}, weigh(1)
        each = [set(_terms(text)) for texts in templates.values() for text in texts]
        self.telling = {t for own in each for t in (own - ORDINARY or own)}
        self.templates = []
        for name in sorted(templates):
            for text in templates[name]:
                counts = Counter(_terms(text))
                length = math.sqrt(sum((c * self.weight[t]) ** 2 for t, c in counts.items()))
                self.templates.append((name, {t: c * self.weight[t] / length for t, c in counts.items()}))

    def best(self, terms: list[str]) -> tuple[float, str | None]:
        """The greatest cosine, and its template's name; the first of equals."""
        counts = Counter(terms)
        own = {t: c * self.weight.get(t, self.other) for t, c in counts.items()}
        length = math.sqrt(sum(w * w for w in own.values()))
        top: tuple[float, str | None] = (0.0, None)
        for name, vector in self.templates:
            cosine = sum(w * vector[t] for t, w in own.items() if t in vector) / length if length else 0.0
            if cosine > top[0] + 1e-12:
                top = (cosine, name)
        return top

    def read(self, text: str) -> tuple[float, str | None, int | None, float, str | None]:
        """Of the best header: cosine, licence, its first line; of the whole text: cosine, licence."""
        lowered = text.lower()
        lines = lowered.split("\n")
        telling = [i for i, line in enumerate(lines) if not self.telling.isdisjoint(TERM.findall(line))]
        top: tuple[float, str | None, int | None] = (0.0, None, None)
        runs: list[tuple[int, int]] = []
        for i in telling:
            runs = [*runs[:-1], (runs[-1][0], i + 1)] if runs and runs[-1][1] == i else [*runs, (i, i + 1)]
        windows = ((a, b) for first, end in runs for a in range(first, end) for b in range(a + 1, min(a + WINDOW, end) + 1))
        for a, b in dict.fromkeys([*runs, *windows]):
            cosine, name = self.best(TERM.findall("\n".join(lines[a:b])))
            if name and cosine > top[0] + 1e-12:
                top = (cosine, name, a)
        whole = self.best(TERM.findall(lowered)) if telling else (0.0, None)
        return (*top, *whole)


def own_licences(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``path`` and what each document's own text tells."""
    held = docs.sparkSession.sparkContext.broadcast((dict(templates), *document_counts(docs, templates)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                read = [matcher.read(text or "") for text in part.column("text").to_pylist()]
                kinds = (pa.float64(), pa.string(), pa.int32(), pa.float64(), pa.string())
                names = ["header_score", "header", "line", "file_score", "file"]
                yield pa.record_batch([part.column("doc_id"), part.column("path"), *(pa.array([r[k] for r in read], t) for k, t in enumerate(kinds))],
                                      names=["doc_id", "path", *names])

    schema = "doc_id long, path string, header_score double, header string, line int, file_score double, file string"
    return docs.select("doc_id", "path", "text").mapInArrow(scan, schema)


def licences(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, header: float = HEADER, file: float = FILE) -> DataFrame:
    """``doc_id``, ``path``, ``licence`` (null: none), its ``origin`` (header, file, inherited, none), ``score`` and ``line``; inherited ones with ``from_directory``."""
    told = step_table(own_licences(docs, templates), "licences")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), ""))
    told = told.withColumn("directory", parent)
    files = told.filter((F.col("file_score") >= file) & F.col("directory").isNotNull())
    granted = step_table(files.groupBy("directory").agg(
        F.min_by("file", F.struct(-F.col("file_score"), F.col("path"))).alias("granted")).withColumnRenamed("directory", "above"), "licence-directories")
    parts = F.split("directory", "/")
    above = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    chains = told.select("directory").filter("directory IS NOT NULL").distinct().select("directory", F.posexplode(above).alias("depth", "above"))
    nearest = chains.join(granted, "above").groupBy("directory").agg(F.max_by(F.struct("granted", "above"), "depth").alias("nearest"))
    rows = told.join(nearest, "directory", "left")
    is_file, has_own = F.col("file_score") >= file, F.col("header_score") >= header
    inherits = ~is_file & ~has_own & F.col("nearest").isNotNull()
    return rows.select(
        "doc_id", "path",
        F.when(is_file, F.col("file")).when(has_own, F.col("header")).otherwise(F.col("nearest.granted")).alias("licence"),
        F.when(is_file, "file").when(has_own, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(is_file, F.col("file_score")).when(has_own, F.col("header_score")).alias("score"),
        F.when(has_own & ~is_file, F.col("line")).alias("line"), F.when(inherits, F.col("nearest.above")).alias("from_directory"))
