"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Method. A file's segments are its lines, split at sentence ends, and its sentences joined over line ends
(comment marks are no words, so wrapped notices in comments join too; lines without words end them).
A segment's sparse vector holds the TF-IDF weights of its words; its cosine with each notice's vector decides. Inverse
document frequencies of the templates' words count all lines' segments of the corpus; other
words weigh as much as a word that occurs once. The best segment is the file's header
licence, and a file that as a whole is like a notice, or like one of the whole licence texts in ``licences``
(repeated words damped by logarithm, so that common words alone are no likeness), has that licence. It speaks for its
directory if it is a licence file: by its shape (like a whole licence text) or by its name (``LICENSE_NAMES``) and a notice; a
one-line notice in a file of another name speaks for itself only. A file without a header licence inherits from the licence file in the nearest directory
above it: each directory is joined with its ancestors, the longest match wins, and files
join their directory.

Skew: only directories, not files, are expanded to ancestors; a hot directory is one row
there, and its files are split by the skew join. The templates' words are the only data
collected (the templates bound them).

Defined results: null and empty texts and null paths have no licence of their own (a file with a
null path inherits nothing); an empty table gives none; very long texts are scanned in blocks of whole words; columns besides doc_id, path and text are not read; equal scores go to the first licence by name, equal licence files of a directory to the smallest path; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read_table
from .scan import ALNUM, longs, slices, word_hashes

HEADER_LIKENESS, FILE_LIKENESS = 0.6, 0.6
#: Least cosine of a file with a whole licence text.
TEXT_LIKENESS = 0.8
#: Names of files that hold the licence of a directory.
LICENSE_NAMES = r"(?i)^((un)?licen[cs]e|copying|copyright|notice)([-_. ][^/]*)?$"
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by the Free Software Foundation"
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
#: The notices that licences ask for, and first sentences of their texts.
TEMPLATES = [
    ("AGPL-3.0", _GNU.format("program", ":", "Affero") + ", either version 3 of the License, or (at your option) any later version"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", _GNU.format("program", ";", "") + "; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", _GNU.format("program", ":", "") + ", either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser") + "; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser") + ", either version 3 of the License, or (at your option) any later version"),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
#: Ends of segments: line ends and full stops before white space.
_ENDS = r"\n|\.\s+"
#: Ends of sentences that go on over line ends: lines without words, and full stops before white space.
_SENTENCE_ENDS = r"\n(?:[\x00-/:-@\[-`{-\x7F]*\n)|\.\s+"


@lru_cache(None)
def licence_texts() -> list[tuple[str, str]]:
    """(licence, its whole text), by name: the files of ``licences``."""
    return sorted((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in (resources.files(__package__) / "licences").iterdir() if x.name.endswith(".txt"))


def _segments(texts: pa.Array, ends: str = _ENDS) -> tuple[pa.Array, np.ndarray]:
    """All segments of all texts, and the text of each."""
    split = pc.split_pattern_regex(texts.fill_null(""), ends)
    return split.flatten(), pc.list_parent_indices(split).to_numpy()


class Templates:
    """Sparse unit vectors over the words of all templates."""

    def __init__(self, templates: list[tuple[str, str]], idf: dict[int, float] | None = None, rare: float = 1.0, damped: bool = False):
        self.licences = [name for name, _ in templates]
        words, at = word_hashes(pa.array([text for _, text in templates], pa.string()), ALNUM)
        self.words = np.unique(words)
        self.rare, self.damped = rare, damped
        self.idf = np.array([(idf or {}).get(int(w), rare) for w in self.words.view(np.int64)])
        vectors = np.zeros((len(templates), len(self.words)))
        np.add.at(vectors, (np.repeat(np.arange(len(templates)), np.diff(at)), np.searchsorted(self.words, words)), 1.0)
        vectors = self._times(vectors) * self.idf
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def _times(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0) if self.damped else n

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words

    def likeness(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best template and cosine of each stretch of words. Words outside the templates count once per occurrence."""
        n, size = len(at) - 1, len(self.words)
        owner = np.repeat(np.arange(n), np.diff(at))
        place, known = self.places(words)
        other = np.bincount(owner[~known], minlength=n) * self.rare ** 2
        cell, tf = np.unique(owner[known] * size + place[known], return_counts=True)
        weight = self._times(tf) * self.idf[cell % size]
        norm = np.sqrt(np.bincount(cell // size, weights=weight ** 2, minlength=n) + other)
        dots = np.stack([np.bincount(cell // size, weights=weight * v[cell % size], minlength=n) for v in self.vectors])
        cosine = dots / np.maximum(norm, 1e-300)
        best = cosine.argmax(axis=0)
        return best, cosine[best, np.arange(n)]


def _document_frequency(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            segments, _ = _segments(batch.column("text"))
            words, at = word_hashes(segments, ALNUM)
            place, known = templates.places(words)
            owner = np.repeat(np.arange(len(segments)), np.diff(at))
            cell = np.unique(owner[known] * len(templates.words) + place[known])
            term, n = np.unique(templates.words[cell % len(templates.words)], return_counts=True)
            filled = int(np.count_nonzero(np.diff(at)))
            yield pa.RecordBatch.from_arrays([pa.array([*term.view(np.int64).tolist(), None], pa.int64()), longs(np.append(n, filled))], ["term", "n"])
    return run


def _judge(templates: Templates, whole_texts: Templates):
    names = np.array(templates.licences, dtype=object)
    text_names = np.array(whole_texts.licences, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            parts = []
            for ends in (_ENDS, _SENTENCE_ENDS):
                segments, parent = _segments(texts, ends)
                parts.append((parent, *templates.likeness(*word_hashes(segments, ALNUM))))
            parent, best, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((best, -cosine, parent))
            first = order[np.concatenate(([True], parent[order][1:] != parent[order][:-1]))] if len(order) else order
            header, header_score = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows)
            header[parent[first]], header_score[parent[first]] = names[best[first]], cosine[first]
            header[header_score < HEADER_LIKENESS] = None
            words = word_hashes(texts, ALNUM)
            whole, whole_score = templates.likeness(*words)
            file = names[whole]
            file[whole_score < FILE_LIKENESS] = None
            text, text_score = whole_texts.likeness(*words)
            is_text = text_score >= TEXT_LIKENESS
            file[is_text], whole_score[is_text] = text_names[text[is_text]], text_score[is_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(header, pa.string()), pa.array(header_score), pa.array(file, pa.string()), pa.array(whole_score), pa.array(is_text)],
                                             ["doc_id", "path", "header_license", "header_score", "file_license", "file_score", "is_text"])
    return run


def scan_files(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, path, header_license, header_score, license, inherited_from) of files (doc_id, path, text)."""
    files = files.select("doc_id", "path", "text")
    texts = licence_texts()
    plain = Templates([*templates, *texts])
    counts = {r["term"]: r["n"] for r in files.mapInArrow(_document_frequency(plain), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(None, 0) or 0
    rare = float(np.log(1 + total) + 1)
    idf = {t: float(np.log((1 + total) / (1 + n)) + 1) for t, n in counts.items()}
    judged = cut(files.mapInArrow(_judge(Templates(templates, idf, rare), Templates(texts, idf, rare, damped=True)), "doc_id long, path string, header_license string, header_score double, file_license string, file_score double, is_text boolean"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)  # "" at the top
    judged = judged.withColumn("dir", folder)
    speaks = F.col("is_text") | F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_NAMES)
    by_dir = (judged.where(F.col("file_license").isNotNull() & F.col("path").isNotNull() & speaks).groupBy("dir")
              .agg(F.min_by(F.struct("file_license", "path"), F.struct(-F.col("file_score"), F.col("path"))).alias("l"))
              .select(F.col("dir").alias("above"), F.col("l.file_license").alias("inherited"), F.col("l.path").alias("inherited_from")))
    dirs = judged.where("path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    nearest = (dirs.withColumn("above", F.explode(F.array_distinct(above))).join(by_dir, "above").groupBy("dir")
               .agg(F.max_by(F.struct("inherited", "inherited_from"), F.length("above")).alias("i")).select("dir", "i.*"))
    return (judged.join(nearest, "dir", "left")
            .select("doc_id", "path", "header_license", "header_score", F.coalesce("header_license", "file_license", F.when(F.col("path").isNotNull(), F.col("inherited"))).alias("license"),
                    F.when(F.col("header_license").isNull() & F.col("file_license").isNull() & F.col("path").isNotNull(), F.col("inherited_from")).alias("inherited_from")))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file doc_id in the directory of its source."""
    docs = read_table(spark, sf_dir, "documents")
    return scan_files(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("path"), "text"))
