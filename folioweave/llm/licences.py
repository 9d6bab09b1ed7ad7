"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Units are the lines of a text and its runs of as many words as a template has (headers), and the text as a whole (licence
files). Template words are few and go to every task;
how rare they are is counted over all units of the corpus. Directories without a licence of their own get it by joins on
the paths of their ancestors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.tables import written
from folioweave.llm.words import chunks, shingle_hashes, word_hashes

# Notices by which the licences ask to be named.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
        "Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.")

# The header blocks that the licences recommend.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                   'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
                   "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, _GNU.format(kind, version, kind, kind)) for name, kind, version in [
        ("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3")]),
]

#: Tags name a licence exactly or not at all.
TAGS = [(name, f"SPDX-License-Identifier: {name}") for name in (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0",
    "MIT", "MIT-0", "MPL-2.0")]

#: Least cosine of a unit to a template.
THRESHOLD = 0.75

#: Runs of words are compared with whole templates of at most LONGEST words; longer licence texts are compared block by block, with
#: BLOCK words from every STEP-th on, so a quoted passage of BLOCK + STEP words holds a whole block. A block is compared with the
#: documents that hold PASSAGE of its words in a row; the first block of a text with all. Of a template of fewer than SHORT words, of
#: which one word may be the name, a run must have nearly all.
LONGEST, BLOCK, STEP, PASSAGE, SHORT, NEARLY = 300, 150, 75, 5, 12, 0.95


def licence_texts() -> list[tuple[str, str]]:
    """(licence, whole text), for the driver. The AGPL, which is the GPL but for its name and a section, is made from it to tell the two apart."""
    texts = {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))}
    affero = re.sub(r"(GNU )(General Public License)", r"\1Affero \2", texts["GPL-3.0"], flags=re.I).replace("29 June", "19 November")
    return [*texts.items(), ("AGPL-3.0", affero)]


def _run_templates(templates: list[tuple[str, str]], threshold: float) -> tuple[list[tuple[str, str]], list[float], list[bool]]:
    """The templates of runs, longest first, the least cosine to each, and whether it is compared only where a passage of it stands.

    Of blocks of equal length those that stand in one licence only come first, so that they name a text before shared ones do.
    """
    cut = [(name, re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)) for name, text in templates]
    every = [(n, w, max(threshold, NEARLY) if len(w) < SHORT else threshold, False) for n, w in cut if len(w) <= LONGEST]
    texts = [(name, words) for name, words in cut if len(words) > LONGEST]
    joined = [(name, f" {' '.join(words).lower()} ") for name, words in texts]
    for name, words in texts:
        starts = sorted({*range(0, len(words) - BLOCK, STEP), len(words) - BLOCK})
        every += [(name, words[i : i + BLOCK], threshold, i > 0) for i in starts]
    shared = lambda n, w: len(w) == BLOCK and any(n != other and f" {' '.join(w).lower()} " in text for other, text in joined)
    every += [(n, re.findall(r"[0-9A-Za-z]+", t), 1 - 1e-9, False) for n, t in TAGS]
    every.sort(key=lambda x: (-len(x[1]), shared(x[0], x[1])))
    return [(n, " ".join(w)) for n, w, *_ in every], [least for _, _, least, _ in every], [by_passage for *_, by_passage in every]


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    values = np.arange(256, dtype=np.uint8)
    values[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return values, inside


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, unit of each word, document of each unit) for lines; lines end at \\n and with their text."""
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1, [len(data)]]))
    words, firsts = word_hashes(data, bounds, *_byte_classes())
    unit = np.repeat(np.arange(len(bounds) - 1), np.diff(firsts))
    return words, unit, np.searchsorted(offsets, bounds[:-1], "right") - 1


def template_parts(templates: list[tuple[str, str]]) -> dict:
    """The words of the templates and each template's term counts over them, as plain arrays."""
    texts = pa.array([t for _, t in templates])
    (_, _, data, offsets), = chunks(texts, 1 << 40)
    words, firsts = word_hashes(data, offsets, *_byte_classes())
    vocabulary, at = np.unique(words, return_inverse=True)
    counts = np.zeros((len(templates), len(vocabulary)))
    np.add.at(counts, (np.repeat(np.arange(len(templates)), np.diff(firsts)), at), 1)
    passages, begin = shingle_hashes(words, firsts, PASSAGE)
    return {"names": [n for n, _ in templates], "vocabulary": vocabulary, "counts": counts, "passages": passages, "begin": begin}


def _ranks(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def _unit_counts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many lines hold each word of the vocabulary; word -1 counts the lines."""
    total = np.zeros(len(vocabulary) + 1, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            words, unit, _ = _units(data, offsets)
            total[-1] += len(np.unique(unit))
            rank = _ranks(words, vocabulary)
            known = rank >= 0
            pairs = np.unique(unit[known] * len(vocabulary) + rank[known])
            total[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocabulary)), -1)), pa.array(total)], ["word", "n"])


def cosines(words: np.ndarray, unit: np.ndarray, n_units: int, parts: dict) -> tuple[np.ndarray, np.ndarray]:
    """(best cosine, its template) of every unit. Words of no template weigh as much as the rarest.

    Units whose template words can't reach the threshold against their other words are left at 0 without counting terms.
    """
    best, which = np.zeros(n_units), np.full(n_units, -1)
    vocabulary, idf, rarest, threshold = parts["vocabulary"], parts["idf"], parts["rarest"], parts["threshold"]
    rank = _ranks(words, vocabulary)
    known = rank >= 0
    most = np.bincount(unit[known], idf[rank[known]], minlength=n_units) ** 2
    least = np.bincount(unit[~known], minlength=n_units) * rarest**2
    open_ = (most > 0) & (least * threshold**2 <= most * (1 - threshold**2))
    if not open_.any():
        return best, which
    number = np.cumsum(open_) - 1
    mine = open_[unit]
    words, rank, unit = words[mine], rank[mine], number[unit[mine]]
    inside, n = rank >= 0, int(open_.sum())
    cell, times = np.unique(unit[inside] * len(vocabulary) + rank[inside], return_counts=True)
    mine, rank = np.divmod(cell, len(vocabulary))
    weights = times * idf[rank]
    other, times = np.unique(np.stack([unit[~inside].astype(np.uint64), words[~inside]], axis=1), axis=0, return_counts=True)
    norm = np.bincount(mine, weights**2, minlength=n) + np.bincount(other[:, 0].astype(np.int64), (times * rarest) ** 2.0, minlength=n)
    top, top_which = np.full(n, -1.0), np.zeros(n, np.int64)
    for t, template in enumerate(parts["units"]):
        cosine = np.bincount(mine, weights * template[rank], minlength=n) / np.sqrt(norm)
        better = cosine > top
        top[better], top_which[better] = cosine[better], t
    best[open_], which[open_] = top, top_which
    return best, which


def _holders(words: np.ndarray, doc: np.ndarray, n_docs: int, parts: dict) -> dict[int, np.ndarray]:
    """The documents with a passage of each template that is compared by passages, for those that have any."""
    by_passage = np.flatnonzero(parts["by_passage"])
    if not len(by_passage):
        return {}
    template = np.repeat(np.arange(len(parts["names"])), np.diff(parts["begin"]))
    mine = np.isin(template, by_passage)
    known, of = np.unique(parts["passages"][mine], return_inverse=True)
    firsts = np.searchsorted(doc, np.arange(n_docs + 1))
    found, begin = shingle_hashes(words, firsts, PASSAGE)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hit = np.flatnonzero(known[at] == found)
    held = np.unique(np.stack([at[hit], np.searchsorted(begin, hit, "right") - 1], axis=1), axis=0) if len(hit) else np.empty((0, 2), np.int64)
    out: dict[int, list[np.ndarray]] = {}
    order = np.argsort(of.reshape(-1), kind="stable")
    bounds = np.searchsorted(of.reshape(-1)[order], np.arange(len(known) + 1))
    for passage in np.unique(held[:, 0]):
        docs = held[np.searchsorted(held[:, 0], passage) : np.searchsorted(held[:, 0], passage, "right"), 1]
        for t in np.unique(template[mine][order[bounds[passage] : bounds[passage + 1]]]):
            out.setdefault(int(t), []).append(docs)
    return {t: np.unique(np.concatenate(docs)) for t, docs in out.items()}


def run_cosines(words: np.ndarray, doc: np.ndarray, n_docs: int, parts: dict) -> tuple[np.ndarray, np.ndarray]:
    """(best cosine, its template) of every document's runs of as many words as a template has, where the template's least is reached.

    ``doc`` ascends. A run's norm is at least that of its words counted once each, so sums of words bound its cosine; terms are
    counted for runs whose bound is above what their document has reached. Templates that are compared by passages read the
    documents that hold one.
    """
    best, which = np.zeros(n_docs), np.full(n_docs, -1)
    vocabulary, idf, rarest = parts["vocabulary"], parts["idf"], parts["rarest"]
    every = _ranks(words, vocabulary), words, doc
    every += (np.concatenate([[0.0], np.cumsum(np.append(idf, rarest)[every[0]] ** 2)]),)
    holders = _holders(words, doc, n_docs, parts)
    narrowed: dict[bytes, tuple] = {}  # neighbouring blocks mostly have the same documents
    for t, least in enumerate(parts["least"]):
        if not parts["by_passage"][t]:
            rank, own, of, squares = every
        elif t in holders:
            key = holders[t].tobytes()
            if key not in narrowed:
                mine = np.isin(doc, holders[t])
                narrowed = {key: (every[0][mine], words[mine], doc[mine], np.concatenate([[0.0], np.cumsum(np.append(idf, rarest)[every[0][mine]] ** 2)]))}
            rank, own, of, squares = narrowed[key]
        else:
            continue
        length = int(parts["counts"][t].sum())
        if len(own) < length:
            continue
        dots = np.concatenate([[0.0], np.cumsum(np.append(parts["units"][t] * idf, 0.0)[rank])])
        bounds = (dots[length:] - dots[:-length]) / np.sqrt(squares[length:] - squares[:-length])
        starts = np.flatnonzero((bounds >= least - 1e-6) & (of[: len(bounds)] == of[length - 1 :]))
        for start in starts[np.argsort(-bounds[starts], kind="stable")]:
            if bounds[start] + 1e-6 <= best[of[start]]:
                continue
            run = slice(start, start + length)
            _, first, times = np.unique(own[run], return_index=True, return_counts=True)
            weight = np.append(idf, rarest)[rank[run][first]]
            cosine = (dots[start + length] - dots[start]) / np.sqrt(((times * weight) ** 2).sum())
            if cosine >= least - 1e-6 and cosine > best[of[start]] + 1e-6:
                best[of[start]], which[of[start]] = min(cosine, 1.0), t
    return best, which


def _scanned(batches: Iterator[pa.RecordBatch], parts: dict) -> Iterator[pa.RecordBatch]:
    runs, wholes = parts["runs"], parts["wholes"]
    parts = parts["lines"]
    names, run_names, whole_names = (np.array(p["names"], dtype=object) for p in (parts, runs, wholes))
    long = wholes["counts"].sum(axis=1) >= BLOCK
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text")):
            n = last - first
            words, unit, doc = _units(data, offsets)
            line, line_which = cosines(words, unit, len(doc), parts)
            whole, whole_which = cosines(words, doc[unit], n, wholes)
            run, run_which = run_cosines(words, doc[unit], n, runs)
            at = np.lexsort((line_which, -line, doc))  # of a document's lines the best one, of equal ones the first template
            top = at[np.concatenate([[True], doc[at][1:] != doc[at][:-1]])] if len(at) else at
            header, header_which = np.zeros(n), np.full(n, -1)
            header[doc[top]], header_which[doc[top]] = line[top], line_which[top]
            by_run = run > header + 1e-9
            header_name = np.where(by_run, run_names[run_which], names[header_which])
            header = np.where(by_run, run, header)
            is_file = (whole >= parts["threshold"]) & ((whole >= header) | long[whole_which])
            score = np.where(is_file, whole, header)
            good = score >= parts["threshold"]
            name = np.where(is_file, whole_names[whole_which], header_name)
            yield pa.RecordBatch.from_arrays(
                [batch.column("path").slice(first, n), pa.array(np.where(good, name, None), pa.string()), pa.array(np.where(good, score, 0.0)), pa.array(is_file)],
                ["path", "licence", "score", "whole"])


def _folder(path: Column) -> Column:
    """The directory of a path; empty for a path without any."""
    return F.regexp_replace(path, r"(?s)/?[^/]*$", "")


def scan_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score, origin), one row for each row of ``files`` (path, text; other columns are ignored).

    A file's licence is the template with the largest cosine, at least ``threshold``, among its lines and runs of words (origin
    ``header``) and its whole text (origin ``file``). Runs are compared with ``templates``, header blocks, tags and licence texts,
    of the longest all blocks of BLOCK words; whole texts with all but the tags. A directory's licence comes from the files in it that are licences as a whole or are
    called LICENSE, LICENCE or COPYING; the best score counts, then the first name. Files without a licence of their own get
    that of their nearest directory that has one (origin ``inherited``); others have a null licence and score 0.

    * Null and empty texts have no licence of their own; a null path inherits nothing.
    * Repeated rows get equal results, one each. Texts are read whole. An empty table gives an empty result.
    """
    spark = files.sparkSession
    wholes = templates + HEADERS + licence_texts()
    run_templates, least, by_passage = _run_templates(wholes, threshold)
    sides = {"lines": template_parts(templates), "runs": template_parts(run_templates) | {"least": least, "by_passage": by_passage}, "wholes": template_parts(wholes)}
    vocabulary = np.unique(np.concatenate([side["vocabulary"] for side in sides.values()]))
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(vocabulary)
    counted = rows.select("text").mapInArrow(lambda batches: _unit_counts(batches, sent.value), "word long, n long")
    counts = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row a template word
    total = counts.pop(-1, 0)
    every_idf = np.array([np.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in range(len(vocabulary))])
    for side in sides.values():
        idf = every_idf[_ranks(side["vocabulary"], vocabulary)]
        units = side["counts"] * idf
        side |= {"idf": idf, "rarest": float(np.log(1 + total) + 1), "threshold": threshold, "units": units / np.sqrt((units**2).sum(axis=1, keepdims=True))}
    known = spark.sparkContext.broadcast(sides)
    scanned = rows.mapInArrow(lambda batches: _scanned(batches, known.value), "path string, licence string, score double, whole boolean")
    scanned = written(scanned.withColumn("folder", _folder(F.col("path"))), "licences")
    named = F.col("whole") | F.col("path").rlike(r"(?i)(?:^|/)(?:licen[cs]e|copying)[^/]*$")
    owners = scanned.where("licence is not null and path is not null").where(named)
    best = owners.groupBy("folder", "licence").agg(F.max("score").alias("score"))
    best = best.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("own"))
    best = written(best.select("folder", F.col("own.licence").alias("licence"), (-F.col("own.minus")).alias("score")), "folder-licences")
    folders = scanned.where("licence is null and path is not null").select("folder").distinct()
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    above = F.posexplode(F.array_distinct(above)).alias("depth", "above")
    reached = folders.select("folder", above).join(best.withColumnRenamed("folder", "above"), "above")
    nearest = reached.groupBy("folder").agg(F.max_by(F.struct("licence", "score"), "depth").alias("from"))
    nearest = written(nearest, "inherited")
    out = scanned.join(nearest, "folder", "left")
    own = F.col("licence").isNotNull()
    origin = F.when(own, F.when(F.col("whole"), "file").otherwise("header")).when(F.col("from").isNotNull() & F.col("path").isNotNull(), "inherited")
    return out.select(
        "path", F.when(own, F.col("licence")).otherwise(F.when(origin == "inherited", F.col("from.licence"))).alias("licence"),
        F.when(own, F.col("score")).when(origin == "inherited", F.col("from.score")).otherwise(0.0).alias("score"), origin.alias("origin"))
