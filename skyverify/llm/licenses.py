"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance from ancestor directories.

Templates are whole licence texts, the standard headers of files, tags and one-line notices.  Units
of a file are compared with all of them as sparse TF-IDF vectors: its lines, its blocks (lines without
a blank one between, where comments and other lines are blocks of their own, as a header of a
source file is), and the whole text, as a licence file is.  Inverse document frequencies of the
templates' terms are counted over all files; any other term gets the largest one.

A file's license is its best unit's, if that is similar enough.  A file that is mostly license, or
is named like one, is a license file and speaks for its directory.  A file without a license takes
that of the nearest ancestor directory with one, found by joining directories to their ancestors.

Most units are ruled out without a loss.  Of each template the heaviest terms are keys, as many as
hold more than 1 - least^2 of its squared length.  By Cauchy's inequality a unit without any of them
has a cosine under ``least``, so only units with a key are compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from importlib import resources

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: One-line notices (fixed values).
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Use of this source code is governed by a BSD-style license (2-Clause)."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license (3-Clause).", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL, version 3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0."],
}
#: Identifiers of tags (fixed values); the GNU ones may end in -only and -or-later.
TAGS = ["Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.

You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_KINDS = {"GPL-2.0": "General Public License", "GPL-3.0": "General Public License", "LGPL-2.1": "Lesser General Public License", "LGPL-3.0": "Lesser General Public License", "AGPL-3.0": "Affero General Public License"}
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_NAME = re.compile(r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$")
#: What a line of a comment begins with.
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\"|rem\b)", re.I)


def default_templates() -> dict[str, list[str]]:
    """Texts of each license: notices, tags, headers with and without their further paragraphs, and the whole text."""
    out: defaultdict[str, list[str]] = defaultdict(list)
    for name, texts in NOTICES.items():
        out[name] += texts
    for name in TAGS:
        out[name] += [f"SPDX-License-Identifier: {name}{end}" for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    headers = {"Apache-2.0": _APACHE, "MPL-2.0": _MPL} | {k: _GNU.format(kind=kind, version=k.split("-")[1].removesuffix(".0")) for k, kind in _GNU_KINDS.items()}
    for name, text in headers.items():
        out[name] += dict.fromkeys([text, text.split("\n\n")[0]])
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        out[file.name.removesuffix(".txt")].append(file.read_text())
    return dict(out)


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def vocabulary(templates: Mapping[str, Sequence[str]]) -> frozenset[str]:
    return frozenset(t for texts in templates.values() for x in texts for t in terms(x))


class Matcher:
    """Cosines of units to templates; among equals the first license by name counts."""

    def __init__(self, templates: Mapping[str, Sequence[str]], df: Mapping[str, int], n: int, least: float):
        self.least, self.top = least, math.log(n + 1) + 1
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in sorted(vocabulary(templates))}
        self.names: list[str] = []
        self.weights: defaultdict[str, list[tuple[int, float]]] = defaultdict(list)  # of each term in templates by number
        keys: set[str] = set()
        for name in sorted(templates):
            for text in templates[name]:
                v = self.vector(Counter(terms(text)))
                mass = 0.0
                for t, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
                    self.weights[t].append((len(self.names), x))
                    if mass <= 1 - least**2 + 1e-9:
                        keys.add(t)
                        mass += x * x
                self.names.append(name)
        self.keys = frozenset(keys)

    def vector(self, counts: Mapping[str, int]) -> dict[str, float]:
        v = {t: (1 + math.log(c)) * self.idf.get(t, self.top) for t, c in counts.items()}
        norm = math.sqrt(math.fsum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def unit(self, counts: Mapping[str, int]) -> tuple[str | None, float]:
        """The license of the most similar template and the cosine; None and 0 if it's under the limit."""
        if self.keys.isdisjoint(counts):
            return None, 0.0
        sums = [0.0] * len(self.names)
        for t, x in self.vector(counts).items():
            for k, y in self.weights.get(t, ()):
                sums[k] += x * y
        sums = [round(x, 9) for x in sums]  # the order of addition breaks no tie
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        return (self.names[best], sums[best]) if sums[best] >= self.least else (None, 0.0)

    def text(self, text: str) -> tuple[str | None, float, float]:
        """License, cosine, and the share of words in license units."""
        if self.keys.isdisjoint(terms(text)):
            return None, 0.0, 0.0
        best: tuple[str | None, float] = (None, 0.0)
        whole, inside = Counter(), 0

        def better(counts: Counter) -> bool:
            nonlocal best
            got = self.unit(counts)
            best = max(best, got, key=lambda b: b[1])
            return got[0] is not None

        blocks = list(blocks_of(text))
        for block in blocks:
            counts, lines = Counter(), 0
            for line in block:
                own = Counter(terms(line))
                counts += own
                if better(own):
                    lines += len(line.split())
            whole += counts
            inside += sum(len(line.split()) for line in block) if len(block) > 1 and better(counts) else lines
        share = 1.0 if len(blocks) > 1 and better(whole) else inside / max(1, len(text.split()))
        return *best, share


def blocks_of(text: str) -> Iterator[list[str]]:
    """Lines of each block: without a blank one between, and all comments or none."""
    block: list[str] = []
    kind = None
    for line in text.split("\n"):
        now = None if not line.strip() else bool(_COMMENT.match(line))
        if block and now is not kind:
            yield block
            block = []
        kind = now
        if now is not None:
            block.append(line)
    if block:
        yield block


def _document_counts(words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for rows in batches:
            for text in rows.column(0).to_pylist():
                n += 1
                df.update(words.intersection(terms(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *df]), pa.array([n, *df.values()], pa.int64())], names=["term", "n"])

    return run


def _finder(matcher: Matcher):
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [matcher.text(t or "") for t in texts]
        return pd.DataFrame({"license": [g[0] for g in got], "score": [g[1] if g[0] else None for g in got], "share": [g[2] for g in got]})

    return run


def scan(files: DataFrame, path: Column, text_col: str = "text", keep: str | None = None, templates: Mapping[str, str | Sequence[str]] | None = None, least: float = 0.75, file_share: float = 0.2) -> DataFrame:
    """``path, license, score, origin, license_dir`` of every row, after the column ``keep`` if one is named.

    ``path`` has its directories before slashes.  ``templates`` has one text or several of each license.  ``origin`` is ``own``, ``inherited`` or ``none``; an
    inherited license comes from ``license_dir``, and ``score`` is that license file's.  Among a
    directory's license files the most similar counts, then the first license by name.  A null or
    empty text has no license of its own; a null path has no directory and inherits nothing.
    Repeated rows are scanned one by one.  An empty table gives an empty result.
    """
    given = {k: [v] if isinstance(v, str) else list(v) for k, v in (templates or default_templates()).items()}
    small_batches(files.sparkSession)
    own = files.select(*([files[keep].alias("kept_id")] if keep else [F.lit(None).alias("kept_id")]), path.alias("path"), files[text_col].cast("string").alias("text"))
    counts = own.select("text").mapInArrow(_document_counts(vocabulary(given)), "term string, n bigint")
    df = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the templates' terms
    matcher = Matcher(given, df, df.pop("", 0), least)
    find = F.pandas_udf(_finder(matcher), "license string, score double, share double")
    hits = cut(own.select("kept_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), find("text").alias("f")).select("kept_id", "path", "dir", "f.*"))
    named = hits.where((F.col("share") >= file_share) | (F.col("license").isNotNull() & F.col("path").rlike(_NAME.pattern)))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license"))
    licensed = named.where("dir <> ''").groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("license_dir"), F.col("b.license").alias("dir_license"), (-F.col("b.minus")).alias("dir_score"))
    # one row for each directory and ancestor, itself included; files join only to their own directory
    parts = F.split("dir", "/")
    up = hits.where("dir <> ''").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("license_dir"))
    nearest = up.join(licensed, "license_dir").groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("n"), "license_dir", "dir_license", "dir_score")).alias("a"))
    out = hits.join(nearest, "dir", "left")
    got, inherits = F.col("license").isNotNull(), F.col("a").isNotNull()
    return out.select(
        *([F.col("kept_id").alias(keep)] if keep else []), "path", F.coalesce("license", "a.dir_license").alias("license"), F.when(got, F.col("score")).otherwise(F.col("a.dir_score")).alias("score"),
        F.when(got, "own").when(inherits, "inherited").otherwise("none").alias("origin"), F.when(~got, F.col("a.license_dir")).alias("license_dir"),
    )
