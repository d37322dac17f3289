"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directories."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscape.session import cut

#: The first paragraph of the header that the GNU licences ask for.
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."


def _gnu(name: str, version: str) -> list[str]:
    brief = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License, version {version}"
    return [f"This work is licensed under the GNU {name}General Public License, version {version}.", brief, *(_GNU.format(what=what, mark=":", name=name, version=version) for what in ("program", "library"))]


def _cc(short: str, name: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"Licensed under the Creative Commons {name} 4.0 International License.", _CC.format(name)]


#: Notices by licence, in the words that headers and licence files use.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 2-Clause License.",
    ],
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "LGPL-2.1": _gnu("Lesser ", "2.1"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    "AGPL-3.0": _gnu("Affero ", "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without written permission."],
}

_SOFTWARE = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Whole texts of the short licences, for whole licence files.
WHOLE = {
    "MIT": "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": f"{_FORMS} {_SOFTWARE}",
    "BSD-3-Clause": f"{_FORMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_SOFTWARE}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

_TERM = re.compile(r"[a-z0-9][a-z0-9.]*")
_WORD = re.compile(r"\w+")
_TAG = re.compile(r"<[^<>]*>")
#: All other tags stand within a line.
_BLOCK = re.compile(
    r"<(?:!|/?(?:address|article|aside|blockquote|body|br|button|caption|center|d[dlt]|details|dialog|div|fieldset|figcaption|figure|footer|form|h[1-6r]|head|header|html|iframe|legend|li|link|main|meta|nav|noscript|[ou]l|option|p|pre|script|section|select|style|summary|table|tbody|t[dhr]|template|textarea|tfoot|thead|title)\b)[^<>]*>", re.I
)
#: Every clause of a notice has one, so that a notice whose first words are missing is looked at too.
_CUE = re.compile(
    r"licen[sc]|redistribut|permission|public domain|unencumbered|rights reserved|cc0|\bcc by|source code form|free software|free of charge|deal in the software|without restriction|source and binary|with or without|conditions are met|copyright holder|endorse or promote|its contributors"
)


def terms(text: str) -> list[str]:
    """Words and pairs of words, so that "gnu general" and "version 3" weigh as phrases. Hyphens part words, as lines break there."""
    w = [t.strip(".") for t in _TERM.findall(text.lower())]
    w = [t for t in w if t]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


VOCABULARY = sorted({t for name, forms in TEMPLATES.items() for f in [*forms, *([WHOLE[name]] if name in WHOLE else [])] for t in terms(f)})


#: Words of joined lines: the longest notice and half as many again.
WINDOW = max(len(f.split()) for forms in TEMPLATES.values() for f in forms) * 3 // 2


def segments(text: str | None) -> Iterator[str]:
    """The lines of a whole text that hold a licence cue, their sentences, and all runs of lines around them.

    Block tags are line ends, other tags vanish. A run joins two lines, or more while it has
    WINDOW words at most, as notices are wrapped at any width; blank lines don't count."""
    if not text:
        return
    flat = _TAG.sub("", _BLOCK.sub("\n", text))
    low = flat.lower()
    # a cue may be cut by a line end and a comment mark
    if not _CUE.search(low) and not _CUE.search(" ".join(_WORD.findall(low))):
        return
    lines = [x for x in flat.split("\n") if _WORD.search(x)]
    words = [len(_WORD.findall(x)) for x in lines]
    cue = [bool(_CUE.search(x.lower())) for x in lines]
    cut_cue = [bool(_CUE.search(" ".join(_WORD.findall(f"{a} {b}".lower())))) for a, b in zip(lines, lines[1:], strict=False)]
    for i, line in enumerate(lines):
        if cue[i]:
            yield line
            parts = re.split(r"(?<=[a-z0-9)])[.;]\s+(?=[A-Z])", line)
            if len(parts) > 1:
                yield from (p for p in parts if _CUE.search(p.lower()))
        n, some = words[i], cue[i]
        for j in range(i + 1, len(lines)):
            n += words[j]
            some = some or cue[j] or cut_cue[j - 1]
            if j > i + 1 and n > WINDOW:
                break
            if some:
                yield "\n".join(lines[i : j + 1])


#: A licence whose text has all of another's, and more: where both are found, it is this one.
CONTAINS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Licences nearer to each other than this aren't told apart.
MARGIN = 0.001


class Templates:
    """Unit TF-IDF vectors of the templates under one set of document frequencies.

    A term weighs by how few texts have it, and by how few licences: "lesser", "affero" or a
    version tell apart what is otherwise the same text, however common they are in the texts.
    A term outside the vocabulary weighs as if one document had it."""

    def __init__(self, df: dict[str, int], docs: int):
        self.rare = float(np.log((1 + docs) / 2) + 1)
        many = Counter(t for name, forms in TEMPLATES.items() for t in {t for f in [*forms, WHOLE.get(name, "")] for t in terms(f)})
        spread = {t: float(np.log((1 + len(TEMPLATES)) / (1 + n)) + 1) for t, n in many.items()}
        self.idf = {t: float(np.log((1 + docs) / (1 + df.get(t, 0))) + 1) * spread[t] for t in VOCABULARY}
        self.post: dict[str, list[tuple[int, float]]] = {}
        self.names: list[str] = []
        notices = [(name, f) for name, forms in TEMPLATES.items() for f in forms]
        self.notices = len(notices)
        for name, f in [*notices, *WHOLE.items()]:
            v, norm = self.vector(f)
            for t, x in v.items():
                self.post.setdefault(t, []).append((len(self.names), x / norm))
            self.names.append(name)

    def vector(self, text: str) -> tuple[dict[str, float], float]:
        tf: dict[str, int] = {}
        for t in terms(text):
            tf[t] = tf.get(t, 0) + 1
        v = {t: n * self.idf.get(t, self.rare) for t, n in tf.items()}
        return v, float(np.sqrt(sum(x * x for x in v.values())))

    def scores(self, text: str, many: int) -> dict[str, float]:
        """The cosine of each licence: that of its nearest among the first ``many`` templates, by sparse dot products."""
        v, norm = self.vector(text)
        score = np.zeros(len(self.names))
        for t, x in v.items():
            for i, y in self.post.get(t, ()):
                score[i] += x * y
        out: dict[str, float] = {}
        for name, s in zip(self.names[:many], score[:many].tolist(), strict=True) if norm else ():
            if s:
                out[name] = max(out.get(name, 0.0), s / norm)
        return out

    def best(self, text: str | None, file: bool = False, least: float = 0.6) -> tuple[str | None, float]:
        """The licence nearest to any segment of the text; of a licence file, the one nearest to all of it if that is near enough.

        So a licence that begins like a shorter one isn't taken for it. Of licences within
        MARGIN of each other in the same segment none is told, as where a text names a licence
        without its version."""
        if file and text:
            whole = self.scores(_TAG.sub("", _BLOCK.sub("\n", text)), len(self.names))
            name, m = self._told(whole, {})
            if m >= least:
                return name, m
        top: dict[str, float] = {}
        at: tuple[float, dict[str, float]] = (0.0, {})
        for seg in segments(text):
            found = self.scores(seg, self.notices)
            for name, m in found.items():
                top[name] = max(top.get(name, 0.0), m)
            m = max(found.values(), default=0.0)
            if m > at[0] + 1e-12:
                at = (m, found)
        return self._told(at[1], top)

    def _told(self, found: dict[str, float], top: dict[str, float]) -> tuple[str | None, float]:
        """The nearest licence of a segment, given the best of all segments (none, where the segment is the whole text)."""
        if not found:
            return None, 0.0
        m = max(found.values())
        name = min(n for n, x in found.items() if x >= m - 1e-12)
        wider = CONTAINS.get(name)
        if wider and top.get(wider, 0.0) >= 0.9 * m:
            return wider, top[wider]
        rivals = [n for n, x in found.items() if n != name and x >= m - MARGIN and CONTAINS.get(n) != name]
        return (None, m) if rivals else (name, m)


def frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all texts each vocabulary term stands, and the number of texts.

    Tasks count; the driver gets one row for each term of the fixed vocabulary."""

    def count(batches):
        known = set(VOCABULARY)
        sums: dict[str, int] = {}
        for b in batches:
            for t in b["text"]:
                for w in known.intersection(terms(t)) if t else ():
                    sums[w] = sums.get(w, 0) + 1
        yield pd.DataFrame(list(sums.items()), columns=["term", "n"])

    got = files.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in got}, files.where("text IS NOT NULL").count()


def path_of(url: Column) -> Column:
    """host/dir/.../name of a URL without query and fragment; a last slash stands for its directory."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.regexp_replace(bare, r"/+$", "")


LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([-.][^/]*)?$"


def scan(files: DataFrame, least: float = 0.6, any_file: bool = False) -> DataFrame:
    """All columns of ``files`` (path, text, ...) but text, with licence, cosine, inherited and from_dir, which replace columns of these names.

    A file's own licence is that of the nearest template, if any line, sentence or run of
    lines of its whole text has a cosine of at least ``least``; a licence file is compared
    as a whole first. A directory's licence comes from its
    licence files (LICENSE, COPYING, NOTICE, ...), or with ``any_file`` from all its files:
    the most frequent, ties to the first by name. A file without its own licence inherits
    that of its nearest ancestor directory that has one: each path emits one row for each of
    its ancestors, and these join the table of licensed directories. Null paths inherit
    nothing; null and empty texts have no licence; repeated rows stay."""
    df, n = frequencies(files)
    shared = files.sparkSession.sparkContext.broadcast(Templates(df, n))

    @F.pandas_udf("own string, cosine double")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for texts, files_too in batches:
            found = [t.best(x, bool(f), least) for x, f in zip(texts, files_too, strict=True)]
            yield pd.DataFrame({"own": [a if s >= least else None for a, s in found], "cosine": [s for _, s in found]})

    made = ("licence", "cosine", "inherited", "from_dir")
    rest = [c for c in files.columns if c not in ("text", *made)]
    told = files.withColumn("__m", match.asNondeterministic()("text", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))))
    own = cut(told.select(F.struct(*rest).alias("row"), "path", "__m.own", "__m.cosine"), "own")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    source = own.where(F.col("own").isNotNull() & F.col("path").isNotNull())
    source = source if any_file else source.where(F.col("path").rlike(LICENCE_FILE))
    counts = source.groupBy(folder.alias("dir"), "own").count()
    dirs = counts.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("less"), "own"))["own"].alias("dir_own")).withColumn("key", F.xxhash64("dir"))
    # one row per distinct path without a licence and ancestor, so copies of a path join once;
    # ancestors go as hashes, so a deep path doesn't write each of them out
    bare = own.where(F.col("own").isNull() & F.col("path").isNotNull()).select("path").distinct()
    deep = F.size(F.split("path", "/")) - 1
    keys = F.transform(F.sequence(F.lit(1), deep), lambda i: F.xxhash64(F.call_function("substring_index", F.col("path"), F.lit("/"), i)))
    above = bare.where(deep > 0).select(F.xxhash64("path").alias("of"), F.posexplode(keys).alias("depth", "key"))
    near = above.join(dirs, "key").groupBy("of").agg(F.max_by(F.struct("dir_own", "dir"), "depth").alias("up"))
    # all paths lie under the root, so its licence isn't joined: it is one row
    root = dirs.where("dir = ''").agg(F.first(F.struct("dir_own", "dir")).alias("root"))
    out = own.withColumn("of", F.xxhash64("path")).join(near, "of", "left").crossJoin(F.broadcast(root)).withColumn("up", F.coalesce("up", "root"))
    inside = (F.col("up.dir") == "") | F.col("path").startswith(F.concat("up.dir", F.lit("/")))
    takes = F.col("own").isNull() & F.col("path").isNotNull() & F.col("up").isNotNull() & inside
    return out.select("row.*", F.coalesce("own", F.when(takes, F.col("up.dir_own"))).alias("licence"), "cosine", F.coalesce(takes, F.lit(False)).alias("inherited"), F.when(takes, F.col("up.dir")).alias("from_dir"))
