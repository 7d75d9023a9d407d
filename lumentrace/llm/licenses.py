"""Licence scans: TF-IDF cosine of lines, word windows and licence files to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions.arrays import let
from lumentrace.llm.common import join_facts, text_or_empty, written

# Notices by which licences ask to be named, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    # Titles of licence files.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # Notices of licences that differ from one above in a word or two, so that the nearest one is theirs.
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole licences, for licence files. The long ones (Apache, GNU, MPL, CC) hold their title and most their notice, which windows find.
BODIES = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
     "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
#: What a unit is, and so what it is compared with: a line with all templates, a window with those that stand in running text, a licence file with whole licences.
LINE, WINDOW, WHOLE = 0, 1, 2
#: Least cosine of a line and its template.
LEAST_COSINE = 0.8
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
#: Words that some languages begin a comment line with.
COMMENT = r"(?im)^[ \t]*(?:rem|dnl)[ \t]"
LICENSE_FILE = r"(?i)^(license|licence|copying|notice|unlicense)([.-].*)?$"
#: The same for a path.
FILE_NAME = r"(?i)(?:^|/)(license|licence|copying|notice|unlicense)([.-][^/]*)?$"


def terms(text: Column) -> Column:
    """Words and version numbers, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def template_counts() -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(TERM, text.lower()))) for name, text in TEMPLATES]


def compared() -> list[tuple[int, str, list[str]]]:
    """(kind of unit, license, terms in order) of all that units are compared with.

    A window may end within a line, so it does not see what follows an SPDX tag or a title of few words: these are lines of their own.
    """
    out = [(WHOLE, name, re.findall(TERM, text.lower())) for name, text in BODIES]
    for name, text in TEMPLATES:
        found = re.findall(TERM, text.lower())
        out += [(k, name, found) for k in ((LINE, WINDOW) if len(found) > 4 and found[0] != "spdx" else (LINE,))]
    return out


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the rows that have each term, over all terms; the empty term counts all rows."""
    found = F.concat(F.array(F.lit("")), F.array_distinct(terms(text_or_empty(text))))
    return docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def inverse(rows: int, n: int) -> float:
    return math.log((rows + 1) / (n + 1)) + 1


def weights_of(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template term, counted over all rows."""
    return weights_in(frequencies(docs, text), {t for _, c in template_counts() for t in c})[0]


def weights_in(counted: DataFrame, vocabulary: Collection[str]) -> tuple[dict[str, float], int]:
    """Weights of a fixed list of terms from :func:`frequencies`, and the rows. Only their counts reach the driver."""
    counts = {r["term"]: r["n"] for r in counted.filter(F.col("term").isin(["", *sorted(vocabulary)])).collect()}
    rows = counts.get("", 0)
    return {t: inverse(rows, counts.get(t, 0)) for t in sorted(vocabulary)}, rows


def anchors_of(counts: Counter, weights: dict[str, float], least: float) -> set[str]:
    out = set()
    squares = sorted(((c * weights[t]) ** 2, t) for t, c in counts.items())
    total, rest = sum(s for s, _ in squares), 0.0
    for square, term in squares:
        rest += square
        if math.sqrt(rest / total) >= least - 1e-9:
            out.add(term)
    return out


def anchors(weights: dict[str, float], least: float = LEAST_COSINE) -> list[str]:
    """Terms of which a line must have one to reach the cosine with any template.

    A line without the heaviest terms of a template reaches at most the length of the rest of its vector.
    """
    return sorted(set().union(*(anchors_of(counts, weights, least) for _, counts in template_counts())))


def shares(found: Sequence[str], weights: dict[str, float]) -> list[tuple[str, float]]:
    """(term, its part of the squared norm) of a template."""
    squares = {t: (c * weights[t]) ** 2 for t, c in Counter(found).items()}
    return [(t, s / sum(squares.values())) for t, s in sorted(squares.items())]


def reaches(unit: Column, parts: Column, least: float) -> Column:
    """Whether terms can have the cosine: it is at most the length of the template's vector over the terms that both have."""
    part = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.when(F.array_contains(unit, p["t"]), p["s"]).otherwise(0.0))
    return part >= least * least - 1e-9


def windows(found: Column, weights: dict[str, float], least: float) -> Column:
    """Stretches of terms as long as a template, wherever one of its anchors stands as it does in the template; lines do not matter."""
    models, marks = [], set()
    for kind, _, words in compared():
        if kind == WINDOW:
            heavy = anchors_of(Counter(words), weights, least)
            marks |= heavy
            models.append(F.struct(
                F.lit(len(words)).alias("n"),
                F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for q, t in enumerate(words) if t in heavy]).alias("at"),
                F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("s")) for t, x in shares(words, weights)]).alias("parts"),
            ))

    def of(ts: Column) -> Column:
        marked = F.filter(F.transform(ts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda m: m["t"].isin(sorted(marks)))

        def against(here: Column) -> Column:
            starts = lambda m: F.array_distinct(F.flatten(F.transform(here, lambda x: F.transform(
                F.filter(m["at"], lambda a: a["t"] == x["t"]), lambda a: F.greatest(x["i"] - a["q"], F.lit(0))))))
            return F.flatten(F.transform(F.array(*models), lambda m: F.filter(
                F.transform(starts(m), lambda i: F.slice(ts, i + 1, m["n"])), lambda w: reaches(w, m["parts"], least))))

        return let(marked, against)

    return F.transform(let(found, of), lambda w: F.array_join(w, " "))


def nearest(line: Column, weights: dict[str, float]) -> Column:
    """The highest cosine that a line can have with a template: a term outside the templates weighs 1 there, its least."""
    vocabulary = sorted(weights)
    place = {t: i for i, t in enumerate(vocabulary)}
    vectors = []
    for _, counts in template_counts():
        norm = math.sqrt(sum((c * weights[t]) ** 2 for t, c in counts.items()))
        vectors.append(F.array(*[F.struct(F.lit(place[t]).alias("i"), F.lit(c * weights[t] / norm).alias("w")) for t, c in sorted(counts.items())]))
    idf = F.lit([weights[t] for t in vocabulary])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def of(found: Column) -> Column:
        counts = F.transform(F.lit(vocabulary), lambda t, i: F.size(F.filter(found, lambda x: x == t)) * F.get(idf, i))
        others = F.size(F.filter(found, lambda x: ~F.array_contains(F.lit(vocabulary), x)))

        def against(vector: Column) -> Column:
            norm = F.sqrt(total(F.transform(vector, lambda v: v * v)) + others)
            return F.array_max(F.transform(F.array(*vectors), lambda m: F.coalesce(
                F.try_divide(total(F.transform(m, lambda p: p["w"] * F.get(vector, p["i"]))), norm), F.lit(0.0)
            )))

        return let(counts, against)

    return let(terms(line), of)


def scored(units: DataFrame, counted: DataFrame, rows: int, weights: dict[str, float], least: float) -> DataFrame:
    """(kind, unit, own) of the template nearest to each distinct unit, the last name among equals; none below ``least``.

    All terms of a unit are in its norm, by their frequency over all documents. Sums are decimals, so they do not
    depend on their order.
    """
    spark = units.sparkSession
    each = written(units.select("kind", "unit").distinct().withColumn("uid", F.monotonically_increasing_id()), "units")
    found = each.select("uid", "kind", F.explode(terms(F.col("unit"))).alias("term")).groupBy("uid", "kind", "term").agg(F.count(F.lit(1)).alias("c"))
    found = written(found, "unitterms")
    needed = written(counted.join(found.select("term").distinct(), "term", "left_semi"), "frequencies")
    idf = F.log((F.lit(rows) + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1
    weighed = join_facts(found, needed, needed.count(), ["term"]).select("uid", "kind", "term", (F.col("c") * idf).alias("w"))
    exact = lambda x: F.sum(x.cast("decimal(28,12)")).cast("double")
    norms = weighed.groupBy("uid").agg(exact(F.col("w") * F.col("w")).alias("square"))
    lines = []
    for k, (kind, name, words) in enumerate(compared()):
        counts = Counter(words)
        norm = math.sqrt(sum((c * weights[t]) ** 2 for t, c in counts.items()))
        lines += [(kind, t, k, name, c * weights[t] / norm) for t, c in counts.items()]
    table = spark.createDataFrame(lines, "kind int, term string, k int, license string, tw double")
    dots = weighed.join(F.broadcast(table), ["kind", "term"]).groupBy("uid", "k", "license").agg(exact(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / F.sqrt("square"), 6)
    best = dots.join(norms, "uid").groupBy("uid").agg(F.max(F.struct(cosine.alias("cosine"), "license")).alias("own")).filter(F.col("own.cosine") >= least)
    return each.join(best, "uid").select("kind", "unit", "own")


def own_licenses(files: DataFrame, text: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """All columns of ``files`` (with a path) but the text, and ``__own`` (cosine, license) of the best unit, null below ``least``.

    Units are lines, windows of words over the whole text, and the whole text of a licence file; a file that is a whole
    licence is that one, whatever it quotes. Units that an upper bound keeps below ``least`` go no further; each other
    one is weighed once, however many rows have it.
    """
    counted = written(frequencies(files, text), "terms")
    weights, rows = weights_in(counted, {t for _, _, words in compared() for t in words})
    of_lines = {t: weights[t] for _, c in template_counts() for t in c}
    wanted = r"\b(?:" + "|".join(re.escape(a) for a in anchors(of_lines, least)) + r")\b"
    full = text_or_empty(text)
    lines = F.filter(F.split(full, "\n"), lambda x: F.lower(x).rlike(wanted))
    near = F.transform(F.filter(lines, lambda x: nearest(x, of_lines) >= least - 1e-6), lambda x: F.array_join(terms(x), " "))
    running = F.when(F.lower(full).rlike(wanted), windows(terms(F.regexp_replace(full, COMMENT, "")), weights, least))
    bodies = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("s")) for t, x in shares(words, weights)]) for k, _, words in compared() if k == WHOLE])
    whole = F.when(F.col("path").rlike(FILE_NAME), F.transform(F.filter(
        F.array(terms(full)), lambda ts: F.exists(bodies, lambda parts: reaches(ts, parts, least))), lambda ts: F.array_join(ts, " ")))
    none = F.array().cast("array<string>")
    of_kind = lambda kind, found: F.transform(F.array_distinct(F.coalesce(found, none)), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))
    kinds = [of_kind(LINE, near), of_kind(WINDOW, running), of_kind(WHOLE, whole)]
    kept = written(files.withColumn("__units", F.concat(*kinds)).drop(text).withColumn("__rid", F.monotonically_increasing_id()), "near")
    of = kept.select("__rid", F.explode("__units").alias("u")).select("__rid", "u.*")
    best = written(scored(of, counted, rows, weights, least), "scored")
    ranked = F.max(F.struct((F.col("kind") == WHOLE).alias("whole"), "own"))["own"]
    own = join_facts(of, best, best.count(), ["kind", "unit"], "inner").groupBy("__rid").agg(ranked.alias("__own"))
    return kept.drop("__units").join(own, "__rid", "left").drop("__rid")


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def inherited(found: DataFrame, path: str = "path") -> DataFrame:
    """Add ``__from``: the directory whose licence file a file without a licence of its own inherits, and ``__given``.

    The nearest directory at or above the file with a licence file that has a licence decides; of several
    such files in a directory the best match does, then the last name. Directories are resolved once each,
    and then joined to their files. A null path has no directory.
    """
    rows = found.withColumn("__dir", directory_of(F.col(path)))
    named = F.regexp_extract(F.col(path), r"([^/]*)$", 1).rlike(LICENSE_FILE)
    giving = written(rows.filter(named & F.isnotnull("__own")).groupBy("__dir").agg(F.max("__own")["license"].alias("__given")), "licences")
    dirs = rows.filter(F.isnotnull("__dir")).select("__dir").distinct()
    parts = F.split(F.col("__dir"), "/")
    above = dirs.select("__dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up"))
    )).alias("a")).select("__dir", "a.depth", F.col("a.up").alias("__up"))
    nearest = join_facts(above, giving.withColumnRenamed("__dir", "__up"), giving.count(), ["__up"], "inner")
    chosen = written(
        nearest.groupBy("__dir").agg(F.max(F.struct("depth", F.col("__up").alias("up"), F.col("__given").alias("given"))).alias("c"))
        .select("__dir", F.col("c.up").alias("__from"), F.col("c.given").alias("__given")), "inherited",
    )
    return join_facts(rows, chosen, chosen.count(), ["__dir"]).drop("__dir")


def licenses(files: DataFrame) -> DataFrame:
    """doc_id, path, own_license, cosine, license and inherited_from of rows (doc_id, path, text).

    Null or empty text has no licence of its own and may inherit one. Rows are scanned one by one, repeated
    rows alike; an empty table gives an empty result; other columns are not read.
    """
    own = written(own_licenses(files.select("doc_id", "path", "text")), "own")
    found = inherited(own)
    mine = F.col("__own.license")
    return found.select(
        "doc_id", "path", mine.alias("own_license"), F.col("__own.cosine").alias("cosine"),
        F.coalesce(mine, "__given").alias("license"), F.when(F.isnull(mine), F.col("__from")).alias("inherited_from"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, language, and directories of a thousand and a hundred ids; the first
    file of a directory is its LICENSE."""
    n = F.coalesce("doc_id", F.lit(-1))
    thousand, hundred = F.floor(n / 1000).cast("string"), F.floor(n / 100).cast("string")
    top = [F.lit(""), F.coalesce("source", F.lit("none")), thousand]
    deep = F.concat_ws("/", *top, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(n % 1000 == 0, F.concat_ws("/", *top, F.lit("LICENSE"))).when(
        n % 100 == 0, F.concat_ws("/", *top, hundred, F.lit("LICENSE"))
    ).otherwise(deep)
    return docs.select("doc_id", path.alias("path"), "text")
