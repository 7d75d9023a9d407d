import math
import re
from collections import Counter

from lumentrace.llm import licenses as L


def brute_best(text, weights):
    best = None
    for line in (text or "").split("\n"):
        found = Counter(re.findall(L.TERM, line.lower()))
        vector = {t: found[t] * w for t, w in weights.items() if found[t]}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        for name, counts in L.template_counts():
            other = {t: c * weights[t] for t, c in counts.items()}
            cos = sum(vector.get(t, 0) * v for t, v in other.items()) / (norm or 1) / math.sqrt(sum(v * v for v in other.values()))
            best = max(best or (0.0, ""), (round(cos, 6), name))
    return best if best and best[0] >= L.LEAST_COSINE else None


def brute_weights(texts):
    sets = [set(re.findall(L.TERM, (t or "").lower())) for t in texts]
    return {t: math.log((len(sets) + 1) / (sum(t in s for s in sets) + 1)) + 1 for _, c in L.template_counts() for t in c}


FILES = [
    (1, "/a/LICENSE", "Released under the MIT License."),
    (2, "/a/x.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    (3, "/a/b/y.py", "print(1)"), (4, "/a/b/c/z.py", None),
    (5, "/a/b/c/COPYING.txt", "intro\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
    (6, "/d/e/f.py", "nothing here"), (7, "/d/e/LICENSE", "no licence in the licence file"),
    (8, None, "Licensed under CC BY-NC 4.0."), (9, "/a/b/y.py", "print(1)"), (10, "/a", "x"), (11, "/ab/x", "x"), (12, "", ""),
    (13, "/a/b/c/NOTICE", "SPDX-License-Identifier: MIT"),
    (14, "/long/file", "pad " * 30_000 + "\nRELEASED under the mit license\n" + "pad " * 30_000),
]


def test_files(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").repartition(3)
    weights = brute_weights([t for *_, t in FILES])
    assert L.weights_of(df) == weights
    own = {d: brute_best(t, weights) for d, _, t in FILES}
    giving = {}
    for d, p, _ in FILES:
        if p and own[d] and re.match(L.LICENSE_FILE, p.rsplit("/", 1)[-1]):
            folder = p.rsplit("/", 1)[0]
            giving[folder] = max(giving.get(folder, (0.0, "")), own[d])
    got = {r["doc_id"]: r for r in L.licenses(df).collect()}
    assert len(got) == len(FILES)
    for d, p, _ in FILES:
        assert (got[d]["own_license"], got[d]["cosine"]) == ((own[d][1], own[d][0]) if own[d] else (None, None)), d
        up = p.rsplit("/", 1)[0] if p and "/" in p else None
        while up is not None and up not in giving:
            up = up.rsplit("/", 1)[0] if "/" in up else None
        if own[d]:
            assert got[d]["license"] == own[d][1] and got[d]["inherited_from"] is None
        else:
            assert (got[d]["license"], got[d]["inherited_from"]) == ((giving[up][1], up) if up is not None else (None, None)), d
    assert got[3]["license"] == "MIT" and got[4]["license"] == "MIT" and got[14]["own_license"] == "MIT"


def test_documents(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    weights = brute_weights(texts.values())
    rows = L.licenses(L.as_files(documents)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_best(texts[r["doc_id"]], weights)
        assert (r["own_license"], r["cosine"]) == ((want[1], want[0]) if want else (None, None))
    assert any(r["own_license"] for r in rows)


def test_anchors_are_needed():
    weights = brute_weights(["the license of the software", "under the terms"])
    anchors = set(L.anchors(weights))
    for _, counts in L.template_counts():
        rest = sum((c * weights[t]) ** 2 for t, c in counts.items() if t not in anchors)
        assert math.sqrt(rest / sum((c * weights[t]) ** 2 for t, c in counts.items())) < L.LEAST_COSINE


def test_odd_rows(odd, nothing):
    assert L.licenses(L.as_files(odd)).count() == odd.count()
    assert L.licenses(L.as_files(nothing)).count() == 0
    plan = L.licenses(L.as_files(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def full_best(units, texts, templates=None):
    """Cosine with all terms of a unit in its norm, idf over all texts."""
    sets = [set(re.findall(L.TERM, (t or "").lower())) for t in texts]
    idf = lambda t: math.log((len(sets) + 1) / (sum(t in s for s in sets) + 1)) + 1
    best = (0.0, "")
    for unit in units:
        x = {t: c * idf(t) for t, c in Counter(re.findall(L.TERM, unit.lower())).items()}
        for name, counts in templates or L.template_counts():
            y = {t: c * idf(t) for t, c in counts.items()}
            norms = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            best = max(best, (round(sum(v * y.get(t, 0) for t, v in x.items()) / (norms or 1), 6), name))
    return best if best[0] >= L.LEAST_COSINE else None


CLEAN = [
    "A colleague at MIT released her driving license photos yesterday, while nobody under contract complained about anything",
    "The Apache helicopter flew under the clouds, a licensed pilot said; manual version 2.0 lay beside a license plate",
    "SPDX-License-Identifier: LGPL-2.1-only",
]


def test_all_terms_are_in_the_norm(spark):
    texts = [*CLEAN, "SPDX-License-Identifier: MIT and a text", "x\nSPDX-License-Identifier: MIT\ny", *[f"word{i} and the other words of a text" for i in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "concat('/f/', doc_id) AS path", "text")
    got = {r["doc_id"]: r for r in L.licenses(df).collect()}
    for d, text in enumerate(texts):
        want = full_best(text.split("\n"), texts)
        assert (got[d]["own_license"], got[d]["cosine"]) == ((want[1], want[0]) if want else (None, None)), text
    weights = brute_weights(texts)
    assert all(brute_best(t, weights) for t in CLEAN[:2]) and not any(got[d]["own_license"] for d in (0, 1)) and got[2]["own_license"] in (None, "LGPL-2.1")
    assert got[3]["own_license"] == got[4]["own_license"] == "MIT" and got[3]["cosine"] < 1


GPL = "This program is free software: you can redistribute it and/or modify\n{0}it under the terms of the GNU General Public License as published by\n{0}the Free Software Foundation, either version 3 of the License, or\n{0}(at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\n{0}modification, are permitted provided that the following conditions are met:"
PROSE = "the cat and the dog of the house are in the garden of an old man, and this is all that they have to say to it. "


def test_wrapped_notices_and_licence_files(spark):
    bodies = {name: text for name, text in L.BODIES}
    held = {
        "/a/gpl.py": ("# " + GPL.format("# ") + "\nimport os", "GPL-3.0"), "/a/gpl.c": ("/* " + GPL.format(" * ") + " */\nint x;", "GPL-3.0"),
        "/a/gpl.m4": ("dnl " + GPL.format("dnl "), "GPL-3.0"), "/a/gpl2.c": ("// " + GPL.format("// ").replace("version 3", "version 2"), "GPL-2.0"),
        "/a/lgpl.c": ("// " + GPL.format("// ").replace("GNU General", "GNU Lesser General").replace("program", "library"), "LGPL-3.0"),
        "/a/bsd.c": ("// " + BSD.format("// "), "BSD-3-Clause"), "/a/long.txt": (PROSE * 40 + GPL.format("").replace("\n", " ") + " " + PROSE * 40, "GPL-3.0"),
        "/a/short.txt": (PROSE * 3 + "Licensed under the Apache License, Version 2.0. " + PROSE * 3, "Apache-2.0"),
        "/mit/LICENSE": ("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + bodies["MIT"].replace(", ", ",\n"), "MIT"),
        "/bsd2/LICENSE.txt": ("Copyright (c) 2020, A. Person\n" + bodies["BSD-2-Clause"].replace(", ", ",\n"), "BSD-2-Clause"),
        "/bsd3/COPYING": ("Copyright (c) 2020, A. Person\n" + bodies["BSD-3-Clause"].replace(", ", ",\n"), "BSD-3-Clause"),
        "/gnu/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n" + PROSE * 20, "GPL-3.0"),
        "/title/LICENSE": ("MIT License\n\n" + PROSE, "MIT"), "/c/README": (PROSE + "the MIT license is popular", None), "/b/clean": (PROSE, None),
        "/mit/src/x.c": ("int main", "MIT"), "/b/x": ("// SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), "/b/other": ("SPDX-License-Identifier: EUPL-1.2", None),
    }
    rows = [(i, p, t) for i, (p, (t, _)) in enumerate(held.items())] + [(1000 + i, f"/p/{i}", PROSE + f"nr {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)
    got = {r["path"]: r for r in L.licenses(df).collect()}
    assert {p: got[p]["license"] for p in held} == {p: want for p, (_, want) in held.items()}
    assert got["/a/long.txt"]["cosine"] == 1.0 and got["/mit/src/x.c"]["inherited_from"] == "/mit" and not any(got[f"/p/{i}"]["license"] for i in range(200))
