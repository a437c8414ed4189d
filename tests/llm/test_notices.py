"""Licence notices that no unit of the text is alike as a whole."""

import random
import re

from pyspark.sql import functions as F

from concordat.llm import licenses

from .conftest import CLASHING, rows_of
from .test_texts import duck


def test_embedded_and_wrapped_notices(spark):
    filler = "some words of another matter " * 20
    texts = {
        1: ("Copyright 2024 Acme Inc. All rights reserved.", "all-rights-reserved"),
        2: ("This project is released under the MIT License.", "MIT"),
        3: ("The code in this folder is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        4: (f"{filler}\nbefore it this work is licensed under\nthe GNU General Public\nLicense, version 3. {filler}", "GPL-3.0"),
        5: (f"{filler} This work is licensed under a Creative Commons Attribution 4.0 International License. {filler}", "CC-BY-4.0"),
        6: (f"{filler} the rights of all are reserved", ""),
        7: ("", ""),
        8: (None, ""),
    }
    docs = spark.createDataFrame([(d, text) for d, (text, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in licenses.scan(docs).collect()}
    assert got == {d: (want, int(want != "")) for d, (_, want) in texts.items()}


def plain_scan(text, threshold=0.8):
    """Licences of a text with every window of every length scored, and no bounds."""
    folded = re.sub(r"[^\w\n]+|_+", " ", (text or "").lower())
    one_line = lambda u: re.sub(r" *\n[ \n]*", " ", u).strip(" ")
    units = dict.fromkeys(one_line(u) for u in [folded, *re.split(r"\n *\n[ \n]*", folded), *folded.split("\n")])
    grams = lambda u: [f"{a} {b}" for a, b in zip(u.split(" "), u.split(" ")[1:], strict=False)]
    known = [(name, set(licenses.template_bigrams(t))) for name, t in licenses.TEMPLATES]
    dice = lambda found, own: round(2 * len(set(found) & own) / (len(found) + len(own)), 6)
    best = []
    for u in units:
        score, i = max((dice(grams(u), own), -i) for i, (_, own) in enumerate(known))
        if u and score >= threshold:
            best.append((score, i, known[-i][0]))
    whole, windows = grams(one_line(folded)), []
    for i, (name, own) in enumerate(known):
        at = [p for p, g in enumerate(whole) if g in own]
        windows += [(dice(whole[a : b + 1], own), -i, name, a, b) for a in at for b in at if b >= a and dice(whole[a : b + 1], own) >= threshold]
    clear = [w for w in windows if not any(o[2] != w[2] and o[3] <= w[4] and o[4] >= w[3] and o[:2] > w[:2] for o in windows)]
    added = [w[:3] for w in clear if w[2] not in {b[2] for b in best}]
    every = [*best, *added]
    top = max(every, default=(None, None, None))
    return len([u for u in units if u]), len(best) + len({a[2] for a in added}), top[2], top[0], ",".join(sorted({e[2] for e in every}))


def test_scan_is_brute_force_and_sql(spark):
    rng = random.Random(5)
    texts = ["", None, "the license", "license " * 40, "All rights\n\nreserved. all RIGHTS reserved", "x" * 3_000_000 + " all rights reserved"]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 4, 12])):
                words[rng.randrange(len(words))] = rng.choice(["the", "license", "word", "of"])
            cut = rng.choice([0, 0, 3])
            parts += [" ".join(words[cut:]), rng.choice(["", "some other words here", "and the following conditions"])]
        texts.append(rng.choice([" ", "\n", "\n\n", ". "]).join(parts))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.select("*", *[F.lit(c).alias(c) for c in CLASHING])
    got = rows_of(licenses.scan(docs), "doc_id", "n_units", "n_matches", "license", "score", "licenses")
    assert got == sorted(((i, *plain_scan(t)) for i, t in rows), key=repr)
    assert got == sorted(duck(licenses.scan_sql(), documents=(rows, "doc_id long, text string")).fetchall(), key=repr)
    assert len({r[3] for r in got}) > 12


def test_telling_words_cover_every_template():
    known = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    limits = [licenses.bounds(len(g), 0.8) for g in known]
    chosen = licenses.telling(known, limits)
    for grams, (least, _) in zip(known, limits, strict=True):
        assert sum(g not in chosen and not set(g.split()) & set(chosen) for g in grams) < least
