import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of an input that carry the names which operators use inside.
CLASHING = ["row", "rank", "position", "stream", "block", "slot", "a", "b", "key", "fp", "fingerprint", "component_id", "kept", "gone", "lines", "pos", "mark", "score", "ids", "units", "form", "range", "guest", "next_text", "_order", "_hash", "g_id", "q", "v", "m"]


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "Zeta", "éta", "ﬁn", "x"]) + rng.choice(["", "", "s", ","]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, blank and long texts, repeated rows, copies, near copies, shared lines and passages."""
    rng = random.Random(7)
    shared = " ".join(words(rng, 40))
    rows = []
    for i in range(160):
        lines = [" ".join(words(rng, rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "  Common LINE \t")
        if i % 4 == 0:
            lines.append(shared[rng.randint(0, 30) :])
        if i % 17 == 0:
            lines.append("Licensed under the Apache License, Version 2.0.")
        rows.append((i * 3 + 1, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", "odd", None]), None))
    base = rows[5][1]
    rows += [(500 + i, base, "en", "src0", 1) for i in range(12)]  # copies
    rows += [(600 + i, base + " tail" * (i % 3), "en", "src0", 1) for i in range(6)]
    rows += [rows[3], rows[3], (None, base, None, None, None), (None, None, None, None, None), (701, None, None, "src1", 0), (702, "", "en", None, 0), (703, " \t\n ", None, "src0", 3), (704, "one", "fr", "src2", 3)]
    rows += [(10, "same id, other text " + shared, "en", "src3", 9), (705, "ab " * 4000 + shared, "en", "src0", None), (706, "\n" * 30, None, "src0", 30), (707, "a\\b <s>[INST] </s> ▁▁  x  " + "日本語テキスト" * 9, "en", "src0", 5), (-5, "Straße ＦＵＬＬ width", "de", "src0", 2), (-6, "strasse full WIDTH", "de", "src0", 2)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5, "n_chars", "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The corpus with extra columns whose names clash."""
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASHING])


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=repr)
