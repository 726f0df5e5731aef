"""Small tables with everything odd in them: nulls, empty texts, repeats, ties, extra columns of clashing names."""

import random

import pytest

WORDS = {"en": ["the", "and", "thing", "water", "house", "with", "stone", "over"], "de": ["der", "und", "straße", "über", "wasser", "nicht", "haus", "keit"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n int, label string, cls long, token string, shard string"


def rows_of(texts):
    return [(i, t, lang, source, None if t is None else len(t), 0.5, "x", 7, "y", 1, "z", "w") for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(11)
    out = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        out.append((i, "\n".join(" ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "x", "y"]) for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 4))), lang, f"s{i % 3}"))
    base = " ".join(rng.choice(WORDS["en"]) + str(rng.randint(0, 99)) for _ in range(120))
    words = base.split()
    for i in range(120, 150):  # near copies: one or two words changed
        w = list(words)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
        out.append((i, " ".join(w), "en", "s0"))
    out += [(150 + k, t, lang, source) for k, (t, lang, source) in enumerate([(None, "en", "s0"), ("", None, None), (" \t\n", "en", None), ("one", None, "s1"), ("one two", "de", "s1"), ("12 34 !!", "en", "s2")])]
    out += [(160, out[5][1], "en", "s9"), (161, out[5][1].replace(" ", "  "), "en", "s9"), (162, out[7][1].upper(), "en", "s1")]
    out += [(170, " ".join(f"long{j % 977}" for j in range(20_000)), "en", "s1"), (171, "x" * 50_000, "en", "s1"), (5, out[5][1], out[5][2], out[5][3])]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nameless(spark, texts):
    """Rows without doc_id among others: equal and near-equal texts, other texts, no text; and one doc_id with two texts."""
    near = texts[120][1]
    rows = [(None, near, "en", "s0"), (None, near, "en", "s0"), (None, near + " more", None, None), (7, near + " else", "en", "s1"), (None, texts[3][1], "en", "s0"), (None, None, None, None), (None, "", "de", "s1")]
    rows += [(9, texts[4][1], "en", "s0"), (9, texts[9][1], "en", "s0"), (3, texts[9][1] + " tail", "en", "s2"), (None, texts[20][1], "de", "s2")]
    return rows, spark.createDataFrame(rows_of(rows), SCHEMA).repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
