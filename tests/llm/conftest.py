import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, row int, start long, shard string, component_id string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abdeghilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    rng = random.Random(3)
    passage, line = sentence(rng, 70), "the same line again and again\n"
    base = sentence(rng, 120)
    out = [(0, base, "a"), (1, None, "b"), (2, "", None), (3, "   \n\t ", "a"), (4, "one two", "é"), (5, "ONE two", "Z"), (6, "one  two three four", "a")]
    for i in range(7, 20):
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        out.append((i, " ".join(words), rng.choice("abc")))
    for i in range(20, 32):
        out.append((i, sentence(rng, rng.randint(1, 90)) + " " + passage + "  " + sentence(rng, 20), "b"))
    out += [(32, line * 40, "c"), (33, line * 60, "c"), (34, "é" * 30 + "ü " * 40, "a"), (35, "é" * 29 + "ü " * 40, "a"), (36, "x" * 49, "b"), (37, "x" * 50, "b"), (38, "x" * 120, "b")]
    out += [(39, sentence(rng, 9000), "a"), (40, sentence(rng, 3) + passage.upper(), None), (41, "<|endoftext|> a\x00b \U0001f600", "b")]
    out += [(None, base, "a"), (None, sentence(rng, 30), None), (10, out[10][1], out[10][2]), (10, "another text of the same id " + sentence(rng, 60), "a")]
    out += [(i, sentence(rng, rng.randint(1, 200)), rng.choice("abcd")) for i in range(50, 90)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 0.5, "x", 1, 7, "s", "c") for d, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
