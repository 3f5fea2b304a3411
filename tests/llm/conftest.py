import random

import pytest

WORDS = ["stone", "river", "Über", "don't", "42", "lamp", "quiet", "blue,", "walk.", "naïve", "x", "éclair", "the", "of", "中文", "🙂", "A-B", "password=hunter22", "a" * 30]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source, n_chars): nulls, empty, blank, very long and repeated texts and rows."""
    rng = random.Random(7)
    texts = [None, "", "   ", "\t\n\x0b\x0c\r", "one", "One two three", "\x1c\x1d a\x1eb\x1f", "\xa0x y", "İSTANBUL ΣΑΣ ǅ", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "é ȫ", "z" * 5_000, sentence(rng, 20_000)]
    texts += [sentence(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts += [texts[20]] * 5 + [texts[20] + " more"] * 3
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "é", None]), len(t) if t is not None and i % 3 else None) for i, t in enumerate(texts)]
    return rows + rows[14:18] + [(None, "no id", "en", "s1", 5), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
