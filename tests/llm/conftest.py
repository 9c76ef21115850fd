import random

import pytest

SCHEMA = "doc_id long, text string, lang string, kept boolean, fp long, row string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def llm(spark):
    from patchcraft.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared passages, nulls, blanks and odd characters; extra columns clash with the operators' names."""
    rng = random.Random(7)
    passage = words(rng, 90)
    texts = [None, None, "", " \t\n", "one", "Two words", "a" * 700, "é" * 150, "xyz " * 120, "İstanbul ﬁ 日本語 x\xa0y\x1cz", "<|endoftext|> it's 12½ \n\n x  y "]
    for _ in range(12):
        t = words(rng, rng.randint(30, 160))
        texts += [t, t]
        texts.append(t.replace(" ", "\n", 3))
        texts.append(words(rng, 40) + " " + passage + " " + words(rng, 20))
        texts.append(t.upper().replace("É", "é"))
    rows = [(i, t, None if i % 9 == 0 else "ab"[i % 2], None, i, "r") for i, t in enumerate(texts)]
    return rows + [rows[15], (None, texts[12], None, True, None, None)]


@pytest.fixture(scope="session")
def docs(llm, corpus):
    return llm.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], SCHEMA)
