import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, clashing extra columns."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    long = " ".join(rnd.choice(vocab) for _ in range(40_000))
    base = " ".join(rnd.choice(vocab) for _ in range(80))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, long, "en", "b", len(long)),
        (5, base, "en", "b", len(base)),
        (6, base, "en", "b", len(base)),
        (7, base + " " + vocab[0], "fr", None, None),
        (8, "one two", "en", "c", 7),
        (8, "one two", "en", "c", 7),
        (9, "ONE TWO", "en", "c", 7),
        (None, base, "en", "c", 3),
        (None, None, None, None, None),
        (10, "#" * 5000, "xx", "c", 5000),
        (11, "12345 67890", "en", "c", 11),
    ]
    more = "score double, spans string, epoch int, block string, label int, rest int, sk string, ids string, kept boolean, node int, band int, doc int, lo int, key string"
    extra = (0.5, "s", 1, "b", 1, 2, "k", "i", True, 1, 2, 3, 4, "x")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{DOCS}, {more}")


@pytest.fixture(scope="session")
def prose():
    """About sixty texts with exact copies, edited copies and shared passages."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(15, 120))) for _ in range(30)]
    passage = " ".join(rnd.choice(vocab) for _ in range(25))
    for i in range(10):
        w = texts[i].split()
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += texts[:5]
    texts += [texts[12] + " " + passage, passage + " " + texts[13], passage, texts[14][:60] + passage + texts[14][60:]]
    texts += ["", "short", "ÄÖ " * 40, "ab" * 300, "ab" * 300 + "c"]
    rnd.shuffle(texts)
    return list(enumerate(texts))
