import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node int, at string, t int, g string, key string, score string, m string"


def made_texts(seed=5, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["ra", "to", "li", "né", "ß", "ka", "un", "de"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 220))) for _ in range(n)]
    shared = " ".join(rnd.choice(vocab) for _ in range(120))
    for i in range(0, n, 6):
        words = texts[i].split(" ")
        near = words[:]
        near[len(near) // 2] = "anders"
        texts += [texts[i], " ".join(near), texts[i][:40] + " " + shared + " " + texts[i][-40:]]
    return texts


def edge_rows():
    texts = [
        None, "", " ", "\n\t\x0b", "a", "A b", "one two three", "x " * 3000, "y" * 5000, "Ünïcödé <|endoftext|> «ok»\r\n", "12 34 #*$ %&|<>",
        "\x1c \x85\xa0", "日本語 テキスト", "same line\nsame line\n\nsame line", " lead  and trail ", "'s it's we'll", "▁x ▁▁", "😀😀", "\x00nul",
    ]
    return texts


@pytest.fixture(scope="package")
def docs(spark):
    """Made texts with copies and near copies, edge cases, a null id, repeated rows and clashing columns."""
    texts = made_texts() + edge_rows()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[0]), (None, "only here"), (7, "other text of id seven")]
    full = [(i, t, ["en", "fr", None][k % 3], "s", 1, 1, "a", 2, "g", "k", "s", "m") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="package")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
