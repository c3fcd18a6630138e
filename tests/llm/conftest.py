import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, content string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["than", "er", "ou", "st", "ing", "de", "la", "tion", "é", "ü", "ñ", "ha", "re", "on"]
    out = []
    for i in range(words):
        out.append("".join(rng.choices(syllables, k=rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]))
        if i % 17 == 16:
            out.append("\n" + str(rng.randint(0, 9)))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        base, base, base, near, near + " tail", prose(2, 300), None, "", "   \n\t ", "one", "one two", "ONE two", "one two three four five",
        prose(3, 30_000), "x" * 20_000, "spam line here\n" * 60, "<|endoftext|> odd\x1c \x85 text\xa0日本語 😀 Ǆ", prose(2, 300).upper(),
        "and\n\nand\n" + prose(4, 80), "#### $$$ %%% &&& ||| <<< >>> " * 30,
    ]
    rows = [(i * 3 + 1, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t or ""), i, "c") for i, t in enumerate(texts)]
    rows.append(rows[5])                                                # a repeated row
    rows.append((None, prose(5, 60), None, None, None, None, None))     # nulls in every other column
    rows.append((None, base, "en", None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
