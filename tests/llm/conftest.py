"""Small tables with the awkward rows: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

WORDS = ("river stone market letter window garden winter summer engine doctor village silver copper mountain "
         "bridge candle forest harbour island journey").split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    passage = prose(30, 1)
    rows = [(i, prose(5 + 7 * i, 100 + i)) for i in range(30)]
    rows += [(100, passage + " tail " + prose(20, 2)), (101, prose(12, 3) + " " + passage), (102, passage)]
    rows += [(110, prose(40, 4)), (111, prose(40, 4)), (112, prose(40, 4) + " x")]
    rows += [(120, None), (121, ""), (122, "  \t\n"), (123, "ß"), (124, "日本語テキスト" * 40), (125, "日本語テキスト" * 40)]
    rows += [(130, "aaaa" * 60), (131, "a" * 300), (132, prose(4000, 5)), (132, prose(4000, 5)), (133, "!!! ### 123")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table, with columns that clash with results and helper names."""
    rows = [(i, t, "en", "s", 0, 7, "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, kept string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
