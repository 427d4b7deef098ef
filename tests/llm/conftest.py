import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parents[2])]

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = [f"alpha{i} beta{i % 7} gamma{i} delta{i % 5} eps{i}" for i in range(40)]
ODD = [
    (None, "a text without an id, and a few words more to read", "en", "s0", 1),
    (90_900, None, "en", "s0", 0),
    (90_901, "", "en", "s0", 0),
    (90_902, "  \n\t\n ", "en", "s0", 5),
    (90_903, "one", "en", "s0", 3),
    (90_904, LONG, "en", "s0", len(LONG)),
    (90_905, "\n".join(BASE), "en", "s0", 1),
    (90_905, "\n".join(BASE), "en", "s0", 1),
    (90_905, "another text under an id that is taken", "en", "s0", 1),
    (90_906, "\n".join(BASE[:38] + ["new words at the end"]), "fr", "s1", 1),
    (90_907, "an own line first\n" + "\n".join(BASE[5:25]) + "\nand one that follows", "fr", "s1", 1),
    (90_908, "two  spaces,\ttab nbsp \x1c odd\n\n\nlines  \n end. It's <|endoftext|> fine", "en", None, 1),
    (90_909, "Ünïcode ÄÖ — 漢字 emoji 🙂 don't 3.14 á naïve, words. ", "de", "s2", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, removed string"
    return spark.createDataFrame([(*r, 0.5, 7, "x") for r in ODD], schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
