import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside, as further columns of their input.
CLASHING = ["stats", "kept", "base_failed", "uid", "row", "key", "size", "taken", "words", "n_lines", "n_removed", "gone", "digest", "labels", "copies", "s", "label_", "quality"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    rows = [(i, "\n".join([t, sentence(rng, 30), sentence(rng, 25)]), "en", f"src{i % 3}", 0) for i, t in enumerate(base)]
    near = rows[0][1].split(" ")
    near[5] = "changed"
    rows += [
        (20, rows[0][1], "en", "src0", 0),  # an exact copy
        (21, " ".join(near), "en", "src1", 0),  # a near copy
        (22, None, "en", "src1", None), (23, "", None, None, 0), (24, " \n\t\n ", "en", "src2", 0), (25, "one", "en", None, 0),
        (26, "one two three four", "en", "src0", 0), (27, "one two three four", "en", "src0", 0),
        (None, rows[3][1], "en", "src0", 0), (30, rows[4][1], "en", "src2", 0), (30, rows[4][1], "en", "src2", 0),
        (31, "x" * 200_000, "en", "src2", 0), (32, sentence(rng, 20_000), "en", "src1", 0), (33, "é ü 漢字 \U0001f600 " * 30, "fr", "src9", 0),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with further columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
