import random

import pytest

EXTRA = ("host", "score", "rank", "fp", "row", "term", "n", "c", "k", "key", "bucket", "tie", "size", "copies", "kept", "rate", "target", "c0", "c1", "__id", "items", "hits", "entity")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgäé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus():
    """Small rows with every awkward case: nulls, empties, copies, repeats, a long text and hot values."""
    rng = random.Random(5)
    shared = sentence(rng, 60)
    texts = [None, "", " \n\t", "One", "one two", shared, shared, shared + " tail words here", "start " + shared, "password = hunter2secret " + shared]
    texts += [sentence(rng, rng.randint(3, 90)) + (". " + shared if i % 4 == 0 else "") for i in range(30)]
    texts += ["word " * 70, sentence(rng, 9000), "mail bob@site.example.com or call +1 (212) 555-0199 from 10.0.0.1", "#$% " * 60, "ÄÖ ü 中文 😀 " * 20]
    rows = [(i, t, "en", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    return [(*r, *["x"] * len(EXTRA)) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
