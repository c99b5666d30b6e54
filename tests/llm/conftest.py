import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and one very long text, ties, copies, clashing extra columns."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    long_text = " ".join(rng.choice(words) for _ in range(60_000))
    odd = [
        (1, None), (2, ""), (3, " \n\t "), (4, passage), (5, "x " + passage + " y"), (6, passage), (7, long_text), (8, long_text[:5000] + "\n" + passage.upper()), (9, "é" * 300 + "日本語 " * 60), (10, "a" * 500),
        (11, "same same same " * 40), (12, "\n".join(["line one", "line two", "line three"] * 5)), (13, "one"), (14, passage[: len(passage) // 2]), (15, "\x00\x0b\x0c weird   space ▁ mark"),
    ]
    return odd


@pytest.fixture(scope="session")
def odd_frame(spark, odd_docs):
    rows = [(i, t, "k", 1, 2, "x") for i, t in odd_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, tl_row_key string, start long, digit int, fp string")


@pytest.fixture(scope="session")
def no_docs(odd_frame):
    return odd_frame.where("false")
