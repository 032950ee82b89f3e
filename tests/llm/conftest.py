import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, block int, fp long, size int, uid int, digest string"


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    prose = " ".join(f"word{i % 97}x{i * 7 % 1013}" for i in range(300))
    texts = [
        None, "", " \t\n ", "one", "one two three", prose, prose, prose + " tail", prose.replace("word5x", "Word5X"),
        "a b c d e f g h " * 40, "line one is here\n" * 30, "x" * 30_000, "Ünï cödé 数据 \U0001f600 données " * 30,
        "mail me.now@ex-ample.co.uk or 10.0.0.256 and 192.168.1.1 card 4111 1111 1111 1111 tel +49 (30) 123-45 67.",
        "a@b.c" + ".d" * 3000 + " " + "1" * 5000 + " a@b.com_x@y.zz +1.2.3.4.5.6.7.8", prose[::-1], "  lead\n trail    x　y ",
        "released under the MIT license, Apache License, Version 2.0 or CC-BY-NC", "Under the mit\nlicense under the mit license",
    ]
    rows = [(i, t, "en" if i % 3 else None, "a" if i % 2 else None, None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, "z", "z", 1, 1, 1, 1, "z") for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, odd_rows):
    """Repeated rows, null ids, one id with two texts."""
    rows = odd_rows[:8] + odd_rows[4:8] + [(None, "text without an id", None, None, None)] * 2 + [(5, "other text of id five", "en", "a", 1)]
    return spark.createDataFrame([(*r, "z", "z", 1, 1, 1, 1, "z") for r in rows], SCHEMA)
