import datetime

import pytest

#: documents with columns whose names the operators use inside, nulls everywhere, repeated rows and ids beyond 2**53.
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, mark int, t string, row int, _a int, a int, k string, node string, s date"


@pytest.fixture(scope="session")
def odd(spark):
    more = ("x", 1, "y", 1, 1, 1, "z", "n", datetime.date(2020, 1, 1))
    rows = [
        (None, None, None, None, None, *more),
        (1, "", None, "s", 0, *more),
        (2, "hello world a b c d", "en", "s", 5, *more),
        (2, "hello world a b c d", "en", "s", 5, *more),
        (2**60 + 1, " ".join(str(i) for i in range(3000)), "en", "s", 3, *more),
        (None, "mail me at a.b@c.org now", "xx", None, None, *[None] * 9),
        (7, "x" * 300_000, "en", "s", 300_000, *more),
        (8, "\t\n \x0b", "en", "s", 4, *more),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (2, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
