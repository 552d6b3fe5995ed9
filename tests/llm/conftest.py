import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Odd rows: nulls, empty and blank texts, repeats, a repeated id, and a column whose name operators use inside."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, base, "a", 1), (2, base.replace(" ", "\t "), "a", 2), (3, base + " seventeen", "b", 3), (4, None, None, 4), (5, "", "a", 5),
        (6, " \n\t ", "b", 6), (7, "short", None, 7), (7, "short", None, 7), (8, "ONE TWO " + base[8:], "c", 8),
        (9, "quite another text about nothing in particular that is long enough to count", "c", 9), (None, base, "a", 0),
        (10, "x" * 70_000 + " end", "a", 10),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _key int")
