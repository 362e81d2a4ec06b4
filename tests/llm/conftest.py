from __future__ import annotations

import pytest

from staylens.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Ids and whole texts of the smallest table."""
    return [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    notice = "Released under the MIT License. Apache license, CC BY"
    common = "this very line is in many documents, été"
    long_text = "\n".join(f"line {i} of a long text {common if i % 7 == 0 else ''}" for i in range(3000))
    rows = [
        (1, common + "\n short \n" + notice), (2, "  " + common.upper().replace("É", "é") + "\t\nx"),
        (3, common + "\n" + common), (3, common + "\n" + common), (4, None), (None, common), (None, None),
        (None, "no id, other text\n" + common), (5, ""), (6, "\n\n"), (7, long_text), (8, long_text),
        (9, " "), (10, "é"), (11, "a b c d e f g h i j k l"), (12, "a b c d e f g h i j k l"),
        (-5, "A-b_C d 1–2 e"), (2**62, "one two"), (-(2**62), "one two three"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """These rows with null attributes and columns that operators also use for themselves."""
    extra = ["_keep_0", "_in_0", "keys", "score", "n_words", "part", "size", "bytes", "key", "batch", "ids", "label"]
    frame = spark.createDataFrame([(*row, None, None, None) for row in odd_rows], COLUMNS)
    for name in extra:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def result(spark):
    """A registered query's rows on the smallest tables, by name; each runs once."""
    known = {}

    def get(name):
        if name not in known:
            known[name] = QUERIES[name](spark, FOLDER).collect()
        return known[name]

    return get
