import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer rows, in several partitions."""

    def make(rows, schema=DOCS, parts=3):
        width = schema.count(",") + 1
        rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, blanks, ties and repeated rows, one long text."""
    return [(1, None), (2, ""), (3, " \n\n "), (4, "the same short line here"),
            (5, "the same short line here"), (5, "the same short line here"), (None, "no id at all"),
            (None, None), (6, "word " * 30_000), (7, "!!!"), (8, "日本語 текст ünï")]


@pytest.fixture(scope="session")
def clashing():
    """Extra columns named like the operators' own."""
    return ("doc_id bigint, text string, row string, out string, x string, place string, "
            "ids string, score string, n_words string, shard string, piece_ids string")
