import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, label string"


@pytest.fixture(scope="session")
def sf():
    if not SF.is_dir():
        pytest.skip(f"{SF} is not there")
    return str(SF)


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang), with columns of clashing names."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return build


@pytest.fixture
def odd_texts():
    return [(0, None), (1, ""), (2, "   \n\t "), (3, "123 !? --"), (4, "Straße ÉCLAIR Σας 中文 \U0001f600"),
            (5, "same text here, twice over"), (6, "same text here, twice over"), (6, "same text here, twice over"),
            (None, "no id at all in this row"), (7, "word " * 30_000), (8, "x" * 100_000), (9, "a<|endoftext|>b")]
