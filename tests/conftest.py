import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from loadweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "8g",
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hourly(spark):
    """Builds ``(series_id, timestamp, value...)`` frames from hour numbers since 2024-01-01."""
    import pandas as pd

    def build(rows, columns=("actual_load_mw",), start="2024-01-01"):
        base = pd.Timestamp(start)
        names = ", ".join(f"{c} double" for c in columns)
        data = [(s, (base + pd.Timedelta(hours=h)).to_pydatetime(), *[None if v is None else float(v) for v in vs])
                for s, h, *vs in rows]
        return spark.createDataFrame(data, f"series_id string, timestamp timestamp_ntz, {names}")
    return build
