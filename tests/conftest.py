import numpy as np
import pandas as pd
import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tidemark-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def level_shift(base=50.0, slope=0.5, shift=10.0, n=100, at=70, seed=42):
    """The trend-plus-noise series with a step the detection tests use."""
    noise = np.random.RandomState(seed).normal(0, 2, n)
    y = base + slope * np.arange(n) + noise
    y[at:] += shift
    return y


def long_table(series: dict[str, np.ndarray], start="2020-01-01", freq="D") -> pd.DataFrame:
    return pd.concat([
        pd.DataFrame({"key": k, "date": pd.date_range(start, periods=len(y), freq=freq), "value": np.asarray(y, float)})
        for k, y in series.items()
    ])
