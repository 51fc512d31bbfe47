import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators.layout import index_series
from tidewatch.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def wave():
    """Two series of length 400 and 90 with d = 3; the first has a shift and spikes."""
    rng = np.random.default_rng(7)
    frames = []
    for name, n in (("a", 400), ("b", 90)):
        x = rng.normal(size=(n, 3)) + np.sin(np.arange(n) / 5)[:, None]
        x[n // 2: n // 2 + 20] += 3
        x[[n // 3, n - 5]] += 6
        f = pd.DataFrame(x, columns=["f0", "f1", "f2"])
        f["series_id"], f["t"] = name, np.arange(n)
        frames.append(f)
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def indexed(spark, wave):
    """``indexed(rows)``: the wave series laid out in chunks of ``rows``."""
    shuffled = wave.sample(frac=1.0, random_state=3)

    def make(rows=8192, bins=64):
        return index_series(spark.createDataFrame(shuffled), ["t"], rows=rows, bins=bins)

    return make


def local(df, *order):
    return df.toPandas().sort_values(list(order) or ["series_id", "idx"]).reset_index(drop=True)
