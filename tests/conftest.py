import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import tiff  # noqa: E402
from pyspark import cloudpickle  # noqa: E402

from tessera.session import local_session  # noqa: E402

cloudpickle.register_pickle_by_value(tiff)  # the tests' raster codec isn't on the workers' path

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="tessera-tests")
    yield s
    s.stop()


def masks_df(spark, images: dict):
    """Raster table from {name: 2-D numpy array}."""
    rows = [(n, int(a.shape[0]), int(a.shape[1]), [int(v) for v in np.asarray(a).ravel()]) for n, a in images.items()]
    return spark.createDataFrame(rows, "img_name string, height int, width int, pixels array<int>")


def area_dict(area_df):
    """{(grid, class): value} for a single-image area table."""
    return {(r["grid"], r["class"]): r["value"] for r in area_df.collect()}
