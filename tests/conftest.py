"""One local session for all tests, and fixtures of frames."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from framesieve.session import local_session, ship  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = ship(local_session(4, shuffle_partitions=4, memory="4g"))
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def white(n, w=320, h=180):
    return np.full((n, h, w, 3), 255, np.uint8)


def ramp(n, w=320, h=180):
    """A horizontal ramp: bright and varied, but without edges."""
    line = np.linspace(20, 230, w).astype(np.uint8)
    return np.broadcast_to(line[None, None, :, None], (n, h, w, 3)).copy()


def noise(n, seed=0, w=320, h=180):
    return np.stack([np.random.default_rng(seed + k).integers(0, 256, (h, w, 3)).astype(np.uint8) for k in range(n)])


def frame_rows(spark, videos):
    """(video_id, frame_idx, height, width, n_channels, data) of a dict of arrays."""
    rows = [(name, k, f.shape[0], f.shape[1], f.shape[2], bytearray(f.tobytes())) for name, frames in videos.items() for k, f in enumerate(frames)]
    return spark.createDataFrame(rows, "video_id string, frame_idx bigint, height int, width int, n_channels int, data binary")
