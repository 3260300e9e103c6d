"""Files of one piece written by many tasks: each writes what it holds at its place, and the driver commits them all at once."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def shared_path(path: str) -> str:
    """A path on a file system that all executors mount. Object stores can't write in the middle of a file."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: files of one piece need a mounted shared folder")
    return path.removeprefix("file://").removeprefix("file:")


class Assembly:
    """A folder whose files are written beside their places and moved there by ``commit``.

    What a task writes depends on its rows alone, so attempts may repeat or run twice.
    """

    def __init__(self, path: str):
        self.path = shared_path(path)
        self.folder = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        os.makedirs(self.folder)
        self.names: list[str] = []

    def write(self, name: str, rows: DataFrame) -> int:
        """Writes rows of ``at`` (first byte) and ``data``; the number of bytes written."""
        target = f"{self.folder}/{name}"
        open(target, "wb").close()
        self.names.append(name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, out = 0, os.open(target, os.O_WRONLY)
            try:
                for b in batches:
                    for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        n += write_all(out, data, at)
                os.fsync(out)
            finally:
                os.close(out)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return rows.select("at", "data").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0

    def patch(self, name: str, at: int, data: bytes) -> None:
        """Writes a small piece, such as a header, from the driver."""
        out = os.open(f"{self.folder}/{name}", os.O_WRONLY)
        try:
            write_all(out, data, at)
        finally:
            os.close(out)

    def describe(self, name: str, content: dict) -> None:
        with open(f"{self.folder}/{name}", "w") as f:
            json.dump(content, f)
        self.names.append(name)

    def commit(self, *last: str) -> None:
        """Moves the files into place, those named ``last`` at the end."""
        for name in [*(n for n in self.names if n not in last), *last]:
            os.replace(f"{self.folder}/{name}", f"{self.path}/{name}")
        os.rmdir(self.folder)


def write_all(out: int, data: bytes, at: int) -> int:
    done = 0
    while done < len(data):
        done += os.pwrite(out, data[done:], at + done)
    return done


def to_steps(values: np.ndarray, scale: float, offset: float) -> np.ndarray:
    """Coordinates as 32-bit steps; fails where one doesn't fit, as a wrapped number would be another place."""
    steps = np.floor((np.asarray(values, np.float64) - offset) / scale + 0.5)
    if len(steps) and not (np.isfinite(steps).all() and steps.min() >= -(2**31) and steps.max() < 2**31):
        raise ValueError(f"coordinates of {np.min(values)} to {np.max(values)} don't fit 32 bits at scale {scale} and offset {offset}")
    return steps.astype("<i4")
