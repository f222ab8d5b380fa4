"""Tables of numbers by a 64-bit hash that grow with the input: sorted, range-partitioned files in the shared folder.

A file holds the hashes of one range, in order, and their values; there are as many
ranges as the number of rows asks for. Readers hold a bounded number of bytes of them.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold
from .token_store import _put

PART_ROWS, LEAST_BITS = 1 << 15, 6


def write_table(rows: DataFrame, folder: str, n_rows: int) -> None:
    """rows: h (bigint, distinct) and numbers. Writes a file per range of h, as an unsigned number; n_rows: about how many there are."""
    bits = max(LEAST_BITS, (n_rows // PART_ROWS).bit_length())
    values = [c for c in rows.columns if c != "h"]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame["h"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(h)
        _put(f"{folder}/{int(frame['p'].iloc[0])}.table", h[by].tobytes() + b"".join(frame[c].to_numpy(np.float32)[by].tobytes() for c in values))
        return pd.DataFrame({"n": [len(frame)]})

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    ranged = rows.withColumn("p", F.shiftrightunsigned("h", 64 - bits))
    ranged.groupBy("p").applyInPandas(build, "n bigint").write.parquet(f"{folder}/ranges")
    _put(f"{folder}/layout", np.array([bits, len(values)], "<u4").tobytes())


class Table:
    """A folder of write_table; at most max_bytes of its files are held."""

    def __init__(self, folder: str, max_bytes: int = 96 << 20):
        self.fs, self.at = pyarrow.fs.FileSystem.from_uri(folder)
        with self.fs.open_input_file(f"{self.at}/layout") as f:
            self.bits, self.width = map(int, np.frombuffer(f.read(), "<u4"))
        self.held: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.left = max_bytes

    def _part(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if p not in self.held:
            try:
                with self.fs.open_input_file(f"{self.at}/{p}.table") as f:
                    data = f.read()
            except FileNotFoundError:
                data = b""
            n = len(data) // (8 + 4 * self.width)
            self.held[p] = np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.float32, n * self.width, 8 * n).reshape(self.width, n)
            self.left -= len(data)
            while self.left < 0 and len(self.held) > 1:
                h, _ = self.held.popitem(last=False)[1]
                self.left += len(h) * (8 + 4 * self.width)
        self.held.move_to_end(p)
        return self.held[p]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values by column of each hash (uint64), 0 where there is none."""
        out = np.zeros((self.width, len(h)), np.float32)
        by = np.argsort(h)
        own = h[by]
        edges = np.searchsorted(own >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            here, at = own[edges[p] : edges[p + 1]], by[edges[p] : edges[p + 1]]
            keys, values = self._part(p)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
                out[:, at] = np.where(keys[i] == here, values[:, i], 0)
        return out


_TABLES: dict[str, Table] = {}
#: What else keeps tables, to be cleared with them.
KEEPERS: list[dict] = [_TABLES]


def _release() -> None:
    for held in KEEPERS:
        held.clear()


def table(folder: str) -> Table:
    """The worker's table of a folder; those of two folders are held."""
    hold("look-up", _release)
    if folder not in _TABLES:
        while len(_TABLES) > 1:
            _TABLES.pop(next(iter(_TABLES)))
        _TABLES[folder] = Table(folder)
    return _TABLES[folder]
