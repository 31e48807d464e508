"""The rows of a task in order of user, time and place in the logs, in bounded memory.

Rows beyond ``RUN_BYTES`` are sorted in runs that go to the executor's local disk, and the runs are merged block by block. The files
have no name, so none is left when a task ends, however it ends.
"""

from __future__ import annotations

import os
import sys
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get this module's code along with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
FAN_IN = 32  # runs of a level; so many make one run of the next

_KEYS = [(c, "ascending") for c in ("user", "us", "file_path", "line_seq")]


def _sorted(batches: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.take(pc.sort_indices(table, sort_keys=_KEYS, null_placement="at_end")).combine_chunks()


class _Run:
    """A sorted run on local disk, and of its next block what is not given out yet."""

    def __init__(self, tables: Iterator[pa.Table]):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file, out = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None), None
        for table in tables:
            out = out or pa.ipc.new_stream(self.file, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            out.write_table(table, max_chunksize=max(1, BLOCK_BYTES * table.num_rows // max(1, table.nbytes)))
        out.close()
        self.file.seek(0)
        self.reader = None

    def load(self) -> bool:
        self.reader = self.reader or pa.ipc.open_stream(self.file)
        try:
            self.block = self.reader.read_next_batch()
        except StopIteration:
            self.file.close()
            return False
        self.users = self.block["user"].to_numpy(zero_copy_only=False)
        self.us = self.block["us"].to_numpy()
        self.begin, end = 0, self.block.num_rows - 1
        self.last = (self.users[end], int(self.us[end]), *self._place(end))
        return True

    def _place(self, at: int) -> tuple:
        path, seq = self.block["file_path"][at].as_py(), self.block["line_seq"][at].as_py()
        return path is None, path or "", seq is None, seq or 0

    def cut(self, key: tuple) -> pa.RecordBatch:
        """The rows up to a key, which then are given out."""
        user, us, *place = key
        low = bisect_left(self.users, user, self.begin)
        high = bisect_right(self.users, user, low)
        low, high = (low + int(np.searchsorted(self.us[low:high], us, side)) for side in ("left", "right"))
        end = bisect_right(range(high), tuple(place), low, key=self._place)
        begin, self.begin = self.begin, end
        return self.block.slice(begin, end - begin)


def _merged(runs: list[_Run]) -> Iterator[pa.Table]:
    """The rows of all runs in order. Each step gives out what no later block can precede, one whole block at least."""
    runs = [run for run in runs if run.load()]
    while runs:
        upto = min(run.last for run in runs)
        yield _sorted([run.cut(upto) for run in runs])
        runs = [run for run in runs if run.begin < run.block.num_rows or run.load()]


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows sorted by ``user``, ``us``, ``file_path``, ``line_seq``, nulls last, in tables of moderate size."""
    held, size, levels = [], 0, []

    def add(run: _Run, level: int) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == FAN_IN:
            runs, levels[level] = levels[level], []
            add(_Run(_merged(runs)), level + 1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= RUN_BYTES:
            add(_Run(iter([_sorted(held)])), 0)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if not levels:
        if held:
            yield _sorted(held)
        return
    if held:
        add(_Run(iter([_sorted(held)])), 0)
        held = []
    yield from _merged([run for level in levels for run in level])
