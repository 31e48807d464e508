"""Reading the first lines of files inside Spark tasks."""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle

# Fixed value: lines per file that format detection may look at.
SAMPLE_LINES = 20
LINE_CHARS = 1 << 20  # detection looks at so many characters of a line

# Tasks get this module's code along with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every ``file_path`` its first lines, numbered from 1; the rest of the file is not read.

    A file that cannot be opened or read gives one row with place 0 and the reason.
    """
    for batch in batches:
        for path in batch["file_path"]:
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
            try:
                files, name = fs.FileSystem.from_uri(uri)
                with files.open_input_stream(name) as raw:
                    text = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", errors="replace")
                    head = [line[:LINE_CHARS].strip() for _, line in zip(range(SAMPLE_LINES), _lines(text))]
            except (OSError, ValueError, EOFError) as error:
                reason = str(error).splitlines()[0] if str(error) else type(error).__name__
                yield pd.DataFrame({"file_path": [path], "place": [0], "line": [None], "error": [reason]})
                continue
            yield pd.DataFrame({"file_path": path, "place": range(1, len(head) + 1), "line": head, "error": None})


def _lines(text: io.TextIOWrapper) -> Iterator[str]:
    """Lines, of which very long ones are read no further than the sample needs."""
    while line := text.readline(LINE_CHARS):
        whole = line
        while not whole.endswith("\n") and (whole := text.readline(LINE_CHARS)):
            pass
        yield line
