"""Fixed-width binary files read in ranges of records: one file, many tasks, no task with more than its range."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from falloff.plans.staging import staged

#: Records of one range, and of one read within it.
RECORDS, READ = 500_000, 50_000


def opened(path: str) -> pa.NativeFile:
    """A file that can be sought in, by a path as Spark lists it; any store that pyarrow reaches."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inside = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inside)


def split(files: DataFrame, count: Callable[[pa.NativeFile, int], tuple[int, str | None]], records: int = RECORDS) -> DataFrame:
    """(path, begin, end, error): ranges of the records of ``files`` (path, length), dealt to as many tasks.

    ``count`` reads what it needs of a file's header and says how many records there are and what is amiss; a ValueError of it makes
    one row with the error and no records, as for a file of none.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    with opened(path) as f:
                        n, error = count(f, int(length))
                except (ValueError, OSError) as e:
                    n, error = 0, str(e)
                out += [(path, at, min(n, at + records), error) for at in range(0, max(n, 1), records)]
            yield pd.DataFrame(out, columns=["path", "begin", "end", "error"])

    found = staged(files.select("path", "length").mapInPandas(of, "path string, begin long, end long, error string"), "file-ranges")
    return found.repartition(max(1, min(10_000, found.count())), "path", "begin").select("path", "begin", "end", F.col("error"))


def reads(begin: int, end: int) -> Iterator[tuple[int, int]]:
    for at in range(begin, end, READ):
        yield at, min(end, at + READ)
