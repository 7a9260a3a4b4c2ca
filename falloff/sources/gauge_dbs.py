"""Binary gauge records (.dbs): fixed layout, read in ranges of samples."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.sources import ranges
from falloff.sources.files import listing
from falloff.sources.gauge_csv import roles

#: Fixed values of the layout: magic bytes, offsets of the header, bytes of a channel's record.
MAGIC = b"\x77\xef\xcd\xab"
CHANNELS_AT, SAMPLES_AT, INTERVAL_AT, DATA_AT, HEADER, RECORD = 0x2B4, 0x2B8, 0x2C0, 0x2CC, 0x334, 84

ROWS = "path string, idx long, t_s double, channels map<string,double>, p double, rate double, volume double, p_is_bhp boolean, error string"


def channel_names(records: list[bytes]) -> list[str]:
    """Names of channels, a tag or a number added to those that came before; DateTime is taken."""
    seen, out = {"DateTime"}, []
    for r in records:
        tag = r[:4].split(b"\0")[0].decode("latin-1").strip()
        base = name = r[16:].split(b"\0")[0].decode("latin-1").strip() or tag
        if name in seen:
            base = name = f"{base} [{tag}]"
        k = 2
        while name in seen:
            name, k = f"{base} ({k})", k + 1
        seen.add(name)
        out.append(name)
    return out


def header(file: pa.NativeFile, length: int) -> tuple[list[str], int, float, int]:
    """Channel names, samples, seconds between samples and where samples begin; ValueError if the layout doesn't hold."""
    head = file.read(HEADER)
    if len(head) < HEADER or head[:4] != MAGIC:
        raise ValueError("no gauge record")
    n, rows = struct.unpack_from("<II", head, CHANNELS_AT)
    (minutes,), (data,) = struct.unpack_from("<f", head, INTERVAL_AT), struct.unpack_from("<I", head, DATA_AT)
    if not 1 <= n <= 64 or rows == 0:
        raise ValueError("no channels or no samples")
    if not (math.isfinite(minutes) and minutes > 0):
        raise ValueError("no sample interval")
    if data != HEADER + RECORD * n or length != data + rows * 4 * (n + 1):
        raise ValueError("size and header disagree")
    records = file.read(RECORD * n)
    return channel_names([records[RECORD * k : RECORD * (k + 1)] for k in range(n)]), rows, minutes * 60.0, data


def parse(content: bytes) -> tuple[list[str], np.ndarray, float]:
    """Channel names, all rows (idx, values) and seconds between samples of a record in memory."""
    names, rows, seconds, data = header(pa.BufferReader(content), len(content))
    return names, np.frombuffer(content, dtype=np.dtype([("idx", "<u4"), ("v", "<f4", (len(names),))]), count=rows, offset=data), seconds


def _count(file: pa.NativeFile, length: int) -> tuple[int, str | None]:
    return header(file, length)[1], None


def read_gauge_dbs(spark: SparkSession, root: str, with_channels: bool = True, samples: int = ranges.RECORDS) -> DataFrame:
    """(path, idx, ts, t_s, channels, p, rate, volume, p_is_bhp, error, test_id) of every .dbs under ``root``; a file that can't
    be read is one row with its error. ts counts from 1970.

    A record is read in ranges of ``samples`` by as many tasks, each of which reads only its range. Without
    ``with_channels`` the map of all channels is null and only pressure, rate and volume are decoded.
    """
    return read_dbs_files(listing(spark, root, "*.[dD][bB][sS]"), with_channels, samples)


def read_dbs_files(files: DataFrame, with_channels: bool = True, samples: int = ranges.RECORDS) -> DataFrame:
    """The same for given files (path, length)."""
    parts = ranges.split(files, _count, samples)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin, end, error in zip(batch["path"], batch["begin"], batch["end"], batch["error"], strict=True):
                if error is not None:
                    yield pd.DataFrame({"path": [path], "idx": [0]} | {c: [None] for c in ("t_s", "channels", "p", "rate", "volume", "p_is_bhp")} | {"error": [error]})
                    continue
                with ranges.opened(path) as file:
                    names, _, seconds, data = header(file, file.size())
                    at, kind = roles(names), np.dtype([("idx", "<u4"), ("v", "<f4", (len(names),))])
                    for first, stop in ranges.reads(begin, end):
                        file.seek(data + first * kind.itemsize)
                        part = np.frombuffer(file.read((stop - first) * kind.itemsize), dtype=kind)
                        values = part["v"]
                        maps = [{n: v for n, v in zip(names, r, strict=True) if math.isfinite(v)} for r in values.astype(float).tolist()] if with_channels else None
                        one = lambda k: np.where(np.isfinite(values[:, k]), values[:, k].astype(float), np.nan)  # noqa: B023, E731
                        mine = {c: None if at[r] is None else one(at[r]) for c, r in (("p", "pressure"), ("rate", "rate"), ("volume", "volume"))}
                        yield pd.DataFrame({"path": path, "idx": np.arange(first, stop), "t_s": part["idx"] * seconds, "channels": maps, **mine, "p_is_bhp": at["bottom"] is not None, "error": None})

    ts = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("t_s").cast("decimal(18,6)"))
    number = {c: F.nanvl(F.col(c), F.lit(None)) for c in ("p", "rate", "volume")}
    return parts.mapInPandas(rows, ROWS).withColumns({**number, "ts": ts, "test_id": F.col("path")})
