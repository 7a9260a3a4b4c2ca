"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from falloff.llm.common import cut

SEGMENT = 16


def sign_code(vector: Column, dims: int) -> Column:
    """Binary code of a vector: one bit for each dimension, set if it is above zero, in 16-bit segments, as an array.

    Null if the vector is null, has another number of dimensions, or holds null or non-finite components.
    """
    parts = []
    for at in range(0, dims, SEGMENT):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, 1 << (SEGMENT - 1 - (i - at))).otherwise(0) for i in range(at, min(dims, at + SEGMENT))]
        parts.append(sum(bits[1:], bits[0]))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) == dims) & ~bad, F.array(*parts))


def search(codes: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", code: str = "code", shard_codes: int = 1 << 16, block: int = 256) -> DataFrame:
    """(query_id, rank, id, distance): of all rows of ``codes`` the k nearest to each query but itself, exactly.

    Codes are arrays of 16-bit segments, all of one length. Neighbours rank by Hamming distance, then id. Rows with a null
    id or code are neither found nor asked for; of rows that repeat an id one counts, that of the least code. A query finds fewer than
    k rows only where there are fewer. An empty side gives an empty result.

    Copies of a code are one entry with its k + 1 smallest ids, which is all that a result can need; those ids are first
    cut down in each batch, then by salted windows, so a code that a third of all rows have is never gathered.
    Distinct codes are hashed into shards of about ``shard_codes``. In a shard each 16-bit segment has a table of
    the values that occur. For each query of a block, segment by segment, buckets at radius 0, 1, 2, ... are verified until the
    k-th distance found is at most radius * segments + segment: by the pigeonhole principle every nearer code has then
    been met. Blocks of queries meet all shards; each meeting leaves k + 1 codes for a query. Other columns are ignored, whatever
    their names; codes may have any number of segments.
    """
    kinds = dict(codes.dtypes)
    every = codes.where(F.col(id).isNotNull() & F.col(code).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(code).alias("code"))
    asked = queries.where(F.col(id).isNotNull() & F.col(code).isNotNull()).groupBy(F.col(id).alias("query_id")).agg(F.min(code).alias("code"))
    every, asked = cut(every, "codes"), cut(asked, "queries")
    entries = cut(_smallest_ids(every, kinds[id], k + 1), "entries")
    n = entries.count()
    shards = max(1, -(-n // shard_codes))
    packed = entries.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), "code", F.element_at("ids", 1).alias("low"))
    packed = cut(packed.groupBy("shard").applyInPandas(_pack, "shard int, codes binary, lows binary, segments int, n int"), "shards")

    wanted = asked.select("code").distinct()
    blocks = max(1, -(-wanted.count() // block))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "code"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_pack_queries, "block int, asked binary, n_asked int")
    # A shard meets up to 16 blocks in a task, and with few shards fewer, so that there is work for many tasks.
    salts = max(1, min(blocks, max(-(-blocks // 16), -(-64 // shards))))
    wanted = wanted.select(F.pmod("block", F.lit(salts)).alias("salt"), "asked", "n_asked", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = wanted.groupBy("shard", "salt").cogroup(packed.groupBy("shard", "salt"))
    near = met.applyInPandas(lambda asked, shard: _search(asked, shard, k + 1), "code array<int>, found array<struct<d:int,low:long,code:array<int>>>")
    # k + 1 codes from each shard; the best k + 1 of them all.
    near = near.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")).select("code", F.explode("found").alias("f")).select("code", "f.d", F.col("f.code").alias("other"))
    listed = near.join(entries.withColumnRenamed("code", "other"), "other").select("code", "d", F.explode("ids").alias("id")).select("code", F.struct("d", "id").alias("f"))
    listed = listed.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("f")), 1, k + 1).alias("found"))
    # Salted, as many queries may have one code.
    salts = 8
    left = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
    right = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    joined = left.join(right, ["code", "salt"])
    mine = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(mine).alias("rank", "f")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias(id), F.col("f.d").alias("distance"))


def _smallest_ids(rows: DataFrame, kind: str, k: int) -> DataFrame:
    """(code, ids): for each code its k smallest ids, in order."""

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = [x.tobytes() for x in batch["code"]]
            batch = batch.assign(key=key).sort_values("id")
            yield batch.groupby("key").head(k)[["id", "code"]]

    some = rows.mapInPandas(few, f"id {kind}, code array<int>").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("code", "salt").orderBy("id")
    some = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k)
    return some.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    codes = np.stack(rows["code"].to_numpy()).astype(np.uint16)
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "codes": [codes.tobytes()], "lows": [rows["low"].to_numpy(np.int64).tobytes()], "segments": codes.shape[1], "n": len(codes)})


def _pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
    codes = np.stack(rows["code"].to_numpy()).astype(np.uint16)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "asked": [codes.tobytes()], "n_asked": len(codes)})


class Tables:
    """For each segment the values that occur and the codes that have them."""

    def __init__(self, codes: np.ndarray, lows: np.ndarray) -> None:
        self.codes, self.lows, self.parts = codes, lows, []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, start = np.unique(codes[order, s], return_index=True)
            self.parts.append((order, values, start, np.append(start[1:], len(order))))

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest codes by (distance, smallest id)."""
        m = len(self.parts)
        apart = [np.bitwise_count(values ^ query[s]) for s, (_, values, *_) in enumerate(self.parts)]
        seen = np.zeros(len(self.codes), dtype=bool)
        rows, dist = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for radius in range(SEGMENT + 1):
            for s, (order, _, start, end) in enumerate(self.parts):
                at = np.flatnonzero(apart[s] == radius)
                if len(at):
                    size = end[at] - start[at]
                    got = order[np.repeat(start[at] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
                    got = got[~seen[got]]
                    seen[got] = True
                    rows = np.append(rows, got)
                    dist = np.append(dist, np.bitwise_count(self.codes[got] ^ query).sum(axis=1, dtype=np.int64))
                    if len(rows) > 4 * k:
                        keep = np.lexsort((self.lows[rows], dist))[:k]
                        rows, dist = rows[keep], dist[keep]
                covered = m * radius + s
                if len(rows) >= k and np.partition(dist, k - 1)[k - 1] <= covered:
                    keep = np.lexsort((self.lows[rows], dist))[:k]
                    return rows[keep], dist[keep]
        keep = np.lexsort((self.lows[rows], dist))[:k]
        return rows[keep], dist[keep]


def _search(asked: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest codes of a shard to each query of some blocks."""
    out = []
    for s in shard.itertuples():
        tables = Tables(np.frombuffer(s.codes, np.uint16).reshape(s.n, s.segments), np.frombuffer(s.lows, np.int64))
        for r in asked.itertuples():
            for query in np.frombuffer(r.asked, np.uint16).reshape(r.n_asked, s.segments):
                rows, dist = tables.nearest(query, k)
                out.append((query.astype(np.int32), [{"d": int(d), "low": int(tables.lows[i]), "code": tables.codes[i].astype(np.int32)} for i, d in zip(rows, dist, strict=True)]))
    return pd.DataFrame(out, columns=["code", "found"])
