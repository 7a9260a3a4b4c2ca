"""Embedding near-dedup: a navigable small-world graph for each shard, every shard queried, links verified by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from falloff.llm.common import components, cut, stars


class Graph:
    """Layers of a hierarchical navigable small world over unit vectors, searched for many queries in step.

    Vectors within ``cover`` (cosine) of a node that is there already become members of that node, so a dense
    cluster is a few nodes with many members rather than a tangle of links among copies.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 48, cover: float = 0.97, seed: int = 3) -> None:
        self.degree, self.cover = degree, cover
        n = len(vectors)
        self.vectors = vectors
        level = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(int), 12)
        level[0] = max(level[0], level.max(initial=0))
        self.node = np.full(n, -1, dtype=np.int64)  # of each vector the vector that is its node
        self.links = [np.full((n, 2 * degree if k == 0 else degree), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.level, self.entry = level, 0
        if n:
            self.node[0] = 0
        at, size = 1, 1
        while at < n:  # batches grow with the graph, so that each is searched in a graph larger than itself
            batch = np.arange(at, min(n, at + size))
            self._insert(batch, beam)
            at += len(batch)
            size = min(2 * size, 1024)

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        found, sims = self.search(self.vectors[batch], beam)
        near = sims[:, 0] >= self.cover
        self.node[batch[near]] = found[near, 0]
        new = batch[~near]
        # Within the batch, greedily: the first of vectors that lie together becomes their node.
        if len(new):
            among = self.vectors[new] @ self.vectors[new].T
            for i in range(len(new)):
                if self.node[new[i]] < 0:
                    self.node[new[i]] = new[i]
                    together = (among[i] >= self.cover) & (self.node[new] < 0)
                    self.node[new[together]] = new[i]
            own = self.node[new] == new
            among, new = among[np.ix_(own, own)], new[own]
            np.fill_diagonal(among, -2)
            for layer in range(len(self.links)):
                part = self.level[new] >= layer
                if not part.any():
                    break
                nodes = new[part]
                if layer == 0:
                    cand, sim = found[~near][own][part], sims[~near][own][part]
                else:
                    cand, sim = self.search(self.vectors[nodes], beam, layer)
                inner = among[np.ix_(part, part)]
                top = np.argsort(-inner, axis=1)[:, : self.degree]
                cand = np.concatenate([cand, nodes[top]], axis=1)
                sim = np.concatenate([sim, np.take_along_axis(inner, top, axis=1)], axis=1)
                self._connect(layer, nodes, cand, sim)

    def _connect(self, layer: int, nodes: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        links, width = self.links[layer], self.links[layer].shape[1]
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        for row, node in enumerate(nodes):
            ok = (cand[row] >= 0) & (sim[row] > -2)
            _, first = np.unique(cand[row][ok], return_index=True)
            mine = cand[row][ok][np.sort(first)]
            links[node] = -1
            keep = self._diverse(node, mine[: 3 * self.degree], self.degree)
            links[node, : len(keep)] = keep
            for other in keep:
                free = np.flatnonzero(links[other] < 0)
                if node in links[other]:
                    continue
                if len(free):
                    links[other, free[0]] = node
                else:
                    those = np.append(links[other], node)
                    those = those[np.argsort(-(self.vectors[those] @ self.vectors[other]), kind="stable")]
                    keep2 = self._diverse(other, those, width)
                    links[other] = -1
                    links[other, : len(keep2)] = keep2

    def _diverse(self, node: int, cand: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first, those nearer to the node than to one already kept; filled up with the nearest."""
        if len(cand) <= most:
            return cand
        v = self.vectors[cand]
        to_node, among = v @ self.vectors[node], v @ v.T
        keep: list[int] = []
        for i in range(len(cand)):
            if len(keep) < most and (not keep or among[i, keep].max() < to_node[i]):
                keep.append(i)
        rest = [i for i in range(len(cand)) if i not in set(keep)]
        return cand[np.array(keep + rest[: most - len(keep)], dtype=int)]

    def search(self, queries: np.ndarray, beam: int, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``beam`` best found in layer ``stop`` for each query, best first; -1 where fewer."""
        q = len(queries)
        best = np.full((q, 1), self.entry, dtype=np.int64)
        sims = (queries @ self.vectors[self.entry])[:, None]
        for layer in range(len(self.links) - 1, stop, -1):
            best, sims = self._layer(queries, best, sims, layer, 4)
        return self._layer(queries, best, sims, stop, beam)

    def _layer(self, queries: np.ndarray, start: np.ndarray, sims: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, width = len(queries), self.links[layer].shape[1]
        ids = np.full((q, beam), -1, dtype=np.int64)
        sim = np.full((q, beam), -3.0)
        k = min(beam, start.shape[1])
        ids[:, :k], sim[:, :k] = start[:, :k], sims[:, :k]
        done = np.zeros((q, beam), dtype=bool)
        seen = np.zeros((q, len(self.vectors)), dtype=bool) if q * len(self.vectors) <= 1 << 26 else None
        rows = np.arange(q)
        if seen is not None:
            for j in range(k):
                seen[rows[ids[:, j] >= 0], ids[ids[:, j] >= 0, j]] = True
        active = rows
        while len(active):
            todo = np.where(done[active] | (ids[active] < 0), -4.0, sim[active])
            pick = todo.argmax(axis=1)
            going = todo[np.arange(len(active)), pick] > -3.5
            active, pick = active[going], pick[going]
            if not len(active):
                break
            done[active, pick] = True
            next_ = self.links[layer][ids[active, pick]].astype(np.int64)
            valid = next_ >= 0
            if seen is not None:
                valid &= ~seen[active[:, None], np.maximum(next_, 0)]
                seen[np.broadcast_to(active[:, None], next_.shape)[valid], next_[valid]] = True
            else:
                valid &= ~(next_[:, :, None] == ids[active][:, None, :]).any(axis=2)
            s = np.full(next_.shape, -3.0)
            r, c = np.nonzero(valid)
            if len(r):
                s[r, c] = np.einsum("ij,ij->i", queries[active[r]], self.vectors[next_[r, c]])
            all_ids = np.concatenate([ids[active], np.where(valid, next_, -1)], axis=1)
            all_sim = np.concatenate([sim[active], s], axis=1)
            all_done = np.concatenate([done[active], np.zeros((len(active), width), dtype=bool)], axis=1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            sim[active] = np.take_along_axis(all_sim, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
        return ids, sim

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors by node, and where each node's begin."""
        order = np.argsort(self.node, kind="stable")
        return order, np.searchsorted(self.node[order], np.arange(len(self.node) + 1))


def near(graph: Graph, queries: np.ndarray, cosine: float, beam: int = 32, audit: int = 128, recall: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of the queries to the graph's vectors, as blocks (query rows, vector rows, whether they link).

    A vector within ``cosine`` of a query lies in a node within the sum of both angles, so all nodes within that
    angle are wanted and their members verified. A query's beam is doubled until its worst node lies outside that
    angle. Then ``audit`` of the queries, spread evenly, are held against every vector; while fewer than ``recall`` of
    their links are found, all beams are doubled and searched again, at last up to every node.
    """
    wide = math.cos(min(math.pi, math.acos(cosine) + math.acos(min(1.0, graph.cover)))) - 1e-9
    nodes = int((graph.node == np.arange(len(graph.node))).sum())
    order, begin = graph.members()
    spread = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    truth = queries[spread] @ graph.vectors.T >= cosine
    while True:
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), 512):
            todo, width = np.arange(at, min(len(queries), at + 512)), beam
            while len(todo):
                width = min(width, nodes)
                ids, sims = graph.search(queries[todo], width)
                full = (sims[:, -1] >= wide) & (width < nodes)
                good = (sims >= wide) & ~full[:, None]
                r, c = np.nonzero(good)
                hits.append((todo[r], ids[r, c]))
                todo, width = todo[full], 2 * width
        query, node = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        found = np.zeros_like(truth)
        for i, s in enumerate(spread):
            for v in node[query == s]:
                m = order[begin[v] : begin[v + 1]]
                found[i, m] = truth[i, m]
        if found.sum() >= recall * truth.sum() or beam >= nodes:
            break
        beam = min(2 * beam, nodes)
    # Nodes of one member are verified together; the others node by node, a block of queries against a block of members.
    size = begin[node + 1] - begin[node]
    one = size == 1
    alone = order[begin[node[one]]]
    yield query[one], alone, np.einsum("ij,ij->i", queries[query[one]], graph.vectors[alone]) >= cosine
    query, node = query[~one], node[~one]
    by = np.argsort(node, kind="stable")
    query, node = query[by], node[by]
    cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(node)), strict=True) if len(node) else []:
        m = order[begin[node[a]] : begin[node[a] + 1]]
        for i in range(a, b, 1024):
            for j in range(0, len(m), 4096):
                mm, qq = m[j : j + 4096], query[i : min(b, i + 1024)]
                yield qq, mm, queries[qq] @ graph.vectors[mm].T >= cosine


def link(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, shard_rows: int = 1 << 15, min_shards: int = 6, block_rows: int = 1 << 12) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two vectors link when their cosine in double precision is at least ``cosine``; n_links counts the other vectors linked
    directly, component_id is the smallest id reachable, kept tells the rows that are their component's id. A vector that
    is null, zero, or holds null or non-finite components links with nothing, like one of another length. Of rows
    that repeat an id, one counts, that of the least vector; each of them gets its answer. A null id gets no links and no component.

    Exact copies are one entry that carries their number. Entries are hashed into shards; each shard becomes a
    graph, in one task of bounded memory, written to the shared folder. Blocks of entries meet every shard; a
    meeting leaves for each entry how many vectors it links to there, and edges that connect what the block's links connect, no
    more than there are entries: pairs inside a cluster are never listed.
    """
    kind = dict(rows.dtypes)[id]
    given = rows.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    given = given.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(2), "v"))
    given = cut(given, "vectors")
    entries = given.where("usable").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    entries = cut(entries, "vector-entries")
    n = entries.count()
    shards, blocks = max(min_shards, -(-n // shard_rows)), max(2 * min_shards, -(-n // block_rows))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "g"])
        out = []
        for length, same in part.groupby(part["v"].map(len)):
            x = _units(same["v"])
            graph = Graph(x)
            out.append((int(same["shard"].iloc[0]), int(length), same["id"].to_numpy(np.int64).tobytes(), same["n"].to_numpy(np.int64).tobytes(), x.tobytes(), graph.node.tobytes(), graph.level.astype(np.int8).tobytes(), [k.tobytes() for k in graph.links]))
        return pd.DataFrame(out, columns=["shard", "length", "ids", "counts", "vectors", "node", "level", "links"])

    sharded = entries.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    graphs = cut(sharded.groupBy("shard").applyInPandas(build, "shard int, length int, ids binary, counts binary, vectors binary, node binary, level binary, links array<binary>"), "graphs")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = [(int(part["block"].iloc[0]), int(length), same["id"].to_numpy(np.int64).tobytes(), _units(same["v"]).tobytes()) for length, same in part.groupby(part["v"].map(len))]
        return pd.DataFrame(out, columns=["block", "length", "asked", "queries"])

    blocked = entries.withColumn("block", F.pmod("g", F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, length int, asked binary, queries binary")
    met = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(shards * blocks, "block", "shard").join(graphs, ["shard", "length"])
    found = cut(met.mapInPandas(lambda it: _meet(it, cosine), "a long, b long, links long"), "vector-links")

    counts = found.where("links is not null").groupBy(F.col("a").alias("low")).agg(F.sum("links").alias("links"))
    label = components(found.where("links is null").select("a", "b")).withColumnsRenamed({"node": "_node", "component": "_component"})
    named = entries.select("h", "g", F.col("id").alias("low")).join(counts, "low", "left").join(label, F.col("low") == F.col("_node"), "left")
    named = named.select("h", "g", F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("_component", "low").alias("_low"), F.lit(True).alias("usable"))
    each = given.select("id", "h", "g", "usable").join(named, ["h", "g", "usable"], "left")
    each = each.select(F.col("id").alias("_id"), F.coalesce(F.col("_links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("_low"), F.col("id")).cast(kind).alias("component_id"))
    out = rows.select(F.col(id)).join(each, F.col(id) == F.col("_id"), "left").drop("_id")
    return out.select(id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)).alias("kept"))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _meet(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            ids, counts, asked = (np.frombuffer(x, dtype=np.int64) for x in (r.ids, r.counts, r.asked))
            graph = Graph.__new__(Graph)
            graph.vectors = np.frombuffer(r.vectors).reshape(len(ids), r.length)
            graph.node, graph.level, graph.entry, graph.cover = np.frombuffer(r.node, dtype=np.int64), np.frombuffer(r.level, dtype=np.int8), 0, 0.97
            graph.links = [np.frombuffer(k, dtype=np.int32).reshape(len(ids), -1) for k in r.links]
            links, a, b = np.zeros(len(asked), dtype=np.int64), [], []
            for q, v, good in near(graph, np.frombuffer(r.queries).reshape(len(asked), r.length), cosine):
                if good.ndim == 1:
                    np.add.at(links, q[good], counts[v[good]])
                    a.append(asked[q[good]])
                    b.append(ids[v[good]])
                else:
                    links[q] += good @ counts[v]
                    # What a block connects: labels go to and fro until each connected part has one.
                    x, y = _connected(good)
                    a.append(asked[q[x]])
                    b.append(ids[v[y]])
            x, y = stars(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": asked, "b": np.int64(0), "links": pd.array(links, dtype="Int64")})
            yield pd.DataFrame({"a": x, "b": y, "links": pd.array([None] * len(x), dtype="Int64")})


def _connected(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a block that connect whatever all its links connect, fewer than rows plus columns."""
    rows = np.arange(len(good))
    any_row, any_column = good.any(axis=1), good.any(axis=0)
    first_column, first_row = good.argmax(axis=1), good.argmax(axis=0)
    x = [rows[any_row], first_row[any_column]]
    y = [first_column[any_row], np.flatnonzero(any_column)]
    # First links alone may leave parts apart; links between different parts are added until there are none.
    while True:
        a, b = np.concatenate(x), np.concatenate(y)
        label = np.arange(len(good) + good.shape[1])
        node, low = stars(a, b + len(good))
        label[node] = low
        apart = good & (label[: len(good), None] != label[None, len(good) :])
        if not apart.any():
            return a, b
        r = np.flatnonzero(apart.any(axis=1))
        x.append(r)
        y.append(apart[r].argmax(axis=1))
