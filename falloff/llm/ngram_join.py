"""N-gram Jaccard join: adaptive multi-match prefixes over hashed word shingles, exact classes of near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from falloff.llm.common import BROADCAST_BYTES, components, cut, drop_cut, stars

_K = np.uint64(0x9E3779B97F4A7C15)
_LOW32 = np.uint64(0xFFFFFFFF)
#: How far a prefix may be lengthened, as shares of a set's size; the first always means one shared token.
LENGTHS = (0.0, 0.03, 0.1, 0.2)
#: The share of the first pass, which only tells the sets that may link with any.
FIRST = 0.05
#: A set's first tokens: by the first few it finds leaders, by all of them it chooses one.
HEADS, MEETINGS, LEADERS = 32, 8, 6
#: Sets of one group that are held in one block, and so many of a block in a token's list that the block is met whole.
BLOCK, DENSE = 256, 32
#: Stands for all classes of a block.
ALL = np.iinfo(np.int64).min
#: Bytes of text that are hashed at a time.
_SLICE = 1 << 20
#: Bits of the map of wanted rows that is broadcast: 2 MB whatever the input.
_BITS = 1 << 24
_PIECES = 64

#: A byte's turn to be white space between words, and what it adds to a word's sum, A-Z as a-z.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[0x41:0x5B] += np.uint64(0x20)
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _words(b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and starts of the words of a slice in which texts begin at ``begins``.

    A word's hash is a difference of one running sum, moved to place 0 by the inverse power of its start.
    """
    if not _powers:
        for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
            power = np.full(2 * _SLICE + 1, base, dtype=np.uint64)
            power[0] = 1
            _powers.append(np.multiply.accumulate(power))
    inside = ~_SPACE[b]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = begins[(begins > 0) & (begins < len(b))]
    first[at], last[at - 1] = inside[at], inside[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[b] * _powers[0][: len(b)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * _powers[1][start]), start


def _long_words(b: np.ndarray) -> np.ndarray:
    """Word hashes of a text longer than a slice, in slices that end at white space; a longer word is hashed whole."""
    parts, at = [], 0
    while at < len(b):
        end = at + _SLICE
        while end < len(b):
            space = np.flatnonzero(_SPACE[b[end : end + _SLICE]])
            if len(space):
                end += int(space[0])
                break
            end += _SLICE
        piece = b[at : min(end, len(b))]
        if len(piece) <= 2 * _SLICE:
            parts.append(_words(piece, np.zeros(1, dtype=np.int64))[0])
        else:  # what stands before the long word, then that word
            inside = np.flatnonzero(_SPACE[piece[:_SLICE]])
            cut_at = int(inside[-1]) if len(inside) else 0
            parts.append(_words(piece[:cut_at], np.zeros(1, dtype=np.int64))[0])
            parts.append(np.array([xxhash.xxh64_intdigest(piece[cut_at:].tobytes().strip().lower())], dtype=np.uint64))
        at = min(end, len(b))
    return np.concatenate(parts)


def _set_of(h: np.ndarray, windows: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct shingles of a text from its word hashes and those of its windows of n words."""
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], dtype=np.uint64)
    s = np.sort(windows[: len(h) - n + 1])
    return s[np.append(True, s[1:] != s[:-1])]


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return h[:0]
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s *= _K
        s += h[k : len(h) - n + 1 + k]
    return _mixed(s)


def shingle_sets(texts: pa.Array, n: int = 5, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of the texts that have words: sorted 64-bit hashes of the distinct n-word shingles, of all words as one
    if there are fewer. Words are what ASCII white space separates, A-Z in lower case. Only ``rows``, if given."""
    _, offsets, data = texts.cast(pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    rows = np.arange(len(texts)) if rows is None else rows
    size = offsets[rows + 1] - offsets[rows]
    at = 0
    while at < len(rows):
        if size[at] > _SLICE:
            h = _long_words(data[offsets[rows[at]] : offsets[rows[at] + 1]])
            if len(h):
                yield int(rows[at]), _set_of(h, _windows(h, n), n)
            at += 1
            continue
        # Texts of up to a slice together.
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + 4096]), _SLICE, "right")))
        part = rows[at:end]
        begins = np.cumsum(np.append(0, size[at:end]))
        b = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in part]) if end - at > 1 else data[offsets[part[0]] : offsets[part[0] + 1]]
        h, start = _words(b, begins[:-1]) if len(b) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        bounds = np.searchsorted(start, begins).tolist()
        windows = _windows(h, n)
        for k, r in enumerate(part.tolist()):
            a, z = bounds[k], bounds[k + 1]
            if z > a:
                yield r, _set_of(h[a:z], windows[a:z], n)
        at = end


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The set of one text; empty for null and for texts without words."""
    return next((s for _, s in shingle_sets(pa.array([text or ""], type=pa.string()), n)), np.zeros(0, dtype=np.uint64))


def _class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def _needed(n, percent: int):
    """The least overlap of a set of n with any set it links to."""
    return (percent * n + 99) // 100


def _length(n: int, share: float) -> int:
    return max(1, int(np.ceil(share * n)))


def _lengths(n: int) -> list[int]:
    return [_length(n, share) for share in LENGTHS]


def link_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles;
    component_id is the smallest id reachable. A text without words, or null, has 0 shingles and links with nothing, its
    component being its own id. Equal sets are one class, met once. Ids may repeat; rows then stand for themselves.
    An empty table gives an empty table; other columns are ignored.

    A set's order is that of its hashes. Its l-prefix (size - least overlap + l) shares l tokens with that of any
    set it links to. In a first pass all sets give a prefix lengthened a little; those that share fewer than l of its
    tokens with any other are out. The others give their longest prefix; a token that only one of them has is
    forgotten, the rest come back with the number of sets that have them. Each document then chooses l by the
    cost of its candidates: for a longer prefix more tokens must be shared, so l - 1 of the most frequent ones need not be
    looked up, and a set with fewer than l such tokens is out. What is looked up gives candidates, which
    are verified on whole sets.

    A group of near copies has more pairs than can be listed, so candidates come in two rounds. First each document
    meets two leaders at most: of a few sets of like size with one of its first tokens, the one most like it, and the
    first. That joins most of each group at a cost in proportion to documents. Then all pairs of fitting size that share a looked-up token and whose components still differ are verified, so no link between components is lost, and none
    inside one is needed. Candidates, sets and prefixes travel as arrays, dealt by hashes of tokens or classes. A task
    holds the list of a token, some 30 bytes for each different set that has it. What is broadcast is a bitmap of
    fixed size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, n = [None] * len(batch), np.zeros(len(batch), dtype=np.int64)
            for r, s in shingle_sets(batch.column("text"), words):
                of[r], n[r] = _class_of(s), len(s)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(of, pa.int64()), pa.array(n)], names=["id", "class", "n"])

    base = cut(rows.mapInArrow(sizes, f"id {kind}, class long, n long"), "ngram-sizes")
    classes = base.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("low"), F.max("n").alias("n"))
    classes = cut(classes.withColumn("slot", _slot(F.col("low"))), "ngram-classes")
    buckets = max(256, (classes.agg(F.sum("n")).first()[0] or 0) // 400_000)
    dealt = classes.select("class", "n", "slot", F.pmod("class", F.lit(buckets)).cast("int").alias("bucket"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen, out = set(), _Sent(buckets)
        for batch in batches:
            for _, s in shingle_sets(batch.column("text"), words):
                if (c := _class_of(s)) not in seen:
                    if len(seen) > 100_000:  # a class sent twice does no harm
                        seen.clear()
                    seen.add(c)
                    yield from out.add(c, s[: len(s) - _needed(len(s), percent) + _length(len(s), FIRST)])
        yield from out.flushed()

    def first_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("owner", pa.binary())])
        for rows in first(batches):
            yield pa.RecordBatch.from_pandas(rows[kinds.names], schema=kinds, preserve_index=False)

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        token, owner = _joined(rows, "token", np.uint32), _joined(rows, "owner", np.int64)
        keep, df = _in_several(token, owner)
        owner = owner[keep][df > 1]
        return pd.concat([_empty(["bucket", "owner"]), *_dealt(owner % buckets, owner=owner)])

    def several(reply: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        owner, count = np.unique(_joined(reply, "owner", np.int64), return_counts=True)
        at = np.searchsorted(owner, known["class"].to_numpy(np.int64)).clip(max=max(0, len(owner) - 1))
        has = (owner[at] == known["class"].to_numpy(np.int64)) if len(owner) else np.zeros(len(known), dtype=bool)
        enough = [h and count[k] >= _length(n, FIRST) for h, k, n in zip(has, at, known["n"], strict=True)]
        return known[np.array(enough, dtype=bool)]

    reply = rows.select("text").mapInArrow(first_batches, "bucket int, token binary, owner binary").groupBy("bucket").applyInPandas(shared, "bucket int, owner binary")
    likely = cut(reply.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(several, "class long, n long, slot int, bucket int"), "ngram-some")

    wanted = spark.sparkContext.broadcast(_bitmap(likely))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, dtype=np.uint8)

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            heads = pa.array([s[:HEADS].view(np.int64) for s in held], pa.list_(pa.int64()))
            arrays = [pa.array([_class_of(s) for s in held], pa.int64()), pa.array([len(s) for s in held], pa.int64()), heads, pa.array([s.tobytes() for s in held], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["class", "n", "heads", "tokens"])

        for batch in batches:
            slot = batch.column("slot").to_numpy()
            ask = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            held, size = [], 0
            for _, s in shingle_sets(batch.column("text"), words, ask):
                held.append(s)
                size += len(s)
                if size > 500_000:
                    yield out(held)
                    held, size = [], 0
            yield out(held)

    # Of each wanted class the row of its smallest id; what the bitmap lets through beside is met by nobody.
    sets = cut(rows.select(_slot(F.col("id")).alias("slot"), "text").mapInArrow(whole_sets, "class long, n long, heads array<long>, tokens binary"), "ngram-sets")

    def longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Sent(buckets)
        for batch in batches:
            for c, s in zip(batch["class"].tolist(), batch["tokens"], strict=True):
                s = np.frombuffer(s, dtype=np.uint64)
                end = len(s) - _needed(len(s), percent) + _lengths(len(s))[-1]
                # Places are told in 256ths of the set, rounded down: a prefix then holds a token too many, never one too few.
                yield from out.add(c, s[:end], (np.arange(end) * 256 // len(s)).astype(np.uint8))
        yield from out.flushed()

    def shared_by(rows: pd.DataFrame) -> pd.DataFrame:
        token, owner, place = _joined(rows, "token", np.uint32), _joined(rows, "owner", np.int64), _joined(rows, "place", np.uint8)
        keep, df = _in_several(token, owner)
        keep, df = keep[df > 1], df[df > 1]
        token = (token[keep].astype(np.uint64) << np.uint64(32)) | np.uint64(rows["bucket"].iloc[0])
        return pd.concat([_empty(_REPLY), *_dealt(owner[keep] % buckets, owner=owner[keep], token=token, df=df.astype(np.int32), place=place[keep])])

    def choose(reply: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(reply) or not len(known):
            return _empty(_ENTRY)
        owner, token, df, place = (_joined(reply, c, k) for c, k in (("owner", np.int64), ("token", np.uint64), ("df", np.int32), ("place", np.uint8)))
        order = np.lexsort((token, df, owner))
        owner, token, df, place = owner[order], token[order], df[order], place[order]
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes, out = dict(zip(known["class"], known["n"], strict=True)), []
        for a, b in zip(start.tolist(), np.append(start[1:], len(owner)).tolist(), strict=True):
            if (n := sizes.get(owner[a])) is None:
                continue  # let through by the bitmap
            best, low = None, place[a:b].astype(np.int64) * n // 256
            for need in _lengths(n):
                at = np.flatnonzero(low < n - _needed(n, percent) + need)
                if len(at) < need:
                    best = None
                    break  # by the lemma it links with nothing
                at = at[: len(at) - need + 1]  # rarest first
                cost = int(df[a:b][at].sum())
                if best is None or cost < best[0]:
                    best = cost, at, _lengths(n).index(need)
            if best is not None:
                probe = np.zeros(b - a, dtype=np.uint8)
                probe[best[1]] = 1
                out.append((int(reply["bucket"].iloc[0]), int(owner[a]), n, best[2], token[a:b].tobytes(), probe.tobytes(), place[a:b].tobytes()))
        return pd.DataFrame(out, columns=_ENTRY).astype({"bucket": "int32"}) if out else _empty(_ENTRY)

    sent = sets.mapInPandas(longest, "bucket int, token binary, owner binary, place binary")
    reply = sent.groupBy("bucket").applyInPandas(shared_by, "bucket int, owner binary, token binary, df binary, place binary")
    entries = reply.groupBy("bucket").cogroup(likely.groupBy("bucket")).applyInPandas(choose, "bucket int, class long, n long, need long, token binary, probe binary, place binary")
    entries = cut(entries, "ngram-entries")

    # What the bitmap let through or the lemma put out has no entry.
    able = entries.select("class")
    heads = sets.select("class", "n", "heads").join(F.broadcast(able) if able.count() * 16 <= BROADCAST_BYTES else able, "class", "left_semi")
    led = cut(_led(heads), "ngram-led")
    to = F.pmod("class", F.lit(buckets)).cast("int")
    asked = led.groupBy(F.pmod("y", F.lit(buckets)).cast("int").alias("bucket"), "x").agg(F.collect_list("y").alias("ys"))
    links = cut(_compared(asked, sets.select("class", "tokens", to.alias("bucket")), percent), "ngram-links")
    label = components(links)

    homes = cut(_homes(able, led, label, buckets), "ngram-homes")
    asked = _requests(_candidates(entries, homes, buckets, percent))
    last = _compared(asked, sets.join(homes.select("class", F.col("block").alias("bucket")), "class").select("class", "tokens", "bucket"), percent)
    every = cut(last.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))), "ngram-links")
    for used in (likely, sets, entries, led, homes, links):
        drop_cut(used)
    links = every
    label = components(links)

    classes = classes.join(label, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("component", "class").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "component").select(F.col("class").alias("_class"), "component_id")
    out = base.join(named, F.col("class") == F.col("_class"), "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that are the first of their class by id; rows without words all stay. Ids should be unique:
    rows that repeat the first id all stay, and every row goes whose id a later member of a class has, whatever its own text."""
    found = link_classes(docs, id, text, words, percent).where(F.col(id) != F.col("component_id")).select(F.col(id).alias("_gone")).distinct()
    return docs.join(found, F.col(id) == F.col("_gone"), "left_anti")


_REPLY = ["bucket", "owner", "token", "df", "place"]
_ENTRY = ["bucket", "class", "n", "need", "token", "probe", "place"]
#: What a token's bucket learns of each set that has the token, and its type.
_KINDS = {"token": np.uint32, "owner": np.int64, "probe": np.uint8, "place": np.uint8, "size": np.int32, "need": np.uint8, "component": np.int64, "block": np.int32}


def _empty(columns: list[str]) -> pd.DataFrame:
    kinds = {"bucket": "int32", "class": "int64", "n": "int64", "need": "int64"}
    return pd.DataFrame({c: pd.Series(dtype=kinds.get(c, object)) for c in columns})


def _slot(id):
    return F.pmod(F.xxhash64(id), F.lit(_BITS)).cast("int")


def _joined(rows: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), dtype=kind)


def _dealt(bucket: np.ndarray, **arrays: np.ndarray) -> Iterator[pd.DataFrame]:
    """One row for each bucket: what goes there, as bytes."""
    if not len(bucket):
        return
    bucket = bucket.astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    spans = list(zip(at.tolist(), np.append(at[1:], len(order)).tolist(), strict=True))
    out = {"bucket": bucket[at]}
    for name, values in arrays.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in spans]
    yield pd.DataFrame(out)


class _Sent:
    """Prefix tokens on their way to the buckets of tokens, so many at a time.

    Within a bucket a token's upper half tells it apart as well as all of it does.
    """

    def __init__(self, buckets: int, limit: int = 250_000) -> None:
        self.buckets, self.limit = np.uint64(buckets), limit
        self.tokens: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, owner: int, tokens: np.ndarray, place: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        self.tokens.append(tokens)
        self.owners.append(np.full(len(tokens), owner, dtype=np.int64))
        self.places += [] if place is None else [place]
        self.held += len(tokens)
        if self.held > self.limit:
            yield from self.flushed()

    def flushed(self) -> Iterator[pd.DataFrame]:
        if self.held:
            token, owner = np.concatenate(self.tokens), np.concatenate(self.owners)
            place = {"place": np.concatenate(self.places)} if self.places else {}
            self.tokens, self.owners, self.places, self.held = [], [], [], 0
            yield from _dealt(token % self.buckets, token=(token >> np.uint64(32)).astype(np.uint32), owner=owner, **place)


def _in_several(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different (token, owner), by token, and how many owners each one's token has."""
    order = np.lexsort((owner, token))
    t, o = token[order], owner[order]
    order = order[np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))] if len(order) else order
    _, run, size = np.unique(token[order], return_inverse=True, return_counts=True)
    return order, size[run]


def _bitmap(entries: DataFrame) -> bytes:
    """Which slots the rows of the classes of ``entries`` fall into."""
    wide = _BITS // _PIECES // 8

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(_BITS, dtype=bool)
        for batch in batches:
            bits[batch["slot"].to_numpy()] = True
        packed = np.packbits(bits, bitorder="little").reshape(_PIECES, wide)
        used = np.flatnonzero(packed.any(axis=1))
        yield pd.DataFrame({"piece": used.astype(np.int32), "bits": [packed[k].tobytes() for k in used]})

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in rows["bits"]])
        return rows.iloc[:1].assign(bits=[total.tobytes()])

    out = bytearray(_BITS // 8)
    for r in entries.select("slot").mapInPandas(slots, "piece int, bits binary").groupBy("piece").applyInPandas(either, "piece int, bits binary").collect():  # 64 rows of 32 kB
        out[r["piece"] * wide : (r["piece"] + 1) * wide] = r["bits"]
    return bytes(out)


def _led(heads: DataFrame) -> DataFrame:
    """(y, x, first): sets y with the leaders x that they meet, and whether x is the first of them by hash.

    Leaders of a token are those sets with the token among their first ``MEETINGS`` that come first by each of ``LEADERS``
    hashes, within a band of sizes. Of the leaders of its tokens a set takes the first by each hash, and of these the one
    with most of its own ``HEADS`` tokens and the first one, which ties together the followers of different ones, if they
    have half of them: two meetings at most for each set, however large its group.
    Bands are of a factor of 4/3, once from 1 on and once half a band further, so that like sizes meet in one of the two.
    """
    band, each = F.log("n") / F.log(F.lit(4 / 3)), [f"l{k}" for k in range(LEADERS)]
    asks = heads.select("class", F.array(F.floor(band), -1 - F.floor(band + 0.5)).alias("bands"), F.explode(F.slice("heads", 1, MEETINGS)).alias("token")).select("class", "token", F.explode("bands").alias("band"))
    key = [F.min(F.struct(F.xxhash64(F.lit(k), "class").alias("h"), F.col("class").alias("x"))).alias(c) for k, c in enumerate(each)]
    leaders = asks.groupBy("token", "band").agg(*key, F.count("*").alias("some")).where("some > 1").drop("some")
    own = asks.join(leaders, ["token", "band"]).groupBy("class").agg(*[F.min(c).alias(c) for c in each])
    pairs = own.select(F.col("class").alias("y"), F.posexplode(F.array_distinct(F.array(*[f"{c}.x" for c in each]))).alias("k", "x")).where("x <> y")
    mine = heads.select(F.col("class").alias("y"), F.col("heads").alias("hy"))
    theirs = heads.select(F.col("class").alias("x"), F.col("heads").alias("hx"))
    pairs = pairs.join(mine, "y").join(theirs, "x").withColumn("same", F.size(F.array_intersect("hx", "hy"))).where(F.col("same") * 2 >= F.greatest(F.size("hx"), F.size("hy")))
    pairs = pairs.groupBy("y").agg(F.max(F.struct("same", "x")).alias("best"), F.min(F.struct("k", "x")).alias("first"))
    return pairs.select("y", F.col("first.x").alias("home"), F.explode(F.array_distinct(F.array("best.x", "first.x"))).alias("x")).select("y", "x", (F.col("x") == F.col("home")).alias("first"))


def _homes(able: DataFrame, led: DataFrame, label: DataFrame, buckets: int) -> DataFrame:
    """(class, component, block, bucket) of every set: where it is compared, and by which task it is looked up.

    Sets with one first leader are compared in one block, so that a set goes once to all of its group. A group of more than
    ``BLOCK`` has as many blocks as that takes.
    """
    first = led.where("first").select(F.col("y").alias("class"), F.col("x").alias("home"))
    homes = able.join(first, "class", "left").withColumn("home", F.coalesce("home", "class"))
    large = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
    homes = homes.join(large, "home", "left").join(label.withColumnRenamed("node", "class"), "class", "left")
    part = F.pmod(F.xxhash64(F.lit(7), "class"), F.coalesce("parts", F.lit(1)))
    block = F.pmod(F.xxhash64("home", part), F.lit(buckets)).cast("int")
    return homes.select("class", F.coalesce("component", "class").alias("component"), block.alias("block"), F.pmod("class", F.lit(buckets)).cast("int").alias("bucket"))


def _candidates(entries: DataFrame, homes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(bucket, x, y): arrays of classes to be compared, of different components, dealt by the block of y."""

    def by_token(entries: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        if not len(entries):
            return _empty(["bucket", *_KINDS])
        token, probe, place = (_joined(entries, c, k) for c, k in (("token", np.uint64), ("probe", np.uint8), ("place", np.uint8)))
        each, classes = [len(x) for x in entries["probe"]], entries["class"].to_numpy(np.int64)
        homes = homes.sort_values("class")
        at = np.searchsorted(homes["class"].to_numpy(np.int64), classes)
        whole = {"owner": classes, "size": entries["n"].to_numpy(np.int32), "need": entries["need"].to_numpy(np.uint8), "component": homes["component"].to_numpy(np.int64)[at], "block": homes["block"].to_numpy(np.int32)[at]}
        every = {"token": (token >> np.uint64(32)).astype(np.uint32), "probe": probe, "place": place} | {c: np.repeat(x, each) for c, x in whole.items()}
        return pd.concat(_dealt(token & _LOW32, **{c: every[c] for c in _KINDS}))

    def across(token, owner, probe, component, size, need, place, block) -> Iterator[pd.DataFrame]:
        """All pairs of fitting size of different components, in frames of bounded size.

        A pair needs more overlap than either set alone: its token must stand in prefixes shortened by that. Where many of a
        list are in one block, sets meet that block as a whole, which names no pairs.
        """
        low = place * size // 256
        _, run = np.unique(token, return_inverse=True)
        least, most = _needed(size, percent), 100 * size // percent
        asks = np.flatnonzero(probe > 0)
        asks = asks[np.argsort(run[asks], kind="stable")]
        ask_run = run[asks]
        order = np.lexsort((block, run))
        at = np.flatnonzero(np.append(True, (np.diff(run[order]) != 0) | (np.diff(block[order]) != 0)))
        width = np.diff(np.append(at, len(order)))
        alone = np.sort(order[np.repeat(width < DENSE, width)])
        x, y = [asks[:0]], [block[:0]]
        for start, n in zip(at[width >= DENSE].tolist(), width[width >= DENSE].tolist(), strict=True):
            one = order[start : start + n]
            mine = asks[np.searchsorted(ask_run, run[one[0]]) : np.searchsorted(ask_run, run[one[0]], "right")]
            mine = mine[(least[mine] <= size[one].max()) & (most[mine] >= size[one].min())]
            low_of, high_of = component[one].min(), component[one].max()
            mine = mine[(component[mine] != low_of) | (component[mine] != high_of)]
            x.append(mine)
            y.append(np.full(len(mine), block[one[0]], dtype=np.int32))
        x, to = _different(owner[np.concatenate(x)], np.concatenate(y))
        yield from _dealt(to, x=x, y=np.full(len(x), ALL))
        # Those of one component in a token's list: large ones are met one by one, so that none meets itself.
        order = alone[np.lexsort((size[alone], component[alone], run[alone]))]
        at = np.flatnonzero(np.append(True, (np.diff(run[order]) != 0) | (np.diff(component[order]) != 0))) if len(order) else order
        width = np.diff(np.append(at, len(order)))
        little = order[np.repeat(width <= 32, width)]
        little = little[np.lexsort((size[little], run[little]))]
        key = run[little] * (1 << 40) + size[little]
        a, b = np.searchsorted(key, run[asks] * (1 << 40) + least[asks]), np.searchsorted(key, run[asks] * (1 << 40) + most[asks], "right")

        def fit(who: np.ndarray, other: np.ndarray) -> np.ndarray:
            n, m = size[who], size[other]
            spare = need[who] - -(-percent * (n + m) // (100 + percent))
            return (component[who] != component[other]) & (low[who] < n + spare) & (low[other] < m + spare)

        found = _Found(owner, block, fit)
        yield from found.ranges(asks, a, b, little)
        for start, n in zip(at[width > 32].tolist(), width[width > 32].tolist(), strict=True):
            one = order[start : start + n]
            mine = asks[np.searchsorted(ask_run, run[one[0]]) : np.searchsorted(ask_run, run[one[0]], "right")]
            mine = mine[component[mine] != component[one[0]]]
            a, b = np.searchsorted(size[one], least[mine]), np.searchsorted(size[one], most[mine], "right")
            yield from found.ranges(mine, a, b, one)
        yield from found.flushed()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _by_bucket(batches):
            columns = {c: _joined(rows, c, k) for c, k in _KINDS.items()}
            columns |= {c: columns[c].astype(np.int64) for c in ("size", "place")}
            columns["need"] = np.maximum(1, np.ceil(np.array(LENGTHS)[columns["need"]] * columns["size"])).astype(np.int64)
            yield from across(**columns)

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in _KINDS)
    sent = entries.groupBy("bucket").cogroup(homes.groupBy("bucket")).applyInPandas(by_token, schema)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(pairs, "bucket int, x binary, y binary")


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each bucket of a partition that is sorted by bucket."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for bucket, rows in batch.groupby("bucket", sort=False):
            if held and held[0]["bucket"].iloc[0] != bucket:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (a, b), by a."""
    names, x = np.unique(a, return_inverse=True)
    others, y = np.unique(b, return_inverse=True)
    key = np.unique((x << 32) | y)
    return names[key >> 32], others[key & 0xFFFFFFFF]


class _Found:
    """Pairs of classes as they come, those met again soon left out; what goes out is bounded at a time."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, fit, limit: int = 500_000) -> None:
        self.fit, self.limit = fit, limit
        self.names, at, self.code = np.unique(owner, return_index=True, return_inverse=True)
        self.block = block[at]
        self.keys: list[np.ndarray] = []
        self.held = 0

    def ranges(self, asks: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        """Each of ``asks`` with those of the rows from a to b that fit, so many pairs at a time."""
        some = b > a
        asks, a, n = asks[some], a[some], (b - a)[some]
        end = np.cumsum(n)
        i = 0
        while i < len(asks):
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + self.limit)))
            m = n[i:j]
            at = np.arange(m.sum()) + np.repeat(a[i:j] - np.append(0, np.cumsum(m)[:-1]), m)
            who, other = np.repeat(asks[i:j], m), rows[at]
            good = self.fit(who, other)
            x, y = self.code[who[good]], self.code[other[good]]
            self.keys.append(np.unique((np.minimum(x, y) << 32) | np.maximum(x, y)))
            self.held += len(self.keys[-1])
            if self.held > 2 * self.limit:
                self.keys = [np.unique(np.concatenate(self.keys))]
                self.held = len(self.keys[0])
                if self.held > self.limit:
                    yield from self.flushed()
            i = j

    def flushed(self) -> Iterator[pd.DataFrame]:
        key = np.unique(np.concatenate(self.keys)) if self.keys else np.zeros(0, dtype=np.int64)
        self.keys, self.held = [], 0
        x, y = key >> 32, key & 0xFFFFFFFF
        yield from _dealt(self.block[y], x=self.names[x], y=self.names[y])


def _requests(candidates: DataFrame) -> DataFrame:
    """(bucket, x, ys) of candidates (bucket, x, y): what each x is to be compared with in a bucket, once, or ALL alone."""

    def requests(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _different(_joined(rows, "x", np.int64), _joined(rows, "y", np.int64))
        at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=int)
        ys = [k[:1] if k[0] == ALL else k for k in np.split(y, at[1:])] if len(at) else []
        return pd.DataFrame({"bucket": np.int32(rows["bucket"].iloc[0]), "x": x[at], "ys": ys})

    return candidates.groupBy("bucket").applyInPandas(requests, "bucket int, x long, ys array<long>")


def _classes_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"class": np.unique(np.concatenate([batch["x"].to_numpy(np.int64), *batch["ys"]]))})


def _compared(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links among those asked for, (bucket, x, ys). Sets (class, tokens, bucket) come to the bucket
    of y: that of each y once, that of x once for each bucket with candidates; those that nobody asks for stay where they are."""
    asked = cut(asked, "ngram-asked")
    whole = asked.where(F.array_contains("ys", ALL)).select("bucket").distinct()
    met = asked.mapInPandas(_classes_in, "class long").union(sets.select("class", "bucket").join(whole, "bucket", "left_semi").select("class"))
    met = cut(met.distinct(), "ngram-met")
    sets = sets.join(F.broadcast(met) if met.count() * 16 <= BROADCAST_BYTES else met, "class", "left_semi")
    asked = asked.join(sets.select(F.col("class").alias("x"), F.col("tokens").alias("xs")), "x")

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        held = held.sort_values("class")
        size = np.array([len(t) // 8 for t in held["tokens"]], dtype=np.int64)
        for _, part in held.groupby(np.cumsum(size) // 1_000_000 if len(asked) else size, sort=False):  # so many tokens at a time
            block = _Block(part["class"].to_numpy(np.int64), [np.frombuffer(t, dtype=np.uint64) for t in part["tokens"]])
            for x, xs, ys in zip(asked["x"], asked["xs"], asked["ys"], strict=True):
                y = block.linked(np.frombuffer(xs, dtype=np.uint64), ys, percent)
                a.append(np.full(len(y), x, dtype=np.int64))
                b.append(y)
        x, y = stars(np.concatenate(a), np.concatenate(b))  # what they connect, in at most one edge for each class
        return pd.DataFrame({"a": x, "b": y})

    return asked.groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInPandas(compare, "a long, b long")


class _Block:
    """Sets that others are compared with: one by one, or if many are asked for, by the owners of each token."""

    def __init__(self, classes: np.ndarray, sets: list[np.ndarray]) -> None:
        self.classes, self.sets, self.size = classes, sets, np.array([len(s) for s in sets], dtype=np.int64)
        self.token: np.ndarray | None = None

    def linked(self, s: np.ndarray, ys: np.ndarray, percent: int) -> np.ndarray:
        """Those of the classes ``ys`` that are in the block and link with the set ``s``."""
        at = np.searchsorted(self.classes, ys).clip(max=len(self.classes) - 1)
        at = at[self.classes[at] == ys] if ALL not in ys else np.arange(len(self.classes))
        at = at[100 * np.minimum(self.size[at], len(s)) >= percent * np.maximum(self.size[at], len(s))]
        same = self._by_owner(s)[at] if len(at) > 8 else np.array([_common(s, self.sets[k]) for k in at], dtype=np.int64)
        return self.classes[at[100 * same >= percent * (len(s) + self.size[at] - same)]]

    def _by_owner(self, s: np.ndarray) -> np.ndarray:
        """How many tokens of ``s`` each set of the block has."""
        if self.token is None:
            token = np.concatenate(self.sets)
            order = np.argsort(token, kind="stable")
            self.token, self.owner = token[order], np.repeat(np.arange(len(self.sets)), self.size)[order]
        a, b = np.searchsorted(self.token, s), np.searchsorted(self.token, s, "right")
        n = b - a
        return np.bincount(self.owner[np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)], minlength=len(self.sets))


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """How many tokens two sets share; the first is in order."""
    at = np.searchsorted(s, t)
    at[at == len(s)] = 0
    return int(np.count_nonzero(s[at] == t))
