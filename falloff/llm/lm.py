"""Language-model scores of documents: online logistic mixing of context predictors over counts of the whole corpus."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.llm import mixer
from falloff.llm.common import cut

#: Bytes of text that a task counts or scores at a time, and characters of a text read at a time.
PART, SLICE = 8 << 20, 4 << 20
#: A-Z are lower-cased and white space is a space.
_PLAIN = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What ends a text; it can't be in a word.
END = b"\n"
_BLOB = "kind int, bucket int, part int, names binary, values binary"


def pack(x: np.ndarray) -> bytes:
    """Bytes of ``x`` by significance, compressed."""
    return zlib.compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes(), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def slices(text: bytes | None) -> Iterator[tuple[list[bytes], bytes]]:
    """A text's words slice by slice, and the slice as it is scored: five bytes of context, then words each with a space, at last the end."""
    plain = (text or b"").translate(_PLAIN)
    at, before = 0, END * mixer.ORDER
    while True:
        stop = len(plain)
        if stop - at > SLICE:
            cut_at = plain.rfind(b" ", at + 1, at + SLICE)
            cut_at = plain.find(b" ", at + SLICE) if cut_at < 0 else cut_at
            stop = stop if cut_at < 0 else cut_at
        words = plain[at:stop].split()
        last = stop == len(plain)
        data = before + b"".join([w + b" " for w in words]) + (END if last else b"")
        yield [*words, END] if last else words, data
        if last:
            return
        at, before = stop, data[-mixer.ORDER :]


def joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the scored bytes of the segments, and where each segment's begin."""
    lengths = np.array([len(s) for s in segments])
    starts = np.cumsum(lengths) - lengths
    keep = np.ones(lengths.sum(), dtype=bool)
    for k in range(mixer.ORDER):
        keep[starts + k] = False
    return mixer.grams(np.frombuffer(b"".join(segments), dtype=np.uint8))[keep[mixer.ORDER :]], starts - mixer.ORDER * np.arange(len(segments))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams with the same two nearest bytes share a bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(40503) & np.uint64(0xFFFFFF)) % np.uint64(buckets)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the sums of their counts (a row for each fold)."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], mixer.runs(keys[order])
    return keys[at], np.add.reduceat(counts[:, order], at, axis=1) if len(at) else counts


def _counted(segments: list[bytes], folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    keys, starts = joined(segments)
    fold = np.repeat(np.array(folds, dtype=np.uint64), np.diff(np.append(starts, len(keys))))
    both = keys << np.uint64(3) | fold
    both.sort()
    at = mixer.runs(both)
    n, fold, keys = np.diff(np.append(at, len(both))), (both[at] & np.uint64(7)).astype(int), both[at] >> np.uint64(3)
    first = mixer.runs(keys)
    counts = np.zeros((mixer.FOLDS + 1, len(first)), dtype=np.int64)
    counts[fold, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))] = n
    return keys[first], counts[:-1]


def _count(buckets: int):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        """Different grams and words of a part with their counts in training texts: grams by fold; 0 for what only other texts have."""
        part, words, others = int(rows["part"].iloc[0]), Counter(), set()
        segments, folds, held, grams = [], [], 0, []
        for text, fold in zip(rows["text"], rows["fold"], strict=True):
            for some, data in slices(text):
                words.update(some) if fold < mixer.FOLDS else others.update(some)
                segments.append(data)
                folds.append(fold)
                held += len(data)
                if held > PART:
                    grams.append(_counted(segments, folds))
                    segments, folds, held = [], [], 0
        if segments:
            grams.append(_counted(segments, folds))
        keys, counts = grams[0] if len(grams) == 1 else merged(np.concatenate([k for k, _ in grams]), np.concatenate([c for _, c in grams], axis=1))
        to, out = bucket_of(keys, buckets), []
        for b in range(buckets):
            mine = to == b
            if mine.any():
                out.append((0, b, part, pack(np.diff(keys[mine], prepend=np.uint64(0))), pack(counts[:, mine].astype(np.uint32).ravel())))
        by: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in others - words.keys():
            words[w] = 0
        for w in words:
            by[zlib.crc32(w) % buckets].append(w)
        for b, mine in enumerate(by):
            if mine:
                mine.sort()
                out.append((1, b, part, zlib.compress(b" ".join(mine), 1), pack(np.array([words[w] for w in mine], dtype=np.int64))))
        return pd.DataFrame(out, columns=["kind", "bucket", "part", "names", "values"])

    return of


def _keys(names: bytes) -> np.ndarray:
    return np.cumsum(unpack(names, np.uint64), dtype=np.uint64)


def _all_grams(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's grams over all parts, with counts by fold."""
    keys, counts = [], []
    for names, values in zip(rows["names"], rows["values"], strict=True):
        keys.append(_keys(names))
        counts.append(unpack(values, np.uint32).reshape(mixer.FOLDS, -1).astype(np.int64))
    keys, counts = merged(np.concatenate(keys), np.concatenate(counts, axis=1))
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "names": [pack(np.diff(keys, prepend=np.uint64(0)))], "values": [pack(counts.ravel())]})


def _all_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of a bucket's words over all parts, for each part in the order it names them; and how many are known, and their sum."""
    total: Counter = Counter()
    for names, values in zip(rows["names"], rows["values"], strict=True):
        for w, n in zip(zlib.decompress(names).split(b" "), unpack(values, np.int64).tolist(), strict=True):
            total[w] += n
    out = [(1, b, part, names, pack(np.array([total[w] for w in zlib.decompress(names).split(b" ")], dtype=np.int64))) for b, part, names in zip(rows["bucket"], rows["part"], rows["names"], strict=True)]
    known = np.array([sum(n > 0 for n in total.values()), sum(total.values())], dtype=np.int64)
    return pd.DataFrame([*out, (2, int(rows["bucket"].iloc[0]), -1, b"", pack(known))], columns=["kind", "bucket", "part", "names", "values"])


def _read(row: pd.Series) -> tuple[mixer.Slots, np.ndarray]:
    keys = _keys(row["names"])
    return mixer.Slots(keys), unpack(row["values"], np.int64).reshape(mixer.FOLDS, len(keys)).astype(float)


def _cells(**tables: np.ndarray) -> pd.DataFrame:
    parts = [pd.DataFrame({"name": k, "at": np.flatnonzero(v), "value": v.ravel()[np.flatnonzero(v)].astype(float)}) for k, v in tables.items()]
    return pd.concat(parts, ignore_index=True)


def _near_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for _, row in rows.iterrows():
            slots, counts = _read(row)
            yield _cells(**{str(f): np.bincount(slots.near, weights=c, minlength=65536) for f, c in enumerate(counts)})


def _lessons(near: np.ndarray, weights: mixer.Weights, step: str):
    """Learn the weights, or count what came of probabilities, on a bucket: each fold by counts of the others."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, row in rows.iterrows():
                slots, counts = _read(row)
                w = mixer.Weights(weights.a.copy(), weights.b.copy(), np.zeros_like(weights.ones), np.zeros_like(weights.all))
                rng, so_far, bit = np.random.default_rng(int(row["bucket"])), *slots.bits()
                for f in range(mixer.FOLDS):
                    x, a, b = slots.inputs(counts.sum(axis=0) - counts[f], near.sum(axis=0) - near[f])
                    if step == "learn":
                        mixer.learn(w, x, a, b, counts[f], rng)
                    else:
                        mixer.observe(w, mixer.mixed(w, x, a, b), so_far, bit, counts[f])
                much = counts.sum()
                yield _cells(a=w.a * much, b=w.b * much, much=np.array([much])) if step == "learn" else _cells(ones=w.ones, all=w.all)

    return of


def _summed(cells: DataFrame, **shapes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Tables of fixed shapes from their cells, added up by Spark."""
    out = {k: np.zeros(int(np.prod(v))) for k, v in shapes.items()}
    for r in cells.groupBy("name", "at").agg(F.sum("value").alias("value")).collect():  # a row for each cell of the shapes
        out[r["name"]][r["at"]] = r["value"]
    return {k: v.reshape(shapes[k]) for k, v in out.items()}


def _answers(near: np.ndarray, weights: mixer.Weights):
    def of(all_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """log2 of the probabilities of a bucket's grams, for each part in the order it names them."""
        slots, counts = _read(all_.iloc[0])
        x, a, b = slots.inputs(counts.sum(axis=0), near.sum(axis=0))
        both = np.stack(mixer.log2p(weights, mixer.mixed(weights, x, a, b), *slots.bits())).astype(np.float32)
        out = [(0, bucket, part, names, both[:, np.searchsorted(slots.keys, _keys(names))].tobytes()) for bucket, part, names in zip(asked["bucket"], asked["part"], asked["names"], strict=True)]
        return pd.DataFrame(out, columns=["kind", "bucket", "part", "names", "values"])

    return of


class _Table:
    """Values of keys, found by a slot of their hash, by search where two share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.ascontiguousarray(values[:, order])
        self.shift = np.uint64(64 - max(10, int(len(keys) * 8).bit_length()))
        self.slot = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.slot[self._hash(self.keys)] = np.arange(len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[:, at]


def _score(id: str, distinct: int, total: int):
    def of(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Scores of a part's documents from the answers to its grams and words."""
        if docs.empty:
            return pd.DataFrame(columns=[id, "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])
        grams = answers[answers["kind"] == 0]
        keys, values = np.concatenate([_keys(x) for x in grams["names"]]), np.concatenate([np.frombuffer(x, dtype=np.float32).reshape(2, -1) for x in grams["values"]], axis=1)
        table, counts = _Table(keys, values), {}
        for names, n in zip(answers["names"][answers["kind"] == 1], answers["values"][answers["kind"] == 1], strict=True):
            counts.update(zip(zlib.decompress(names).split(b" "), unpack(n, np.int64).tolist(), strict=True))
        n = len(docs)
        tokens, known, logs, size, bits = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros((2, n))
        segments, owner, held = [], [], 0

        def flush() -> None:
            keys, starts = joined(segments)
            np.add.at(bits, (slice(None), owner), np.add.reduceat(table.of(keys).astype(np.float64), starts, axis=1))

        for k, text in enumerate(docs["text"]):
            for words, data in slices(text):
                if len(data) == mixer.ORDER:
                    continue
                c = np.array([counts[w] for w in words], dtype=np.int64)
                tokens[k] += len(c)
                known[k] += np.count_nonzero(c)
                logs[k] += np.log10(c + 1.0).sum()
                size[k] += len(data) - mixer.ORDER
                segments.append(data)
                owner.append(k)
                held += len(data)
                if held > PART // 4:
                    flush()
                    segments, owner, held = [], [], 0
        if segments:
            flush()
        score = (np.logaddexp2(bits[0], bits[1]) - 1) * np.log10(2)
        return pd.DataFrame({id: docs[id], "held_out": docs["fold"] >= mixer.FOLDS, "n_tokens": tokens, "n_known": known, "base_score": logs - tokens * np.log10(total + distinct + 1.0), "score": score, "n_bytes": size})

    return of


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", part: int = PART, weights: mixer.Weights | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of ``docs``.

    What is scored is a text in lower case (A-Z): its words, each with a space, and an end. The model predicts its bytes bit by bit.
    Predictors of orders 0 to 5 know how often either bit followed in their context in the texts where ``train`` holds; their stretched
    probabilities are added with weights chosen by how far the context is known and by the place in the byte. The weights are
    learned online, gram by gram, on each of three folds by counts of the two others, in every bucket, and averaged; then a
    table of what came of such probabilities refines them (given ``weights`` are used as they are). A text's probability is the Bayesian mixture of the mixer's and
    the refined one's, so each text leans, as it goes on, to the one that tells it better. base_score is the unigram score with add-one smoothing.

    Counts of grams and words grow with the corpus and stay in Spark: documents are dealt to parts of about ``part`` bytes, each part
    sends its different grams and words to buckets, where they are added up over all parts, and gets back the answers for those it
    named. Neither the driver nor a broadcast holds them; the driver has the weights and tables of fixed size (65,536 byte pairs).

    Null text is empty: its end alone. A null id isn't excluded from training by itself; a null ``train`` holds the row out. Repeated rows
    count as often as they stand there. Very long texts are read in slices. An empty table gives an empty table; without
    training rows all counts are 0. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id).alias(id), F.col(text).cast("binary").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    fold = F.when(F.col("_train"), F.pmod(F.xxhash64("_text"), F.lit(mixer.FOLDS))).otherwise(mixer.FOLDS).cast("int")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 1)).first()[0] or 0
    parts = max(8, -(-size // part))
    buckets = max(8, parts // 4)
    rows = rows.select(F.col(id), F.col("_text").alias("text"), fold.alias("fold"), F.pmod(F.xxhash64(F.col(id).cast("string"), "_text"), F.lit(parts)).cast("int").alias("part"))
    dealt = rows.repartition(parts, "part")
    blobs = cut(dealt.select("text", "fold", "part").groupBy("part").applyInPandas(_count(buckets), _BLOB), "lm-parts")
    asked = blobs.where("kind = 0").repartition(buckets, "bucket")
    grams = cut(asked.groupBy("bucket").applyInPandas(_all_grams, "bucket int, names binary, values binary"), "lm-grams")
    words = cut(blobs.where("kind = 1").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_all_words, _BLOB), "lm-words")
    known = [unpack(r["values"], np.int64) for r in words.where("kind = 2").select("values").collect()]  # one for each bucket
    distinct, total = (int(sum(x[k] for x in known)) for k in (0, 1))

    spread, schema = grams.repartition(buckets, "bucket"), "name string, at int, value double"
    near = np.stack([*_summed(spread.mapInPandas(_near_pairs, schema), **{str(f): (65536,) for f in range(mixer.FOLDS)}).values()])
    learned = weights is not None or not total
    weights = weights or mixer.Weights.start()
    if not learned:
        got = _summed(spread.mapInPandas(_lessons(near, weights, "learn"), schema), a=weights.a.shape, b=weights.b.shape, much=(1,))
        weights.a, weights.b = got["a"] / got["much"], got["b"] / got["much"]
        seen = _summed(spread.mapInPandas(_lessons(near, weights, "observe"), schema), ones=weights.ones.shape, all=weights.all.shape)
        weights.ones, weights.all = weights.ones + seen["ones"], weights.all + seen["all"]

    answers = spread.groupBy("bucket").cogroup(asked.select("bucket", "part", "names").groupBy("bucket")).applyInPandas(_answers(near, weights), _BLOB)
    answers = answers.unionByName(words.where("kind = 1")).repartition(parts, "part")
    kind = docs.schema[id].dataType.simpleString()
    out = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_score(id, distinct, total), f"`{id}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = F.col("score") / F.lit(-np.log10(2)) / F.col("n_bytes")
    return out.select(id, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
