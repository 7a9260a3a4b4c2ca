"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, calibrated by temperature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of one to three characters; counts of a bucket are what the model sees.
BITS = 16
SIZE = 1 << BITS
#: Code points read at a time, so that a very long text needs no more memory than a short one.
SLICE = 1 << 18
#: Code points below 128 that are no letters are read as a space.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole text between spaces, slice by slice."""
    text = f" {text.lower()} "
    for at in range(0, len(text), SLICE):
        # Two characters more, so that n-grams over the edge are read once.
        c = np.frombuffer(text[at : at + SLICE + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = c < 128
        c = np.where(low, _ASCII[np.where(low, c, 0)], c)
        n = min(SLICE, len(text) - at)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        one = c[:n] * np.uint32(0x165667B1)
        yield np.concatenate([one, two[:n], three[:n]]) >> np.uint32(32 - BITS)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often each occurs."""
    count = np.zeros(SIZE, dtype=np.int64)
    for g in _grams(text):
        count += np.bincount(g, minlength=SIZE)
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray  # (SIZE,)
    weights: np.ndarray  # (SIZE, labels)
    bias: np.ndarray
    temperature: float = 1.0
    scale: float = 40.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"idf": None, "weights": None}  # tasks need what is ready only

    def __post_init__(self) -> None:
        self.ready = (self.weights * (self.idf * self.scale)[:, None]).astype(np.float32)

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for g in _grams(text):
            # Gathered in pieces that stay in the cache.
            for k in range(0, len(g), 1 << 13):
                total += self.ready[g[k : k + (1 << 13)]].sum(axis=0)
            n += len(g)
        return total / max(1, n) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader (proximal) with L1 and L2 penalties.

    rows: buckets, values and class of each document.
    """
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy on documents that the logits' model hasn't seen.

    Targets are smoothed as Platt's are: of n documents and K labels the right label has (n + 1) / (n + K), each other one
    1 / (n + K), so that documents told apart without an error don't drive it to 0. The loss is convex
    in 1 / T; a golden-section search on its logarithm finds the least.
    """
    n, labels = logits.shape
    target = np.full((n, labels), 1.0 / (n + labels))
    target[np.arange(n), y] = (n + 1.0) / (n + labels)

    def loss(log_beta: float) -> float:
        z = logits * np.exp(log_beta)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

    low, high, ratio = -10.0, 10.0, (np.sqrt(5.0) - 1) / 2
    while high - low > 1e-6:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp(-(low + high) / 2))


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000, most: int = 500) -> Model:
    """A model of the rows of ``docs`` whose label is not null and that are not held out.

    Document frequencies come from all those rows: each task adds up one count for each of the 65,536 buckets,
    and the counts of tasks are added by ranges of buckets. The classifier itself is fitted on a bounded sample of
    about ``sample`` labelled rows, as many of each label, chosen by a hash of id. The temperature comes from models of
    either half of the sample and their logits on the other half. Rows with null text or without letters teach nothing. Without any labelled row the
    model has no labels; more than ``most`` labels are refused, as the model (256 kB for each) is broadcast. Repeated rows count as often
    as they stand there; other columns are ignored.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id))).select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    labels = sorted(counts)
    if len(labels) > most:
        raise ValueError(f"{len(labels)} labels; at most {most}")
    if not labels:
        return Model([], np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0))
    parts = usable.select("text").mapInPandas(_document_counts, "chunk int, n long, df binary")
    df, total = np.zeros(SIZE), 0
    for r in parts.groupBy("chunk").applyInPandas(_add_counts, "chunk int, n long, df binary").collect():  # 64 rows of 8 kB
        got = np.frombuffer(r["df"], dtype=np.int64)
        df[r["chunk"] * len(got) : (r["chunk"] + 1) * len(got)] = got
        total = r["n"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    per = max(1, sample // len(labels))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, per / counts[name]))) for name in labels])
    chance = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(chance < share).mapInPandas(_sparse_rows, "lang string, at binary, count binary, fold long")
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for r in chosen.orderBy("fold").limit(2 * sample).collect():  # about ``sample`` rows by the share; the limit bounds them
        at, count = np.frombuffer(r["at"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["count"], dtype=np.uint32)
        rows.append((at, count / count.sum() * idf[at] * Model.scale, labels.index(r["lang"])))
    model = Model(labels, idf, *ftrl(rows, len(labels)))
    halves = rows[::2], rows[1::2]
    if min(map(len, halves)) >= len(labels) > 1:
        logits = [x @ w[at] + b for one, other in (halves, halves[::-1]) for w, b in [ftrl(one, len(labels))] for at, x, _ in other]
        model.temperature = temperature(np.stack(logits), np.array([y for *_, y in (*halves[1], *halves[0])]))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of those names.

    lang_pred is ``und`` with score 0 if the text is null, has no letter, or the model has no label; else the label
    of highest probability, the first in order if several tie, and score is its calibrated probability. Repeated
    rows get equal answers. The model (256 kB for each label) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = [known.predict(x) if x is not None and known.labels and any(map(str.isalpha, x)) else ("und", 0.0) for x in batch]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    got = docs.drop("lang_pred", "score").withColumn("_lang", of(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in got.columns if c != "_lang"], F.col("_lang.lang_pred"), F.col("_lang.score"))


def keep_known(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``, columns as they were."""
    out = predict(docs.withColumnsRenamed({"lang_pred": "_lang_pred", "score": "_score"}), fit(docs, id, text, lang), text)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score").withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"})


_CHUNKS = 64


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n, seen = np.zeros(SIZE, dtype=np.int64), 0, np.zeros(SIZE, dtype=bool)
    for batch in batches:
        for text in batch["text"]:
            for g in _grams(text):
                seen[g] = True
            df += seen
            seen[:] = False
        n += len(batch)
    width = SIZE // _CHUNKS
    yield pd.DataFrame({"chunk": np.arange(_CHUNKS, dtype=np.int32), "n": n, "df": [df[k * width : (k + 1) * width].tobytes() for k in range(_CHUNKS)]})


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.int64) for x in rows["df"])
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "n": [int(rows["n"].sum())], "df": [total.tobytes()]})


def _sparse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for id, text, lang in zip(batch["id"], batch["text"], batch["lang"], strict=True):
            if any(map(str.isalpha, text)):
                at, count = sparse(text)
                fold = int.from_bytes(hashlib.blake2b(str(id).encode(), digest_size=6).digest(), "big")
                out.append((lang, at.astype(np.uint16).tobytes(), count.astype(np.uint32).tobytes(), fold))
        yield pd.DataFrame(out, columns=["lang", "at", "count", "fold"])
