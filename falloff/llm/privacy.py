"""Information-theoretic sanitisation: personal data by pattern, and the terms that reveal it by co-occurrence."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from falloff.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# Possessive and anchored forms of the base patterns: same matches, linear time on long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: A term is a word of letters, at least four, in lower case.
TERM = re.compile(r"[^\W\d_]{4,}")
#: What the share of an entity in the corpus weighs, in rows, beside the rows of a term (Krichevsky and Trofimov's half).
PRIOR = 0.5

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by kind as listed and then start; null text has none."""
    if not text:
        return []
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append(("email", start, free))
        # A failed at-sign bounds the next local part by itself, as it is no character of one.
        at = text.find("@", max(at + 1, free))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def entity(text: str, span: Span) -> int:
    """A signed 64-bit name of a protected entity: its kind and its value in one spelling."""
    kind, start, end = span
    value = text[start:end]
    value = value.lower() if kind in ("email", "ip") else _NOT_DIGIT.sub("", value)
    return _h(f"{kind}:{value}")


def _h(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text", reveal: float = 0.9) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for every row of ``docs``.

    Base spans come from the four patterns. A term t reveals a protected entity e of its document if
    PMI(e, t) / IC(e) >= ``reveal``, with IC = log2(N / n(e)) and PMI = log2(P(e|t) N / n(e)), n counting rows over the
    whole corpus; the ratio is the share of e's information that t gives away. P(e|t) is smoothed: (n(e,t) +
    PRIOR n(e) / N) / (n(t) + PRIOR), so that few rows tell less than many, yet every entity is estimated, one that
    stands in a single text too. A term that no other row has gives away 0.585 bits less than all of such an entity,
    which is enough from 58 rows on. Such terms in the documents of e are
    added as spans of kind ``term``; documents without personal data get none. An entity in every row has no
    information and adds none. Null and empty texts have no spans. Repeated rows get equal answers. Other columns are ignored, whatever
    their names. A very long text with many entities and terms has their pairs made a piece at a time.

    Every pass reads whole texts, counts are added by key with partial aggregation, and the filters that are
    broadcast are bitmaps of 128 kB whatever the input; exact joins follow them. Texts are not shuffled.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    base = cut(rows.mapInPandas(_detect, f"id {dict(rows.dtypes)['id']}, page long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>"), "pii-base")
    head = [F.col("id").alias(id), "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")]
    held = base.select(F.explode("entities").alias("e"))
    known = cut(held.groupBy("e").agg(F.count("*").alias("n_e")), "pii-entities")
    if known.isEmpty():
        return base.select(*head, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_term"))
    total = base.count()
    spark = docs.sparkSession

    pairs = rows.select("text").mapInPandas(_pairs, "e long, t long, n long").groupBy("e", "t").agg(F.sum("n").alias("n_et"))
    pairs = cut(pairs.join(known, "e"), "pii-pairs")
    terms = spark.sparkContext.broadcast(bitmap(pairs.select(F.col("t").alias("key"))))
    n_t = rows.select("text").mapInPandas(lambda it: _term_counts(it, terms.value), "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    pmi = F.log2((F.col("n_et") * F.lit(float(total)) / F.col("n_e") + PRIOR) / (F.col("n_t") + PRIOR))
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    telling = cut(pairs.join(n_t, "t").where((ic > 0) & (pmi >= reveal * ic)).select("e", "t"), "pii-terms")
    told = spark.sparkContext.broadcast(bitmap(telling.select(F.col("t").alias("key"))))
    places = rows.mapInPandas(lambda it: _places(it, told.value), f"id {dict(rows.dtypes)['id']}, page long, e long, t long, a long, b long")
    places = places.join(telling, ["e", "t"]).groupBy("id", "page").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s"))
    added = places.select(F.col("id").alias("_id"), F.col("page").alias("_page"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.lit("term"), x["a"], x["b"])), ",").alias("_terms"), F.size("s").cast("long").alias("_n"))
    out = base.join(added, base["id"].eqNullSafe(F.col("_id")) & (base["page"] == F.col("_page")), "left")
    spans = F.when(F.col("_terms").isNull(), F.col("base")).otherwise(F.concat_ws(",", F.expr("nullif(base, '')"), "_terms"))
    return out.select(*head, spans.alias("spans"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_term"))


def sanitise(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (from ``detect``) generalised to its kind, as [email] or [term], in ``text``.

    ids must be unique; a document without spans stays as it is.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([generalise(t, s) for t, s in zip(texts, spans, strict=True)], dtype="object")

    told = found.where(F.col("spans") != "").select(F.col(id).alias("_id"), F.col("spans").alias("_spans"))
    out = docs.join(told, F.col(id) == F.col("_id"), "left")
    return out.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(clean(F.col(text), F.col("_spans")))).drop("_id", "_spans")


def generalise(text: str | None, spans: str | None) -> str | None:
    """``text`` with the spans replaced by their kinds; of spans that overlap, the first and longest stands."""
    if not text or not spans:
        return text
    cuts = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))))
    out, at = [], 0
    for a, b, kind in cuts:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = -b
        elif -b > at:
            at = -b
    return "".join([*out, text[at:]])


#: Bits of a bitmap, and the pieces it is put together from.
_BITS, _PIECES = 1 << 20, 64


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2**20 bits of the long column ``key``; it may let other keys through, never keep one back."""
    slot = F.pmod(F.col("key"), F.lit(_BITS))
    wide = _BITS // _PIECES
    parts = keys.select(slot.alias("slot")).distinct().groupBy((F.col("slot") / wide).cast("int").alias("piece")).agg(F.collect_list(F.pmod(F.col("slot"), F.lit(wide)).cast("int")).alias("slots"))
    out = np.zeros(_BITS, dtype=bool)
    for r in parts.mapInPandas(_pack, "piece int, bits binary").collect():  # 64 rows of 2 kB
        out[r["piece"] * wide : (r["piece"] + 1) * wide] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)).astype(bool)
    return out


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for slots in batch["slots"]:
            bits = np.zeros(_BITS // _PIECES, dtype=bool)
            bits[np.asarray(slots)] = True
            out.append(np.packbits(bits).tobytes())
        yield pd.DataFrame({"piece": batch["piece"], "bits": out})


def _page(text: str | None) -> int:
    return _h(text) if text else 0


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for id, text in zip(batch["id"], batch["text"], strict=True):
            spans = base_spans(text)
            kinds = Counter(k for k, *_ in spans)
            out.append((id, _page(text), *(kinds[k] for k in KINDS), join_spans(spans), list({entity(text, s) for s in spans})))
        yield pd.DataFrame(out, columns=["id", "page", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"]).astype({"id": batch["id"].dtype})


def _terms(text: str, spans: list[Span]) -> Iterator[tuple[int, int, int]]:
    """(name, start, end) of the terms outside the base spans."""
    taken = sorted((a, b) for _, a, b in spans)
    k = 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            yield _h(m.group().lower()), a, b


#: Pairs of a document's entities and terms that are made at a time.
_AT_ONCE = 500_000


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        e, t, each, size = [], [], [], 0
        for text in batch["text"]:
            if spans := base_spans(text):
                held = list({entity(text, s) for s in spans})
                terms = np.fromiter({name for name, *_ in _terms(text, spans)}, dtype=np.int64)
                step = max(1, _AT_ONCE // max(1, len(terms)))
                for at in range(0, len(held), step):
                    some = held[at : at + step]
                    e += some
                    t += [terms] * len(some)
                    each += [len(terms)] * len(some)
                    size += len(terms) * len(some)
                    if size > _AT_ONCE:
                        yield _paired(e, t, each)
                        e, t, each, size = [], [], [], 0
        if e:
            yield _paired(e, t, each)


def _paired(e: list[int], t: list[np.ndarray], each: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"e": np.repeat(np.array(e, dtype=np.int64), each), "t": np.concatenate(t), "n": np.int64(1)})


def _term_counts(batches: Iterator[pd.DataFrame], terms: np.ndarray) -> Iterator[pd.DataFrame]:
    count: Counter[int] = Counter()
    name: dict[str, int] = {}
    for batch in batches:
        for text in batch["text"]:
            if text:
                seen = set()
                for word in set(TERM.findall(text)):
                    if (t := name.get(word)) is None:
                        if len(name) > 400_000:  # forget, so that memory is bounded
                            name.clear()
                        t = _h(word.lower())
                        t = name[word] = t if terms[t % _BITS] else 0
                    if t:
                        seen.add(t)
                count.update(seen)
        if len(count) > 400_000:
            yield pd.DataFrame({"t": np.fromiter(count.keys(), np.int64), "n": np.fromiter(count.values(), np.int64)})
            count.clear()
    yield pd.DataFrame({"t": np.fromiter(count.keys(), np.int64), "n": np.fromiter(count.values(), np.int64)})


def _places(batches: Iterator[pd.DataFrame], told: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for id, text in zip(batch["id"], batch["text"], strict=True):
            if spans := base_spans(text):
                page, held = _page(text), np.array(list({entity(text, s) for s in spans}), dtype=np.int64)
                found = [x for x in _terms(text, spans) if told[x[0] % _BITS]]
                step = max(1, _AT_ONCE // max(1, len(held)))
                for at in range(0, len(found), step):
                    some = np.array(found[at : at + step], dtype=np.int64)
                    t, a, b = np.repeat(some, len(held), axis=0).T
                    out = pd.DataFrame({"page": page, "e": np.tile(held, len(some)), "t": t, "a": a, "b": b})
                    out.insert(0, "id", pd.Series([id] * len(out), dtype=batch["id"].dtype))
                    yield out
