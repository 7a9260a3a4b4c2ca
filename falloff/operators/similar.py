"""Names that are alike: every pair above a ratio of matching blocks, by signatures that such a pair must share.

The ratio of two strings is twice their matched characters over both lengths; matched characters keep their order. With lengths m and n
a pair of ratio r leaves D = (1 - r) (m + n) characters unmatched at most. Hence

* cut into D + 1 segments, a string has one that no unmatched character touches: it stands in the other string, shifted by no more than
  D allows before and after it. Names and keys are joined on (length, number of segments, place, segment).
* their bags of characters differ by D at most, and their sets of neighbouring pairs by 3 D (an unmatched character breaks two pairs on its own
  side, one on the other). Both are compared as bits in the join, before a pair is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from falloff.plans.staging import staged

_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TIMES = (1, 2, 3, 4)
_BITS = [f"c{t}" for t in _TIMES] + ["g1", "g2"]


def _signed(df: DataFrame, column: str) -> DataFrame:
    """Length and bits: which characters occur once, twice, .. at least, and which pairs of neighbours occur, by hash."""
    out = df.withColumn("n", F.length(column))
    for t in _TIMES:
        out = out.withColumn(f"c{t}", F.expr(f"aggregate(sequence(0, 35), 0L, (a, i) -> a | if(n - length(replace({column}, substring('{_CHARS}', i + 1, 1), '')) >= {t}, shiftleft(1L, i), 0L))"))
    for k in (0, 1):
        place = f"pmod(hash(substring({column}, i, 2)), 128)"
        out = out.withColumn(f"g{k + 1}", F.expr(f"if(n > 1, aggregate(sequence(1, n - 1), 0L, (a, i) -> a | if({place} div 64 = {k}, shiftleft(1L, {place} % 64), 0L)), 0L)"))
    return out


def _spare(m: str, n: str, least: float) -> str:
    """Characters that a pair of such lengths may leave unmatched; as many, to an even number, as their difference."""
    most = f"cast(floor({1 - least:.6f} * ({m} + {n}) + 1e-9) as int)"
    return f"({most} - pmod({most} - ({n} - {m}), 2))"


def _segment(m: str) -> tuple[str, str]:
    """Begin and length of segment i of g of a string of length m; the last ones are longer by one."""
    short = f"(g - pmod({m}, g))"
    return f"(i * ({m} div g) + greatest(0, i - {short}))", f"({m} div g + if(i >= {short}, 1, 0))"


def _pieces_of_keys(keys: DataFrame, least: float) -> DataFrame:
    lengths = f"sequence(cast(ceil(n * {least / (2 - least):.6f} - 1e-6) as int), cast(floor(n * {(2 - least) / least:.6f} + 1e-6) as int))"
    numbers = f"array_distinct(transform(filter({lengths}, x -> abs(x - n) <= {_spare('n', 'x', least)}), x -> {_spare('n', 'x', least)} + 1))"
    begin, size = _segment("n")
    out = keys.withColumn("g", F.expr(f"explode({numbers})")).where("g <= n").withColumn("i", F.expr("explode(sequence(0, g - 1))"))
    return out.withColumn("sign", F.expr(f"xxhash64(n, g, i, substring(other, {begin} + 1, {size}))")).drop("g", "i")


def _pieces_of_names(names: DataFrame, least: float) -> DataFrame:
    lengths = f"sequence(cast(ceil(n * {least / (2 - least):.6f} - 1e-6) as int), cast(floor(n * {(2 - least) / least:.6f} + 1e-6) as int))"
    begin, size = _segment("m")
    out = names.withColumn("m", F.expr(f"explode({lengths})")).withColumn("d", F.expr(_spare("m", "n", least))).where("abs(n - m) <= d").withColumn("g", F.expr("d + 1")).where("g <= m")
    out = out.withColumn("i", F.expr("explode(sequence(0, g - 1))"))
    room = "((d - abs(n - m)) div 2)"
    out = out.withColumn("at", F.expr(f"explode(sequence({begin} + least(0, n - m) - {room}, {begin} + greatest(0, n - m) + {room}))")).where(f"at >= 0 and at + {size} <= n")
    return out.withColumn("sign", F.expr(f"xxhash64(m, g, i, substring(key, at + 1, {size}))")).drop("m", "d", "g", "i", "at")


def candidates(names: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(key, other): pairs of different names (key) and keys (other) among which are all with a ratio of ``least`` either way."""
    left = _pieces_of_names(staged(_signed(names.select("key").distinct(), "key"), "similar-names"), least)
    right = _pieces_of_keys(staged(_signed(keys.select("other").distinct(), "other"), "similar-keys"), least)
    right = right.withColumnsRenamed({c: f"{c}_" for c in ("n", *_BITS)})
    apart = lambda some: " + ".join(f"bit_count({c} ^ {c}_)" for c in some)
    spare = f"({1 - least:.6f} * (n + n_) + 1e-9)"
    near = F.expr(f"{apart(_BITS[:4])} <= {spare} and {apart(_BITS[4:])} <= 3 * {spare}")
    return left.join(right, "sign").where(near).select("key", "other").distinct()


def ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, other) with there and back, the ratios of matching blocks in either order, and digits: whether the digits
    differ only by what one of them lacks."""

    @F.pandas_udf("there double, back double, digits boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                numbers = SequenceMatcher(None, *("".join(c for c in s if c.isdigit()) for s in (x, y)))
                out.append((SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio(), all(op != "replace" for op, *_ in numbers.get_opcodes())))
            yield pd.DataFrame(out, columns=["there", "back", "digits"])

    return pairs.withColumn("_r", of("key", "other")).select("key", "other", "_r.*")
