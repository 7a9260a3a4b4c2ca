"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.llm.common import BROADCAST_BYTES, cut


def line_key(line: Column) -> Column:
    """128 bits that stand for a line without its outer white space."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(7), bare).alias("g"))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """(host, h, g, pages, total): lines that stand on more than ``ratio`` of their host's pages, and on ``min_pages``.

    Lines are compared without outer spaces; blank lines never count. Pages are the host's distinct texts, so a
    page that was copied many times doesn't make its own lines boilerplate. Rows of a null host form a host of
    their own; null texts are no pages. Both counts are first reduced by (host, line, text), then by (host,
    line) with partial aggregation, so a host with a third of all rows is spread by its lines.
    """
    pages = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(text).alias("page"))
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), line_key))
    counts = (
        pages.select("host", "page", F.explode(keys).alias("k"))
        .select("host", "page", "k.h", "k.g")
        .distinct()
        .groupBy("host", "h", "g")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    # Rows here are distinct repeated lines, not lines of text; a host's total is joined null-safely.
    found = counts.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return found.where(F.col("pages") > ratio * F.col("total")).select("c.host", "h", "g", "pages", "total")


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and columns n_lines, n_dropped.

    Null text stays null with 0 and 0; an empty text is one blank line, which is kept. Kept lines stay as they
    are, in order, joined by a line feed; a text whose every line goes becomes empty. Repeated rows count as
    separate pages and are treated alike; extra columns pass through unless named n_lines or n_dropped, which are
    replaced. The flagged lines of a host number at most its mean distinct lines for each page divided by
    ``ratio``. Where all of them measure under 8 MB they are broadcast, so texts are not shuffled; beyond that
    they are joined by host, each host's pages spread over 32 salts.
    """
    flagged = cut(boilerplate(docs, text, host, ratio, min_pages).select("host", "h", "g"), "lines")
    count = flagged.count()
    sets = flagged.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.struct("h", "g")).alias("_flagged"))
    base = docs.drop("n_lines", "n_dropped")
    if count * 64 <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(sets), base[host].eqNullSafe(F.col("_host")), "left")
    else:
        salts = 32
        left = base.withColumn("_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(salts)))
        right = sets.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = left.join(right, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_at")), "left").drop("_salt", "_at")
    lines = F.split(F.col(text), "\n")
    # Only a host that has flagged lines has its lines hashed.
    keep = F.when(F.col("_flagged").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_flagged"), line_key(x))))
    out = joined.withColumn("_lines", lines).withColumn("_keep", keep)
    n = F.coalesce(F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")), F.lit(0)).cast("long")
    return (
        out.withColumn("n_lines", n)
        .withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_keep")).cast("long"))
        .withColumn(text, F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join("_keep", "\n")))
        .drop("_host", "_flagged", "_lines", "_keep")
    )
