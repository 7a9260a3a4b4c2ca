"""Prefix trie of conversations: rolling fingerprints of prefixes, verified turn by turn, and figures rolled up to parents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.llm.common import cut

#: Two prime moduli below 2^31, so that products fit a long, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 740882966)
#: Bits of a turn's hash; fewer only to provoke collisions.
BITS = 62
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_SCANNED = "pos long, f1 long, f2 long, b1 long, b2 long, seen long, part long, seq long"


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo ``prime``, by doubling."""
    out = np.ones(max(1, n), dtype=np.int64)
    done = 1
    while done < n:
        step = pow(base, done, prime)
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % prime
        done += more
    return out


def _scan_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local positions, fingerprints, their powers and running word counts of the conversations of a sorted partition."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    last = None  # of the run that may go on: conversation, turns, fingerprints, words
    for rows in batches:
        n = len(rows)
        if not n:
            continue
        conv, x, w = rows["conv_id"].to_numpy(), rows["x"].to_numpy(), rows["words"].to_numpy()
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = conv[1:] != conv[:-1]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        pos = np.arange(n) - begin + 1
        seen = np.cumsum(w)
        seen = seen - np.where(begin > 0, seen[begin - 1], 0)
        goes_on = (begin == 0) & (last is not None and last[0] == conv[0])
        marks, powers = [], []
        for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            up, down = _powers(base, prime, n + 1), _powers(pow(base, -1, prime), prime, n + 1)
            total = np.cumsum((x >> (31 * k) & 0x7FFFFFFF) % prime * down[:n] % prime)
            before = np.where(begin > 0, total[begin - 1], 0)
            mark, power = (total - before) % prime * up[:n] % prime, up[pos]
            if last is not None:
                mark = np.where(goes_on, (last[2][k] * power + mark) % prime, mark)
                power = np.where(goes_on, last[3][k] * power % prime, power)
            marks.append(mark)
            powers.append(power)
        if last is not None:
            pos, seen = pos + np.where(goes_on, last[1], 0), seen + np.where(goes_on, last[4], 0)
        last = conv[-1], int(pos[-1]), [int(m[-1]) for m in marks], [int(p[-1]) for p in powers], int(seen[-1])
        yield rows.assign(pos=pos, f1=marks[0], f2=marks[1], b1=powers[0], b2=powers[1], seen=seen, part=part, seq=np.arange(seq, seq + n))
        seq += n


def scan(turns: DataFrame, *order: Column) -> DataFrame:
    """``turns`` (conv_id, x, words, ..) with pos, the turn's place in its conversation from 1, k and before, the fingerprints
    of the prefixes that end with it and just before it, and seen, the words of the prefix.

    Rows are sorted by ranges of (conv_id, ``order``), so a long conversation is spread over tasks. Each task scans its
    range with numpy; what a conversation that goes on brings from earlier ranges is one row for each range, joined to its rows.
    """
    spark = turns.sparkSession
    placed = turns.repartitionByRange(F.col("conv_id"), *order[:1]).sortWithinPartitions(F.col("conv_id"), *order)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    local = cut(placed.mapInPandas(_scan_partition, f"{kept}, {_SCANNED}"), "trie-scan")
    ends = local.groupBy("part").agg(F.min_by("conv_id", "seq").alias("first"), F.max_by(F.struct("conv_id", "pos", "f1", "f2", "b1", "b2", "seen"), "seq").alias("last")).orderBy("part").collect()  # a row for each range
    carried, state = [], None
    for r in ends:
        end = r["last"].asDict()
        if state is not None and state["conv_id"] == r["first"]:
            carried.append((r["part"], state["conv_id"], state["pos"], state["f1"], state["f2"], state["seen"]))
            if end["conv_id"] == r["first"]:
                f = [(state[f"f{k + 1}"] * end[f"b{k + 1}"] + end[f"f{k + 1}"]) % PRIMES[k] for k in (0, 1)]
                end |= {"pos": state["pos"] + end["pos"], "f1": f[0], "f2": f[1], "seen": state["seen"] + end["seen"]}
        state = end
    carry = spark.createDataFrame(carried, "part long, conv_id long, c_pos long, c1 long, c2 long, c_seen long")
    out = local.join(F.broadcast(carry), ["part", "conv_id"], "left")  # at most a row for each range
    marks, befores = [], []
    for k, prime in enumerate(PRIMES):
        mark = (F.coalesce(F.col(f"c{k + 1}"), F.lit(0)) * F.col(f"b{k + 1}") + F.col(f"f{k + 1}")) % prime
        own = F.shiftright("x", 31 * k).bitwiseAND(0x7FFFFFFF) % prime
        marks.append(mark)
        befores.append((mark - own + prime) % prime * pow(BASES[k], -1, PRIMES[k]) % prime)
    joint = lambda two: F.shiftleft(two[0], 31).bitwiseOR(two[1])
    return out.select(
        *turns.columns, (F.col("pos") + F.coalesce("c_pos", F.lit(0))).alias("pos"), joint(marks).alias("k"), joint(befores).alias("before"), (F.col("seen") + F.coalesce("c_seen", F.lit(0))).alias("seen")
    )


def ordered(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, role, text): turns by place from 1; a null turn comes first, ties go by role and text, null role or text is empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), blank(role), blank(text), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("words"))
    rows = rows.where(F.col("conv_id").isNotNull())
    out = scan(rows, F.col("turn").asc_nulls_first(), F.col(role), F.col(text))
    return out.select("conv_id", "pos", F.col(role).alias("role"), F.col(text).alias("text"))


def rebuild(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_ids, turns): each conversation with the head of another in place of its own.

    Conversation c takes the first h turns of c - c % ``every`` (all if there are fewer, none if it isn't there), then its own after
    its first h; h is the CRC-32 of c in decimal modulo ``heads``. ``turns`` are as ``ordered`` makes them.
    """
    head = lambda c: (F.crc32(c.cast("string").cast("binary")) % heads).cast("long")
    turns = turns.withColumn("h", head(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    ids = turns.groupBy("conv_id", "h", "base").agg(F.lit(1).alias("_")).drop("_")
    starts = turns.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < heads)).select("base", "pos", "role", "text")
    taken = ids.join(starts, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    there = starts.groupBy("base").agg(F.count("*").alias("there"))
    own = turns.where("pos > h").join(there, "base", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).alias("pos"), "role", "text")
    return ids.select("conv_id"), taken.unionByName(own)


def fingerprinted(turns: DataFrame, bits: int = BITS) -> DataFrame:
    """``turns`` (conv_id, pos, role, text) with the class of the prefix that ends with each, and that of the one before.

    Prefixes of equal length are classed by polynomial rolling fingerprints. Then every turn of a class of several is compared with
    the turn of the class's representative, its smallest conv_id. Turns of equal text have equal hashes, so two members whose
    last turns are equal shared a class one turn before: if no comparison fails, classes are exact. Where one fails, each
    different turn of the class gets the smallest conv_id that has it, these are fingerprinted in a second component, and all is compared again.
    """
    rows = turns.select("conv_id", F.col("pos").alias("turn"), "role", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"))
    x = F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1)
    first = scan(rows.withColumn("x", x), F.col("turn")).withColumnsRenamed({"k": "k1", "before": "before1"}).drop("turn", "x").withColumns({"k2": F.lit(0).cast("long"), "before2": F.lit(0).cast("long")})
    now = cut(first, "trie-classes")
    for seed in range(1, 9):
        key = ["pos", "k1", "k2"]
        shared = now.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 1").drop("n")
        members = now.select(*key, "conv_id", "role", "text").join(shared, key)
        own = members.where(F.col("conv_id") == F.col("rep")).select(*key, F.col("role").alias("its_role"), F.col("text").alias("its_text"))
        wrong = cut(members.join(own, key).where((F.col("role") != F.col("its_role")) | (F.col("text") != F.col("its_text"))).select("pos", "k1").distinct(), "trie-collisions")
        if not wrong.take(1):
            return now
        alike = now.join(wrong, ["pos", "k1"]).groupBy("pos", "k1", "role", "text").agg(F.min("conv_id").alias("alias"))
        lowest = alike.groupBy("pos", "k1").agg(F.min("alias").alias("lowest"))
        alike = alike.join(lowest, ["pos", "k1"]).where("alias <> lowest").drop("lowest")
        told = F.when(F.col("alias").isNotNull(), F.xxhash64(F.lit(seed), "alias").bitwiseAND((1 << BITS) - 1)).otherwise(F.lit(0)).cast("long")
        split = now.drop("k2", "before2", "seen").join(alike, ["pos", "k1", "role", "text"], "left").withColumn("x", told).drop("alias").withColumnRenamed("pos", "turn")
        now = cut(scan(split, F.col("turn")).withColumnsRenamed({"k": "k2", "before": "before2"}).drop("turn", "x"), "trie-classes")
    raise RuntimeError("prefixes still collide after eight seeds")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the ids of each class, streamed in order; a partition holds whole classes, sorted."""
    key, digest = None, None
    for rows in batches:
        out = []
        keys = list(zip(rows["pos"], rows["k1"], rows["k2"], strict=True))
        for k, c in zip(keys, rows["conv_id"], strict=True):
            if k != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(str(c).encode())
            else:
                digest.update(b",%d" % c)
        yield pd.DataFrame(out, columns=["pos", "k1", "k2", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["pos", "k1", "k2", "ends_sha256"])


def build(ids: DataFrame, turns: DataFrame, bits: int = BITS) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ids: every conversation (conv_id), even without turns; turns: conv_id, pos (order only), role, text. A node is a different
    sequence of first turns, the root the empty one. conv_id is its smallest member, parent_conv_id its parent's (null at the root),
    n_children the nodes one turn longer, n_leaves the nodes without children in its subtree, itself included;
    saved_tokens the sum over its subtree of (members - 1) times the words of the last turn; ends_sha256 the hash of
    the ids of the members that end there, in order, joined by commas.

    Nothing walks the tree. Going down, a conversation is its node's smallest member from some depth on, so it owns one chain
    of nodes that ends where it ends; every node has one owner. Subtree sums are then sums over the node's members: of what they own
    below it, found from the depth where each one's chain begins. All are grouped sums with partial aggregation.
    The ids that end at one node go through one task's hash in order, streamed, as SHA-256 can't be split (about ten bytes each).

    Null conv_ids are left out; null role or text is empty (by ``ordered``); repeated turns are turns like others. An empty table
    has no nodes, conversations without turns a root only. Very long texts are hashed and compared whole. Other columns are ignored.
    """
    rows = fingerprinted(turns, bits)
    small = rows.select("conv_id", "pos", "k1", "k2", "before1", "before2", (F.col("seen") - F.col("words")).alias("above"), "seen")
    zero = F.lit(0).cast("long")
    length = small.groupBy("conv_id").agg(F.max("pos").alias("len"), F.max("seen").alias("total"))
    convs = ids.select("conv_id").where(F.col("conv_id").isNotNull()).distinct().join(length, "conv_id", "left").na.fill(0, ["len", "total"])
    roots = convs.select("conv_id", zero.alias("pos"), zero.alias("k1"), zero.alias("k2"), zero.alias("before1"), zero.alias("before2"), zero.alias("above"))
    paths = cut(small.drop("seen").unionByName(roots).join(convs, "conv_id"), "trie-paths")

    key = ["pos", "k1", "k2"]
    owners = paths.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.min("above").alias("above"), F.max("len").alias("longest"))
    chain = owners.groupBy("conv_id").agg(F.min("pos").alias("own_from"), F.min_by("above", "pos").alias("own_above"), F.max(F.when(F.col("longest") == F.col("pos"), 1).otherwise(0)).alias("leaf"))
    steps = paths.join(chain, "conv_id", "left")
    child = F.when((F.col("len") > F.col("pos")) & (F.col("own_from") <= F.col("pos") + 1), 1).otherwise(0)
    owned = F.when(F.col("own_from").isNull(), 0).when(F.col("pos") > F.col("own_from"), F.col("total") - F.col("above")).otherwise(F.col("total") - F.col("own_above"))
    nodes = cut(
        steps.groupBy(*key).agg(
            F.min("conv_id").alias("conv_id"), F.min("before1").alias("before1"), F.min("before2").alias("before2"), F.count("*").alias("n_convs"), F.sum(child).cast("long").alias("n_children"),
            F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(F.col("total") - F.col("above") - owned).cast("long").alias("saved_tokens"),
        ), "trie-nodes",
    )
    above = nodes.select((F.col("pos") + 1).alias("pos"), F.col("k1").alias("before1"), F.col("k2").alias("before2"), F.col("conv_id").alias("parent_conv_id"))
    ends = paths.where(F.col("pos") == F.col("len")).select(*key, "conv_id").repartition(*key).sortWithinPartitions(*key, "conv_id").mapInPandas(_digests, "pos long, k1 long, k2 long, ends_sha256 string")
    out = nodes.join(above, ["pos", "before1", "before2"], "left").join(ends, key, "left")
    return out.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
