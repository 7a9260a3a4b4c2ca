"""SentencePiece unigram encoding and decoding: Viterbi as a max-plus scan over the chunks of each document."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from falloff.llm.common import cut

#: No path.
NEVER = np.int64(-(1 << 62))
#: What a character that is in no piece costs beyond the rarest piece, in nats.
UNKNOWN = 10.0
#: Scores are integers, in 1/64 nat, so that sums are exact and chunks combine to what the whole text gives.
NAT = 64


class Pieces:
    """A vocabulary of pieces with integer scores.

    The vocabulary file ranks its pieces; by Zipf's law a piece of rank r has the score -ln(1 + r). The escaped
    space of the file is a plain space here, so every text, one with U+2581 too, decodes to itself. Characters
    in no piece become one piece for each UTF-8 byte. As usual, encoding puts one space before the text.
    """

    def __init__(self, pieces: list[str], byte_ids: list[int], special: set[int], unk: int = 0) -> None:
        self.pieces, self.byte_ids, self.unk, self.kernel = pieces, byte_ids, unk, None
        usual = [k for k in range(len(pieces)) if k not in special and k not in set(byte_ids)]
        self.text = [p.replace("▁", " ") for p in pieces]
        self.known: dict[str, tuple[int, int] | None] = {}
        least = 0
        for rank, k in enumerate(usual):
            score = -round(math.log(2 + rank) * NAT)
            least = min(least, score)
            self.known[self.text[k]] = (k, score)
        self.unknown = least - round(UNKNOWN * NAT)
        self.longest = max(len(self.text[k]) for k in usual)
        for p in [self.text[k] for k in usual]:  # prefixes of pieces, so that a search stops early
            for n in range(1, len(p)):
                self.known.setdefault(p[:n], None)
        # No piece has a space after another character, nor a character that is in no piece: cuts are forced there.
        self.unit = re.compile(r"\n| *[^ \n]+| +")
        self.cut = re.compile(r"(?<! )(?= )|(?=\n)")
        if any(" " in self.text[k].lstrip(" ") or "\n" in self.text[k] for k in usual):
            self.unit, self.cut = re.compile(r".+", re.S), None
        self.bytes_of = {k: bytes([b]) for b, k in enumerate(byte_ids)}
        #: What an id adds to a path; the bytes of an unknown character count once, at its first.
        self.worth = np.zeros(len(pieces), dtype=np.int64)
        for hit in self.known.values():
            if hit is not None:
                self.worth[hit[0]] = hit[1]
        self.worth[[k for b, k in enumerate(byte_ids) if b & 0xC0 != 0x80]] = self.unknown
        #: So many characters have a sum that a 32-bit float holds exactly.
        self.exact = (1 << 24) // -self.unknown

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        byte_ids = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([file.id_to_piece(k) for k in range(n)], byte_ids, {k for k in range(n) if file.is_unknown(k) or file.is_control(k)}, file.unk_id())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kernel": None}

    def steps(self, text: str, at: int) -> Iterator[tuple[int, int, int]]:
        """(end, id, score) of the pieces that begin at ``at``; id -1 for an unknown character."""
        known, single = self.known, False
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            piece = text[at:end]
            if piece not in known:
                break
            if (hit := known[piece]) is not None:
                single = single or end == at + 1
                yield end, *hit
        if not single:
            yield at + 1, -1, self.unknown

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal ones, that whose last piece is longest, and so on backwards."""
        return self._trace(text, self._best(text)[1], len(text))[1]

    def _best(self, text: str, start: tuple | list = (0,), size: int | None = None) -> tuple[list, list]:
        """Scores of all positions, None where no path leads, and their back pointers.

        ``start`` has what it costs to begin that many characters into the text. No piece begins at ``size`` or beyond, one may end there.
        """
        best = [*start, *[None] * (len(text) + 1 - len(start))]
        back: list = [None] * len(best)
        for at in range(len(text) if size is None else size):
            here = best[at]
            if here is None:
                continue
            for end, k, score in self.steps(text, at):
                if best[end] is None or here + score > best[end]:
                    best[end], back[end] = here + score, (at, k)
        return best, back

    def _trace(self, text: str, back: list, end: int) -> tuple[int, list[int]]:
        """Where the best path to ``end`` begins, and its ids."""
        ids: list[int] = []
        while back[end] is not None:
            at, k = back[end]
            ids += [k] if k >= 0 else [self.byte_ids[b] for b in reversed(text[at:end].encode("utf-8", "surrogatepass"))]
            end = at
        ids.reverse()
        return end, ids

    def _kernel(self):
        """The library's Viterbi over the same pieces and scores, for short words that are not yet in memory."""
        if self.kernel is None:
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece_model_pb2.ModelProto()
            model.trainer_spec.model_type = 1
            model.trainer_spec.byte_fallback = True
            model.normalizer_spec.name = "identity"
            model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = False
            code = {k: 6 for k in self.byte_ids}
            for k, piece in enumerate(self.pieces):
                hit = self.known.get(self.text[k]) if k not in code else None
                usual = hit is not None and hit[0] == k
                model.pieces.add(piece=piece, score=hit[1] / NAT if usual else 0.0, type=1 if usual else code.get(k, 2 if k == self.unk else 3))
            self.kernel = sentencepiece.SentencePieceProcessor()
            self.kernel.LoadFromSerializedProto(model.SerializeToString())
        return self.kernel

    def _stretches(self, text: str) -> Iterator[str]:
        """The text from forced cut to forced cut, about 4,096 characters at a time."""
        at = 0
        while at < len(text):
            m = self.cut.search(text, at + 4096) if self.cut else None
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids of a text as it is, without the space before it.

        Stretches whose sums a 32-bit float holds exactly go to the library's Viterbi; the few that are longer, or
        that have characters which the library reads as something else, go through ours.
        """
        out: list[int] = []
        for stretch in self._stretches(text):
            if len(stretch) <= self.exact and "▁" not in stretch and "\0" not in stretch:
                out += self._kernel().encode(stretch, num_threads=1)
            else:
                for u in self.unit.findall(stretch):
                    out += self.viterbi(u)
        return np.array(out, dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_plain(" " + text)

    def decode_plain(self, ids: np.ndarray) -> bytes:
        bytes_of, text = self.bytes_of, self.text
        return b"".join([bytes_of[k] if k in bytes_of else text[k].encode() for k in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded."""
        text = self.text
        listed = ids.tolist()
        if self.bytes_of.keys().isdisjoint(listed):
            return "".join([text[k] for k in listed])[1:]
        return self.decode_plain(ids).decode("utf-8", "surrogatepass")[1:]

    def cuts(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and last forced cut of a chunk that lie after all its begin states and before its end, if there is one."""
        found = self.cut.search(text, self.longest, size) if self.cut else None
        if found is None:
            return None
        first, reach = found.start(), 256
        while not (late := [m.start() for m in self.cut.finditer(text, max(first, size - reach), size)]):
            reach *= 4
        return first, late[-1]

    def summary(self, text: str, size: int) -> dict:
        """What the scan needs to know of a chunk of ``size`` characters, and the ids that do not depend on its neighbours.

        State s: the piece over an edge ends s characters into what follows. All paths through a chunk with a forced cut meet there, so
        its matrix from begin to end states has rank one: ``m`` has the best scores from each begin state to the first cut, ``w`` those
        from there to each end state, with what lies between, whose ids are final. A chunk without a cut has its whole matrix in ``m``
        and its text in ``tail``. In ``tail`` pieces begin at the first ``rest`` characters.
        """
        found = self.cuts(text, size)
        if found is None:
            m = np.stack([self._ends(text, size, [None] * s + [0]) for s in range(self.longest)])
            return {"m": m.tobytes(), "w": None, "head": None, "tail": text, "rest": size, "ids": np.zeros(0, dtype=np.int32), "exact": True}
        head, tail = found
        to = [0] * (head + 1)
        for at in range(head - 1, -1, -1):
            to[at] = max(score + to[end] for end, _, score in self.steps(text[:head], at))
        ids = self.encode_plain(text[head:tail])
        w = plus(self._ends(text[tail:], size - tail, [0]), self.worth[ids].sum())
        exact = self.decode_plain(ids).decode("utf-8", "surrogatepass") == text[head:tail]
        return {"m": np.array(to[: self.longest], dtype=np.int64).tobytes(), "w": w.tobytes(), "head": text[:head], "tail": text[tail:], "rest": size - tail, "ids": ids, "exact": exact}

    def _ends(self, text: str, size: int, start: list) -> np.ndarray:
        """Best scores of the states behind ``size`` characters."""
        best = self._best(text, start, size)[0][size : size + self.longest]
        return np.array([NEVER if x is None else x for x in best] + [NEVER] * (self.longest - len(best)), dtype=np.int64)

    def entries(self, head: str | None, tail: str, rest: int, v: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Backwards, from each end state of a chunk to the begin state of its best path: a step of the scan, 0 where the path leads.

        ``v``: scores of the begin states.
        """
        start = [None if x == NEVER else int(x) for x in v]
        if head is not None:
            entry = np.full(self.longest, NEVER)
            entry[self._trace(head, self._best(head, start)[1], len(head))[0]] = 0
            return np.where(w == NEVER, NEVER, 0), entry
        best, back = self._best(tail, start, rest)
        m = np.full((self.longest, self.longest), NEVER)
        for e, x in enumerate(best[rest : rest + self.longest]):
            if x is not None:
                m[e, self._trace(tail, back, rest + e)[0]] = 0
        return m, None

    def path(self, head: str | None, tail: str, rest: int, v: np.ndarray, exit: int, middle: np.ndarray) -> tuple[np.ndarray, bool]:
        """The ids of a chunk's path to an end state, and whether those about its cuts decode to their text."""
        start = [None if x == NEVER else int(x) for x in v]
        first, same = [], True
        if head is not None:
            entry, first = self._trace(head, self._best(head, start)[1], len(head))
            same, start = self._decodes(first, head[entry:]), [0]
        entry, last = self._trace(tail, self._best(tail, start, rest)[1], rest + exit)
        ids = np.concatenate([np.array(first, dtype=np.int32), np.asarray(middle, dtype=np.int32), np.array(last, dtype=np.int32)])
        return ids, same and self._decodes(last, tail[entry : rest + exit])

    def _decodes(self, ids: list[int], text: str) -> bool:
        return self.decode_plain(np.array(ids, dtype=np.int32)).decode("utf-8", "surrogatepass") == text


#: A step between states: a matrix and None, or the two vectors whose sums are a matrix of rank one.
Step = tuple[np.ndarray, np.ndarray | None]


def plus(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Sum of scores, none of which is above 0; without a path it stays without."""
    return np.maximum(a + b, NEVER)


def through(v: np.ndarray, step: Step) -> np.ndarray:
    """Scores of the states behind a step, from those before it."""
    m, w = step
    return plus(v[:, None], m).max(axis=0) if w is None else plus(plus(v, m).max(), w)


def product(a: Step, b: Step) -> Step:
    """Max-plus product, of rank one where either is; associative."""
    if a[1] is not None:
        return a[0], through(a[1], b)
    if b[1] is not None:
        return plus(a[0], b[0][None, :]).max(axis=1), b[1]
    return plus(a[0][:, :, None], b[0][None, :, :]).max(axis=1), None


def _read(m: bytes, w: bytes | None, states: int) -> Step:
    m = np.frombuffer(m, dtype=np.int64)
    return (m.reshape(states, states), None) if w is None else (m, np.frombuffer(w, dtype=np.int64))


def _written(steps: list[Step]) -> dict[str, list[bytes | None]]:
    return {"m": [m.tobytes() for m, _ in steps], "w": [None if w is None else w.tobytes() for _, w in steps]}


def _blocks(done: list[tuple[tuple[int, int], Step]]) -> pd.DataFrame:
    return pd.DataFrame({"page": [p for (p, _), _ in done], "k": [b for (_, b), _ in done], **_written([step for _, step in done])})


def _ordered(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("page", "b").sortWithinPartitions("page", "b", "k")


def scan(steps: DataFrame, states: int, block: int = 64) -> DataFrame:
    """(page, k, v): what the product of a text's steps before step k makes of state 0.

    ``steps`` has page, the text's hash, k (from 0 without gaps) and m and w, a step as bytes. Steps are multiplied
    in blocks, the blocks' products likewise, until a document has one; the scores then go down again. A task reads its blocks in order,
    a batch at a time, and holds one step; blocks are many rows to a task and none is a group of its own.
    """
    at = (F.col("k") / block).cast("long")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for rows in batches:
            done = []
            for page, b, m, w in zip(rows["page"], rows["b"], rows["m"], rows["w"], strict=True):
                step = _read(m, w, states)
                if (page, b) != now:
                    if now is not None:
                        done.append((now, total))
                    now, total = (page, b), step
                else:
                    total = product(total, step)
            yield _blocks(done)
        if now is not None:
            yield _blocks([(now, total)])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, v = None, None
        for rows in batches:
            out = []
            for page, b, m, w, first in zip(rows["page"], rows["b"], rows["m"], rows["w"], rows["v"], strict=True):
                if (page, b) != now:
                    now, v = (page, b), np.frombuffer(first, dtype=np.int64)
                out.append(v.tobytes())
                v = through(v, _read(m, w, states))
            yield rows[["page", "k"]].assign(v=out)

    levels = [steps.select("page", "k", "m", "w")]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) >= block:
        up = _ordered(levels[-1].withColumn("b", at)).mapInPandas(multiply, "page long, k long, m binary, w binary")
        levels.append(cut(up, "scan"))
    start = np.full(states, NEVER)
    start[0] = 0
    v = levels[-1].where("k = 0").select("page", F.lit(0).cast("long").alias("b"), F.lit(bytearray(start.tobytes())).alias("v"))
    for level in reversed(levels):
        v = _ordered(level.withColumn("b", at).join(v, ["page", "b"])).mapInPandas(go, "page long, k long, v binary")
        v = v.withColumnRenamed("k", "b") if level is not levels[0] else v
    return v


def encode(docs: DataFrame, vocabulary: Pieces, id: str = "doc_id", text: str = "text", chunk: int = 1 << 13) -> DataFrame:
    """(id, part, ids, n_chars, exact, n_ids, sum_ids, dot_ids): the ids of every document, one longer than a chunk in parts in order.

    Parts of a document put one after the other are the ids of the whole text, whatever the chunks. exact tells
    that the ids decode to what was encoded; dot_ids is the sum of (place in the part + 1) * id. Null texts and empty ones have one part; null has null ids, an
    empty text the ids of the space before it. A text of one chunk, up to ``chunk`` characters, is encoded where it is read.
    All longer ones are cut into chunks; each yields a matrix of best scores between its boundary states (two vectors, where a cut is
    forced inside it), the matrices are combined by an associative scan, a second scan, backwards, tells the exit state of each chunk,
    and each then traces its own path back from there. Repeated rows give repeated results. An empty table gives an empty one; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    large = F.coalesce(F.length("text") > chunk, F.lit(False))

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for at in range(0, len(batch), 128):  # small frames, as ids take more room than their text
                rows = batch.iloc[at : at + 128]
                ids = [None if t is None else known.encode(t) for t in rows["text"]]
                exact = [t is None or known.decode(x) == t for t, x in zip(rows["text"], ids, strict=True)]
                yield _sums(pd.DataFrame({"doc": rows["doc"].array, "part": np.int64(0), "ids": ids, "n_chars": [0 if t is None else len(t) for t in rows["text"]], "exact": exact}))

    schema = f"doc {kind}, part long, ids array<int>, n_chars long, exact boolean, n_ids long, sum_ids long, dot_ids long"
    plain = rows.where(~large).mapInPandas(small, schema)
    # Giants are known by the hash of their text until their parts are done, so that an id may be null.
    giants = rows.where(large).withColumn("page", F.xxhash64("text"))
    if giants.select("doc").isEmpty():
        return plain.withColumnRenamed("doc", id)

    states = vocabulary.longest

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, t in zip(batch["page"], batch["text"], strict=True):
                t = " " + t
                places = list(enumerate(range(0, len(t), chunk)))
                for i in range(0, len(places), 64):
                    # With what a piece over the end may reach.
                    made = [{"page": page, "k": k, "text": t[a : a + chunk + states], "size": min(chunk, len(t) - a), "last": a + chunk >= len(t)} for k, a in places[i : i + 64]]
                    yield pd.DataFrame(made)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = batch.iloc[at : at + 64]
                found = pd.DataFrame([known.summary(t, s) for t, s in zip(rows["text"], rows["size"], strict=True)])
                yield pd.concat([rows[["page", "k", "size", "last"]].reset_index(drop=True), found], axis=1)

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            steps = [known.entries(r.head, r.tail, r.rest, np.frombuffer(r.v, dtype=np.int64), None if r.w is None else np.frombuffer(r.w, dtype=np.int64)) for r in batch.itertuples()]
            yield batch[["page", "k"]].assign(**_written(steps))

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = batch.iloc[at : at + 64]
                found = [known.path(r.head, r.tail, r.rest, np.frombuffer(r.v, dtype=np.int64), int(np.frombuffer(r.exit, dtype=np.int64).argmax()), r.ids) for r in rows.itertuples()]
                yield _sums(rows[["page", "k", "size"]].assign(ids=[x for x, _ in found], exact=rows["exact"].to_numpy() & np.array([same for _, same in found])))

    chunks = giants.select("page", "text").mapInPandas(split, "page long, k long, text string, size int, last boolean").dropDuplicates(["page", "k"])
    times = giants.groupBy("doc", "page").agg(F.count("*").cast("int").alias("times"))
    whole = cut(chunks.mapInPandas(summaries, "page long, k long, size int, last boolean, m binary, w binary, head string, tail string, rest int, ids array<int>, exact boolean"), "pieces-chunks")
    before = cut(scan(whole, states), "pieces-before")
    ends = whole.where("last").select("page", F.col("k").alias("end"))
    turned = whole.select("page", "k", "w", "head", "tail", "rest").join(before, ["page", "k"]).mapInPandas(backwards, "page long, k long, m binary, w binary")
    turned = cut(turned.join(ends, "page").select("page", (F.col("end") - F.col("k")).alias("k"), "m", "w"), "pieces-exits")
    exits = scan(turned, states).join(ends, "page").select("page", (F.col("end") - F.col("k")).alias("k"), F.col("v").alias("exit"))
    traced = whole.select("page", "k", "size", "head", "tail", "rest", "ids", "exact").join(before.join(exits, ["page", "k"]), ["page", "k"])
    traced = traced.mapInPandas(traces, "page long, k long, size int, ids array<int>, exact boolean, n_ids long, sum_ids long, dot_ids long")
    parts = traced.join(times, "page")
    n = F.col("size") - F.when(F.col("k") == 0, 1).otherwise(0)
    parts = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc", F.col("k").alias("part"), "ids", n.cast("long").alias("n_chars"), "exact", "n_ids", "sum_ids", "dot_ids", "page", "copy")
    return plain.withColumns({"page": F.lit(0).cast("long"), "copy": F.lit(1)}).unionByName(parts).withColumnRenamed("doc", id)


def digests(encoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row for each document: (id, n_chars, n_ids, sum_ids, dot_ids, exact), places counted over the whole text.

    Only the parts of giant documents meet, as four numbers each.
    """
    if "page" not in encoded.columns:
        encoded = encoded.withColumns({"page": F.lit(0).cast("long"), "copy": F.lit(1)})
    whole = encoded.where("page = 0").select(id, "n_chars", "n_ids", "sum_ids", "dot_ids", "exact")
    many = encoded.where("page <> 0")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy(id, "page", "copy").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = many.withColumn("dot_ids", F.col("dot_ids") + before * F.col("sum_ids")).groupBy(id, "page", "copy").agg(F.sum("n_chars").alias("n_chars"), F.sum("n_ids").alias("n_ids"), F.sum("sum_ids").alias("sum_ids"), F.sum("dot_ids").alias("dot_ids"), F.min("exact").alias("exact"))
    return whole.unionByName(many.select(whole.columns))


def _sums(rows: pd.DataFrame) -> pd.DataFrame:
    ids = [np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in rows["ids"]]
    return rows.assign(n_ids=[len(x) for x in ids], sum_ids=[int(x.sum()) for x in ids], dot_ids=[int(np.dot(x, np.arange(1, len(x) + 1))) for x in ids])
