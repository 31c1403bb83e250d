"""Best-fit packing of texts into sequences of several permitted lengths.

Pieces are dealt out by a hash into shards of about SHARD pieces each, however many there are; within a shard
they go, longest first, each into the open bin that it fills best. Where none has room a new bin is opened, with the permitted length that costs
least for each token that is expected to fill it: the cost of a bin is `overhead` plus its length plus
`quadratic` times its squared length, and the expected filling follows from the pieces still to come.
At the end each bin shrinks to the least permitted length that holds its contents.

Sizes are words. A text longer than the largest permitted length is cut into pieces of that length and
a rest, so every word of every text is packed exactly once. A task holds the numbers of one shard's pieces; texts travel only
in `pack_texts`, beside the plan and not through it.

Defined cases: null texts and texts without words have nothing to pack and no rows; equal sizes are taken in
the order of id, text hash, copy and start; repeated rows are packed as often as they occur and numbered as copies; null ids are
an id like any other; empty tables give no rows. Columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, bounded_batches, cut

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces that are packed together. Beyond some thousands more of them fill bins no better.
SHARD = 1 << 15
_WORD = re.compile(WORD)


@dataclass(frozen=True)
class Costs:
    """What a bin costs: by the bin, by its tokens, and by the square of its tokens."""

    overhead: float = 32.0
    quadratic: float = 1 / 32768

    def of(self, length: int) -> float:
        return self.overhead + length + self.quadratic * length * length


def open_length(piece: int, rest: np.ndarray, lengths: tuple[int, ...], costs: Costs) -> int:
    """The length of a new bin for `piece`, the least costly for each word that is expected in it.

    `rest` has, at each size, the words of the pieces still to come that are no longer than that: only
    they can fill what the piece leaves."""
    best = None
    for length in lengths:
        if length < piece:
            continue
        room = length - piece
        filled = piece + min(room, int(rest[min(room, len(rest) - 1)]))
        rate = costs.of(length) / filled
        if best is None or rate < best[0]:
            best = (rate, length)
    return best[1]


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, costs: Costs = Costs()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in descending size: the bin of each, its offset there, and each bin's final length."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    words = np.bincount(sizes, weights=sizes, minlength=top + 1)[: top + 1]
    of, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), sorted: the first that fits fits best
    rest, stale = np.cumsum(words), 0
    for i, size in enumerate(sizes.tolist()):
        words[size] -= size
        stale += 1
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            if stale:
                rest, stale = np.cumsum(words), 0
            b = len(used)
            room = open_length(size, rest, lengths, costs)
            used.append(0)
        of[i], at[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    final = np.array(lengths, np.int64)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return of, at, final


def pieces(docs: DataFrame, top: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, copy, start, size): the word ranges of each text, none longer than `top`. `digest` is a hash of the text, and
    rows of equal id and text are copies, numbered from 1."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), n.alias("n")).filter("n > 0")
    each = sized.groupBy("doc_id", "digest", "n").agg(F.count("*").alias("copies"))
    # in two steps, so that no row holds a long array, however often a text is repeated
    step = F.lit(1 << 12)
    each = each.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), step.cast("long"))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + step - 1, F.col("copies")))))
    each = each.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))))
    return each.select("doc_id", "digest", "copy", "start", F.least(F.lit(top).cast("long"), F.col("n") - F.col("start")).cast("int").alias("size"))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, costs: Costs = Costs(), shard: int = SHARD, **columns: str) -> DataFrame:
    """(bin, length, offset, doc_id, digest, copy, start, size) of every piece: `bin` is unique, `length` its permitted length,
    `offset` the piece's first word there, `start` its first word in the text."""
    lengths = tuple(sorted(lengths))
    items = cut(pieces(docs, lengths[-1], **columns))
    shards = max(1, -(-items.count() // shard))
    # dealt by all that tells pieces apart: no source, language, length or group of copies gathers in one task
    order = ("doc_id", "digest", "copy", "start")
    items = items.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    items = items.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.desc("size"), *order)
    kind = items.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One shard."""
            t = pa.Table.from_batches(held)
            of, at, final = pack(t.column("size").to_numpy().astype(np.int64), lengths, costs)
            first = np.int64(t.column("shard")[0].as_py()) << 32
            names = (*order, "size")
            cols = [pa.array(first + of), pa.array(final[of].astype(np.int32)), pa.array(at.astype(np.int32)), *[t.column(c).combine_chunks() for c in names]]
            yield from pa.table(cols, names=["bin", "length", "offset", *names]).to_batches(1 << 14)

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            shards_here = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(shards_here[1:] != shards_here[:-1]) + 1).tolist(), len(shards_here)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and now != shards_here[a]:
                    yield from out(held)
                    held = []
                now = shards_here[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    return items.mapInArrow(run, f"bin long, length int, offset int, doc_id {kind}, digest long, copy long, start long, size int")


def slices(text: str, top: int) -> list[str]:
    """The text cut before every `top`-th of its words: together they are the text."""
    if len(text) < 2 * top:  # too short for more than `top` words
        return [text]
    at = [m.start() for i, m in enumerate(_WORD.finditer(text)) if i % top == 0][1:]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


def pack_texts(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, costs: Costs = Costs(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What pack_documents returns, and `text`: the piece of the text, with the white space around and between its words.

    A bin's sequence is its rows' texts in order of `offset`; a copy's text is its rows' texts in order of `start`."""
    top = max(lengths)
    plan = cut(pack_documents(docs, lengths, costs, doc_id=doc_id, text=text))
    # each different text once, however many copies of it are packed
    whole = docs.select(F.col(doc_id).alias("t_id"), F.xxhash64(text).alias("t_digest"), F.col(text).alias("t_text")).filter("t_text is not null").dropDuplicates(["t_id", "t_digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # row by row, as a long text gives many
                parts = slices(batch.column(2)[i].as_py(), top)
                one = pa.array([i] * len(parts), pa.int64())
                yield pa.record_batch([batch.column(0).take(one), batch.column(1).take(one), pa.array([k * top for k in range(len(parts))], pa.int64()), pa.array(parts, pa.string())], ["t_id", "t_digest", "t_start", "text"])

    kind = whole.schema["t_id"].dataType.simpleString()
    parts = bounded_batches(whole).mapInArrow(run, f"t_id {kind}, t_digest long, t_start long, text string")
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("digest") == F.col("t_digest")) & (F.col("start") == F.col("t_start"))
    return plan.join(parts, same).select("bin", "length", "offset", "doc_id", "digest", "copy", "start", "size", "text")
