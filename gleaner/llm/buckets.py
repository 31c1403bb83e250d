"""Linking the members of buckets, whatever their size, without making their pairs.

Rows are (key, node) or (key, node, payload): a node stands in the buckets of its keys, and `apart` says how far two
nodes of a bucket are from each other: apart(loads, i, j) gets rows of bytes, the node's eight and the payload (or the nodes
themselves, without a payload) and gives for each position in `i` its distance from the one in `j`, or from j; FAR if they are
not linked, 0 only if their rows are equal. What comes out joins, step by step, all nodes that are linked: of each bucket's links the spanning forest of least
distances, not all links. The forests of all buckets together hold that of the whole graph, as a link that is no bucket's
longest on a circle of links is kept.

Rows are sorted by bucket and streamed. Small buckets are compared pair by pair at once; in larger ones a tree grows by the
nearest node that it doesn't have, so that a bucket's pairs are never held. A bucket of more than
`block` rows is handed on in blocks, every two of which then meet in a bucket of their own: no bucket is
capped or dropped, and no task holds more than a few blocks.

Defined cases: a null key is a key like any other, nodes are not null; a node that stands in a bucket several times
is linked with itself if `apart` says so, which the forest leaves out; tables without rows have no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, partitions

#: Rows of one bucket that are compared in one piece.
BLOCK = 1 << 15
#: Buckets up to this size are compared pair by pair.
DENSE = 256
EDGE, HELD = 0, 1
FAR = np.int16(32767)

Apart = Callable[[np.ndarray, np.ndarray, "np.ndarray | int"], np.ndarray]


def _walk(nodes: np.ndarray, loads: np.ndarray, apart: Apart) -> tuple[list[int], list[int]]:
    """The forest of one bucket, node by node: each one reached is compared with those not yet reached."""
    a, b = [], []
    left, parent, best = np.arange(1, len(nodes)), np.zeros(len(nodes) - 1, np.int64), np.full(len(nodes) - 1, FAR)
    x = 0
    while len(left):
        d = apart(loads, left, x)
        if (same := d == 0).any():  # nothing is nearer
            a += [int(nodes[x])] * int(same.sum())
            b += nodes[left[same]].tolist()
            left, parent, best, d = left[~same], parent[~same], best[~same], d[~same]
            if not len(left):
                break
        nearer = d < best
        best[nearer], parent[nearer] = d[nearer], x
        k = int(best.argmin())
        x = int(left[k])
        if best[k] < FAR:
            a.append(int(nodes[parent[k]]))
            b.append(int(nodes[x]))
        left[k], parent[k], best[k] = left[-1], parent[-1], best[-1]
        left, parent, best = left[:-1], parent[:-1], best[:-1]
    return a, b


def _side_by_side(keys: np.ndarray, loads: np.ndarray, apart: Apart) -> tuple[np.ndarray, np.ndarray]:
    """All links within buckets, by position: of rows 1, 2, ... places apart; shorter links first."""
    left, right, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
    at = np.arange(len(keys))
    for step in range(1, DENSE):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        d = apart(loads, at, at + step)
        hit = at[d < FAR]
        left.append(hit)
        right.append(hit + step)
        length.append(d[d < FAR])
    order = np.argsort(np.concatenate(length), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of links, the first ones first, so that dense buckets don't return all their pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def _loads(batch: pa.RecordBatch) -> np.ndarray:
    if batch.num_columns == 2:
        return batch.column(1).to_numpy(zero_copy_only=False)
    nodes, rows = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
    return np.hstack([np.ascontiguousarray(nodes).view(np.uint8).reshape(-1, 8), np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)])


def _run(apart: Apart, with_load: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "part", *["load"] * with_load]

        def out(kind: int, a, b, part, loads=None) -> pa.RecordBatch:
            a = np.asarray(a, np.int64)
            cols = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(part, np.int32))]
            if with_load:
                cols.append(pa.nulls(len(a), pa.binary()) if loads is None else pa.array([x[8:].tobytes() for x in loads], pa.binary()))
            return pa.record_batch(cols, names)

        def links(keys: np.ndarray, nodes: np.ndarray, loads: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of whole buckets."""
            if len(nodes) < 2:
                return
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(cuts)
            small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= DENSE), sizes))
            i, j = _side_by_side(keys[small], loads[small], apart)
            a, b = _forest(nodes[small][i], nodes[small][j])
            yield out(EDGE, a, b, np.zeros(len(a)))
            for k in np.flatnonzero(sizes > DENSE):
                a, b = _walk(nodes[cuts[k] : cuts[k + 1]], loads[cuts[k] : cuts[k + 1]], apart)
                yield out(EDGE, a, b, np.zeros(len(a)))

        held = None  # the last bucket so far, which may go on
        big, seen = None, 0  # the bucket that has passed the block size, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes, loads = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _loads(batch)
            if held is not None:
                keys, nodes, loads = (np.concatenate(x) for x in zip(held, (keys, nodes, loads), strict=True))
                held = None
            if big is not None:
                n = int(np.searchsorted(keys != big, True)) if keys[-1] != big else len(keys)
                yield out(HELD, np.full(n, big), nodes[:n], (seen + np.arange(n)) // block, loads[:n] if with_load else None)
                seen += n
                keys, nodes, loads = keys[n:], nodes[n:], loads[n:]
                if not len(keys):
                    continue
                big = None
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes, last = np.diff(cuts), int(cuts[-2])
            for k in np.flatnonzero(sizes > block):
                part = slice(cuts[k], cuts[k + 1])
                yield out(HELD, keys[part], nodes[part], np.arange(sizes[k]) // block, loads[part] if with_load else None)
                if cuts[k] == last:
                    big, seen = keys[last], int(sizes[k])
            whole = np.flatnonzero(~np.repeat(sizes > block, sizes)[:last])
            yield from links(keys[whole], nodes[whole], loads[whole])
            if big is None:
                held = keys[last:], nodes[last:], loads[last:]
        if held is not None:
            yield from links(*held)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "node")


def links(rows: DataFrame, apart: Apart, block: int = BLOCK) -> DataFrame:
    """(a, b) links of nodes that together join all that is linked in any bucket."""
    with_load = "payload" in rows.columns
    schema = "kind int, a long, b long, part int" + ", load binary" * with_load
    found = cut(_dealt(rows).mapInArrow(_run(apart, with_load, block), schema))
    edges = found.filter(F.col("kind") == EDGE).select("a", "b")
    held = found.filter(F.col("kind") == HELD).withColumnRenamed("a", "key")
    if held.isEmpty():
        return edges
    # every two blocks of a bucket meet once, each pair of blocks in a bucket of its own
    last = held.groupBy("key").agg(F.max("part").alias("last")).withColumnRenamed("key", "k")
    pairs = held.join(last, F.col("key") == F.col("k")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    key = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key")
    pairs = pairs.select(key, F.col("b").alias("node"), *[F.col("load").alias("payload")] * with_load)
    more = _dealt(pairs).mapInArrow(_run(apart, with_load, 4 * block), schema)
    return edges.unionByName(more.filter(F.col("kind") == EDGE).select("a", "b"))
