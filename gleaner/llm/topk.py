"""Exact top-k inner products by pivot-table elimination.

A table of distances from every vector to many pivots, and to the origin, is computed beforehand. Together the distances fix a
vector's place in the pivots' span and how far from the span it lies; the table keeps just these: coordinates a in an
orthonormal basis of the span and the rest r. For a query q and a candidate x the largest lower bound on their squared distance
that the tables allow is |a(q) - a(x)|^2 + (r(q) - r(x))^2, and with the two norms this is an upper bound on the inner product:
q.x <= a(q).a(x) + r(q) r(x). Candidates are evaluated in the order of that bound, step after step, until the next bound is
below the k-th best score found; ties are evaluated, so the result is exact.

Work is dealt out by blocks. Vectors lie in blocks with others near the same pivot; each block's descriptor has the centre
and the spread of its table rows, so that a bound on a query's scores in the whole block follows from the descriptor alone. First
every block of queries meets the blocks that suit most of them best, whose k-th scores are thresholds that go on with the
queries. Then it meets only the blocks in which some query's bound reaches its threshold: vectors of others are not sent. The
pivots are chosen far apart, from a bounded sample of SAMPLE rows with the least hashes: any choice gives the same result.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, as query or as
candidate; the first vector's dimension is expected of all, others raise; a candidate is not compared with
its own id, so rows that share a query's id are left out for it; repeated rows are candidates as often as
they occur, while a repeated query is answered once; equal scores go to the smaller id; with fewer than k candidates all are returned; empty tables
give no rows. Columns other than the id and the vector are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, cut, drop, partitions

#: Pivots: seven for eight dimensions, so that little of a vector is outside of their span, within these numbers.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 24, 256, 4096
#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 1024
#: Blocks that a block of queries meets before all others, at most; and bytes of block descriptors that are sent to every executor at once.
FIRST, BROADCAST_BYTES = 6, 32 << 20
#: Candidates whose scores are computed at once, in the order of their bounds; queries whose bounds are held at once.
STEP, ROWS = 64, 128
#: Bounds are rounded: what they may be too low by, absolutely and relative to the norms' product.
SLACK, RELATIVE = 1e-3, 1e-5


def integral(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x taken as double; null if any is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


# --- the pivot table ---


def pivots_for(dimensions: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 7 * dimensions // 8))


def _choose(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far apart from each other, the first of them far from the mean."""
    d = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = []
    for _ in range(min(n, len(sample))):
        i = int(d.argmax())
        chosen.append(i)
        d = np.minimum(d if len(chosen) > 1 else np.inf, ((sample - sample[i]) ** 2).sum(axis=1))
    return sample[chosen]


@dataclass(frozen=True)
class Table:
    """What pivot distances say: coordinates in the pivots' span, and the length of the rest."""

    pivots: np.ndarray
    basis: np.ndarray

    @staticmethod
    def of(pivots: np.ndarray) -> Table:
        u, s, _ = np.linalg.svd(pivots.T, full_matrices=False)
        return Table(pivots, u[:, s > 1e-9 * max(s.max(initial=0), 1e-300)])

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Coordinates and the rest, one vector a row."""
        a = x @ self.basis
        return np.hstack([a, np.sqrt(np.maximum((x**2).sum(axis=1) - (a**2).sum(axis=1), 0))[:, None]])

    def nearest(self, x: np.ndarray, most: int) -> np.ndarray:
        """The number of the nearest of the first `most` pivots, equal ones by order."""
        some = self.pivots[:most]
        return ((some**2).sum(axis=1)[None, :] - 2 * x @ some.T).argmin(axis=1)


def _slack(q_norm: np.ndarray, norm: np.ndarray | float) -> np.ndarray:
    return SLACK + RELATIVE * q_norm * norm


# --- blocks ---


@dataclass
class Block:
    """Vectors with their ids and table rows; of queries also the k-th best score so far, or the least number."""

    ids: np.ndarray
    vectors: np.ndarray
    table: np.ndarray

    @staticmethod
    def read(ids: bytes, vectors: bytes, kind: str, table: bytes) -> Block:
        i = np.frombuffer(ids, np.int64)
        return Block(i, np.frombuffer(vectors, kind).reshape(len(i), -1), np.frombuffer(table, np.float32).reshape(len(i), -1))

    def norms(self) -> np.ndarray:
        return np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < 2**53:  # exact in floating point, and faster
        return np.rint(vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


def search_block(q: Block, least: np.ndarray, x: Block, k: int) -> tuple[list[int], list[int], list[int], int]:
    """(query ids, candidate ids, scores) of each query's best k in one block, if they reach the scores `least`; and how many
    scores it took."""
    out_q: list[int] = []
    out_x: list[int] = []
    out_s: list[int] = []
    evaluated = 0
    norm, q_norms = float(x.norms().max(initial=0)), q.norms()
    for at in range(0, len(q.ids), ROWS):
        bounds = q.table[at : at + ROWS] @ x.table.T
        bounds += _slack(q_norms[at : at + ROWS], norm)[:, None].astype(np.float32)
        for i, bound in enumerate(bounds, at):
            need, best_s, best_x = float(least[i]), np.zeros(0, np.int64), np.zeros(0, np.int64)
            left = np.flatnonzero((bound >= need) & (x.ids != q.ids[i]))
            take = STEP
            while len(left):
                # the next candidates by bound, put in order only as far as they are needed
                some = left if len(left) <= take else left[np.argpartition(-bound[left], take - 1)[:take]]
                evaluated += len(some)
                s, ids = np.r_[best_s, _scores(x.vectors[some], q.vectors[i])], np.r_[best_x, x.ids[some]]
                top = np.lexsort((ids, -s))[:k]
                best_s, best_x = s[top], ids[top]
                if len(some) == len(left):
                    break
                if len(best_s) == k:
                    need = max(need, float(best_s[-1]))
                bound[some] = -np.inf
                left = left[bound[left] >= need]
                take *= 2
            reach = best_s >= least[i]
            out_q += [int(q.ids[i])] * int(reach.sum())
            out_x += best_x[reach].tolist()
            out_s += best_s[reach].tolist()
    return out_q, out_x, out_s, evaluated


_PACKED = "ids binary, vectors binary, kind string, `table` binary, centre binary, spread double, rest double, norm double"


def _packed(rows: DataFrame, size: int, table: Table) -> DataFrame:
    """Up to `size` rows of equal `group`, which follow each other, together as bytes; and the descriptor: centre and spread of the
    coordinates, largest rest and norm."""
    dims = len(table.basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n, now = [], [], 0, None

        def out():
            v, i = np.concatenate(vectors), np.concatenate(ids)
            f = v.astype(np.float64)
            t = table.rows(f)
            centre = t[:, :-1].mean(axis=0)
            spread = float(np.sqrt(((t[:, :-1] - centre) ** 2).sum(axis=1)).max())
            kind = next(c for c in ("int8", "int16", "int32", "int64") if np.iinfo(c).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(c).max)
            row = {"ids": i.tobytes(), "vectors": v.astype(kind).tobytes(), "kind": kind, "table": t.astype(np.float32).tobytes(), "centre": centre.tobytes(), "spread": spread, "rest": float(t[:, -1].max()), "norm": float(np.sqrt((f**2).sum(axis=1)).max())}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string()), ("table", pa.binary()), ("centre", pa.binary()), ("spread", pa.float64()), ("rest", pa.float64()), ("norm", pa.float64())]))

        for batch in batches:
            group = batch.column(2).to_numpy()
            edges = sorted({*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), *range(0, len(group), size), len(group)})
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if n and (n + part.num_rows > size or group[a] != now):
                    yield out()
                    ids, vectors, n = [], [], 0
                now = group[a]
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != part.num_rows * dims:
                    raise ValueError("vectors differ in dimension")
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                vectors.append(flat.reshape(part.num_rows, -1).astype(np.int64))
                n += part.num_rows
        if n:
            yield out()

    # numbers that hold once the blocks are written out
    return rows.mapInArrow(run, _PACKED).withColumn("block", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, size: int, count: int, table: Table, apart: bool) -> DataFrame:
    """Blocks of vectors near the same pivot, or, if not `apart`, near few; a pivot with many vectors has many blocks."""
    dims = len(table.basis)
    n = max(1, -(-count // size))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != batch.num_rows * dims:
                raise ValueError("vectors differ in dimension")
            cell = table.nearest(flat.reshape(-1, dims).astype(np.float64), 2 * n) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], ["id", "vector", "cell"])

    celled = rows.mapInArrow(near, "id long, vector array<long>, cell int").withColumn("h", F.xxhash64("id", "vector"))
    dealt = celled.repartitionByRange(n, "cell", "h").sortWithinPartitions("cell", "h")
    return _packed(dealt.select("id", "vector", F.col("cell") if apart else F.lit(0).alias("cell")), size, table)


# --- which blocks to compare ---


def _pairs(asks: DataFrame, blocks: DataFrame, with_least: bool, first: int | None) -> DataFrame:
    """(q_block, block): with `first`, so many blocks whose centres are best for most of a query block's queries; else those where some query's bound reaches its
    `least` score. Descriptors of all blocks pass each query block, in pieces of bounded size."""
    out = None
    described = blocks.select("block", "centre", "spread", "rest", "norm")
    dims = described.limit(1).collect()
    if not dims:
        return blocks.sparkSession.createDataFrame([], "q_block long, block long")
    pieces = max(1, -(-blocks.count() * (len(dims[0]["centre"]) + 64) // BROADCAST_BYTES))
    for piece in range(pieces):
        some = described.filter(F.pmod(F.col("block"), F.lit(pieces)) == piece).toArrow()
        sent = asks.sparkSession.sparkContext.broadcast((some.column("block").to_numpy(), np.stack([np.frombuffer(c, np.float64) for c in some.column("centre").to_pylist()]) if some.num_rows else None, *(some.column(c).to_numpy() for c in ("spread", "rest", "norm"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            numbers, centres, spread, rest, norm = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    q = Block.read(r["ids"], r["vectors"], r["kind"], r["table"])
                    a, q_norms = q.table[:, :-1].astype(np.float64), q.norms()
                    if first is None:
                        least = np.frombuffer(r["least"], np.int64).astype(np.float64)
                    best = np.full(len(numbers), -np.inf if first is None else 0.0)
                    for i in range(len(a)):
                        middle = centres @ a[i]
                        if first is None:
                            bound = middle + np.sqrt((a[i] ** 2).sum()) * spread + q.table[i, -1] * rest + _slack(q_norms[i], norm)
                            best = np.maximum(best, bound - least[i])
                        else:
                            best[middle.argmax()] += 1
                    hit = np.flatnonzero(best >= 0) if first is None else np.argsort(-best, kind="stable")[: min(first, max(1, np.count_nonzero(best)))]
                    yield pa.record_batch([pa.array(np.full(len(hit), r["block"])), pa.array(numbers[hit]), pa.array(best[hit])], ["q_block", "block", "bound"])

        if some.num_rows:
            part = asks.select("block", "ids", "vectors", "kind", "table", *["least"] * with_least).mapInArrow(run, "q_block long, block long, bound double")
            out = part if out is None else out.unionByName(part)
    if first is not None and pieces > 1:
        rank = F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("bound"), "block"))
        out = out.withColumn("n", rank).filter(F.col("n") <= first)
    return out.select("q_block", "block")


def _compared(pairs: DataFrame, asks: DataFrame, blocks: DataFrame, k: int, with_least: bool) -> DataFrame:
    """(q_block, query_id, vec_id, score, evaluated) of pairs of blocks; a row without query_id has what the pair evaluated."""
    q = asks.select(F.col("block").alias("a_block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "kind", "table", *["least"] * with_least)])
    x = blocks.select(F.col("block").alias("b_block"), *[F.col(c).alias(f"x_{c}") for c in ("ids", "vectors", "kind", "table")])
    n = partitions(pairs.sparkSession)  # as asked for, as Spark would else join small tables in few tasks
    asked = pairs.join(q, F.col("q_block") == F.col("a_block")).repartition(n, "block")
    met = asked.join(x.repartition(n, "b_block"), F.col("block") == F.col("b_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # pair by pair: a batch of them in Python objects would be large
                r = batch.slice(i, 1).to_pylist()[0]
                q, x = (Block.read(*(r[f"{s}_{c}"] for c in ("ids", "vectors", "kind", "table"))) for s in "qx")
                least = np.frombuffer(r["q_least"], np.int64) if with_least else np.full(len(q.ids), np.iinfo(np.int64).min)
                a, b, c, evaluated = search_block(q, least, x, k)
                cols = [pa.array([r["q_block"]] * (len(a) + 1), pa.int64()), *(pa.array([None, *v], pa.int64()) for v in (a, b, c)), pa.array([evaluated] + [0] * len(a), pa.int64())]
                yield pa.record_batch(cols, ["q_block", "query_id", "vec_id", "score", "evaluated"])

    return bounded_batches(met.drop("a_block", "b_block")).mapInArrow(run, "q_block long, query_id long, vec_id long, score long, evaluated long")


def search(rows: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "vector") -> DataFrame | None:
    """(query_id, vec_id, score, evaluated): a superset of each query's k best, and rows without query_id that say how many
    scores were computed; None without a vector or query."""
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), query.alias("asks")).filter("id is not null and vector is not null and size(vector) > 0")
    sample = [r["vector"] for r in rows.select("vector").orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).collect()]
    if not sample:
        return None
    if len({len(v) for v in sample}) > 1:
        raise ValueError("vectors differ in dimension")
    table = Table.of(_choose(np.array(sample, np.float64), pivots_for(len(sample[0]))))
    n, asking = (int(v) for v in rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first())
    if not asking:
        return None
    few = max(256, min(CANDIDATES, -(-n // partitions(spark))))  # small tables: still a block for each core
    blocks = cut(_blocks(rows.select("id", "vector"), few, n, table, True))
    asks = cut(_blocks(rows.filter("asks").select("id", "vector").distinct(), QUERIES, asking, table, False))
    begun = cut(_pairs(asks, blocks, False, FIRST))
    near = cut(_compared(begun, asks, blocks, k, False))
    armed = cut(_with_least(asks, near, k))
    rest = _pairs(armed, blocks, True, None).join(begun, ["q_block", "block"], "left_anti")
    far = cut(_compared(rest, armed, blocks, k, True))
    for done in (begun, armed, asks, blocks):
        drop(done)
    return near.unionByName(far).drop("q_block")


def _with_least(asks: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Query blocks with `least`: each query's k-th score so far, or the least number where it has no k yet."""
    rank = F.row_number().over(Window.partitionBy("q_block", "query_id").orderBy(F.desc("score")))
    kth = near.filter("query_id is not null").withColumn("n", rank).filter(F.col("n") == k)
    kth = kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("kth"))  # one for each of at most QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                found = {p["query_id"]: p["score"] for p in r["kth"] or []}
                least = np.array([found.get(int(q), np.iinfo(np.int64).min) for q in np.frombuffer(r["ids"], np.int64)], np.int64)
                cols = [batch.column(c).slice(i, 1) for c in ("block", "ids", "vectors", "kind", "table")]
                yield pa.record_batch([*cols, pa.array([least.tobytes()], pa.binary())], ["block", "ids", "vectors", "kind", "table", "least"])

    met = asks.select("block", "ids", "vectors", "kind", "table").join(kth, F.col("block") == F.col("q_block"), "left").drop("q_block")
    return bounded_batches(met).mapInArrow(run, "block long, ids binary, vectors binary, kind string, `table` binary, least binary")


def top_k(rows: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every row that `query` selects with all
    other rows. `vector` holds whole numbers (see integral)."""
    best = search(rows, query, k, key, vector)
    if best is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = best.filter("query_id is not null").withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def scored_share(rows: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "vector") -> float:
    """The share of all pairs of a query and a candidate whose scores top_k computes."""
    best = search(rows, query, k, key, vector)
    if best is None:
        return 0.0
    sound = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    asking = sound.filter(query).select(key, vector).distinct().count()
    return best.agg(F.sum("evaluated")).first()[0] / (asking * sound.count())
