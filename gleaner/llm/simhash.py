"""SimHash near-duplicates, linked exactly within a Hamming distance by the generalised pigeonhole principle.

Fingerprints: a text's words (A-Z lower-cased) give shingles, repeats included; bit i of the fingerprint is
set if it is set in more than half of the shingles' XXH64 hashes.

Links: the 64 bits are grouped into m partitions, correlated bits together. If two fingerprints differ in
at most t bits and thresholds T1..Tm (each at least -1) add up to t - m + 1, then they differ in at most Ti
bits within some partition i. A dynamic programme picks the thresholds, and the number of partitions,
with the least estimated work: index rows, and pairs to verify, which follow from how often
fingerprints agree in a partition (counted over all fingerprints) and from each bit's share of ones. A
partition with threshold Ti is probed by masking every choice of Ti of its bits: two fingerprints within
Ti bits there share a masked value. Within such a bucket distances are verified; only a spanning
forest of the links is kept, so a dense bucket costs as many rows as it has members (see buckets).
`classes` links equal and near fingerprints; equal ones are one node from the start, whatever number of documents has them.

`keep_one` and `near_classes` link texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts with the
same set are one node. The fingerprints that find candidates are of the different shingles of SEARCH_SHINGLE words: an edit
changes fewer of these than of five-word ones, so that fingerprints differ in fewer bits. A candidate pair is tested in its bucket
by WORDS * 64 further bits, of the five-word shingles, with room for the estimate's error; a spanning forest of the most alike
pairs is then verified by the shingle sets themselves. So no link is false; one is lost if its fingerprints differ in more bits
than either step admits, or if pairs that look more alike, but aren't, took its place in the forest.

Defined cases: a null text, or one without words, has fingerprint 0, linked like any other; a text with fewer
words than a shingle is one shingle; texts without shingles have similarity 1 with each other and 0 with others;
a component's id is its smallest doc_id (null only if all of its
doc_ids are); repeated rows share a component; empty tables give no rows. Columns other than the id and
the text are not read, so their names can't clash; `keep_one` returns all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import buckets
from gleaner.llm.common import bounded_batches, cut
from gleaner.llm.components import components

BITS, SEED = 64, 42
#: Words of a shingle of the fingerprints that find candidates, and 64-bit words that test them.
SEARCH_SHINGLE, WORDS = 2, 4
#: Share of pairs at the least similarity that either step should let pass.
SEARCH_RECALL, TEST_RECALL = 0.9, 0.98
#: Estimated work: an index row against a pair to verify.
ROW_COST, PAIR_COST = 100.0, 1.0
PARTITIONS = (2, 3, 4, 5, 6, 7)
#: Keys of dropped rows are sent to every executor up to this many bytes.
BROADCAST_BYTES = 64 << 20


# --- fingerprints ---


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both concern ASCII only, as the contract asks
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends, at = b" ".join(words), [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last], ends[shingle - 1 :] or ends[-1:], strict=True)), np.uint64, last)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    return _majority(_shingle_hashes(text, shingle))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of different shingles' hashes, and of hashes of these."""
    h, out = shingles, []
    for _ in range(WORDS):
        out.append(_majority(h))
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return np.array(out, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    return np.unique(_shingle_hashes(text, shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two shingle sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp) of every row: digest is a hash of the text, fp the fingerprint as a signed long."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "digest", "fp"])

    return bounded_batches(ids).mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, digest long, fp long")


def set_prints(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, node, fp, words) of every row: node is a hash of the text's shingle set, fp the fingerprint that finds
    candidates, and words the bytes of the wide fingerprint that tests them."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, words = [], [], []
            for t in batch.column(2).to_pylist():
                shingles = shingle_set(t, shingle)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                fps.append(_majority(shingle_set(t, SEARCH_SHINGLE)))
                words.append(wide_fingerprint(shingles).tobytes())
            cols = [batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)), pa.array(words, pa.binary())]
            yield pa.record_batch(cols, ["doc_id", "digest", "node", "fp", "words"])

    return bounded_batches(ids).mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, digest long, node long, fp long, words binary")


# --- partitions and thresholds ---


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often bits i and j are set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
            n += len(x)
            for i in range(0, len(x), 1 << 14):  # float32 sums of so few ones are exact
                both += x[i : i + (1 << 14)].T @ x[i : i + (1 << 14)]
        yield pa.record_batch([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel(), float(n)], pa.float64())], ["cell", "value"])

    cells = {r["cell"]: r["value"] for r in nodes.select("fp").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    n = int(cells.get(BITS * BITS, 0))
    return n, np.array([cells.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]  # column i is bit i


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Partitions of nearly equal width; each takes up the bits that are most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (round(sum(corr[b, c] for c in left if c != b), 9), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (round(sum(corr[b, c] for c in group), 9), -b))
            group.append(best)
            left.remove(best)
        out.append(tuple(sorted(group)))
    return out


def _mask(bits: tuple[int, ...]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def agreements(nodes: DataFrame, groups: list[tuple[int, ...]]) -> list[float]:
    """For each group of bits, how many ordered pairs of different fingerprints agree in all of them."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v")) for i, g in enumerate(groups)])).alias("k")
    counts = nodes.select(keys).groupBy("k.g", "k.v").agg(F.count("*").cast("double").alias("n"))
    found = {r["g"]: r["pairs"] for r in counts.groupBy("g").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).collect()}
    return [found.get(i, 0.0) for i in range(len(groups))]


def allocate(n: int, ones: np.ndarray, groups: list[tuple[int, ...]], agree: list[float], most: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated work that add up to most - m + 1; and that work."""
    table = []
    for bits, pairs in zip(groups, agree, strict=True):
        differ = np.array([1.0])  # of two fingerprints: chances to differ in 0, 1, ... bits of the group
        for b in bits:
            q = 2 * ones[b] / max(n, 1) * (1 - ones[b] / max(n, 1))
            differ = np.convolve(differ, [1 - q, q])
        row = {-1: 0.0}
        for t in range(min(most, len(bits)) + 1):
            # masked buckets: a pair that differs in d bits meets in those masks that cover them
            meet = sum(differ[d] / max(differ[0], 1e-300) * comb(len(bits) - d, t - d) for d in range(t + 1))
            row[t] = ROW_COST * n * comb(len(bits), t) + PAIR_COST * max(pairs, 1.0) / 2 * meet
        table.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in table:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in row.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[most - len(groups) + 1]


def plan(nodes: DataFrame, most: int) -> list[tuple[int, ...]]:
    """The masks to probe with, as signed longs of the bits that stay: the cheapest plan of PARTITIONS.

    `nodes` has one row for each different fingerprint."""
    n, both = bit_moments(nodes)
    options = [group_bits(n, both, m) for m in PARTITIONS if m <= most + 1] or [group_bits(n, both, 1)]
    agree = iter(agreements(nodes, [g for o in options for g in o]))
    costs = [allocate(n, np.diag(both), o, [next(agree) for _ in o], most) for o in options]
    (_, chosen), groups = min(zip(costs, options, strict=True), key=lambda x: x[0][0])
    return [_mask(tuple(b for b in g if b not in hidden)) for g, t in zip(groups, chosen, strict=True) if t >= 0 for hidden in map(set, combinations(g, t))]


# --- links ---


def links(nodes: DataFrame, most: int, block: int = buckets.BLOCK, most_wide: int | None = None) -> DataFrame:
    """(a, b): links of fingerprints within `most` bits, that together join whatever is linked by steps.

    With `most_wide`, nodes have `node` and `words`, and all bits of `words` together may differ in so many."""
    masks = plan(nodes if most_wide is None else nodes.select("fp").distinct(), most)
    # different masks, or values, that met in one bucket key would only add pairs, which are verified
    probe = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks)])).alias("p")
    # whole, as a payload's bytes have the same order for all
    payload = [] if most_wide is None else [F.concat(F.unhex(F.lpad(F.hex("fp"), 16, "0")), "words").alias("payload")]
    key = F.xxhash64("p.i", F.col("fp").bitwiseAND(F.col("p.m"))).alias("key")
    node = F.col("fp" if most_wide is None else "node").alias("node")
    rows = nodes.select("fp", node, *payload, probe).select(key, "node", *["payload"] * len(payload))

    def apart(loads: np.ndarray, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        if most_wide is None:  # as unsigned: of signed numbers bitwise_count counts the absolute value's bits
            d = np.bitwise_count((loads[i] ^ loads[j]).view(np.uint64)).astype(np.int16)
            return np.where(d <= most, d, buckets.FAR)
        words = loads.view(np.uint64)[:, 1:]
        near = np.bitwise_count(words[i, 0] ^ words[j, 0])
        out, some = np.full(len(near), buckets.FAR), np.flatnonzero(near <= most)
        if len(some):
            wide = np.bitwise_count(words[i[some], 1:] ^ words[j[some] if isinstance(j, np.ndarray) else j, 1:]).sum(axis=1, dtype=np.int16)
            out[some] = np.where(wide <= most_wide, wide + near[some], buckets.FAR)
        return out

    return buckets.links(rows, apart, block)


def classes(prints: DataFrame, most: int = 4, block: int = buckets.BLOCK) -> DataFrame:
    """(doc_id, digest, fp, component_id) for fingerprints() rows: fingerprints within `most` bits are linked.

    `component_id` is the component's least doc_id."""
    prints = cut(prints)
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    by_node = _named(nodes.withColumnRenamed("fp", "node"), links(nodes.select("fp"), most, block))
    return prints.join(by_node, F.col("fp") == F.col("f"), "left").select("doc_id", "digest", "fp", "component_id")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(f, root, component_id) of every (node, first): its component's least node and least `first`."""
    roots = components(edges).withColumnRenamed("node", "n")
    named = nodes.join(roots, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    # written out first: next to an aggregation Spark can't split a join's hot keys
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r"))
    return named.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("f"), "root", "component_id")


# --- near duplicates by the similarity of shingle sets ---


def differing(similarity: float) -> float:
    """Expected share of differing bits: a Jaccard similarity s of sets of like size is a cosine of 2s / (1 + s), and bits differ in
    proportion to the angle."""
    return acos(2 * similarity / (1 + similarity)) / pi


def search_similarity(similarity: float, shingle: int, shorter: int) -> float:
    """The similarity of texts' sets of shorter shingles, if scattered edits leave them this similarity of longer ones."""
    kept = (2 * similarity / (1 + similarity)) ** (shorter / shingle) if shorter < shingle else 2 * similarity / (1 + similarity)
    return kept / (2 - kept)


def bits_for(similarity: float, bits: int, recall: float) -> int:
    """In how many of `bits` bits fingerprints at this similarity differ at most, but for a share of 1 - recall."""
    p, chance = differing(similarity), 0.0
    for most in range(bits + 1):
        chance += comb(bits, most) * p**most * (1 - p) ** (bits - most)
        if chance >= recall:
            return most
    return bits


def verified(edges: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """The (a, b) edges whose nodes' texts have shingle sets of at least that similarity.

    `nodes` names one row of `docs` for each node by `one` (doc_id, digest). Only texts with an edge are read again; sets travel by
    joins on one node each, whose hot keys Spark can split, and two of them meet in a row."""
    ends = edges.select(F.col("a").alias("e")).unionByName(edges.select(F.col("b").alias("e"))).distinct()
    wanted = _sized(cut(nodes.join(ends, F.col("node") == F.col("e"), "left_semi").select("node", F.col("one.doc_id").alias("g_id"), F.col("one.digest").alias("g_digest"))))
    rows = docs.select(F.col(doc_id).alias("d_id"), F.xxhash64(text).alias("d_digest"), F.col(text).alias("d_text"))
    rows = rows.join(wanted, F.col("d_id").eqNullSafe(F.col("g_id")) & (F.col("d_digest") == F.col("g_digest"))).select("node", "d_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["node", "shingles"])

    # a row that occurs several times gives its set several times; one of them stays
    each = cut(bounded_batches(rows).mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))
    left, right = each.select(F.col("node").alias("l"), F.col("shingles").alias("x")), each.select(F.col("node").alias("r"), F.col("shingles").alias("y"))
    met = edges.join(left, F.col("a") == F.col("l")).select("a", "b", "x").join(right, F.col("b") == F.col("r")).select("a", "b", "x", "y")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [jaccard(*(np.frombuffer(v.as_py(), np.uint64) for v in pair)) >= similarity for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(hits, pa.bool_()))

    return bounded_batches(met).mapInArrow(alike, "a long, b long")


def near_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", block: int = buckets.BLOCK) -> DataFrame:
    """(doc_id, digest, root, component_id) of every row of `docs`: `root` and `component_id` are its component's least node and
    doc_id. Texts are linked whose shingle sets have at least that similarity."""
    prints = cut(set_prints(docs, shingle, doc_id, text))
    nodes = cut(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("words").alias("words"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "digest")).alias("one")))
    most, wide = bits_for(search_similarity(similarity, shingle, SEARCH_SHINGLE), BITS, SEARCH_RECALL), bits_for(similarity, BITS * WORDS, TEST_RECALL)
    found = links(nodes.select("node", "fp", "words"), most, block, wide)
    found = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    by_node = _named(nodes.select("node", "first"), verified(found, nodes, docs, shingle, similarity, doc_id, text))
    return prints.join(by_node, F.col("node") == F.col("f"), "left").select("doc_id", "digest", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, less all but one of each component: the one with the least doc_id."""
    found = cut(near_classes(docs, shingle, similarity, doc_id, text).select("root", "doc_id", "digest"))
    # rows of equal id and text are one key; of each component's keys the least stays
    keys = found.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = keys.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select(F.col("root").alias("r"), F.col("first.doc_id").alias("i"), F.col("first.digest").alias("d"))
    # joined on the whole key: a large component's rows are dealt out like any others
    stays = (F.col("root") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    keys = cut(keys.join(first, stays, "left").select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest"), "n", F.col("r").isNotNull().alias("stays")))

    def same(rows: DataFrame, keys: DataFrame) -> Column:
        return rows[doc_id].eqNullSafe(keys["g_id"]) & (F.xxhash64(rows[text]) == keys["g_digest"])

    gone = _sized(keys.filter(~F.col("stays")).select("g_id", "g_digest"))
    kept = docs.join(gone, same(docs, gone), "left_anti")
    often = cut(keys.filter(F.col("stays") & (F.col("n") > 1)).select("g_id", "g_digest"))
    if often.isEmpty():
        return kept
    often = _sized(often)
    repeated = kept.join(often, same(kept, often), "left_semi").dropDuplicates([doc_id, text])
    return kept.join(often, same(kept, often), "left_anti").unionByName(repeated)


def _sized(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if small enough; beyond, Spark shuffles both sides of the join."""
    return F.broadcast(keys) if keys.count() * 24 <= BROADCAST_BYTES else keys


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
