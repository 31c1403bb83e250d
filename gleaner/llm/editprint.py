"""Document fingerprints by randomised edit embedding.

A walk steps through a text: at step t it writes out the character it stands on, and a shared random bit
for (t, character) says whether it moves on. Two texts walk with the same bits, so after an insertion or
deletion their walks soon fall into step again, and edit distance becomes Hamming distance of what they
write. SLOTS positions of that output are sampled; each gives BITS bits of a hash of the position and
of the characters from there on. Positions are sampled consistently: slot k takes the last of its own
random record times that the output reaches, so that texts of similar length sample the same positions,
whatever their length, and no text is cut off.

`bands` groups the sampled bits into band keys; texts that share one are candidates: of texts of which a third is replaced at the
end, and which share 0.66 of their slots, 0.99 do (399 texts of sf0.01), of unrelated ones none did. `likeness` verifies:
the share of equal slots, less what chance gives. `near_classes` does both over a table: equal fingerprints are
one node, nodes that share a band are verified bucket by bucket, and linked ones get one class.

`follow` hands every text its successor in descending id, with one shuffle of the texts: ids are cut into
ranges at quantiles; the first text of each range is also sent to the range above it.

Defined cases: a null text is empty; empty texts have a fingerprint like any other, equal among
themselves; the last text's successor is the first one (itself, in a table of one row); equal ids are ordered
by text and lie in one range, like null ids, which come last; ids that are no whole numbers are null. Long texts are walked whole. Empty tables give no rows. Columns other than the
id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import buckets
from gleaner.llm.common import bounded_batches, cut, partitions
from gleaner.llm.components import components

SLOTS, BITS, BAND = 256, 8, 5
GRAM = 3
#: Walks share bits for (step modulo PERIOD, character class).
PERIOD, CLASSES, SEED = 4096, 64, 20260901


def _dwell() -> list[list[int]]:
    """For each character class and step: how many steps the walk stays on such a character."""
    moves = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    moves[:, -1] = True
    out = []
    for row in moves:
        at = np.flatnonzero(row)
        out.append((at[np.searchsorted(at, np.arange(PERIOD))] - np.arange(PERIOD) + 1).tolist())
    return out


def _records() -> np.ndarray:
    """For each slot the times at which a sequence of random numbers has a new least one, as far as any text can reach."""
    rng, out = np.random.default_rng(SEED + 1), []
    for _ in range(SLOTS):
        at, least, times = 0, rng.random(), [0]
        while at < 1 << 45:
            at += int(rng.geometric(least))
            least *= rng.random()
            times.append(at)
            if least < 1e-18:
                break
        out.append(times)
    width = max(map(len, out))
    return np.array([t + [np.iinfo(np.int64).max] * (width - len(t)) for t in out], np.int64)


class Embedding:
    """The shared randomness; made once for each task."""

    def __init__(self):
        self.dwell, self.records = _dwell(), _records()

    def codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)

    def walk(self, codes: np.ndarray, at: int = 0) -> np.ndarray:
        """The step at which the walk leaves each character, if it comes to the first at step `at`."""
        classes = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.uint8).tobytes()
        dwell, mask, out = self.dwell, PERIOD - 1, []
        leave = out.append
        for row in map(dwell.__getitem__, classes):
            at += row[at & mask]
            leave(at)
        return np.array(out, np.int64)

    def print(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """SLOTS numbers of BITS bits, for a text and its walk."""
        if not len(codes):
            return np.zeros(SLOTS, np.uint8)
        k = (self.records < left[-1]).sum(axis=1) - 1
        at = self.records[np.arange(SLOTS), k]
        i = np.searchsorted(left, at, side="right")
        padded = np.r_[codes + np.uint64(1), np.zeros(GRAM, np.uint64)]
        h = at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(SLOTS, dtype=np.uint64)
        for g in range(GRAM):
            h = (h ^ (padded[i + g] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - BITS)).astype(np.uint8)


def as_hex(slots: np.ndarray) -> str:
    return slots.astype(np.uint8).tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the share of equal slots, less what unequal texts have by chance."""
    chance = 2.0**-BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def bands(slots: np.ndarray) -> np.ndarray:
    """SLOTS // BAND keys of BAND slots each; texts that share one are candidates."""
    some = slots[: SLOTS // BAND * BAND].reshape(-1, BAND).astype(np.uint64)
    return (some << (np.arange(BAND, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1)


def share_band(a: np.ndarray, b: np.ndarray) -> bool:
    return bool((bands(a) == bands(b)).any())


# --- successors ---

_LOWEST = np.iinfo(np.int64).min


def _order_keys(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(int(_LOWEST)).to_numpy(zero_copy_only=False)


def _ranges(ids: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds of at most n ranges of ids; and each range's largest id, for those that have rows."""
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(found, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = _order_keys(batch.column(0))
                r = np.searchsorted(bounds, key, side="left")
                t = pa.table([pa.array(r, pa.int64()), pa.array(key)], names=["r", "key"]).group_by("r").aggregate([("key", "max")])
                yield from t.select(["r", "key_max"]).rename_columns(["r", "top"]).to_batches()

    tops = ids.mapInArrow(run, "r long, top long").groupBy("r").agg(F.max("top").alias("top")).collect()
    return bounds, {r["r"]: r["top"] for r in tops}


def follow(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (range, own, doc_id, text), each range in one partition, in descending id; a range ends with rows that
    are not its own, of which the first is its last row's successor."""
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds, tops = _ranges(base.select("doc_id"), n)
    ranges = sorted(tops)
    to = {tops[r]: ranges[(i + 1) % len(ranges)] for i, r in enumerate(ranges)}  # where a range's first row is the successor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(sorted(to), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _order_keys(batch.column(0))
            r = np.searchsorted(bounds, key, side="left")
            yield pa.record_batch([pa.array(r, pa.int32()), pa.array(np.ones(len(r), bool)), batch.column(0), batch.column(1)], ["range", "own", "doc_id", "text"])
            if len(again := np.flatnonzero(np.isin(key, first))):
                copies = batch.take(pa.array(again))
                yield pa.record_batch([pa.array([to[int(k)] for k in key[again]], pa.int32()), pa.array(np.zeros(len(again), bool)), copies.column(0), copies.column(1)], ["range", "own", "doc_id", "text"])

    dealt = bounded_batches(base).mapInArrow(run, "range int, own boolean, doc_id long, text string").repartitionById(max(n, len(bounds) + 1), F.col("range"))
    return dealt.sortWithinPartitions(F.desc("own"), F.desc_nulls_last("doc_id"), "text")


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by the start of the following one; and how many characters stay."""
    third = len(text) // 3
    kept = len(text) - third
    return text[:kept] + following[:third], kept


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, bands) of every row."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Embedding()
        for batch in batches:
            slots = [e.print(c := e.codes(t), e.walk(c)) for t in batch.column(1).to_pylist()]
            keys = pa.array([bands(s).astype(np.int64).tolist() for s in slots], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(map(as_hex, slots), pa.string()), keys], ["doc_id", "fingerprint", "bands"])

    return bounded_batches(base).mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fingerprint string, bands array<long>")


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, band_edited, band_next)
    of every row: how like its fingerprint is to that of its edited text and of the next text, and whether
    banding would make them candidates."""
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "band_edited", "band_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Embedding()
        before = None  # the row whose successor comes next
        for batch in batches:
            rows = []
            for own, key, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not own and before is None:
                    continue
                codes = e.codes(t)
                left = e.walk(codes)
                slots = e.print(codes, left)
                if before is not None:
                    b_key, b_text, b_codes, b_left, b_slots = before
                    new, kept = edited(b_text, t)
                    tail = codes[: len(b_text) - kept]
                    walked = np.r_[b_left[:kept], e.walk(tail, int(b_left[kept - 1]) if kept else 0)]
                    new_slots = e.print(np.r_[b_codes[:kept], tail], walked)
                    rows.append((b_key, len(b_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(b_slots), as_hex(new_slots), likeness(b_slots, new_slots), likeness(b_slots, slots), share_band(b_slots, new_slots), share_band(b_slots, slots)))
                before = (key, t, codes, left, slots) if own else None
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], columns)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, band_edited boolean, band_next boolean"
    return follow(docs, doc_id, text).mapInArrow(run, schema)


def near_classes(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", block: int = buckets.BLOCK) -> DataFrame:
    """(doc_id, fingerprint, class_id) of every row: texts that share a band and are at least `least` alike are linked;
    class_id is the least doc_id that links lead to."""
    found = cut(prints(docs, doc_id, text).select("doc_id", "fingerprint", F.xxhash64("fingerprint").alias("node")))
    nodes = cut(found.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("first")))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [bands(from_hex(f)) for f in batch.column(1).to_pylist()]
            n = SLOTS // BAND
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.record_batch([pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n))], ["i", "band", "node"])

    keyed = nodes.select("node", "fingerprint").mapInArrow(explode, "i int, band long, node long").select(F.xxhash64("i", "band").alias("key"), "node")
    # fingerprints travel only to the bands that several nodes share
    shared = cut(keyed).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rows = keyed.join(shared, "key", "left_semi").join(nodes.select("node", F.unhex("fingerprint").alias("payload")), "node").select("key", "node", "payload")
    chance = 2.0**-BITS
    equal = (least * (1 - chance) + chance) * SLOTS

    def apart(loads: np.ndarray, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        differ = (loads[i, 8:] != loads[j, 8:]).sum(axis=1, dtype=np.int16)
        return np.where(SLOTS - differ >= equal, differ, buckets.FAR)

    roots = components(buckets.links(rows, apart, block))
    named = nodes.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("class_id")).withColumnRenamed("root", "r")
    by_node = named.join(smallest, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "class_id")
    return found.join(by_node, F.col("node") == F.col("n"), "left").select("doc_id", "fingerprint", "class_id")
