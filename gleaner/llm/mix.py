"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id and text. A source that must give `target` words out of `size` gives
all its documents floor(target / size) times, and once more those whose hash is at most the source's
threshold. The threshold comes from histograms: words summed by source and by the top 12 bits of the hash
show in which bucket the budget is crossed; only that boundary bucket is summed again by the next 12 bits,
and so on until it holds a single hash. No documents are sorted. What the document at the boundary
would exceed is filled up in two further rounds, by documents beyond the threshold that are small enough: a source
then has three nested thresholds, the later ones with a largest size. In the first round a larger budget
takes a superset of what a smaller one takes.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last in order; rows of equal id, source and text are numbered, and the number is hashed as well, so that repeated rows are taken
one by one; a null id or text is hashed like an empty one; an empty table gives no rows. The last threshold falls where the words taken come nearest to the target, the
smaller on a tie; an earlier one may pass it by an EARLY-th of what would stay open. The driver holds one row for each source, as the mixing weights themselves do. Columns other
than the id, the source and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, cut, small_frame

HASH_BITS, LEVEL_BITS, ROUNDS = 60, 12, 3
LARGEST = (1 << 63) - 1
#: Before the last round a document may exceed the room if that leaves an error so many times smaller.
EARLY = 8
DEFAULT_WEIGHTS, DEFAULT_SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2


def document_hash(doc_id: Column, digest: Column, ordinal: Column) -> Column:
    """HASH_BITS bits of the MD5 of the id, the text's MD5 and which of equal rows it is; any engine can compute it."""
    what = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), digest, ordinal.cast("string"))
    return F.conv(F.substring(F.md5(what.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, digest, ordinal, size, hash) of every document."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_digest(F.col(text)).alias("digest"), word_count(F.col(text)).alias("size"))
    each = numbered(each.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n")).withColumn("before", F.lit(0).cast("long")))
    return each.select("doc_id", "source", "digest", "ordinal", "size", document_hash(F.col("doc_id"), F.col("digest"), F.col("ordinal")).alias("hash"))


def numbered(rows: DataFrame, prefix: str = "") -> DataFrame:
    """`n` rows for each, with `ordinal` from before + 1 on; in two steps, so that no row holds a long array. Names have a prefix."""
    n, before, low, ordinal = (prefix + c for c in ("n", "before", "low", "ordinal"))
    step, last = F.lit(1 << 12).cast("long"), F.col(before) + F.col(n)
    rows = rows.withColumn(low, F.explode(F.sequence(F.col(before) + 1, last, step)))
    return rows.withColumn(ordinal, F.explode(F.sequence(F.col(low), F.least(F.col(low) + step - 1, last)))).drop(n, before, low)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = DEFAULT_WEIGHTS, share: float = DEFAULT_SHARE, most: int = MOST_TIMES) -> dict[str | None, float]:
    """Words to take of each source: `share` of all words by weight, at most `most` times a source's own, the excess reshared.

    Sources that stop at their limit are those with the least limit for their weight; the rest share what is left.
    """
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = share * sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):
        out[s] = min(float(most * sizes[s]), left / total * weight[s]) if total else 0.0
        if out[s] == most * sizes[s]:
            left, total = left - out[s], total - weight[s]
    return out


def thresholds(docs: DataFrame, plan: list[dict], rounds: int = ROUNDS) -> list[dict]:
    """Find for each source up to which hash its documents are taken once more.

    `docs` is a sized() frame that is cheap to read again; `plan` has source and budget. Returns the plan with
    `steps`, `rounds` pairs of a threshold and a size: between the threshold before (-1 at first) and its own, a
    pair takes the documents of at most its size. In the first round all sizes are taken up to the budget; in each
    further one the documents that still fit into what is left of it."""
    state = [p | {"room": float(p["budget"]), "after": -1, "steps": []} for p in plan]
    for k in range(rounds):
        for p in state:
            p["cap"] = LARGEST if k == 0 else int(p["room"])
            p["threshold"] = p["after"]
        _search(docs, [p for p in state if p["room"] > 0 and p["cap"] > 0], patience=1 if k == rounds - 1 else EARLY)
        for p in state:
            p["steps"].append((p["threshold"], p["cap"]))
            p["after"] = p["threshold"]
    return state


def _search(docs: DataFrame, state: list[dict], patience: int) -> None:
    """One round: set each source's threshold and take what it uses off its room.

    The documents up to the threshold stay within the room, but that the last one may exceed it if what it
    exceeds by is less than a `patience`-th of what would else stay open."""
    for p in state:
        p["lead"] = 0
    now = state
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if not now:
            break
        level = small_frame(docs.sparkSession, pa.table({
            "l_source": pa.array([p["source"] for p in now], pa.string()),
            "lead": pa.array([p["lead"] for p in now], pa.int64()),
            "room": pa.array([p["room"] for p in now], pa.float64()),
            "after": pa.array([p["after"] for p in now], pa.int64()),
            "cap": pa.array([p["cap"] for p in now], pa.int64()),
        }))
        same = F.col("source").eqNullSafe(F.col("l_source")) & (F.shiftright("hash", bits + LEVEL_BITS) == F.col("lead"))
        inside = docs.filter(F.col("size") > 0).join(level, same & (F.col("hash") > F.col("after")) & (F.col("size") <= F.col("cap")))
        sums = inside.groupBy("source", "room", F.shiftright("hash", bits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # at most 4096 sums for each source: the bucket where the running sum first exceeds the room
        crossing = sums.groupBy("source", "room").agg(F.array_sort(F.collect_list(F.struct("bucket", "words", "low", "high"))).alias("all"))
        walked = F.aggregate(
            "all",
            F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("last"), F.lit(None).cast("struct<bucket:long,words:long,low:long,high:long>").alias("hit")),
            lambda acc, x: F.when(acc["hit"].isNotNull(), acc)
            .when(acc["used"] + x["words"] <= F.col("room"), F.struct((acc["used"] + x["words"]).alias("used"), x["high"].alias("last"), acc["hit"].alias("hit")))
            .otherwise(F.struct(acc["used"].alias("used"), acc["last"].alias("last"), x.alias("hit"))),
        )
        found = {r["source"]: r["w"] for r in crossing.select("source", walked.alias("w")).collect()}
        open_ = []
        for p in now:
            w = found.get(p["source"])
            if w is None:
                continue
            if w["last"] >= 0:
                p["threshold"] = w["last"]
            p["room"] -= w["used"]
            if w["hit"] is None:
                continue
            if w["hit"]["low"] < w["hit"]["high"]:
                p["lead"] = w["hit"]["bucket"]
                open_.append(p)
            elif (w["hit"]["words"] - p["room"]) * patience < p["room"]:  # a single hash
                p["threshold"] = w["hit"]["high"]
                p["room"] -= w["hit"]["words"]
        now = open_


def shares(docs: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, share: float = DEFAULT_SHARE, most: int = MOST_TIMES) -> DataFrame:
    """(p_source, source_size, target, times, steps): what each source of a sized() frame gives."""
    sizes = {r["source"]: r["words"] for r in docs.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    goal = targets(sizes, weights, share, most)
    plan = []
    for s, size in sizes.items():
        times = int(goal[s] // size) if size else 0
        plan.append({"source": s, "size": size, "target": goal[s], "times": times, "budget": goal[s] - times * size})
    plan = thresholds(docs, plan)
    return small_frame(docs.sparkSession, pa.table({
        "p_source": pa.array([p["source"] for p in plan], pa.string()),
        "source_size": pa.array([p["size"] for p in plan], pa.int64()),
        "target": pa.array([p["target"] for p in plan], pa.float64()),
        "times": pa.array([p["times"] for p in plan], pa.int32()),
        "steps": pa.array([[{"threshold": t, "most": m} for t, m in p["steps"]] for p in plan], pa.list_(pa.struct([("threshold", pa.int64()), ("most", pa.int64())]))),
    }))


def _once_more(steps: Column, hash_: Column, size: Column) -> Column:
    """1 if the first threshold that the hash doesn't pass belongs to a size that the document keeps to."""
    own = F.get(F.filter(steps, lambda s: hash_ <= s["threshold"]), F.lit(0))
    return F.when(own.isNotNull() & ((own["most"] == F.lit(LARGEST)) | (size <= own["most"])), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, share: float = DEFAULT_SHARE, most: int = MOST_TIMES, **columns: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    docs = cut(sized(docs, **columns))
    out = docs.join(shares(docs, weights, share, most), F.col("source").eqNullSafe(F.col("p_source")))
    copies = F.col("times") + _once_more(F.col("steps"), F.col("hash"), F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "hash", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, share: float = DEFAULT_SHARE, most: int = MOST_TIMES, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as the mix takes it."""
    each = cut(sized(docs, doc_id, source, text))
    plan = shares(each, weights, share, most)
    plan = plan.select(F.col("p_source").alias("g_source"), F.col("times").alias("g_times"), F.col("steps").alias("g_steps"))
    keys = [F.col(doc_id), F.col(source), text_digest(F.col(text))]
    often = cut(each.filter("ordinal = 2").select(F.col("doc_id").alias("o_id"), F.col("source").alias("o_source"), F.col("digest").alias("o_digest")))
    rows = docs.withColumn("g_ordinal", F.lit(1).cast("long"))
    if not often.isEmpty():
        same = keys[0].eqNullSafe(F.col("o_id")) & keys[1].eqNullSafe(F.col("o_source")) & (keys[2] == F.col("o_digest"))
        # wholly equal rows are summed up before those that differ in other columns are put in order
        whole = docs.join(often, same, "left_semi").groupBy(*docs.columns).agg(F.count("*").alias("g_n"))
        w = Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
        whole = numbered(whole.withColumn("g_before", F.coalesce(F.sum("g_n").over(w), F.lit(0))), "g_")
        rows = rows.join(often, same, "left_anti").unionByName(whole.select(*docs.columns, "g_ordinal"))
    out = rows.join(plan, keys[1].eqNullSafe(F.col("g_source")))
    copies = F.col("g_times") + _once_more(F.col("g_steps"), document_hash(keys[0], keys[2], F.col("g_ordinal")), word_count(F.col(text)))
    return out.filter(copies > 0).withColumn("g_copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
