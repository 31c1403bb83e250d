import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import buckets, simhash
from gleaner.llm.components import components
from gleaner.llm.queries import op7_simhash_dedup

from .conftest import make_docs, words


def slow_print(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(ids, prints, most):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("k", [1, 4, 5])
@pytest.mark.parametrize("text", ["", None, "one", "A b C d", "É é A a \x0b x\x1cy z", "a a a a a a a a", "w " * 70_000, " ".join(map(str, range(70_000)))])
def test_fingerprint(k, text):
    assert simhash.fingerprint(text, k) == slow_print(text, k)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_print(r["text"], 4) for r in rows]
    want = {(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, slow_classes([r["doc_id"] for r in rows], prints, 4), strict=True)}
    assert {tuple(r) for r in op7_simhash_dedup(spark, sf).collect()} == want


def planted(rng, n):
    """Random fingerprints, some of them chains and clouds of neighbours, with copies."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("most", [0, 1, 3, 4, 9])
@pytest.mark.parametrize("seed", [0, 1])
def test_links_are_exact(spark, seed, most):
    prints = planted(random.Random(seed), 150)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(range(len(signed)), [0] * len(signed), signed, strict=True)), "doc_id long, digest long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, most).collect()}
    assert [got[i] for i in range(len(prints))] == slow_classes(list(range(len(prints))), prints, most)


@pytest.mark.parametrize("m", range(1, 8))
@pytest.mark.parametrize("most", [2, 4, 11])
def test_every_plan_covers(m, most):
    """Whatever thresholds are chosen, any two fingerprints within `most` bits share a masked value."""
    if m > most + 1:
        return
    rng = random.Random(m * 10 + most)
    ones = np.array([rng.uniform(0, 100) for _ in range(64)])
    groups = simhash.group_bits(100, np.diag(ones) + 0.0, m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    _, chosen = simhash.allocate(100, ones, groups, [rng.choice([0, 10, 10**9]) for _ in groups], most)
    assert sum(chosen) == most - m + 1
    for _ in range(300):
        flipped = rng.sample(range(64), rng.randint(0, most))
        assert any(len(set(flipped) & set(g)) <= t for g, t in zip(groups, chosen, strict=True))


def test_large_buckets_are_cut_into_blocks(spark):
    """Near copies that crowd one bucket: blocks give the same links as one piece."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = list({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})[:900] + [rng.getrandbits(64) for _ in range(100)]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(range(len(signed)), [0] * len(signed), signed, strict=True)), "doc_id long, digest long, fp long")
    want = slow_classes(list(range(len(prints))), prints, 4)
    for block in (16, 100, 400, 1 << 15):
        got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, 4, block).collect()}
        assert [got[i] for i in range(len(prints))] == want
    nodes = df.select("fp")
    assert simhash.links(nodes, 4).count() < 60 * len(prints)  # no pairs by the square


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = sorted({x for e in edges for x in e})
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_similarity_bits():
    assert simhash.bits_for(1.0, 64, 0.9) == 0
    assert simhash.bits_for(0.8, 64, 0.5) == 10 and simhash.bits_for(0.8, 64, 0.9) == 13 and simhash.bits_for(0.8, 256, 0.98) == 51
    assert abs(simhash.search_similarity(0.8, 5, 5) - 0.8) < 1e-12 and 0.9 < simhash.search_similarity(0.8, 5, 2) < 0.92


@pytest.mark.parametrize("block", [8, 1 << 15])
def test_wide_links_are_exact(spark, block):
    rng = random.Random(11)
    made = [[rng.getrandbits(64) for _ in range(5)] for _ in range(60)]
    for _ in range(240):
        x = list(rng.choice(made))
        for b in rng.sample(range(320), rng.randint(0, 75)):
            x[b // 64] ^= 1 << b % 64
        made.append(x)
    rows = [(i, int(np.uint64(w[0]).view(np.int64)), np.array(w[1:], np.uint64).tobytes()) for i, w in enumerate(made)]
    df = spark.createDataFrame(rows, "node long, fp long, words binary")
    roots = dict(map(tuple, components(simhash.links(df, 10, block, 44)).collect()))

    def linked(i, j):
        differ = [(a ^ b).bit_count() for a, b in zip(made[i], made[j], strict=True)]
        return differ[0] <= 10 and sum(differ[1:]) <= 44

    assert [roots.get(i, i) for i in range(len(made))] == components_of(len(made), linked)


@pytest.mark.parametrize("size", [20, 700])
def test_forests_keep_the_nearest_links(size):
    """A bucket gives a spanning forest of least total distance, whether compared pair by pair or grown."""
    rng = random.Random(size)
    at = np.array([rng.randint(0, 4000) for _ in range(size)], np.int64)

    def apart(loads, i, j):
        d = np.abs(loads[i] - loads[j])
        return np.where(d <= 9, d, buckets.FAR).astype(np.int16)

    def total(a, b):
        return sum(abs(int(at[x]) - int(at[y])) for x, y in zip(a, b, strict=True)), len(a)

    nodes = np.arange(size)
    gaps = np.diff(np.sort(at))
    want = int(gaps[gaps <= 9].sum()), int((gaps <= 9).sum())
    assert total(*buckets._walk(nodes, at, apart)) == want
    if size <= buckets.DENSE:
        assert total(*buckets._forest(*buckets._side_by_side(np.zeros(size, np.int64), at, apart))) == want


def test_wide_fingerprints_estimate_similarity():
    rng = random.Random(12)
    for _ in range(5):
        base = words(rng, 800).split()
        other = [w if rng.random() > 0.02 else "zz" for w in base]
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        shingles = [simhash.shingle_set(" ".join(t), 5) for t in (base, other)]
        assert abs(simhash.jaccard(*shingles) - true) < 1e-12
        prints = [simhash.wide_fingerprint(x) for x in shingles]
        assert int(prints[0][0]) == slow_print(" ".join(base), 5)
        differ = sum((int(a) ^ int(b)).bit_count() for a, b in zip(*prints, strict=True))
        assert abs(differ - 256 * simhash.differing(true)) < 4 * (256 * simhash.differing(true)) ** 0.5


def edited(rng, text, share):
    return " ".join("".join(rng.choice("xyz") for _ in range(5)) if rng.random() < share else w for w in text.split())


def test_near_classes_against_all_pairs(spark):
    """No link below the similarity; of the links at or above it at least nine in ten, here with scattered edits."""
    rng = random.Random(15)
    texts = []
    for _ in range(60):
        texts.append(words(rng, rng.randint(60, 500)))
        texts += [edited(rng, texts[-1], rng.choice([0.003, 0.01, 0.02, 0.03, 0.05])) for _ in range(3)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(make_docs(spark, texts)).collect()}
    want = components_of(len(texts), lambda i, j: (i, j) in alike)
    assert all(want[i] == want[got[i]] for i in range(len(texts)))
    found = sum(got[i] == got[j] for i, j in alike)
    assert len(alike) > 100 and found >= 0.9 * len(alike)


def test_near_classes_of_one_large_group(spark):
    """Hundreds of different near copies of one text are one component, blocks or not."""
    rng = random.Random(16)
    base = words(rng, 300)
    texts = [edited(rng, base, 0.004) for _ in range(400)] + [words(rng, 300) for _ in range(30)]
    docs = make_docs(spark, texts)
    sets = [simhash.shingle_set(t, 5) for t in texts]
    want = components_of(len(texts), lambda i, j: simhash.jaccard(sets[i], sets[j]) >= 0.8)
    assert want.count(0) > 390
    for block in (100, 1 << 15):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(docs, block=block).collect()}
        assert all(want[i] == want[got[i]] for i in range(len(texts))) and sum(got[i] == want[i] for i in range(len(texts))) >= 0.99 * len(texts)


def test_keep_one(spark):
    rng = random.Random(6)
    base = words(rng, 400)
    near = base.split()
    near[200] = "changed"
    texts = [words(rng, 300), base, " ".join(near), base, words(rng, 300), None, "", "lone"]
    docs = make_docs(spark, texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 5, 7]


def test_a_repeated_shingle_links_no_strangers(spark):
    rng = random.Random(7)
    texts = ["- " * 300 + words(rng, 200) for _ in range(3)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(make_docs(spark, texts)).collect()) == [0, 1, 2]


def test_equal_fingerprints_are_verified(spark):
    """Equal first words of the fingerprints don't link nodes whose other words differ."""
    rows = [(i, 77, np.array([w] * 4, np.uint64).tobytes()) for i, w in enumerate([0, 2**64 - 1, 2**64 - 1, 1])]
    df = spark.createDataFrame(rows, "node long, fp long, words binary")
    assert dict(map(tuple, components(simhash.links(df, 11, most_wide=44)).collect())) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_odd(spark, odd_docs, no_docs):
    found = simhash.classes(simhash.fingerprints(odd_docs), 4).toPandas()
    rows = odd_docs.select("doc_id", "text").toPandas()
    assert len(found) == len(rows)
    texts = [t if isinstance(t, str) else None for t in rows.text]
    ids = [None if i != i else int(i) for i in rows.doc_id]
    want = slow_classes(ids, [slow_print(t, 4) for t in texts], 4)
    assert sorted(zip(map(str, ids), map(str, want), strict=True)) == sorted((str(None if r.doc_id != r.doc_id else int(r.doc_id)), str(int(r.component_id))) for r in found.itertuples())
    assert simhash.classes(simhash.fingerprints(no_docs), 4).count() == 0
    near = simhash.near_classes(odd_docs).toPandas()
    assert len(near) == len(rows) and near[near.doc_id == 5].component_id.eq(5).all() and simhash.near_classes(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    assert kept.filter("doc_id = 5").count() == 1 and kept.filter(F.col("doc_id").isNull()).count() <= 1
    assert simhash.keep_one(no_docs).count() == 0
