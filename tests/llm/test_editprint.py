import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import editprint
from gleaner.llm.queries import op6_edit_fingerprints

from .conftest import make_docs, words


@pytest.fixture(scope="module")
def embedding():
    return editprint.Embedding()


def slots(e, text):
    codes = e.codes(text)
    return e.print(codes, e.walk(codes))


def slow_output(e, text, steps):
    """The walk step by step: what it writes out."""
    moves = np.random.default_rng(editprint.SEED).integers(0, 2, (editprint.CLASSES, editprint.PERIOD)).astype(bool)
    moves[:, -1] = True
    out, i = [], 0
    for t in range(steps):
        if i == len(text):
            break
        out.append(i)
        k = (ord(text[i]) * 0x9E3779B97F4A7C15 % 2**64) >> 58
        i += bool(moves[k, t % editprint.PERIOD])
    return out


def test_walk_step_by_step(embedding):
    text = words(random.Random(1), 2000) + "éß中\U0001f600"
    left = embedding.walk(embedding.codes(text))
    out = slow_output(embedding, text, int(left[-1]) + 5)
    assert len(out) == left[-1]
    assert np.searchsorted(left, np.arange(len(out)), side="right").tolist() == out
    half = embedding.walk(embedding.codes(text)[:500])
    assert np.r_[half, embedding.walk(embedding.codes(text)[500:], int(half[-1]))].tolist() == left.tolist()


def test_likeness_falls_with_edits(embedding):
    rng = random.Random(2)
    text = words(rng, 600)
    means = []
    for share in (0, 0.002, 0.01, 0.05, 0.3):
        near = []
        for _ in range(8):
            edited = list(text)
            for _ in range(int(share * len(text))):
                i = rng.randrange(len(edited))
                edited[i : i + 1] = rng.choice([[], ["x"], [edited[i], "q"]])
            near.append(editprint.likeness(slots(embedding, text), slots(embedding, "".join(edited))))
        means.append(sum(near) / len(near))
    assert means[0] == 1 and means == sorted(means, reverse=True) and means[1] > 0.7 and means[-1] < 0.1
    other = [editprint.likeness(slots(embedding, text), slots(embedding, words(rng, 600))) for _ in range(20)]
    assert max(other) < 0.1


def test_banding(embedding):
    rng = random.Random(3)
    text = words(rng, 500)
    close = text[:1000] + "z" + text[1001:]
    assert editprint.share_band(slots(embedding, text), slots(embedding, close))
    assert not any(editprint.share_band(slots(embedding, text), slots(embedding, words(rng, 500))) for _ in range(20))
    s = slots(embedding, text)
    assert (editprint.from_hex(editprint.as_hex(s)) == s).all() and len(editprint.bands(s)) == editprint.SLOTS // editprint.BAND


def brute(rows):
    """rows: (doc_id, text); each with its successor in descending id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + after[:third]
        out.append((k, t, new, after))
    return out


def check(e, found, rows):
    want = []
    for k, t, new, after in brute(rows):
        a, b, c = slots(e, t), slots(e, new), slots(e, after)
        want.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), editprint.as_hex(a), editprint.as_hex(b), round(editprint.likeness(a, b), 9), round(editprint.likeness(a, c), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query(spark, sf, embedding):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(embedding, op6_edit_fingerprints(spark, sf), rows)


def test_bands_find_edited_texts(spark):
    """Through the query: of texts with a third replaced at least nine in ten share a band, of strangers hardly any."""
    found = op6_edit_fingerprints(spark, "/root/testdata/sf0.01").filter("n_chars >= 50").toPandas()
    assert len(found) > 900 and found.band_edited.mean() >= 0.95 and found[found.near_next < 0.1].band_next.mean() <= 0.001
    assert found.near_edited.mean() > 0.6


def test_near_classes_of_odd_tables(odd_docs, no_docs):
    found = editprint.near_classes(odd_docs).toPandas()
    assert len(found) == odd_docs.count() and found[found.doc_id.isin([5, 6])].class_id.nunique() == 1
    assert found[found.doc_id.isin([0, 1, 10])].class_id.eq(0).all()  # null and empty texts
    assert editprint.near_classes(no_docs).count() == 0


@pytest.mark.parametrize("ids", [[5], [3, 4], [10**12, -5, 0, 7, 8, 2**62], [1, 1, 1, 2, 2], [None, 4, None]])
def test_ranges(spark, embedding, ids):
    rng = random.Random(len(ids))
    rows = [(i, words(rng, rng.randint(0, 30))) for i in ids]
    check(embedding, editprint.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_odd(spark, odd_docs, no_docs, embedding):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    check(embedding, editprint.compare_edits(odd_docs), rows)
    assert editprint.compare_edits(no_docs).count() == 0
    prints = editprint.prints(odd_docs).groupBy("fingerprint").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in prints) >= 5  # null and empty texts are equal


def test_equal_texts(spark):
    docs = make_docs(spark, ["same words here"] * 3)
    assert editprint.prints(docs).select("fingerprint").distinct().count() == 1
    assert [r["near_next"] for r in editprint.compare_edits(docs).collect()] == [1.0] * 3


@pytest.mark.parametrize("block", [2, 1 << 15])
def test_near_classes(spark, embedding, block):
    """Against all pairs: linked if they share a band and are alike enough."""
    rng = random.Random(7)
    texts = [words(rng, 120) for _ in range(12)]
    for _ in range(60):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += ["", None, ""]
    found = {r["doc_id"]: r["class_id"] for r in editprint.near_classes(make_docs(spark, texts), block=block).collect()}
    made = [slots(embedding, t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (made[i] == made[j]).all() or editprint.share_band(made[i], made[j]) and editprint.likeness(made[i], made[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert [found[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert len(set(found.values())) < 40
