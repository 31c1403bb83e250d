import random
import re

import numpy as np
import pytest

from gleaner.llm import packing
from gleaner.llm.queries import op1_bestfit_packing

from .conftest import make_docs, words


def brute_pack(sizes, lengths, costs):
    """Best fit by looking at every open bin; the same opening rule, from the sizes still to come."""
    bins = []  # [capacity, used]
    of, at = [], []
    for i, s in enumerate(sizes):
        fit = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= s]
        if fit:
            _, b = min(fit)
        else:
            rates = []
            for c in lengths:
                if c >= s:
                    fill = sum(x for x in sizes[i + 1 :] if x <= c - s)
                    rates.append((costs.of(c) / (s + min(c - s, fill)), c))
            bins.append([min(rates)[1], 0])
            b = len(bins) - 1
        of.append(b)
        at.append(bins[b][1])
        bins[b][1] += s
    return of, at, [min(c for c in lengths if c >= u) for _, u in bins]


@pytest.mark.parametrize("seed", range(30))
def test_pack_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = tuple(sorted(rng.sample([4, 8, 12, 16, 32, 64], rng.randint(1, 4))))
    sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(0, 80))), reverse=True)
    costs = packing.Costs(rng.choice([0, 2, 20]), rng.choice([0, 0.01]))
    of, at, final = packing.pack(np.array(sizes, np.int64), lengths, costs)
    want = brute_pack(sizes, lengths, costs)
    assert (of.tolist(), at.tolist(), final.tolist()) == tuple(map(list, want))


def check_whole(found, n_words):
    """Every word once, no bin over its length, every bin as small as permitted, no overlap within a bin."""
    assert found["size"].sum() == n_words
    for _, b in found.groupby("bin"):
        assert b.length.nunique() == 1
        at = 0
        for r in b.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.size
        length = b.length.iloc[0]
        assert at <= length and length == min(x for x in packing.LENGTHS if x >= at)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = packing.pack_documents(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    check_whole(found, sum(len((t or "").split()) for t in texts))
    for key, pieces in found.groupby("doc_id"):
        at = 0
        for r in pieces.sort_values("start").itertuples():
            assert r.start == at
            at += r.size
        assert at == len(texts[key].split())


def test_query(spark, sf):
    found = op1_bestfit_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    check_whole(found, sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text))
    order = found.sort_values(["size", "doc_id", "digest", "copy", "start"], ascending=[False, True, True, True, True])
    of, at, final = brute_pack(order["size"].tolist(), packing.LENGTHS, packing.Costs())  # one shard, at this size
    assert order.offset.tolist() == at and order.length.tolist() == [final[b] for b in of]
    assert len(set(zip(of, order.bin, strict=True))) == len(set(of)) == order.bin.nunique()


@pytest.mark.parametrize("shard", [7, 40, 1 << 15])
def test_shards(spark, shard):
    """Shards follow from the number of pieces alone, and every word is packed once, in bins of one shard."""
    rng = random.Random(1)
    docs = make_docs(spark, [words(rng, rng.randint(0, 900)) for _ in range(60)])
    n = sum(len(t.split()) for t in docs.toPandas().text)
    found = packing.pack_documents(docs, shard=shard).toPandas()
    check_whole(found, n)
    assert (found.bin.to_numpy() >> 32).max() < -(-len(found) // shard)
    again = packing.pack_documents(docs.repartition(3), shard=shard).toPandas()
    assert sorted(found.itertuples(index=False)) == sorted(again.itertuples(index=False))


def test_copies(spark):
    docs = make_docs(spark, ["a b c", "d e"])
    rows = docs.unionByName(docs.filter("doc_id = 0")).unionByName(docs.filter("doc_id = 0"))
    found = packing.pack_texts(rows).toPandas()
    assert sorted(found[found.doc_id == 0]["copy"]) == [1, 2, 3] and found[found.doc_id == 1]["copy"].tolist() == [1]
    assert set(found.text) == {"a b c", "d e"}


@pytest.mark.parametrize("text", ["", " ", "a", " a  b\n\nc ", "x " * 100, "\u00a0a\u2003b c\td"])
@pytest.mark.parametrize("top", [1, 2, 7, 100])
def test_slices_are_the_text(text, top):
    parts = packing.slices(text, top)
    assert "".join(parts) == text
    counts = [len(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts]
    assert all(c == top for c in counts[:-1]) and counts[-1] <= top


def test_odd(odd_docs, no_docs):
    found = packing.pack_documents(odd_docs).toPandas()
    texts = odd_docs.toPandas().text
    check_whole(found, sum(len((t or "").split()) for t in texts))
    assert (found[found.doc_id == 5]["size"] == 5).all() and (found.doc_id == 5).sum() == 2
    assert packing.pack_documents(no_docs).count() == 0
