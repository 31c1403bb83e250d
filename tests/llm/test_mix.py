import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mix, oracles
from gleaner.llm.queries import op2_source_mix

from .conftest import make_docs, words


def fill(sizes, weights, share, most):
    """Rounds of sharing: whoever passes its limit stops there and the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    while open_ := [s for s in order if s not in out]:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = {rng.choice([None, "a", "b", "ä", "", "z", "B"]) if i == 0 else f"s{i}": rng.randint(0, 1000) for i in range(rng.randint(1, 9))}
    got, want = mix.targets(sizes), fill(sizes, (3, 1, 2), 1.5, 2)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def check(found):
    """Near the target: within one percent, or, where a source is a handful of documents, no more than its largest."""
    for _, s in found.groupby("source", dropna=False):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= max(0.01 * s.target.iloc[0], s["size"].max())
    assert (found.taken <= 2 * found["size"]).all() and (found.taken >= 0).all()


def test_query(spark, sf, oracle, same):
    found = op2_source_mix(spark, sf).toPandas()
    check(found)
    same(oracle(oracles.OP2), found)
    same(found, op2_source_mix(spark, sf).toPandas())


def slow_taken(s, rounds=3):
    """One source's documents, taken one hash after the other."""
    size, target = s.source_size.iloc[0], s.target.iloc[0]
    times = int(target // size)
    room, after, more = target - times * size, -1, set()
    for k in range(rounds):
        fits = s[(s.hash > after) & (s["size"] > 0) & ((s["size"] <= int(room)) if k else True)]
        if room <= 0:
            break
        for h, words in fits.groupby("hash")["size"].sum().items():
            if words > room and not (words - room) * (1 if k == rounds - 1 else 8) < room:
                break
            more |= set(fits.index[fits.hash == h])
            after = h
            room -= words
            if room < 0:
                break
    return [r["size"] * (times + (i in more)) for i, r in s.iterrows()]


@pytest.mark.parametrize("rounds", [1, 3])
def test_refining_finds_the_exact_thresholds(spark, monkeypatch, rounds):
    rng = random.Random(3)
    docs = make_docs(spark, [words(rng, rng.choice([0, 1, 5, 40])) for _ in range(300)], source=[rng.choice("abcd") for _ in range(300)])
    monkeypatch.setattr(mix.thresholds, "__defaults__", (rounds,))
    fine = mix.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    for _, s in fine.groupby("source"):
        assert slow_taken(s, rounds) == s.taken.tolist()
    monkeypatch.setattr(mix, "LEVEL_BITS", 4)  # other levels, same thresholds
    coarse = mix.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert coarse.taken.tolist() == fine.taken.tolist()


def test_nested(spark, monkeypatch):
    monkeypatch.setattr(mix.thresholds, "__defaults__", (1,))
    rng = random.Random(4)
    docs = make_docs(spark, [words(rng, rng.randint(1, 9)) for _ in range(200)], source=[rng.choice("abc") for _ in range(200)])
    less = mix.mix(docs, share=0.5).select("doc_id", F.col("copies").alias("less"))
    both = mix.mix(docs, share=0.9).join(less, "doc_id").toPandas()
    assert (both.copies >= both.less).all()


def test_take_repeats_rows(spark):
    rng = random.Random(5)
    docs = make_docs(spark, [words(rng, rng.randint(1, 9)) for _ in range(100)], source=[rng.choice("ab") for _ in range(100)])
    want = mix.mix(docs).toPandas().set_index("doc_id").copies
    got = mix.take(docs)
    assert got.columns == docs.columns
    assert got.toPandas().doc_id.value_counts().reindex(want.index, fill_value=0).tolist() == want.tolist()


def test_rows_that_share_an_id_are_taken_one_by_one(spark):
    """Null ids, equal ids and wholly equal rows: targets are met all the same."""
    rng = random.Random(6)
    texts = [words(rng, rng.randint(20, 60)) for _ in range(120)]
    docs = make_docs(spark, texts, source=["a"] * 60 + ["b"] * 60)
    same_id = docs.withColumn("doc_id", F.when(F.col("doc_id") < 60, F.lit(None)).otherwise(F.lit(7)).cast("long"))
    equal = make_docs(spark, ["one two three four"]).withColumn("source", F.lit("c"))
    for _ in range(6):
        equal = equal.unionByName(equal)
    rows = same_id.unionByName(equal).unionByName(equal.limit(1).withColumn("lang", F.lit("fr")))
    found = mix.mix(rows).toPandas()
    for _, s in found.groupby("source"):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= 0.02 * s.target.iloc[0]
    got = mix.take(rows).toPandas()
    assert got.groupby("source").text.agg(lambda x: sum(len(t.split()) for t in x)).to_dict() == found.groupby("source").taken.sum().to_dict()


def test_odd(odd_docs, no_docs):
    found = mix.mix(odd_docs).toPandas()
    assert len(found) == odd_docs.count()
    assert set(found.source.map(lambda x: x if isinstance(x, str) else None)) == {None, "", "s"}
    assert (found[found["size"] == 0].taken == 0).all()
    assert mix.take(odd_docs).columns == odd_docs.columns
    assert mix.mix(no_docs).count() == 0 and mix.take(no_docs).count() == 0
