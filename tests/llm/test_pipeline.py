import random
import re

import zstandard as zstd

import corpus_pipeline
from gleaner.llm import langid, packing, pii, simhash
from gleaner.llm.common import scratch, table

from .conftest import make_docs, words


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mix", "pack"]


def check_sequences(packed, taken):
    """The result alone gives the sequences, and they hold each taken text once for each time it was taken."""
    rows = packed.toPandas()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert rows.text.map(count).tolist() == rows["size"].tolist()
    for _, b in rows.groupby("bin"):
        b = b.sort_values("offset")
        assert b.offset.tolist() == [0, *b["size"].cumsum().tolist()[:-1]] and b["size"].sum() <= b.length.iloc[0]
        assert b.length.nunique() == 1 and b.length.iloc[0] in packing.LENGTHS
    whole = rows.sort_values("start").groupby(["doc_id", "digest", "copy"], dropna=False).text.agg("".join)
    texts = [r["text"] for r in taken.collect()]
    assert sorted(whole) == sorted(t for t in texts if t and count(t))
    return rows


def test_stages_one_by_one(spark, sf):
    """Every stage against brute force on its own input."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    first = docs.toPandas()
    a = scratch(corpus_pipeline.identify_language(spark, docs, sf), "a")
    model = langid.train(docs)
    want = {r.doc_id for r in first.itertuples() if not slow_rejects(model, r.text)}
    assert a.columns == columns and {r["doc_id"] for r in a.collect()} == want
    b = scratch(corpus_pipeline.drop_near_duplicates(spark, a, sf), "b")
    rows = sorted(a.collect(), key=lambda r: r["doc_id"])
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"])) for r in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    kept = {rows[i]["doc_id"] for i in range(len(rows)) if find(i) == i}
    assert b.columns == columns and {r["doc_id"] for r in b.collect()} == kept
    c = scratch(corpus_pipeline.mask_personal_data(spark, b, sf), "c")
    before = {r["doc_id"]: r["text"] for r in b.collect()}
    assert {r["doc_id"] for r in c.collect()} == kept
    for r in c.collect():
        assert r["text"] == pii.redacted(before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    d = scratch(corpus_pipeline.mix_sources(spark, c, sf), "d")
    assert d.columns == columns and set(r["doc_id"] for r in d.collect()) <= kept
    size = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert abs(size(d) - 1.5 * size(c)) <= 0.1 * size(c)
    check_sequences(corpus_pipeline.pack_sequences(spark, d, sf), d)


def slow_rejects(model, text):
    """By plain zstandard calls: the sizes behind each language's dictionary and primer, and the lead over the runner-up."""
    raw = langid.words(text)
    if not raw:
        return True
    sizes = {}
    for lang, primer, pool in model.samples:
        params = zstd.ZstdCompressionParameters.from_level(3, source_size=4096, dict_size=len(pool), write_content_size=False, write_checksum=False, write_dict_id=False)
        c = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(pool, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[lang] = sum(len(c.compress(primer + raw[i : i + 32768])) - len(c.compress(primer)) for i in range(0, len(raw), 32768))
    (least, best), (more, _) = sorted((s, k) for k, s in sizes.items())[:2]
    return more - least < max(1, dict(model.shares).get(best, langid.NARROW_SHARE) * least)


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["bin", "length", "offset", "doc_id", "digest", "copy", "start", "size", "text"] and found.count() > 0
    rows = found.toPandas()
    assert not any(any(pii.find(t)) for t in rows.text)  # nothing is left to mask, and no piece cuts a placeholder
    assert (rows.groupby("bin")["size"].sum() <= rows.groupby("bin").length.first()).all()
    assert rows["copy"].max() == 2 and not rows.duplicated(["doc_id", "digest", "copy", "start"]).any()


def test_stages_with_odd_rows(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, scratch(stage(spark, docs, ""), name)
            assert docs.columns == start.columns
            if name == "pii":
                assert docs.count() == before.count()
        check_sequences(corpus_pipeline.pack_sequences(spark, docs, ""), docs)
        assert (docs.count() > 0) == (start is odd_docs)


def test_each_stage_takes_odd_rows_as_they_are(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, "").count() == 0
        kept = stage(spark, odd_docs, "").toPandas()
        assert {"language_id": 1 <= len(kept) < odd_docs.count(), "near_dedup": 5 in set(kept.doc_id), "pii": len(kept) == odd_docs.count(), "mix": len(kept) > 0}[name]
    check_sequences(corpus_pipeline.pack_sequences(spark, odd_docs, ""), odd_docs)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    texts = [words(rng, 400) for _ in range(30)]
    planted = []
    for i in range(10):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "other"
        planted.append(" ".join(w))
    docs = make_docs(spark, texts + planted + texts[:5])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(range(30))
