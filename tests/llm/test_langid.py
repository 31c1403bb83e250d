import random
import re
import zlib

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from gleaner.llm import langid
from gleaner.llm.queries import op4_compression_langid

from .conftest import make_docs, words

ALPHABETS = {"xa": "abcdef", "xb": "ghijkl", "xc": "mnopqr"}


def test_held_out_accuracy(spark):
    """On the larger tables, as a few hundred documents say little."""
    sf = "/root/testdata/sf0.01"
    found = op4_compression_langid(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").lang
    assert len(found) == len(truth)
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]
    held = found[found.held_out]
    assert (held.lang_pred == held.doc_id.map(truth)).mean() >= 0.98
    assert found.score.between(0, 1).all()


def slow_samples(rows):
    """Each language's different texts of least hashes, in Python: (language, text) rows."""
    out = {}
    for lang in sorted({k for k, t in rows if k and t and any(map(str.isalpha, t))}):
        texts = {t for k, t in rows if k == lang and t and any(map(str.isalpha, t))}
        chosen = []
        for t in texts:
            x = xxhash.xxh64_intdigest(t.encode(), 42)
            x -= (x >> 63) << 64
            if x % 2**30 < min(2**30, 300 * 2**30 // len(texts)):
                at = x % max(1, len(t) - 20_000 + 1)
                chosen.append((x, t[at : at + 20_000]))
        pool = b"".join(langid.words(t) for _, t in sorted(chosen))[:126_000]
        at = min(16_000, len(pool) // 2)
        out[lang] = pool[:at] or b" ", pool[at:] or b" "
    return out


def slow_language(samples, text):
    """The language that adds the fewest bytes behind its primer, by plain zstandard calls."""
    found = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]
    if not found:
        return "und"
    raw = (" " + " ".join(w for w, b in zip(found, [None, *found]) if w != b) + " ").encode()
    sizes = {}
    for lang, (primer, pool) in samples.items():
        params = zstandard.ZstdCompressionParameters.from_level(3, source_size=4096, dict_size=len(pool), write_content_size=False, write_checksum=False, write_dict_id=False)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(pool, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[lang] = sum(len(c.compress(primer + raw[i : i + 32_768])) - len(c.compress(primer)) for i in range(0, len(raw), 32_768))
    return min(sizes, key=lambda k: (sizes[k], k))


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    samples = slow_samples([(r["lang"], r["text"]) for r in rows if not held[r["doc_id"]]])
    found = {r["doc_id"]: (r["held_out"], r["lang_pred"]) for r in op4_compression_langid(spark, sf).collect()}
    assert found == {r["doc_id"]: (held[r["doc_id"]], slow_language(samples, r["text"])) for r in rows}


def test_every_language_is_learned(spark, monkeypatch):
    """Hundreds of labels, of one text each: all have a dictionary, within the bytes that all may have."""
    rng = random.Random(8)
    texts = [words(rng, 60) for _ in range(400)]
    docs = make_docs(spark, texts, lang=[f"x{i}" for i in range(400)])
    assert len(langid.train(docs).samples) == 400
    monkeypatch.setattr(langid, "MODEL_BYTES", 400 * 200)
    small = langid.train(docs)
    assert len(small.samples) == 400 and max(len(p) + len(d) for _, p, d in small.samples) <= (langid.PRIMER_BYTES + langid.DICTIONARY_BYTES) / langid.LEAST_PART


def test_prediction_uses_the_text_alone(spark):
    rng = random.Random(1)
    texts = [words(rng, 30, ALPHABETS[k]) for k in ALPHABETS for _ in range(20)]
    docs = make_docs(spark, texts, lang=[k for k in ALPHABETS for _ in range(20)])
    model = langid.train(docs)
    classify = langid.Classifier(model)
    for k, alphabet in ALPHABETS.items():
        assert classify(words(rng, 20, alphabet))[0] == k
        assert classify(words(rng, 3000, alphabet))[0] == k


def test_long_texts_are_judged_whole():
    """Not by what fits zstandard's window: the first 60 KB are in another language than the remaining 2 MB."""
    rng = random.Random(4)
    known = {k: [words(rng, 1, a) for _ in range(2000)] for k, a in (("xa", "abcdefghij"), ("xb", "abcdefghij"))}
    text = lambda k, size: " ".join(rng.choice(known[k]) for _ in range(size // 5))
    samples = {k: langid.words(text(k, 150_000)) for k in known}
    classify = langid.Classifier(langid.Model(tuple((k, s[:16_000], s[16_000:126_000]) for k, s in samples.items())))
    assert classify(text("xa", 60_000) + " " + text("xb", 2_000_000))[0] == "xb"
    assert classify(text("xb", 60_000) + " " + text("xa", 2_000_000))[0] == "xa"


def test_training_sees_only_its_rows(spark):
    rng = random.Random(2)
    docs = make_docs(spark, [words(rng, 30, "abc"), words(rng, 30, "xyz"), None], lang=["xa", None, "xc"])
    assert [k for k, *_ in langid.train(docs).samples] == ["xa"]


def test_copies_fill_no_dictionary(spark):
    rng = random.Random(3)
    docs = make_docs(spark, ["one same text"] * 500 + [words(rng, 40)], lang=["xa"] * 501)
    (_, primer, raw), = langid.train(docs).samples
    assert (primer + raw).count(b"one same text") <= 1


def test_skewed_languages_keep_their_sample(spark):
    """Copies don't count against a language's share, and long texts give a piece."""
    rng = random.Random(5)
    own = [words(rng, 30, "ghijkl") for _ in range(40)]
    long = words(rng, 8000, "mnopqr")
    assert len(long) > langid.SAMPLE_CHARS
    docs = make_docs(spark, [*own, long], lang=["xb"] * 40 + ["xc"])
    docs = docs.unionByName(docs.filter("doc_id = 0").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(400_000)))))
    samples = {k: primer + raw for k, primer, raw in langid.train(docs).samples}
    assert sorted(samples) == ["xb", "xc"] and all(langid.words(t) in samples["xb"] for t in own)
    assert 10_000 < len(samples["xc"]) <= langid.SAMPLE_CHARS + 2


def test_noise_and_unlearned_languages_are_rejected(spark):
    """On the larger tables: of clean texts few are lost, of noise nearly none stays, of a language that was left out the least part."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200").dropDuplicates(["text"])
    rng = random.Random(6)
    noise = [words(rng, rng.randint(20, 300), a) for a in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя") for _ in range(60)]
    model = langid.train(docs)
    classify = langid.Classifier(model)
    rejected = lambda c, t: c.rejects(*(lambda f: (f[0], f[2], f[3]))(c.judge(langid.words(t))))
    assert sum(rejected(classify, t) for t in noise) >= 0.95 * len(noise)
    texts = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sum(rejected(classify, t) for _, t in texts) <= 0.01 * len(texts)
    without = langid.Classifier(langid.Model(tuple(s for s in model.samples if s[0] != "es"), model.shares))
    spanish = [t for k, t in texts if k == "es"]
    assert sum(rejected(without, t) for t in spanish) >= 0.8 * len(spanish)


def test_odd(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    found = langid.predict(odd_docs, model, carry=[odd_docs.doc_id]).toPandas().set_index("doc_id")
    assert len(found) == odd_docs.count()
    for i in (0, 1, 2, 3, 10):
        assert tuple(found.loc[i]) == ("und", 0.0, True)
    assert found.loc[5].lang_pred.nunique() == 1
    kept = langid.keep(odd_docs, model)
    assert kept.schema == odd_docs.schema and not {0, 1, 2, 3, 10} & {r["doc_id"] for r in kept.collect()}
    nothing = langid.train(no_docs)
    assert nothing.samples == () and langid.predict(no_docs, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def test_words():
    assert langid.words("Ab ab, CD 12 cd") == b" ab cd "
    assert langid.words("12 ² !") == b"" and langid.words(None) == b""


@pytest.mark.parametrize("text", ["", None, "1 2"])
def test_unknown(text):
    assert langid.Classifier(langid.Model(()))(text) == ("und", 0.0, 0)
