import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import encoding
from gleaner.functions import text as t
from gleaner.functions.stemming import RussianStemmer, normalize_tokens
from gleaner.functions.vectors import l2_normalize, sum_pool


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(c(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("  Ёлка  Ремонт ", "елка ремонт"), (None, ""), ("a  b\t\nc", "a b c"), ("", "")])
def test_normalize(spark, raw, want):
    assert one(spark, t.normalize_text, raw) == want


def test_tokens(spark):
    assert one(spark, lambda c: t.tokens(t.normalize_text(c)), "авто-мойка а 5 кВт_2") == ["авто", "мойка", "квт_2"]
    assert one(spark, t.hyphen_tokens, "авто-мойка -x- авто-мойка ab") == ["авто-мойка", "ab"]


def test_coverage(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(t.coverage(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def char_wb(text, low, high):
    """The published description, word by word."""
    out = []
    for w in text.split():
        w = f" {w} "
        for n in range(low, high + 1):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return out


@pytest.mark.parametrize(("low", "high"), [(4, 4), (3, 5), (2, 6)])
@pytest.mark.parametrize("text", ["а ремонт дом", "", "x yz", "один"])
def test_char_wb(spark, text, low, high):
    assert sorted(one(spark, lambda c: t.char_wb_ngrams(c, low, high), text)) == sorted(char_wb(text, low, high))


def test_char_wb_hand_made(spark):
    want = [" а ", " рем", "ремо", "емон", "монт", "онт ", " дом", "дом "]
    assert one(spark, t.char_wb_ngrams, "а ремонт дом") == want


def test_word_ngrams(spark):
    got = one(spark, lambda c: t.word_ngrams(F.split(c, " "), 1, 3), "a b c")
    assert got == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, lambda c: t.word_ngrams(F.split(c, " "), 2, 2), "a") == []


def test_stable_hash(spark):
    assert one(spark, t.stable_hash, "баня") == "4f8f29eae3c4bf283850a53b54902795b62b39bf"


def test_signature_text(spark):
    df = spark.createDataFrame([("a", 1)], "a string, b int")
    assert df.select(t.signature_text(F.col("a"), F.col("b"))).first()[0] == repr(("a", "1"))
    assert df.select(t.signature_text(F.col("a"))).first()[0] == repr(("a",))


@pytest.mark.parametrize("value", ["it's", 'say "so"', """it's "so\"""", "back\\slash", "a\nb\tc\rd", "nul\x00\x1f\x7f\x85\xa0\xad", "é中\U0001f600", ""])
def test_signature_text_prints_as_python(spark, value):
    df = spark.createDataFrame([(value, "x")], "a string, b string")
    assert df.select(t.signature_text(F.col("a"), F.col("b"))).first()[0] == repr((value, "x"))


def test_composition(spark):
    df = spark.createDataFrame([("t", "p", "d", "q")], "title string, params string, description string, q string")
    parts = {c: F.col(c) for c in ("title", "params", "description")}
    got = df.select(*[t.compose_item(v, parts, w) for v in t.VARIANTS for w in (False, True)], *[t.compose_query(v, F.col("q"), F.col("params"), w) for v in t.VARIANTS for w in (False, True)]).first()
    assert list(got) == ["t", "t", "t p", "t t p", "t p d", "t t t p d", "q", "q", "q p", "q q p", "q p", "q q p"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("важная", "важн"), ("вазах", "ваз"), ("вечеринки", "вечеринк"), ("ремонта", "ремонт"), ("красивейший", "красив"), ("бегавшись", "бега"), ("умываться", "умыва"), ("длинный", "длин"), ("радость", "радост"), ("новость", "новост"), ("дом", "дом"), ("в", "в"), ("", "")],
)
def test_snowball(word, stem):
    assert RussianStemmer().stem(word) == stem


def test_token_modes(spark):
    rows = spark.createDataFrame([(1, "ремонта"), (2, "стены"), (3, "abc")], "id int, token string")
    lemmas = spark.createDataFrame([("стены", "стёна"), ("abc", "zzz")], "token string, lemma string")
    get = lambda *a: {r["id"]: r["token"] for r in normalize_tokens(rows, *a).collect()}
    assert get() == {1: "ремонта", 2: "стены", 3: "abc"}
    assert get("snowball")[1] == "ремонт"
    assert get("lemma", lemmas) == {1: "ремонта", 2: "стена", 3: "abc"}
    with pytest.raises(ValueError):
        normalize_tokens(rows, "lemma")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "z")], "doc_id int, token string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vector array<double>")
    got = {r["doc_id"]: r["vector"] for r in sum_pool(tokens, vectors).collect()}
    assert got.keys() == {1} and got[1] == pytest.approx([0.5**0.5, 0.5**0.5])


def test_encoding(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, " ", ""), (3, None, "c")], "id int, a string, b string")
    texts = df.select("id", encoding.join_fields(F.col("a"), F.col("b")).alias("text"))
    assert [r["text"] for r in texts.orderBy("id").collect()] == ["ab", "", "c"]
    made = encoding.encode(texts, lambda: lambda batch: np.array([[3.0 * len(t), 4.0 * len(t)] for t in batch]), "id", batch_size=2)
    assert {r["id"]: r["vector"] for r in made.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.6, 0.8]}
