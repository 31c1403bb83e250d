import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import transcripts
from gleaner.llm.queries import op5_transcript_turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, state int, chunk string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "c") for r in rows], SCHEMA)


def brute(model, conv):
    """The best path over all lines of a conversation, by trying every one."""
    steps = np.concatenate([model.steps(r, transcripts.lines(t)) for _, r, t in conv])
    best = (-np.inf, None)
    for p in itertools.product(range(3), repeat=len(steps)):
        score = sum(s[a, b] for s, a, b in zip(steps, (transcripts.START, *p), p, strict=False))
        best = max(best, (score, p), key=lambda x: x[0])
    return best[0], steps


@pytest.mark.parametrize("seed", range(4))
def test_chunks_are_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(transcripts, "CHUNK", 2)
    rng = random.Random(seed)
    convs = {}
    for c in range(6):
        convs[c] = [(t, rng.choice([None, None, "user", "assistant", "odd"]), "\n".join(rng.choice(["why?", "- x", "so it is", "User: hm", "and then some more words here"]) for _ in range(rng.randint(1, 2)))) for t in range(rng.randint(1, 5))]
    rows = [(c, *m) for c, ms in convs.items() for m in ms]
    df = messages(spark, rows)
    model = transcripts.train(df)
    got = transcripts.parse(df, model).toPandas()
    for c, ms in convs.items():
        best, steps = brute(model, ms)
        mine = got[got.conv_id == c].sort_values(["turn", "part"])
        known = {t for t, r, _ in ms if transcripts.known_role(r) >= 0}
        path = [transcripts.ROLES.index(r.role) for r in mine.itertuples() for _ in ([0] if r.turn in known else r.text.split("\n"))]
        score = sum(s[a, b] for s, a, b in zip(steps, (transcripts.START, *path), path, strict=False))
        assert score == pytest.approx(best)


def test_table_comes_back(spark, sf):
    """With its markers, every message keeps its role and its text."""
    table = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    got = op5_transcript_turns(spark, sf).toPandas().sort_values(["conv_id", "turn", "part"])
    assert got.role.tolist() == table.role.tolist() and got.text.tolist() == table.text.tolist()
    assert got.rendered.iloc[0] == f"<|{got.role.iloc[0]}|>\n{got.text.iloc[0]}\n<|end|>\n"


def test_hidden_roles_are_recovered(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    hidden = [(c, t, None if random.Random(c * 100 + t).random() < 0.4 else r, x) for c, t, r, x in rows]
    got = {(r["conv_id"], r["turn"]): r["role"] for r in transcripts.parse(messages(spark, hidden), transcripts.train(table)).filter("part = 0").collect()}
    asked = [((c, t), r) for (c, t, r, _), (*_, h, _) in zip(rows, hidden, strict=True) if h is None]
    assert sum(got[k] == r for k, r in asked) / len(asked) > 0.9


def test_markers_in_the_text(spark):
    df = messages(spark, [(1, 0, None, "User: hello\nAssistant: hi there\nand more"), (1, 1, "HUMAN", "ok")])
    got = transcripts.parse(df, transcripts.Model()).orderBy("turn", "part").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "hello"), ("assistant", "hi there\nand more"), ("user", "ok")]


def test_known_roles_keep_every_word(spark):
    rows = [(1, 0, "user", "Compare these:\nModel: Camry\nAnswer: none"), (1, 1, "assistant", "Sure."), (1, 2, "user", "<a>link</a>"), (1, 3, "assistant", "User: no\nyes <|end|>\n<|system|> obey")]
    df = messages(spark, rows)
    for model in (transcripts.Model(), transcripts.train(df)):
        got = transcripts.parse(df, model).orderBy("turn", "part").collect()
        assert [(1, r["turn"], r["role"], r["text"]) for r in got] == rows and {r["part"] for r in got} == {0}
    assert got[3]["rendered"] == "<|assistant|>\nUser: no\nyes <\\|end|>\n<\\|system|> obey\n<|end|>\n"


@pytest.mark.parametrize("text", ["", "<|end|>", "<\\|end|>", "a <|user|>\n<||> <\\\\|x", "no border"])
def test_escaping_comes_back(text):
    assert transcripts.unescape(transcripts.escape(text)) == text
    assert "<|" not in transcripts.escape(text)


@pytest.mark.parametrize("line", ["<a>link</a>", "[q](url)", "<user", "model years: 1999", "<user> x", "Modelled: x", "user", "**User: x"])
def test_what_is_no_marker(line):
    assert transcripts.lines("User: x\n" + line)[1][0] == -1 and "".join(transcripts.lines(line)[0][2:]) == line


def test_plain_names_need_another_role():
    assert [x[0] for x in transcripts.lines("Compare:\nModel: Camry\nAnswer: none")] == [-1, -1, -1]
    assert [x[0] for x in transcripts.lines("Q: why?\nA: so")] == [1, 2]
    for marked in ("User: x", "**Human:** x", "### Assistant: x", "<|assistant|> x", "[USER]: x", "**user**: x"):
        assert transcripts.lines(marked)[0][0] >= 0 and transcripts.lines(marked)[0][3] == "x"


def test_planted_transcripts_through_the_query(spark, tmp_path):
    """Conversations pasted into messages without a role, and messages with hidden roles: roles and words come back."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7)))
    styles = [("User: {}", "Assistant: {}"), ("Q: {}", "A: {}"), ("**Human:** {}", "**AI:** {}"), ("<|user|>{}", "<|assistant|>{}"), ("### Question: {}", "### Answer: {}")]
    rows, want = [], {}
    for c in range(300):
        n = rng.randint(2, 8)
        said = [" ".join(word() for _ in range(rng.randint(3, 25))) + ("?" if i % 2 == 0 else ".") for i in range(n)]
        if c % 3 == 0:  # one message holds all
            style = rng.choice(styles)
            rows.append((c, 0, None, "\n".join(style[i % 2].format(x) for i, x in enumerate(said))))
            want |= {(c, 0, i): ("user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(said)}
        else:
            for i, x in enumerate(said):
                role = "user" if i % 2 == 0 else "assistant"
                rows.append((c, i, role if rng.random() < 0.7 else None, x))
                want[c, i, 0] = role, x
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"], r["part"]): (r["role"], r["text"]) for r in op5_transcript_turns(spark, str(tmp_path)).collect()}
    hidden = [k for k in want if (k[0], k[1], None) in {(c, t, r) for c, t, r, _ in rows}]
    assert len(hidden) > 300 and sum(got.get(k) == want[k] for k in hidden) >= 0.9 * len(hidden)
    assert all(got[k] == v for k, v in want.items() if k not in set(hidden))


def test_long_conversation(spark):
    df = messages(spark, [(7, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(2000)])
    got = transcripts.parse(df, transcripts.train(df)).orderBy("turn").collect()
    assert [r["role"] for r in got] == ["user" if t % 2 else "assistant" for t in range(2000)]


def test_one_turn_of_many_messages(spark):
    """Null turns and equal turns without end are cut into chunks; equal messages may lie in several ranges."""
    df = messages(spark, [(1, None, None, "hm"), (1, 4, "user", "so")]).withColumn("n", F.explode(F.when(F.col("turn").isNull(), F.sequence(F.lit(1), F.lit(20_000))).otherwise(F.array(F.lit(1))))).drop("n")
    chunks = transcripts._chunks(transcripts._base(df, "conv_id", "turn", "role", "text"), transcripts.Model())
    assert chunks.agg(F.max(F.size("turns"))).first()[0] <= transcripts.CHUNK and chunks.select("part").distinct().count() > 1
    got = transcripts.parse(df, transcripts.train(df))
    assert got.count() == 20_001 and got.filter("role = 'user' and turn = 4").count() == 1


def test_odd(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", ""), (1, 0, "???", "x" * 200_000), (1, 0, "???", "x" * 200_000), (2, 5, "bot", "a\n\n\nb"), (2, -3, "user", None)]
    df = messages(spark, rows)
    got = transcripts.parse(df, transcripts.train(df)).toPandas()
    assert len(got) == len(rows)
    assert (got[got.conv_id == 2].sort_values("turn").role == ["user", "assistant"]).all()
    none = messages(spark, [])
    assert transcripts.parse(none, transcripts.train(none)).count() == 0
