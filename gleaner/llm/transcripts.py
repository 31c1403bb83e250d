"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles.

The states are the roles. A message whose role column names one is of that role, whole, as its text stands. Other messages are
cut into lines; a line may begin with a speaker marker ("User:" and the like) and has features of its form. Names that also stand
in plain text ("model:", "answer:", "q:") count as markers only where a marker of another role stands in the same message.
Emissions and transitions are counted over all messages whose role is known. Viterbi's best path gives every line a role; runs of
one role within a message become turns. A marker is taken off its line only if the path gave the line the marker's role, and
never where it opens a bracket that it doesn't close. Turns are rendered canonically, with "<|" escaped within texts so that no
text can look like a turn's border; `unescape` gives it back.

Viterbi steps are max-plus matrices, and these multiply associatively. Messages are sorted into ranges of conversation and turn,
whatever the sizes of conversations are, and each range is cut into chunks of CHUNK messages or CHUNK_BYTES of text. Each chunk
becomes one matrix. Of conversations with several chunks, the matrices of a range are multiplied, then a conversation's ranges
are chained, then the chunks of each range; this gives every chunk its states before and at its end, and each is decoded by itself.
No task holds more than a chunk of texts, however long a conversation is or how many messages share a turn, and the path is as
good as that of one pass over the whole conversation.

Defined cases: null or unknown roles are no evidence; null texts are empty and give one empty turn; null
turns stand before the others; null conv_ids are one conversation; messages with equal turns are ordered by
a hash of role and text; repeated messages each give their turns; an empty table gives no rows, and a table without
any known role is decoded with even odds. Columns other than the four named are not read, so their names can't
clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.llm.common import bounded_batches, cut, partitions

ROLES = ("system", "user", "assistant")
START, STATES = len(ROLES), len(ROLES) + 1
#: Messages and characters that are decoded in one piece; a longer message is a piece of its own.
CHUNK, CHUNK_BYTES = 256, 1 << 20

#: Names of speakers and their roles.
SPEAKERS = {
    "system": 0, "instructions": 0, "instruction": 0,
    "user": 1, "human": 1, "prompter": 1, "customer": 1, "question": 1, "q": 1,
    "assistant": 2, "bot": 2, "ai": 2, "gpt": 2, "model": 2, "agent": 2, "answer": 2, "a": 2,
}
#: Names that also begin lines of plain text.
PLAIN_NAMES = {"instructions", "instruction", "customer", "question", "q", "model", "agent", "answer", "a", "system", "bot", "ai"}
_NAMES = "|".join(sorted(SPEAKERS, key=len, reverse=True))
#: A name with a colon, perhaps as a heading or in bold; or in brackets of its own.
_MARKER = re.compile(rf"\s{{0,8}}(?:(?:#{{1,6}}\s{{0,3}})?(?:\*\*(?P<bold>{_NAMES})(?:\*\*\s{{0,3}}:|:\s{{0,3}}\*\*)|(?P<bare>{_NAMES})\s{{0,3}}:)|<\|(?P<bar>{_NAMES})\|>|\[(?P<square>{_NAMES})\](?:\s{{0,3}}:)?)\s{{0,8}}", re.I)
_LIST = re.compile(r"\s*(?:[-*\u2022]|[0-9]+[.)])\s")
_BORDER = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

#: Chance that a marker names another role than the line's, and that within a message a line without or with a marker changes the
#: speaker.
WRONG_MARKER, CHANGE_IN_MESSAGE, CHANGE_AT_MARKER = 0.01, 0.02, 0.5
SIZES = (0, 1, 4, 12, 40)

Line = tuple[int, int, str, str]  # marker's role or -1, form, the marker's text, the rest


def known_role(role: str | None) -> int:
    return SPEAKERS.get((role or "").strip().lower(), -1)


def lines(text: str | None) -> list[Line]:
    """A message's lines, with the markers that they may begin with."""
    found = []
    for line in (text or "").split("\n"):
        m = _MARKER.match(line)
        name = next(x for x in m.groups() if x).lower() if m else ""
        found.append((name, line[: m.end()] if m else "", line[m.end() :] if m else line))
    roles = {SPEAKERS[n] for n, _, _ in found if n}
    out = []
    for i, (name, marker, rest) in enumerate(found):
        sure = name and (name not in PLAIN_NAMES or len(roles) > 1)
        out.append((SPEAKERS[name] if sure else -1, form(rest if sure else marker + rest, i == 0), marker if sure else "", rest if sure else marker + rest))
    return out


def form(line: str, first: bool) -> int:
    """One number for what a line looks like."""
    n = line.count(" ") + 1 if line.strip() else 0
    size = sum(n > s for s in SIZES)
    kind = 1 if _LIST.match(line) else 2 if line[:1].islower() else 3 if line[:3] == "```" else 0
    return ((size * 4 + kind) * 2 + line.rstrip().endswith("?")) * 2 + first


FORMS = (len(SIZES) + 1) * 4 * 2 * 2


@dataclass(frozen=True)
class Model:
    """Natural logarithms; row START holds a conversation's first role."""

    moves: np.ndarray = field(default_factory=lambda: np.full((STATES, len(ROLES)), -np.log(len(ROLES))))
    forms: np.ndarray = field(default_factory=lambda: np.full((len(ROLES), FORMS), -np.log(FORMS)))

    def steps(self, role: str | None, message: list[Line]) -> np.ndarray:
        """The max-plus matrix from the state before to its own: for each line, or one for a message of known role."""
        if (known := known_role(role)) >= 0:
            out = np.full((1, STATES, STATES), -np.inf)
            out[0, :, known] = self.moves[:, known]
            return out
        out = np.full((len(message), STATES, STATES), -np.inf)
        out[:, :, :START] = self.forms[:, [m[1] for m in message]].T[:, None, :]
        marked = np.array([m[0] >= 0 for m in message])
        stay = np.empty((2, STATES, len(ROLES)))
        for k, change in enumerate((CHANGE_IN_MESSAGE, CHANGE_AT_MARKER)):
            stay[k] = np.log(change / (len(ROLES) - 1))
            stay[k, range(len(ROLES)), range(len(ROLES))] = np.log(1 - change)
        out[0, :, :START] += self.moves
        out[1:, :, :START] += stay[marked[1:].astype(int)]
        for i, (marker, *_) in enumerate(message):
            if marker >= 0:
                out[i, :, :START] += np.log(WRONG_MARKER / (len(ROLES) - 1))
                out[i, :, marker] += np.log(1 - WRONG_MARKER) - np.log(WRONG_MARKER / (len(ROLES) - 1))
        return out


def product(steps: np.ndarray) -> np.ndarray:
    """The steps one after the other as one matrix: neighbours are multiplied until one is left."""
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        pairs = (steps[0:even:2, :, :, None] + steps[1:even:2, None, :, :]).max(axis=2)
        steps = np.concatenate([pairs, steps[even:]])
    return steps[0]


def path(steps: np.ndarray, before: int, last: int | None) -> list[int]:
    """The best states of the steps from state `before`, ending in `last` if that is given."""
    score, back = np.full(STATES, -np.inf), []
    score[before] = 0
    for s in steps:
        through = score[:, None] + s
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    out = [int(score.argmax()) if last is None else last]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _base(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def train(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Count line forms by role, and roles that follow each other, over all messages with a known role."""
    base = _base(messages, conv, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ROLES), FORMS), np.int64)
        for batch in batches:
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (state := known_role(r)) >= 0:
                    for i, line in enumerate((t or "").split("\n")):
                        n[state, form(line, i == 0)] += 1
        cell = np.flatnonzero(n)
        yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(n.ravel()[cell])], ["cell", "n"])

    forms = np.ones((len(ROLES), FORMS))
    for r in bounded_batches(base.select("role", "text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        forms.ravel()[r["cell"]] += r["n"]
    known = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    states = base.select("conv", "turn", F.try_element_at(known, F.lower(F.trim("role"))).alias("state")).filter("turn is not null")
    # one state for each turn number; what follows is an equi-join on the next number
    states = states.groupBy("conv", "turn").agg(F.min("state").alias("state"))
    after = states.select(F.col("conv").alias("c"), (F.col("turn") - 1).alias("t"), F.col("state").alias("next"))
    pairs = states.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).groupBy("state", "next").agg(F.count("*").alias("n"))
    firsts = states.groupBy("conv").agg(F.min_by("state", "turn").alias("next")).groupBy("next").agg(F.count("*").alias("n"))
    moves = np.ones((STATES, len(ROLES)))
    for r in pairs.unionByName(firsts.withColumn("state", F.lit(START))).filter("state is not null and next is not null").collect():
        moves[r["state"], r["next"]] += r["n"]
    return Model(np.log(moves / moves.sum(axis=1, keepdims=True)), np.log(forms / forms.sum(axis=1, keepdims=True)))


# --- chunks ---


def _chunks(base: DataFrame, model: Model) -> DataFrame:
    """(conv, part, chunk, m, turns, roles, texts): messages in order, cut into chunks; `part` is the range they lie in."""
    kind = to_arrow_type(base.schema["conv"].dataType)
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("chunk", pa.int64()), ("m", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, out, held = TaskContext.get().partitionId(), 0, [], 0
        now, rows, size = None, [], 0

        def done() -> dict:
            m = product(np.concatenate([product(model.steps(r, lines(t)))[None] for _, r, t in rows]))
            return {"conv": now, "part": part, "chunk": chunk, "m": m.tobytes(), "turns": [r[0] for r in rows], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows]}

        for batch in batches:
            for c, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                length = len(row[2] or "")
                if rows and (c != now or len(rows) >= CHUNK or size + length > CHUNK_BYTES):
                    out.append(done())
                    chunk, held, rows, size = chunk + 1, held + size, [], 0
                    if held > 1 << 22 or len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                now = c
                rows.append(row)
                size += length
        if rows:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # messages that are equal in all but the last key are equal, so a hot one may be dealt out
    rows = base.select("conv", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    keys = ("conv", "turn", "tie", "salt")
    rows = rows.repartitionByRange(partitions(base.sparkSession), *keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text")
    conv = base.schema["conv"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"conv {conv}, part int, chunk long, m binary, turns array<long>, roles array<string>, texts array<string>")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first `keys` columns, which follow each other."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and r[:keys] != now:
                yield now, rows
                rows = []
            now = r[:keys]
            rows.append(r)
    if rows:
        yield now, rows


def _read(rows: list[tuple], column: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows)).reshape(-1, STATES, STATES)


def _ends(chunks: DataFrame) -> DataFrame:
    """(part, chunk, before, last): of the conversations with several chunks, the states before each chunk and at its end."""
    n, conv = partitions(chunks.sparkSession), chunks.schema["conv"].dataType.simpleString()
    kind = to_arrow_type(chunks.schema["conv"].dataType)
    rows = chunks.select("conv", "part", "chunk", "m")
    several = rows.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("s_conv"))
    rows = cut(rows.join(several, F.col("conv").eqNullSafe(F.col("s_conv")), "left_semi"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, p), found in _grouped(batches, 2):
            yield pa.record_batch([pa.array([c], kind), pa.array([p], pa.int32()), pa.array([product(_read(found, 3)).tobytes()], pa.binary())], ["conv", "part", "m"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c,), found in _grouped(batches, 1):
            states = path(_read(found, 2), START, None)
            cols = [pa.array([c] * len(found), kind), pa.array([r[1] for r in found], pa.int32()), pa.array([START, *states[:-1]], pa.int32()), pa.array(states, pa.int32())]
            yield pa.record_batch(cols, ["p_conv", "p_part", "p_before", "p_last"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _grouped(batches, 2):
            states = path(_read(found, 3), found[0][4], found[0][5])
            cols = [pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.int64()), pa.array([found[0][4], *states[:-1]], pa.int32()), pa.array(states, pa.int32())]
            yield pa.record_batch(cols, ["e_part", "e_chunk", "before", "last"])

    dealt = rows.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "chunk")
    parts = dealt.mapInArrow(multiply, f"conv {conv}, part int, m binary").repartition(n, "conv").sortWithinPartitions("conv", "part")
    parts = cut(parts.mapInArrow(chain, f"p_conv {conv}, p_part int, p_before int, p_last int"))
    met = rows.join(parts, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part"))).select("conv", "part", "chunk", "m", "p_before", "p_last")
    met = met.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "chunk")
    return met.mapInArrow(within, "e_part int, e_chunk long, before int, last int")


# --- turns ---


def escape(text: str) -> str:
    """The text with a backslash more in every "<|", "<\\|" and so on: nothing in it reads as a turn's border."""
    return _BORDER.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n{escape(text)}\n<|end|>\n"


def turns_of(role: str | None, text: str | None, message: list[Line], states: list[int]) -> list[tuple[int, str]]:
    """(state, text) of a message's turns; a marker goes where its line's state is the marker's."""
    if known_role(role) >= 0:
        return [(states[0], text or "")]
    turns: list[tuple[int, list[str]]] = []
    for (marker, _, before, rest), s in zip(message, states, strict=True):
        line = rest if marker == s else before + rest
        if turns and turns[-1][0] == s:
            turns[-1][1].append(line)
        else:
            turns.append((s, [line]))
    return [(s, "\n".join(kept)) for s, kept in turns]


def parse(messages: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, part, role, text, rendered): the turns of every message, in order of turn and part."""
    base = _base(messages, conv, turn, role, text)
    chunks = cut(_chunks(base, model))
    ends = cut(_ends(chunks))
    rows = chunks.join(ends, (F.col("part") == F.col("e_part")) & (F.col("chunk") == F.col("e_chunk")), "left")
    rows = rows.select("conv", "before", "last", "turns", "roles", "texts")
    arrow = to_arrow_type(base.schema["conv"].dataType)
    types = [arrow, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, before, last, turns, roles, texts = (column[i].as_py() for column in batch.columns)
                read = [[] if known_role(r) >= 0 else lines(t) for r, t in zip(roles, texts, strict=True)]
                steps = [model.steps(r, x) for r, x in zip(roles, read, strict=True)]
                states, at, out = path(np.concatenate(steps), START if before is None else before, last), 0, []
                for n, r, t, x, s in zip(turns, roles, texts, read, steps, strict=True):
                    for part, (state, body) in enumerate(turns_of(r, t, x, states[at : at + len(s)])):
                        out.append((c, n, part, ROLES[state], body, render(ROLES[state], body)))
                    at += len(s)
                yield pa.record_batch([pa.array(col, t) for col, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "turn", "part", "role", "text", "rendered"])

    kind = base.schema["conv"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"conv_id {kind}, turn long, part int, role string, text string, rendered string")
