"""Secret scanning over a trigram inverted index, with DataFrame functions only.

`trigram_query` derives from a rule's regular expression what trigrams any match must contain, as an OR of
ANDs. `index` makes the postings (trigram, doc_id) of the trigrams that the rules ask for, in one pass over whole,
case-folded texts. `candidates` intersects the postings of each AND, by counting how many of its trigrams a document has, and
unites the rules that a document may match. `scan` verifies the candidates with the expressions themselves; a rule without mandatory
trigrams (long hex runs, say) has no query and is matched against every text. Rules are rows and arrays, not columns: their number
is not limited. A rule must not look around itself, as (?=...) does: its matches are also taken apart by themselves.

Defined cases: a null text counts as empty; a repeated doc_id shares its candidates (each of its texts
is verified on its own, so this only costs time); null doc_ids are one id; without rules there are no spans. Matches are leftmost and
non-overlapping for each rule; offsets count code points, ends are exclusive. Empty tables give no
rows. Columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """A match of `pattern` counts if its `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same matches as [0-9a-f]+ of 24 or more, without the short ones
)

#: Conjunctions or strings kept while deriving a query; beyond, the query is widened, which stays right.
MOST = 64
#: Candidate ids are sent to every executor up to this many bytes; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20

Query = frozenset  # of frozensets of trigrams: OR of ANDs; with an empty AND it excludes nothing


# --- what trigrams must a match contain? ---


def trigram_query(pattern: str) -> Query | None:
    """The weakest OR of ANDs of lower-case trigrams that every match meets, or None if any text might match."""
    run, _, query = _walk(sre.parse(pattern))
    query = _both(query, _of_strings(run))
    return None if frozenset() in query else _shortest(query)


def _trigrams(s: str) -> frozenset:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _of_strings(strings: set[str]) -> Query:
    return frozenset(map(_trigrams, strings))


def _shortest(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    a, b = _shortest(a), _shortest(b)
    if len(a) * len(b) > MOST:
        return min(a, b, key=lambda q: (frozenset() in q, len(q)))
    return _shortest(frozenset(x | y for x in a for y in b))


ANY: Query = frozenset([frozenset()])


def _walk(nodes) -> tuple[set[str], bool, Query]:
    """The strings that a match of the sequence ends in; whether they are all of it; a query for what stands before them."""
    run, whole, query = {""}, True, ANY
    for node in nodes:
        options, inner = _node(node)
        if options is not None and len(run) * len(options) <= MOST:
            run = {x + y for x, y in product(run, options)}
        else:
            query = _both(_both(query, inner), _of_strings(run))
            run, whole = options or {""}, False
    return run, whole, query


def _group(nodes) -> tuple[set[str] | None, Query]:
    run, whole, query = _walk(nodes)
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def _node(node) -> tuple[set[str] | None, Query]:
    """The strings that a node may match, or None if they are too many; and a query."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg)}, ANY
    if op == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                chars |= {chr(x) for x in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 4 else (None, ANY)
    if op == "SUBPATTERN":
        return _group(arg[-1])
    if op == "BRANCH":
        parts = [_group(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANY
        return None, _shortest(frozenset().union(*(_both(q, _of_strings(s)) if s is not None else q for s, q in parts)))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, what = arg
        strings, inner = _group(what)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low and strings is not None and len(strings) == 1 and low * len(next(iter(strings))) <= 64:
            return (({next(iter(strings)) * low}, ANY) if low == high else (None, _of_strings({next(iter(strings)) * low})))
        return None, inner if low else ANY
    if op == "AT":
        return {""}, ANY
    return None, ANY


# --- the index and its candidates ---


def vocabulary(queries: list[Query | None]) -> list[str]:
    """The trigrams that the queries ask for, in order."""
    return sorted({g for q in queries if q is not None for a in q for g in a})


def _any_of(grams: list[str]) -> str:
    """An expression that looks ahead for one of the trigrams at every place, so that they may overlap; equal beginnings are
    tried once."""
    tree: dict[str, dict[str, set[str]]] = {}
    for a, b, c in grams:
        tree.setdefault(a, {}).setdefault(b, set()).add(c)
    lit = lambda c: f"\\x{{{ord(c):x}}}"
    ends = lambda cs: "[" + "".join(map(lit, sorted(cs))) + "]"
    each = (lit(a) + "(?:" + "|".join(lit(b) + ends(cs) for b, cs in sorted(rest.items())) + ")" for a, rest in sorted(tree.items()))
    return f"(?=({'|'.join(each)}))"


def index(docs: DataFrame, grams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, doc_id)."""
    here = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_any_of(grams)), F.lit(1)))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(here).alias("gram"))


def candidates(postings: DataFrame, queries: list[Query | None]) -> DataFrame:
    """(doc_id, rules): the numbers of the rules whose queries the document's trigrams meet, in order."""
    ands = [(rule, a) for rule, q in enumerate(queries) if q is not None for a in sorted(q, key=sorted)]
    spark = postings.sparkSession
    asked = spark.createDataFrame([(g, k, rule, len(a)) for k, (rule, a) in enumerate(ands) for g in sorted(a)], "a_gram string, a_and int, rule int, need int")
    met = postings.join(F.broadcast(asked), F.col("gram") == F.col("a_gram"))  # as many rows as the rules have trigrams
    # equal rows of one id count several times: that only makes more candidates
    whole = met.groupBy("doc_id", "a_and", "rule", "need").agg(F.count("*").alias("n")).filter("n >= need")
    return whole.groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


# --- verification ---

_KIND = "array<struct<start:int,kind:int,end:int>>"
#: Matches that are put in a row together: an array that grows is copied with each of them.
RUN = 512


def _matches(text: Column, pattern: Column, group: Column, least: Column, order: Column) -> Column:
    """Array of (start, order, end) of a rule's matches."""
    found, held = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, group)
    # lengths of what stands before each match, of the match and of the part that must be long enough
    between = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        F.zip_with(found, held, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))),
        lambda b, x: F.struct(F.length(b).alias("b"), x["m"].alias("m"), x["g"].alias("g")),
    )
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN)))

    def walked(run: Column, at: Column) -> Column:
        """The spans of some matches, the first of which has its text from `at` on."""
        return F.aggregate(
            run,
            F.struct(at.alias("at"), F.array().cast(_KIND).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["b"] + x["m"]).alias("at"),
                F.when(x["g"] >= least, F.array_append(acc["out"], F.struct((acc["at"] + x["b"]).alias("start"), order.alias("kind"), (acc["at"] + x["b"] + x["m"]).alias("end"))))
                .otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + x["b"] + x["m"]))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    spans = F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), walked))
    return F.when(F.rlike(text, pattern), spans).otherwise(F.array().cast(_KIND))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, spans, n_<kind>...): spans holds (kind, start, end) by start, then by the rules' order."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = vocabulary(queries)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    always = F.array(*[F.lit(i) for i, q in enumerate(queries) if q is None]).cast("array<int>")
    if grams:
        found = cut(candidates(index(base, grams), queries))
        if found.count() * (16 + 4 * len(rules)) <= BROADCAST_BYTES:
            found = F.broadcast(found)
        found = found.withColumnRenamed("doc_id", "c_id")
        base = base.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")), "left").drop("c_id")
        base = base.withColumn("rules", F.concat(always, F.coalesce("rules", F.array().cast("array<int>"))))
    else:
        base = base.withColumn("rules", always)
    rule = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.group).alias("group"), F.lit(r.least).alias("least"), F.lit(r.kind).alias("kind")) for r in rules])

    def matches(i: Column) -> Column:
        r = F.element_at(rule, i + 1)
        return _matches(F.col("text"), r["pattern"], r["group"], r["least"], i)

    if rules:
        base = base.select("doc_id", "text", F.array_sort(F.flatten(F.transform("rules", matches))).alias("found"))
        kind = lambda x: F.element_at(rule, x["kind"] + 1)["kind"]
    else:
        base, kind = base.select("doc_id", "text", F.array().cast(_KIND).alias("found")), lambda x: F.lit("")
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")
    spans = F.transform("found", lambda x: F.struct(kind(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return base.select("doc_id", "text", spans.alias("spans"), *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)])


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
