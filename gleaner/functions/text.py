"""Column expressions for text: normalising, tokens, n-grams, document composition, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two or more letters, digits or underscores of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: The same with inner hyphens; it starts and ends at a letter, digit or underscore.
HYPHEN_TOKEN = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_][\p{L}\p{N}_-]*[\p{L}\p{N}_]"
SEED = "20260918"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """Null to empty, lower case, ё to е, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(filled(c)), "ё", "е"), r"(?U)\s+", " "))


def normalize_basic(c: Column) -> Column:
    """Lower case and trimmed only, as the data profile counts texts."""
    return F.trim(F.lower(filled(c)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def hyphen_tokens(c: Column) -> Column:
    """Distinct tokens that may hold hyphens."""
    return F.array_distinct(F.regexp_extract_all(normalize_text(c), F.lit(HYPHEN_TOKEN), F.lit(0)))


def coverage(needles: Column, haystack: Column) -> Column:
    """Share of the distinct needles that the haystack holds; 0 without needles."""
    found = F.size(F.array_intersect(needles, haystack))
    return F.when(F.size(needles) > 0, found / F.size(F.array_distinct(needles))).otherwise(F.lit(0.0))


def contains_query(query: Column, text: Column) -> Column:
    """1.0 if a query that is not empty stands in the text."""
    return F.when((F.length(query) > 0) & F.contains(text, query), F.lit(1.0)).otherwise(F.lit(0.0))


#: What a document is made of: the parts of an item, and whether a query adds its parameters.
VARIANTS = {
    "title": (("title",), False),
    "title_params": (("title", "params"), True),
    "all_text": (("title", "params", "description"), True),
}
#: Repetitions of the title and of the query in the weighted composition.
TITLE_TIMES = {"title": 1, "title_params": 2, "all_text": 3}
QUERY_TIMES = 2


def compose_item(variant: str, parts: dict[str, Column], weighted: bool = False) -> Column:
    """An item's document: its normalised parts joined by spaces; weighted, the title is repeated."""
    names = VARIANTS[variant][0]
    times = TITLE_TIMES[variant] if weighted else 1
    cols = [parts["title"]] * times + [parts[n] for n in names[1:]]
    return F.trim(F.concat_ws(" ", *cols))


def compose_query(variant: str, query: Column, params: Column, weighted: bool = False) -> Column:
    """A query's document: with its parameters in every variant but `title`; weighted, the query is repeated."""
    with_params = VARIANTS[variant][1]
    cols = [query] * (QUERY_TIMES if weighted and with_params else 1) + ([params] if with_params else [])
    return F.trim(F.concat_ws(" ", *cols))


def word_ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of low..high words, joined by spaces."""
    grams = [words if n == 1 else _runs(words, n) for n in range(low, high + 1)]
    return F.concat(*grams) if len(grams) > 1 else grams[0]


def _runs(words: Column, n: int) -> Column:
    """Shifted copies side by side: `words` is evaluated a few times in all, not once for each run."""
    k = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), k)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(j + 1), k), lambda a, b: F.concat_ws(" ", a, b))
    return out


def char_wb_ngrams(text: Column, low: int = 4, high: int = 4) -> Column:
    """Character n-grams within words, each word padded by a space on both sides; a padded word shorter than the
    smallest n is a gram itself, and longer n add nothing for a word that is no longer than a smaller n."""
    words = F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    out = [F.flatten(F.transform(padded, lambda w: _slide(w, low, whole=True)))]
    for n in range(low + 1, high + 1):
        out.append(_longer(padded, n))
    return F.concat(*out) if len(out) > 1 else out[0]


def _slide(word: Column, n: int, whole: bool) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: word.substr(i, F.lit(n)))
    return cut if whole else F.when(F.length(word) >= n, cut).otherwise(F.array().cast("array<string>"))


def _longer(padded: Column, n: int) -> Column:
    return F.flatten(F.transform(padded, lambda w: _slide(w, n, whole=False)))


def stable_hash(value: Column, seed: str = SEED) -> Column:
    """SHA-1 of "seed|value", in hex."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), value).cast("binary"))


def signature_text(*parts: Column) -> Column:
    """A tuple of strings as Python prints it: in single quotes, or in double ones if it holds single quotes only; backslashes, the
    quotes around it, line feeds, carriage returns, tabs and other control characters below 160 are escaped. Nulls read None."""

    def printed(p: Column) -> Column:
        c = p.cast("string")
        double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(char), F.lit(name))
        # the rest of them are rare: only such strings are walked
        odd = F.transform(F.split(c, ""), lambda x: F.when(x.rlike("[\\x00-\\x1f\\x7f-\\xa0\\xad]"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))).otherwise(x))
        c = F.when(c.rlike("[\\x00-\\x1f\\x7f-\\xa0\\xad]"), F.array_join(odd, "")).otherwise(c)
        quoted = F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))
        return F.coalesce(quoted, F.lit("'None'"))

    return F.concat(F.lit("("), F.concat_ws(", ", *map(printed, parts)), F.lit(",)" if len(parts) == 1 else ")"))


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)
