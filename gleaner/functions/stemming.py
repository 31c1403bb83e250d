"""Word forms to stems or lemmas, over distinct tokens and joined back.

`RussianStemmer` is the published Snowball algorithm for Russian, written from its description.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffix classes of the published algorithm.
VOWELS = "аеиоуыэюя"
GERUND_1 = ("в", "вши", "вшись")
GERUND_2 = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE = ("ейш", "ейше")
DERIVATIONAL = ("ост", "ость")


class RussianStemmer:
    """stem(word) for lower-case words with ё already as е."""

    def __init__(self) -> None:
        longest = lambda xs: "|".join(sorted(xs, key=len, reverse=True))
        after = "(?<=[ая])"
        self.gerund = re.compile(f"(?:{longest(GERUND_2)}|{after}(?:{longest(GERUND_1)}))$")
        self.reflexive = re.compile(f"(?:{longest(REFLEXIVE)})$")
        self.adjective = re.compile(f"(?:{longest(ADJECTIVE)})$")
        self.participle = re.compile(f"(?:{longest(PARTICIPLE_2)}|{after}(?:{longest(PARTICIPLE_1)}))$")
        self.verb = re.compile(f"(?:{longest(VERB_2)}|{after}(?:{longest(VERB_1)}))$")
        self.noun = re.compile(f"(?:{longest(NOUN)})$")
        self.derivational = re.compile(f"(?:{longest(DERIVATIONAL)})$")
        self.superlative = re.compile(f"(?:{longest(SUPERLATIVE)})$")

    @staticmethod
    def regions(word: str) -> tuple[int, int]:
        """Where RV (after the first vowel) and R2 (after two vowel-consonant pairs) begin."""
        first = next((i for i, c in enumerate(word) if c in VOWELS), None)
        rv = len(word) if first is None else first + 1
        at = 0
        for _ in range(2):
            at = next((i + 1 for i in range(at + 1, len(word)) if word[i] not in VOWELS and word[i - 1] in VOWELS), len(word))
        return rv, at

    def stem(self, word: str) -> str:
        rv, r2 = self.regions(word)
        head, tail = word[:rv], word[rv:]

        def strip(pattern: re.Pattern[str], text: str) -> str | None:
            found = pattern.search(text)
            return text[: found.start()] if found else None

        done = strip(self.gerund, tail)
        if done is None:
            tail = strip(self.reflexive, tail) if self.reflexive.search(tail) else tail
            done = strip(self.adjective, tail)
            if done is not None:
                shorter = strip(self.participle, done)
                done = done if shorter is None else shorter
            else:
                done = strip(self.verb, tail)
                if done is None:
                    done = strip(self.noun, tail)
        tail = tail if done is None else done
        tail = tail.removesuffix("и")
        whole = head + tail
        if r2 < len(whole) and (m := self.derivational.search(whole, r2)):
            whole = whole[: m.start()]
        tail = whole[rv:]
        shorter = strip(self.superlative, tail)
        if shorter is not None:
            tail = shorter
        if tail.endswith("нн"):
            tail = tail[:-1]
        elif shorter is None and tail.endswith("ь"):
            tail = tail[:-1]
        return head + tail


def stem_tokens(distinct_tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, form): the stems of distinct tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stemmer = RussianStemmer()
        for batch in batches:
            yield pd.DataFrame({"token": batch[token], "form": [stemmer.stem(t) for t in batch[token]]})

    return distinct_tokens.select(token).mapInPandas(run, "token string, form string")


def normalize_tokens(rows: DataFrame, mode: str = "plain", lemmas: DataFrame | None = None, token: str = "token") -> DataFrame:
    """Rows with `token` in the form that the mode asks for: plain, snowball, or lemma.

    Forms are made once for each distinct token. `lemmas` is a (token, lemma) dictionary; a token
    that it lacks, or that is not written in Russian letters only, stays as it is; ё becomes е.
    """
    if mode == "plain":
        return rows
    distinct = rows.select(token).distinct()
    if mode == "snowball":
        forms = stem_tokens(distinct, token)
    elif mode == "lemma" and lemmas is not None:
        known = lemmas.select(F.col("token"), F.translate("lemma", "ё", "е").alias("lemma"))
        forms = distinct.select(F.col(token).alias("token")).join(known, "token", "left")
        russian = F.col("token").rlike("^[а-я]+$")
        forms = forms.select("token", F.when(russian, F.coalesce("lemma", "token")).otherwise(F.col("token")).alias("form"))
    else:
        raise ValueError(f"unknown mode, or no dictionary for it: {mode}")
    forms = forms.withColumnRenamed("token", "f_token")
    joined = rows.join(forms, rows[token] == F.col("f_token"))
    return joined.select(*[F.col("form").alias(token) if c == token else rows[c] for c in rows.columns])
