"""Language identification by compression.

For each language labelled documents give raw text: a zstandard raw-content dictionary and a primer. A text,
reduced to its lower-case words without immediate repetitions, is compressed with every dictionary; the
language that leaves the fewest bytes is predicted. The text is compressed behind the language's primer,
whose own compressed size is taken off: it settles zstandard's letter and length statistics, without
which a few words would be stored as they are and all languages tie.

The dictionaries are fitted on a bounded sample: about SAMPLE_TEXTS different texts with a letter of each language,
however often each is copied, chosen by a hash of the text, up to PRIMER_BYTES + DICTIONARY_BYTES; of a text longer than
SAMPLE_CHARS characters a piece of that length. Every labelled language is learned: if there are so many that all this would
pass MODEL_BYTES, each has less of it.
Every text is classified whole: a long one in pieces of PIECE_BYTES, each behind dictionary and primer, as zstandard refers to a dictionary only until primer and
text fill its window (131,072 bytes here); the pieces' sizes are added up.

Rejected is a text whose best language leads the runner-up by less than NARROW_SHARE of its size: noise, and most texts in a
language that was not learned. Where a language's own sampled texts lead by less, its share is lower. With one language the
runner-up is compression without a dictionary.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; with no labelled
document every text is. Equal sizes go to the language that comes first by name, and are a narrow margin.
Repeated rows are each classified, equally. Empty tables give no rows. `keep` returns all columns, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, small_frame

SAMPLE_TEXTS, SAMPLE_CHARS = 300, 20_000
DICTIONARY_BYTES, PRIMER_BYTES, LEVEL = 110_000, 16_000, 3
#: Bytes of all dictionaries and primers together; below a share of 1 / LEAST_PART of their sizes they don't shrink any more.
MODEL_BYTES, LEAST_PART = 64 << 20, 30
#: Bytes of a text that are compressed in one piece: with the primer, well inside the window.
PIECE_BYTES = 32_768
UNKNOWN = "und"
#: A margin is narrow if the runner-up needs less than this many bytes more, or less than this share of the best size.
NARROW_BYTES, NARROW_SHARE = 1, 0.07
#: Sampled texts of a language that its dictionary has no room for lower its share: all but this part of them must pass. So many
#: texts, of so many bytes, are tried for each language.
FALSE_REJECTIONS, TRIED_TEXTS, TRIED_BYTES = 0.05, 20, 2_000
#: Share of the bits by which compressed sizes differ that counts as evidence: neighbouring bytes depend on each other.
EVIDENCE = 0.1

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """(language, primer, dictionary), by language; and each language's narrow share, where it isn't NARROW_SHARE."""

    samples: tuple[tuple[str, bytes, bytes], ...]
    shares: tuple[tuple[str, float], ...] = ()


def words(text: str | None) -> bytes:
    """The text's lower-case words, without immediate repetitions; empty if it has no letter."""
    found = [w for w in _LETTERS.findall((text or "").lower()) if any(map(str.isalpha, w))]
    return (" " + " ".join(w for w, before in zip(found, [None, *found], strict=False) if w != before) + " ").encode("utf-8", "replace") if found else b""


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit the dictionaries on rows of `docs` that have a language and a text."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null and length(text) > 0")
    # a long text gives a piece from a place that its hash names
    x = F.xxhash64("text")
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    different = rows.select("lang", x.alias("x")).distinct()
    counts = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Model(())
    part = max(1 / LEAST_PART, min(1.0, MODEL_BYTES / (len(counts) * (PRIMER_BYTES + DICTIONARY_BYTES))))
    texts, chars, span = int(SAMPLE_TEXTS * part), int(SAMPLE_CHARS * part), 1 << 30
    at = F.pmod(x, F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    share = small_frame(docs.sparkSession, pa.table({"s_lang": pa.array(list(counts), pa.string()), "share": pa.array([min(span, texts * span // n) for n in counts.values()], pa.int64())}))
    sample = rows.join(share, F.col("lang") == F.col("s_lang")).filter(F.pmod(x, F.lit(span)) < F.col("share"))
    sample = sample.select("lang", x.alias("x"), F.col("text").substr(at, F.lit(chars)).alias("text"))
    # copies are one text: the aggregate's map side leaves one row of each group of copies
    sample = sample.groupBy("lang", "x").agg(F.min("text").alias("text"))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in sample.toLocalIterator():
        by_lang.setdefault(r["lang"], []).append((r["x"], r["text"]))
    primer, dictionary = int(PRIMER_BYTES * part), int(DICTIONARY_BYTES * part)
    return _calibrated(Model(tuple((k, *_fill(v, primer, dictionary)) for k, v in sorted(by_lang.items()))), by_lang, primer + dictionary)


def _calibrated(model: Model, by_lang: dict[str, list[tuple[int, str]]], used: int) -> Model:
    """Lower the narrow shares of languages whose own texts lead by less, as those of close relatives do."""
    classify, shares = Classifier(model), []
    for lang, texts in sorted(by_lang.items()):
        found, size = [], 0
        for _, t in sorted(texts):
            raw = words(t)
            size += len(raw)
            if size - len(raw) >= used and raw:
                got, _, lead, least = classify.judge(raw[:TRIED_BYTES])
                found += [lead / max(least, 1)] if got == lang else []
                if len(found) == TRIED_TEXTS:
                    break
        if found and (low := sorted(found)[int(len(found) * FALSE_REJECTIONS)]) < NARROW_SHARE:
            shares.append((lang, low))
    return Model(model.samples, tuple(shares))


def _fill(texts: list[tuple[int, str]], primer: int, dictionary: int) -> tuple[bytes, bytes]:
    pool = b"".join(words(t) for _, t in sorted(texts))[: primer + dictionary]
    at = min(primer, len(pool) // 2)
    return pool[:at] or b" ", pool[at:] or b" "


class Classifier:
    """Compressors, made once for each task."""

    def __init__(self, model: Model):
        self.by_lang, self.shares = [], dict(model.shares)
        for lang, primer, raw in model.samples:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            params = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=4096, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            compress = zstd.ZstdCompressor(dict_data=d, compression_params=params).compress
            self.by_lang.append((lang, primer, len(compress(primer)), compress))

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        """Language, score from 0 to 1, and by how many bytes it leads."""
        return self.judge(words(text))[:3]

    def judge(self, raw: bytes) -> tuple[str, float, int, int]:
        """The same of a text's words(), and their size in that language."""
        if not raw or not self.by_lang:
            return UNKNOWN, 0.0, 0, 0
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = [sum(len(compress(primer + piece)) - own for piece in pieces) for _, primer, own, compress in self.by_lang]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        runners_up = (s for i, s in enumerate(sizes) if i != best)
        lead = min(runners_up, default=0) - sizes[best] if len(sizes) > 1 else sum(map(self._alone, pieces)) - sizes[best]
        return self.by_lang[best][0], 1 / sum(2.0 ** max(-60.0, 8 * EVIDENCE * (sizes[best] - s)) for s in sizes), lead, sizes[best]

    def rejects(self, lang: str, lead: int, size: int) -> bool:
        """Unknown, or by a narrow margin."""
        return lang == UNKNOWN or lead < max(NARROW_BYTES, self.shares.get(lang, NARROW_SHARE) * size)

    @staticmethod
    def _alone(piece: bytes) -> int:
        """Size without dictionary and primer: the runner-up of an only language."""
        return len(zstd.ZstdCompressor(level=LEVEL, write_content_size=False).compress(piece))


def _judged(model: Model, texts: pa.Array, classify: Classifier) -> tuple[list[str], list[float], list[bool]]:
    found = [classify.judge(words(t)) for t in texts.to_pylist()]
    return [f[0] for f in found], [f[1] for f in found], [classify.rejects(f[0], f[2], f[3]) for f in found]


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """The columns of `carry`, lang_pred, score and rejected (unknown, or by a narrow margin) for every row."""
    base = docs.select(*(carry or []), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            n = batch.num_columns - 1
            langs, scores, rejected = _judged(model, batch.column(n), classify)
            yield pa.record_batch(
                [*[batch.column(i) for i in range(n)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*batch.schema.names[:n], "lang_pred", "score", "rejected"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]
    return bounded_batches(base).mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            _, _, rejected = _judged(model, batch.column(batch.schema.get_field_index(text)), classify)
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
