"""Language identification with bit-sliced Bloom filters over byte n-grams.

A filter has one slot of language bits for each hash value: bit l of a slot says that some n-gram of language l has
that hash. The AND of an n-gram's slots is the set of all languages that contain it, found for all languages at
once. A text's n-grams are counted per language that way; the counts are corrected for the rate at which a
language's filter says yes to what it never saw, and the largest corrected count decides.

Training reads a stated sample (about ``Settings.sample`` rows of each language, those whose hash of id and text is
below the share of the language's rows that this is); an n-gram is
put in a language's filter if it is at least ``Settings.share`` of that language's n-grams and, where ``Settings.few`` n-grams of its
length or more do, occurs twice; a small sample keeps what occurs once. The slots are made by Spark, an aggregate of bits by slot, and
reach the driver as long as the filter is: 2**bits words for every 64 languages. Prediction reads every whole text and nothing but the text.

Nulls and odd cases: null, empty and letterless texts are ``und`` with score 0. Null languages are not learned
from. Null ids are predicted, but not learned from. With nothing to learn from, every text is ``und``. Repeated
rows are predicted alike. Ties go to the language that sorts first. Other columns pass through ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, crc_mod, mix64, steps, utf8, written

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """sample: rows learned from, of each language, on average; bits: log2 of the slots; hashes: slots of an n-gram; sizes: n-gram
    lengths in bytes; share: least share of a language's n-grams; few: n-grams that occur twice, from which on others are left out."""

    sample: int = 2000
    bits: int = 18
    hashes: int = 2
    sizes: tuple[int, ...] = (3, 4)
    share: float = 2e-5
    few: int = 64


@dataclass(frozen=True)
class Model:
    """languages in code-point order; slots: uint64 of shape (planes, 2**bits); rate: false positives of each language."""

    settings: Settings
    languages: tuple[str, ...]
    slots: np.ndarray
    rate: np.ndarray


def _grams(texts: pa.Array, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the n-grams as numbers and the text that each is of. ASCII upper case counts as lower case, what is no
    letter as a space, and n-grams with a space inside are left out; every word has a space before and behind, also at the ends of a text."""
    data, off = utf8(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off) + 2)
    letters = np.full(len(row), 32, np.uint8)
    letters[np.arange(len(data)) + 2 * np.repeat(np.arange(len(texts)), np.diff(off)) + 1] = _LETTER[_LOWER[data]]
    for n in sizes:
        m = len(letters) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        for i in range(n):
            key |= letters[i : m + i].astype(np.uint64) << np.uint64(8 * i)
        ok = row[:m] == row[n - 1 :]
        for i in range(1, n - 1) if n > 2 else range(n - 1, n):
            ok &= letters[i : m + i] != 32
        yield key[ok] | np.uint64(n << 60), row[:m][ok]


_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _slots_of(keys: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """The slots of each n-gram."""
    h = mix64(keys)
    return [((h >> np.uint64(i * settings.bits)) & np.uint64((1 << settings.bits) - 1)).astype(np.int64) for i in range(settings.hashes)]


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from (doc_id, text, lang) rows that may all be learned from. Only names of languages and the filter's slots come to the driver."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_rows"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))  # from 0 to 1
    # a row a language; the model that goes to all tasks has 2**bits / 8 bytes for each
    sample = labelled.join(F.broadcast(counts), "lang").where(place < F.lit(settings.sample) / F.col("_rows")).select("lang", "text")
    sizes = settings.sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.column(1).filter(pa.array(langs == lang))
                for _, part in steps(own):
                    for keys, _ in _grams(part, sizes):
                        u, c = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c)], names=["lang", "key", "n"])

    grams = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    grams = written(grams.withColumn("size", F.shiftrightunsigned("key", 60)), "langid-grams")
    sums = grams.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("twice"))
    least = F.greatest(F.when(F.col("twice") >= settings.few, 2).otherwise(1), settings.share * F.col("total"))
    often = grams.join(sums, ["lang", "size"]).where(F.col("n") >= least).select("lang", "key")
    languages = tuple(sorted(r["lang"] for r in sums.select("lang").distinct().collect()))
    nth = {lang: i for i, lang in enumerate(languages)}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([nth[x] for x in batch.column(0).to_pylist()], np.int64)
            for at in _slots_of(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), settings):
                bit = np.left_shift(np.uint64(1), (number % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((number // 64).astype(np.int32)), pa.array(at), pa.array(bit)], names=["plane", "slot", "bits"])

    made = often.mapInArrow(bits, "plane int, slot long, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << settings.bits), np.uint64)
    slots[made.column("plane").to_numpy(), made.column("slot").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    rate = np.array([((slots[i // 64] & np.uint64(1 << (i % 64))) != 0).mean() ** settings.hashes for i in range(len(languages))])
    return Model(settings, languages, slots, rate)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = [], np.zeros(len(texts))
    s, n = model.settings, len(model.languages)
    for first, part in steps(texts):
        hits, seen = np.zeros((max(n, 1), len(part))), np.zeros(len(part))
        for keys, row in _grams(part, s.sizes) if n else ():
            seen += np.bincount(row, minlength=len(part))
            at = _slots_of(keys, s)
            for p in range(len(model.slots)):
                mask = model.slots[p][at[0]]
                for a in at[1:]:
                    mask = mask & model.slots[p][a]
                for i in range(64 * p, min(n, 64 * p + 64)):
                    own = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                    hits[i] += np.bincount(row[own], minlength=len(part))
        true = np.maximum(0, hits - seen * model.rate[:, None]) / (1 - model.rate[:, None]) if n else hits
        best = true.argmax(0)
        score = true[best, np.arange(len(part))] / np.maximum(true.sum(0), 1e-300)
        data, off = utf8(part)
        ascii_letter = np.concatenate([[0], np.cumsum((_LETTER[_LOWER[data]] != 32) & (data < 128))])
        plain = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
        for i in range(len(part)):
            if n and (plain[i] or _has_letter(part[i].as_py())):
                names.append(model.languages[best[i]])
                scores[first + i] = score[i]
            else:
                names.append(UNKNOWN)
    return names, scores


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns, language and score, of the names given; raises ValueError if docs has one of them. Reads each text once."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    if taken := set(names) & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(taken)}: give other names")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the settings give its slots
    out = [*docs.columns, *names]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=out)

    return docs.mapInArrow(label, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def train_split(docs: DataFrame) -> DataFrame:
    """The rows to learn from: crc32 of the id modulo 3 is not 1."""
    return docs.where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third is held out of the training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(train_split(docs))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
