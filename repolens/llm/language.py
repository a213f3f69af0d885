"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted
by its place, by multiplication; a text's vector bundles (adds) its n-grams' vectors; a language's prototype
is the normalised bundle of its texts. A text goes to the prototype of the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, crc_of_id, documents, per_slice, slices

DIMENSIONS = 1024
SYMBOLS = 64
GRAM = 3
SEED = 20
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Languages a model may have; more is an error, since prototypes are broadcast.
MAX_LANGUAGES = 1000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """A symbol for each code point: 0 for all but letters, 1-26 for a-z, others by their number's remainder."""
    table = np.zeros(0x110000, np.int64)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))):
        points = np.arange(*m.span())
        table[points] = 27 + points % (SYMBOLS - 27)
    for i in range(26):
        table[[65 + i, 97 + i]] = 1 + i
    return table


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Vectors of n-grams given by number, first letter highest: letter k from the end is rolled k places."""
    letters = letter_vectors()
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for k in range(GRAM):
        out *= np.roll(letters, k, axis=1)[(grams // SYMBOLS**k) % SYMBOLS]
    return out


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram) pairs, once for each occurrence, and which texts have a letter. Runs of other than
    letters are one symbol, also at both ends; letters are lower-cased."""
    lower = [f" {t.lower()} " if t else "  " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = symbols()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (owner[1:] != owner[:-1])
    symbol, owner = symbol[keep], owner[keep]
    lettered = np.bincount(owner, symbol != 0, len(texts)) > 0
    n = len(symbol) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    number = np.zeros(n, np.int64)
    for k in range(GRAM):
        number = number * SYMBOLS + symbol[k : k + n]
    inside = owner[:n] == owner[GRAM - 1 :]
    return owner[:n][inside], number[inside], lettered


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray

    def compare(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The nearest language of each text and its cosine, from 0 to 1."""
        owner, gram, lettered = grams_of(texts)
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return found, scores
        for low in range(0, len(texts), 256):
            high = min(low + 256, len(texts))
            here = slice(*np.searchsorted(owner, [low, high]))
            distinct, column = np.unique(gram[here], return_inverse=True)
            vectors = np.zeros((high - low, DIMENSIONS), np.float32)
            for at in range(0, len(distinct), 4096):
                part = (column >= at) & (column < at + 4096)
                width = min(4096, len(distinct) - at)
                counts = np.bincount((owner[here][part] - low) * width + column[part] - at, minlength=(high - low) * width)
                vectors += counts.reshape(high - low, width).astype(np.float32) @ gram_vectors(distinct[at : at + width]).astype(np.float32)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            cosine = (vectors / np.maximum(norm, 1e-9)) @ self.prototypes.T
            best = cosine.argmax(axis=1)
            for i in range(high - low):
                if lettered[low + i]:
                    found[low + i] = self.languages[best[i]]
                    scores[low + i] = float(np.clip(cosine[i, best[i]], 0.0, 1.0))
        return found, scores


def learn(docs: DataFrame) -> Profiles:
    """Prototypes from all rows of ``docs`` with a text and a language. Bundling is a sum, so n-gram counts by
    language, added up on the executors, give it exactly; at most languages x symbols^3 rows come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            owner, gram, _ = grams_of(batch.column("text").to_pylist())
            for lang in set(langs):
                of = np.array([x == lang for x in langs])
                got = np.bincount(gram[of[owner]], minlength=SYMBOLS**GRAM)
                sums[lang] = sums.get(lang, 0) + got
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], schema=arrow_schema("lang string, gram long, n long"))

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    where = {x: i for i, x in enumerate(languages)}
    row = np.array([where[x] for x in counts["lang"].to_pylist()], np.int64)
    gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    prototypes = np.zeros((len(languages), DIMENSIONS))
    for i in range(len(languages)):
        mine = np.flatnonzero(row == i)
        for at in range(0, len(mine), 8192):
            part = mine[at : at + 8192]
            prototypes[i] += n[part].astype(np.float64) @ gram_vectors(gram[part]).astype(np.float64)
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Profiles(languages, (prototypes / np.maximum(norm, 1e-9)).astype(np.float32))


def predict_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; ``und`` and 0 for null or letterless texts, or if
    nothing was learned. Only ``doc_id`` and ``text`` are read."""

    def fn(batch: pa.RecordBatch) -> dict:
        found, scores = profiles.compare(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": found, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(rows, fn, "doc_id long, lang_pred string, score double")


def op10_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the rows that are not held out. A null id is not held out."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_of_id() % FOLDS == HELD_OUT, F.lit(False))
    profiles = learn(docs.where(~held_out))
    return predict_language(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
