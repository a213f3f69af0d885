"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context-window scores.

The lexicon (whole terms, and stems that take any ending) is learned from labelled rows. Each distinct word
runs through the trie together with its Levenshtein automaton, so that misspelled terms are caught without
comparing the word with every term. Each hit is looked at in a window of words: between quotation marks or
beside a word of reporting it counts as quotation, beside an address to somebody as abuse. A logistic model
turns the counts into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, crc_of_id, documents, id_and_text, materialize, per_slice, slices

FOLDS = 5
#: Labelled rows of either kind that a fit reads at most, and terms that a lexicon holds at most.
FIT_TOXIC, FIT_CLEAN = 6_000, 14_000
MAX_TERMS = 2_000
STEM_SIZES = (4, 5, 6, 7)
WINDOW = 6
#: Highest probability that chance alone makes a word look toxic, and that it makes a repeated stem do so, of
#: which there are far fewer.
CHANCE, STEM_CHANCE = 5e-5, 1e-3

#: A word: letters and digits, stand-in signs only before or between them.
WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!*]+[^\W_]+)*")
#: Signs that stand in for letters within a word; fixed values.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
#: Words of reporting and of address in the corpus languages; fixed values.
REPORTING = frozenset("said says wrote writes called quote quoted quotes term word phrase means dit écrit mot appelé sagte sagt schrieb wort genannt dijo dice escribió palabra llamado".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir ihr euch sie tu te toi vous votre ton tú ti usted ustedes eres".split())
QUOTES = "\"“”„«»‘"


def allowed(length: int) -> int:
    """Errors a term may have: none below five letters, one below nine, else two."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """Terms on a trie; a node knows the shortest and longest term below it."""

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for term in sorted(terms):
            node = 0
            self.most[0] = max(self.most[0], allowed(len(term)))
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed(len(term)))
            self.term[node] = term

    def near(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest errors against ``word`` (a letter more, less or other, or two neighbours
        swapped), within what its length allows. The automaton is nondeterministic, its states bits: bit i of
        mask k says that i letters of the word can be read with k errors. A branch ends when no state that
        some term below it allows is left."""
        n, masks = len(word), {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full, end = (2 << n) - 1, 1 << n
        best: tuple[str, int] | None = None
        start = (1, 3 & full, 7 & full)
        stack = [(0, "", start, (0, 0, 0))]
        while stack:
            node, last, (r0, r1, r2), (p0, p1, _) = stack.pop()
            term = self.term[node]
            if term is not None:
                errors = 0 if r0 & end else 1 if r1 & end else 2 if r2 & end else 3
                if errors <= allowed(len(term)) and (best is None or (errors, term) < (best[1], best[0])):
                    best = (term, errors)
            for c, child in self.next[node].items():
                m = masks.get(c, 0)
                most = self.most[child]
                n0 = (r0 & m) << 1
                n1 = n2 = 0
                if most:
                    swap = m & (masks.get(last, 0) >> 1)
                    n1 = (((r1 & m) << 1) | r0 | (r0 << 1) | (n0 << 1) | ((p0 & swap) << 2 if last else 0)) & full
                if most > 1:
                    n2 = (((r2 & m) << 1) | r1 | (r1 << 1) | (n1 << 1) | ((p1 & swap) << 2 if last else 0)) & full
                if n0 | n1 | n2:
                    stack.append((child, c, (n0, n1, n2), (r0, r1, r2)))
        return best


class _Known(dict):
    """What the lexicon says of a word, kept up to a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = got = self.lexicon.look(word)
        return got


@dataclass
class Lexicon:
    """Whole terms, stems (which mean nothing without an ending), and terms that a stem covers: these are for the
    automaton alone. With at most one error a term's first or second half stands unchanged at its end
    of the word, with at most two one of its thirds near its place, but for swaps across a border, for which
    the piece with its last or first letter swapped is kept too; words without any such piece never reach the
    automaton."""

    terms: list[str]
    stems: list[str]
    inflected: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        spelled = [*self.terms, *self.inflected]
        self.trie = Trie(spelled)
        self.exact, self.prefix = frozenset(self.terms), frozenset(self.stems)
        heads: set[str] = set()
        tails: set[str] = set()
        middles: set[str] = set()
        for t in spelled:
            k, n = allowed(len(t)), len(t)
            if k:
                low, high = (n // 2, n // 2) if k == 1 else (n // 3, n - n // 3)
                heads |= {t[:low], t[: low - 1] + t[low]}
                tails |= {t[high:], t[high - 1] + t[high + 1 :]}
                if k == 2:
                    middles.add(t[low:high])
        self.heads, self.tails, self.middles = frozenset(heads), frozenset(tails), sorted(middles)
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in heads}), sorted({len(h) for h in tails})
        self.longest = max((len(t) + allowed(len(t)) for t in spelled), default=0)

    def _worth(self, word: str) -> bool:
        if not 4 <= len(word) <= self.longest:
            return False
        for k in self.head_sizes:
            if word[:k] in self.heads:
                return True
        for k in self.tail_sizes:
            if word[-k:] in self.tails:
                return True
        for m in self.middles:
            if m in word:
                return True
        return False

    def _plain(self, word: str) -> int:
        if word in self.exact:
            return 1
        for k in STEM_SIZES:
            if len(word) > k and word[:k] in self.prefix:
                return 2
        return 0

    def look(self, word: str) -> int:
        """0 for a clean word, 1 for a term, 2 for a stem with some ending, 3 for a misspelled term."""
        got = self._plain(word)
        if got:
            return got
        letters = word.translate(STAND_INS)
        if letters != word and self._plain(letters):
            return 3
        return 3 if self._worth(letters) and self.trie.near(letters) else 0


def hits(text: str, known: _Known) -> list[tuple[int, int, str, bool, bool]]:
    """(start, kind, word, quoted, addressed) of each hit. Quoted: quotation marks stand on both sides within
    the window, or a word of reporting is in it; addressed: a word of address is in it."""
    lower = text.lower()
    if not any(map(known.__getitem__, WORD.findall(lower))):
        return []
    found = list(WORD.finditer(lower))
    words = [m.group() for m in found]
    out = []
    for i, (m, word) in enumerate(zip(found, words, strict=True)):
        kind = known[word]
        if not kind:
            continue
        low, high = max(0, i - WINDOW), min(len(found), i + WINDOW + 1)
        before = lower[max(0, found[low].start() - 2) : m.start()]
        after = lower[m.end() : found[high - 1].end() + 2]
        near = {*words[low:i], *words[i + 1 : high]}
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or not near.isdisjoint(REPORTING)
        out.append((m.start(), kind, word, quoted, not near.isdisjoint(ADDRESS)))
    return out


N_FEATURES = 6
_ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def measure(text: str | None, known: _Known) -> list[float]:
    """Logarithms of how many terms, stems, misspelled terms, quoted and addressed hits, and hits at all. One
    word with a stem may be chance: of those only what goes beyond the first counts."""
    got = hits(text, known) if text else []
    if sum(h[1] == 2 for h in got) == 1:
        got = [h for h in got if h[1] != 2]
    counts = [sum(h[1] == k for h in got if not h[3]) for k in (1, 2, 3)]
    counts[1] = max(0, counts[1] - 1)
    counts += [sum(h[3] for h in got), sum(h[4] and not h[3] for h in got), len(got)]
    return np.log1p(counts).tolist()


@dataclass
class ToxicModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], known: _Known) -> list[float]:
        x = np.array([measure(t, known) for t in texts]).reshape(len(texts), N_FEATURES)
        return (1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))).tolist()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the weights; without both labels, a bias only."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(N_FEATURES), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    w = np.zeros(full.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p) + 1e-6)[:, None]) + penalty, full.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _smallest(text: str) -> list[int]:
    """The smallest hash of any three words in a row, under four orders."""
    words = text.lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int((hashes * np.uint64(odd)).min() >> np.uint64(1)) for odd in _ORDERS]


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS, most_clean: float = 0.02) -> Lexicon:
    """Terms that toxic rows of ``sample`` (text, toxic) use, and stems that they use with endings at least
    twice in a text, and clean ones hardly ever do: at a rate among clean texts of at most ``most_clean`` of that
    among toxic ones, and in so many toxic texts (three or more) that chance, given the share of toxic texts in
    the sample, gives that with a probability of ``CHANCE`` or ``STEM_CHANCE`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(t, s, c[1], c[0]) for (t, s), c in sums.items()]
            sums.clear()
            schema = arrow_schema("term string, stem boolean, n_toxic long, n_clean long")
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = Counter(WORD.findall((text or "").lower()))
                stems: Counter[str] = Counter()
                for w, n in words.items():
                    for k in STEM_SIZES:
                        if len(w) > k:
                            stems[w[:k]] += n
                names = [(w, False) for w in words if 3 <= len(w) <= 40] + [(w, True) for w, n in stems.items() if n > 1]
                for name in names:
                    sums.setdefault(name, [0, 0])[toxic] += 1
                if len(sums) > 200_000:
                    yield from out()
        yield from out()

    # near copies of one text would vouch for all of its words: of texts that share the smallest of their
    # shingle hashes under one of four orders, one counts
    def sketch(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        marks = [_smallest(t or "") for t in texts]
        return {"text": batch.column("text"), "toxic": batch.column("toxic")} | {f"m{k}": [m[k] for m in marks] for k in range(4)}

    sample = per_slice(sample.select("text", "toxic"), sketch, "text string, toxic int, m0 long, m1 long, m2 long, m3 long")
    for k in range(4):
        sample = sample.dropDuplicates(["toxic", f"m{k}"])
    sample = materialize(sample.select("text", "toxic"), "sample")
    size = sample.groupBy("toxic").count().collect()  # two rows
    n = {r["toxic"]: r["count"] for r in size}
    ratio = n.get(1, 0) / max(1, n.get(0, 0))
    counts = sample.select("text", "toxic").mapInArrow(count, "term string, stem boolean, n_toxic long, n_clean long").groupBy("term", "stem").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"))
    share = n.get(1, 0) / max(1, sum(n.values()))
    least, least_stem = (max(3, math.ceil(math.log(p) / math.log(share))) if 0 < share < 1 else 3 for p in (CHANCE, STEM_CHANCE))
    worth = counts.where((F.col("t") >= F.when(F.col("stem"), least_stem).otherwise(least)) & (F.col("c") * ratio <= most_clean * F.col("t")))
    best = worth.orderBy(F.desc("t"), "term", "stem").limit(max_terms).collect()  # at most max_terms rows
    support = {(r["term"], r["stem"]): r["t"] for r in best}
    by_term = {t: k for (t, stem), k in support.items() if not stem}
    alone: dict[str, int] = {}
    for t, k in by_term.items():
        for n_letters in STEM_SIZES:
            alone[t[:n_letters]] = max(alone.get(t[:n_letters], 0), k)
    # a stem says more than its terms only where it is in many more texts than any one of them; of stems within
    # each other the longest that loses few texts
    many = {t: k for (t, stem), k in support.items() if stem and k >= 1.5 * alone.get(t, 0)}
    stems = sorted(t for t, k in many.items() if not any(u != t and u.startswith(t) and n >= 0.9 * k for u, n in many.items()))
    stems = [t for t in stems if not any(t[:k] in stems for k in STEM_SIZES if k < len(t))]
    covered = frozenset(stems)
    inflected = {t for t in by_term if any(len(t) > k and t[:k] in covered for k in STEM_SIZES)}
    return Lexicon(sorted(by_term.keys() - inflected), stems, tuple(sorted(inflected)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = FIT_TOXIC, clean_rows: int = FIT_CLEAN) -> ToxicModel:
    """Lexicon and weights from at most ``toxic_rows`` and ``clean_rows`` labelled rows, those with the
    smallest hash of their id. Rows with a null id or label are not used; of repeated ids the highest label."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(rows.where("toxic = 0").orderBy(*order).limit(clean_rows))
    sample = id_and_text(docs).join(F.broadcast(picked), "doc_id")  # at most toxic_rows + clean_rows rows of 12 bytes
    lexicon = learn_lexicon(sample)
    known = _Known(lexicon)

    def fn(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "x": [measure(t, known) for t in batch.column("text").to_pylist()]}

    got = per_slice(sample.select("doc_id", "text", "toxic"), fn, "doc_id long, toxic int, x array<double>").orderBy("doc_id").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, N_FEATURES)
    weights, bias = logistic(x, got["toxic"].to_numpy().astype(float))
    return ToxicModel(lexicon, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score`` of every whole text; null text is empty and gets the bias alone."""
    known = _Known(model.lexicon)

    def fn(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "score": model.scores(texts, known)}

    return per_slice(id_and_text(docs), fn, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row. Held out: crc32 of the id as text is a multiple
    of 5; those labels are never learned from. A null id is not held out. Equal texts score alike; an empty
    table gives no rows; other columns are not read."""
    model = fit_toxicity(docs, labels.where(crc_of_id() % FOLDS != 0))
    held_out = F.coalesce(crc_of_id() % FOLDS == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
