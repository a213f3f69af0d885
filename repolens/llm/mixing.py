"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree of domains, languages and sources, split by weight at each node. What a node
cannot use, because all below it is used up, goes to its siblings by their weights; only what all of them
cannot take goes up. A leaf's budget is whole epochs of its documents and a token-prefix of one more, whose
order is seeded anew for each epoch: it ends some tokens into the document at a cut in the order's hash, found
from sums of hash slices, so no leaf, however large, is ever sorted in one task. A node of weight 0 is never
drawn from, nor is anything below it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, per_slice
from .tokens import default_path, tokenizer

SEED = 11
DOMAINS = 4
LEVELS = ("domain", "lang", "source")
#: Leaves a tree may have; their plan is broadcast.
MAX_LEAVES = 200_000
ROWS_IN_SLICE = 5_000

Path = tuple[str, ...]


def split(budget: int, weights: list[float], capacity: list[int]) -> list[int]:
    """``budget`` by weight, no share over its capacity, the rest again by weight among those with room.
    Whole tokens: what rounding leaves goes one by one to the largest remainders, then the first. A weight of
    0 gets nothing."""
    share = [0] * len(weights)
    capacity = [c if w > 0 else 0 for c, w in zip(capacity, weights, strict=True)]
    left = min(budget, sum(capacity))
    while left:
        room = [i for i in range(len(weights)) if share[i] < capacity[i]]
        total = sum(weights[i] for i in room)
        part = {i: left * weights[i] / total for i in room}
        full = [i for i in room if part[i] >= capacity[i] - share[i]]
        if full:
            for i in full:
                left -= capacity[i] - share[i]
                share[i] = capacity[i]
            continue
        for i in room:
            share[i] += int(part[i])
        left -= sum(int(p) for p in part.values())
        for i in sorted(room, key=lambda i: (int(part[i]) - part[i], i)):
            if left and share[i] < capacity[i]:
                share[i] += 1
                left -= 1
    return share


def budgets(tokens: Mapping[Path, int], total: int, weights: Mapping[Path, float], max_epochs: int) -> dict[Path, int]:
    """Tokens for each leaf. ``weights`` are by path from the root, among siblings; one that isn't given is 1."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("a negative weight")
    result: dict[Path, int] = {}
    usable = {leaf: max_epochs * n if all(weights.get(leaf[:k], 1.0) > 0 for k in range(1, len(leaf) + 1)) else 0 for leaf, n in tokens.items()}

    def down(prefix: Path, leaves: dict[Path, int], budget: int) -> None:
        if prefix in leaves:
            result[prefix] = budget
            return
        below: dict[Path, dict[Path, int]] = {}
        for leaf, n in leaves.items():
            below.setdefault(leaf[: len(prefix) + 1], {})[leaf] = n
        order = sorted(below)
        got = split(budget, [float(weights.get(p, 1.0)) for p in order], [sum(below[p].values()) for p in order])
        for p, b in zip(order, got, strict=True):
            down(p, below[p], b)

    if tokens:
        down((), usable, min(total, sum(usable.values())))
    return result


def domain_of(source: Column) -> Column:
    """The tables name no domains: sources fall into ``DOMAINS`` of them by crc32."""
    return F.concat(F.lit("domain"), (F.crc32(source.cast("binary")) % DOMAINS).cast("string"))


def leaf_columns() -> list[Column]:
    """Domain, language and source of a row; null counts as a value of its own."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in ("lang", "source"))
    return [domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source")]


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def order_in(epoch: Column, base: Column, seed: int) -> Column:
    """A row's place in an epoch's order."""
    return F.xxhash64(base, F.lit(seed), epoch)


def token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, base, n_tokens`` of every row; null text has no tokens."""
    vocabulary = tokenizer_path or default_path()

    def fn(batch: pa.RecordBatch) -> dict:
        _, at = tokenizer(vocabulary).encode(batch.column("text"))
        return {c: batch.column(c) for c in ("doc_id", *LEVELS, "base")} | {"n_tokens": np.diff(at)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(), row_hash().alias("base"), F.col("text").cast("string").alias("text"))
    return per_slice(rows, fn, "doc_id long, domain string, lang string, source string, base long, n_tokens long")


@dataclass
class Mix:
    """For each leaf: whole epochs, and of the next one the place in its order up to which all is taken, with
    how many tokens are taken at that place; None where no part of an epoch is."""

    leaves: dict[Path, tuple[int, int | None, int]]
    seed: int

    def placed(self, rows: DataFrame, base: Column) -> DataFrame:
        """``rows`` (with the leaf columns), ``epochs``, ``rest``, and ``ahead``: 1 before the cut, 0 at it, -1
        beyond it."""
        spark = rows.sparkSession
        plan = [(*p, *leaf) for p, leaf in self.leaves.items()]
        small = spark.createDataFrame(plan, "domain string, lang string, source string, epochs int, cut long, rest long")  # a row a leaf: at most MAX_LEAVES
        joined = rows.join(F.broadcast(small), list(LEVELS), "left").withColumn("place", order_in(F.col("epochs"), base, self.seed))
        ahead = F.when(F.col("place") < F.col("cut"), 1).when(F.col("place") == F.col("cut"), 0).otherwise(-1)
        return joined.withColumn("ahead", ahead).withColumn("epochs", F.coalesce("epochs", F.lit(0))).drop("cut")


def plan_mix(counts: DataFrame, fraction: float, weights: Mapping[Path, float] | None = None, max_epochs: int = 1, seed: int = SEED) -> Mix:
    """Plans ``fraction`` of all tokens of ``counts`` (a written table of ``token_counts``)."""
    spark = counts.sparkSession
    sums = counts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    tokens = {(r["domain"], r["lang"], r["source"]): r["tokens"] for r in sums}
    budget = budgets(tokens, int(fraction * sum(tokens.values())), weights or {}, max_epochs)
    whole = {p: (b // tokens[p] if tokens[p] else max_epochs) for p, b in budget.items()}
    rest = [(*p, whole[p], b - whole[p] * tokens[p]) for p, b in budget.items() if tokens[p] and b % tokens[p]]
    bits = max(1, (max((r["n"] for r in sums), default=1) // ROWS_IN_SLICE).bit_length())
    small = spark.createDataFrame(rest, "domain string, lang string, source string, epoch int, rest long")  # a row a leaf
    placed = counts.join(F.broadcast(small), list(LEVELS)).withColumn("place", order_in(F.col("epoch"), F.col("base"), seed))
    # slices of the order, by the place's upper bits, in signed order
    placed = placed.withColumn("slice", F.shiftright("place", 64 - bits))
    by_slice = placed.groupBy(*LEVELS, "slice", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("slice"))
    by_slice = by_slice.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    edge = by_slice.where("before <= rest and upto > rest").select(*LEVELS, "slice", "before")  # one slice a leaf
    inside = placed.join(F.broadcast(edge), [*LEVELS, "slice"]).groupBy(*LEVELS, "slice", "rest", "before", "place").agg(F.sum("n_tokens").alias("tokens"))
    within = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "slice").orderBy("place"))
    at = F.struct("place", (F.col("rest") - F.col("within") + F.col("tokens")).alias("rest"))
    cuts = inside.withColumn("within", within).where("within > rest").groupBy(*LEVELS).agg(F.min(at).alias("at")).collect()  # a row a leaf
    ends = {(r["domain"], r["lang"], r["source"]): (r["at"]["place"], r["at"]["rest"]) for r in cuts}
    return Mix({p: (whole[p], *ends.get(p, (None, 0))) for p in budget}, seed)


def mixture(docs: DataFrame, fraction: float, weights: Mapping[Path, float] | None = None, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, copies, tokens_taken`` for every row of ``docs``: how often it is
    taken whole, and how many tokens of it are taken in all.

    A leaf's ``tokens_taken`` add up to its budget: of the row in which its prefix ends only the first tokens are
    taken, so ``tokens_taken`` is ``copies * n_tokens`` for all rows but at most one a leaf. Rows of equal id and text share one
    place; of these, the first ones are taken whole. Rows without tokens are taken with the place they have. Null
    languages and sources are values of their own. An empty table gives no rows.
    """
    counts = materialize(token_counts(docs), "tokens")
    placed = plan_mix(counts, fraction, weights, max_epochs, seed).placed(counts, F.col("base"))
    out = ["doc_id", *LEVELS, "n_tokens", "epochs", "part"]
    plain = placed.where("ahead <> 0").withColumn("part", F.when(F.col("ahead") == 1, F.col("n_tokens")).otherwise(0)).withColumn("more", (F.col("ahead") == 1).cast("int"))
    # at a leaf's cut: one row, or rows alike in id and text
    before = (F.row_number().over(Window.partitionBy(*LEVELS, "place").orderBy("doc_id")) - 1) * F.col("n_tokens")
    edge = placed.where("ahead = 0").withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - before)))
    edge = edge.withColumn("more", ((F.col("part") == F.col("n_tokens")) & (F.col("n_tokens") > 0)).cast("int"))
    both = plain.select(*out, "more").unionByName(edge.select(*out, "more"))
    taken = (F.col("epochs") * F.col("n_tokens") + F.col("part")).cast("long")
    return both.select("doc_id", *LEVELS, "n_tokens", (F.col("epochs") + F.col("more")).cast("int").alias("copies"), taken.alias("tokens_taken"))


def select_mixture(docs: DataFrame, fraction: float, weights: Mapping[Path, float] | None = None, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture takes it. Rows stay whole: the one in which
    a leaf's prefix ends is kept if any of its tokens are, so a leaf goes over its budget by less than that row.
    Null languages and sources are values of their own; null text has no tokens; rows without tokens go with
    their place. An empty table stays empty."""
    mix = plan_mix(materialize(token_counts(docs), "tokens"), fraction, weights, max_epochs, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *leaf_columns(), row_hash().alias("base"))
    copies = F.col("epochs") + ((F.col("ahead") == 1) | (F.col("ahead") == 0) & (F.col("rest") > 0)).cast("int")
    taken = mix.placed(rows, F.col("base")).withColumn("copies", copies).where("copies > 0")
    if max_epochs > 1:
        taken = taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


#: Shares of the four domains in the registered query.
WEIGHTS: dict[Path, float] = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0}


def op9_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, 4:3:2:1 over domains, evenly over their languages and sources, in up to two epochs."""
    return mixture(documents(spark, sf_dir), 0.5, WEIGHTS, max_epochs=2)
