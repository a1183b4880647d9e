"""Operator 9: quality classifier as a sparse rule ensemble.

Shallow boosted trees over text statistics give paths; each path is a
conjunctive rule; a lasso logistic regression keeps the few rules that matter;
what is left is one Spark column expression, so scoring is a single scan without
a shuffle or Python. The expression is a lambda over the statistics of a row, which
are computed once whatever the number of rules, and generated code stays small.

Labels are learned from at most ``SAMPLE`` labelled rows, those whose doc_id has
the least hash among the rows that are not held out (crc32 of the doc_id as text
modulo 5 is 0: held out). Only statistics of these rows come to the driver. The
statistics are of whole texts; labels, lang, source and doc_id are no inputs.

Defined results: a null text counts as empty and an empty one is scored by its
zero statistics; without any labelled row every score is 0.5, with one class
only it is that class's smoothed share; a doc_id with several labels counts with
the least one; rows without a label are scored like others; a null doc_id counts
as '' where it is hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import documents

#: Bound of the labelled rows used, trees, their depth, and the lasso penalty.
SAMPLE, TREES, DEPTH, PENALTY = 20_000, 12, 3, 1e-3
BINS, SHRINK, LEAST_LEAF, STEPS = 32, 0.3, 10, 400
#: Documents with a score of this or more pass.
PASS = 0.3

FEATURES = ("n_chars", "n_words", "word_length", "distinct_words", "repeated_words", "upper", "digits", "symbols", "n_lines", "distinct_lines")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (all columns of docs as a struct) and stats (a double for each of FEATURES)."""
    space = r"[\x20\x09-\x0D]+"
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = held.select("doc", "text", F.array_remove(F.split("text", space), "").alias("words"), F.split("text", "\n").alias("lines"))
    chars, words, lines = F.length("text"), F.size("words"), F.size("lines")
    share = lambda x, of: x.cast("double") / F.greatest(of, F.lit(1))
    without = lambda pattern: share(chars - F.length(F.regexp_replace("text", pattern, "")), chars)
    n = F.greatest(words - 1, F.lit(0))
    same = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: a == b)
    made = (
        chars.cast("double"),
        words.cast("double"),
        share(chars, words),
        share(F.size(F.array_distinct("words")), words),
        share(F.size(F.filter(same, lambda x: x)), words),
        without(r"\p{Lu}"),
        without("[0-9]"),
        without(r"""[^\p{L}\p{N}\s.,;:'"?()-]"""),
        lines.cast("double"),
        share(F.size(F.array_distinct("lines")), lines),
    )
    return held.select("doc", F.struct(*[x.alias(name) for name, x in zip(FEATURES, made, strict=True)]).alias("stats"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each feature index an interval low < x <= high."""

    limits: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, high in self.limits:
            out &= (x[:, f] > low) & (x[:, f] <= high)
        return out

    def column(self, stats: Column) -> Column:
        parts = []
        for f, low, high in self.limits:
            c = stats[FEATURES[f]]
            parts += [c > float(low)] * (low > -np.inf) + [c <= float(high)] * (high < np.inf)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def _split(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[float, int, float] | None:
    """The best (gain, feature, cut) by second-order gain."""
    best, total = None, g.sum() ** 2 / (h.sum() + 1)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        bin_of = np.searchsorted(edges, x[:, f])
        count, gs, hs = (np.cumsum(np.bincount(bin_of, w, len(edges) + 1))[:-1] for w in (np.ones(len(g)), g, h))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - total
        gain[(count < LEAST_LEAF) | (len(g) - count < LEAST_LEAF)] = -1
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float(edges[k]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of all nodes of boosted trees."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    margin, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        todo = [(np.arange(len(y)), {}, 0)]
        while todo:
            rows, path, depth = todo.pop()
            best = _split(x[rows], cuts, g[rows], h[rows]) if depth < DEPTH else None
            if best is None:
                margin[rows] += SHRINK * g[rows].sum() / (h[rows].sum() + 1)
                continue
            _, f, cut = best
            low, high = path.get(f, (-np.inf, np.inf))
            below = x[rows, f] <= cut
            for side, limits in ((below, (low, min(high, cut))), (~below, (max(low, cut), high))):
                own = path | {f: limits}
                found[Rule(tuple((k, *own[k]) for k in sorted(own)))] = None
                todo.append((rows[side], own, depth + 1))
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of an l1-penalised logistic regression (accelerated
    proximal gradient)."""
    n = len(y)
    a = np.column_stack([np.ones(n), r])
    step = 4 * n / np.linalg.norm(a, 2) ** 2
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(STEPS):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if len(np.unique(y)) < 2:
            share = (y.sum() + 1) / (len(y) + 2)
            return cls(float(np.log(share / (1 - share))), ())
        rules = tree_rules(x, y)
        if not rules:
            return cls(float(np.log(y.mean() / (1 - y.mean()))), ())
        b, w = lasso(np.column_stack([r.holds(x) for r in rules]).astype(float), y)
        return cls(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4))

    def column(self, stats: Column) -> Column:
        """The score of a struct of statistics."""

        def score(x: Column) -> Column:
            z = F.lit(self.intercept)
            for rule, weight in self.rules:
                z = z + F.when(rule.column(x), F.lit(weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

        return F.transform(F.array(stats), score)[0]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> RuleEnsemble:
    """Fits on the bounded sample of labels that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(doc_id))
    sample = known.groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    found = statistics(rows).groupBy("doc.id", "doc.label").agg(F.min("stats").alias("stats"))
    held = found.select("id", "label", "stats.*").collect()  # one row a sampled label
    held.sort(key=lambda r: r["id"])
    x = np.array([r[2:] for r in held], float).reshape(len(held), len(FEATURES))
    return RuleEnsemble.fit(x, np.array([r[1] for r in held], float))


def scored(docs: DataFrame, model: RuleEnsemble, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score column."""
    found = statistics(docs, text).select("doc", model.column(F.col("stats")).alias("score"))
    return found.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != score], F.col("score").alias(score))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that pass; all columns stay (pipeline stage)."""
    model = train(docs, labels)
    # The row number keeps the filter above the statistics, where they are computed once.
    found = statistics(docs).withColumn("row", F.monotonically_increasing_id())
    return found.where((F.col("row") >= 0) & (model.column(F.col("stats")) >= PASS)).select("doc.*")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
