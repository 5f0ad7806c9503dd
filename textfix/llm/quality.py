"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are fitted to labelled rows; the path to every node becomes a rule, a conjunction of
bounds on statistics. A logistic regression with a lasso penalty weighs the rules and sets most to
zero. The others are compiled to one Column expression, so all rows are scored by built-in functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import SPACE
from textfix.llm.trees import Node, boost
from textfix.session import computed_once

# Labelled rows that are fitted at most; beyond it those with the smallest hashed id.
FIT_ROWS = 20_000
KEEP_FROM = 0.7

Bound = tuple[int, bool, float]  # feature, whether it must be above the cut, cut


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text. NULL counts as empty; shares of nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words, n_lines = F.size(words), F.size(lines)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def chars_of(kind: str) -> Column:
        return share(F.length(F.regexp_replace(text, f"[^{kind}]+", "")), chars)

    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(chars, n_words),
        "lower": chars_of(r"\p{Ll}"),
        "upper": chars_of(r"\p{Lu}"),
        "digits": chars_of(r"\p{N}"),
        "ends": chars_of(".!?"),
        "exclaims": chars_of("!"),
        "bars": chars_of(r"|<>{}\[\]=_/\\"),
        "symbols": chars_of("#$%&*+@^~"),
        "words_repeat": 1 - share(F.size(F.array_distinct(words)), n_words),
        "lines_repeat": 1 - share(F.size(F.array_distinct(lines)), n_lines),
        "line_words": share(n_words, n_lines),
    }


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """Whether a row is kept from learning; a NULL id counts as an empty one."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % mod == rest


def fit_ids(
    labels: DataFrame, label: str, id_col: str, mod: int, rest: int, limit: int
) -> DataFrame:
    """(id, y): the labelled rows to learn from, the ``limit`` smallest by hashed id at most.

    Of repeated ids the largest label counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(~held_out(F.col(id_col), mod, rest))
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    return known.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def paths(tree: Node, bounds: tuple[Bound, ...] = ()) -> list[tuple[Bound, ...]]:
    """The conjunctions that lead to each node below the root."""
    found = [bounds] if bounds else []
    if tree.left is not None:
        found += paths(tree.left, (*bounds, (tree.feature, False, tree.cut)))
        found += paths(tree.right, (*bounds, (tree.feature, True, tree.cut)))
    return found


def holds(x: np.ndarray, rule: tuple[Bound, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) == above for j, above, cut in rule])


def lasso_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600
) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept is free."""
    full = np.c_[np.ones(len(x)), x]
    size = 4 * len(x) / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    now = ahead = np.zeros(full.shape[1])
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-full @ ahead))
        new = ahead - size * (full.T @ (p - y) / len(x))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - now)
        now, momentum = new, following
    return float(now[0]), now[1:]


class RuleEnsemble:
    """Weighted rules; ``score`` is the chance of label 1."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, penalty: float = 0.001):
        self.names = names
        trees = boost(x, y, rounds=20, depth=3, rate=0.3).trees
        rules = list(dict.fromkeys(rule for tree in trees for rule in paths(tree)))
        if not rules:  # no rows, one class, or nothing to split on
            chance = (y.sum() + 0.5) / (len(y) + 1)
            self.start, self.rules, self.weights = float(np.log(chance / (1 - chance))), [], []
            return
        held = np.column_stack([holds(x, rule) for rule in rules]).astype(float)
        self.start, weights = lasso_logistic(held, y, penalty)
        kept = np.flatnonzero(np.abs(weights) > 1e-6)
        self.rules, self.weights = [rules[k] for k in kept], [float(weights[k]) for k in kept]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.start)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            logit += weight * holds(x, rule)
        return 1 / (1 + np.exp(-logit))

    def column(self) -> Column:
        """The score as an expression over columns named like the statistics."""
        logit = F.lit(self.start)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            conditions = [
                F.col(self.names[j]) > cut if above else F.col(self.names[j]) <= cut
                for j, above, cut in rule
            ]
            both = conditions[0]
            for condition in conditions[1:]:
                both = both & condition
            logit = logit + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
    text: str = "text", mod: int = 4, rest: int = 2, limit: int = FIT_ROWS,
) -> RuleEnsemble:
    """Learn from at most ``limit`` labelled rows of ``docs``; only their statistics travel."""
    chosen = F.broadcast(fit_ids(labels.select(id_col, label), label, id_col, mod, rest, limit))
    rows = docs.select(id_col, text).join(chosen, id_col).dropDuplicates([id_col])
    stats = statistics(F.col(text))
    # In a fixed order, as sums of floats depend on it.
    found = rows.select(id_col, "y", *[c.alias(n) for n, c in stats.items()]).orderBy(id_col).toArrow()
    x = np.column_stack([found.column(n).to_numpy().astype(float) for n in stats])
    return RuleEnsemble(list(stats), x, found.column("y").to_numpy().astype(float))


def with_score(df: DataFrame, model: RuleEnsemble, text: str, name: str) -> DataFrame:
    """Add the score; the statistics are struct fields while it is computed, so no name clashes."""
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col(text)).items()])
    held = df.select(F.struct(*df.columns).alias("_row"), stats.alias("_stats"))
    flat = held.select("_row", "_stats.*").select("_row", model.column().alias("_score"))
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c != name]
    return flat.select(*kept, F.col("_score").alias(name))


def score(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
    text: str = "text", mod: int = 4, rest: int = 2, least: float = KEEP_FROM,
) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``.

    Every whole text is scored, NULL as empty. Learning reads only rows whose crc32 of the id is not
    ``rest`` modulo ``mod``; only the text is an input. Without usable labels the score is a constant.
    """
    model = fit(docs, labels, label, id_col, text, mod, rest)
    out = with_score(docs.select(id_col, text), model, text, "score")
    return out.select(
        id_col,
        held_out(F.col(id_col), mod, rest).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
    least: float = KEEP_FROM,
) -> DataFrame:
    """The rows of ``docs`` that reach ``least``; nothing is shuffled."""
    model = fit(docs, labels, "quality", id_col, text)
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col(text)).items()])
    held = docs.select(F.struct(*docs.columns).alias("_row"), stats.alias("_found"))
    # Else the filter would move down and repeat every statistic in each of its rules.
    flat = computed_once(held, "_stats", F.col("_found")).select("_row", "_stats.*")
    return flat.where(model.column() >= least).select("_row.*")
