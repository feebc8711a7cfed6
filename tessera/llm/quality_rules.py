"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import least_by_hash, materialize

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
MAX_EXAMPLES = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 5e-4, 17


#: Names of the statistics, in their order.
NAMES = (
    "n_words", "word_length", "distinct_words", "distinct_root", "repeated_next", "repeated_lines", "words_per_line",
    "upper", "letters", "digits", "marks", "exclamations", "symbols", "ends",
)


def with_statistics(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of statistics (NAMES) of a whole text, all computed by built-in functions.

    An empty text has zeros. The words, the lines and then the statistics are bound to variables of higher-order
    functions, so that each is computed once a row, however often ``use`` reads it and wherever Spark moves the result.
    """

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), then)[0]

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return bound(F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")), lambda parts: bound(_statistics(parts), use))


def _statistics(parts: Column) -> Column:
    text, words, lines = parts["text"], parts["words"], parts["lines"]

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def without(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    n, n_words = F.length(text), F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(n_words, F.lit(1))), lambda a, b: a.eqNullSafe(b))
    distinct = F.size(F.array_distinct(words))
    columns = (
        n_words.cast("double"),
        share(n, n_words),
        share(distinct, n_words),
        share(distinct, F.sqrt(n_words.cast("double"))),
        share(F.size(F.filter(pairs, lambda x: x)), n_words),
        share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        share(n_words, F.size(lines)),
        share(without(r"\p{Lu}+"), n),
        share(without(r"\p{L}+"), n),
        share(without(r"\p{Nd}+"), n),
        share(without(r"[.,;:?]+"), n),
        share(without("!+"), n),
        share(without(r"[#$%&*+/<=>@\\^_`|~\[\]{}-]+"), n),
        share(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?]['\"]?\s*$"))), F.size(lines)),
    )
    return F.struct(*[c.alias(k) for k, c in zip(NAMES, columns, strict=True)])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self, of: Column | None = None) -> Column:
        """Whether the rule holds for the struct of statistics ``of``, or for columns of their names."""
        at = [(F.col(s) if of is None else of[s], op, t) for s, op, t in self.terms]
        return reduce(lambda a, b: a & b, [s <= t if op == "<=" else s > t for s, op, t in at])

    def __str__(self) -> str:
        return " and ".join(f"{s} {op} {t:.4g}" for s, op, t in self.terms)


@dataclass
class RuleEnsemble:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))."""

    bias: float
    weights: list[tuple[Rule, float]]

    def score(self, of: Column) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(r.column(of), F.lit(w)).otherwise(0.0) for r, w in self.weights], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """Every path from the root of each printed tree to one of its nodes, as a rule."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        depth = len(line) - len(line.lstrip())
        if "Tree " in line:
            path = []
        elif m := re.search(r"(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line):
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[1])], m[2], float(m[3])))]
            # Of several bounds on one statistic and side, the tightest stays.
            tight: dict[tuple[str, str], float] = {}
            for _, (s, op, t) in path:
                old = tight.get((s, op), t)
                tight[s, op] = min(old, t) if op == "<=" else max(old, t)
            rules[Rule(tuple(sorted((s, op, t) for (s, op), t in tight.items())))] = None
    return list(rules)


def fit(examples: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> RuleEnsemble:
    """Fits the ensemble on ``examples`` (columns ``names`` and ``y``), a bounded table.

    Rules are the paths of a small random forest; lasso logistic regression gives most of them weight 0. With rows of
    one label only, or none, the score is the constant (positives + 1) / (rows + 2).
    """
    import math

    n, n_pos = examples.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (n_pos + 1) / (n + 2)
    constant = RuleEnsemble(math.log(share / (1 - share)), [])
    if not 0 < n_pos < n:
        return constant
    table = VectorAssembler(inputCols=names, outputCol="features").transform(examples.select(*names, F.col("y").cast("double").alias("y"))).cache()
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, minInstancesPerNode=3).fit(table)
    rules = tree_rules(forest.toDebugString, names)
    if not rules:
        return constant
    held = table.select("y", F.array(*[r.column().cast("double") for r in rules]).alias("holds"))
    held = held.select("y", _as_vector(F.col("holds")).alias("holds")).cache()
    model = LogisticRegression(labelCol="y", featuresCol="holds", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    table.unpersist()
    held.unpersist()
    return RuleEnsemble(float(model.intercept), weights)


def _as_vector(array: Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(array)


def labelled(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """Statistics and label of a bounded sample of the labelled rows; several labels of one doc_id count as their least."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    chosen = least_by_hash(chosen, "label_id", max_examples)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(F.col("text")).alias("text"))
    # At most max_examples pairs of numbers are broadcast.
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return materialize(rows.select("doc_id", "y", with_statistics(F.col("text"), lambda s: s).alias("s")).select("doc_id", "y", "s.*"))


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> RuleEnsemble:
    """Fits the ensemble on at most ``max_examples`` labelled rows, chosen by a hash of doc_id.

    Null labels and null ids are ignored. Of several rows of one doc_id the one with the least statistics, in the
    order of NAMES, is the example. No labelled rows, or one label only, give a constant.
    """
    sample = labelled(docs, labels, max_examples)
    one = sample.groupBy("doc_id", "y").agg(F.min(F.struct(*NAMES)).alias("s")).select("doc_id", "y", "s.*")
    return fit(one.coalesce(4), list(NAMES))


def quality_scores(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text.

    Null and empty texts have all statistics 0 and so a defined score; repeated rows are scored each; other columns
    are ignored. One narrow stage of built-in functions: no Python, no shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), with_statistics(_text(F.col("text")), model.score).alias("score"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is at least ``threshold``.

    Null and empty texts have all statistics 0 and are kept or not by that score; repeated rows are judged alike; a
    null doc_id changes nothing; names of other columns cannot clash. An empty table stays empty.
    """
    return docs.where(with_statistics(_text(F.col("text")), model.score) >= threshold)
