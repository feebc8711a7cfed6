"""Training of a text classifier: TF-IDF of one and two words, balanced logistic regression."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import share
from tessera.session import shared_dir


def split(rows: DataFrame, key: str, label: str, test_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by a hash of the key within each label: stratified in expectation and repeatable."""
    hit = F.pmod(F.xxhash64(F.col(key), F.col(label)), F.lit(100)) < test_percent
    return rows.where(~hit), rows.where(hit)


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary(rows: DataFrame, terms: str, features: int, least: float, most: float) -> list[str]:
    """The terms that occur most often, ties by code point, of those that stand in ``least`` to ``most`` rows."""
    ordered = rows.select(F.sort_array(terms).alias("terms")).select("terms", F.posexplode("terms").alias("at", "term"))
    new = (F.col("at") == 0) | (F.col("term") != F.get("terms", F.col("at") - 1))
    counts = ordered.select("term", F.when(new, 1).alias("new")).groupBy("term").agg(F.count("*").alias("n"), F.count("new").alias("n_rows"))
    top = counts.where(F.col("n_rows").between(least, most)).orderBy(F.desc("n"), "term").limit(features)
    return [r[0] for r in top.select("term").collect()]


def train(rows: DataFrame, text: str, label: str, features: int = 5000) -> PipelineModel:
    """Fits the pipeline; each label weighs the same.

    The rows are read once. Their words are written, the terms of both vocabularies counted from these, and then the
    rows' counts of these terms are written, from which all else is fitted.
    """
    words = [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+"), StopWordsRemover(inputCol="words", outputCol="kept", caseSensitive=True)]
    pairs = NGram(n=2, inputCol="kept", outputCol="pairs")
    rows = rows.select(F.coalesce(text, F.lit("")).alias(text), F.col(label).cast("double").alias(label))
    kept = _written(PipelineModel(words).transform(rows).select(label, "kept"))
    n = {r[0]: r[1] for r in kept.groupBy(label).count().collect()}
    if len(n) < 2:
        raise ValueError("training needs rows of two labels")
    total = sum(n.values())
    weight = F.coalesce(*[F.when(F.col(label) == k, F.lit(total / (len(n) * v))) for k, v in n.items()])
    paired = pairs.transform(kept)
    found = {c: vocabulary(paired, c, features, 2, 0.95 * total) for c in ("kept", "pairs")}
    counts = [CountVectorizerModel.from_vocabulary(v, inputCol=c, outputCol=f"n_{c}") for c, v in found.items()]
    stages = [pairs, *counts, VectorAssembler(inputCols=["n_kept", "n_pairs"], outputCol="counts")]
    vectors = _written(PipelineModel(stages).transform(kept).select(label, weight.alias("weight"), "counts"))
    idf = IDF(inputCol="counts", outputCol="features").fit(vectors)
    fitted = LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", regParam=0.01, maxIter=30).fit(idf.transform(vectors))
    return PipelineModel([*words, *stages, idf, fitted])


def scores(predicted: DataFrame, label: str) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 of label 1."""
    p, y = F.col("prediction") == 1, F.col(label) == 1
    out = predicted.agg(F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(p == y).alias("right"))
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("n", share(F.col("right"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"))
