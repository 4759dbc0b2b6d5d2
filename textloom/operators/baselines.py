"""Classical baselines of pyspark.ml on feature sets: trees, forests, logistic regression, linear SVM."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("decision_tree", "logistic_regression", "linear_svm", "random_forest")


def vectors(rows: DataFrame, n_features: int) -> DataFrame:
    """rows (features array<int>) -> with `x`, a sparse 0/1 vector."""
    names = [str(i) for i in range(n_features)]
    model = CountVectorizerModel.from_vocabulary(names, inputCol="words_", outputCol="x").setBinary(True)
    return model.transform(rows.withColumn("words_", F.transform("features", lambda i: i.cast("string")))).drop("words_")


def estimator(kind: str, n_rows: int, seed: int = 0):
    """L2 strength 1 is regParam 1 / n; trees have the depth that Spark allows."""
    if kind == "decision_tree":
        return DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=15, seed=seed)
    if kind == "logistic_regression":
        return LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1 / max(1, n_rows), elasticNetParam=0.0, standardization=False, maxIter=100)
    if kind == "linear_svm":
        return OneVsRest(classifier=LinearSVC(regParam=1 / max(1, n_rows), standardization=False, maxIter=50), featuresCol="x", labelCol="y")
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=30, maxDepth=12, seed=seed)
    raise ValueError(f"unknown baseline {kind!r}; one of {KINDS}")


def fit_predict(train: DataFrame, test: DataFrame, n_features: int, kind: str, seed: int = 0) -> DataFrame:
    """train, test (doc_id, label, features) -> doc_id, label, pred."""
    labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    names = F.array(*map(F.lit, labels))
    xs = vectors(train.withColumn("y", (F.array_position(names, F.col("label")) - 1).cast("double")), n_features)
    if len(labels) == 1:
        return test.select("doc_id", "label", F.lit(labels[0]).alias("pred"))
    model = estimator(kind, train.count(), seed).fit(xs.select("x", "y"))
    out = model.transform(vectors(test.select("doc_id", "label", "features"), n_features))
    return out.select("doc_id", "label", F.get(names, F.col("prediction").cast("int")).alias("pred"))
