"""A probe on feature vectors: logistic regression or one hidden layer, chosen by a grid."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(rows: DataFrame, share: float = 0.8, key: str = "vec_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of the key."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000))
    return rows.where(h < int(share * 1000)), rows.where(h >= int(share * 1000))


def _ratio(train: DataFrame) -> float:
    """Negatives for each positive."""
    return float(train.agg((F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("r")).first()["r"] or 0.0)


def _accuracy(model, held: DataFrame) -> float:
    return float(model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0)


def fit(train: DataFrame, decay: float = 0.0, alpha: float = 1.0, rounds: int = 50):
    """Logistic regression on ``features, label``; positives weigh ``alpha`` times the ratio of negatives."""
    weighted = train.withColumn("w", F.when(F.col("label") == 1, float(alpha * _ratio(train))).otherwise(1.0))
    return LogisticRegression(maxIter=rounds, regParam=decay, weightCol="w", tol=1e-4).fit(weighted)


def fit_hidden(train: DataFrame, held: DataFrame, hidden: int, alpha: float = 1.0, rounds: int = 50, step: int = 25, patience: int = 1, least: float = 0.001, seed: int = 0):
    """Network with one hidden layer, and its accuracy on ``held``.

    It is trained ``step`` rounds at a time from where it stands, and training
    stops after ``patience`` steps that do not better the accuracy by
    ``least``; the best state counts.  Spark's network takes no weights, so
    positives are repeated as often as they should weigh, rounded; nor does it
    take a weight decay.
    """
    width = len(train.first()["features"])
    copies = F.when(F.col("label") == 1, max(1, round(alpha * _ratio(train)))).otherwise(1)
    weighted = train.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    best, accuracy, weights, waited = None, -1.0, None, 0
    for _ in range(max(1, rounds // step)):
        trainer = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=step, seed=seed)
        model = (trainer if weights is None else trainer.setInitialWeights(weights)).fit(weighted)
        weights, now = model.weights, _accuracy(model, held)
        if now > accuracy + least:
            best, accuracy, waited = model, now, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, accuracy


def grid_search(
    rows: DataFrame, hidden: tuple[int, ...] = (0, 8), decay: tuple[float, ...] = (0.0, 0.01), alpha: tuple[float, ...] = (0.5, 1.0), key: str = "vec_id",
) -> DataFrame:
    """Validation accuracy per setting, the best first; ties go to the smaller hidden layer.

    ``rows``: ``vec_id, embedding array<float>, label``.  A setting with a
    hidden layer has no decay (null).
    """
    spark = rows.sparkSession
    data = rows.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label")).cache()
    train, held = split(data, key=key)
    out = []
    for a in alpha:
        for h in hidden:
            out += [(h, a, None, fit_hidden(train, held, h, a)[1])] if h else [(0, a, w, _accuracy(fit(train, w, a), held)) for w in decay]
    data.unpersist()
    # one row per setting
    return spark.createDataFrame(out, "hidden int, alpha double, decay double, accuracy double").orderBy(F.desc("accuracy"), "hidden", "alpha", "decay")
