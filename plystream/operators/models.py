"""Runs of models of ``operators.estimators``: fitted on a part of the cases of a log and scored on the others. Neural training is
out of scope."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plystream.operators import metrics, sequence, split


def held_out(df: DataFrame, case: str, train: float = 0.8, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """The rows of ``train`` of the cases, and those of the others. Both halves of one exchange of the cases."""
    ids = split.stratified(df.select(case).distinct(), case, [], train, 1 - train, seed)
    dealt = df.join(ids.select(case, (F.col("split") == "train").alias("__train")), case)
    return dealt.where("__train").drop("__train"), dealt.where("not __train").drop("__train")


def evaluated(estimator: Estimator, df: DataFrame, train: float = 0.8, seed: str = "0") -> tuple[Model, DataFrame]:
    """A fitted model and one row: how many events of the other cases were predicted, the share of right ones, and the mean natural
    logarithm of the probability that they were given, at least 1e-15."""
    case, order, event = (estimator.getOrDefault(n) for n in ("caseCol", "orderCol", "eventCol"))
    known, other = held_out(df, case, train, seed)
    model = estimator.fit(known)
    rows = model.transform(sequence.next_event(other, case, order, event))
    given = F.coalesce(F.try_element_at("probabilities", F.col("next_event").cast("string")), F.lit(0.0))
    return model, rows.agg(F.count("*").alias("n"), metrics.accuracy(F.col("prediction") == F.col("next_event")).alias("accuracy"), F.avg(F.ln(F.greatest(given, F.lit(1e-15)))).alias("log_likelihood"))


def projected(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Adds ``projection``, the first k principal components of arrays of numbers, with the signs that make the largest
    loading of each positive. The covariance is summed by Spark; the driver has a matrix as wide as the arrays."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    fit = PCA(k=k, inputCol="__v", outputCol="__p").fit(d)
    axes = fit.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    out = fit.transform(d).withColumn("__a", vector_to_array("__p"))
    return out.withColumn("projection", F.array(*[F.col("__a")[i] * F.lit(float(s)) for i, s in enumerate(signs)])).drop("__v", "__p", "__a")
