"""RBF-kernel SVM re-aimed for a cluster.

An exact kernel SVM (SMO) is a single-machine solver. Here the RBF kernel is
approximated with random Fourier features (Rahimi & Recht, 2007):
z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2*gamma), b ~ U(0, 2*pi), gamma = 1/(d*var(X))
('scale'), and a linear SVM is trained on z with MLlib (distributed):
OneVsRest(LinearSVC(regParam = 1/(C*n))). M03 takes the arg-max class; M04 keeps
every class whose expit(margin) exceeds the threshold (the per-class binary
margins of the same one-vs-rest model)."""
from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_rows


def rff_features(df: DataFrame, vec: str, W: np.ndarray, b: np.ndarray) -> DataFrame:
    """Random Fourier features per row, computed in Arrow batches with numpy."""
    import pandas as pd
    D = W.shape[0]
    cols = [c for c in df.columns if c != vec]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vec)
    schema = (schema + ", " if schema else "") + "z array<double>"

    def run(batches):
        for p in batches:
            X = np.vstack(p[vec].to_numpy()).astype(np.float64) if len(p) else np.zeros((0, W.shape[1]))
            Z = np.sqrt(2.0 / D) * np.cos(X @ W.T + b)
            out = p[cols].copy()
            out["z"] = list(Z)
            yield out

    return df.mapInPandas(run, schema)


def fit_predict_rff_svm(train: DataFrame, test: DataFrame, vec: str = "vec", C: float = 2.0,
                        n_features: int = 256, seed: int = 0, max_iter: int = 20, t: float = 0.1) -> DataFrame:
    """Returns (id, label, pred_argmax, pred_threshold, margin)."""
    d = bounded_rows(train.select(F.size(vec).alias("d")).limit(1), 1)[0]["d"]
    stats = bounded_rows(train.select(F.explode(vec).alias("x")).agg(F.var_pop("x").alias("v")), 1)[0]
    gamma = 1.0 / (d * (stats["v"] or 1.0))
    rng = np.random.RandomState(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_features, d))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_features)
    labels = [r["label"] for r in bounded_rows(train.select("label").distinct().orderBy("label"), 100_000)]
    spark = train.sparkSession
    lid = spark.createDataFrame([(l, float(i)) for i, l in enumerate(labels)], "label string, y double")
    n = train.count()
    # persisted: every one-vs-rest model iterates over the same feature rows
    tr = (rff_features(train.select("id", F.col("label").cast("string").alias("label"), vec), vec, W, b)
          .join(F.broadcast(lid), "label")  # the checked label list
          .select(array_to_vector("z").alias("features"), "y").persist(StorageLevel.MEMORY_AND_DISK))
    te = rff_features(test.select("id", vec), vec, W, b).select("id", array_to_vector("z").alias("features"))
    svc = LinearSVC(regParam=1.0 / (C * n), maxIter=max_iter, featuresCol="features", labelCol="y",
                    standardization=False)
    model = OneVsRest(classifier=svc, featuresCol="features", labelCol="y", parallelism=4).fit(tr)
    pr = model.transform(te).select("id", vector_to_array("rawPrediction").alias("m"), "prediction")
    out = pr.select("id", F.col("prediction").cast("int").alias("best"),
                    F.posexplode("m").alias("k", "margin"))
    out = out.join(F.broadcast(lid.select("label", F.col("y").cast("int").alias("k"))), "k")
    return out.select("id", "label",
                      (F.col("k") == F.col("best")).alias("pred_argmax"),
                      ((1.0 / (1.0 + F.exp(-F.col("margin")))) > t).alias("pred_threshold"),
                      "margin")
