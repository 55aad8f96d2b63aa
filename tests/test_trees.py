"""Flat trees against the ensemble's own prediction, and the choice of rounds and leaf size."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pegwatch.operators import models as L
from pegwatch.operators import trees


def table(spark, n=300, seed=2):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 3)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.3 * rnd.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(n)], "id long, u double, v double, w double, y int")


def test_flat_trees_equal_the_ensemble(spark):
    rows = table(spark)
    data = VectorAssembler(inputCols=["u", "v", "w"], outputCol="features").transform(rows).withColumn("y", F.col("y").cast("double"))
    model = GBTClassifier(labelCol="y", maxIter=6, maxDepth=3, seed=4).fit(data)
    flat = trees.FlatTrees.of(model, spark)
    got = model.transform(data).select("id", "u", "v", "w", vector_to_array("probability")[1].alias("p")).orderBy("id").toPandas()
    x = got[["u", "v", "w"]].to_numpy()
    assert trees.chance(flat.margins(x, [6])[:, 0]) == pytest.approx(got["p"].to_numpy(), abs=1e-9)
    each = flat.margins(x, range(1, 7))
    parts = np.array([[t.predict(r) * w for t, w in zip(model.trees, model.treeWeights, strict=True)] for r in data.orderBy("id").limit(5).select("features").rdd.map(lambda r: r[0]).collect()])
    assert each[:5] == pytest.approx(np.cumsum(parts, axis=1), abs=1e-9)


def test_leaf_size_and_rounds_by_validation(spark):
    rows = table(spark)
    score = trees.boosted(rows.filter("id < 200"), rows.filter("id >= 200"), ["u", "v", "w"], "y", seeds=(0, 1), leaves=(5, 90), rounds=6, every=3, depth=3)
    assert score.leaf == max(score.valid_ap, key=lambda k: (score.valid_ap[k], -k)) and set(score.valid_ap) == {5, 90}
    assert all(r in (3, 6) for r in score.rounds)
    out = score(rows, ["id", "y"]).collect()
    assert len(out) == 300 and all(0 <= r["score"] <= 1 for r in out)


def test_ids_that_training_lacks_have_their_own_place(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "symbol string")
    rows = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "symbol string")
    got = {r["symbol"]: list(r["h"]) for r in L.id_encoder(train, "symbol").transform(rows).select("symbol", vector_to_array("id_vector").alias("h")).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "zz": [0, 0, 1], None: [0, 0, 1]}
