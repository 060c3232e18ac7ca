"""A kept index of cells: recall with few cells read, and the same from its folder."""

import numpy as np
from pyspark.sql import functions as F

from sparkfolio.operators import evaluate, vectors


def test_cells_of_clusters(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 4000)] + 0.15 * rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id bigint, embedding array<float>").withColumn("cell", F.lit("x"))
    q = df.where("vec_id % 100 = 0")
    index = vectors.CellIndex.build(df, "vec_id", "embedding", str(tmp_path / "i"))
    assert len(index.centres) == 63 and index.probes < 0.2 * len(index.centres)
    exact = vectors.exact_topk(df, q, "vec_id", "embedding", 10)
    found = vectors.CellIndex(spark, str(tmp_path / "i")).search(q, "vec_id", "embedding")
    assert evaluate.index_recall(found, exact, "vec_id").agg(F.avg("recall")).first()[0] >= 0.9
    every = index.search(q, "vec_id", "embedding", probes=63)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    one = index.search(q.where("vec_id = 100"), "vec_id", "embedding", probes=1)
    assert len({r.vec_id for r in one.collect()}) <= 10 and one.where("rank = 1").first().vec_id == 100
    empty = vectors.CellIndex.build(df.where("1 = 0"), "vec_id", "embedding", str(tmp_path / "e"))
    assert empty.search(q, "vec_id", "embedding").count() == 0
