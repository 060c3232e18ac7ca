"""Exact and approximate nearest neighbours over tables of vectors.

Queries are taken in blocks: a block of query vectors, of bounded size, goes to all tasks, each multiplies it with its rows as one
matrix product and keeps its own best k per query, and only those meet in a shuffle. The indexes (inverted cells, product codes, 8-bit
codes) are fitted on a bounded sample and hold every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.functions.vector import norm


#: Query vectors that go to all tasks at once, and rows that an index is fitted on.
QUERY_BLOCK, SAMPLE = 2_048, 20_000
SEED = 11


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (keys, matrix) of the query vectors; the driver holds one at a time."""
    keys, rows = [], []
    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        keys.append(r[0])
        rows.append(r[1])
        if len(keys) == QUERY_BLOCK:
            yield np.array(keys), np.array(rows, float)
            keys, rows = [], []
    if keys:
        yield np.array(keys), np.array(rows, float)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) indexes of the k best rows of each query, ties by id; scores rounded to six places."""
    scores = np.round(scores, 6)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), order.shape[1]), order.reshape(-1)


def _global_top(df: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


_SCORES = {"dot": lambda q, x: q @ x.T, "cosine": lambda q, x: (q @ x.T) / ((np.linalg.norm(q, axis=1)[:, None] + 1e-12) * (np.linalg.norm(x, axis=1) + 1e-12)), "l2": lambda q, x: -np.maximum(((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * (q @ x.T)), 0)}


def exact_topk(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "dot") -> DataFrame:
    """Rows (query_id, rank, key, score): the k nearest rows of each query by dot product, cosine or negative squared distance.

    Rows without a vector are left out. Scores are rounded to six places, ties go to the smaller key.
    """
    score = _SCORES[metric]
    kind = base.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema[key].dataType), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    out = base.sparkSession.createDataFrame([], schema)
    for names, q in query_blocks(queries, key, vector):
        sent = base.sparkSession.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def merge() -> None:
                qi, ids, s = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((ids, -s, qi))
                qi, ids, s = qi[order], ids[order], s[order]
                nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
                held[:] = [(qi[nth < k], ids[nth < k], s[nth < k])]

            for b in batches:
                x, ids = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                s = score(q, x)
                qi, xi = _best(s, ids, k)
                held.append((qi, ids[xi], np.round(s[qi, xi], 6)))
                if len(held) > 4:
                    merge()
            if held:
                merge()
                qi, ids, s = held[0]
                yield pa.RecordBatch.from_arrays([pa.array(names[qi]), pa.array(ids), pa.array(s)], names=schema.names)

        part = base.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)
        out = out.unionByName(part)
    return _global_top(out, key, k)


def _sample(base: DataFrame, vector: str, n: int = SAMPLE) -> np.ndarray:
    """At most n vectors, spread over the table by a hash of the vector, the same in every run."""
    h = base.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(n)
    return np.array([r[0] for r in h.collect()], float)


def kmeans(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Centres of k clusters by Lloyd's turns from a seeded choice of rows; an empty cluster takes the row farthest from its centre."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(turns):
        d = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        for j in range(len(c)):
            mine = near == j
            c[j] = x[mine].mean(0) if mine.any() else x[d.min(1).argmax()]
    return c


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float, most: int = 400) -> int:
    """Cells to look into so that the k nearest are found with `recall`, measured on the sample that the centres are from.

    Of up to `most` rows of it, the true neighbours are looked up, and how far down the list of nearest cells their cells stand.
    """
    q = x[:: max(1, len(x) // most)]
    order = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    near = np.argsort(-(q @ x.T), axis=1)[:, : k + 1]
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1


def ivf_topk(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, cells: int = 32, probes: int | None = None, recall: float = 0.95) -> DataFrame:
    """Rows (query_id, rank, key, score) from an index of inverted cells.

    Every row is in the cell of its nearest centre, and a query looks into its `probes` nearest cells; without that number, into as many as
    probes_for() finds to be needed for `recall`. Vectors without clusters need many. Rows and queries meet by a join on
    the cell, which the adaptive join splits where a cell is hot.
    """
    x = _sample(base, vector)
    schema = T.StructType([T.StructField("query_id", queries.schema[key].dataType), T.StructField(key, base.schema[key].dataType), T.StructField("score", T.DoubleType())])
    if not len(x):
        return _global_top(base.sparkSession.createDataFrame([], schema), key, k)
    centres = kmeans(x, cells)
    probes = probes or probes_for(x, centres, k, recall)

    def near(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    m = _matrix(b.column(1))
                    d = (centres**2).sum(1) - 2 * m @ centres.T
                    best = np.argsort(d, axis=1)[:, :n].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=[key, vector, "cells"])

        return run

    shape = T.StructType([base.schema[key], T.StructField(vector, T.ArrayType(T.FloatType())), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    rows = base.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias(vector))
    asked = queries.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias(vector))
    a = asked.mapInArrow(near(probes), shape).select(F.col(key).alias("query_id"), F.col(vector).alias("q"), F.explode("cells").alias("cell"))
    b = rows.mapInArrow(near(1), shape).select(key, vector, F.col("cells")[0].alias("cell"))
    from sparkfolio.functions.vector import dot

    return _global_top(a.join(b, "cell").select("query_id", key, F.round(dot("q", vector), 6).alias("score")), key, k)


class CellIndex:
    """Inverted cells kept in a folder, one folder of vectors for each cell; a search reads the folders that its queries look into.

    There are about as many cells as the root of the number of rows, CELLS at most, as the centres are fitted on a bounded sample. Queries go in blocks to the
    tasks, each multiplies a cell's rows with the queries that look into it and keeps its own best k of each query, so that queries times k rows of a
    task are shuffled, however many rows are looked at. A cell that holds most rows is many files.
    """

    CELLS = 1_024

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # CELLS at most
        self.centres = np.array([r.centre for r in rows], float)
        self.key, self.kind, self.probes = (rows[0].key, rows[0].kind, rows[0].probes) if rows else (None, None, 0)

    @classmethod
    def build(cls, base: DataFrame, key: str, vector: str, folder: str, cells: int | None = None, k: int = 10, recall: float = 0.95) -> CellIndex:
        """Index all rows that have a vector. `recall`: what is aimed at for the k nearest; the number of cells to look into is measured on the sample."""
        spark = base.sparkSession
        there = base.where(F.col(vector).isNotNull())
        x = _sample(base, vector)
        want = cells or max(1, min(cls.CELLS, int(there.count() ** 0.5)))
        centres = kmeans(x, want) if len(x) else np.empty((0, 0))
        probes = probes_for(x, centres, k, recall) if len(x) else 0
        kind = base.schema[key].dataType.simpleString()
        rows = [(i, c.tolist(), key, kind, probes) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>, key string, kind string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    m = _matrix(b.column(1))
                    near = ((centres**2).sum(1) - 2 * m @ centres.T).argmin(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], names=[key, "vector", "cell"])

        shape = T.StructType([base.schema[key], T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType())])
        placed = there.select(key, F.col(vector).cast("array<float>").alias("vector")).mapInArrow(place, shape)
        placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
        return cls(spark, folder)

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
        """Rows (query_id, rank, key, score) of the k nearest by dot product in the `probes` nearest cells of each query."""
        schema = T.StructType.fromDDL(f"query_id {queries.schema[key].dataType.simpleString()}, `{self.key or key}` {self.kind or 'bigint'}, score double")
        out = self.spark.createDataFrame([], schema)
        if not len(self.centres):
            return _global_top(out, self.key or key, k)
        table = self.spark.read.schema(f"`{self.key}` {self.kind}, vector array<float>, cell int").parquet(f"{self.folder}/vectors")
        for names, q in query_blocks(queries, key, vector):
            near = np.argsort((self.centres**2).sum(1) - 2 * q @ self.centres.T, axis=1)[:, : probes or self.probes]
            out = out.unionByName(table.where(F.col("cell").isin(*map(int, np.unique(near)))).mapInArrow(self._nearest(names, q, near, k, schema), schema))
        return _global_top(out, self.key, k)

    def _nearest(self, names: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, schema: T.StructType):
        sent = self.spark.sparkContext.broadcast((names, q, near))  # a block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, near = sent.value
            held: list[tuple[np.ndarray, ...]] = []

            def merge() -> None:
                qi, ids, s = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((ids, -s, qi))
                qi, ids, s = qi[order], ids[order], s[order]
                nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
                held[:] = [(qi[nth < k], ids[nth < k], s[nth < k])]

            for b in batches:
                x, ids, cell = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
                for c in np.unique(cell):
                    asked, mine = np.flatnonzero((near == c).any(axis=1)), np.flatnonzero(cell == c)
                    if len(asked):
                        s = q[asked] @ x[mine].T
                        qi, xi = _best(s, ids[mine], k)
                        held.append((asked[qi], ids[mine][xi], np.round(s[qi, xi], 6)))
                        if len(held) > 16:
                            merge()
            if held:
                merge()
                qi, ids, s = held[0]
                yield pa.RecordBatch.from_arrays([pa.array(names[qi]), pa.array(ids), pa.array(s)], names=schema.names)

        return run


def pq_fit(base: DataFrame, vector: str, parts: int = 16, codes: int = 128) -> np.ndarray:
    """Codebooks (parts x codes x width) of product quantisation, fitted on a bounded sample."""
    x = _sample(base, vector)
    w = x.shape[1] // parts
    return np.stack([kmeans(x[:, i * w : (i + 1) * w], codes) for i in range(parts)])


def pq_encode(base: DataFrame, key: str, vector: str, books: np.ndarray) -> DataFrame:
    """Rows (key, code): one byte per part, for every row."""
    schema = T.StructType([base.schema[key], T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = books.shape[2]
        for b in batches:
            if len(b):
                m = _matrix(b.column(1))
                code = np.stack([((c**2).sum(1) - 2 * m[:, i * w : (i + 1) * w] @ c.T).argmin(1) for i, c in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in code], pa.binary())], names=schema.names)

    return base.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


def pq_topk(encoded: DataFrame, queries: DataFrame, books: np.ndarray, key: str, vector: str, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, key, score) by asymmetric distance: queries as they are against codes, through a table per query."""
    schema = T.StructType([T.StructField("query_id", queries.schema[key].dataType), encoded.schema[key], T.StructField("score", T.DoubleType())])
    out = encoded.sparkSession.createDataFrame([], schema)
    w = books.shape[2]
    for names, q in query_blocks(queries, key, vector):
        tables = np.stack([q[:, i * w : (i + 1) * w] @ c.T for i, c in enumerate(books)], axis=1)  # query x part x code
        sent = encoded.sparkSession.sparkContext.broadcast((names, tables))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, tables = sent.value
            for b in batches:
                if not len(b):
                    continue
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1)
                s = sum(tables[:, i, code[:, i]] for i in range(code.shape[1]))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                qi, xi = _best(s, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(names[qi]), pa.array(ids[xi]), pa.array(np.round(s[qi, xi], 6))], names=schema.names)

        out = out.unionByName(encoded.mapInArrow(run, schema))
    return _global_top(out, key, k)


def int8_ranges(base: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """One row (lo, hi): the least and the greatest value of each dimension."""
    at = [F.element_at(vector, i + 1).cast("double") for i in range(dimensions)]
    return base.agg(F.array(*[F.min(a) for a in at]).alias("lo"), F.array(*[F.max(a) for a in at]).alias("hi"))


def int8_quantise(base: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """`base` with `code` (0 to 255 per dimension, evenly over its range) and `restored` (the vector the code stands for)."""
    scaled = F.zip_with(F.arrays_zip("lo", "hi"), F.col(vector), lambda r, v: F.when(r["hi"] == r["lo"], 0.0).otherwise((v.cast("double") - r["lo"]) / (r["hi"] - r["lo"]) * 255))
    coded = base.crossJoin(F.broadcast(int8_ranges(base, vector, dimensions))).withColumn("code", F.transform(scaled, lambda v: F.floor(v + 0.5).cast("int")))
    back = F.zip_with(F.arrays_zip("lo", "hi"), "code", lambda r, c: r["lo"] + c / 255.0 * (r["hi"] - r["lo"]))
    return coded.withColumn("restored", back).drop("lo", "hi")


def maxsim_topk(tokens: DataFrame, queries: DataFrame, document: str, vector: str, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, document, score): late interaction, the sum over a query's token vectors of their best cosine in the document.

    `tokens` and `queries` have rows (document, vector). A document's token vectors come together in one task; they are as many as
    it has tokens.
    """
    grouped = tokens.where(F.col(vector).isNotNull()).groupBy(document).agg(F.collect_list(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(document, vector).orderBy(document)
    names, rows = [], []
    schema = T.StructType([T.StructField("query_id", queries.schema[document].dataType), tokens.schema[document], T.StructField("score", T.DoubleType())])
    out = tokens.sparkSession.createDataFrame([], schema)

    def part(names: list, rows: list) -> DataFrame:
        q = np.array(rows, float)
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)
        ids, first = np.unique(np.array(names), return_index=True)
        sent = tokens.sparkSession.sparkContext.broadcast((ids, first, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, first, q = sent.value
            for b in batches:
                if not len(b):
                    continue
                docs = b.column(0).to_numpy(zero_copy_only=False)
                s = np.empty((len(ids), len(docs)))
                for j, v in enumerate(b.column(1).to_pylist()):
                    x = np.array(v, float)
                    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
                    s[:, j] = np.add.reduceat((q @ x.T).max(1), first)
                qi, xi = _best(s, docs, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(docs[xi]), pa.array(np.round(s[qi, xi], 6))], names=schema.names)

        return grouped.mapInArrow(run, schema)

    for r in asked.toLocalIterator():
        if len(names) >= QUERY_BLOCK and r[0] != names[-1]:
            out = out.unionByName(part(names, rows))
            names, rows = [], []
        names.append(r[0])
        rows.append(r[1])
    if names:
        out = out.unionByName(part(names, rows))
    return _global_top(out, document, k)


def save_books(spark, books: np.ndarray, folder: str) -> None:
    """Keep the codebooks of an index as a table (part, code, centre)."""
    rows = [(i, j, [float(v) for v in c]) for i, b in enumerate(books) for j, c in enumerate(b)]
    spark.createDataFrame(rows, "part int, code int, centre array<double>").write.mode("overwrite").parquet(folder)


def load_books(spark, folder: str) -> np.ndarray:
    rows = spark.read.parquet(folder).orderBy("part", "code").collect()
    parts = 1 + max(r.part for r in rows)
    return np.array([r.centre for r in rows]).reshape(parts, len(rows) // parts, -1)


def synthetic_vectors(spark, n: int, dimensions: int = 384, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Rows (vec_id, embedding) of n random unit vectors for measurements, the same for a seed and a number of parts."""
    raw = spark.range(0, n, 1, parts).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed * dimensions + i) for i in range(dimensions)]).alias("x"))
    return raw.select("vec_id", F.transform("x", lambda v: (v / norm("x")).cast("float")).alias("embedding"))


def hashing_embedder(text, dimensions: int = 64):
    """The offline default for a model: signed hashing of tokens, normalised. A Column of array<double>."""
    from sparkfolio.functions.text import tokenize

    h = F.transform(tokenize(text), lambda t: F.xxhash64(t))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(dimensions)) == i), F.lit(0.0), lambda a, x: a + F.when(F.shiftright(x, 40).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)),
    )
    n = norm(raw)
    return F.when(n == 0, raw).otherwise(F.transform(raw, lambda v: v / n))


def embed(df: DataFrame, key: str, text: str, model=None, dimensions: int = 64) -> DataFrame:
    """Rows (key, vector). `model()` is called once per task and gives a function from texts to vectors; without it, hashing_embedder()."""
    if model is None:
        return df.select(key, hashing_embedder(text, dimensions).alias("vector"))
    schema = T.StructType([df.schema[key], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model()
        for b in batches:
            v = np.asarray(encode([t or "" for t in b.column(1).to_pylist()]), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


