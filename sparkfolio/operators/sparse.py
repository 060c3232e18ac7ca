"""Inverted index, TF-IDF and BM25 for batches of queries.

Without an index the documents of a batch are tokenised once; only tokens that some query asks for leave the scan, so what is shuffled grows with
the hits, not with the corpus. A kept Index holds the postings by term, and a batch reads those of its own terms only. Statistics (documents, mean
length, document frequency, mean idf) are over all documents, empty ones included.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import TOKEN, tokenize
from sparkfolio.session import cut

K1, B = 1.5, 0.75
#: Up to so many distinct query terms are held against the tokens inside the scan; more of them are joined.
TERMS_INLINE = 2_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (term, key, tf, positions): the inverted index, positions counted in tokens from 0. Null texts have no postings."""
    t = docs.select(key, F.posexplode(tokenize(text)).alias("pos", "term"))
    return t.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (term, df): in how many documents each term is."""
    return docs.select(key, F.explode(F.array_distinct(tokenize(text))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))


def boolean_and(docs: DataFrame, key: str, text: str, *terms: str) -> DataFrame:
    """Keys of the documents that hold all terms; of each argument the first token counts, one without a token none; no terms: none."""
    words = first_tokens(terms)
    if not words:
        return docs.select(key).limit(0)
    have = tokenize(text)
    return docs.where(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(have, w))).select(key).distinct()


def first_tokens(terms) -> list[str]:
    """The first token of each term, once and in order; terms without one are left out."""
    return sorted({m[0] for t in terms if (m := re.search(TOKEN, t.lower()))})


def query_terms(queries: DataFrame) -> DataFrame:
    """Rows (query_id, term, qtf) of queries (query_id, query); a term asked twice counts twice."""
    return queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def matches(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """Rows (query_id, key, term, qtf, tf, dl, n, avgdl, df) of all documents that share a term with a query."""
    asked = query_terms(queries)
    terms = [r.term for r in asked.select("term").distinct().limit(TERMS_INLINE + 1).collect()]
    tokens = tokenize(text)
    base = docs.select(F.col(key), F.coalesce(F.size(tokens), F.lit(0)).alias("dl"), tokens.alias("tokens"))
    if len(terms) <= TERMS_INLINE:  # longer batches of queries keep all tokens and meet them in the join below
        base = base.withColumn("tokens", F.filter("tokens", lambda t: t.isin(*terms) if terms else F.lit(False)))
    base = cut(base)
    stats = base.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    tf = base.select(key, "dl", F.explode("tokens").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(asked, "term").join(df, "term").crossJoin(F.broadcast(stats))


def top_k(scored: DataFrame, key: str, k: int, places: int = 6) -> DataFrame:
    """Rows (query_id, rank, key, score): the k best per query, ties by key; scores are rounded before they are ranked."""
    s = scored.withColumn("score", F.round("score", places))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def bm25_idf(variant: str = "plus"):
    """idf = ln(1 + (N - df + 0.5) / (df + 0.5)); variant "okapi" is ln((N - df + 0.5) / (df + 0.5)), negative for common terms."""
    odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    return F.log(1 + odds) if variant == "plus" else F.log(odds)


def bm25_of(found: DataFrame, key: str, k: int = 10, k1: float = K1, b: float = B, idf: str = "plus", mean: DataFrame | None = None) -> DataFrame:
    """bm25() of what matches() found; `mean`: one row with mean_idf, for the variant "okapi"."""
    w = bm25_idf(idf)
    if idf == "okapi":
        found = found.crossJoin(F.broadcast(mean))  # one row
        w = F.when(w < 0, 0.25 * F.col("mean_idf")).otherwise(w)
    length = 1 - b + b * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * w * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return top_k(found.groupBy("query_id", key).agg(F.sum(part).alias("score")), key, k)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, idf: str = "plus") -> DataFrame:
    """Rows (query_id, rank, key, score) of the k best documents of each query by BM25.

    Only documents that share a term with the query are ranked. idf "okapi": a negative idf is replaced by a quarter of the mean idf of all
    terms of the documents, as the common library does; that takes a second pass, over the whole vocabulary.
    """
    mean = None
    if idf == "okapi":
        n = docs.agg(F.count("*").alias("n"))
        mean = document_frequency(docs, key, text).crossJoin(F.broadcast(n)).agg(F.avg(bm25_idf(idf)).alias("mean_idf"))  # n is one row
    return bm25_of(matches(docs, key, text, queries), key, k, k1, b, idf, mean)


def tfidf_of(found: DataFrame, key: str, k: int = 10) -> DataFrame:
    """tfidf() of what matches() found."""
    part = F.col("qtf") * (1 + F.log("tf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return top_k(found.groupBy("query_id", key).agg(F.sum(part).alias("score")), key, k)


def tfidf(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, key, score) by the sum of (1 + ln tf) (ln((N + 1) / (df + 1)) + 1)."""
    return tfidf_of(matches(docs, key, text, queries), key, k)


class Index:
    """An inverted index kept in a folder: postings and document frequencies in buckets of terms, and the statistics of the collection.

    It is built once and searched by any number of batches; a batch reads the buckets of its terms, and within them the row groups that may hold
    them, as rows are sorted by term. Nothing of a bucket is gathered: a term of very many documents is many rows.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        self.stats = spark.read.parquet(f"{folder}/stats")
        first = self.stats.first()
        self.key, self.buckets = first.key, first.buckets
        self.shapes = {"postings": f"term string, `{first.key}` {first.kind}, tf bigint, dl int, bucket int", "terms": "term string, df bigint, bucket int"}

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, folder: str, buckets: int = 64) -> Index:
        """Index the texts of `docs` by `key`; rows with the same key are one document. Null and empty texts are documents without terms."""
        spark = docs.sparkSession
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        tokens = tokenize(text)
        base = docs.select(F.col(key), F.coalesce(F.size(tokens), F.lit(0)).alias("dl"), tokens.alias("tokens"))
        tf = base.select(key, "dl", F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.max("dl").alias("dl")).withColumn("bucket", bucket)
        # spread by term and key, so a term that most documents hold is in many tasks; sorted, so a file's row groups tell terms apart
        tf.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        kind = docs.schema[key].dataType.simpleString()
        tf = spark.read.schema(tf.schema).parquet(f"{folder}/postings")
        df = tf.groupBy("bucket", "term").agg(F.count("*").alias("df"))
        df.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
        df = spark.read.schema(df.schema).parquet(f"{folder}/terms")
        one = base.groupBy(key).agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
        mean = df.crossJoin(F.broadcast(one)).agg(F.avg(bm25_idf("okapi")).alias("mean_idf"))  # one row
        one.crossJoin(mean).select("*", F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        return cls(spark, folder)

    def _read(self, name: str, terms: list[str] | None) -> DataFrame:
        t = self.spark.read.schema(self.shapes[name]).parquet(f"{self.folder}/{name}")
        if terms is None:
            return t
        if not terms:
            return t.limit(0)
        words = self.spark.createDataFrame([(w,) for w in terms], "term string")
        there = [r.b for r in words.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
        return t.where(F.col("bucket").isin(*there) & F.col("term").isin(*terms))

    def matches(self, queries: DataFrame) -> DataFrame:
        """As matches() over the documents. Batches of more than TERMS_INLINE terms join all postings."""
        asked = query_terms(queries)
        terms = [r.term for r in asked.select("term").distinct().limit(TERMS_INLINE + 1).collect()]
        few = terms if len(terms) <= TERMS_INLINE else None
        tf = self._read("postings", few).drop("bucket")
        found = tf.join(asked, "term").join(self._read("terms", few).drop("bucket"), "term")
        return found.crossJoin(F.broadcast(self.stats.select("n", "avgdl")))  # one row

    def bm25(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, idf: str = "plus") -> DataFrame:
        return bm25_of(self.matches(queries), self.key, k, k1, b, idf, self.stats.select("mean_idf"))

    def tfidf(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return tfidf_of(self.matches(queries), self.key, k)

    def boolean_and(self, *terms: str) -> DataFrame:
        """As boolean_and() over the documents."""
        words = first_tokens(terms)
        hits = self._read("postings", words)
        return hits.groupBy(self.key).agg(F.count("*").alias("c")).where(F.col("c") == len(words)).select(self.key)

    def document_frequency(self) -> DataFrame:
        return self._read("terms", None).select("term", "df")


def filled(run: DataFrame, docs: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """A run with exactly k rows per query, as far as there are documents: documents without a hit follow with score 0, by key.

    At most k documents of a query have hits, so the first 2k keys are enough to fill it.
    """
    first = docs.select(key).distinct().orderBy(key).limit(2 * k)
    rest = queries.select("query_id").crossJoin(F.broadcast(first)).join(run.select("query_id", key), ["query_id", key], "left_anti")
    return top_k(run.select("query_id", key, "score").unionByName(rest.withColumn("score", F.lit(0.0))), key, k)


def first_rank_of(run: DataFrame, queries: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Rows (query_id, first): the rank of the first target (query_id, key) of each query, null if none came."""
    hit = run.join(targets.select("query_id", key).distinct(), ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id").join(hit, "query_id", "left")


def count_in_top(run: DataFrame, targets: DataFrame, key: str, k: int) -> DataFrame:
    """Rows (query_id, n): how many of the targets are among the k best."""
    top = run.where(F.col("rank") <= k).join(targets.select("query_id", key).distinct().withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return top.groupBy("query_id").agg(F.count("hit").alias("n"))


def term_curves(k1: float = K1, b: float = B) -> tuple:
    """Columns of BM25's two curves for a frequency f and a relative length r: saturation and length penalty."""
    return F.col("f") * (k1 + 1) / (F.col("f") + k1), 1 - b + b * F.col("r")
