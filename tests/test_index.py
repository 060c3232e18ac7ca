"""A kept index gives what a scan gives, and a batch reads only the buckets of its terms."""

from pyspark.sql import functions as F

from sparkfolio.operators import sparse


def test_index_is_a_scan(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 2 + i % 9))) for i in range(120)] + [(200, None), (201, ""), (202, "w1 w1 w1 rare-term"), (203, "Ü w2")]
    docs = spark.createDataFrame(rows, "k int, t string").withColumn("tf", F.lit("x")).withColumn("term", F.lit(1))
    queries = spark.createDataFrame([(1, "w1 w5 w5"), (2, "rare-term w36"), (3, "nothing"), (4, ""), (5, None)], "query_id int, query string")
    kept = sparse.Index.build(docs, "k", "t", str(tmp_path / "i"), buckets=8)
    again = sparse.Index(spark, str(tmp_path / "i"))

    def same(a, b):
        return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))

    for idx in (kept, again):
        assert same(idx.bm25(queries), sparse.bm25(docs, "k", "t", queries)) and same(idx.tfidf(queries, 5), sparse.tfidf(docs, "k", "t", queries, 5))
        assert same(idx.bm25(queries, idf="okapi"), sparse.bm25(docs, "k", "t", queries, idf="okapi"))
    assert same(again.document_frequency(), sparse.document_frequency(docs, "k", "t"))
    for terms in (("w1",), ("w1", "w2"), ("W1", "zzz"), ("!",), ()):
        assert same(again.boolean_and(*terms), sparse.boolean_and(docs, "k", "t", *terms))


def test_a_batch_reads_its_buckets(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("k"), F.concat_ws(" ", *[F.concat(F.lit("t"), (F.col("id") * i % 997).cast("string")) for i in range(1, 20)]).alias("t"))
    idx = sparse.Index.build(docs, "k", "t", str(tmp_path / "i"), buckets=16)
    q = spark.createDataFrame([(1, "t5 t7")], "query_id int, query string")
    def files(df):
        """Files that a scan without an exchange opens."""
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.collect()
        return plan.collectLeaves().head().metrics().apply("numFiles").value()

    assert 0 < files(idx._read("postings", ["t5", "t7"])) <= 2 < 16 <= files(idx._read("postings", None))
    plan = idx.bm25(q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    empty = sparse.Index.build(docs.where("1 = 0"), "k", "t", str(tmp_path / "e"))
    assert empty.bm25(q).count() == 0 and empty.document_frequency().count() == 0
