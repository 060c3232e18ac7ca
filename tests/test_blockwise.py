"""The best of blocks are the best of all, and pairs of queries and documents are not kept."""

import random

import pytest

from sparkfolio.operators import blockwise, sparse


def collection(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]

    def say(n):
        return " ".join(rng.choices(words, weights, k=n))

    # few lengths and words give ties; some keys come twice, with the same and with other lengths
    docs = [(f"k{rng.randrange(250):03}", say(rng.choice((3, 3, 8, 30)))) for _ in range(400)] + [("k900", None), ("k901", ""), ("k902", "?!"), (None, say(5)), (None, say(5))]
    queries = [(i, say(rng.randrange(1, 7)), True) for i in range(60)] + [(100, "w39 w39 w0", True), (101, "nowhere", True), (102, "", True), (103, None, True), (104, "w1 absent", True)]
    return docs, queries


@pytest.mark.parametrize("sizes", [(60_000, 60_000, 4_000_000), (30, 60_000, 100), (60_000, 1, 4_000_000)])
def test_best_of_blocks(spark, monkeypatch, sizes):
    for name, n in zip(("PART_ROWS", "BLOCK_ROWS", "BLOCK_TOKENS"), sizes):
        monkeypatch.setattr(blockwise, name, n)
    monkeypatch.setattr(blockwise, "AT_ONCE", 7)
    docs, queries = collection(sizes[0])
    docs = spark.createDataFrame(docs, "k string, t string").repartition(5)
    queries = spark.createDataFrame(queries, "query_id bigint, query string, x boolean")
    for k in (1, 10):
        got = blockwise.best(docs, "k", "t", queries, k)
        assert got.columns == ["config", "query_id", "rank", "k", "score"]
        got = got.collect()
        for config, f in (("bm25", sparse.bm25), ("tfidf", sparse.tfidf)):
            wanted = f(docs, "k", "t", queries, k).collect()
            assert sorted((tuple(r[1:]) for r in got if r.config == config), key=lambda r: r[:2]) == sorted(map(tuple, wanted), key=lambda r: r[:2])


def test_best_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a pump"), (2, None)], "k int, t string")
    ask = spark.createDataFrame([(1, "pump")], "query_id int, query string")
    assert [(r.config, r.k) for r in blockwise.best(docs, "k", "t", ask).orderBy("config").collect()] == [("bm25", 1), ("tfidf", 1)]
    assert blockwise.best(docs, "k", "t", ask.limit(0)).count() == 0
    assert blockwise.best(docs.limit(0), "k", "t", ask).count() == 0
    assert blockwise.best(docs.where("t is null"), "k", "t", ask).count() == 0


def test_known_items_keep_no_pairs(spark, tmp_path, monkeypatch):
    """Forty queries share a word with each of 2,000 chunks; of these 80,000 pairs only the best of each query and block are written."""
    from sparkfolio.plans import retrieval

    patents = [(100 * i, f"D{i}", f"a thing of part{i}") for i in range(40)]
    chunks = [(f"c{i}", f"D{i % 400}", f"a piece of part{i % 400} {i}") for i in range(2_000)]
    spark.createDataFrame(patents, "record_id bigint, doc_id string, title string").write.parquet(f"{tmp_path}/patents.parquet")
    spark.createDataFrame(chunks, "chunk_id string, document_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    kept = []

    def counted(df, cut=retrieval.cut):
        df = cut(df)
        kept.append(df.count())
        return df

    monkeypatch.setattr(retrieval, "cut", counted)
    got = {r.config: (r.queries, r.mrr) for r in retrieval.known_item_metrics(spark, str(tmp_path)).collect()}
    assert got == {c: (40, 1.0) for c in ("bm25", "tfidf", "fused")}
    assert max(kept) <= 40 * 3 * 50
