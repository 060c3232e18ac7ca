"""The best documents of very many queries, by blocks of documents.

sparse.matches() has a row for each query, document and term that they share. For a batch of a fixed size that grows with the hits; where the queries
grow with the documents it grows with their square. Here the documents are written once as numbers of the terms that some query asks for, and each
block of documents scores all queries in memory and gives away its k best rows of each. What is shuffled are the numbers, and k rows per query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import tokenize
from sparkfolio.operators.sparse import B, K1, query_terms, top_k
from sparkfolio.session import cut, parts_for

#: Documents of a partition, and the documents and tokens after which a block in it ends.
PART_ROWS, BLOCK_ROWS, BLOCK_TOKENS = 60_000, 60_000, 3_000_000
#: A term in more than one of so many documents of a block has a number for each of them, else a list.
WIDE = 8
#: Queries whose rows are given away at once.
AT_ONCE = 2_000
#: Scores are rounded to six places before they are ranked; what is nearer than this to the k-th may still be as good.
NEAR = 2e-6


def bm25_part(tf, dl, df, n, avgdl):
    """What a term adds to the score of a document, as in sparse.bm25(); above 0."""
    return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def tfidf_part(tf, dl, df, n, avgdl):
    """As in sparse.tfidf(); above 0."""
    return (1 + np.log(tf)) * (np.log((n + 1) / (df + 1)) + 1)


PARTS = {"bm25": bm25_part, "tfidf": tfidf_part}


def coded(docs: DataFrame, key: str, text: str, terms: pa.Array) -> DataFrame:
    """Rows (key, dl, codes) in the order of key and dl, all of a key in one partition: of the tokens in `terms` their numbers, and how many tokens there are."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1)
            flat = pc.list_flatten(t)
            ids = pc.index_in(flat, value_set=terms.cast(flat.type))
            asked = pc.is_valid(ids)
            per_row = np.bincount(pc.list_parent_indices(t).filter(asked).to_numpy(), minlength=len(t))
            ends = pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32())
            dl = pc.fill_null(pc.list_value_length(t), 0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), dl, pa.ListArray.from_arrays(ends, ids.filter(asked))], names=[key, "dl", "codes"])

    kind = docs.schema[key].dataType.simpleString()
    n = docs.count()
    parts = max(parts_for(n, PART_ROWS, 1), min(docs.sparkSession.sparkContext.defaultParallelism, parts_for(n, 2_000, 1)))
    c = docs.select(key, tokenize(text).alias("tokens")).mapInArrow(code, f"`{key}` {kind}, dl int, codes array<int>")
    return c.repartition(parts, key).sortWithinPartitions(key, "dl")


def _steps(keys: pa.Array) -> np.ndarray:
    """Where another key begins; nulls are one key."""
    k = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[True], k[1:] != k[:-1]])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """The columns of rows in the order of their keys, in blocks of a limited size that end between keys."""
    have, tokens, rows = [], 0, 0

    def columns(t: pa.Table):
        one = t.combine_chunks().to_batches()[0]
        return one.column(0), one.column(1).to_numpy(), one.column(2)

    for b in batches:
        if not b.num_rows:
            continue
        have.append(b)
        tokens, rows = tokens + len(pc.list_flatten(b.column(2))), rows + b.num_rows
        if tokens >= BLOCK_TOKENS or rows >= BLOCK_ROWS:
            t = pa.Table.from_batches(have).combine_chunks()
            last = int(np.flatnonzero(_steps(t.to_batches()[0].column(0)))[-1])
            if last:
                yield columns(t.slice(0, last))
                have = t.slice(last).to_batches()
                tokens, rows = sum(len(pc.list_flatten(x.column(2))) for x in have), sum(x.num_rows for x in have)
    if have:
        yield columns(pa.Table.from_batches(have))


def _counted(keys: pa.Array, dl: np.ndarray, codes: pa.Array) -> tuple[np.ndarray, ...]:
    """(term, group, tf) by term and group, then for the groups dl and the number of their key, then the row where each key begins.

    As in sparse.matches() a group is all rows of the same key and length.
    """
    new_key = _steps(keys)
    new_group = new_key | np.concatenate([[True], dl[1:] != dl[:-1]])
    group = np.cumsum(new_group) - 1
    groups = int(group[-1]) + 1
    at = pc.list_flatten(codes).to_numpy().astype(np.int64) * groups + group[pc.list_parent_indices(codes).to_numpy()]
    at, tf = np.unique(at, return_counts=True)
    return at // groups, at % groups, tf, dl[new_group].astype(float), (np.cumsum(new_key) - 1)[new_group], np.flatnonzero(new_key)


class Lists:
    """What each term adds to the documents of a block: the lists of terms one after the other, each by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, part: np.ndarray, terms: int, docs: int):
        at = term * docs + doc
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
        if len(first) < len(at):  # keys of several lengths
            term, doc, part = term[first], doc[first], np.add.reduceat(part, first)
        self.doc, self.part, self.sums = doc, part, np.zeros(docs)
        self.begin = np.searchsorted(term, np.arange(terms + 1))
        self.wide: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(np.diff(self.begin) * WIDE > docs).tolist():
            self.wide[t] = np.zeros(docs)
            self.wide[t][doc[self.begin[t] : self.begin[t + 1]]] = part[self.begin[t] : self.begin[t + 1]]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best for the terms of a query and how often it has them, ties by document."""
        sums = self.sums
        sums.fill(0)
        for t, f in zip(terms.tolist(), times.tolist()):
            if t in self.wide:
                sums += self.wide[t] if f == 1 else f * self.wide[t]
            else:
                a, z = self.begin[t], self.begin[t + 1]
                sums[self.doc[a:z]] += f * self.part[a:z]
        least, run = 0.0, len(sums) // (16 * k)
        if run > 1:  # the best of each run of documents: the k-th of these is not above the k-th of all
            tops = sums[: len(sums) // run * run].reshape(-1, run).max(axis=1)
            least = np.partition(tops, len(tops) - k)[len(tops) - k] - NEAR
        found = np.flatnonzero(sums >= least) if least > 0 else np.flatnonzero(sums)  # parts are above 0
        scores = sums[found]
        if len(found) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - NEAR
            found, scores = found[near], scores[near]
        order = np.lexsort((found, -np.round(scores, 6)))[:k]
        return found[order], scores[order]


def best(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10, scores: tuple[str, ...] = ("bm25", "tfidf")) -> DataFrame:
    """Rows (config, query_id, rank, key, score): for each of the `scores` what sparse.bm25() or sparse.tfidf() give.

    The terms of all queries (query_id, query) are sent to all tasks, 16 bytes a term; no row of a query and a document leaves a task unless it is
    among the k best of its block. Null and empty texts count as documents without terms; queries without a term have no rows.
    """
    spark = docs.sparkSession
    asked = query_terms(queries).toArrow()
    asked = asked.sort_by([("query_id", "ascending")])
    terms = asked.column("term").combine_chunks().unique()
    ids = asked.column("query_id").combine_chunks()
    begin = np.append(np.flatnonzero(_steps(ids)), len(ids)) if len(ids) else np.zeros(1, np.int64)
    c = cut(coded(docs, key, text, terms))
    n_terms = len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, dl, codes in blocks(batches):
            df = np.bincount(_counted(keys, dl, codes)[0], minlength=n_terms)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, n_terms), pa.int64()), pa.array(np.concatenate([[len(dl), dl.sum()], df]), pa.int64())], names=["code", "many"])

    # -2: how many documents there are, -1: how many tokens, then the document frequencies of the terms
    many = dict(c.mapInArrow(count, "code bigint, many bigint").groupBy("code").agg(F.sum("many").alias("many")).collect())
    n, avgdl = many.get(-2, 0), many.get(-1, 0) / max(many.get(-2, 0), 1)
    of_all = spark.sparkContext.broadcast(
        {
            "ids": ids.take(pa.array(begin[:-1])),
            "begin": begin,
            "terms": pc.index_in(asked.column("term").combine_chunks(), value_set=terms).to_numpy(),
            "times": asked.column("qtf").to_numpy().astype(float),
            "df": np.array([many.get(i, 0) for i in range(n_terms)], float),
        }
    )
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), key: docs.schema[key].dataType.simpleString()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = of_all.value
        for keys, dl, codes in blocks(batches):
            term, group, tf, length, doc, rows = _counted(keys, dl, codes)
            keys = keys.take(pa.array(rows))
            for name in scores:
                lists = Lists(term, doc[group], PARTS[name](tf, length[group], q["df"][term], n, avgdl), n_terms, len(rows))
                for a in range(0, len(q["ids"]), AT_ONCE):
                    some = range(a, min(a + AT_ONCE, len(q["ids"])))
                    got = [lists.best(q["terms"][q["begin"][i] : q["begin"][i + 1]], q["times"][q["begin"][i] : q["begin"][i + 1]], k) for i in some]
                    who = pa.array(np.repeat(np.array(some), [len(d) for d, _ in got]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(who), pa.string()), q["ids"].take(who), keys.take(pa.array(np.concatenate([d for d, _ in got]))), pa.array(np.concatenate([s for _, s in got]))],
                        names=["config", "query_id", key, "score"],
                    )

    found = c.mapInArrow(score, f"config string, query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double")
    ranked = top_k(found.select(F.struct("config", "query_id").alias("query_id"), key, "score"), key, k)
    return ranked.select("query_id.config", "query_id.query_id", "rank", key, "score")
