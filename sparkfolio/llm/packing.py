"""Filling containers of fixed token capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.bpe import TOKENIZERS, VOCABULARY, CorpusEncoder, blocks

#: Items that are differenced together. A larger batch leaves less space, a smaller one is quicker.
BATCH = 768


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition `sizes` into k windows by differencing: (window of each item, sum of each window).

    Every item begins as a partition of its own with one window in use. Again and again the two partial partitions with the
    widest imbalance are merged, the fullest windows of one onto the emptiest of the other. Only windows in use are kept, the
    others are empty by implication.
    """
    link = np.arange(len(sizes) + len(sizes) * 2)  # items, then windows; union by pointing
    sums: dict[int, np.ndarray] = {}
    names: dict[int, np.ndarray] = {}
    heap: list[tuple[int, int]] = []
    free = len(sizes)
    for i, s in enumerate(sizes):
        sums[i], names[i] = np.array([s]), np.array([i])
        heap.append((-s, i))
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, na, sb, nb = sums.pop(a), names.pop(a), sums.pop(b), names.pop(b)  # descending
        spare = k - len(sa) - len(sb)
        if spare >= 0:
            s, n = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:
            over = -spare  # so many of the emptiest windows of either share a window
            x, y = sa[len(sa) - over :], sb[len(sb) - over :][::-1]
            nx, ny = na[len(na) - over :], nb[len(nb) - over :][::-1]
            link[ny] = nx
            s = np.concatenate([sa[: len(sa) - over], sb[: len(sb) - over], x + y])
            n = np.concatenate([na[: len(na) - over], nb[: len(nb) - over], nx])
        order = np.argsort(-s, kind="stable")
        s, n = s[order], n[order]
        least = int(s[-1]) if len(s) == k else 0
        sums[fresh], names[fresh] = s, n
        heapq.heappush(heap, (least - int(s[0]), fresh))
        fresh += 1
    last = heap[0][1]
    final = link[:free].copy()
    while True:  # follow the pointers of windows that were merged
        up = link[final]
        if (up == final).all():
            break
        final = up
    window = {int(n): w for w, n in enumerate(names[last])}
    return np.array([window[int(x)] for x in final], np.int64), sums[last]


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of each item so that no window holds more than `capacity`.

    The number of windows begins at the least that could do and rises whenever a window exceeds the capacity. With one
    window per item it always holds, as no item is larger than the capacity.
    """
    if not sizes:
        return np.empty(0, np.int64)
    half = sum(1 for s in sizes if 2 * s > capacity)
    k = max(1, -(-sum(sizes) // capacity), half)
    while True:
        windows, sums = difference(sizes, k)
        if sums[0] <= capacity:
            return windows
        k = min(len(sizes), k + max(1, int(np.maximum(sums - capacity, 0).sum() // (4 * capacity))))


SCHEMA = "container_id bigint, {key} {kind}, piece int, start_token bigint, n_tokens int"


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, folder: str = TOKENIZERS, name: str = VOCABULARY, batch: int = BATCH) -> DataFrame:
    """Rows (container_id, key, piece, start_token, n_tokens): every text in containers of `capacity` tokens.

    A text is cut only if it alone is longer: into full containers and a rest, which is packed like a whole text. Null
    and empty texts are left out; blank ones have tokens and are packed. A null key and repeated rows are items of their own.
    Other columns are not read. Each task packs the rows that it reads, `batch` items at a time, so there is no shuffle,
    no group of unbounded size. Items come in the order in which a task reads them: one that reads a file again gives the same containers, one behind
    a shuffle may give others, as the order of fetched blocks isn't fixed. All of one run's containers come from the same attempt of a task.
    """
    if capacity < 1 or batch < 1:
        raise ValueError("capacity and batch must be positive")
    kind = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("container_id", T.LongType(), False),
            T.StructField(key, kind),
            T.StructField("piece", T.IntegerType(), False),
            T.StructField("start_token", T.LongType(), False),
            T.StructField("n_tokens", T.IntegerType(), False),
        ]
    )
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = CorpusEncoder(folder, name)
        where = TaskContext.get()
        nextid = (where.partitionId() if where else 0) << 40
        rows: list[tuple] = []  # container, key, piece, start, tokens
        pool: list[tuple] = []  # key, piece, start, tokens

        def close(items: list[tuple]) -> None:
            nonlocal nextid
            windows = pack([x[3] for x in items], capacity)
            rows.extend((nextid + int(w), *x) for w, x in zip(windows, items))
            nextid += int(windows.max()) + 1 if len(windows) else 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            kinds = (pa.int64(), arrow_key, pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

        for b in batches:
            for s in blocks(b.column(1)):
                lengths = enc.lengths(b.column(1)[s.start : s.stop].to_pylist())
                for k, n in zip(b.column(0)[s.start : s.stop].to_pylist(), map(int, lengths)):
                    piece = start = 0
                    while n > capacity:
                        rows.append((nextid, k, piece, start, capacity))
                        nextid, piece, start, n = nextid + 1, piece + 1, start + capacity, n - capacity
                    if n:
                        pool.append((k, piece, start, n))
                    if len(pool) >= batch:
                        close(pool)
                        pool = []
                if rows:
                    yield out()
        close(pool)
        if rows:
            yield out()

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
