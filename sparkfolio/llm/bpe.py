"""Byte-level BPE over whole corpora with a pair occurrence index.

The words that a partition brings are encoded together, not one by one: an index maps every pair of adjacent
symbols to all its positions in the distinct words at hand, the ranks present are applied in ascending order, and
a merge updates only the lists of the pairs it touches. Distinct words stay known for the rest of the partition,
so a word costs its merges once.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Folder of the public vocabularies; a parameter of every public function here.
TOKENIZERS = os.environ.get("SPARKFOLIO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# The white space of the Unicode property White_Space, and the pre-split of the vocabulary's family.
_SPACE = r"\t-\r \x85\xa0  -     　"
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Distinct words kept between batches of a partition; beyond it the memory starts afresh, results stay the same.
WORDS_KEPT = 400_000


def pretokens(text: str) -> list[str]:
    """The pieces of `text` that merges never cross; together they are the text."""
    return _ASCII_SPLIT.findall(text) if text.isascii() else _SPLIT.findall(text)


def load_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairIndexBpe:
    """Encoder of batches of words by one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}

    def _rank(self, a: int, b: int) -> int:
        """Rank of joining symbols a and b, -1 if the vocabulary doesn't."""
        key = (a, b)
        r = self.pair_rank.get(key)
        if r is None:
            r = self.pair_rank[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. All words share one index of pair positions."""
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts: list[int] = []
        for word in words:
            at = len(sym)
            starts.append(at)
            n = len(word)
            sym.extend([self.single[b] for b in word])
            nxt.extend(range(at + 1, at + n))
            nxt.append(-1)
            prv.append(-1)
            prv.extend(range(at, at + n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        for i, j in enumerate(nxt):
            if j >= 0:
                index.setdefault((sym[i], sym[j]), []).append(i)
        heap = [(r, p) for p in index if (r := self._rank(*p)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, pair = heapq.heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            places.sort()
            for i in places:
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # an earlier merge took one of the two
                k = nxt[j]
                sym[i], sym[j] = rank, -1
                nxt[i] = k
                h = prv[i]
                if k >= 0:
                    prv[k] = i
                    self._add(index, heap, (rank, sym[k]), i)
                if h >= 0:
                    self._add(index, heap, (sym[h], rank), h)
        out: list[list[int]] = []
        for at, word in zip(starts, words):
            ids, i = [], at if word else -1
            while i >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    def _add(self, index, heap, pair, place) -> None:
        have = index.get(pair)
        if have is not None:
            have.append(place)
            return
        r = self._rank(*pair)
        if r >= 0:
            index[pair] = [place]
            heapq.heappush(heap, (r, pair))


class CorpusEncoder:
    """Encodes lists of texts into one flat array of ids and offsets, remembering words between calls."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        self.bpe = PairIndexBpe(load_ranks(folder, name))
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.code]
        if not new:
            return
        coded = self.bpe.encode_words([w.encode("utf-8") for w in new])
        base = len(self.code)
        self.code.update((w, base + i) for i, w in enumerate(new))
        sizes = np.fromiter((len(c) for c in coded), np.int64, len(coded))
        flat = np.fromiter((x for c in coded for x in c), np.int32, int(sizes.sum()))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, at])
        self.size = np.concatenate([self.size, sizes])

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code of every word of the texts, and the number of words of each text."""
        if len(self.code) > WORDS_KEPT:
            self._reset()
        split = [pretokens(t) if t else [] for t in texts]
        seen: set[str] = set()
        for s in split:
            seen.update(s)
        self._learn(seen)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        code = self.code
        codes = np.fromiter((code[w] for s in split for w in s), np.int64, int(counts.sum()))
        return codes, counts

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        codes, counts = self._words(texts)
        run = np.concatenate([[0], np.cumsum(self.size[codes])])
        ends = np.cumsum(counts)
        return run[ends] - run[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts in them."""
        codes, counts = self._words(texts)
        sizes = self.size[codes]
        run = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.start[codes] - run[:-1], sizes) + np.arange(run[-1])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[where], run[ends]


def blocks(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[slice]:
    """Slices of a column of texts of about `most_bytes` each, so that long texts don't add up in memory."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield slice(at, to)
        at = to


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Rows (key, ids): the token ids of every text, without special tokens.

    Null and empty texts give an empty array, blank texts are encoded like any other; a null key stays null and repeated
    rows stay repeated. Strings of special tokens in a text are ordinary text. Other columns are not read. No
    shuffle: each task encodes its own rows.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = CorpusEncoder(folder, name)
        for batch in batches:
            texts = batch.column(1)
            for s in blocks(texts):
                part = texts[s.start : s.stop].to_pylist()
                flat, offsets = enc.encode(part)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
