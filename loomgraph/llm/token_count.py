"""Token counts by byte-pair merging over a heap and a linked list, without making identifiers.

A word starts as its bytes, one symbol each, in a doubly linked list. A heap holds the ranks of adjacent
pairs; the lowest rank (leftmost among equals) is popped, its right symbol is unlinked, and the two pairs
that the merged symbol forms are pushed. Entries whose pair is gone are skipped. The count of a word is
its bytes less the merges made. The work is m log m for a word of m bytes, however long it is.

The vocabulary file is a parameter; the driver reads it, checks its size and broadcasts it. Texts are
counted inside Arrow batches, a bounded number of characters at a time, and nothing is shuffled. A
worker remembers counts of words it has met, up to MAX_REMEMBERED.

NULL and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; rows without an id are
counted like others; an empty table gives none; other columns are ignored. The string of a special token
inside a text is one token, as the tokenizers library has it by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.bpe import ASCII_SPLIT, SPLIT, byte_letters, portions, shipped
from loomgraph.llm.common import texts, with_package

LIMIT = 512
MAX_REMEMBERED = 1_000_000
PORTION = 2_000_000


class Counts(dict):
    """Tokens per word, computed when a word is first asked for."""

    def __init__(self, content: bytes):
        super().__init__()
        spec = json.loads(content)
        byte_of, ids = byte_letters(), spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbol = [ids[letter] for letter, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)

    def __missing__(self, word: str) -> int:
        data = word.encode()
        self[word] = count = len(data) - self.merges(data)
        return count

    def merges(self, data: bytes) -> int:
        """How many merges a word takes until no adjacent pair has a rank."""
        n, look = len(data), self.merge.get
        symbols = [self.symbol[b] for b in data]
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []
        for i in range(n - 1):
            if found := look((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapify(heap)
        made = 0
        while heap:
            _, i, merged, a, b = heappop(heap)
            j = right[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two symbols was merged meanwhile
            made += 1
            symbols[i], symbols[j] = merged, -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                if found := look((merged, symbols[after])):
                    heappush(heap, (found[0], i, found[1], merged, symbols[after]))
            before = left[i]
            if before >= 0 and (found := look((symbols[before], merged))):
                heappush(heap, (found[0], before, found[1], symbols[before], merged))
        return made

    def of(self, text: str) -> int:
        """Tokens of a whole text."""
        if not self.special or not self.special.search(text):
            return sum(map(self.__getitem__, self.words(text)))
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, self.words(p))) for p in pieces)

    def words(self, text: str) -> list[str]:
        return (ASCII_SPLIT if text.isascii() else self.split).findall(text)


_LOADED: dict[int, Counts] = {}


def loaded(content: bytes) -> Counts:
    """The parsed vocabulary, once per Python worker."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counts(content)
    return _LOADED[key]


def count(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text."""
    content = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(content.value)
        for batch in batches:
            column = batch.column("text")
            for start, stop in portions(pc.binary_length(column).to_pylist(), PORTION):
                part = column.slice(start, stop - start)
                n_tokens = [counts.of(t) for t in part.to_pylist()]
                if len(counts) > MAX_REMEMBERED:
                    counts.clear()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pc.binary_length(part).cast(pa.int64()), pa.array(n_tokens, pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])

    rows = with_package(texts(docs))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Counts per document, and whether a text has more than `limit` tokens."""
    return count(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
