"""Benchmark decontamination with spaced seeds.

A word is a run of characters other than ASCII controls, blanks and punctuation, with A-Z in lower case.
A document overlaps an item where, on one diagonal, a window of WINDOW item words holds at least LEAST
equal words (of an item with fewer words the same share of all its words, rounded up). A mask is a set of
word offsets; the words between them are ignored. Every window with LEAST equal words holds at least one
mask whose words are all equal, and so does every item of fewer words with the masks that MORE adds for its length
(`tests/llm` tries all patterns of every length), so a shared hash of masked words proposes every overlap, and the
words around a hit then decide.

The benchmark is the given query set: it is cut into blocks of at most BLOCK_BYTES, whose size is
measured, and every block meets all documents. Words that are not in a block cannot match and are
dropped at once. Documents are never shuffled.

NULL and empty texts overlap nothing, in either table; repeated documents or items give repeated rows;
an empty table on either side gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import texts, with_package

MASKS = [(0, 1, 2, 3), (0, 1, 3, 4)]
# By item length: masks for the patterns of equal words that hold none of MASKS.
MORE = {5: [(0, 1, 2, 4), (0, 2, 3, 4)], 9: [(0, 1, 2, 4)]}
WINDOW, LEAST = 13, 10
BLOCK_BYTES = 16 << 20
PORTION = 4 << 20
# Bytes of a word by themselves; blanks elsewhere. Bytes of letters outside ASCII stay.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
FOLD = FOLD.translate(bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256)))
PRIME = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def needed(n: int) -> int:
    """Equal words a window needs, in an item of n words."""
    w = min(WINDOW, n)
    return -(-w * LEAST // WINDOW)


def masked(codes: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places where a mask fits on known words (codes above 0), and the hash of the words there."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    fits = codes[:n] > 0
    for k in mask[1:]:
        fits &= codes[k:n + k] > 0
    at = np.flatnonzero(fits)
    key = np.zeros(len(at), dtype=np.uint64)
    for k in mask:
        key = (key + codes[at + k].astype(np.uint64)) * PRIME
        key ^= key >> np.uint64(29)
    return at, key


class Items:
    """A block of the benchmark: its words as codes, and its seeds by hash."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        self.ids, self.code = [], {}
        parts, owner = [np.full(WINDOW, -1)], [np.full(WINDOW, -1)]
        self.first, self.length = [], []
        place = WINDOW
        for item, text in rows:
            words = words_of(text)
            if not words:
                continue
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in words]
            self.first.append(place)
            self.length.append(len(words))
            parts += [np.array(codes), np.full(WINDOW, -1)]
            owner += [np.full(len(words), len(self.ids)), np.full(WINDOW, -1)]
            place += len(words) + WINDOW
            self.ids.append(item)
        self.codes, self.owner = np.concatenate(parts).astype(np.int64), np.concatenate(owner)
        self.least = np.array([needed(n) for n in self.length] + [0])
        self.seeds = [self.table(mask, None) for mask in MASKS]
        span = max(m[-1] for m in MASKS) + 1
        # Items too short for every mask are looked up by all their words but those that may differ.
        for n in sorted({n for n in self.length if n < span}):
            gaps = n - needed(n)
            self.seeds += [self.table(m, n) for m in short_masks(n, gaps)]
        self.seeds += [self.table(m, n) for n in MORE if n in self.length for m in MORE[n]]

    def table(self, mask: tuple[int, ...], length: int | None):
        at, key = masked(self.codes, mask)
        if length is not None:
            keep = np.array(self.length)[self.owner[at]] == length
            at, key = at[keep], key[keep]
        order = np.argsort(key, kind="stable")
        present = np.zeros(1 << FILTER_BITS, dtype=bool)
        present[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return mask, key[order], at[order], present

    def overlaps(self, docs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, largest number of equal words in a window, first word of the document in such an overlap)."""
        codes, starts = [np.zeros(WINDOW, dtype=np.int64)], []
        place = WINDOW
        for t in docs:
            words = words_of(t)
            codes += [np.fromiter(map(self.code.get, words, repeat(0)), dtype=np.int64, count=len(words)), np.zeros(WINDOW, dtype=np.int64)]
            starts.append(place)
            place += len(words) + WINDOW
        text, starts = np.concatenate(codes), np.array(starts)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        done = set()
        for mask, keys, places, present in self.seeds:
            at, key = masked(text, mask)
            maybe = present[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            at, key = at[maybe], key[maybe]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = high - low
            p = np.repeat(at, n)
            q = places[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)]
            for k in range(0, len(p), 1 << 16):
                self.decide(text, starts, p[k:k + (1 << 16)], q[k:k + (1 << 16)], found, done)
        for (doc, item), (equal, first) in sorted(found.items()):
            yield doc, item, equal, first

    def decide(self, text, starts, p, q, found, done) -> None:
        """Verify hits: count equal words around them, then look at whole diagonals of those that may do."""
        around = np.arange(1 - WINDOW, WINDOW)
        # Padding of WINDOW on both sides of every text and item keeps a look-around from crossing into another.
        equal = (text[np.clip(p[:, None] + around, 0, len(text) - 1)] == self.codes[np.clip(q[:, None] + around, 0, len(self.codes) - 1)]).sum(axis=1)
        item = self.owner[q]
        good = equal >= self.least[item]
        doc = np.searchsorted(starts, p[good], "right") - 1
        for d, i, shift in zip(doc.tolist(), item[good].tolist(), (p[good] - q[good]).tolist()):
            if (d, i, shift) in done:
                continue
            done.add((d, i, shift))
            lo, n = self.first[i], self.length[i]
            same = np.zeros(n + WINDOW, dtype=np.int64)
            a, b = max(lo + shift, starts[d]), lo + shift + n
            piece = text[a:min(b, len(text))]
            same[a - lo - shift:a - lo - shift + len(piece)] = piece == self.codes[a - shift:a - shift + len(piece)]
            total = np.concatenate([[0], np.cumsum(same)])
            begins = np.flatnonzero(same[:n])
            held = total[np.minimum(begins + WINDOW, n)] - total[begins]
            enough = held >= self.least[i]
            if enough.any():
                first = int(begins[enough][0] + lo + shift - starts[d])
                was = found.get((d, i), (0, first))
                found[d, i] = (max(was[0], int(held.max())), min(was[1], first))


def short_masks(n: int, gaps: int) -> list[tuple[int, ...]]:
    """Masks over n words that leave out up to `gaps` of them, in every way."""
    from itertools import combinations

    return [tuple(k for k in range(n) if k not in out) for out in combinations(range(n), gaps)]


def portions(texts_: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, t in enumerate(texts_):
        total += len(t)
        if total >= PORTION:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts_):
        yield start, len(texts_)


def blocks(benchmark: DataFrame, most: int) -> Iterator[DataFrame]:
    """The benchmark in parts of at most `most` bytes of text; only one item larger than that goes beyond."""
    sized = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.octet_length("text"))
    count = 1
    while True:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
        top = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.countDistinct("item_id", "text").alias("items")).where("items > 1").agg(F.max("n")).first()[0]
        if (top or 0) <= most:
            break
        count *= 2
    for k in range(count):
        yield dealt.where(F.col("block") == k).select("item_id", F.col("text").cast("binary").alias("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, n_equal, doc_start), one per document and item that overlap.

    `n_equal` is the largest number of equal words in a window, `doc_start` the first word (from 0) of an overlap.
    """
    rows = with_package(texts(docs))
    sc = rows.sparkSession.sparkContext
    item_type = benchmark.schema["item_id"].dataType
    arrow_item = to_arrow_type(item_type)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, n_equal bigint, doc_start bigint"
    out = None
    for block in blocks(benchmark, block_bytes):
        held = sc.broadcast([(r[0], bytes(r[1])) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = Items(held.value)
            for batch in batches:
                texts_ = batch.column("text").cast(pa.binary()).to_pylist()
                for start, stop in portions(texts_):
                    found = list(items.overlaps(texts_[start:stop])) if items.ids else []
                    if found:
                        d, i, equal, first = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array([start + k for k in d])), pa.array([items.ids[k] for k in i], arrow_item),
                             pa.array(equal, pa.int64()), pa.array(first, pa.int64())], ["doc_id", "item_id", "n_equal", "doc_start"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, in their own columns, that overlap no item. Rows with a NULL doc_id are kept."""
    leaked = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
