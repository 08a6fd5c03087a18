"""Byte-level BPE with a rank array per word.

A word is held as a contiguous array of part ids and the ranks of adjacent parts. The least rank is
found by a scan, its boundary is deleted, and the two ranks beside it are refreshed. A word longer
than SHORT bytes takes the same merges from a heap, because a scan per merge is quadratic.

The vocabulary file is a parameter. The driver reads it, checks its size and broadcasts the bytes:
executors need no file. Words are split, merged and remembered inside Arrow batches; a task holds one
batch, the vocabulary and a bounded memory of words.

NULL and empty texts have no ids and decode to ''; repeated rows give repeated rows; an empty table
gives none; other columns are ignored. A special token in a text is one id, as the tokenizers library
has it with its default settings.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.common import sha256_hex, texts, with_package

# Fixed value: how byte-level vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same on texts of ASCII letters alone, where the standard module is faster.
ASCII_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
SHORT = 48
MAX_VOCABULARY_MB = 64
MAX_REMEMBERED = 500_000
PORTION = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Places(dict):
    """Words by their place in the order of first sight; asking for a new word gives it the next place."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Vocabulary:
    """Merge ranks and byte strings of a byte-level BPE file, and the words met so far."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = np.array([ids[a + b] for a, b in pairs] + [0], dtype=np.int32)
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.byte_id = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        size = np.array([len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)], dtype=np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.text = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(size))), dtype=np.uint8)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.forget()
        self.none = len(pairs)
        keys = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; `none` where no merge exists or a part is missing (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.key_rank[at], self.none)

    def merged_short(self, words: list[bytes]) -> list[array]:
        """Ids of words of at most SHORT bytes, all at once.

        A row of `parts` is a word, beside it a row of the ranks of its adjacent parts. A round finds the
        least rank of every row by a scan, puts the merged part in place, deletes the boundary by closing
        the gap, and refreshes the two ranks beside it. Rows without a merge leave the table.
        """
        n, width = len(words), max(map(len, words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        parts = np.where(np.arange(width) < length[:, None], self.byte_id[raw], -1)
        ranks = np.full((n, width), self.none, dtype=np.int32)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        out: list[array] = [array("i")] * n
        row_of = np.arange(n)
        column = np.arange(width)
        while len(row_of):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(at))
            least = ranks[rows, at]
            done = least == self.none
            if done.any():
                for k, ids in zip(row_of[done].tolist(), parts[done]):
                    out[k] = array("i", ids[ids >= 0].tobytes())
                live = ~done
                parts, ranks, row_of, at, least = parts[live], ranks[live], row_of[live], at[live], least[live]
                rows = np.arange(len(at))
                if not len(at):
                    break
            gap = column[None, :] > at[:, None]
            parts[rows, at] = self.made[least]
            parts = np.where(gap, np.pad(parts[:, 1:], ((0, 0), (0, 1)), constant_values=-1), parts)
            ranks = np.where(gap, np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=self.none), ranks)
            nxt = np.minimum(at + 1, width - 1)
            right = np.where(at + 1 < width, parts[rows, nxt], -1)
            ranks[rows, at] = self.ranks(parts[rows, at], right)
            before = np.maximum(at - 1, 0)
            ranks[rows, before] = np.where(at > 0, self.ranks(parts[rows, before], parts[rows, at]), ranks[rows, before])
        return out

    def merged_long(self, word: bytes) -> array:
        """The same merges, lowest rank first and leftmost among equals, from a heap over linked parts."""
        parts = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        look, made = self.rank.get, self.made.tolist()
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (rank := look((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = made[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return array("i", [p for p, live in zip(parts, alive) if live])

    def forget(self) -> None:
        self.places = Places()
        self.word_size, self.word_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def learn(self) -> None:
        """Give ids to the words that got a place but have none yet; words of like length are merged together."""
        known = len(self.word_size)
        if known == len(self.places):
            return
        fresh = [w.encode() for w in islice(self.places, known, None)]
        ids: list[array] = [array("i")] * len(fresh)
        for low, high in zip((0, 8, 12, 16, 24), (8, 12, 16, 24, SHORT)):
            group = [k for k, w in enumerate(fresh) if low < len(w) <= high]
            for start in range(0, len(group), 1 << 14):
                some = group[start:start + (1 << 14)]
                for k, made in zip(some, self.merged_short([fresh[k] for k in some])):
                    ids[k] = made
        for k, w in enumerate(fresh):
            if len(w) > SHORT:
                ids[k] = self.merged_long(w)
        self.word_size = np.concatenate([self.word_size, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))])
        self.word_ids = np.concatenate([self.word_ids, np.frombuffer(b"".join(x.tobytes() for x in ids), dtype=np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, and where each text ends.

        Every word gets a place in the memory; words met for the first time are then merged together.
        """
        if len(self.places) > MAX_REMEMBERED:
            self.forget()
        for token in self.special:
            self.places[token]  # noqa: B018  its ids are put right below
        places, counts = [], []
        for t in texts:
            words: list[str] = []
            for k, piece in enumerate(self.cut.split(t) if self.cut else [t]):
                words += [piece] if k % 2 else (ASCII_SPLIT if piece.isascii() else self.split).findall(piece)
            places.append(np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words)))
            counts.append(len(words))
        first = len(self.word_size) == 0
        self.learn()
        if first and self.special:
            # A special token stands at the first places, with its own id; as a word it never comes out of a split.
            keep = int(self.word_size[:len(self.special)].sum())
            self.word_ids = np.concatenate([np.array(list(self.special.values()), dtype=np.int32), self.word_ids[keep:]])
            self.word_size[:len(self.special)] = 1
        at = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        size = self.word_size[at]
        start = (np.cumsum(self.word_size) - self.word_size)[at]
        ends = np.cumsum(size)
        ids = self.word_ids[np.arange(int(size.sum())) - np.repeat(ends - size - start, size)]
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)] if counts else np.zeros(0, dtype=np.int64)

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> list[str]:
        """Texts of ids that stand one after the other."""
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.text[np.arange(int(size.sum())) - np.repeat(ends - size - self.start[ids], size)].tobytes()
        bounds = [0, *np.concatenate([[0], ends])[stops].tolist()]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]


_LOADED: dict[int, Vocabulary] = {}


def loaded(content: bytes) -> Vocabulary:
    """The parsed vocabulary, once per Python worker."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def shipped(df: DataFrame, path: str):
    """The vocabulary file as a broadcast of checked size."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY_MB << 20:
        raise ValueError(f"a vocabulary of {len(content)} bytes is too large to send to every executor")
    return df.sparkSession.sparkContext.broadcast(content)


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` in size, so that the words of a batch never stand in memory at once."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every text."""
    content = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(content.value)
        for batch in batches:
            texts_ = batch.column("text").to_pylist()
            for start, stop in portions([len(t) for t in texts_], PORTION):
                ids, stops = vocabulary.encode(texts_[start:stop])
                offsets = pa.array(np.concatenate([[0], stops]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:stop], pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    rows = with_package(texts(docs))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the text the ids stand for."""
    content = shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(content.value)
        for batch in batches:
            column = batch.column("ids")
            sizes = np.diff(column.offsets.to_numpy())
            for start, stop in portions(sizes.tolist(), PORTION // 4):
                part = batch.slice(start, stop - start)
                ids = part.column("ids").flatten().to_numpy()
                out = vocabulary.decode(ids, np.cumsum(sizes[start:stop]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], ["doc_id", "ids", "text"])

    rows = with_package(encoded.select("doc_id", "ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the decoded text."""
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha256_hex(F.col("text")).alias("decoded_sha256"))
