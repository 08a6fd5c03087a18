"""Suffix-array dedup: a collection's Burrows-Wheeler order, built one column per round.

A text is its UTF-8 bytes, a window LENGTH of them. Super-k-mers bring equal windows into one bucket, and there
they stand in the same column, counted from the minimiser. So the construction that inserts one symbol of every
document per round, from the right, can order each column by itself: a round takes the order of the suffixes one
column to the right, sorts it stably by the symbol that precedes each suffix, and derives the common prefix with
the upper neighbour from the old ones (one more than the least between two equal symbols, else none). Orders of
other columns are never merged in, as no repeat can lie across them. The sequential files between the rounds are
Spark's sorted partitions: a task streams its buckets and holds a few thousand pieces, whatever a bucket's texts weigh.
A window is repeated where the common prefix with a neighbour reaches LENGTH. Common prefixes from SHORT on are
known on the way: bytes in them are counted too, but stay. A bucket with very many pieces is taken apart: equal
pieces are merged, and windows travel by a 128-bit digest.

NULL and empty texts have no bytes; repeated rows repeat each other's bytes and go on both sides; rows without
doc_id neither lose bytes nor count; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm import pieces
from loomgraph.llm.common import with_package
from loomgraph.llm.minhash import mix

LENGTH, SHORT, GRAM = 400, 256, 32
WIDTH = SHORT - GRAM + 1
ROWS_AT_ONCE = 4_000
FACTOR = 0x9E3779B97F4A7C15


def byte_grams():
    """Hashes of the GRAM-byte sequences of a text, by doubling."""
    def grams(text: bytes) -> np.ndarray:
        if len(text) < SHORT:
            return np.zeros(0, dtype=np.uint64)
        h = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        reach, factor = 1, FACTOR
        while reach < GRAM:
            h = h[:-reach] * np.uint64(factor) + h[reach:]
            factor = factor * factor % (1 << 64)
            reach *= 2
        return mix(h)

    return grams


def bytes_cut(text: bytes):
    return lambda first, n: text[first:first + n + LENGTH - 1]


def longest_shared(group: np.ndarray, left: np.ndarray, held: list[bytes], windows: np.ndarray) -> np.ndarray:
    """How much, up to LENGTH, of what starts at each of a piece's windows another piece of its group has in the same column.

    Told apart are less than SHORT (0), less than LENGTH (SHORT), and LENGTH. `left` is how many bytes a piece has before its minimiser; columns are counted so that minimisers line up.
    """
    m = len(held)
    shift = left.max() - left
    size = np.array([len(p) for p in held])
    columns = int((shift + size).max())
    symbols = np.zeros((columns, m), dtype=np.uint16)  # 0: no byte of the piece
    for k, p in enumerate(held):
        symbols[shift[k]:shift[k] + size[k], k] = np.frombuffer(p, dtype=np.uint8).astype(np.uint16) + 1
    out = np.zeros((columns, m), dtype=np.int16)
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(m, dtype=np.int64)  # with the upper neighbour in the order
    rank = np.unique(group, return_inverse=True)[1].reshape(-1).astype(np.uint16)
    for column in range(columns - 1, -1, -1):
        symbol = symbols[column][order]
        by_symbol = np.argsort(symbol, kind="stable")
        step = by_symbol[np.argsort(rank[order][by_symbol], kind="stable")]
        s, g = symbol[step], rank[order][step]
        same = np.flatnonzero((s[1:] == s[:-1]) & (g[1:] == g[:-1]) & (s[1:] > 0)) + 1
        fresh = np.zeros(m, dtype=np.int64)
        if len(same):
            # The least old prefix between two neighbours that were further apart before.
            bounds = np.stack([step[same - 1] + 1, step[same] + 1], axis=1).reshape(-1)
            fresh[same] = 1 + np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
        prefix, order = fresh, order[step]
        for reach in (SHORT, LENGTH):  # with the upper neighbour, or with the lower one
            long = np.flatnonzero(prefix >= reach)
            out[column, order[long]] = out[column, order[long - 1]] = reach
    return np.concatenate([out[shift[k]:shift[k] + n, k] for k, n in enumerate(windows.tolist())])


def repeats(table: pa.Table) -> pa.Table:
    """(doc_id, tid, first, last, span): windows of the pieces of a bucket that stand in another of its pieces too."""
    known = longest_shared(table.column("key").to_numpy(), table.column("offset").to_numpy(), table.column("piece").to_pylist(), table.column("size").to_numpy())
    return pa.concat_tables([pieces.flagged_runs(table, known >= reach, reach) for reach in (SHORT, LENGTH)])


def repeats_apart(table: DataFrame) -> DataFrame:
    """The same for crowded buckets: windows of the distinct pieces are counted by a digest of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                row, span, at, digest = [], [], [], []
                for k, (piece, windows) in enumerate(zip(part.column("piece").to_pylist(), part.column("size").to_pylist())):
                    for reach in (SHORT, LENGTH):
                        n = min(windows, len(piece) - reach + 1)
                        digest += [hashlib.blake2b(piece[i:i + reach], digest_size=16).digest() for i in range(n)]
                        row.append(np.full(max(n, 0), k))
                        at.append(np.arange(n))
                        span.append(np.full(max(n, 0), reach))
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(row) for c in ("s1", "s2", "times")], pa.array(np.concatenate(span)), pa.array(np.concatenate(at)), pa.array(digest, pa.binary())],
                                                 ["s1", "s2", "times", "span", "i", "window"])

    distinct = pieces.distinct_pieces(table).select("s1", "s2", "times", "size", "piece")
    each = with_package(distinct).mapInArrow(run, "s1 bigint, s2 bigint, times bigint, span bigint, i bigint, window binary")
    often = each.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    listed = each.join(often, "window", "left_semi").groupBy("s1", "s2", "span").agg(F.first("times").alias("times"), pieces.as_runs(F.collect_list("i")).alias("runs"))
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["last"] + F.col("start")).alias("last"), F.col("span").alias("span")))
    return pieces.at_occurrences(table, listed).select("doc_id", "tid", F.inline(moved))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, runs): windows of a text that start anywhere else too."""
    rows = pieces.identified(docs)
    shared = pieces.shared_keys(pieces.minimisers(rows, byte_grams, WIDTH), F.col("n") > 1)
    table = pieces.settled(pieces.cut(rows, byte_grams, WIDTH, bytes_cut, shared), repeats, ROWS_AT_ONCE)
    return pieces.per_document(pieces.plain_hits(table).unionByName(repeats_apart(table)))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_shared, kept) per row; `kept` are the bytes left.

    `n_shared` are the bytes in strings of SHORT bytes that also start anywhere else, removed or not.
    """
    def covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        cover = np.zeros(size + 1, dtype=np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, last, -1)
        return np.cumsum(cover)[:-1] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text, runs_ in zip(batch.column("text").cast(pa.binary()), batch.column("runs")):
                data = np.frombuffer(text.as_py(), dtype=np.uint8)
                first, last, span = [runs_.values.field(c).to_numpy() for c in ("first", "last", "span")] if runs_.is_valid else [np.zeros(0, dtype=np.int64)] * 3
                gone, shared = [covered(len(data), first[span == reach], last[span == reach] + reach) for reach in (LENGTH, SHORT)]
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                for o, v in zip(out, (len(data), int(gone.sum()), spans, int(shared.sum()), data[~gone].tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    both = with_package(rows.join(repeated_windows(docs), ["doc_id", "tid"], "left").select("doc_id", "text", "runs"))
    return both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, n_shared bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
