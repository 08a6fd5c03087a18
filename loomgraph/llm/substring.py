"""Substring dedup by super-k-mers of words.

A window is WINDOW consecutive words. Consecutive windows with the same minimiser (least hash of GRAM words)
travel as one packed string to their bucket, where sorting the windows gives the least document of each. A
bucket with very many strings is taken apart: equal strings are merged, keeping the least document, and windows
travel by their own words. A word goes when a window over it also starts in a
document with a smaller doc_id.

NULL and empty texts have no words; a text with fewer words than a window loses nothing; rows with the same
doc_id don't remove words from each other; rows without doc_id neither lose words nor count; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm import pieces
from loomgraph.llm.common import let, sha256_hex, with_package
from loomgraph.llm.minhash import GOLDEN, WordHashes, mix

WINDOW, GRAM = 13, 5
ROWS_AT_ONCE = 20_000


def word_grams():
    """Hashes of the GRAM-word sequences of a text."""
    hashes = WordHashes()

    def grams(text: bytes) -> np.ndarray:
        words = text.split()
        h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(len(h) - GRAM + 1, 0)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(GRAM):
            out = mix(out + h[k:n + k] + GOLDEN)
        return out

    return grams


def words_cut(text: bytes):
    words = text.split()
    packed = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    return lambda first, n: packed[starts[first]:ends[first + n + WINDOW - 2] - 1]


def repeats(table: pa.Table) -> pa.Table:
    """(doc_id, tid, first, last, span): windows of the pieces of a bucket that a smaller document has too."""
    code: dict[bytes, int] = {}
    split = [p.split(b" ") for p in table.column("piece").to_pylist()]
    codes = np.array([code.setdefault(w, len(code)) for words in split for w in words], dtype=np.int64)
    size = np.array([len(words) for words in split])
    n = table.column("size").to_numpy()
    first = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(n.sum())
    doc = np.repeat(table.column("doc_id").to_numpy(), n)
    group = same_window(codes, first)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    return pieces.flagged_runs(table, least[group] < doc, WINDOW)


def same_window(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number per window, the same for equal windows: sorted by hash, confirmed word by word."""
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(WINDOW):
        h = mix(h + codes[first + k].astype(np.uint64) + GOLDEN)
    order = np.argsort(h, kind="stable")
    twin = h[order][1:] == h[order][:-1]
    a, b = first[order][1:][twin], first[order][:-1][twin]
    if any((codes[a + k] != codes[b + k]).any() for k in range(WINDOW)):
        windows = codes[first[:, None] + np.arange(WINDOW)]
        return np.unique(windows, axis=0, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(first), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~twin)])
    return out


def repeats_apart(table: DataFrame) -> DataFrame:
    """The same for crowded buckets: windows of the distinct pieces are joined by their own words."""
    distinct = pieces.distinct_pieces(table)
    words = F.split(F.col("piece").cast("string"), " ")
    windows = let(words, lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.array_join(F.slice(ws, i, F.lit(WINDOW)), " ")))
    each = distinct.select("s1", "s2", "low", "times", F.posexplode(windows).alias("i", "window"))
    least = each.groupBy("window").agg(F.min("low").alias("m"))
    listed = each.join(least, "window").groupBy("s1", "s2").agg(F.first("times").alias("times"), F.collect_list(F.struct("i", "m")).alias("least"))
    hit = F.transform(F.filter("least", lambda x: x["m"] < F.col("doc_id")), lambda x: x["i"] + F.col("start"))
    return pieces.at_occurrences(table, listed).select("doc_id", "tid", F.inline(pieces.as_runs(hit))).withColumn("span", F.lit(WINDOW).cast("long"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, runs): windows of a text that also start in a document with a smaller id."""
    rows = pieces.identified(docs)
    width = WINDOW - GRAM + 1
    shared = pieces.shared_keys(pieces.minimisers(rows, word_grams, width), F.col("low") < F.col("high"))
    table = pieces.settled(pieces.cut(rows, word_grams, width, words_cut, shared), repeats, ROWS_AT_ONCE)
    return pieces.per_document(pieces.plain_hits(table).unionByName(repeats_apart(table)))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row; `kept` are the words left, joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, runs in zip(batch.column("text").cast(pa.binary()), batch.column("runs")):
                words = text.as_py().split()
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                if runs.is_valid:
                    np.add.at(cover, runs.values.field("first").to_numpy(), 1)
                    np.add.at(cover, runs.values.field("last").to_numpy() + WINDOW, -1)
                keep = np.cumsum(cover)[:-1] == 0
                total.append(len(words))
                gone.append(int((~keep).sum()))
                kept.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    both = with_package(rows.join(repeated_windows(docs), ["doc_id", "tid"], "left").select("doc_id", "text", "runs"))
    return both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")


def report(docs: DataFrame) -> DataFrame:
    return removed(docs).select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))
