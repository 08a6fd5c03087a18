"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document is the set of its word shingles (words `[^\\x20\\x09-\\x0D]+` after A-Z became lower case; with fewer
words than a shingle has, the whole sequence is one). Texts with the same set form a class. Each class gets
a sketch of BINS coordinates: in round i every element falls into one bin by a hash of that round, a bin keeps
the least hash of the first round that reached it, and round BINS + k throws everything into bin k, so every
coordinate fills. For large sets one round does; the share of equal coordinates is concentrated around the
similarity. BANDS x ROWS coordinates are compared: two sets of similarity 0.8 share no band with a
probability of (1 - 0.8^ROWS)^BANDS, 5e-8.

Classes that share a band are tested on their full sets, but not all pairs of a bucket: links only matter
between components. In a star round a bucket tests its members against one pivot; components are then
joined and members of one component need no test any more. What is left in several components after
STAR_ROUNDS is tested in full: members outside the bucket's largest component against all members of other
components, block by block inside the bucket: a task holds at most BLOCK strays and BLOCK members, counts shared
shingles through an index of the members, and gives out links only. So a group of many near copies costs a few
tests each and what strays from it a look at its bucket, and no link between components is lost.

NULL, empty and blank texts have an empty set and are linked with nothing. Rows with the same doc_id are one
document with several texts, each row is reported. Rows without doc_id are linked with nothing, have no
component and are kept. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.scale import cut_lineage, session_conf
from loomgraph.llm.common import texts, with_package
from loomgraph.llm.components import components

ROWS, BANDS = 4, 32
BINS = ROWS * BANDS
STAR_ROUNDS = 3
BLOCK = 500
PORTION = 2 << 20
MAX_REMEMBERED = 150_000
# Rows a Python worker and its executor hold at once. Texts are a few KB each, so the default of 10 000 is tens of MB, several times over.
BATCH_ROWS = 1_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MULTIPLY, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MULTIPLY
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.translate(LOWER).split()  # bytes.split takes exactly the white space of the word rule
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out + h[k:n + k] + GOLDEN)
    return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS coordinates per set that is not empty."""
    size = np.array([len(s) for s in sets])
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    empty = np.uint64((1 << 64) - 1)
    out = np.full(len(sets) * BINS, empty)
    for i in range(2 * BINS):
        h = mix(x + np.uint64(int(GOLDEN) * (i + 1) % (1 << 64)))
        bins = (h >> np.uint64(57)).astype(np.int64) if i < BINS else np.full(len(h), i - BINS)
        at = owner * BINS + bins
        open_ = out[at] == empty
        least = np.full(len(out), empty)
        np.minimum.at(least, at[open_], h[open_] & np.uint64((1 << 57) - 1))
        out = np.where(out == empty, least, out)
        unfilled = (out.reshape(-1, BINS) == empty).any(axis=1)
        if not unfilled.any():
            break
        go_on = unfilled[owner]
        x, owner = x[go_on], owner[go_on]
    return out.reshape(-1, BINS)


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    rows = sketches.reshape(len(sketches), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * GOLDEN + rows[:, :, k])
    return out.view(np.int64)


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= PORTION:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, digest, bands) per row; no digest and bands where the set is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = batch.column("text").cast(pa.binary())
            for start, stop in portions(pc.binary_length(rows).to_pylist()):
                sets = [shingle_set(t.as_py(), size, hashes) for t in rows[start:stop]]
                full = [s for s in sets if len(s)]
                bands = iter(band_hashes(sketch(full))) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[start:stop], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bands"])

    rows = with_package(texts(docs))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, digest binary, bands array<bigint>")


def confirmed(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. `held` has (c, text) for both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        set_of = lru_cache(64)(lambda t: shingle_set(t, size, hashes))
        for batch in batches:
            good = []
            for x, y in zip(*(batch.column(k).cast(pa.binary()) for k in ("ta", "tb"))):
                p, q = set_of(x.as_py()), set_of(y.as_py())
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = (with_package(pairs).join(held.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
            .join(held.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; a link is a similarity of at least `percent` of 100."""
    # every step that runs Python is written in here, in batches of BATCH_ROWS
    with session_conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        return linked(docs, shingle_words, percent)


def linked(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    rows = cut_lineage(sketched(docs, shingle_words))
    named = rows.where("doc_id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("c"))
    # Texts of one document in several classes are linked through its id: a class is known by its least doc_id.
    reps = named.join(classes, "digest").where("doc_id = c").select("c", "n", "bands").distinct()
    placed = reps.select("c", "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut_lineage(placed.join(shared.select("key"), "key"))
    wanted = members.select("c").distinct()
    held = cut_lineage(texts(docs).withColumnRenamed("doc_id", "c").join(wanted, "c", "left_semi"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    links, labels = same_document(named, classes), None

    def with_component() -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("c"))
        return members.join(labels.select(F.col("node").alias("c"), "root"), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("comp"))

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        links = links.unionByName(cut_lineage(found))
        labels = cut_lineage(components(links))

    for k in range(STAR_ROUNDS):
        now = with_component()
        # First the least class, which most buckets of a group share; then another one in every bucket.
        order = F.col("c") if k == 0 else F.xxhash64("c", "key", F.lit(k))
        pivots = (now.groupBy("key").agg(F.min_by(F.struct("c", "n", "comp"), order).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"))
                  .where("low <> high").select("key", "p"))
        pairs = (now.join(pivots, "key").where((F.col("comp") != F.col("p.comp")) & fits(F.col("n"), F.col("p.n")))
                 .select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b")).distinct())
        add(confirmed(pairs, held, shingle_words, percent))
    add(rest_of_buckets(with_component(), held, shingle_words, percent))

    root = labels.select(F.col("node").alias("c"), "root")
    by_class = classes.join(root, "c", "left").select("digest", F.coalesce("root", "c").alias("root"))
    found = rows.join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of documents that have several texts."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    return cut_lineage(named.join(several, "doc_id", "left_semi").join(classes, "digest").where("c <> doc_id")
                       .select(F.col("c").alias("a"), F.col("doc_id").alias("b")).distinct())


def rest_of_buckets(now: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, one of them outside the largest."""
    parts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = (parts.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("n_comps"),
                                        F.sum("size").alias("members"), (F.sum("size") - F.max("size")).alias("strays"))
               .where("n_comps > 1").drop("n_comps"))
    left = cut_lineage(now.join(largest, "key"))
    dealt = lambda n: F.pmod(F.xxhash64("c"), F.ceil(F.col(n) / BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1))
    strays = left.where("comp <> main").select("key", "c", "comp", F.lit(True).alias("stray"), dealt("strays").alias("row"), every("members").alias("col"))
    others = left.select("key", "c", "comp", F.lit(False).alias("stray"), every("strays").alias("row"), dealt("members").alias("col"))
    blocks = strays.unionByName(others).join(held, "c")

    def run(block: pa.Table) -> pa.Table:
        hashes = WordHashes()
        c, comp, stray = (block.column(k).to_numpy() for k in ("c", "comp", "stray"))
        sets = [shingle_set(t.as_py(), size, hashes) for t in block.column("text").cast(pa.binary())]
        n = np.array([len(s) for s in sets])
        there = np.flatnonzero(~stray)
        flat, owner = np.concatenate([sets[k] for k in there] or [np.zeros(0, np.uint64)]), np.repeat(there, n[there])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(stray):
            low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
            m = high - low
            shared = np.bincount(owner[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m - low, m)], minlength=len(n))
            good = np.flatnonzero((shared > 0) & (comp != comp[k]) & (100 * shared >= percent * (n + n[k] - shared)))
            a.append(np.full(len(good), c[k]))
            b.append(c[good])
        return pa.table({"a": np.concatenate(a or [c[:0]]), "b": np.concatenate(b or [c[:0]])})

    kind = now.schema["c"].dataType.simpleString()
    found = with_package(blocks.select("key", "row", "col", "c", "comp", "stray", "text")).groupBy("key", "row", "col").applyInArrow(run, f"a {kind}, b {kind}")
    return found.distinct()


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle_words=2, percent=80)


def one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, in their own columns, without those that have a near copy with a smaller doc_id in their component."""
    gone = near_duplicates(docs, shingle_words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
