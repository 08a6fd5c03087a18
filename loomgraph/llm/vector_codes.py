"""Vector codes: every vector becomes a few code book indexes, one for each of its parts.

Components become integers floor(SCALE * x), so all sums and distances are exact and the result doesn't depend
on how rows are dealt. A vector is cut into PARTS consecutive parts, each with its own code book, which starts
with the parts of the smallest vec_ids and moves to the floored means of what is assigned to it, ROUNDS times.

Distinct parts are counted once and written in lexicographic order, so a task's parts are the leaves of a trie
over their components. The trie is walked depth first, a piece of its leaves at a time: a node holds the squared
distances between the components on its path and those of all entries, and a child adds one component to its
parent's vector, so parts with a common beginning share that work. A leaf takes the nearest entry (lower index
first) and adds its components, as often as it occurs, to the entry's sum. A round moves ENTRIES sums per part
and task; the driver holds the code books (PARTS * ENTRIES parts).

Dropped are rows whose vector is NULL, empty, or holds NULL or non-finite components; so are vectors with
a component of MOST or more in size, whose squares don't fit, and vectors whose length isn't that of the vector
with the smallest vec_id. A length that PARTS doesn't divide is filled up with zeros. Rows with NULL vec_id are
coded like others and come last in the order of ids; repeated ids count each, ordered by components; repeated
rows give repeated rows. With fewer vectors than ENTRIES the code books are smaller; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.scale import cut_lineage
from loomgraph.llm.common import with_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = float(1 << 16)  # components below it become integers below 2**26
LEAVES = 512
# Error sums per label are sent to every task up to this many, counted first; more are joined by a shuffle.
MAX_BROADCAST_LABELS = 1_000_000


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector array<int>) of rows that have a code."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False)))  # NaN is above every number
    return (vectors.select("vec_id", "label", x.alias("embedding")).where(F.coalesce(fit & (F.size("embedding") > 0), F.lit(False)))
            .select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("int")).alias("vector")))


def prepared(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows of one length, and the code books to start with, int64[part, entry, place]. The driver gets ENTRIES vectors."""
    held = whole_numbers(vectors)
    first = held.sort(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES)
    lead = first.select(F.size("vector")).first()
    size = lead[0] if lead else PARTS
    rows = held.where(F.size("vector") == size)
    width = -(-size // PARTS)
    filled = F.concat("vector", F.array_repeat(F.lit(0), PARTS * width - size)) if PARTS * width > size else F.col("vector")
    rows = rows.withColumn("vector", filled)
    start = [r.vector for r in rows.sort(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()]
    return rows, np.array(start, dtype=np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of parts in lexicographic order, by their trie."""
    entry, distance = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    reach = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * reach * reach * parts.shape[1] < 1 << 31 else np.int64
    book = book.astype(kind)
    for start in range(0, len(parts), LEAVES):
        some = parts[start:start + LEAVES].astype(kind)
        fresh = np.zeros(len(some), dtype=bool)  # the leaf's path differs from that of the leaf before
        fresh[0] = True
        node = np.zeros(len(some), dtype=np.int64)
        sums = np.zeros((1, len(book)), dtype=kind)
        for depth in range(parts.shape[1]):
            component = some[:, depth]
            fresh[1:] |= component[1:] != component[:-1]
            heads = np.flatnonzero(fresh)
            step = component[heads, None] - book[None, :, depth]
            step *= step
            step += sums[node[heads]] if len(heads) > len(sums) else sums  # as many nodes as before: the same ones
            sums, node = step, np.cumsum(fresh) - 1
        best = sums.argmin(axis=1)
        entry[start:start + LEAVES] = best[node]
        distance[start:start + LEAVES] = sums[np.arange(len(best)), best][node]
    return entry, distance


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def distinct_parts(rows: DataFrame, width: int) -> DataFrame:
    """(part, piece, n): how often a part holds these components, written in lexicographic order per partition."""
    pieces = F.array(*[F.slice("vector", p * width + 1, width) for p in range(PARTS)])
    counted = rows.select(F.posexplode(pieces).alias("part", "piece")).groupBy("part", "piece").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.sortWithinPartitions("part", "piece"))


def moved(counted: DataFrame, books: np.ndarray) -> np.ndarray:
    """The code books after one round."""
    shape = books.shape
    held = counted.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, uses = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            values = matrix(batch.column("piece"), shape[2])
            for p in np.unique(part):
                at = part == p
                entry, _ = nearest(values[at], held.value[p])
                np.add.at(totals[p], entry, values[at] * n[at, None])
                np.add.at(uses[p], entry, n[at])
        p, e = np.nonzero(uses)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * shape[2], pa.int32()), pa.array(totals[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(uses[p, e]), sums], ["part", "entry", "n", "sums"])

    found = with_package(counted).mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    out = books.copy()
    columns = [F.sum(F.col("sums")[k]) for k in range(shape[2])]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*columns).alias("sums")).collect():
        out[r.part, r.entry] = np.array(r.sums, dtype=np.int64) // r.n
    return out


def train(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Code books after some rounds over the prepared rows."""
    if not books.shape[1]:
        return books
    counted = distinct_parts(rows, books.shape[2])
    for _ in range(rounds):
        books = moved(counted, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code array<int>, error) of prepared rows. A batch's distinct parts make a trie."""
    width = books.shape[2]
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector"), PARTS * width)
            codes, error = np.empty((len(batch), PARTS), dtype=np.int32), np.zeros(len(batch), dtype=np.int64)
            for p in range(PARTS):
                values = vectors[:, p * width:(p + 1) * width]
                order = np.lexsort(values.T[::-1])
                codes[order, p], distance = nearest(values[order], held.value[p])
                error[order] += distance
            offsets = pa.array(np.arange(len(batch) + 1) * PARTS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1))), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return with_package(rows.where(F.lit(books.shape[1] > 0))).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error bigint")


def decode(coded: DataFrame, books: np.ndarray, size: int | None = None) -> DataFrame:
    """(vec_id, vector array<double>): what the codes stand for, up to the step 1 / SCALE."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    whole = F.flatten(F.transform("code", lambda e, p: entries[p][e]))
    vector = F.slice(whole, 1, size) if size else whole
    return coded.select("vec_id", F.transform(vector, lambda x: x / SCALE).alias("vector"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """Codes as hex digits, errors, and the error summed over equal labels (NULL labels together)."""
    rows, start = prepared(vectors)
    rows = cut_lineage(rows)
    books = train(rows, start)
    coded = cut_lineage(encode(rows, books).select(
        "vec_id", "label", F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "").alias("code"), "error"))
    by_label = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "__label")
    side = F.broadcast(by_label) if by_label.count() <= MAX_BROADCAST_LABELS else by_label
    return (coded.join(side, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
