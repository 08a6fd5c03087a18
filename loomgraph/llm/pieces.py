"""Super-k-mers: runs of windows that share a minimiser, cut out as one piece.

Equal windows have the same minimiser at the same offset, so every repeat of a window meets in the bucket of
its minimiser. A minimiser that occurs once cannot belong to a repeat. The others are marked in a filter of fixed
size that every task holds; pieces it doesn't know never travel. Where it takes a minimiser for a marked one, the
piece travels in vain and meets nobody: results never depend on the filter, only the volume does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.scale import cut_lineage
from loomgraph.llm.common import let, with_package
from loomgraph.llm.minhash import mix

# 64-bit blocks of the filter of shared minimisers (16 MB). Beyond some 50 million marks it lets most pieces pass.
BLOCKS = 1 << 21
# Crowded minimisers are sent to every task up to this many, counted first; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000
# A bucket with more pieces is taken apart: equal pieces are merged and windows travel by their own content.
SPLIT_AT = 256
# Pieces of a crowded bucket that go to one task, about: larger groups of equal pieces are dealt to several.
DEALT = 2048
# Equal pieces of which more occurrences are found get their windows by a broadcast, while such names are few.
HOT_NAME, MAX_HOT_NAMES = 2048, 100_000
# Windows worked on at once; longer texts are taken in overlapping segments.
SEGMENT = 1 << 20
OFFSET_BITS = 21


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of `width` values, the leftmost among equals."""
    packed = (h >> np.uint64(OFFSET_BITS) << np.uint64(OFFSET_BITS)) | np.arange(len(h), dtype=np.uint64)
    reach, least = 1, packed
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[:len(h) - width + 1], least[width - reach:])
    return (least & np.uint64((1 << OFFSET_BITS) - 1)).astype(np.int64)


def runs(h: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, minimiser hash, minimiser place) of the runs, per segment of a text.

    `h` are the hashes of the text's grams, `width` the grams in a window.
    """
    total = len(h) - width + 1
    for begin in range(0, max(total, 0), SEGMENT):
        part = h[begin:min(begin + SEGMENT, total) + width - 1]
        at = least_in_windows(part, width)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(first, len(at)))
        yield first + begin, size, part[at[first]], at[first] + begin


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text) of rows that have an id; `tid` tells texts of one id apart."""
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
            .withColumn("tid", F.xxhash64("text")))


def minimisers(docs: DataFrame, grams: Callable[[], Callable[[bytes], np.ndarray]], width: int) -> DataFrame:
    """(doc_id, key, n): how often a document's runs have a minimiser."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = grams()
        for batch in batches:
            keys, counts, sizes = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = [k for _, _, k, _ in runs(hashed(text.as_py()), width)]
                key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                keys.append(key.view(np.int64))
                counts.append(n)
                sizes.append(len(key))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            flat = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.ListArray.from_arrays(offsets, f) for f in flat]], ["doc_id", "keys", "counts"])

    rows = with_package(docs.select("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, keys array<bigint>, counts array<bigint>")
    return found.select("doc_id", F.explode(F.arrays_zip("keys", "counts")).alias("m")).select("doc_id", F.col("m.keys").alias("key"), F.col("m.counts").alias("n"))


def marks(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and two bits in it for every key."""
    h = mix(keys.astype(np.uint64))
    one = np.uint64(1)
    bits = (one << (h >> np.uint64(40) & np.uint64(63))) | (one << (h >> np.uint64(50) & np.uint64(63)))
    return (h % np.uint64(blocks)).astype(np.int64), bits


def marked(keys: DataFrame) -> np.ndarray:
    """The filter over a table of keys: filled per task, joined by block. The driver gets BLOCKS numbers at most."""
    blocks = BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(blocks, dtype=np.uint64)
        for batch in batches:
            np.bitwise_or.at(field, *marks(batch.column("key").to_numpy().view(np.uint64), blocks))
        held = np.flatnonzero(field)
        for start in range(0, len(held), 1 << 16):
            some = held[start:start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(field[some].view(np.int64))], ["block", "bits"])

    found = with_package(keys.select("key")).mapInArrow(run, "block bigint, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(blocks, dtype=np.uint64)
    field[found.column("block").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return field


def shared_keys(found: DataFrame, shared: Column) -> tuple[np.ndarray, DataFrame]:
    """The filter of minimisers that may belong to a repeat, and the crowded ones as (key, parts).

    `parts` is over how many tasks equal pieces of a crowded bucket may be dealt.
    """
    counted = found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"))
    keys = cut_lineage(counted.select("key", "n", shared.alias("shared")).where(F.col("shared") | (F.col("n") > SPLIT_AT)))
    crowded = keys.where(F.col("n") > SPLIT_AT).select("key", F.ceil(F.col("n") / DEALT).cast("int").alias("parts"))
    return marked(keys.where("shared")), F.broadcast(crowded) if crowded.count() <= MAX_BROADCAST_KEYS else crowded


def cut(docs: DataFrame, grams: Callable[[], Callable[[bytes], np.ndarray]], width: int, piece_of: Callable[[bytes], Callable[[int, int], bytes]],
        shared: tuple[np.ndarray, DataFrame]) -> DataFrame:
    """(key, doc_id, tid, start, size, offset, piece, parts): the runs with a shared minimiser; `parts` is NULL where its bucket isn't crowded.

    `start` is the first window of the run, `size` the number of windows, `offset` how far the minimiser lies behind
    `start`, `piece` what the windows cover.
    """
    field, crowded = shared
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = grams()
        for batch in batches:
            row, out = [], [[], [], [], [], []]

            def done() -> pa.RecordBatch:
                at = pa.array(np.concatenate(row) if row else [], pa.int64())
                key, start, count, offset, piece = out
                made = [pa.array(np.concatenate(key).view(np.int64) if key else [], pa.int64()), batch.column("doc_id").take(at), batch.column("tid").take(at),
                        *[pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (start, count, offset)], pa.array(piece, pa.binary())]
                row.clear()
                out[:] = [[], [], [], [], []]
                return pa.RecordBatch.from_arrays(made, ["key", "doc_id", "tid", "start", "size", "offset", "piece"])

            total = 0
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                data = text.as_py()
                slice_of = None
                for first, size, key, place in runs(hashed(data), width):
                    block, bits = marks(key, len(known.value))
                    keep = known.value[block] & bits == bits
                    if not keep.any():
                        continue
                    first, size, key, place = first[keep], size[keep], key[keep], place[keep]
                    slice_of = slice_of or piece_of(data)
                    row.append(np.full(len(first), k))
                    out[0].append(key)
                    out[1].append(first)
                    out[2].append(size)
                    out[3].append(place - first)
                    out[4] += [slice_of(a, n) for a, n in zip(first.tolist(), size.tolist())]
                total += len(data)
                if total >= SEGMENT:
                    yield done()
                    total = 0
            yield done()

    rows = with_package(docs.select("doc_id", "tid", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key bigint, doc_id {kind}, tid bigint, start bigint, size bigint, offset bigint, piece binary").join(crowded, "key", "left")


def settled(found: DataFrame, repeats: Callable[[pa.Table], pa.Table], rows_at_once: int) -> DataFrame:
    """All pieces after one exchange, as a written table of three kinds of rows.

    Pieces of a bucket meet in one task, where `repeats` gives flagged runs of windows (doc_id, tid, first, last, span).
    Pieces of a crowded bucket are dealt by content, large groups of equal ones over several tasks; there equal
    ones are merged: (s1, s2, size, piece, low, times) per distinct piece and task, and (s1, s2, doc_id, tid, first)
    per occurrence, without its content. (s1, s2) names content, windows and place of the minimiser in 128 bits.
    """
    kind = found.schema["doc_id"].dataType.simpleString()
    crowded = F.col("parts").isNotNull()
    name = {"s1": F.when(crowded, F.xxhash64("piece", "offset", "size")), "s2": F.when(crowded, F.xxhash64("size", "offset", F.lit(7), "piece"))}
    deal = F.when(crowded, F.xxhash64(F.xxhash64("piece", "offset", "size"), F.pmod(F.xxhash64("doc_id", "tid", "start"), F.coalesce("parts", F.lit(1))))).otherwise(F.col("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bucket_groups(batches, rows_at_once):
            doc, whole = table.schema.field("doc_id").type, pc.is_null(table.column("s1"))
            plain = table.filter(whole)
            if len(plain):
                yield padded(repeats(plain), doc)
            apart = table.filter(pc.invert(whole))
            if len(apart):
                yield padded(apart.select(["s1", "s2", "doc_id", "tid"]).append_column("first", apart.column("start")), doc)
                merged = apart.group_by(["s1", "s2", "size", "piece"]).aggregate([("doc_id", "min"), ("doc_id", "count")])
                yield padded(merged.select(["s1", "s2", "size", "piece", "doc_id_min", "doc_id_count"]).rename_columns(["s1", "s2", "size", "piece", "low", "times"]), doc)

    rows = found.select(deal.alias("key"), "doc_id", "tid", "start", "size", "offset", "piece", *[c.alias(k) for k, c in name.items()])
    dealt = with_package(rows.repartition("key").sortWithinPartitions("key"))
    return cut_lineage(dealt.mapInArrow(run, f"doc_id {kind}, tid bigint, first bigint, last bigint, span bigint, s1 bigint, s2 bigint, size bigint, piece binary, low {kind}, times bigint"))


def padded(rows: pa.Table, doc: pa.DataType) -> pa.RecordBatch:
    """Rows in the columns of the settled table, NULL where they have none."""
    long = pa.int64()
    kinds = {"doc_id": doc, "tid": long, "first": long, "last": long, "span": long, "s1": long, "s2": long, "size": long, "piece": pa.binary(), "low": doc, "times": long}
    schema = pa.schema(list(kinds.items()))
    held = {c: rows.column(c) for c in rows.schema.names}
    made = pa.table([held[c].cast(t) if c in held else pa.nulls(rows.num_rows, t) for c, t in kinds.items()], schema=schema).combine_chunks().to_batches()
    return made[0] if made else pa.RecordBatch.from_pylist([], schema)


def plain_hits(table: DataFrame) -> DataFrame:
    """Flagged runs of windows of the buckets that were sorted whole."""
    return table.where("last is not null").select("doc_id", "tid", "first", "last", "span")


def distinct_pieces(table: DataFrame) -> DataFrame:
    """(s1, s2, size, piece, low, times) of the crowded buckets, each piece once."""
    return table.where("times is not null").groupBy("s1", "s2", "size", "piece").agg(F.min("low").alias("low"), F.sum("times").alias("times"))


def at_occurrences(table: DataFrame, listed: DataFrame) -> DataFrame:
    """Occurrences of the crowded buckets' pieces with what `listed` (s1, s2, times, ...) says of the piece.

    A name with very many occurrences would be one hot key: such names are few, and are sent to all tasks once counted.
    """
    seen = table.where("last is null and times is null").select("s1", "s2", "doc_id", "tid", F.col("first").alias("start"))
    listed = cut_lineage(listed)
    hot = listed.where(F.col("times") > HOT_NAME)
    if not 0 < hot.count() <= MAX_HOT_NAMES:
        return seen.join(listed, ["s1", "s2"])
    hot = F.broadcast(hot)
    rest = seen.join(F.broadcast(hot.select("s1", "s2")), ["s1", "s2"], "left_anti").join(listed.where(F.col("times") <= HOT_NAME), ["s1", "s2"])
    return seen.join(hot, ["s1", "s2"]).unionByName(rest)


def as_runs(hits: Column) -> Column:
    """Whole numbers of an array as runs (first, last) of consecutive ones."""
    def of(h: Column) -> Column:
        heads = F.filter(h, lambda x, k: F.coalesce(F.get(h, k - 1) != x - 1, F.lit(True)))
        tails = F.filter(h, lambda x, k: F.coalesce(F.get(h, k + 1) != x + 1, F.lit(True)))
        return F.transform(F.arrays_zip(heads.alias("first"), tails.alias("last")), lambda z: F.struct(
            z["first"].cast("long").alias("first"), z["last"].cast("long").alias("last")))

    return let(F.sort_array(hits), of)


def flagged_runs(table: pa.Table, flags: np.ndarray, span: int) -> pa.Table:
    """Rows (doc_id, tid, first, last, span) of consecutive flagged windows of `span` symbols; a piece has as many flags as windows."""
    n = table.column("size").to_numpy()
    begin = np.cumsum(n) - n
    bounds = np.zeros(len(flags) + 1, dtype=bool)
    bounds[begin] = True  # a run ends with its piece
    edge = np.concatenate([flags, [False]])
    first = np.flatnonzero(edge & (bounds | ~np.concatenate([[False], edge[:-1]])))
    last = np.flatnonzero(edge & (np.concatenate([bounds[1:], [True]]) | ~np.concatenate([edge[1:], [False]])))
    row = np.searchsorted(begin, first, "right") - 1
    shift = table.column("start").to_numpy()[row] - begin[row]
    at = pa.array(row)
    return pa.table([table.column("doc_id").take(at), table.column("tid").take(at), pa.array(first + shift), pa.array(last + shift), pa.array(np.full(len(first), span))],
                    names=["doc_id", "tid", "first", "last", "span"])


def per_document(hits: DataFrame) -> DataFrame:
    """(doc_id, tid, runs): all flagged runs of windows of a text."""
    return hits.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("first", "last", "span")).alias("runs"))


def bucket_groups(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.Table]:
    """Rows that come sorted by `key`, as tables of whole buckets with about `enough` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= enough:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1], "left")) if key[0] != key[-1] else 0
            if end:
                yield table.slice(0, end)
            rest = table.slice(end)
            held, rows = rest.combine_chunks().to_batches(), len(rest)
    if rows:
        yield pa.Table.from_batches(held)
