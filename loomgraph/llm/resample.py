"""Target-distribution importance resampling: draw the documents that look most like a target collection.

Texts become hashed features (runs of 1 to 2 words). A feature bucket's gain says how much more often the
target has it than the corpus; a document's weight is the mean gain of its features, and a score adds Gumbel
noise that depends on the doc_id alone, so the highest scores are a draw without replacement.

Weights are scored from one array of gains that every task holds (BUCKETS numbers). The cutoff of the draw is
found without sorting the corpus: a mergeable quantile sketch proposes a bracket of scores, exact counts outside
it validate the bracket or widen it, and only the rows inside are sorted. Ranks of drawn rows come from a range
partitioning and the sizes of its partitions.

NULL and empty texts, and texts without a word, have no features and weight 0; repeated rows count again, with
equal scores; rows with an equal score and doc_id are drawn fewer features first; rows without doc_id count in
the statistics but have no score and are never drawn (and are not among the N documents); with no document of
LEAST_WORDS words, or too few of them for one draw, nothing is drawn; an empty target has T = 0 and every t = 0;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.scale import cut_lineage
from loomgraph.llm.common import with_package

BUCKETS, SCALE = 10_000, 1000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
# Rank error of the sketch as a share of the rows; the bracket reaches twice as far to both sides at first.
SKETCH_ERROR = 1e-3
# Bytes of a text that are taken apart at once.
SEGMENT = 1 << 20
# A-Z become a-z; every other ASCII character that is neither digit nor lower-case letter parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time (a word is never cut)."""
    data, start = text.translate(FOLD), 0
    while start < len(data):
        stop = data.find(b" ", start + SEGMENT) if start + SEGMENT < len(data) else len(data)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def feature_buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) per segment; checksums of pairs go on from the first word's."""
    open_pair = None  # checksum of the last word of the segment before, with the space behind it
    for words in segments(text):
        if not words:
            continue
        single = list(map(crc32, words))
        before = [crc32(b" ", c) for c in single]
        pairs = list(map(crc32, words[1:], before))
        if open_pair is not None:
            pairs.append(crc32(words[0], open_pair))
        open_pair = before[-1]
        yield len(words), np.array(single + pairs, dtype=np.int64) % BUCKETS


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) over all texts; a task sends one row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                for _, found in feature_buckets(text.as_py()):
                    total += np.bincount(found, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = with_package(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    return rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """One gain per bucket. The driver gets BUCKETS counts of each side at most."""
    def counted(df: DataFrame) -> list[int]:
        n = [0] * BUCKETS
        for r in bucket_counts(df).toLocalIterator():
            n[r.bucket] = r.n
        return n

    s, t = counted(docs), counted(target)
    total_s, total_t = sum(s) + BUCKETS, sum(t) + BUCKETS
    return np.array([math.floor(SCALE * math.log(float(b + 1) * float(total_s) / (float(a + 1) * float(total_t)))) for a, b in zip(s, t)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean of the gains of its features."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = held.value
        for batch in batches:
            out = [[], [], []]
            for text in batch.column("text").cast(pa.binary()):
                n_words = n_features = total = 0
                for words, found in feature_buckets(text.as_py()):
                    n_words, n_features, total = n_words + words, n_features + len(found), total + int(by_bucket[found].sum())
                for o, v in zip(out, (n_words, n_features, total // n_features if n_features else 0)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(o, pa.int64()) for o in out]], ["doc_id", "n_words", "n_features", "weight"])

    rows = with_package(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from a digest of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32)))))


def bracket(scores: DataFrame, n: int, k: int) -> tuple[int, int, int]:
    """(low, high, above): exactly `above` < k rows score over `high`, and the k-th highest is in [low, high].

    The sketch is a mergeable summary per task. Exact counts decide; a bracket that misses the k-th
    highest is widened on the side it misses, doubling its reach there, at last to all scores.
    """
    below = above = 2 * SKETCH_ERROR
    while True:
        share = 1 - k / n
        at = [min(max(share - below, 0.0), 1.0), min(max(share + above, 0.0), 1.0)]
        (low, high), least, most = scores.agg(F.percentile_approx("score", at, int(1 / SKETCH_ERROR)), F.min("score"), F.max("score")).first()
        low, high = (least if at[0] <= 0 else low), (most if at[1] >= 1 else high)
        over, inside = scores.agg(F.sum((F.col("score") > high).cast("long")), F.sum(F.col("score").between(low, high).cast("long"))).first()
        if over < k <= over + inside:
            return low, high, over
        below, above = (below, 2 * above) if over >= k else (2 * below, above)


def ranked(rows: DataFrame, out: str) -> DataFrame:
    """Rows with their place 1, 2, 3, ... by falling score, then doc_id, then n_features.

    Rows are dealt by range and sorted in their partition; the sizes of the partitions before (one number
    each) are added. The ranges are written, so places cannot shift when an executor is lost.
    """
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    local = F.monotonically_increasing_id()
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__at", local).withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}))
    spark, before, offsets = rows.sparkSession, 0, []
    for r in placed.groupBy("__part").agg(F.max("__at").alias("last")).sort("__part").collect():  # one row per partition
        offsets.append((r["__part"], before))
        before += r["last"] + 1
    shift = spark.createDataFrame(offsets, "__part bigint, __before bigint")
    return placed.join(F.broadcast(shift), "__part").withColumn(out, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of a written table (doc_id, n_words, n_features, weight, score) with `rank`, NULL where not drawn."""
    fit = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    n = fit.count()
    k = percent * n // 100
    if k == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    low, high, above = bracket(fit, n, k)
    inside = ranked(fit.where(F.col("score").between(low, high)), "place")
    cut = inside.where(F.col("place") == k - above).select("score", "doc_id", "n_features").first()
    upto = (F.col("score") > cut.score) | (F.col("score") == cut.score) & (
        (F.col("doc_id") < cut.doc_id) | (F.col("doc_id") == cut.doc_id) & (F.col("n_features") <= cut.n_features))
    drawn = F.coalesce((F.col("n_words") >= least_words) & upto, F.lit(False))
    # Repeated rows may stand on both sides of the cutoff: they are equal, so any k of them do.
    top = ranked(scored.where(drawn), "place").withColumn("rank", F.when(F.col("place") <= k, F.col("place"))).drop("place")
    return top.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def score(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, as a written table."""
    return cut_lineage(weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return draw(score(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
