"""Secret scans: known shapes, and windows of high Shannon entropy in candidate strings.

Base kinds (assign, access, hex) follow fixed patterns. The added kind `entropy` takes maximal runs of
key-like characters, classifies each by the characters it holds, and slides a window over it. The sum
of c * log2 c over the window's character counts is updated by the character that enters and the one
that leaves; it is kept in whole millionths, so the sum is exact however long the run is. A run is
reported when some window reaches the entropy its class needs and no allow-list rule covers it. The
allow list suppresses added spans only. Columns and SQL functions only.

NULL and empty texts have no spans; repeated rows give repeated rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import let, sha256_hex, spans, texts

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
# A class is the first whose pattern the whole run fits; the number is the entropy, in bits per character, a window must reach.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", 3.4),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", 3.4),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.7),
]
# Runs that look like keys and are none.
ALLOW = [
    r"(?i)example|sample|dummy|placeholder|test_?key|your[_-]",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"0123456789|(?i:abcdefghij)",
    r"^/?(?:[A-Za-z_-]+/)+[A-Za-z0-9_-]*$",
]
UNIT = 1_000_000
#: c * log2 c in millionths, for 0 to WINDOW.
WEIGHT = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]


def most_weight(bits: float) -> int:
    """Largest weighted sum at which a window still has that entropy: H = log2 w - sum / w."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


def least_sum(run: Column) -> Column:
    """Least weighted sum over the windows of a run, that is, where its entropy is highest."""
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHT])

    def slide(cs: Column, ws: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(cs, i), F.get(cs, i - WINDOW)

            def after_leaving(a: Column) -> Column:
                n = F.get(a["counts"], leaves)
                return F.struct((a["total"] - F.get(ws, n) + F.get(ws, n - 1)).alias("total"),
                                F.transform(a["counts"], lambda c, k: F.when(k == leaves, c - 1).otherwise(c)).alias("counts"), a["best"].alias("best"))

            def after_entering(a: Column) -> Column:
                n = F.get(a["counts"], enters)
                return let(a["total"] - F.get(ws, n) + F.get(ws, n + 1), lambda total: F.struct(
                    total.alias("total"), F.transform(a["counts"], lambda c, k: F.when(k == enters, c + 1).otherwise(c)).alias("counts"),
                    F.when(i >= WINDOW - 1, F.least(a["best"], total)).otherwise(a["best"]).alias("best")))

            return let(F.when(i >= WINDOW, after_leaving(acc)).otherwise(acc), after_entering)

        start = F.struct(F.lit(0).cast("long").alias("total"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(1 << 60).cast("long").alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, step)["best"]

    letters = F.filter(F.split(run, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(codes, lambda cs: let(weights, lambda ws: slide(cs, ws)))


def dense(run: Column) -> Column:
    """Whether a candidate run holds a window of high entropy for its class."""
    limit = F.lit(-1).cast("long")
    for _, pattern, bits in reversed(CLASSES):
        limit = F.when(run.rlike(pattern), F.lit(most_weight(bits)).cast("long")).otherwise(limit)
    return let(limit, lambda m: F.when(m >= 0, least_sum(run) <= m).otherwise(F.lit(False)))


def allowed(run: Column) -> Column:
    found = F.lit(False)
    for pattern in ALLOW:
        found = found | run.rlike(pattern)
    return found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and, per kind, an array column of spans."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint,hit:string>>")
    text = F.col("text")
    assign = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6)
    candidates = F.filter(spans(text, CANDIDATE), lambda s: s["hit"].rlike("[0-9]") & ~allowed(s["hit"]) & dense(s["hit"]))
    has_digit = text.rlike("[0-9]")
    return texts(docs).select(
        "doc_id", "text",
        F.when(text.rlike("[:=]"), assign).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS)).otherwise(none).alias("access"),
        spans(text, HEX).alias("hex"),
        F.when(has_digit, candidates).otherwise(none).alias("entropy"))


def joined(kinds: list[str]) -> Column:
    """Spans as text, by start, then by the order of the kinds."""
    def ranked(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    marks = F.flatten(F.array(*[ranked(k) for k in kinds]))
    return F.concat_ws(",", F.transform(F.array_sort(marks), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["stop"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the spans as text, and a digest of the base spans."""
    return find(docs).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                             sha256_hex(joined(KINDS[:3])).alias("base_sha256"), joined(KINDS).alias("spans"))
