"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) are always reported when their own rule holds. Two kinds are
added: `iban` (mod 97) and `ssn`, which has no checksum and so needs a score from its context.
Columns and SQL functions only.

A guard such as `(?:(?<![0-9])|\\G)` lets a search start only where a run starts (or where the last
match ended): the matches are the same, but a very long run is read once, not once per position.

NULL and empty texts have no spans; repeated rows give repeated rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import labelled, let, running, sha256_hex, spans, texts

LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
# Scores, in hundredths: of a kind that passed its own rule, and what a context word adds.
PRIOR = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 95, "ssn": 30}
CONTEXT = {
    "email": ["mail", "contact"], "ip": ["address", "host", "server"], "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "call", "tel", "fax"], "iban": ["iban", "account", "bank"], "ssn": ["ssn", "social", "security"],
}
CONTEXT_GAIN, CONTEXT_REACH, ADDED_MIN = 40, 40, 70


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def total(ds: Column) -> Column:
        value = F.transform(ds, lambda d, i: let(d.cast("int"), lambda v: F.when(i % 2 == 0, v).otherwise(
            F.when(v > 4, 2 * v - 9).otherwise(2 * v))))
        return F.aggregate(value, F.lit(0), lambda s, x: s + x)
    return let(F.split(F.reverse(digits), ""), total) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without blanks passes the mod-97 check."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    step = lambda acc, v: F.when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97)
    value = lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, ch: step(acc, value(ch))) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return luhn(F.regexp_replace(hit, r"[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(hit, r"[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, r"\x20", ""))
    return F.lit(True)


# A text without this cannot hold the kind, and its pattern isn't run.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def scored(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind as array<struct<start, stop, hit, score>>."""
    words = "|".join(CONTEXT[kind])

    def score(t: Column, s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT_REACH, F.lit(0))
        near = F.concat_ws(" ", F.substr(t, (first + 1).cast("int"), (s["start"] - first).cast("int")),
                           F.substr(t, (s["stop"] + 1).cast("int"), F.lit(CONTEXT_REACH)))
        return F.least(F.lit(100), F.lit(PRIOR[kind]) + F.when(near.rlike(rf"(?i)\b(?:{words})\b"), CONTEXT_GAIN).otherwise(0))

    def of(t: Column) -> Column:
        good = F.filter(spans(t, PATTERNS[kind]), lambda s: confirmed(kind, s["hit"]))
        with_score = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["hit"].alias("hit"),
                                                          score(t, s).alias("score")))
        return with_score if kind in BASE else F.filter(with_score, lambda s: s["score"] >= ADDED_MIN)

    none = F.array().cast("array<struct<start:bigint,stop:bigint,hit:string,score:int>>")
    if kind in NEEDS:
        return F.when(F.contains(text, F.lit(NEEDS[kind])), let(text, of)).otherwise(none)
    return F.when(text.rlike("[0-9]"), let(text, of)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and, per kind, an array column of scored spans."""
    return texts(docs).select("doc_id", "text", *[scored(k, F.col("text")).alias(k) for k in KINDS])


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the spans as text, and a digest of the base spans."""
    found = find(docs)

    def joined(kinds: list[str]) -> Column:
        return F.concat_ws(",", F.flatten(F.array(*[labelled(k, F.col(k)) for k in kinds])))

    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        sha256_hex(joined(BASE)).alias("base_sha256"), joined(KINDS).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, with every span replaced by its kind in brackets.

    Overlapping spans are merged and take the kind that starts first. The text is cut at the borders
    of the merged spans and joined again. A NULL text becomes an empty one.
    """
    own = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc_id"), F.col("text"))
    found = find(keyed).withColumnRenamed("doc_id", "__doc")

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    marks = F.array_sort(F.flatten(F.array(*[named(k) for k in KINDS])))
    return (found.select("__doc", "text", marks.alias("__m"))
            .select(*[(redacted(F.col("text"), F.col("__m")) if c == "text" else F.col(f"__doc.`{c}`")).alias(c) for c in own]))


def redacted(text: Column, marks: Column) -> Column:
    """A text with sorted marks replaced."""
    def cut(t: Column, ms: Column) -> Column:
        reach = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(ms, lambda m: m["stop"]), lambda a, b: F.greatest(a, b)))

        def pieces(rs: Column) -> Column:
            between = F.transform(ms, lambda m, i: F.concat(
                F.when(m["start"] > F.get(rs, i), F.substr(t, (F.get(rs, i) + 1).cast("int"), (m["start"] - F.get(rs, i)).cast("int"))).otherwise(F.lit("")),
                F.when((i == 0) | (m["start"] >= F.get(rs, i)), F.concat(F.lit("["), m["kind"], F.lit("]"))).otherwise(F.lit(""))))
            return F.concat(F.concat_ws("", between), F.substr(t, (F.element_at(rs, -1) + 1).cast("int")))

        return let(reach, pieces)

    return F.when(F.size(marks) == 0, text).otherwise(let(text, lambda t: let(marks, lambda ms: cut(t, ms))))
