"""Quality rules as a ledger of failure bits.

Every rule runs once per document. The ledger keeps what was measured and one bit per failed
rule; a policy is a named mask over the bits, so a verdict, a new policy version or an ablation
reads the ledger and never the texts.

NULL and empty texts have no words and fail `few_words`; repeated rows give repeated rows; an
empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import WORD, let, texts

# Bits of the ledger, in order; a new rule takes the next bit, none is given twice.
RULES = ["few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "word_length"]
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ["few_words", "repeated_words"]
POLICIES = {
    "base": BASE,
    "v1": [*BASE, "symbols", "repeated_lines"],
    "v2": [*BASE, "symbols", "repeated_lines", "capitals", "word_length"],
}
CURRENT = "v2"
# Thresholds, in percent (of words, lines or characters of words) or characters per word.
MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS, MAX_LINES, MAX_CAPITALS, WORD_LENGTHS = 50, 50, 30, 50, 50, (2, 20)


PLACE_BITS = 24


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    The windows are sorted by hash, those with an equal neighbour are marked, and the union of the marked
    windows is measured from their sorted places: n log n, without a shuffle. Hash and place share one long,
    which sorts fast. A text in which two different windows share a hash, or with too many words for the
    place bits, is counted from windows sorted by their words.
    """
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    digest = lambda x: F.shiftright(x, PLACE_BITS)

    def covered(places: Column) -> Column:
        at = F.sort_array(places)
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    def with_equal_neighbour(s: Column, key) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(key(x) == key(F.get(s, k + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, k - 1)), F.lit(False)))

    def by_words(ws: Column) -> Column:
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(
            F.array(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.cast("long").alias("i"))))
        return let(windows, lambda s: covered(F.transform(with_equal_neighbour(s, lambda x: x["w"]), lambda x: x["i"])))

    def by_hash(ws: Column) -> Column:
        packed = F.sort_array(F.transform(F.slice(ws, F.lit(1), F.size(ws) - 2), lambda w, i: F.shiftleft(
            F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))))

        def checked(twins: Column) -> Column:
            def clash(x: Column, y: Column) -> Column:
                same = F.lit(True)
                for k in range(3):
                    same = same & (F.get(ws, (place(x) + k).cast("int")) == F.get(ws, (place(y) + k).cast("int")))
                return (digest(x) == digest(y)) & ~same

            clashes = F.filter(twins, lambda x, k: F.coalesce(clash(x, F.get(twins, k + 1)), F.lit(False)))
            return F.when(F.size(clashes) > 0, by_words(ws)).otherwise(covered(F.transform(twins, place)))

        return let(packed, lambda s: let(with_equal_neighbour(s, digest), checked))

    return let(words, lambda ws: F.when(F.size(ws) < 4, F.lit(0).cast("long")).when(F.size(ws) >= 1 << PLACE_BITS, by_words(ws)).otherwise(by_hash(ws)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and `bits`, one row per document."""
    text = F.col("text")
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    per_line = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.size(F.array_distinct(ls)).cast("long").alias("n_own")))
    per_word = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n"), F.length(F.array_join(ws, "")).cast("long").alias("chars"), repeated_words(ws).alias("n_repeat")))
    measured = (texts(docs)
                .select("doc_id", per_word.alias("w"), per_line.alias("l"), without(r"[^#*$%&|<>]+").alias("n_symbols"),
                        without(r"\P{Lu}+").alias("n_capitals"))
                .select("doc_id", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", F.col("l.n").alias("n_lines"),
                        (F.col("l.n") - F.col("l.n_own")).alias("n_dup_lines"), F.col("w.n_repeat").alias("n_repeat_words"), "n_capitals"))
    n = F.col("n_words")
    fails = {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > MAX_LINES * F.col("n_lines"),
        "capitals": 100 * F.col("n_capitals") > MAX_CAPITALS * F.col("word_chars"),
        "word_length": (F.col("word_chars") < WORD_LENGTHS[0] * n) | (F.col("word_chars") > WORD_LENGTHS[1] * n),
    }
    bits = F.lit(0)
    for name in RULES:
        bits = bits.bitwiseOR(F.when(fails[name], F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured.withColumn("bits", bits)


def mask_of(rules: list[str]) -> int:
    return sum(BIT[r] for r in rules)


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(rows: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail it, that fail it alone, and that would be kept without it.

    One pass: documents are first counted per bit pattern, of which there are at most 2^rules.
    """
    patterns = rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    uses = [(p, r, BIT[r], mask_of(rs)) for p, rs in POLICIES.items() for r in rs]
    plan = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(b).alias("bit"), F.lit(m).alias("mask"))
                               for p, r, b, m in uses])).alias("use")
    hit = F.col("bits").bitwiseAND(F.col("use.mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return (patterns.select("bits", "n", plan).groupBy("use.policy", "use.rule")
            .agg(count(hit.bitwiseAND(F.col("use.bit")) != 0).alias("n_fail"), count(hit == F.col("use.bit")).alias("n_only"),
                 count(hit.bitwiseAND(F.bitwise_not(F.col("use.bit"))) == 0).alias("n_kept_without")))


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the base verdict and the verdict of a policy that includes the base rules."""
    base = F.col("bits").bitwiseAND(F.lit(mask_of(BASE))) != 0
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass, in their own columns."""
    own = docs.columns
    base = F.col("__v.bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]) | mask_of(BASE))) == 0
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc_id"), F.col("text"))
    judged = ledger(keyed).select(F.col("doc_id").alias("__doc"), F.struct("bits").alias("__v"))
    return judged.where(base).select("__doc.*")
