"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once, evaluates every rule once and stores the
failures as bits of one long beside the measurements.  Policies are named,
versioned sets of rules, so a policy is a mask: applying one, comparing
versions, or asking what a single rule costs needs the ledger only, never the
texts.  ``ablations`` aggregates the ledger to its distinct bit patterns and
answers every "policy without this rule" from those with bitwise operations.

Edge cases: a null or empty text has no words and fails ``few_words``; a null
id is kept as null; repeated rows are measured each; an empty table gives an
empty ledger; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
            "n_repeat_words", "n_upper")


def _rules() -> dict[str, Column]:
    """Failure conditions over the measurements; the position is the bit."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 50 * c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 50 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": (c("n_words") >= 20) & (100 * c("n_upper") > 60 * c("word_chars")),
    }


RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words",
         "long_words", "shouting")

#: Policy versions: a version is never changed, a new one is added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "web-2": ("few_words", "repeated_windows", "symbols", "duplicate_lines",
              "short_words", "long_words", "shouting"),
}
CURRENT = "web-2"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words inside ``size``-word windows found twice or more in the array.

    Windows are compared by hash first; only a text with an equal pair of
    hashes goes on to compare the words of those windows themselves.
    """
    def starts(w):
        return F.sequence(F.lit(1), F.size(w) - (size - 1))

    def neighbours(sorted_, key):
        """Entries of a sorted array whose key equals a neighbour's."""
        return F.filter(sorted_, lambda x, i: (
            (F.get(sorted_, i - 1)[key] == x[key]) & (i > 0))
            | F.coalesce(F.get(sorted_, i + 1)[key] == x[key], F.lit(False)))

    def by_words(w, near):
        keyed = F.transform(near, lambda x: F.struct(
            F.array_join(F.slice(w, x["at"], size), " ").alias("key"), x["at"].alias("at")))
        return _let(F.sort_array(keyed), lambda s: neighbours(s, "key"))

    def count(found):
        at = F.sort_array(F.transform(found, lambda x: x["at"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(at, zero, lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(size), p - acc["last"])).cast("long").alias("n"),
            p.alias("last")), lambda acc: acc["n"])

    def compare(w, hashes):
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("key"), (i + 1).alias("at")))
        near = _let(F.sort_array(pairs), lambda s: neighbours(s, "key"))
        return count(by_words(w, near))

    def of(w):
        hashes = F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) > size, _let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), compare(w, h)).otherwise(F.lit(0).cast("long"))
        )).otherwise(F.lit(0).cast("long"))

    return _let(words, of)


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, the measurements, fail_bits), one per document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id).alias("id"), body.alias("text"),
        F.array_remove(F.split(body, SPACE), "").alias("words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD_CHAR)).alias("lines"))

    def removed(pattern: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")

    measured = split.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        removed(r"\p{Lu}").alias("n_upper"))
    rules = _rules()
    bits = [F.when(rules[r], F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
            for k, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.select("*", total.alias("fail_bits"))


def passes(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """What each policy keeps, and what it would keep without each of its rules.

    Rows (policy, dropped_rule, n_kept, n_gained); ``dropped_rule`` is null
    for the policy itself.  Only the distinct bit patterns (at most 2 to the
    number of rules) meet the policies.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [(p, d, mask_of(rs) & ~(1 << RULES.index(d) if d else 0), mask_of(rs))
             for p, rs in POLICIES.items() for d in (None, *rs)]
    variants = F.explode(F.array(*(F.struct(
        F.lit(p).alias("policy"), F.lit(d).cast("string").alias("dropped_rule"),
        F.lit(m).cast("long").alias("mask"), F.lit(full).cast("long").alias("full"))
        for p, d, m, full in cases)))
    kept = F.col("fail_bits").bitwiseAND(F.col("v.mask")) == 0
    before = F.col("fail_bits").bitwiseAND(F.col("v.full")) == 0
    return (patterns.select("fail_bits", "n", variants.alias("v"))
            .groupBy("v.policy", "v.dropped_rule")
            .agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept"),
                 F.sum(F.when(kept & ~before, F.col("n")).otherwise(0)).alias("n_gained")))
