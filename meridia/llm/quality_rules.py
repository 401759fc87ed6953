"""Quality rules as a bitmask ledger (DataFrame operations only).

``ledger`` evaluates every rule of the catalogue once for every document and stores the
measurements and one long of failure bits.  Policies are versioned sets of rules: ``apply_policy``
compares the bits with the policy's mask, so a new policy needs no second look at the texts, and
``ablation`` sums, over the few distinct bit patterns, how many documents each rule alone rejects.

Words are runs of characters other than space and \\t-\\r.  Repeated windows of eight words are
compared by 64-bit hashes inside the document's own arrays: nothing is exploded or shuffled.

Defined cases: a null text counts as empty: no words, so it fails ``few_words`` only; rows are judged
one by one whatever their ids; ratios over no words are zero; an empty table gives no rows; columns
named like a measurement are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_but

WINDOW = 8
#: Bit by position, name, condition on the measurements under which the rule fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 5 * n_words and n_words > 0"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars - n_unspaced > 20 * n_words"),
    ("no_letters", "5 * n_alpha_words < 3 * n_words"),
    ("shouting", "2 * n_upper > word_chars and word_chars > 0"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_upper", "n_unspaced"]
#: Scripts that put no spaces between words; their letters say nothing about a word's length.
UNSPACED = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"]


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails more than ``tolerance`` of the rules."""

    version: str
    rules: tuple[str, ...]
    tolerance: int = 0

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_windows")),
    "v2": Policy("v2", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "no_letters", "shouting")),
}
CURRENT = "v2"


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(*keep, text.alias("__text"), F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))
    n = F.size("__words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    # Item access is constant-time where slice() would copy the whole array for each window.
    hashed = one.select(*keep, "__text", "__words", lines.alias("__lines"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"), starts.alias("__starts"))
    two = hashed.select(*keep, "__text", "__words", "__lines", F.transform("__starts", lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)])).alias("__hashes"))
    # Only texts with a repeated window pay for finding where.
    repeated = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    pairs = F.when(repeated, F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    unspaced = "[" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + "]+"
    three = two.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter("__words", lambda w: F.rlike(w, F.lit(r"\p{L}")))).cast("long").alias("n_alpha_words"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        (F.length("__text") - F.length(F.regexp_replace("__text", unspaced, ""))).cast("long").alias("n_unspaced"),
        pairs.alias("__pairs"),
    )
    where = F.array_sort(
        F.transform(
            F.filter(
                F.zip_with("__pairs", F.zip_with(F.slice(F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), "__pairs"), F.lit(1), F.size("__pairs")), F.concat(F.slice("__pairs", F.lit(2), F.size("__pairs")), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))), lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b"))), lambda x, y: F.struct(x["i"].alias("i"), (F.coalesce(x["h"] == y["a"], F.lit(False)) | F.coalesce(x["h"] == y["b"], F.lit(False))).alias("again"))),
                lambda x: x["again"],
            ),
            lambda x: x["i"],
        )
    )
    four = three.select(*keep, *[m for m in MEASUREMENTS if m != "n_repeat_words"], F.when(F.col("__pairs").isNotNull(), where).alias("__where"))
    covered = F.aggregate(
        "__where",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["upto"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("upto")),
        lambda a: a["n"],
    )
    repeats = F.when(F.col("__where").isNotNull(), covered).otherwise(F.lit(0).cast("long"))
    # A generator of one row: later filters stay above it, where they would else be pushed into copies of these expressions.
    one_row = F.explode_outer(F.array(F.struct(*[m for m in MEASUREMENTS if m != "n_repeat_words"], repeats.alias("n_repeat_words"))))
    return four.select(*keep, one_row.alias("__m")).select(*keep, *[F.col(f"__m.{m}").alias(m) for m in MEASUREMENTS])


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add the measurements and fail_bits (bit k: rule k of RULES failed)."""
    kept = columns_but(docs, {*MEASUREMENTS, "fail_bits"}) if keep is None else keep
    bits: Column = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, kept).select(*kept, *MEASUREMENTS, bits.alias("fail_bits"))


def apply_policy(rows: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(policy.mask))) <= policy.tolerance)


def failed(*rules: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(sum(BIT[r] for r in rules))) != 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, documents kept now and kept without it."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    per = [F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]
    each = patterns.select("bits", "n", F.explode(F.array(*per)).alias("r"))
    left = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))))
    return each.groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.bit_count("bits") <= policy.tolerance, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(left <= policy.tolerance, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
