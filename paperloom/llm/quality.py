"""Quality rules as a ledger: every rule is evaluated once, policies of any version are applied to its bits later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WHITE, words_of

#: Rule i sets bit i where it fails; the conditions are SQL over the measurements.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("very_long", "n_words > 100000"),
]
#: The rules that no policy can waive.
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Documents go if they fail a base rule or more than allowed of the policy's rules."""

    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return bits(self.rules)


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in rules)


POLICIES = [
    Policy(1, ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")),
    Policy(2, tuple(name for name, _ in RULES)),
    Policy(3, ("symbols", "repeated_lines", "word_length", "bullet_lines", "ellipsis_lines"), allowed=1),
]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the array w has twice or more.

    The windows' hashes are sorted with their places, so that equal ones are neighbours; the places of those that
    have one are sorted again, and each adds the words that the one before does not cover.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(w[i - 1], w[i], w[i + 1]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twin = lambda k: ((k > 1) & (s[k - 2]["h"] == s[k - 1]["h"])) | ((k < F.size(s)) & (s[k]["h"] == s[k - 1]["h"]))
        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), F.size(s)), twin), lambda k: s[k - 1]["i"]))
        start = F.struct(F.lit(-3).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("end"), (a["n"] + F.least(F.lit(3), p - a["end"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_with(F.sort_array(windows), covered))


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def ledger(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_bullet_lines, n_ellipsis_lines, n_repeat_words and failure_bits.

    docs needs a column text; columns of docs with one of these names are replaced. A null, empty or blank text has
    zero in all measurements. It is one pass over the rows without a shuffle, so that a hot source or group of
    copies is no burden; a long text stays in its row.
    """
    text = F.coalesce("text", F.lit(""))

    def measure(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
        of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(F.filter(x, lambda y: F.btrim(y, F.lit(WHITE)).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"), F.size(F.filter(x, lambda y: F.btrim(y, F.lit(WHITE)).rlike("(?:\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _with(lines, of_lines).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in [*names, "failure_bits"]]
    # explode keeps the optimizer from computing the struct again for each of its fields.
    each = docs.select(*rest, F.explode(F.transform(F.array(words_of(F.col("text"))), measure)).alias("_m"))
    each = each.select(*rest, *(F.col(f"_m.{n}" if n in ("n_words", "word_chars", "n_symbols", "n_repeat_words") else f"_m.lines.{n}").alias(n) for n in names))
    failed = [F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, sql) in enumerate(RULES)]
    return each.withColumn("failure_bits", sum(failed[1:], failed[0]))


def verdict(policy: Policy, failure_bits: str = "failure_bits") -> Column:
    """Whether a row of the ledger stays."""
    failed = F.bit_count(F.col(failure_bits).bitwiseAND(F.lit(policy.mask & ~bits(BASE))))
    return (F.col(failure_bits).bitwiseAND(F.lit(bits(BASE))) == 0) & (failed <= policy.allowed)


def ablations(rows: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without) of a ledger, from one row for each pattern of bits.

    n_only counts the documents that fail this rule alone of the policy's and base rules; n_kept_without those that
    the policy would keep if the rule were waived. An empty ledger gives no rows.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    found = None
    for p in policies:
        for i, (name, _) in enumerate(RULES):
            mask = p.mask | bits(BASE)
            if not mask >> i & 1:
                continue
            less = F.col("failure_bits").bitwiseAND(F.lit(~(1 << i)))
            count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
            kept_without = (less.bitwiseAND(F.lit(bits(BASE))) == 0) & (F.bit_count(less.bitwiseAND(F.lit(p.mask & ~bits(BASE)))) <= p.allowed)
            one = patterns.agg(
                F.lit(p.version).alias("policy"),
                F.lit(name).alias("rule"),
                count(F.col("failure_bits").bitwiseAND(F.lit(1 << i)) != 0).alias("n_failed"),
                count(F.col("failure_bits").bitwiseAND(F.lit(mask)) == (1 << i)).alias("n_only"),
                count(verdict(p)).alias("n_kept"),
                count(kept_without).alias("n_kept_without"),
                F.count(F.lit(1)).alias("patterns"),
            )
            found = one if found is None else found.union(one)
    return found.filter("patterns > 0").drop("patterns")
