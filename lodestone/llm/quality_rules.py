"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the bits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import key_and_text


class Rule(NamedTuple):
    """A rule fails a document where `fails`, SQL over the measurements, holds."""

    name: str
    fails: str


#: The bit of a rule is its place in this list; new rules go to the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("word_length", "word_chars > 15 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versioned policies: the rules that reject a document. A policy never changes; a new one gets a new name.
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_windows"],
    "web-1": sum(BIT.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements (long) and fail_bits of every row's whole text.

    Words are runs without ASCII white space, lines are split at \\n and count if they hold a word. All of it is
    expressions over one row: no shuffle, no Python. Repeated windows are first sought among 64-bit hashes; only a text
    that has equal ones is sorted by its windows' words, so the count is exact. A null or empty text measures 0 and
    fails few_words; a null doc_id stays null; repeated rows are measured each; an empty table gives no rows; other
    columns are not read.
    """
    texts = key_and_text(df, id_col, text_col)
    return _measured(texts.select("text", "doc_id"), ["doc_id"]).select("doc_id", *MEASURES, "fail_bits")


def _measured(df: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns, the measurements and fail_bits of the column `text`."""
    space = r"' \t\n\u000B\u000C\r'"
    texts = df.select(*carried, F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select("*", F.expr(f"btrim(text, {space})").alias("body")).select(*carried, "text", F.expr(r"CASE WHEN body = '' THEN CAST(array() AS array<string>) ELSE split(body, '[\\x20\\x09-\\x0D]+') END").alias("words"))
    hashed = words.select("*", F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))").alias("hashes"))
    lined = hashed.select(
        *carried, "text", "words",
        F.expr(r"filter(split(text, '\n'), line -> line rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN sort_array(transform(hashes, (h, i) -> struct(concat_ws(' ', get(words, i), get(words, i + 1), get(words, i + 2)) AS words, i AS at))) END").alias("windows"),
    )
    marked = lined.select(*carried, "text", "words", "lines", F.expr("sort_array(transform(filter(windows, (x, i) -> x.words = get(windows, i - 1).words OR x.words = get(windows, i + 1).words), x -> x.at))").alias("found"))
    measured = marked.select(
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.expr("length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.expr("length(regexp_replace(text, '[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
        # Each window covers the three words from its place on; those after the last covered word are new.
        F.expr("coalesce(aggregate(found, struct(-3 AS last, 0L AS n), (a, at) -> struct(at AS last, a.n + least(3, at - a.last) AS n)).n, 0L)").alias("n_repeat_words"),
        F.expr(r"length(regexp_replace(text, '\\P{Lu}+', ''))").cast("long").alias("n_upper"),
    )
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES)]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]))


def failed(policy: str) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def kept_rows(df: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all columns, that the policy keeps: their ledger is computed beside them, without a join.

    A null or empty text has no words and fails few_words; repeated rows are judged each; columns may have any names.
    """
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).cast("string").alias("text"))
    # The filter must stay above the measurements: pushed below, it would repeat all of them in its condition. A row
    # number in their projection, which the condition names, holds it there.
    judged = _measured(whole, ["_row"]).select("_row", "fail_bits", F.monotonically_increasing_id().alias("_at"))
    return judged.where(~failed(policy) & (F.col("_at") >= 0)).select("_row.*")


def ablations(ledgered: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that it alone fails, and rows kept without it.

    Rows are first counted by their bits (at most 2 to the number of rules, with partial sums on every task); the rest
    works on those counts.
    """
    mask = POLICIES[policy]
    counts = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")

    def total(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0)).cast("long")

    return each.groupBy("rule").agg(total("bits & bit <> 0").alias("n_failed"), total("bits = bit").alias("n_alone"), total("bits & ~bit = 0").alias("n_kept_without"))
