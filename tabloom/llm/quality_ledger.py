"""Quality rules as a ledger: every rule is evaluated once, its verdict kept as a bit.

``ledger`` reads each text once and stores what was measured and one bit for each
rule that failed. Policies are named sets of rules; applying another version of a
policy, or asking what a rule costs, only reads the bits.

Defined results: a null or empty text has no words and fails ``few_words``; null ids
and repeated rows stay, a row in gives a row out; an empty table gives an empty
ledger; other columns of the input are left alone, a column that carries the name of
a ledger column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import as_long, blank_words, once, table, text_or_empty

SYMBOLS = "[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule name to its failure, over the measures. A rule's bit is its place here.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "n_lines > 3 AND 2 * n_dup_lines > n_lines",
}
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    Windows are hashed; where a hash repeats, (hash, place) pairs are sorted so equal
    windows are neighbours: n log n in the text's length, whatever its length."""

    def windows(w):
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2])
        )

    def places(p):
        same = lambda i, j: p[i]["h"] == p[j]["h"]
        hits = F.filter(
            p, lambda x, i: F.when(i > 0, same(i - 1, i)).otherwise(False) | F.when(i + 1 < F.size(p), same(i, i + 1)).otherwise(False)
        )
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    def covered(q):
        steps = F.transform(q, lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - q[F.greatest(j - 1, F.lit(0))])))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            once(once(pairs, places), covered)
        )

    return once(once(words, windows), count)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``failed_bits`` (bit i set: rule i of ``RULES`` failed)."""
    kept = [c for c in docs.columns if c.lower() not in {*MEASURES, "failed_bits"}]
    whole = text_or_empty(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\u000b\f\r")) != "")

    def measures(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def repeated(x):
        return F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        )

    measured = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        once(blank_words(whole), measures).alias("_words"),
        once(lines, repeated).alias("_lines"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(*[F.col(f"`{c}`") for c in kept], "_words.*", "_lines.*", "n_symbols")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.select(*[F.col(f"`{c}`") for c in kept], *MEASURES, bits.cast("long").alias("failed_bits"))


def passes(policy: str) -> Column:
    """Whether a ledger's row fails no rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule: documents the policy rejects, those the rule fails, and those
    only this rule rejects. One count by bit pattern, then bit arithmetic on the patterns."""
    grid = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(POLICIES[p])).cast("long").alias("m"), F.lit(mask((r,))).cast("long").alias("b"))
            for p in policies
            for r in POLICIES[p]
        ]
    )
    bad = F.col("failed_bits").bitwiseAND(F.col("m"))
    return (
        book.groupBy("failed_bits").agg(F.count("*").alias("n"))
        .select("failed_bits", "n", F.explode(grid).alias("g")).select("failed_bits", "n", "g.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(bad != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(bad.bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(bad == F.col("b"), F.col("n")).otherwise(0)).alias("only_this_rule"),
        )
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(as_long("doc_id").alias("doc_id"), "text")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes("v2")).alias("kept"), "failed_bits", "n_lines",
    )


OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
r AS (SELECT row_number() OVER () AS rid, * FROM t),
w AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM r)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w),
p AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM c WHERE n > 1),
s AS (SELECT rid, sum(CASE WHEN before IS NULL THEN 3 ELSE least(3, i - before) END) AS n FROM p GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM r LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_symbols > n_words)::INT
         + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT
         + 32 * (n_lines > 3 AND 2 * n_dup_lines > n_lines)::INT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_bits = 0 AS kept,
  failed_bits, n_lines FROM b
"""
