"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a
policy is a version of which bits count, so new policies and ablations read the narrow ledger and never the texts.

Defined results: a null or empty text has no words, all measurements are 0 and only ``too_few_words`` fails. Very
long texts are handled row by row inside the JVM; nothing is grouped across rows, so no key can be hot. Repeated
rows give repeated ledger rows, an empty table an empty ledger, and further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.common import texts_of

#: Fixed patterns of words and symbols.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: name -> condition of failure over the measurements; the bit is the place in this list, so only append.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_heavy": "10 * n_symbols > 2 * n_words",
    "repeated_lines": "n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "n_letters >= 20 AND 10 * n_upper > 7 * n_letters",
}
BASE_RULES = ("too_few_words", "repeated_windows")
#: Versions of policies; a version never changes once it has been used.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in rules)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that is found twice or more.

    Windows are sorted by their hash; those with an equal neighbour are repeated. Their places, sorted, each
    add the words up to the next place, ``WINDOW`` at most.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i")),
    )

    def covered(ordered: Column) -> Column:
        def again(x: Column, at: Column) -> Column:
            equal = [F.coalesce(F.get(ordered, at + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
            return equal[0] | equal[1]

        places = F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["i"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, at: F.least(F.coalesce(F.get(p, at + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("bigint")),
            F.lit(0).cast("bigint"), lambda total, x: total + x,
        ))

    return F.when(F.size(words) > WINDOW, _let(F.sort_array(windows), covered)).otherwise(F.lit(0).cast("bigint"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, read off the whole text."""
    text = F.coalesce("text", F.lit(""))
    base = texts_of(docs).select("doc_id", text.alias("text"))
    parts = base.select(
        "doc_id", "text",
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    without = lambda signs: F.length(F.translate("text", signs, ""))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return parts.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        without(" \t\n\x0b\f\r").cast("bigint").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        letters.cast("bigint").alias("n_letters"),
        upper.cast("bigint").alias("n_upper"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``: bit k is set where rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured(docs).select("*", total.alias("fail_bits"))


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """``kept`` by a policy, from the ledger alone."""
    mask = F.lit(mask_of(POLICIES[version])).cast("bigint")
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(mask) == 0)


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents it fails, and those that pass once it alone is left out.

    Rows are first counted per bit pattern (at most two to the number of rules), so the shuffle is tiny.
    """
    mask = mask_of(POLICIES[version])
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit"))
        for k, name in enumerate(RULES) if mask >> k & 1
    ])
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    each = patterns.select(failed.alias("failed"), "n", F.explode(rules).alias("r")).select("failed", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or("failed").bitwiseAND(F.first("bit")).alias("bit_seen"),
    )


def rule_verdicts(docs: DataFrame, version: str = "v2") -> DataFrame:
    """One row per document: the base measurements, ``base_failed`` and the policy's ``kept``."""
    judged = apply_policy(ledger(docs), version)
    base = F.lit(mask_of(BASE_RULES)).cast("bigint")
    base_failed = F.col("fail_bits").bitwiseAND(base) != 0
    return judged.select(
        "doc_id", *MEASURES[:5], base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), "fail_bits",
    )


#: DuckDB twin of ``rule_verdicts`` over ``documents``.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, unnest(generate_series(1, len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT r, i, array_to_string(words[i : i + 4], ' ') AS gram FROM g),
d AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY r, gram) >= 2),
c AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM d),
k AS (SELECT r, sum(n) AS n FROM c GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines,
        length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN k USING (r)),
f AS (SELECT *,
        (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN n_letters >= 20 AND 10 * n_upper > 7 * n_letters THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM f
"""
