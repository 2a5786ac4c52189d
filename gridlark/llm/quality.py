"""Quality rules as a ledger of failure bits.

Each text is measured once and each rule is evaluated once; the verdicts are
stored as bits of one long beside the measurements. A policy is a named,
versioned bit mask over the rules: a document is kept when none of its failure
bits is in the mask. Trying another policy, or asking what one rule costs, then
reads the ledger only (a group by the few distinct bit patterns and bitwise
operations on the counts), never the texts.

Cases: a null text has no words and fails like an empty one; a null id passes
through; repeated rows are judged one by one; a text at a limit passes; an empty
table gives an empty ledger; texts are measured whole whatever their length;
other columns, of any name, are not looked at and stay in ``kept_documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import free_name, map_texts, shared_folder

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, "
    "n_upper_words long, n_distinct_words long"
)

SYMBOLS = "#*$%&|<>"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII white-space characters
    n = len(words)
    blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    return (
        n,
        len(text) - blanks,
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(ids, len(seen)),
        sum(map(bytes.isupper, words)),
        len(seen),
    )


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct < 2_000_000:
        keys = pairs[:-1] * distinct + ids[2:]
    else:
        keys = np.unique(pairs[:-1], return_inverse=True)[1] * distinct + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """One rule: its bit (given once, never reused), its limit, and the failure condition over named measurements."""

    bit: int
    limit: int
    fails: Callable[[Callable[[str], Column], int], Column]


#: Rules by name. A rule with another limit is another rule with a bit of its own, so old ledgers keep their meaning.
#: Bit 6 belonged to a rule that was withdrawn (it looked only at texts under a certain length).
RULES: dict[str, Rule] = {
    "too_few_words": Rule(0, 50, lambda m, k: m("n_words") < k),
    "repeated_windows": Rule(1, 50, lambda m, k: 100 * m("n_repeat_words") > k * m("n_words")),
    "too_many_symbols": Rule(2, 20, lambda m, k: 100 * m("n_symbols") > k * F.greatest(m("n_words"), F.lit(1))),
    "repeated_lines": Rule(3, 50, lambda m, k: (m("n_dup_lines") >= 3) & (100 * m("n_dup_lines") > k * m("n_lines"))),
    "shouting": Rule(4, 50, lambda m, k: 100 * m("n_upper_words") > k * m("n_words")),
    "odd_word_length": Rule(5, 25, lambda m, k: (m("word_chars") > k * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    # distinct words grow with the root of the length, so their square over the length compares texts of any length
    "low_variety": Rule(7, 1, lambda m, k: m("n_distinct_words") * m("n_distinct_words") < k * m("n_words")),
}
BASE_RULES = ("too_few_words", "repeated_windows")

#: Versioned policies; a version never changes once ledgers were judged by it. Version 2 went with bit 6.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v3": (*BASE_RULES, "too_many_symbols", "repeated_lines", "shouting", "odd_word_length", "low_variety"),
}
CURRENT = "v3"


def policy_mask(names: tuple[str, ...]) -> int:
    """The bit mask of a policy's rules."""
    return sum(1 << RULES[n].bit for n in names)


def ledger(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Measurements and ``failed_bits`` for every row of ``docs``, beside the columns ``keep``."""
    measured = map_texts(docs, lambda texts: [measure(t) for t in texts], MEASURES, keep, text_col)
    return measured.withColumn("failed_bits", failure_bits())


def failure_bits(at: str = "") -> Column:
    """Every rule evaluated once, over measurements whose names begin with ``at``: the bits of those that fail."""
    bits = F.lit(0).cast("long")
    for rule in RULES.values():
        bits = bits.bitwiseOR(F.when(rule.fails(lambda name: F.col(at + name), rule.limit), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def store_ledger(docs: DataFrame, path: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Write the ledger of ``docs`` once, as Parquet; policies and ablations then read it from there."""
    ledger(docs, keep, text_col).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def kept(bits: Column, policy: str = CURRENT) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return bits.bitwiseAND(F.lit(policy_mask(POLICIES[policy])).cast("long")) == 0


def kept_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``docs`` without the rows that a policy rejects; all columns stay.

    Only the texts go to Python, and only the failure bits come back.
    """

    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[m.split()[0] for m in MEASURES.split(", ")], dtype="int64")

    name = free_name(docs, "measured")
    ledger_rows = docs.withColumn(name, measured(F.col("text").cast("string")))
    return ledger_rows.where(kept(failure_bits(f"{name}."), policy)).drop(name)


def ablation(ledger_df: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that the rule fails, that it alone rejects, and that the policy rejects.

    The ledger is first counted by bit pattern (partial sums, at most one row
    for each pattern), so each policy and rule costs a pass over patterns.
    """
    patterns = ledger_df.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = [
        (version, name, policy_mask(names), 1 << RULES[name].bit)
        for version, names in policies.items()
        for name in names
    ]
    masks = ledger_df.sparkSession.createDataFrame(grid, "policy string, rule string, mask long, bit long")
    each = patterns.join(F.broadcast(masks), F.col("failed_bits").bitwiseAND(F.col("mask")) != 0)
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum("n").alias("policy_rejects"),
    )


def new_ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A ledger of ``docs`` stored in a folder of its own that all executors share."""
    return store_ledger(docs, f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}", keep)


def quality(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per document: base measurements, base verdict and the policy's verdict, read from a stored ledger."""
    rows = new_ledger(docs)
    base = F.col("failed_bits").bitwiseAND(F.lit(policy_mask(BASE_RULES)).cast("long")) != 0
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & kept(F.col("failed_bits"), policy)).alias("kept"),
        "failed_bits",
    )


def _measures_sql() -> str:
    """CTEs that measure every document again in SQL: ``m`` has a row for each, with ``failed_bits``."""
    word = r"'[^\x20\x09-\x0D]+'"
    rules = {
        "too_few_words": "n_words < {k}",
        "repeated_windows": "100 * n_repeat_words > {k} * n_words",
        "too_many_symbols": "100 * n_symbols > {k} * greatest(n_words, 1)",
        "repeated_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > {k} * n_lines",
        "shouting": "100 * n_upper_words > {k} * n_words",
        "odd_word_length": "word_chars > {k} * n_words OR word_chars < 2 * n_words",
        "low_variety": "n_distinct_words * n_distinct_words < {k} * n_words",
    }
    bits = " + ".join(f"CASE WHEN {rules[n].format(k=r.limit)} THEN {1 << r.bit} ELSE 0 END" for n, r in RULES.items())
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {word}) AS x FROM t)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM (
  SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE w2 IS NOT NULL),
d AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, {word}) GROUP BY r),
c AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(DISTINCT w) AS n_distinct_words, count(*) FILTER (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_upper_words FROM w GROUP BY r),
q AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::bigint AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_upper_words, 0) AS n_upper_words, coalesce(n_distinct_words, 0) AS n_distinct_words
  FROM t LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN d USING (r)),
m AS (SELECT *, ({bits})::bigint AS failed_bits FROM q)"""


def sql() -> str:
    """``quality`` as DuckDB SQL over ``documents``."""
    base = policy_mask(BASE_RULES)
    return f"""{_measures_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {base} <> 0 AS base_failed, failed_bits & {policy_mask(POLICIES[CURRENT])} = 0 AS kept, failed_bits FROM m"""


def ablation_sql() -> str:
    """``ablation`` as DuckDB SQL over ``documents``."""
    grid = ", ".join(f"('{v}', '{n}', {policy_mask(names)}, {1 << RULES[n].bit})" for v, names in POLICIES.items() for n in names)
    return f"""{_measures_sql()}
SELECT policy, rule, count(*) FILTER (failed_bits & bit <> 0) AS failed, count(*) FILTER (failed_bits & mask = bit) AS rejected_alone, count(*) AS policy_rejects
FROM m, (VALUES {grid}) p(policy, rule, mask, bit) WHERE failed_bits & mask <> 0 GROUP BY policy, rule"""
