"""Text steps of document intake: repeated edge lines, masking, keyword votes, similar titles, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge lines looked at, share of pages, least pages, and the length that a repeated line exceeds.
EDGE, SHARE, LEAST_PAGES, SHORT = 2, 0.5, 3, 3
#: What is masked, in this order.
MASKS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[0-9]{6}-[0-9]{7}", "[ID]"),
    (r"[0-9]{2,3}-[0-9]{3,4}-[0-9]{4}", "[PHONE]"),
)


def edge_lines(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, line, n_pages): lines that stand near an edge on at least half of a document's pages."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), F.trim), lambda s: F.length(s) > 0)
    edges = F.array_distinct(F.concat(F.slice("lines", 1, EDGE), F.slice(F.reverse("lines"), 1, EDGE)))
    each = pages.select(document, page, lines.alias("lines")).select(document, page, F.explode(edges).alias("line"))
    counted = each.where(F.length("line") > SHORT).groupBy(document, "line").agg(F.count(F.lit(1)).alias("n_pages"))
    total = pages.groupBy(document).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= LEAST_PAGES)
    return counted.join(total, document).where(F.col("n_pages") >= SHARE * F.col("total")).select(document, "line", "n_pages")


def masked(text: Column) -> Column:
    """The text with mail addresses, identity numbers and telephone numbers masked."""
    for pattern, label in MASKS:
        text = F.regexp_replace(text, pattern, label)
    return text


def keyword_vote(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """The type with the most distinct keywords in a text; the first on a tie, ``default`` without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    votes = [(kind, sum((F.when(low.contains(k), 1).otherwise(0) for k in words), F.lit(0))) for kind, words in keywords.items()]
    best = F.greatest(*[v for _, v in votes]) if len(votes) > 1 else votes[0][1]
    out = F.when(best == 0, default)
    for kind, v in votes:
        out = out.when(v == best, kind)
    return out


def bigrams(text: Column) -> Column:
    """The distinct pairs of adjacent characters, without white space."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substring(plain, i, F.lit(2)))
    return F.when(F.length(plain) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def checksum_dedupe(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(checksum, first id, copies) of each distinct text; rows without a text have a null checksum, which no text shares."""
    return rows.groupBy(F.md5(F.col(text).cast("binary")).alias("checksum")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies")
    )
