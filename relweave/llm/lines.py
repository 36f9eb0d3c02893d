"""Line deduplication by site-relative frequency, in DataFrame functions only.

The pages of a host that contain a line, divided by all pages of the host: a line above ``max_ratio`` is boilerplate there. A
page counts a line once. Lines are counted by 128-bit hash with partial sums, so neither a hot host nor a hot line gathers rows.

A host has few boilerplate lines: if its pages have b lines on average, at most b / max_ratio. They are written as one array per
host and measured. Up to ``BROADCAST`` bytes they are broadcast, and pages aren't shuffled at all; above, pages are joined by host and
one of ``SALTS`` numbers, so that a hot host is spread.

Cases: a null text counts as empty; a null host is a host of its own; lines without a word are never dropped; repeated rows are
pages of their own; a ratio that is exactly the limit isn't above it; lines are compared as they are, without trimming; texts of any length
are worked on whole; an empty table gives no rows; other columns stay, but columns named as the two that are added are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import WORD_PATTERN, new_column, written

#: Production limits: the boilerplate ratio, and the pages that must have the line. A source mixes many sites, so a site's
#: boilerplate is a small share of it; without the page minimum every line of a host of up to 1 / MAX_RATIO pages is above the ratio.
MAX_RATIO, MIN_PAGES = 0.01, 3
#: Bytes of all drop lists that may be broadcast; numbers by which a host's pages are spread beyond that.
BROADCAST, SALTS = 32_000_000, 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has any: __host and __drop, the hashes of its boilerplate lines."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: x.rlike(WORD_PATTERN)), _key))
    counts = pages.select(host.alias("h"), F.explode(keys).alias("k")).groupBy("h", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy(host.alias("__host")).agg(F.count("*").alias("total"))
    frequent = counts.join(totals, F.col("h").eqNullSafe(F.col("__host"))).where(F.col("n") > max_ratio * F.col("total"))
    return frequent.groupBy("__host").agg(F.collect_list("k").alias("__drop"))


def line_dedup(pages: DataFrame, host: Column | str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages with boilerplate lines gone from the text; __n_lines and __n_dropped tell how many lines there were and went."""
    for name in ("__n_lines", "__n_dropped"):
        new_column(pages, name)
    host = F.col(host) if isinstance(host, str) else host
    found = written(boilerplate(pages, host, text_col, max_ratio, min_pages), "line-drops")
    size = found.agg(F.sum(F.size("__drop") * 24 + F.coalesce(F.length(F.col("__host").cast("string")), F.lit(0)) * 4 + 64)).first()[0] or 0
    keyed = pages.withColumn("__page_host", host)
    same = F.col("__page_host").eqNullSafe(F.col("__host"))
    if size <= BROADCAST:
        joined = keyed.join(F.broadcast(found), same, "left")
    else:
        keyed = keyed.withColumn("__page_salt", F.pmod(F.xxhash64(text_col), F.lit(SALTS)))
        salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.join(salted, same & (F.col("__page_salt") == F.col("__salt")), "left").drop("__page_salt", "__salt")
    lines = _lines(F.col(text_col))
    # The page's own lines on the list, which are few, are what each line is held against.
    out = joined.withColumn("__keys", F.when(F.col("__drop").isNotNull(), F.transform(lines, _key)))
    out = out.withColumn("__hits", F.array_intersect("__keys", "__drop"))
    kept = F.when(F.coalesce(F.size("__hits"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__hits"), F.get(F.col("__keys"), i))))
    out = out.withColumn("__kept", kept).withColumn("__n_lines", F.size(lines).cast("long"))
    out = out.withColumn("__n_dropped", F.col("__n_lines") - F.size("__kept")).withColumn(text_col, F.concat_ws("\n", "__kept"))
    return out.drop("__page_host", "__host", "__drop", "__kept", "__keys", "__hits")


def oracle(documents: str = "documents") -> str:
    """The query's rows in DuckDB's SQL."""
    word = "regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')"
    return f"""
WITH lines AS (
  SELECT doc_id, source, pos, ls[pos] AS l FROM (
    SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM {documents})),
totals AS (SELECT source, count(*) AS total FROM {documents} GROUP BY source),
counts AS (SELECT source, l, count(DISTINCT doc_id) AS n FROM lines WHERE {word} GROUP BY source, l),
drops AS (SELECT c.source, c.l FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * total),
marked AS (SELECT x.doc_id, x.pos, x.l, d.l IS NOT NULL AS gone FROM lines x LEFT JOIN drops d ON x.source IS NOT DISTINCT FROM d.source AND x.l = d.l)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
  CAST(length(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
