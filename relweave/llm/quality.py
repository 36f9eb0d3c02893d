"""Quality rules with suffix-array repetition.

Many texts are put into one array of word ids. Ids are made distinct between texts and each text ends with a separator of its
own, so one suffix array holds the suffixes of all of them and no repeat crosses texts. Buckets of equal suffixes are refined
by prefix doubling, only where they are still tied; the ranks of each round give the longest common prefix of neighbours.
The deepest LCP interval around a suffix has the value max(lcp to its left, lcp to its right) = m; words [i, i + m) are then a
repeat that can't be prolonged to the right. The union of those spans of at least ``min_words`` words is the covered part.

Cases: a null text counts as empty (no words, rejected as short); texts without words likewise; repeated rows stay repeated; ties:
exactly at a limit (30 words of 100 in repeated windows, a covered share of ``MAX_COVERED``, a longest repeat of ``MAX_LONGEST``) a text passes, and one
of ``LONGEST_FROM`` words counts as long; an empty table gives no rows; extra columns stay, but a column named as the result is an
error. Texts of any length are worked on whole; a batch ends once it has ``BATCH_WORDS`` words, one text at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import WORD, new_column

#: Production limits. A repeat counts from so many words on, below the windows of 8 of the base rule; the covered share of the
#: words; the longest repeat's share and words. Two copies of the longest may cover less than the covered share allows.
MIN_WORDS, MAX_COVERED, MAX_LONGEST, LONGEST_FROM = 5, 0.25, 0.10, 50
BATCH_WORDS = 400_000
SYMBOLS = "#*$%&|<>"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs again in the same text.

    words: ids of all texts, a separator (-1) after each text; ends: the separators' positions.
    """
    n = len(words)
    text = np.zeros(n, np.int64)
    text[ends[:-1] + 1] = 1
    text = np.cumsum(text)
    key = text * (int(words.max(initial=0)) + 2) + words + 1

    def heads(*keys: np.ndarray) -> np.ndarray:
        """True where sorted keys change."""
        first = np.ones(len(keys[0]), bool)
        first[1:] = False
        for k in keys:
            first[1:] |= k[1:] != k[:-1]
        return first

    order = np.argsort(key, kind="stable")
    first = heads(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    single = first & np.append(first[1:], True)
    tied = order[~single]
    suffixes = order
    where = np.flatnonzero(~single)  # their places in the suffix array
    while len(tied):
        a, b = rank[tied], rank[tied + step]
        by = np.lexsort((b, a))
        tied, a, b = tied[by], a[by], b[by]
        suffixes[where] = tied
        first = heads(a, b)
        rank[tied] = np.maximum.accumulate(np.where(first, where, 0))
        step *= 2
        levels.append(rank.copy())
        keep = ~(first & np.append(first[1:], True))
        tied, where = tied[keep], where[keep]
    left, right = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    for k in reversed(range(len(levels))):
        i, j = left[live] + lcp[live], right[live] + lcp[live]
        same = live[levels[k][i] == levels[k][j]]
        lcp[same] += 1 << k
    out = np.zeros(n, np.int64)
    out[suffixes[:-1]] = lcp
    out[suffixes[1:]] = np.maximum(out[suffixes[1:]], lcp)
    return out


def covered(lengths: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for positions inside any span [i, i + spans[i]) with spans[i] > 0."""
    reach = np.maximum.accumulate(np.where(spans > 0, np.arange(len(spans)) + spans, 0))
    return reach > np.arange(len(spans))


def measure(texts: list[str]) -> pd.DataFrame:
    words = [WORD.findall(t) for t in texts]
    flat = [w for ws in words for w in [*ws, None]]
    n_words = np.array([len(ws) for ws in words], np.int64)
    ends = np.cumsum(n_words + 1) - 1
    codes, _ = pd.factorize(np.array(flat, dtype=object))  # None gets -1
    repeats = longest_repeats(codes.astype(np.int64), ends)
    starts = ends - n_words

    def by_text(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), starts) if len(x) else np.zeros(0, np.int64)

    windows = by_text(covered(repeats, np.where(repeats >= 8, 8, 0)))
    union = by_text(covered(repeats, np.where(repeats >= MIN_WORDS, repeats, 0)))
    longest = np.maximum.reduceat(repeats, starts)
    dup_lines = []
    for t in texts:
        seen, n = set(), 0
        for line in t.split("\n"):
            if line in seen:
                n += bool(WORD.search(line))
            else:
                seen.add(line)
        dup_lines.append(n)
    base_failed = (n_words < 20) | (100 * windows > 30 * n_words)
    poor = (union > MAX_COVERED * n_words) | (longest >= LONGEST_FROM) & (longest > MAX_LONGEST * n_words)
    return pd.DataFrame(
        {
            "n_words": n_words,
            "word_chars": [sum(map(len, ws)) for ws in words],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": dup_lines,
            "n_repeat_words": windows,
            "covered_words": union,
            "longest_repeat": longest,
            "base_failed": base_failed,
            "kept": ~base_failed & ~poor,
        }
    )


def oracle() -> str:
    """The query's rows in DuckDB's SQL. Words that lie in repeats of n words or more are those in windows of n words that are found
    again in their text; the longest repeat comes from lengthening, step by step, what is found again."""
    word = r"[^ \t\n\x0B\f\r]"
    windows = lambda n: f"""
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS i, w[i : i + {n - 1}] AS g FROM words WHERE len(w) >= {n})) WHERE n > 1) GROUP BY doc_id"""  # noqa: E731
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
same AS (
  SELECT doc_id, i, 1 AS size, g FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, x) AS g, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words)) WHERE n > 1
  UNION ALL
  SELECT doc_id, i, size, g FROM (
    SELECT a.doc_id, a.i, a.size + 1 AS size, min(a.i) OVER (PARTITION BY a.doc_id, a.g, b.g) AS g, count(*) OVER (PARTITION BY a.doc_id, a.g, b.g) AS n FROM same a JOIN same b ON a.doc_id = b.doc_id AND b.i = a.i + 1) WHERE n > 1),
longest AS (SELECT doc_id, max(size) AS n FROM same GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words)) WHERE nth > 1 AND regexp_matches(l, '{word}') GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS covered_words, CAST(coalesce(l.n, 0) AS BIGINT) AS longest_repeat
  FROM words LEFT JOIN dups d USING (doc_id) LEFT JOIN ({windows(8)}) r USING (doc_id) LEFT JOIN ({windows(MIN_WORDS)}) c USING (doc_id) LEFT JOIN longest l USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND covered_words <= {MAX_COVERED} * n_words AND NOT (longest_repeat >= {LONGEST_FROM} AND longest_repeat > {MAX_LONGEST} * n_words) AS kept FROM judged"""


def _run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        done, some, size = [], [], 0
        for t in texts:
            some.append(t or "")
            size += 1 + len(some[-1]) // 4
            if size >= BATCH_WORDS:
                done.append(measure(some))
                some, size = [], 0
        if some:
            done.append(measure(some))
        yield pd.concat(done, ignore_index=True) if done else pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})


def quality(docs: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """The rows of docs with a column ``into``: the struct RESULT."""
    new_column(docs, into)
    run = F.pandas_udf(_run, RESULT).asNondeterministic()
    return docs.withColumn(into, run(F.col(text_col)))
