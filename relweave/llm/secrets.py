"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts (assignments, access identifiers, long hexadecimal runs) are reported by themselves. Weak parts, that is user names,
bare 40-character keys and endpoints, are candidates, which are reported only with a complementary part: an identifier or an endpoint needs a
secret, a secret needs an identifier, where the other part may be strong or weak. Both must lie in one scope, a block of
text between blank lines, at most ``within`` code points apart. A part is linked with its nearest complement in the scope (of two
as near an identifier takes the one after it, others the one before), so that of two records side by side each keeps its own, and a scope
with many parts makes one link a part, never all pairs: the join of intervals is a sweep over the parts sorted by start, in which each sees the last end before it
and the next start after it of each role. The work is a sort and linear in the number of parts.

Positions come from the text cut by the pattern: lengths of gaps and of matches summed in order. Offsets are code points, ends
exclusive. Rows are dealt by a row number, with lengths only; texts are never shuffled. All parts of one text are sorted in one task.

Cases: a null text counts as empty; a text without parts gives zero counts and empty lists; repeated rows stay repeated, whatever
their ids; weak parts that overlap a strong one are that one and neither reported again nor linked; parts that begin together are in the order of
their kinds; an empty table gives no rows; other columns, whatever their names, are not read; texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Weak parts.
USER = r"""(?i:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
KEY40 = r"[A-Za-z0-9+/=_-]{40,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}"""
BLANK = r"\n[\x20\x09\x0D]*\n"
WITHIN = 300


@dataclass(frozen=True)
class Kind:
    """``fits``: what a match must pass, in SQL that Spark and DuckDB share, with {h} for the match. Roles of break: it ends a scope."""

    pattern: str
    role: str
    strong: bool = False
    fits: str = "true"


#: In the order of lists. The hexadecimal pattern finds whole runs, as no shorter one would fit.
KINDS = {
    "assign": Kind(ASSIGN, "secret", True),
    "access": Kind(ACCESS, "id", True, "length({h}) >= 20"),
    "hex": Kind("[0-9a-f]{24,}", "secret", True),
    "user": Kind(USER, "id"),
    "key": Kind(KEY40, "secret", False, "length({h}) = 40 AND length(translate({h}, '=_-', '')) = 40 AND length(translate({h}, '0123456789', '')) < 40 AND lower({h}) <> {h} AND upper({h}) <> {h}"),
    "endpoint": Kind(ENDPOINT, "endpoint"),
    "blank": Kind(BLANK, "break"),
}
WEAK = [k for k, v in KINDS.items() if not v.strong and v.role != "break"]
#: By role, what completes it.
COMPLEMENT = {"id": "secret", "secret": "id", "endpoint": "secret"}


def _found(text: Column, kind: str) -> Column:
    """Array of (kind, order, pos, gap before, length, fits) for a pattern's matches, in order."""
    pattern, order = KINDS[kind].pattern, list(KINDS).index(kind)
    gaps = F.transform(F.split(text, pattern), F.length)
    fits = (lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6) if kind == "assign" else (lambda h: _fits(h, kind))
    # Blank lines matter only where a weak part may be linked.
    there = F.lit(False)
    for k in WEAK if kind == "blank" else [kind]:
        there = there | text.rlike(KINDS[k].pattern)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h, i: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), i.alias("pos"), F.get(gaps, i).alias("gap"), F.length(h).alias("length"), fits(h).alias("fits")))
    return F.when(there, hits).otherwise(F.array())


def _fits(h: Column, kind: str) -> Column:
    if kind == "key":
        return (F.length(h) == 40) & (F.length(F.translate(h, "=_-", "")) == 40) & (F.length(F.translate(h, "0123456789", "")) < 40) & (F.lower(h) != h) & (F.upper(h) != h)
    return F.length(h) >= 20 if kind == "access" else F.lit(True)


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per match, strong or weak; a null kind for one that fails its test and for a text without any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_found(F.col("text"), k) for k in KINDS])
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id()).select("row", "id", F.explode_outer(found).alias("p")).select("row", "id", "p.*")
    # One exchange by row serves the sums, the sweeps and the lists.
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.col("length")).over(before) - F.col("length")
    roles = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v.role)])
    # A match that fails its test stays as a row without kind, so that its text isn't lost.
    placed = rows.repartition("row").withColumn("start", start).withColumn("end", F.col("start") + F.col("length")).withColumn("kind", F.when(F.col("fits"), F.col("kind")))
    return placed.select("row", "id", "kind", "order", "start", "end", roles[F.col("kind")].alias("role"), F.col("kind").isin(*[k for k, v in KINDS.items() if v.strong]).alias("strong"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = WITHIN) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base (strong spans), spans (with linked weak ones), each an array of
    struct(start, order, kind, end), and links, of struct(span, partner) for each linked weak one; all sorted."""
    every = parts(docs, id_col, text_col)
    sweep = Window.partitionBy("row").orderBy("start", "order")
    ahead, after = (lambda w: w.rowsBetween(Window.unboundedPreceding, -1)), (lambda w: w.rowsBetween(1, Window.unboundedFollowing))
    # Weak parts that overlap a strong one are out; what ends before another begins can't reach over it, so the greatest end tells.
    strong, weak = F.col("strong"), F.col("role").isin(*COMPLEMENT) & ~F.col("strong")
    over = (F.max(F.when(strong, F.col("end"))).over(ahead(sweep)) > F.col("start")) | (F.min(F.when(strong, F.col("start"))).over(after(sweep)) < F.col("end"))
    scope = F.count_if(F.col("role") == "break").over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    placed = every.withColumn("scope", scope).withColumn("out", weak & F.coalesce(over, F.lit(False)))
    role = F.when(~F.coalesce("out", F.lit(False)), F.col("role"))
    block = Window.partitionBy("row", "scope").orderBy("start", "order")
    span = F.struct("start", "order", "kind", "end")
    last = {r: F.max(F.when(role == r, F.struct("end", span.alias("span")))).over(ahead(block)) for r in ("id", "secret")}
    next_ = {r: F.min(F.when(role == r, F.struct("start", span.alias("span")))).over(after(block)) for r in ("id", "secret")}
    pick = lambda by: F.when(weak & role.isNotNull(), F.coalesce(*[F.when(role == r, by[c]) for r, c in COMPLEMENT.items()]))
    judged = placed.withColumn("last", pick(last)).withColumn("next", pick(next_))
    gap = lambda to, apart: F.when(F.col(to).isNotNull(), F.greatest(F.lit(0), apart))
    back, forth = gap("last", F.col("start") - F.col("last.end")), gap("next", F.col("next.start") - F.col("end"))
    nearer = (back < forth) | (back == forth) & (role != "id") | forth.isNull()
    partner = F.when((back <= within) & nearer, F.col("last.span")).when(forth <= within, F.col("next.span"))
    judged = judged.withColumn("partner", partner)
    told = strong | F.col("partner").isNotNull()
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, v in KINDS.items() if v.strong]
    listed_ = lambda x, name: F.array_sort(F.collect_list(x)).alias(name)
    lists = [listed_(F.when(strong, span), "base"), listed_(F.when(told, span), "spans"), listed_(F.when(F.col("partner").isNotNull(), F.struct(span.alias("span"), "partner")), "links")]
    return judged.groupBy("row", "id").agg(*counts, *lists).select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base", "spans", "links")


def _written(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, _written))


def listed_links(links: Column) -> Column:
    """kind:start:end>kind:start:end of links, comma-joined."""
    return F.concat_ws(",", F.transform(links, lambda x: F.concat_ws(">", _written(x["span"]), _written(x["partner"]))))


def oracle() -> str:
    """The query's rows in DuckDB's SQL, for documents with ids of their own."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    fits = lambda k, v: f"length(regexp_extract(h, {quoted(ASSIGN)}, 2)) >= 6" if k == "assign" else v.fits.format(h="h")
    one = lambda i, k, v: f"""SELECT doc_id, '{k}' AS kind, {i} AS ord, '{v.role}' AS role, {str(v.strong).lower()} AS strong, s AS "start", s + length(h) AS "end" FROM (
    SELECT doc_id, h, (sum(gap + length(h)) OVER (PARTITION BY doc_id ORDER BY n)) - length(h) AS s FROM (
      SELECT doc_id, n, hits[n] AS h, length(gaps[n]) AS gap FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS n FROM (
        SELECT doc_id, regexp_extract_all(t, {quoted(v.pattern)}) AS hits, regexp_split_to_array(t, {quoted(v.pattern)}) AS gaps FROM base)))) WHERE {fits(k, v)}"""  # noqa: E731
    needs = "CASE role " + " ".join(f"WHEN '{r}' THEN {{0}}_{c}" for r, c in COMPLEMENT.items()) + " END"
    text = "kind || ':' || \"start\" || ':' || \"end\""
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(one(i, k, v) for i, (k, v) in enumerate(KINDS.items()))}),
scoped AS (SELECT *, {text} AS span, NOT strong AND role <> 'break' AS weak, count(*) FILTER (role = 'break') OVER (PARTITION BY doc_id ORDER BY "start", ord ROWS UNBOUNDED PRECEDING) AS scope,
  coalesce(max("end") FILTER (strong) OVER (PARTITION BY doc_id ORDER BY "start", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start", false)
  OR coalesce(min("start") FILTER (strong) OVER (PARTITION BY doc_id ORDER BY "start", ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < "end", false) AS over FROM parts),
live AS (SELECT * FROM scoped WHERE role <> 'break' AND NOT (weak AND over)),
pairs AS (SELECT a.doc_id, a.span, a."start" AS s, a.ord AS o, b.span AS partner, b."start" AS bs,
  greatest(0, CASE WHEN (b."start", b.ord) < (a."start", a.ord) THEN a."start" - b."end" ELSE b."start" - a."end" END) AS gap, (b."start", b.ord) > (a."start", a.ord) AS behind, a.role = 'id' AS id, b."end" AS be, b.ord AS bo
  FROM live a JOIN live b ON a.doc_id = b.doc_id AND a.scope = b.scope AND a.weak AND b.role = CASE a.role WHEN 'secret' THEN 'id' ELSE 'secret' END),
nearest AS (SELECT * FROM pairs WHERE gap <= {WITHIN} QUALIFY row_number() OVER (PARTITION BY doc_id, s, o ORDER BY gap, behind <> id, CASE WHEN behind THEN bs ELSE -be END, CASE WHEN behind THEN bo ELSE -bs END, CASE WHEN behind THEN 0 ELSE -bo END) = 1),
told AS (SELECT l.*, n.partner FROM live l LEFT JOIN nearest n ON n.doc_id = l.doc_id AND n.s = l."start" AND n.o = l.ord)
SELECT b.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY "start", ord) FILTER (strong), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY "start", ord) FILTER (strong OR partner IS NOT NULL), '') AS spans,
  coalesce(string_agg(span || '>' || partner, ',' ORDER BY "start", ord) FILTER (partner IS NOT NULL), '') AS links
FROM base b LEFT JOIN told ON told.doc_id = b.doc_id GROUP BY b.doc_id"""
