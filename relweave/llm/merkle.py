"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions only.

A paragraph is a line. Its leaves are its clauses, cut after punctuation or 64 code points at the latest (an empty line has one
empty leaf). A leaf's hash is that of its text; a paragraph's hash is that of its leaves' hashes in order, a section's that of its
paragraphs' hashes, and the root that of the sections' hashes, all SHA-256 at full length. A section is a run of paragraphs that
ends with one whose hash ends in 0 or 8, so sections follow the content and not positions. The fingerprint writes the tree down
with shortened hashes: ``root|section:leaves.paragraph,leaves.paragraph;section:...``. Equal roots tell equal texts.

A comparison starts at the roots and goes down differing branches only: sections of equal hash are paired (the n-th of a hash with
the n-th of that hash), the paragraphs of those left over are paired likewise, then the leaves of those left over. Leaves without a
partner are where the texts differ, and are given by their path. Likeness is the share of both texts' leaves that lie in paired
branches which come after the one paired before them, so order and repeats count; it is 1 for equal roots and below 1 otherwise.

Cases: a null text counts as empty (one empty paragraph); repeated ids: the next document is one of the next id's rows, the
one with the least prefix (ties: the least fingerprint), and each row is compared with it; repeated rows stay repeated; a null id
comes before all others; a table of one document is its own next; an empty table gives no rows; extra columns, whatever their
names, are not read; texts of any length are worked on whole, in time that grows with n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import written

#: Pieces of a paragraph: up to the next mark of punctuation, 64 code points at most, or marks alone; nothing, if it is empty.
CLAUSE = r"[^.,;:!?\n]{1,64}[.,;:!?]*|[.,;:!?]+|^$"
#: Hexadecimal digits that the fingerprint keeps of a leaf's, of a paragraph's or section's and of the root's hash.
LEAF, NODE, ROOT = 6, 8, 32


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def fingerprint(text: Column) -> Column:
    leaves = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda x: F.sha2(x, 256)))
    paragraphs = F.transform(leaves, lambda d: F.concat(F.concat_ws("", F.transform(d, lambda x: F.substring(x, 1, LEAF))), F.lit("."), F.sha2(F.concat_ws("", d), 256)))
    sections = F.split(F.regexp_replace(F.concat_ws(",", paragraphs), "([08]),", "$1;"), ";")
    hashed = F.transform(sections, lambda s: F.concat(F.sha2(F.concat_ws(",", F.transform(F.split(s, ","), lambda e: F.substring_index(e, ".", -1))), 256), F.lit(":"), F.regexp_replace(s, rf"\.([0-9a-f]{{{NODE}}})[0-9a-f]+", ".$1")))
    root = lambda s: F.substring(F.sha2(F.concat_ws("", F.transform(s, lambda x: F.substring(x, 1, 64))), 256), 1, ROOT)
    short = lambda s: F.concat_ws(";", F.transform(s, lambda x: F.concat(F.substring(x, 1, NODE), F.substring(x, 65, 1 << 30))))
    return _let(hashed, lambda s: F.concat_ws("|", root(s), short(s)))


def _placed(hashes: Column, side: str) -> Column:
    """Each hash with its side and place, as text."""
    return F.transform(hashes, lambda x, i: F.concat(F.lit(";"), x, F.lit(side), F.lpad(i.cast("string"), 10, "0")))


def _paired(a: Column, b: Column, digits: int) -> Column:
    """Places in a and in b of equal hashes, the n-th of its kind with the n-th, in the order of a."""
    # Sorted together, equal hashes are a run, those of a before those of b; runs that have both are taken out. (The mark in
    # front of each lets the pattern pass over others quickly, and possessive repeats need no stack.)
    both = F.sort_array(F.concat(_placed(a, "0"), _placed(b, "1")))
    runs = F.regexp_extract_all(F.concat_ws("", both), F.lit(rf";([0-9a-f]{{{digits}}})0.{{10}}(?:;\10.{{10}})*+(?:;\11.{{10}})++"), F.lit(0))
    of = lambda r, side: F.filter(F.split(r, ";"), lambda e: F.substring(e, digits + 1, 1) == side)
    place = lambda e: F.substring(e, digits + 2, 10).cast("int")
    pairs = F.flatten(F.transform(runs, lambda r: F.zip_with(of(r, "0"), of(r, "1"), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(place(x).alias("a"), place(y).alias("b"))))))
    return F.when(F.arrays_overlap(a, b), F.sort_array(F.array_compact(pairs))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def _rest(items: Column, pairs: Column, side: str) -> Column:
    """The items that are in no pair."""
    left = F.array_except(F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>")), F.transform(pairs, lambda p: p[side]))
    return F.transform(left, lambda i: F.get(items, i))


def _in_order(pairs: Column, weight: Callable[[Column], Column]) -> Column:
    """The weight of the pairs that come, in b too, after the one before them."""
    before = F.concat(F.array(F.lit(None).cast("struct<a:int,b:int>")), pairs)
    kept = F.zip_with(pairs, F.slice(before, F.lit(1), F.greatest(F.size(pairs), F.lit(1))), lambda p, q: F.when(p.isNotNull() & (q.isNull() | (q["b"] < p["b"])), weight(p["a"])).otherwise(0))
    return F.aggregate(kept, F.lit(0), lambda n, w: n + w.cast("int"))


def _leaves(section: Column) -> Column:
    """How many leaves a written section holds."""
    paragraphs = F.length(section) - F.length(F.replace(section, F.lit("."), F.lit("")))
    return ((F.length(section) - NODE - paragraphs * (NODE + 2)) / LEAF).cast("int")


def compare(df: DataFrame, a: str, b: str, likeness: str, differing: str | None = None) -> DataFrame:
    """The rows of df with the likeness of the fingerprints in columns a and b and, on request, where they differ.

    ``differing``: null for equal roots, else struct(a, b): of each the leaves without partner, as struct(section, paragraph, leaf),
    which count from 0: the section in the text, the paragraph in the section, the leaf in the paragraph.
    """
    own, sides = df.columns, ("a", "b")
    col = lambda name, side: F.col(f"__m_{name}_{side}")
    add = lambda d, **cols: d.select("*", *[c.alias(f"__m_{n}") for n, c in cols.items()])
    paragraph = lambda x, i: F.transform(F.split(F.substring(x, NODE + 2, 1 << 30), ","), lambda p, j: F.struct(p.alias("p"), i.alias("section"), j.alias("paragraph")))
    leaf = lambda x: F.transform(F.regexp_extract_all(F.substring_index(x["p"], ".", 1), F.lit(f".{{{LEAF}}}"), F.lit(0)), lambda h, k: F.struct(h.alias("h"), x["section"].alias("section"), x["paragraph"].alias("paragraph"), k.alias("leaf")))
    numbered = lambda x: F.transform(x, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    d = df.withColumn("__m_same", F.substring(F.col(f"`{a}`"), 1, ROOT) == F.substring(F.col(f"`{b}`"), 1, ROOT))
    # Equal roots: there is nothing to go down into.
    d = add(d, **{f"s_{s}": numbered(F.when(F.col("__m_same"), F.array().cast("array<string>")).otherwise(F.split(F.substring(F.col(f"`{c}`"), ROOT + 2, 1 << 30), ";"))) for s, c in zip(sides, (a, b), strict=True)})
    hashes = {"s": (lambda x: F.substring(x["s"], 1, NODE), NODE), "p": (lambda x: F.substring_index(x["p"], ".", -1), NODE), "l": (lambda x: x["h"], LEAF)}
    weights = {"s": lambda x: _leaves(x["s"]), "p": lambda x: (F.length(F.substring_index(x["p"], ".", 1)) / LEAF).cast("int"), "l": lambda x: F.lit(1)}
    below = {"s": ("p", lambda x: paragraph(x["s"], x["i"])), "p": ("l", leaf)}
    for level, (key, digits) in hashes.items():
        d = add(d, **{f"h{level}_{s}": F.transform(col(level, s), key) for s in sides})
        d = add(d, **{f"pairs_{level}": _paired(col(f"h{level}", "a"), col(f"h{level}", "b"), digits)})
        d = add(d, **{f"w_{level}": _in_order(F.col(f"__m_pairs_{level}"), lambda i, x=level: weights[x](F.get(col(x, "a"), i))), **{f"rest{level}_{s}": _rest(col(level, s), F.col(f"__m_pairs_{level}"), s) for s in sides}})
        if level in below:
            name, down = below[level]
            d = add(d, **{f"{name}_{s}": F.flatten(F.transform(col(f"rest{level}", s), down)) for s in sides})
    total = sum(F.aggregate(col("s", s), F.lit(0), lambda n, x: n + _leaves(x["s"])) for s in sides)
    share = 2.0 * (F.col("__m_w_s") + F.col("__m_w_p") + F.col("__m_w_l")) / F.greatest(total, F.lit(1))
    out = [F.when(F.col("__m_same"), 1.0).otherwise(F.least(F.lit(0.999), share)).alias(likeness)]
    if differing:
        path = lambda s: F.transform(col("restl", s), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph"), x["leaf"].alias("leaf"))).alias(s)
        out.append(F.when(~F.col("__m_same"), F.struct(path("a"), path("b"))).alias(differing))
    return d.select(*[F.col(f"`{c}`") for c in own if c not in (likeness, differing)], *out)


def next_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """id and the next id in ascending order, the first after the last; one row per distinct id.

    Ids alone are dealt by range; each range finds its own neighbours, and a table with one row per range links them.
    """
    ids = docs.select(F.col(id_col).alias("id")).distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    ids = written(ids, "merkle-ids")
    inside = ids.withColumn("next", F.lead(F.struct("id")).over(Window.partitionBy("part").orderBy("id")))
    ends = ids.groupBy("part").agg(F.min_by(F.struct("id"), F.struct(F.col("id").isNotNull(), "id")).alias("first"))
    # One row per range, as many as partitions: a bounded number.
    order = Window.orderBy("part")
    links = ends.select(F.col("part").alias("p"), F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return inside.join(links, F.col("part") == F.col("p")).select("id", F.coalesce("next", "after")["id"].alias("next_id"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its text with the last quarter taken from the next document's beginning, and the
    likeness of its fingerprint to that one and to the next document's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Each text is dealt by its id once; both joins use that exchange, so both must need the same columns of it.
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    pairs = next_ids(docs, id_col)
    sizes = docs.select(F.col(id_col).alias("sid"), F.floor(F.length(text) / 4).cast("int").alias("need")).groupBy("sid").agg(F.max("need").alias("need"))
    pairs = pairs.join(sizes, F.col("id").eqNullSafe(F.col("sid"))).select(F.col("id").alias("of"), "next_id", "need")
    following = base.join(pairs, F.col("id").eqNullSafe(F.col("next_id"))).groupBy("of").agg(F.min(F.struct(F.substring("text", F.lit(1), F.col("need")).alias("prefix"), fingerprint(F.col("text")).alias("print"))).alias("next"))
    joined = base.join(following, F.col("id").eqNullSafe(F.col("of"))).withColumn("n_chars", F.length("text").cast("long")).withColumn("fingerprint", fingerprint(F.col("text")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next.prefix", F.lit(1), quarter))
    out = joined.select(F.col("id").alias(id_col), "n_chars", "fingerprint", edited.alias("edited"), F.col("next.print").alias("next_print"))
    out = out.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    out = compare(compare(out, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_print", "near_next")
    return out.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def oracle() -> str:
    """The query's rows in DuckDB's SQL, for documents with ids of their own."""
    clause = CLAUSE.removesuffix("|^$").replace("\\n", "\n")
    level = lambda name, rows, key, weight: f"""
{name} AS (SELECT *, {key} AS h, {weight} AS w, row_number() OVER (PARTITION BY doc_id, which, side, {key} ORDER BY i, j, k) AS nth FROM ({rows})),
{name}_paired AS (SELECT a.doc_id, a.which, a.w, a.i, a.j, a.k, b.i AS bi, b.j AS bj, b.k AS bk FROM {name} a JOIN {name} b ON a.doc_id = b.doc_id AND a.which = b.which AND a.h = b.h AND a.nth = b.nth AND a.side = 0 AND b.side = 1),
{name}_weight AS (SELECT doc_id, which, sum(w) AS w FROM (SELECT *, lag((bi, bj, bk)) OVER (PARTITION BY doc_id, which ORDER BY i, j, k) AS prev FROM {name}_paired) WHERE prev IS NULL OR prev < (bi, bj, bk) GROUP BY ALL),
{name}_rest AS (SELECT * FROM {name} x WHERE NOT EXISTS (SELECT 1 FROM {name}_paired p WHERE p.doc_id = x.doc_id AND p.which = x.which AND CASE WHEN x.side = 0 THEN p.i = x.i AND p.j = x.j AND p.k = x.k ELSE p.bi = x.i AND p.bj = x.j AND p.bk = x.k END)),"""  # noqa: E731
    unnested = lambda source, items, i, j, k: f"SELECT doc_id, which, side, {i} AS i, {j} AS j, {k} AS k, xs[n] AS x FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS n FROM (SELECT *, {items} AS xs FROM {source}))"
    paragraphs = f"(length(x) - length(replace(x, '.', '')))"  # noqa: F541
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ahead AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS nid FROM base),
texts AS (SELECT doc_id, 'own' AS kind, t FROM ahead UNION ALL SELECT doc_id, 'edited', substring(t, 1, n - n // 4) || substring(nt, 1, n // 4) FROM ahead),
leaves AS (SELECT *, list_transform(string_split(t, chr(10)), lambda p: CASE WHEN p = '' THEN [sha256('')] ELSE list_transform(regexp_extract_all(p, '{clause}'), lambda x: sha256(x)) END) AS d FROM texts),
pars AS (SELECT *, list_transform(d, lambda x: array_to_string(list_transform(x, lambda y: y[1:{LEAF}]), '') || '.' || sha256(array_to_string(x, ''))) AS e FROM leaves),
secs AS (SELECT *, list_transform(string_split(regexp_replace(array_to_string(e, ','), '([08]),', '\\1;', 'g'), ';'), lambda s: sha256(regexp_replace(s, '[0-9a-f]+\\.', '', 'g')) || ':' || regexp_replace(s, '\\.([0-9a-f]{{{NODE}}})[0-9a-f]+', '.\\1', 'g')) AS s FROM pars),
prints AS (SELECT doc_id, kind, t, sha256(array_to_string(list_transform(s, lambda x: x[1:64]), ''))[1:{ROOT}] || '|' || array_to_string(list_transform(s, lambda x: x[1:{NODE}] || x[65:]), ';') AS f FROM secs),
sides AS (
  SELECT a.doc_id, 'edited' AS which, a.f AS fa, b.f AS fb FROM prints a JOIN prints b ON a.doc_id = b.doc_id AND a.kind = 'own' AND b.kind = 'edited'
  UNION ALL SELECT a.doc_id, 'next', p.f, q.f FROM ahead a JOIN prints p ON p.doc_id = a.doc_id AND p.kind = 'own' JOIN prints q ON q.doc_id = a.nid AND q.kind = 'own'),
apart AS (SELECT doc_id, which, 0 AS side, fa AS f FROM sides WHERE fa[1:{ROOT}] <> fb[1:{ROOT}] UNION ALL SELECT doc_id, which, 1, fb FROM sides WHERE fa[1:{ROOT}] <> fb[1:{ROOT}]),
{level("s", unnested("apart", f"string_split(f[{ROOT + 2}:], ';')", "n", "0", "0"), f"x[1:{NODE}]", f"(length(x) - {NODE} - {paragraphs} * {NODE + 2}) // {LEAF}")}
{level("p", unnested("s_rest", f"string_split(x[{NODE + 2}:], ',')", "i", "n", "0"), "split_part(x, '.', 2)", f"length(split_part(x, '.', 1)) // {LEAF}")}
{level("l", unnested("p_rest", f"regexp_extract_all(split_part(x, '.', 1), '.{{{LEAF}}}')", "i", "j", "n"), "x", "1")}
total AS (SELECT doc_id, which, sum(w) AS n FROM s GROUP BY ALL),
share AS (SELECT t.doc_id, t.which, least(0.999, 2.0 * (coalesce(a.w, 0) + coalesce(b.w, 0) + coalesce(c.w, 0))::DOUBLE / t.n) AS x
  FROM total t LEFT JOIN s_weight a USING (doc_id, which) LEFT JOIN p_weight b USING (doc_id, which) LEFT JOIN l_weight c USING (doc_id, which))
SELECT a.doc_id, CAST(a.n AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, o.f AS fingerprint, e.f AS edited_fingerprint,
  coalesce(ne.x, 1.0)::DOUBLE AS near_edited, coalesce(nn.x, 1.0)::DOUBLE AS near_next
FROM ahead a JOIN prints o ON o.doc_id = a.doc_id AND o.kind = 'own' JOIN prints e ON e.doc_id = a.doc_id AND e.kind = 'edited'
LEFT JOIN share ne ON ne.doc_id = a.doc_id AND ne.which = 'edited' LEFT JOIN share nn ON nn.doc_id = a.doc_id AND nn.which = 'next'"""
