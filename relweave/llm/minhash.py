"""MinHash near-duplicates with circulant permutations.

A text's set holds the 64-bit hashes of its distinct word shingles. Two bijections of 32 bits give all coordinates: the first is
applied once, its values are shifted circularly by k steps, the second is applied, and the minimum is coordinate k. Coordinates
are banded; texts that share a band's values are candidates; a candidate is a link if the exact Jaccard similarity of the full
sets is high enough. ``layout`` derives bands and the signature filter from the similarity asked for: of pairs exactly at it, less
than 1 in 100,000 shares no band, and less than 1 in 100,000 is lost by the filter (at 80 %: 40 bands of 6); of more similar ones
fewer still. None is linked wrongly, and there is no cap on members, candidates or links.

Work is on distinct sets (nodes): copies fall together by a 128-bit name of the set before anything is compared. Buckets are
never expanded to pairs. Each member is first compared with one pivot of its bucket, and links are contracted to components;
buckets that then hold one component are done. In the others only members outside the bucket's largest component (strays) look
for partners: their signatures are compared with those of the whole bucket in memory, those that agree often enough are gathered
to clusters, and strays' sets are compared exactly with their cluster's, which yields only as many links as join components.

Rows: a bucket is one group of one row per member up to ``MEMBERS`` members, a cluster likewise up to ``WORDS`` shingles (16 MB).
Larger ones are cut into blocks, and a row goes to as many groups as there are blocks of strays (a stray: blocks of any kind), so
m members of which s are strays make about m (1 + s / MEMBERS) + s m / MEMBERS rows: a bucket of 20,000 unlike members stays 20,000.
Components come from repeated contraction to the least neighbour, where nodes are ordered by the least id of their rows, so that a
component's label is its least id and nothing is gathered by label; each round is a written table.

Cases: texts without words (or null) have an empty set and are linked with nothing; texts with fewer words than a shingle have
their whole sequence as the one shingle; repeated rows fall together; rows that share an id are told apart; rows with a null id are
left alone (component null) unless ``row_col`` tells rows apart, by which they take part as the last ones; ties of equal ids go to
the least row; tables may be empty; extra columns, whatever their names, are not read. Texts are worked on whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import written

COORDINATES = 240
#: Pairs exactly at the similarity asked for that banding, and the signature filter, may each lose at most.
LOST = 1e-5
#: Members of a bucket whose signatures one task holds (about 16 MB), and shingles of a cluster whose sets it holds (16 MB).
MEMBERS, WORDS = 1 << 16, 2_000_000
LAST = (1 << 63) - 1
_U64, _U32 = np.uint64, np.uint32


@functools.cache
def layout(percent: int) -> tuple[int, int, int]:
    """Bands, coordinates in each, and how many coordinates of linked texts agree at least."""
    s = percent / 100
    rows = max((r for r in range(1, COORDINATES + 1) if (1 - s**r) ** (COORDINATES // r) <= LOST), default=1)
    lost, agree = 0.0, 0
    while lost <= LOST and agree < COORDINATES:
        lost += math.comb(COORDINATES, agree) * s**agree * (1 - s) ** (COORDINATES - agree)
        agree += lost <= LOST
    return COORDINATES // rows, rows, agree


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Only A-Z are lower-cased; words end at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words))
    width = min(width, len(words))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = _mix64(out * _U64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(_mix64(out + _U64(width)))


def signatures(sets: list[np.ndarray], n: int = COORDINATES) -> np.ndarray:
    """A row of n 32-bit coordinates for each set; none may be empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = np.concatenate(sets)
    x = (x ^ (x >> _U64(32))).astype(_U32)
    for c, s in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):  # the first permutation
        x = (x ^ (x >> _U32(s))) * _U32(c)
    x ^= x >> _U32(16)
    out, y, t = np.empty((len(sets), n), _U32), np.empty_like(x), np.empty_like(x)
    for k in range(n):  # the second one, on values shifted circularly
        np.add(x, _U32(k * 0x9E3779B9 & 0xFFFFFFFF), out=y)
        np.multiply(y, _U32(0x7FEB352D), out=y)
        np.right_shift(y, _U32(15), out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, _U32(0x846CA68B), out=y)
        np.right_shift(y, _U32(16), out=t)
        np.bitwise_xor(y, t, out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def bands(sig: np.ndarray, percent: int) -> np.ndarray:
    """The bands' keys of 64 bits for each signature."""
    many, rows, _ = layout(percent)
    parts = sig[:, : many * rows].reshape(len(sig), many, rows).astype(_U64)
    key = np.arange(many, dtype=_U64)[None, :] * _U64(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = _mix64(key ^ (parts[:, :, i] + _U64(i)))
    return key.view(np.int64)


def name(s: np.ndarray) -> tuple[int, int]:
    """A set's name: 128 bits as two signed numbers."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


SKETCH = "id long, row long, h long, n long, hi long, lo long, bands array<long>, sig binary"


def _sketch(width: int, percent: int):
    def some(b: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
        full = [s for s in sets if len(s)]
        sig = signatures(full) if full else np.empty((0, COORDINATES), _U32)
        keys, low, at = bands(sig, percent), sig.astype(np.uint8), iter(range(len(full)))
        rows = [(len(s), *name(s), keys[i := next(at)], low[i].tobytes()) if len(s) else (0, None, None, None, None) for s in sets]
        made = pd.DataFrame(rows, columns=["n", "hi", "lo", "bands", "sig"], index=b.index, dtype=object)
        return pd.concat([b[["id", "row", "h"]], made], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.astype({"id": object})
            b["id"] = [None if pd.isna(i) else int(i) for i in b["id"]]
            lo, sets, size = 0, [], 0
            for i, text in enumerate(b["text"].tolist(), 1):
                sets.append(shingle_set(text, width))
                size += len(sets[-1])
                if size >= 200_000 or i == len(b):
                    yield some(b.iloc[lo:i], sets)
                    lo, sets, size = i, [], 0

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 200):
                some = b.iloc[lo : lo + 200]
                sets = [shingle_set(t, width) for t in some["text"]]
                same = [name(s) == x for s, x in zip(sets, zip(some["hi"].tolist(), some["lo"].tolist(), strict=True), strict=True)]
                yield pd.DataFrame({"node": some["node"].to_numpy()[same], "words": [s.tobytes() for s, ok in zip(sets, same, strict=True) if ok]})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y in zip(p["wa"], p["wb"], strict=True):
                x, y = np.frombuffer(x, _U64), np.frombuffer(y, _U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield p.loc[ok, ["a", "b"]]

    return run


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], weight: str, most: int) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by keys, of a weight of ``most`` or more together where they are small."""
    held: list[pd.DataFrame] = []
    for b in (x.iloc[lo : lo + 1000] for x in batches for lo in range(0, len(x), 1000)):
        held.append(b)
        if sum(x[weight].sum() for x in held) < most:
            continue
        rows = pd.concat(held, ignore_index=True)
        k = rows[keys].to_numpy()
        last = int(np.flatnonzero((k[1:] != k[:-1]).any(axis=1))[-1]) + 1 if (k[1:] != k[:-1]).any() else 0
        if last:
            yield rows.iloc[:last].reset_index(drop=True)
        held = [rows.iloc[last:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _bounds(rows: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    k = rows[keys].to_numpy()
    edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _join(joined: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Joins i with js in place, where ``joined`` numbers what belongs together; one of js for each number that was another."""
    numbers, at = np.unique(joined[js], return_index=True)
    js = js[at[numbers != joined[i]]]
    joined[np.isin(joined, numbers)] = joined[i]
    return js


_PAIR = ["key", "first", "second"]


def _partners(rows: pd.DataFrame, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """The strays of a group's first block, each with the places of those it is to be compared with: all of another label in the
    second block, where two strays of one block meet once."""
    label, block, stray = (rows[c].to_numpy()[lo:hi] for c in ("label", "block", "stray"))
    first, second, place = rows["first"].iloc[lo], rows["second"].iloc[lo], np.arange(hi - lo)
    right = block == second
    for i in np.flatnonzero((block == first) & stray).tolist():
        js = right & (label != label[i]) & ((place > i) | ~stray) if first == second else right & (label != label[i])
        if js.any():
            yield lo + i, lo + np.flatnonzero(js)


def _open(percent: int):
    """Of a bucket's pair of blocks, strays and members of other components that may be linked by their sizes and signatures:
    edges that join all such, one less than members at most."""
    need = layout(percent)[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _PAIR, "one", 20_000):
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
            label, n, node = (rows[c].to_numpy() for c in ("label", "n", "node"))
            fits = lambda i, j: 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            bounds = _bounds(rows, _PAIR)
            i = np.array([lo for lo, hi in bounds if hi - lo == 2], np.int64)
            i = i[(label[i] != label[i + 1]) & fits(i, i + 1)] if len(i) else i
            i = i[np.count_nonzero(sig[i] == sig[i + 1], axis=1) >= need] if len(i) else i
            out = list(zip(node[i].tolist(), node[i + 1].tolist(), strict=True))
            joined = np.arange(len(rows))
            for lo, hi in bounds:
                for i, js in _partners(rows, lo, hi) if hi - lo > 2 else ():
                    js = js[(joined[js] != joined[i]) & fits(js, i)]
                    js = js[np.count_nonzero(sig[js] == sig[i], axis=1) >= need] if len(js) else js
                    out += [(node[i], node[j]) for j in _join(joined[lo:hi], i - lo, js - lo) + lo]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _exact(percent: int):
    """Links between components in a pair of blocks, as many as join what can be joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _PAIR, "n", 500_000):
            out = []
            for lo, hi in _bounds(rows, _PAIR):
                g = rows.iloc[lo:hi].reset_index(drop=True)
                node = g["node"].to_numpy()
                sets = [np.frombuffer(w, _U64) for w in g["words"]]
                size = np.array([len(s) for s in sets])
                _, words = np.unique(np.concatenate(sets), return_inverse=True)
                at = np.cumsum(size) - size
                owner = np.repeat(np.arange(len(sets)), size)
                keep = np.flatnonzero((g["block"].to_numpy() == g["second"].iloc[0])[owner])
                order = keep[np.argsort(words[keep], kind="stable")]
                holders, heads = owner[order], np.searchsorted(words[order], np.arange(words.max(initial=-1) + 2))
                joined = np.unique(g["label"], return_inverse=True)[1]
                for i, js in _partners(g, 0, len(g)):
                    js = js[joined[js] != joined[i]]
                    if not len(js):
                        continue
                    mine = words[at[i] : at[i] + size[i]]
                    lens = heads[mine + 1] - heads[mine]
                    place = np.repeat(heads[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                    both = np.bincount(holders[place], minlength=len(sets))[js]
                    js = js[100 * both >= percent * (size[js] + size[i] - both)]
                    out += [(node[i], node[j]) for j in _join(joined, i, js)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _in_blocks(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """Rows (key, node, label, ...) of each key dealt to the pairs of blocks in which a stray may meet a partner.

    Strays are those outside the key's largest label. Where all of a key fits into ``most``, it is one block."""
    sizes = rows.groupBy("key", "label").agg(F.sum(weight).alias("w")).groupBy("key").agg(F.max(F.struct("w", "label")).alias("big"), F.sum("w").alias("w"), F.count("*").alias("labels"))
    sizes = sizes.where("labels > 1").select(F.col("key").alias("k"), F.col("big.label").alias("largest"), F.col("w").alias("all"), F.ceil((F.col("w") - F.col("big.w")) / most).alias("strays"), F.ceil(F.col("big.w") / most).alias("rest"))
    dealt = rows.join(sizes, F.col("key") == F.col("k")).withColumn("stray", F.col("label") != F.col("largest")).withColumn("rest", F.when(F.col("all") <= most, 0).otherwise(F.col("rest")))
    hashed = F.xxhash64("node")
    block = F.when(F.col("stray"), F.pmod(hashed, F.col("strays"))).when(F.col("rest") == 0, 0).otherwise(F.col("strays") + F.pmod(hashed, F.col("rest")))
    reach = F.when(F.col("block") < F.col("strays"), F.col("strays") + F.col("rest")).otherwise(F.col("strays"))
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), reach - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return dealt.drop("k", "largest", "all", "strays", "rest", "other")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node that links reach) for every node of links (a, b); nodes are of any type with an order."""
    labels, edges = None, written(links.select("a", "b").distinct(), "cc-links")
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parent = written(parent.alias("x").join(parent.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.p").alias("p")), "cc-parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            labels = written(labels.join(parent, F.col("label") == F.col("a"), "left").select("node", F.coalesce("p", "label").alias("label")), "cc-labels")
        q = parent.select(F.col("a").alias("c"), F.col("p").alias("q"))
        edges = edges.join(parent, "a").select("b", "p").join(q, F.col("b") == F.col("c")).where(F.col("p") != F.col("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        edges = written(edges, "cc-links")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach) for every row. Ids are integers.

    ``row_col``: a column of whole numbers that tells rows apart. Then the result has it too, and ``kept``: whether the row is the
    one of its component that stays, the least by id and row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")).alias("row"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sketch = written(rows.mapInPandas(_sketch(width, percent), SKETCH), "minhash-sketch")
    takes_part = F.col("hi").isNotNull() if row_col else F.col("hi").isNotNull() & F.col("id").isNotNull()
    place = F.coalesce("id", F.lit(LAST))
    # A node is known by the least of its rows, in the order of ids.
    distinct = sketch.where(takes_part).groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct(place.alias("id"), "row", "h")).alias("least"))
    nodes = written(distinct.select("hi", "lo", "n", "bands", F.col("least.row").alias("node"), F.col("least.id").alias("id"), F.col("least.h").alias("h")), "minhash-nodes")
    members = nodes.select(F.explode("bands").alias("key"), "node", "n")
    buckets = written(members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("pivot")).where(F.col("size") > 1), "minhash-buckets")
    shared = written(members.join(buckets, "key").select("key", "node", "n", "pivot"), "minhash-shared")
    fits = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    star = shared.where((F.col("node") != F.col("pivot.node")) & fits).select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()

    def sets_for(wanted: DataFrame) -> DataFrame:
        """node, words: the sets of the nodes wanted, made anew from the text of one row of each."""
        picks = nodes.join(wanted.select(F.col("node").alias("need")), F.col("node") == F.col("need")).select(F.col("id").alias("pick"), F.col("h").alias("of"), "hi", "lo", "node")
        texts = rows.join(picks, (place == F.col("pick")) & (F.col("h") == F.col("of"))).select("text", "hi", "lo", "node")
        return written(texts.mapInPandas(_sets(width), "node long, words binary").dropDuplicates(["node"]), "minhash-sets")

    ids = nodes.select(F.col("node").alias("of"), "id")

    def ordered(links: DataFrame) -> DataFrame:
        """Links between nodes as links between (id, node)."""
        for end in ("a", "b"):
            links = links.join(ids, F.col(end) == F.col("of")).withColumn(end, F.struct("id", F.col(end).alias("node"))).drop("of", "id")
        return links

    def labels_of(links: DataFrame) -> DataFrame:
        return components(ordered(links)).select(F.col("node.node").alias("member"), "label")

    pairs = written(star, "minhash-pairs")
    made = sets_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    one = pairs.join(made.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    two = one.join(made.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    links = written(two.select("a", "b", "wa", "wb").mapInPandas(_confirm(percent), "a long, b long"), "minhash-links")
    labels = labels_of(links)

    # Buckets that hold several components still.
    with_label = lambda df: df.join(labels, F.col("node") == F.col("member"), "left").withColumn("label", F.coalesce("label.node", "node")).drop("member")
    labelled = with_label(shared.select("key", "node", "n")).withColumn("one", F.lit(1))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    labelled = written(labelled.join(several, "key"), "minhash-open")
    sigs = sketch.select(F.col("row").alias("of"), "sig")
    left = _in_blocks(labelled, "one", MEMBERS).join(sigs, F.col("node") == F.col("of")).drop("of").repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    maybe = written(left.mapInPandas(_open(percent), "a long, b long").distinct(), "minhash-maybe")
    if not maybe.isEmpty():
        clusters = components(maybe).select(F.col("label").alias("key"), "node")
        full = with_label(clusters.join(nodes.select(F.col("node").alias("of"), "n"), F.col("node") == F.col("of")).drop("of"))
        full = written(full, "minhash-clusters")
        dealt = _in_blocks(full, "n", WORDS).join(sets_for(full.select("node")).withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
        more = dealt.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInPandas(_exact(percent), "a long, b long")
        links = links.union(written(more, "minhash-links"))
        labels = labels_of(links)
    named = nodes.join(labels, F.col("node") == F.col("member"), "left").select(F.col("hi").alias("h1"), F.col("lo").alias("h2"), F.coalesce("label", F.struct("id", "node")).alias("label"))
    named = written(named, "minhash-named")
    out = sketch.select("id", "row", "n", "hi", "lo").join(named, (F.col("hi") == F.col("h1")) & (F.col("lo") == F.col("h2")), "left")
    least = F.coalesce("label.id", "id")
    if row_col is None:
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), least).alias("component_id"))
    return out.select(F.col("row").alias(row_col), F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(least != LAST, least).alias("component_id"), F.coalesce(F.col("label.node") == F.col("row"), F.lit(True)).alias("kept"))


def oracle(percent: int = 80) -> str:
    """The rows for shingles of two words in DuckDB's SQL, by counting common shingles of all pairs."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({lower}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= {percent} * (len(a.s) + len(b.s) - n)),
two_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, t.y FROM reach r JOIN two_way t ON r.y = t.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = x"""
