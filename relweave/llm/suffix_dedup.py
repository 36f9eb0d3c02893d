"""Exact-substring deduplication by bucket-pointer refinement.

Every byte that is covered by a string of 50 bytes which also starts in a document with a smaller id is removed. In terms of
suffixes: two positions match if their suffixes share the first 50 bytes, so suffixes are put into classes to that depth.

Distribution. All suffixes of one class must meet, but suffixes alone in their class need not travel. Documents are packed
into blocks of a few megabytes. Each 50-byte window has a key, the least hash of its 16-byte grams; equal windows have equal
keys, and consecutive windows mostly share theirs, so a block is a list of runs of windows with one key. First only the distinct
keys of each block travel (dealt by key), and bits come back for each: whether another document has it, and whether it is hot,
which is if its runs have more than ``HOT`` texts in all blocks. Runs of hot keys are taken apart into windows, each dealt by the hash of
all its 50 bytes; of these, too, the hashes travel first, and only windows that another document has go on. Then the texts of
runs and windows with shared keys travel, each distinct text once per block with its least document. A key that a third of all
documents have is thus one entry per block if its text is the same, and is spread over all buckets if its texts differ.

Refinement. Where the texts of a key meet, equal ones are joined first; a key with one text left holds no two suffixes to be told
apart. Suffixes of keys with several texts get initial buckets by their first 8 bytes (q-grams, taken exactly). A bucket for 16
bytes is a bucket sorted by its suffixes' pointers to the buckets of the suffixes 8 positions on; a bucket's number is the place of its
head, so refined buckets keep to the place of the one that they come from, and the pointers that are updated by one pass are what the next
ones sort by: 16 positions on for 32 bytes, 18 on for 50. Suffixes alone in their bucket leave, their pointer being final. Every class
then has its least document, which goes back to the blocks as runs.

Cases: a null text counts as empty; texts under 50 bytes lose nothing; documents with one id count as one document; a null id
counts as greater than all others; ties don't exist as ids are compared strictly; empty tables give no rows; extra columns are
not read, whatever their names; repeated rows lose nothing to one another. Ids are integers. Texts are worked on whole; a block holds one text at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import written

DEPTH, GRAM = 50, 16
#: Bytes of text in a block, and of all text for each bucket of keys.
BLOCK, PER_BUCKET = 8_000_000, 12_000_000
#: Positions that are hashed at a time.
CHUNK = 1 << 18
#: Distinct texts of a key, over all blocks, from which its windows are dealt one by one.
HOT = 1 << 14
LAST = np.iinfo(np.int64).max
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """8 bytes from each position as a number; equal numbers for equal bytes."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)) if len(data) > 7 else np.empty(0, _U)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    w = _grams(data)
    return _mix(w[:-8] * _U(0x9E3779B97F4A7C15) + (w[8:] ^ _U(0xD6E8FEB86659FD93)) * _U(0xC2B2AE3D27D4EB4F)) if len(w) > 8 else np.empty(0, _U)


def _window_keys(data: np.ndarray) -> np.ndarray:
    """For each window of DEPTH bytes the least hash of its grams."""
    h, width = _gram_hashes(data), 1
    while 2 * width <= DEPTH - GRAM + 1:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = DEPTH - GRAM + 1 - width
    return np.minimum(h[: len(h) - rest], h[rest:])


def _text_keys(texts: list[bytes]) -> np.ndarray:
    """The least hash of each text's grams: its windows' key."""
    out, some, size = [], [], 0
    for i, t in enumerate(texts, 1):
        some.append(t)
        size += len(t)
        if size > CHUNK or i == len(texts):
            h = _gram_hashes(np.frombuffer(b"".join(some), np.uint8))
            lengths = np.array([len(x) for x in some], np.int64)
            begin = np.cumsum(lengths) - lengths
            crossing = (begin[1:, None] - np.arange(1, GRAM)).ravel()
            h[crossing[crossing < len(h)]] = np.iinfo(_U).max
            out.append(np.minimum.reduceat(h, begin))
            some, size = [], 0
    return np.concatenate(out) if out else np.empty(0, _U)


def _zip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes laid out by place, compressed."""
    return _zip(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _from_planes(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_unzip(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


class Runs:
    """Runs of windows: for each its first window, the place after its last window, document, key and bucket; and the distinct
    keys, by bucket and value: ``several`` tells whether several documents have it, ``texts`` how many distinct texts."""

    def __init__(self, first: np.ndarray, stop: np.ndarray, doc: np.ndarray, key: np.ndarray, bucket: np.ndarray, ids: np.ndarray, data: np.ndarray):
        self.first, self.stop, self.doc, self.key, self.bucket = first, stop, doc, key, bucket
        grams = _grams(data)
        text = _mix(grams[first] + _mix(grams[stop + DEPTH - 9] ^ (stop - first).astype(_U))) if len(first) else key
        order = np.lexsort((text, key, bucket))
        k, t = key[order], text[order]
        new, differs = np.ones(len(k), bool), np.ones(len(k), np.int64)
        new[1:] = k[1:] != k[:-1]
        differs[1:] = new[1:] | (t[1:] != t[:-1])
        self.place = np.empty(len(k), np.int64)  # of each run's key among the distinct ones
        self.place[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.keys, self.bucket_of = k[heads], bucket[order][heads]
        docs = ids[doc[order]]
        self.several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads) if len(heads) else np.empty(0, bool)
        self.texts = np.add.reduceat(differs, heads).astype(np.uint32) if len(heads) else np.empty(0, np.uint32)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """Bucket and its range of distinct keys."""
        edges = [*np.flatnonzero(np.diff(self.bucket_of, prepend=-1)).tolist(), len(self.bucket_of)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(self.bucket_of[lo]), lo, hi

    def bits(self, masks: list, name: str) -> np.ndarray:
        """For each run what the masks of its bucket tell of its key."""
        out, at = np.zeros(len(self.keys), bool), {b: (lo, hi) for b, lo, hi in self.by_bucket()}
        for m in masks:
            if m["bucket"] in at and m[name] is not None:
                lo, hi = at[m["bucket"]]
                out[lo:hi] = np.unpackbits(np.frombuffer(m[name], np.uint8), count=hi - lo).astype(bool)
        return out[self.place]


class Block:
    """A block's documents, its runs (``one``) and, once masks tell which keys are hot, the windows of those (``two``, in buckets
    from ``buckets`` on)."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes, buckets: int, masks: list | None = None):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.raw = _unzip(text)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        data = np.frombuffer(self.raw, np.uint8)
        first, stop, doc, key = self._runs(data, np.flatnonzero(self.sizes >= DEPTH))
        self.one = Runs(first, stop, doc, key, (key % _U(buckets)).astype(np.int64), self.ids, data)
        if masks is None:
            return
        live, hot = self.one.bits(masks, "mask"), self.one.bits(masks, "hot")
        wide = np.flatnonzero(live & hot)
        count = stop[wide] - first[wide]
        window = np.repeat(first[wide] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        key = self._whole(data, window)
        self.two = Runs(window, window + 1, np.repeat(doc[wide], count), key, (key % _U(buckets)).astype(np.int64) + buckets, self.ids, data)
        self.first, self.stop, self.doc, self.bucket = (np.concatenate([getattr(r, x) for r in (self.one, self.two)]) for x in ("first", "stop", "doc", "bucket"))
        self.live = np.concatenate([live & ~hot, self.two.bits(masks, "mask")])

    @staticmethod
    def _whole(data: np.ndarray, window: np.ndarray) -> np.ndarray:
        """A hash of all bytes of each window."""
        grams, out = _grams(data), np.zeros(len(window), _U)
        for at in (*range(0, DEPTH - 8, 8), DEPTH - 8) if len(window) else ():
            out = _mix(out * _U(0x9E3779B97F4A7C15) + grams[window + at])
        return out

    def _runs(self, data: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        opens, closes = self.starts[long], self.ends[long] - DEPTH + 1
        first, keys = [np.empty(0, np.int64)], [np.empty(0, _U)]
        for lo in range(0, max(0, len(data) - DEPTH + 1) if len(long) else 0, CHUNK):
            back = max(0, lo - 1)
            low = _window_keys(data[back : lo + CHUNK + DEPTH - 1])
            at = back + 1 + np.flatnonzero(low[1:] != low[:-1])
            doc = np.searchsorted(opens, at, "right") - 1
            at = at[(doc >= 0) & (at < closes[doc])]
            own = opens[np.searchsorted(opens, lo) : np.searchsorted(opens, lo + CHUNK)]
            if len(at):
                own = own[at[np.minimum(np.searchsorted(at, own), len(at) - 1)] != own]
            at = np.insert(at, np.searchsorted(at, own), own)
            first.append(at)
            keys.append(low[at - back])
        first, key = np.concatenate(first), _mix(np.concatenate(keys))
        doc = long[np.searchsorted(opens, first, "right") - 1] if len(first) else first
        return first, np.minimum(np.append(first[1:], len(data))[: len(first)], self.ends[doc] - DEPTH + 1), doc, key

    def shared_texts(self) -> dict[int, tuple[list[bytes], list[int], list[int], list[list[int]]]]:
        """By bucket the distinct texts of runs whose keys are shared, the least and greatest id of each, its runs."""
        runs = np.flatnonzero(self.live)
        out: dict = {}
        buckets, begin, end, ids = (x.tolist() for x in (self.bucket[runs], self.first[runs], self.stop[runs] + DEPTH - 1, self.ids[self.doc[runs]]))
        raw, seen = self.raw, {}
        for run, b, lo, hi, d in zip(runs.tolist(), buckets, begin, end, ids, strict=True):
            # A window that is dealt by its own hash is no run of its key, even if the text is the same.
            text = (raw[lo:hi], b)
            if (i := seen.get(text)) is None:
                texts, least, most, where = out.setdefault(b, ([], [], [], []))
                seen[text] = len(texts)
                texts.append(text[0])
                least.append(d)
                most.append(d)
                where.append([run])
            else:
                _, least, most, where = out[b]
                least[i], most[i] = min(least[i], d), max(most[i], d)
                where[i].append(run)
        return out


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, texts, size, n, part = [], [], 0, 0, TaskContext.get().partitionId()

    def block() -> pd.DataFrame:
        return pd.DataFrame({"block": [part << 32 | n], "ids": [np.array(ids, np.int64).tobytes()], "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "text": [_zip(b"".join(texts))], "n_bytes": [size]})

    for b in batches:
        for i, t in zip(b["id"], b["text"], strict=True):
            raw = (t or "").encode()
            if texts and size + len(raw) > BLOCK:
                yield block()
                ids, texts, size, n = [], [], 0, n + 1
            ids.append(LAST if pd.isna(i) else int(i))
            texts.append(raw)
            size += len(raw)
    if texts:
        yield block()


def _keys(buckets: int):
    """Keys of a block's runs or, where masks are given, of its hot windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                masks = getattr(r, "masks", None)
                x = Block(r.ids, r.sizes, r.text, buckets, masks)
                x = x.one if masks is None else x.two
                rows = [(k, r.block, _planes(np.diff(x.keys[lo:hi], prepend=_U(0))), np.packbits(x.several[lo:hi]).tobytes(), _planes(x.texts[lo:hi])) for k, lo, hi in x.by_bucket()]
                yield pd.DataFrame(rows, columns=["bucket", "block", "keys", "several", "texts"])

    return run


def _shared(hot: int):
    """For each block bits for each of its keys in a bucket: whether more than one document has it, and whether its runs have more
    than ``hot`` texts in all blocks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_from_planes(k, _U), dtype=_U) for k in rows["keys"]]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(rows["several"], keys, strict=True)]
        texts = np.concatenate([_from_planes(x, np.uint32) for x in rows["texts"]]).astype(np.int64)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        k = every[order]
        same = k[1:] == k[:-1]
        shared = np.zeros(len(k), bool)
        shared[1:] |= same
        shared[:-1] |= same
        out, many = np.empty(len(k), bool), np.empty(len(k), bool)
        out[order] = shared
        heads = np.flatnonzero(np.append(True, ~same))
        many[order] = np.repeat(np.add.reduceat(texts[order], heads) > hot, np.diff(np.append(heads, len(k))))
        # A key that several documents of one block have is shared as well; in every block that has it, it is found so or above.
        out |= np.concatenate(several).astype(bool)
        many &= out
        ends = np.cumsum([len(x) for x in keys])
        masks = [(out[hi - len(x) : hi], many[hi - len(x) : hi]) for x, hi in zip(keys, ends, strict=True)]
        keep = [i for i, (m, _) in enumerate(masks) if m.any()]
        bits = lambda x: np.packbits(x).tobytes()
        return pd.DataFrame({"block": rows["block"].to_numpy()[keep], "bucket": np.full(len(keep), key[0]), "mask": [bits(masks[i][0]) for i in keep], "hot": [bits(masks[i][1]) if masks[i][1].any() else None for i in keep]})

    return run


def _texts(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                found = Block(r.ids, r.sizes, r.text, buckets, r.masks).shared_texts() if r.masks is not None else {}
                rows = [(k, r.block, _planes(np.array([len(t) for t in texts], np.uint32)), _planes(np.array(least, np.int64)), _planes(np.array(most, np.int64)), _zip(b"".join(texts))) for k, (texts, least, most, _) in found.items()]
                yield pd.DataFrame(rows, columns=["bucket", "block", "sizes", "least", "most", "texts"])

    return run


def refine(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each text the least document of each of its windows of DEPTH bytes over all texts, by bucket-pointer refinement.

    ``docs``: the least document of each text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(DEPTH), np.uint8)
    starts = np.cumsum(sizes) - sizes
    windows = sizes - DEPTH + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]

    def heads(x: np.ndarray) -> np.ndarray:
        """Where sorted numbers change."""
        return np.append(True, x[1:] != x[:-1])

    def left(first: np.ndarray) -> np.ndarray:
        """Who is not alone, of sorted ones that change where ``first`` says so."""
        return ~(first & np.append(first[1:], True))

    def refined(tied: np.ndarray, step: int) -> np.ndarray:
        """Sorts the buckets of the tied suffixes by the pointers ``step`` positions on and updates their own; gives those still tied."""
        key = at[tied] << _U(32) | at[tied + step]
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        first, outer = heads(key), heads(key >> _U(32))
        n = np.arange(len(key))
        begin = np.maximum.accumulate(np.where(outer, n, 0))
        at[tied] = (key >> _U(32)) + (np.maximum.accumulate(np.where(first, n, 0)) - begin).astype(_U)
        return tied[left(first)]

    # A suffix's pointer: the place of its bucket's head in the order of all. Across two texts' border it is never used.
    grams = _grams(data)
    order = np.argsort(grams)
    first = heads(grams[order])
    at = np.zeros(len(grams) + DEPTH, _U)
    at[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    tied = order[left(first)]
    for step in (8, 16):
        tied = refined(tied, step) if len(tied) else tied
    inside = np.zeros(len(data), bool)
    inside[place] = True
    tied = tied[inside[tied]]
    least = docs[owner]
    if len(tied):
        key = at[tied] << _U(32) | at[tied + DEPTH - 32]
        order = np.argsort(key)
        tied, number = tied[order], np.cumsum(heads(key[order])) - 1
        where = np.empty(len(data), np.int64)
        where[place] = np.arange(len(place))
        low = np.full(number[-1] + 1, LAST)
        np.minimum.at(low, number, least[where[tied]])
        least[where[tied]] = low[number]
    return np.split(least, np.cumsum(windows)[:-1])


def _answers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each block and text of a bucket the least document of each window, as runs; only where some run may lose bytes."""
    index: dict[bytes, int] = {}
    texts, docs, per_block = [], [], []
    for r in rows.itertuples():
        sizes, least, most, raw = _from_planes(r.sizes, np.uint32), _from_planes(r.least, np.int64), _from_planes(r.most, np.int64), _unzip(r.texts)
        at, mine = 0, []
        for n, d in zip(sizes.tolist(), least.tolist(), strict=True):
            t = raw[at : at + n]
            at += n
            if (i := index.get(t)) is None:
                i = index[t] = len(texts)
                texts.append(t)
                docs.append(d)
            elif d < docs[i]:
                docs[i] = d
            mine.append(i)
        per_block.append((r.block, np.array(mine, np.int64), most))
    del index
    docs = np.array(docs, np.int64)
    # Keys with one text need no refinement: each window's least document is the text's.
    sizes = np.array([len(t) for t in texts], np.int64)
    keys = _text_keys(texts)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    many = np.flatnonzero(counts[inverse] > 1)
    refined, lo = {}, 0
    order = many[np.argsort(inverse[many], kind="stable")]  # the texts of a key stay together
    group = inverse[order]
    while lo < len(order):
        hi = min(len(order), lo + 60_000)
        while hi < len(order) and group[hi] == group[hi - 1]:
            hi += 1
        some = order[lo:hi]
        refined |= dict(zip(some.tolist(), refine([texts[i] for i in some.tolist()], docs[some]), strict=True))
        lo = hi
    out = []
    for block, mine, most in per_block:
        which, counts_, lens, vals = [], [], [], []
        for i, (t, m) in enumerate(zip(mine.tolist(), most.tolist(), strict=True)):
            w = refined.get(t)
            if w is None:
                if docs[t] < m:
                    which.append(i)
                    counts_.append(1)
                    lens.append([sizes[t] - DEPTH + 1])
                    vals.append([docs[t]])
            elif (w < m).any():
                edges = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)]
                which.append(i)
                counts_.append(len(edges) - 1)
                lens.append([hi - lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
                vals.append(w[edges[:-1]])
        if which:
            out.append((block, key[0], _planes(np.array(which, np.uint32)), _planes(np.array(counts_, np.uint32)), _planes(np.concatenate(lens).astype(np.uint32)), _planes(np.concatenate(vals).astype(np.int64))))
    return pd.DataFrame(out, columns=["block", "bucket", "which", "counts", "lens", "vals"])


def _remove(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = Block(r.ids, r.sizes, r.text, buckets, r.masks if r.masks is not None else [])
                gone = np.zeros(len(x.raw) + 1, np.int32)
                found = x.shared_texts() if r.answers is not None else {}
                whole, least = [], []  # runs all of whose windows have one least document
                for a in r.answers if r.answers is not None else []:
                    where = found[a["bucket"]][3]
                    at = 0
                    lens, vals = _from_planes(a["lens"], np.uint32).astype(np.int64).tolist(), _from_planes(a["vals"], np.int64).tolist()
                    for i, n in zip(_from_planes(a["which"], np.uint32).tolist(), _from_planes(a["counts"], np.uint32).tolist(), strict=True):
                        if n == 1:
                            whole += where[i]
                            least += [vals[at]] * len(where[i])
                        else:
                            for run_ in where[i]:
                                own, lo = x.ids[x.doc[run_]], int(x.first[run_])
                                for k in range(at, at + n):
                                    if vals[k] < own:
                                        gone[lo] += 1
                                        gone[lo + lens[k] + DEPTH - 1] -= 1
                                    lo += lens[k]
                        at += n
                whole = np.array(whole, np.int64)
                whole = whole[np.array(least, np.int64) < x.ids[x.doc[whole]]] if len(whole) else whole
                np.add.at(gone, x.first[whole], 1)
                np.subtract.at(gone, x.stop[whole] + DEPTH - 1, 1)
                lost = np.cumsum(gone, out=gone)[:-1] > 0
                raw = np.frombuffer(x.raw, np.uint8)
                some, size = [], 0
                for d, (lo, hi) in enumerate(zip(x.starts.tolist(), x.ends.tolist(), strict=True)):
                    out = lost[lo:hi]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                    some.append((None if x.ids[d] == LAST else int(x.ids[d]), hi - lo, [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)], raw[lo:hi][~out].tobytes()))
                yield pd.DataFrame(some, columns=["id", "n_bytes", "spans", "kept"]).astype({"id": "Int64"})

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, spans (removed byte ranges, maximal, array of struct(start, end)), kept (remaining bytes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = written(rows.mapInPandas(_pack, "block long, ids binary, sizes binary, text binary, n_bytes long"), "suffix-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PER_BUCKET + 1)
    blocks = blocks.select("block", "ids", "sizes", "text")
    told, kind = "bucket long, block long, keys binary, several binary, texts binary", "block long, bucket long, mask binary, hot binary"
    masks = written(blocks.mapInPandas(_keys(n), told).groupBy("bucket").applyInPandas(_shared(HOT), kind), "suffix-masks")

    def with_masks(found: DataFrame) -> DataFrame:
        return blocks.join(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask", "hot")).alias("masks")), "block", "left")  # bits for each key of one block

    # Windows of hot keys: what their hashes tell replaces what the keys told. No window is told hot.
    wide = with_masks(masks).where(F.exists("masks", lambda m: m["hot"].isNotNull()))
    masks = masks.union(written(wide.mapInPandas(_keys(n), told).groupBy("bucket").applyInPandas(_shared(LAST), kind), "suffix-window-masks"))
    marked = with_masks(masks)
    texts = marked.mapInPandas(_texts(n), "bucket long, block long, sizes binary, least binary, most binary, texts binary")
    answers = written(texts.groupBy("bucket").applyInPandas(_answers, "block long, bucket long, which binary, counts binary, lens binary, vals binary"), "suffix-answers")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "which", "counts", "lens", "vals")).alias("answers"))  # of one block's texts
    final = marked.join(told, "block", "left").mapInPandas(_remove(n), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return final.withColumnRenamed("id", id_col)


def oracle() -> str:
    """The query's rows in DuckDB's SQL, for documents with ids of their own: every string of DEPTH bytes, in hexadecimal digits."""
    return f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, p, substring(h, 2000 * p + 1, {2000 + 2 * DEPTH - 2}) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS p FROM texts)),
windows AS (SELECT doc_id, 1000 * p + k AS s, substring(c, 2 * k + 1, {2 * DEPTH}) AS g FROM (SELECT doc_id, p, c, unnest(range(0, least(1000, length(c) // 2 - {DEPTH - 1}))) AS k FROM parts)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (SELECT w.doc_id, w.s FROM windows w JOIN firsts f ON w.g = f.g WHERE f.least < w.doc_id),
edges AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {DEPTH}, true)::INTEGER AS opens FROM gone),
numbered AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM edges),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + {DEPTH} AS b FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM spans
  UNION ALL SELECT t.doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id GROUP BY t.doc_id),
kept AS (SELECT p.doc_id, string_agg(substring(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo, hi) AS h FROM pieces p JOIN texts t ON t.doc_id = p.doc_id GROUP BY p.doc_id),
counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts t JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN counts c ON c.doc_id = t.doc_id"""
