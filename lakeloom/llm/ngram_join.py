"""Exact n-gram Jaccard self-join of documents, and its groups.

A document's set is its distinct word shingles as 64-bit hashes.  Documents of
equal sets are one class and are compared once.

1. Every class emits its prefix: with n shingles in a fixed global order, the
   first n - ceil(t n) + 1.  Two sets of similarity t or more share a prefix
   shingle, whatever the order; very frequent shingles are last in it, so that
   common passages make no candidates.
2. The classes of one prefix shingle are a tile, cut in bands of sizes that allow
   a link.  A small tile gives its pairs, a large one pairs each class with the
   leader of its band.
3. Candidate pairs are bounded from above by the bit counts of hashed bitmap
   signatures, then counted exactly on the sorted arrays.
4. The links so far make groups.  What large tiles have left, pairs of different
   groups only, is compared the same way, so that a group of very many near
   copies costs about one comparison a member and yet no group is parted.
5. If links are asked for, the classes of each group are then compared all with
   all, in pairs of blocks: a link is always within a group, so that each is
   counted once.  Only counts leave a block, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, settle, sift
from .components import connected_components

SLICE_BYTES = 1_500_000  # bytes of text hashed at once; longer texts are hashed in parts
COUNTED = 4_000_000  # shingles that one task counts at a time
LOCAL_MIN = 4  # counts below this are not reported by a task
FREQUENT = 256  # shingles reported this often come last in the order
FREQUENT_MOST = 1 << 20  # the list of frequent shingles is no longer than this
SMALL_TILE = 12  # tiles up to this size give all their pairs at once
HOT_LEAST = 2048  # and with more than so many rows
BANDS_MOST = 256  # size bands
BITS_LEAST, BITS_MOST = 64, 1 << 18  # sizes of a bitmap signature
BITS_EACH = 4  # bits for each shingle at least, so that few share one
LARGE_TILE = 128  # open tiles above this size are compared with bitmaps at hand
TILE_ROWS = 2048  # members of a tile in one block; larger tiles are pairs of blocks
GROUP_ROWS = 512  # classes of a group in one block, where links are counted
GROUP_HASHES = 500_000  # and their shingles, so that groups of long texts have smaller blocks
COLUMNS = 4096  # shingles of a block compared at a time
LONG_WORD = 128  # bytes of a word that are mixed eight at a time; a cryptographic hash takes the rest
HOT_TILES = 1024  # tiles with more than one in so many of all prefix shingles are dealt over many tasks

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # public mixing constants


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)  # mask of the first n of 8 bytes


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``: its length and its bytes, eight at a time, each mixed into what came before.

    No step is linear in the bytes over the whole word, so words of a regular
    structure collide no more than others.
    """
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(~_WHITE[low[: len(data)]], prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(data) + 1, "<u8", low.data, strides=(1,))  # the eight bytes from each place on
    out = _mix(size.astype(np.uint64) * _M1)
    rest = np.arange(len(start))
    for step in range(0, LONG_WORD, 8):
        rest = rest[size[rest] > step]
        if not len(rest):
            break
        out[rest] = _mix(out[rest] * _M3 + (eight[start[rest] + step] & _KEPT[np.minimum(size[rest] - step, 8)]))
    for i in rest[size[rest] > LONG_WORD]:
        tail = low[start[i] + LONG_WORD : start[i] + size[i]].tobytes()
        out[i] = _mix(out[i : i + 1] * _M3 + np.frombuffer(hashlib.blake2b(tail, digest_size=8).digest(), "<u8"))[0]
    return out, start


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of a text of any length, in parts cut at white space."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + SLICE_BYTES)
        while stop < len(text) and not _WHITE[text[stop]]:
            stop += 1
        out.append(_words(text[at:stop])[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _chain(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k words in a row."""
    n = len(words) - k + 1
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = _mix(out * _M1 + words[j : j + n])
    return out


def _one_set(words: np.ndarray, chained: np.ndarray | None, k: int) -> np.ndarray:
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return _chain(words, len(words), len(words))
    return np.unique(_chain(words, k, 0) if chained is None else chained)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    with np.errstate(over="ignore"):
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_BYTES):
                size += len(texts[last]) + 1
                last += 1
            if last == first + 1 and len(texts[first]) > SLICE_BYTES:
                yield _one_set(_long_words(texts[first]), None, k)
            else:
                words, start = _words(b" ".join(texts[first:last]))
                begin = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
                cut = np.searchsorted(start, begin)
                chained = _chain(words, k, 0) if len(words) >= k else None
                for i in range(last - first):
                    a, b = cut[i], cut[i + 1]
                    yield _one_set(words[a:b], chained[a : b - k + 1] if b - a >= k else None, k)
            first = last


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n shares with any it links to."""
    return -(-percent * n // 100)


def prefix(found: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n - needed + 1 hashes in the order (frequent last, then by hash)."""
    size = len(found) - needed(len(found), percent) + 1
    if len(frequent):
        at = np.searchsorted(frequent, found)
        common = frequent[np.minimum(at, len(frequent) - 1)] == found
        if common[:size].any():
            return np.concatenate((found[~common], found[common]))[:size]
    return found[:size]


def signature(found: np.ndarray) -> bytes:
    """Bitmap of hashed shingles, a power of two of bits."""
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * len(found) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(found >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def most_overlap(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """Upper bound of the overlap: a bit that one set has alone stands for a shingle that the other lacks."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    only_a, only_b = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
    return min(n_a - only_a, n_b - only_b)


def links(n_a: int, n_b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def overlap_of(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def _batch(names: list[str], types: list[pa.DataType], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def scan(docs: DataFrame, k: int) -> DataFrame:
    """One pass over all texts: a row for each document (doc_id, text_hash, n, digest of its set), and counts of shingles (shingle, seen).

    Each task reports the shingles that it sees LOCAL_MIN times in COUNTED or more.
    """
    names = ["doc_id", "text_hash", "n", "digest", "shingle", "seen"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def report(counted: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(counted), return_counts=True)
        keep = n >= LOCAL_MIN
        none = [None] * int(keep.sum())
        return _batch(names, types, none, none, none, none, values[keep].view(np.int64), n[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            n, digest = [], []
            for found in shingle_sets(_texts(batch, 2), k):
                n.append(len(found))
                digest.append(set_digest(found))
                held.append(found)
                size += len(found)
                if size >= COUNTED:
                    yield report(held)
                    held, size = [], 0
            none = [None] * len(n)
            yield _batch(names, types, batch.column(0), batch.column(1), n, digest, none, none)
        if held:
            yield report(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, shingle long, seen long")


def set_digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def frequent_shingles(scanned: DataFrame) -> np.ndarray:
    """Hashes of very frequent shingles, from the counts of :func:`scan`.

    Only the order of shingles depends on the list, never the result, and
    FREQUENT_MOST bounds it: the threshold rises with the total.
    """
    counts = scanned.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("n")).filter(F.col("n") >= FREQUENT)
    counts = materialize(counts, "frequent")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counts.filter(F.col("n") >= max(FREQUENT, -(-total // FREQUENT_MOST)))
    out = np.array([r[0] for r in kept.select("shingle").toLocalIterator()], np.int64).view(np.uint64)
    remove(counts)
    return np.sort(out)


def band_starts(percent: int) -> np.ndarray:
    """Least size of each band: a size links with none above the band next to its own (exact, in integers)."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, 100 * out[-1] // percent + 1))
        if len(out) > BANDS_MOST:  # of narrow bands, as above 99 percent, several are one
            return band_starts(percent - 1)
    return np.array(out, np.int64)


def chosen_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids`` (rep), and of some others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return sift(rows, F.xxhash64("doc_id"), ids, F.xxhash64("rep"))


def class_rows(docs: DataFrame, classes: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """digest, number of frequent shingles, size band, prefix keys and bitmap of each class, from the text of its first document."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_MOST hashes
    starts = band_starts(percent)
    names = ["digest", "common", "band", "keys", "bits"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            sets = [x for x in shingle_sets(_texts(batch, 1), k) if len(x)]
            yield _batch(
                names, types, [set_digest(x) for x in sets], [overlap_of(common, x) for x in sets], np.searchsorted(starts, [len(x) for x in sets], "right"),
                [prefix(x, common, percent).view(np.int64) for x in sets], [signature(x) for x in sets],
            )

    made = chosen_texts(docs, classes).mapInArrow(run, "digest binary, common long, band long, keys array<long>, bits binary")
    # Rows of one digest are equal, so that each task sends one of them at most.
    return made.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("common", "band", "keys", "bits")])


def _tile_pairs(n: np.ndarray, nid: np.ndarray, pos: np.ndarray, percent: int) -> list[tuple[int, int]]:
    out = []
    for i in range(len(n)):
        for j in range(i + 1, len(n)):
            if possible(int(n[i]), int(pos[i]), int(n[j]), int(pos[j]), percent):
                out.append((int(nid[i]), int(nid[j])))
    return out


def possible(n_a: int, pos_a: int, n_b: int, pos_b: int, percent: int) -> bool:
    """Whether sizes and the places of a shared shingle in both orders allow a link."""
    most = min(pos_a, pos_b) + 1 + min(n_a - pos_a - 1, n_b - pos_b - 1)
    return links(n_a, n_b, most, percent)


def hot_shingles(rows: DataFrame) -> DataFrame | None:
    """Shingles of tiles with more than one in HOT_TILES of all rows, found by a sketch of heavy hitters; HOT_TILES rows at most."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(shingle, {HOT_TILES}, {HOT_TILES * 16})").alias("top")).first()
    least = max(HOT_LEAST, found["n"] // HOT_TILES)
    hot = [(t["item"],) for t in found["top"] or [] if t["count"] > least]
    return rows.sparkSession.createDataFrame(hot, "shingle long") if hot else None


def tiles(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of small tiles and of the leaders of large ones, and members (a, null, shingle, band, n, pos) of large tiles; and those of hot tiles.

    A tile is sorted by band, and in a band by the number of frequent shingles:
    of many variants of one text, that with the fewest changes comes first, and
    this leader is paired with the others of its band.  A hot tile is in no one
    task: its leaders are found by aggregation and sent to its rows.
    """
    rows = classes.select("nid", "n", "common", "band", F.posexplode("keys").alias("pos", "shingle")).withColumn("pos", F.col("pos").cast("long"))
    hot = hot_shingles(rows)
    large = None
    if hot is not None:
        hot = F.broadcast(hot)  # at most HOT_TILES rows
        large = _hot_tiles(rows.join(hot, "shingle"), percent)
        rows = rows.join(hot, "shingle", "left_anti")
    rows = rows.repartition("shingle").sortWithinPartitions("shingle", "band", F.desc("common"), "nid")
    rows = rows.select("shingle", "band", "n", "nid", "pos")
    names, types = ["a", "b", "shingle", "band", "n", "pos"], [pa.int64()] * 6

    def emit(pairs: list[np.ndarray], members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if pairs:
            both = np.concatenate(pairs)
            both = np.unique(np.sort(both, axis=1), axis=0)
            none = [None] * len(both)
            yield _batch(names, types, both[:, 0], both[:, 1], none, none, none, none)
        if members:
            m = np.concatenate(members)
            yield _batch(names, types, m[:, 3], [None] * len(m), m[:, 0], m[:, 1], m[:, 2], m[:, 4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)
        leader: np.ndarray | None = None  # of the unfinished large tile's last band
        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            pairs, members, held, leader = _work(rows, leader, False, percent)
            yield from emit(pairs, members)
        pairs, members, _, _ = _work(held, leader, True, percent)
        yield from emit(pairs, members)

    return rows.mapInArrow(run, "a long, b long, shingle long, band long, n long, pos long"), large


def _hot_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Members of hot tiles and the pairs with their leaders, as :func:`tiles` gives them."""
    lead = rows.groupBy("shingle", "band").agg(F.min(F.struct((-F.col("common")).alias("few"), "nid", "n")).alias("lead"))
    lead = F.broadcast(lead.select(F.col("shingle").alias("_s"), F.col("band").alias("_b"), F.col("lead.nid").alias("one"), F.col("lead.n").alias("n_one")))  # HOT_TILES times bands at most
    paired = rows.join(lead, F.expr("shingle = _s and band = _b and nid <> one")).filter(f"100 * least(n, n_one) >= {percent} * greatest(n, n_one)")
    none = F.lit(None).cast("long")
    pairs = paired.select(F.least("nid", "one").alias("a"), F.greatest("nid", "one").alias("b")).distinct()
    pairs = pairs.select("a", "b", none.alias("shingle"), none.alias("band"), none.alias("n"), none.alias("pos"))
    return rows.select(F.col("nid").alias("a"), none.alias("b"), "shingle", "band", "n", "pos").unionByName(pairs)


def _work(rows: np.ndarray, leader: np.ndarray | None, final: bool, percent: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray | None]:
    """Pairs and members of the tiles in sorted (shingle, band, n, nid, pos) rows; rows to hold, and the leader of a tile that may go on."""
    pairs: list[np.ndarray] = []
    members: list[np.ndarray] = []
    if not len(rows):
        return pairs, members, rows, leader
    begin = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1))
    end = np.append(begin[1:], len(rows))
    going = leader is not None and leader[0] == rows[0, 0]  # the first tile is the rest of a large one
    held = rows[:0]
    if not final and len(rows) - begin[-1] <= SMALL_TILE and not (going and len(begin) == 1):
        held, begin, end = rows[begin[-1] :], begin[:-1], end[:-1]
    size = end - begin
    two = np.flatnonzero(size == 2)
    rest = np.flatnonzero(size > 2)
    if going:
        two, rest = two[two != 0], np.unique(np.append(rest, 0))
    if len(two):
        a, b = rows[begin[two]], rows[begin[two] + 1]
        most = np.minimum(a[:, 4], b[:, 4]) + 1 + np.minimum(a[:, 2] - a[:, 4], b[:, 2] - b[:, 4]) - 1
        ok = 100 * most >= percent * (a[:, 2] + b[:, 2] - most)
        pairs.append(np.stack((a[ok, 3], b[ok, 3]), axis=1))
    last: np.ndarray | None = None
    for g in rest:
        tile = rows[begin[g] : end[g]]
        lead = leader if going and g == 0 else None
        if lead is None and len(tile) <= SMALL_TILE:
            if found := _tile_pairs(tile[:, 2], tile[:, 3], tile[:, 4], percent):
                pairs.append(np.array(found, np.int64))
            continue
        members.append(tile)
        for start in np.concatenate(([0], np.flatnonzero(tile[1:, 1] != tile[:-1, 1]) + 1)):
            own = tile[start : start + np.searchsorted(tile[start:, 1], tile[start, 1], side="right")]
            if lead is None or lead[1] != own[0, 1]:
                lead, own = own[0], own[1:]
            least, most = np.minimum(own[:, 2], lead[2]), np.maximum(own[:, 2], lead[2])
            own = own[100 * least >= percent * most]
            if len(own):
                pairs.append(np.stack((np.full(len(own), lead[3]), own[:, 3]), axis=1))
        if g == len(begin) - 1 and not len(held):
            last = lead
    return pairs, members, held, last


class _Join:
    """What the steps of one join share."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent = docs, classes, k, percent

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose bitmaps allow a link."""
        percent = self.percent
        c = self.classes
        one = c.select(F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        two = c.select(F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_a, bits_a, n_b, bits_b = (batch.column(i).to_pylist() for i in range(2, 6))
                keep = [links(x, y, most_overlap(x, p, y, q), percent) for x, p, y, q in zip(n_a, bits_a, n_b, bits_b, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
        return joined.mapInArrow(run, "a long, b long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(nid, hashes) of the classes in ``nodes``, from the text of each class's first document."""
        k = self.k
        need = materialize(nodes.join(self.classes.select("nid", "digest", "rep"), "nid"), "need")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [x for x in shingle_sets(_texts(batch, 1), k) if len(x)]
                yield _batch(["digest", "hashes"], [pa.binary()] * 2, [set_digest(x) for x in sets], [x.tobytes() for x in sets])

        made = chosen_texts(self.docs, need).mapInArrow(run, "digest binary, hashes binary")
        made = made.groupBy("digest").agg(F.first("hashes").alias("hashes"))  # equal in all rows of a digest
        return made.join(need.select("digest", "nid"), "digest").select("nid", "hashes")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link: bounded by bitmaps, then counted on sorted arrays."""
        percent = self.percent
        near = materialize(self.bounded(pairs), "near")
        nodes = near.select(F.col("a").alias("nid")).unionByName(near.select(F.col("b").alias("nid"))).distinct()
        sets = materialize(self.sets(nodes), "sets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, two = batch.column(2), batch.column(3)
                keep = []
                for i in range(batch.num_rows):
                    x, y = np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64)
                    keep.append(links(len(x), len(y), overlap_of(x, y), percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one = sets.select(F.col("nid").alias("a"), F.col("hashes").alias("one"))
        two = sets.select(F.col("nid").alias("b"), F.col("hashes").alias("two"))
        out = materialize(near.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long"), "links")
        remove(near)
        remove(sets)
        return out


def _left_over(members: DataFrame, hot: DataFrame | None, roots: DataFrame, percent: int, classes: DataFrame) -> DataFrame:
    """Pairs of classes in one large tile that are in different groups so far and that their bitmaps allow to link.

    A tile that one group fills is done.  Others up to LARGE_TILE members give
    the pairs that sizes and places of the shingle allow.  Larger ones are
    compared by bitmaps before a pair is given, in cells of two blocks each.
    """

    def opened(rows: DataFrame, send: bool) -> DataFrame:
        known = rows.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        known = materialize(known, "known")
        blocks = F.struct("band", F.ceil(F.col("size") / TILE_ROWS).cast("int").alias("blocks"))
        bands = known.groupBy("shingle", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
        whole = bands.groupBy("shingle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size"), F.map_from_entries(F.collect_list(blocks)).alias("blocks"))
        whole = materialize(whole.filter("lo < hi").select("shingle", "size", "blocks"), "whole")  # apart, so that the join can split a tile
        return known.join(F.broadcast(whole) if send else whole, "shingle")  # of hot tiles there are HOT_TILES at most

    known = opened(members, False) if hot is None else opened(members, False).unionByName(opened(hot, True))
    known = materialize(known, "open")
    return _middle(known.filter(F.col("size") <= LARGE_TILE), percent).unionByName(_large(known.filter(F.col("size") > LARGE_TILE), classes, percent)).distinct()


def _middle(known: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups in tiles of limited size, by an equi-join on shingle and size band."""
    left = known.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    left = left.select("shingle", "band", F.col("a").alias("x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"), F.col("root").alias("root_x"))
    both = left.join(known.drop("blocks"), ["shingle", "band"]).filter("root <> root_x and (n_x < n or (n_x = n and x < a))")
    most = "(least(pos, pos_x) + least(n - pos, n_x - pos_x))"
    both = both.filter(f"100 * {most} >= {percent} * (n + n_x - {most})")
    return both.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b"))


def _large(known: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups in large tiles that the bitmaps allow to link.

    Each band of a tile is in blocks of bounded size; a cell is a block with
    itself, with another of its band, or with one of the next band.
    """
    own = F.pmod(F.xxhash64("a"), F.element_at("blocks", F.col("band"))).cast("int")
    cells = F.expr(
        "flatten(transform(array(-1, 0, 1), d -> transform(filter(sequence(0, coalesce(blocks[band + d], 1) - 1), j -> blocks[band + d] is not null), j -> "
        "case when d > 0 or (d = 0 and own <= j) then named_struct('lo', band, 'one', own, 'hi', band + d, 'two', j, 'side', 0) "
        "else named_struct('lo', band + d, 'one', j, 'hi', band, 'two', own, 'side', 1) end)))"
    )
    dealt = known.withColumn("own", own).withColumn("cell", F.explode(cells)).select("a", "n", "root", "shingle", "cell.*")
    dealt = dealt.join(classes.select(F.col("nid").alias("a"), "bits"), "a")
    cell = ["shingle", "lo", "one", "hi", "two"]
    rows = dealt.select(*cell, "side", "n", "a", "root", "bits").repartition(*cell).sortWithinPartitions(*cell, "n", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 5):
            if found := _block_pairs(block, percent):
                both = np.array(found, np.int64)
                yield _batch(["a", "b"], [pa.int64()] * 2, both.min(axis=1), both.max(axis=1))

    return rows.mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], axis=1)
        if not len(ids):
            continue
        begin = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1))
        for a, b in zip(begin, np.append(begin[1:], len(ids)), strict=True):
            key = tuple(ids[a])
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(block: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of a cell (its rows sorted by size; side, n, class, group and bitmap from column 5 on) that can link."""
    lo, one, hi, two = (block.column(i)[0].as_py() for i in range(1, 5))
    alone = (lo, one) == (hi, two)
    side, n, nid, root = (block.column(i).to_numpy() for i in range(5, 9))
    bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in block.column(9)]
    width = np.array([len(b) for b in bits])
    stacks = {}  # rows by width of their bitmap
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        stacks[w] = (at, np.stack([bits[i] for i in at]))
    out = []
    for i in range(len(n)):
        stop = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        for w, (at, whole) in stacks.items():
            low, high = np.searchsorted(at, (i + 1, stop))
            if low >= high:
                continue
            rest = at[low:high]
            other = whole[low:high]
            allowed = root[rest] != root[i]
            if not alone:
                allowed &= side[rest] != side[i]
            if not allowed.any():
                continue
            rest, other = rest[allowed], other[allowed]
            if w > width[i]:  # folded to the narrower width; a larger set's bitmap is never narrower
                other = np.bitwise_or.reduce(other.reshape(len(rest), -1, width[i]), axis=1)
            only_i = np.bitwise_count(bits[i] & ~other).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(other & ~bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - only_i, n[rest] - only_j)
            out += [(int(nid[i]), int(nid[j])) for j in rest[100 * most >= percent * (n[i] + n[rest] - most)]]
    return out


def link_counts(sets: DataFrame, percent: int) -> DataFrame:
    """(nid, linked): documents of other classes that link to a class, from (nid, root, docs, hashes) of all classes in groups."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_ROWS, F.sum(F.length("hashes")) / (8 * GROUP_HASHES)))
    dealt = sets.join(sets.groupBy("root").agg(blocks.cast("int").alias("blocks")), "root")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "nid", "docs", "hashes")
    rows = dealt.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            nid, linked = _block_links(block, percent)
            if len(nid):
                yield _batch(["nid", "linked"], [pa.int64()] * 2, nid, linked)

    return rows.mapInArrow(run, "nid long, linked long").groupBy("nid").agg(F.sum("linked").alias("linked"))


def _block_links(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a block (own, nid, docs and hashes from column 3 on) and the documents that link to each, by exact overlaps."""
    one, two = block.column(1)[0].as_py(), block.column(2)[0].as_py()
    own, nid, docs = (block.column(i).to_numpy() for i in range(3, 6))
    found = [np.frombuffer(h.as_buffer(), np.uint64) for h in block.column(6)]
    n = np.array([len(x) for x in found])
    # Incidence of the shingles that more than one class has, some columns at a time; counts below 2 ** 24 are exact in float32.
    values, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(n)), n), times[at] > 1
    column = (np.cumsum(times > 1) - 1)[at[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = np.flatnonzero(own == one), np.flatnonzero(own == two)  # the same rows, or those of two blocks
    overlap = np.zeros((len(a), len(b)), np.int64)
    last = int((times > 1).sum())
    for start in range(0, last, COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        there = np.zeros((len(n), min(COLUMNS, last - start)), np.float32)
        there[row[low:high], column[low:high] - start] = 1
        overlap += (there[a] @ there[b].T).astype(np.int64)
    linked = 100 * overlap >= percent * (n[a][:, None] + n[b] - overlap)
    counts = np.zeros(len(n), np.int64)
    if one == two:
        np.fill_diagonal(linked, False)
        counts[a] = linked @ docs[b]
    else:
        counts[a], counts[b] = linked @ docs[b], linked.T @ docs[a]
    return nid[counts > 0], counts[counts > 0]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, with_links: bool = False) -> DataFrame:
    """Groups of documents whose shingle sets are alike: doc_id, n_shingles, component_id, text_hash, class_id, group.

    ``with_links`` adds n_links, the number of other rows that link to a row
    (rows of its own class too), from an exact pass over all groups.

    Words are runs of other than ASCII white space, A-Z as a-z; a set is the
    distinct shingles of ``words`` words (with fewer words, all of them as one).
    Two documents link if 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable by links, class_id the smallest of the
    documents with an equal set; ``group`` numbers the components, whether they
    have a doc_id or not.  Texts without words, and nulls, link with nothing:
    they are their own component (their doc_id, null if that is null) and have
    neither class nor group.  A null doc_id is a component's or a class's id only
    if all of its documents have none.  Repeated rows are each returned.  Other
    columns are not read.  Hashes have 64 bits.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    scanned = materialize(scan(docs, words), "scan")
    members = scanned.filter("n is not null").select("doc_id", "text_hash", "n", "digest")
    frequent = frequent_shingles(scanned)
    first_of = members.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"))
    first_of = materialize(first_of, "first")
    made = class_rows(docs, first_of, words, percent, frequent)
    classes = materialize(first_of.join(made, "digest").withColumn("nid", F.monotonically_increasing_id()), "classes")
    remove(first_of)
    join = _Join(docs, classes, words, percent)

    found, hot = tiles(classes, percent)
    found, hot = materialize(found, "tiles"), None if hot is None else materialize(hot, "hot")
    both = found if hot is None else found.unionByName(hot)
    first = materialize(both.filter("b is not null").select("a", "b").distinct(), "pairs")
    edges = join.linked(first)
    columns = ("a", "shingle", "band", "n", "pos")
    large = found.filter("b is null").select(*columns)
    if hot is not None or not large.isEmpty():
        hot_members = None if hot is None else hot.filter("b is null").select(*columns)
        more = _left_over(large, hot_members, connected_components(edges), percent, classes)
        more = materialize(more.join(first, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            edges = edges.unionByName(join.linked(more))
        remove(more)
    remove(both)
    remove(first)
    roots = connected_components(edges)
    reps = classes.select("digest", "nid", "rep").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    classed = reps.join(least, "root").select("digest", "nid", "rep", "root", "component")
    count = []
    if with_links:
        sets = materialize(join.sets(roots.select(F.col("node").alias("nid"))), "sets")
        sets = sets.join(roots.withColumnRenamed("node", "nid"), "nid").join(classes.select("nid", "docs"), "nid").select("nid", "root", "docs", "hashes")
        counted = materialize(link_counts(sets, percent), "link_counts")
        classed = classed.join(classes.select("nid", "docs"), "nid").join(counted, "nid", "left")
        classed = classed.withColumn("n_links", F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).drop("docs", "linked")
        count = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    out = members.join(classed, "digest", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("nid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "text_hash",
        F.col("rep").alias("class_id"),
        F.col("root").alias("group"),
        *count,
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """All columns of ``docs``, one document of each group: that with the smallest doc_id.

    Documents without words all stay.  Of a group's rows with that doc_id (or, if
    none has a doc_id, of all) the one with the least text hash stays, and of rows
    that repeat it, one.
    """
    groups = settle(docs.sparkSession, lambda: near_duplicates(docs, words, percent).select("doc_id", "text_hash", "component_id", "group"), "groups")
    grouped = groups.filter("group is not null")
    best = grouped.filter("doc_id <=> component_id").groupBy("group").agg(F.min("text_hash").alias("best"), F.first("component_id").alias("first"))
    rows = grouped.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")).join(best, "group")
    rows = rows.withColumn("stays", F.expr("doc_id <=> first and text_hash = best"))
    fate = materialize(rows.filter("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"), "fate")
    same = docs["doc_id"].cast("long").eqNullSafe(fate["_id"]) & (F.xxhash64(docs["text"]) == fate["_hash"])
    rest = docs.join(fate, same, "left_anti")
    again = fate.filter("stays")
    if again.isEmpty():
        return rest
    same = docs["doc_id"].cast("long").eqNullSafe(again["_id"]) & (F.xxhash64(docs["text"]) == again["_hash"])
    return rest.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
