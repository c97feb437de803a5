"""Best-fit packing of documents into sequences of fixed capacity, under conflicts.

Bins are kept in the order of their residual space and carry bitmaps of the
sources and of the duplicate clusters they hold.  A piece goes to the tightest
bin that has room and neither its source nor its cluster: the search starts at
the smallest residual that is enough and takes the successors in turn until a
bin is compatible; if none is, a new bin is opened.  Successors stand in blocks
with the intersection of their bitmaps, so that a block whose bins all hold the
piece's source, as a hot source makes them, is passed in one step.

Texts longer than the capacity are cut: whole-capacity pieces fill bins of their
own, the rest is packed.  The law over all rows: rows are dealt into groups of
bounded size by a hash, which spreads sources and clusters evenly, and each group
is packed by one task, largest piece first, ties by doc_id.  With one group this
is the best fit over all bins.  With more, the bins that are left with room are
placed again as whole pieces, in rounds, among the open bins of other groups, by
the same search; rounds end with one that sees all open bins or saves hardly any.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows, remove

CAPACITY = 8192  # characters of a sequence
GROUP_ROWS = 32_768  # documents, or open bins, that one task packs together
SEPARATOR = 1  # room that a piece takes besides its text
BLOCK = 64  # bins that stand together in the residual order
OPEN_SHARE = 16  # a bin is open if a sixteenth of it is free
LEAST_SAVED = 100  # rounds go on while one of so many open bins is saved
SCHEMA = "doc_id long, piece long, start long, n_chars long, bin_id long, slot long, bin_offset long"


class Packer:
    """Best-fit packer with exact conflict bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.blocks: list[list[tuple[int, int]]] = [[]]  # (residual, bin), ascending over all blocks
        self.common: list[tuple[int, int]] = [(-1, -1)]  # bits that all bins of a block have, or fewer
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.counts: list[int] = []

    def _find(self, need: int, s: int, c: int) -> tuple[int, int] | None:
        """Block and place of the tightest compatible bin."""
        first = bisect_left(self.blocks, (need, -1), key=lambda b: b[-1] if b else (need, -1))
        for k in range(first, len(self.blocks)):
            if self.common[k][0] & s or self.common[k][1] & c:
                continue
            block = self.blocks[k]
            begin = bisect_left(block, (need, -1)) if k == first else 0
            all_s, all_c = -1, -1
            for i in range(begin, len(block)):
                b = block[i][1]
                if not (self.sources[b] & s or self.clusters[b] & c):
                    return k, i
                all_s &= self.sources[b]
                all_c &= self.clusters[b]
            if not begin and block:
                self.common[k] = (all_s, all_c)
        return None

    def _put(self, entry: tuple[int, int]) -> None:
        k = min(bisect_left(self.blocks, entry, key=lambda b: b[-1] if b else entry), len(self.blocks) - 1)
        block, b = self.blocks[k], entry[1]
        insort(block, entry)
        self.common[k] = (self.common[k][0] & self.sources[b], self.common[k][1] & self.clusters[b])
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.common[k : k + 1] = [self.common[k]] * 2

    def place(self, need: int, s: int = 0, c: int = 0, pieces: int = 1) -> tuple[int, int, int]:
        """Bin, slot and offset for a piece (or a bin of ``pieces``) that takes ``need`` and has source bits ``s`` and cluster bits ``c``."""
        found = self._find(need, s, c)
        if found is None:
            residual, b = self.capacity, len(self.counts)
            self.sources.append(0)
            self.clusters.append(0)
            self.counts.append(0)
        else:
            k, i = found
            residual, b = self.blocks[k].pop(i)
            if not self.blocks[k] and len(self.blocks) > 1:
                del self.blocks[k], self.common[k]
        self.sources[b] |= s
        self.clusters[b] |= c
        slot = self.counts[b]
        self.counts[b] += pieces
        self._put((residual - need, b))
        return b, slot, self.capacity - residual


def bits_of(values: list[tuple]) -> list[int]:
    """A bitmap for each tuple of values: a bit for every value that more than one tuple has; none for nulls, which conflict with nothing."""
    seen: dict[object, int] = {}
    for own in values:
        for v in set(own):
            seen[v] = seen.get(v, 0) + 1
    bit: dict[object, int] = {}
    for v, times in seen.items():
        if v is not None and times > 1:
            bit[v] = 1 << len(bit)
    return [sum(bit.get(v, 0) for v in set(own)) for own in values]


def pack_group(rows: list[tuple], capacity: int, group: int = 0) -> list[tuple]:
    """Pack (doc_id, n_chars, source, cluster) rows, largest rest first; ties by doc_id, then input order.

    Returns SCHEMA's columns, then source, cluster and the room taken.
    """
    packer, out, rest = Packer(capacity), [], []
    s, c = bits_of([(r[2],) for r in rows]), bits_of([(r[3],) for r in rows])
    for i, (doc_id, n, _, _) in enumerate(rows):
        if n % capacity or n == 0:
            rest.append((-(n % capacity), doc_id is None, doc_id or 0, i))
    for minus, _, _, i in sorted(rest):
        doc_id, n, source, cluster = rows[i]
        whole = n // capacity
        need = min(-minus + SEPARATOR, capacity)
        b, slot, offset = packer.place(need, s[i], c[i])
        out.append((doc_id, whole, whole * capacity, -minus, (group << 32) + b, slot, offset, source, cluster, need))
    full = len(packer.counts)
    for doc_id, n, source, cluster in rows:
        for piece in range(n // capacity):
            out.append((doc_id, piece, piece * capacity, capacity, (group << 32) + full, 0, 0, source, cluster, capacity))
            full += 1
    return out


def merge_bins(bins: list[tuple], capacity: int) -> list[tuple]:
    """Place (bin_id, taken, pieces, sources, clusters) bins in one another: (bin_id, into, slots, room) of those that go into another."""
    packer, first, out = Packer(capacity), [], []
    bins = sorted(bins, key=lambda b: (-b[1], b[0]))
    s, c = bits_of([tuple(b[3]) for b in bins]), bits_of([tuple(b[4]) for b in bins])
    for i, (bin_id, taken, pieces, _, _) in enumerate(bins):
        b, slot, offset = packer.place(taken, s[i], c[i], pieces)
        if b == len(first):
            first.append(bin_id)
        else:
            out.append((bin_id, first[b], slot, offset))
    return out


def duplicate_cluster(text: Column) -> Column:
    """Cluster of copies that differ in case, punctuation or white space only; null for a text without letters and digits."""
    folded = F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    return F.when(folded != "", F.md5(folded))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PIECES = pa.schema(
    [*[(n, pa.int64()) for n in ("doc_id", "piece", "start", "n_chars", "bin_id", "slot", "bin_offset")], ("source", pa.string()), ("cluster", pa.string()), ("need", pa.int64())]
)
MOVES = pa.schema([(n, pa.int64()) for n in ("bin_id", "into", "slots", "room")])


def _groups(n: int, group_rows: int) -> int:
    return max(1, -(-n // group_rows))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place every document: doc_id, piece, start, n_chars, bin_id, slot, bin_offset.

    A row for each piece, whose text is n_chars code points from ``start`` (0
    based).  No bin has more than ``capacity``, two pieces of one source, or two
    of one duplicate cluster.  ``cluster`` names the column of duplicate clusters,
    such as the groups of a near-duplicate join; without it, texts that differ in
    case, punctuation and white space only are a cluster.  A null or empty text
    is one piece of 0 characters; null sources and clusters conflict with
    nothing; repeated rows are placed one by one (and conflict with each other).
    The text is measured, not moved; extra columns are not read.
    """
    if capacity < 2:
        raise ValueError("capacity must be 2 or more")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    group_of = F.col(f"`{cluster}`").cast("string") if cluster else duplicate_cluster(text)
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), F.col("source").cast("string").alias("source"), group_of.alias("cluster")
    )
    small = small.withColumn("spread", F.xxhash64("doc_id", "n", "cluster"))
    numbered, total = number_rows(small, [F.col(c) for c in ("spread", "doc_id", "n", "source", "cluster")], "row_number")
    groups = _groups(total, group_rows)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row_number")
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "n", "source", "cluster")), strict=True))
        return _table(pack_group(rows, capacity, key[0].as_py()), PIECES)

    dealt = numbered.withColumn("bin_group", F.pmod("row_number", F.lit(groups)))
    pieces = dealt.groupBy("bin_group").applyInArrow(run, f"{SCHEMA}, source string, cluster string, need long")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    if groups == 1:
        return pieces.select(*names)
    pieces = materialize(pieces, "pieces")
    remove(numbered)
    turn = 0
    while True:
        turn += 1
        bins = pieces.groupBy("bin_id").agg(
            F.sum("need").alias("taken"), F.count(F.lit(1)).alias("pieces"), F.collect_list("source").alias("sources"), F.collect_list("cluster").alias("clusters")
        )  # a bin has no more than ``capacity`` pieces
        bins = materialize(bins.filter(F.lit(capacity) - F.col("taken") >= max(1, capacity // OPEN_SHARE)), "open")
        left = bins.count()
        groups = _groups(left, group_rows)

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            rows = zip(*(table.column(c).to_pylist() for c in ("bin_id", "taken", "pieces", "sources", "clusters")), strict=True)
            return _table(merge_bins(list(rows), capacity), MOVES)

        dealt = bins.withColumn("g", F.pmod(F.xxhash64("bin_id", F.lit(turn)), F.lit(groups)))
        moves = materialize(dealt.groupBy("g").applyInArrow(merge, "bin_id long, into long, slots long, room long"), "moves")
        saved = moves.count()
        remove(bins)
        if saved:
            moved = pieces.join(moves, "bin_id", "left")
            moved = moved.withColumn("slot", F.col("slot") + F.coalesce("slots", F.lit(0))).withColumn("bin_offset", F.col("bin_offset") + F.coalesce("room", F.lit(0)))
            moved = materialize(moved.withColumn("bin_id", F.coalesce("into", "bin_id")).select(*pieces.columns), "pieces")
            remove(pieces)
            pieces = moved
        remove(moves)
        if groups == 1 or saved * LEAST_SAVED < left:
            return pieces.select(*names)
