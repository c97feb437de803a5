"""Each operator against a brute-force version, on rows with nulls, repeats, ties, long and empty texts and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat_format, exact_dedup, fingerprints, language_id, line_dedup, ngram_join, packing, sentencepiece_codec, sharding
from lakeloom.llm.queries import piece_model

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 6))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, line string, _held_by string, root long, place long"


def prose(n: int) -> str:
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def make_documents() -> list[tuple]:
    texts: list[str | None] = [None, "", " ", "\n\t", "One", "one two", "!!! 123 ..."]
    base = prose(120)
    texts += [base, base.upper(), base.replace(" ", "  "), base + "\n", base]
    for _ in range(8):  # near copies of one text
        words = base.split()
        words[R.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for _ in range(4):  # less near
        words = base.split()
        for _ in range(9):
            words[R.randrange(len(words))] = R.choice(VOCABULARY)
        texts.append(" ".join(words))
    texts.append(prose(30_000))  # very long
    banner = "shared banner line of many sites"
    texts += [f"{prose(20)}\n{banner}\n{prose(15)}" for _ in range(9)]
    texts += [prose(R.randint(1, 60)) + "é😀" for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, t, ("en", "fr", None)[i % 3], None if i % 11 == 10 else f"s{i % 7}", None if t is None else len(t), "x", "y", "z", 1, 2))
    rows.append((None, "a text without an id " + prose(10), "en", "s1", 5, "x", "y", "z", 1, 2))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    rows += [rows[9], rows[9], rows[0]]  # repeated rows
    return rows


ROWS = make_documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def key(value):
    return (value is None, value or 0)


@pytest.mark.parametrize("memtable", [None, 9])
def test_exact_dedup(docs, memtable):
    """In one batch, and in batches that look up the older runs and compact them."""
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r[0])
    got = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(docs, memtable).collect():
        got[r["text_sha256"]].append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    for text, ids in groups.items():
        rows = got[hashlib.sha256(text.encode()).hexdigest()]
        least = min(ids, key=key)
        assert sorted((r["doc_id"] for r in rows), key=key) == sorted(ids, key=key)
        assert {r["keep_id"] for r in rows} == {least} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [least]


def test_digest_index_over_batches(spark, tmp_path):
    """Hits of each batch against a plain map, levels after compaction, and an index that is opened again."""
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, fanout=3)
    held = collections.defaultdict(list)
    for b in range(7):
        batch = [(R.randrange(60).to_bytes(2, "big"), R.choice([None, R.randrange(1000)])) for _ in range(25)]
        hits = {bytes(r[0]) for r in index.flush(spark.createDataFrame(batch, "digest binary, keep_id long")).collect()}
        for d, i in batch:
            held[d].append(i)
        assert hits == {d for d, _ in batch if len(held[d]) > 1}
        if b == 4:
            index = exact_dedup.DigestIndex(spark, path, fanout=3)
    assert [r.level for r in index.runs] == [1, 1, 0]
    asked = spark.createDataFrame([(i.to_bytes(2, "big"),) for i in range(80)], "digest binary")
    got = {bytes(r["digest"]): (r["keep_id"], r["entries"]) for r in index.lookup(asked).collect()}
    assert got == {d: (min(ids, key=key), len(ids)) for d, ids in held.items()}
    assert len(list((tmp_path / "index").iterdir())) == 3


def test_exact_dedup_many_repeated_rows(spark):
    """Work grows with the rows, not with the square of the rows that repeat one identifier and text."""
    repeated = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same  text").alias("text"))
    nulls = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    began = time.monotonic()
    out = exact_dedup.exact_dedup(repeated.unionByName(nulls)).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert time.monotonic() - began < 60
    assert sorted((tuple(r) for r in out), key=str) == [(5, 5, 150_000, False, 99_999), (5, 5, 150_000, True, 1), (None, 5, 150_000, False, 50_000)]


def test_sharding_rows_law(docs):
    got = sharding.shard_documents(docs, 7).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(ROWS) and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    again = sharding.shard_documents(docs.repartition(5), 7).collect()
    place = lambda rows: sorted(((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=str)
    assert place(got) == place(again)
    for r in got:
        assert sharding.place_of(r["position"], 7) == (r["shard"], r["slot"]) and sharding.number_at(r["shard"], r["slot"], 7) == r["position"]


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 100, 1000])
def test_permutation_is_one(spark, total):
    out = sharding.permute(spark.range(total).withColumnRenamed("id", "n"), "n", total, 3, "p")
    assert sorted(r["p"] for r in out.select("p").collect()) == list(range(total))


def test_walk_stays_inside(spark):
    x = spark.range(40, 49)  # outside 0..39 of a square of 49
    got = [r[0] for r in x.select(sharding._walk(F.col("id"), 40, 7, 3)).collect()]
    assert all(0 <= v < 49 for v in got) and any(v < 40 for v in got)


def test_write_shards_beside_columns_of_its_names(spark, tmp_path):
    rows = [(i % 5, "t", 7, 8, 9) for i in range(40)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, shard long, slot long, _crc long"), f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert sorted((r["doc_id"], r["text"], r["shard"], r["slot"], r["_crc"]) for r in back) == sorted(rows)
    assert sorted((r["_slot"], r["_shard"]) for r in back) == sorted((i // 3, i % 3) for i in range(40))


def test_write_shards(docs, spark, tmp_path):
    placed = sharding.write_shards(docs, f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == len(ROWS) and sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in placed.collect())


def brute_sets(text: str | None, k: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    least = {}
    groups = brute_groups(rows, k, percent)
    for r, group in zip(rows, groups, strict=True):
        least[group] = min([least.get(group), r[0]], key=key) if group in least else r[0]
    return sorted(((r[0], len(brute_sets(r[1], k)), r[0] if g is None else least[g]) for r, g in zip(rows, groups, strict=True)), key=str)


def brute_groups(rows: list[tuple], k: int, percent: int) -> list[int | None]:
    """Number of each row's group, None without words."""
    sets = [brute_sets(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, k, percent):
    got = ngram_join.near_duplicates(docs, k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(ROWS, k, percent)


@pytest.mark.parametrize(("large", "hot"), [(0, 2048), (1000, 2048), (0, 8)])
def test_ngram_join_large_tiles(spark, monkeypatch, large, hot):
    """Tiles above the small size, several blocks, hot tiles, and groups that the leader alone does not find."""
    monkeypatch.setattr(ngram_join, "LARGE_TILE", large)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot)
    monkeypatch.setattr(ngram_join, "SMALL_TILE", 3)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    base = prose(60).split()
    rows = []
    for i in range(60):
        words = base[: R.randint(40, 60)] if i % 3 else list(base)
        for _ in range(R.randint(1, 5)):
            words[R.randrange(len(words))] = R.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, 4, 85).collect()
    want = brute_components(rows, 4, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert len({w[2] for w in want}) > 1


def brute_links(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    sets = [brute_sets(r[1], k) for r in rows]
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    return sorted(((r[0], sum(1 for j, b in enumerate(sets) if j != i and a and b and like(a, b))) for i, (r, a) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_ngram_join_counts_every_link(spark, docs, monkeypatch):
    """Links within groups that single comparisons have joined already count too, in one block and in several."""
    from lakeloom.llm.queries import op3_ngram_jaccard

    monkeypatch.setattr(ngram_join, "SMALL_TILE", 3)
    got = ngram_join.near_duplicates(docs, 4, 85, with_links=True).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=str) == brute_links(ROWS, 4, 85)
    base = prose(60).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 4):
            words[R.randrange(len(words))] = R.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 7)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("lakeloom.llm.queries.table", lambda *_: df)
    got = op3_ngram_jaccard(spark, "").collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=str) == brute_links(rows, 4, 85)
    of = {r["doc_id"]: r["class_id"] for r in got}
    sets = {r[0]: brute_sets(r[1], 4) for r in rows}
    assert all((of[a] == of[b]) == (sets[a] == sets[b]) for a in of for b in of)


def test_keep_one(docs):
    """Every row, those without a doc_id too: wordless rows all stay, and of each group one row."""
    kept = ngram_join.keep_one(docs).collect()
    want = collections.Counter(r[:2] for r in ROWS if not brute_sets(r[1], 5))
    of = collections.defaultdict(list)
    for r, group in zip(ROWS, brute_groups(ROWS, 5, 80), strict=True):
        if group is not None:
            of[group].append(r)
    got = collections.Counter((r["doc_id"], r["text"]) for r in kept)
    for rows in of.values():
        least = min((r[0] for r in rows), key=key)
        texts = {r[1] for r in rows if r[0] == least}
        found = [t for t in texts if got[least, t]]
        assert len(found) == 1
        want[least, found[0]] += 1
    assert got == want and kept[0].__fields__ == docs.columns


def test_keep_one_without_ids(spark):
    """Different texts without a doc_id all stay; of copies without one, one does."""
    texts = [prose(30) for _ in range(6)]
    df = spark.createDataFrame([(None, t) for t in [*texts, texts[0], texts[0], None, "", ""]], "doc_id long, text string")
    got = collections.Counter(r["text"] for r in ngram_join.keep_one(df).collect())
    assert got == collections.Counter([*texts, None, "", ""])


def test_words_of_regular_structure(spark):
    """Words that a polynomial modulo a power of two cannot tell apart do not link."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, t[:n]) for i, (t, n) in enumerate((t, n) for n in (8, 128, 1024, 4096) for t in (word, other))]
    got = ngram_join.near_duplicates(spark.createDataFrame([*rows, (9, word.upper())], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i, _ in rows}, 9: 6}


@pytest.mark.parametrize("percent", [1, 50, 80, 85, 99, 100])
def test_bands_hold_all_links(percent):
    starts = ngram_join.band_starts(percent)
    sizes = [*range(1, 400), *(R.randrange(1, 1 << 30) for _ in range(400))]
    for n in sizes:
        a, b = ngram_join.np.searchsorted(starts, [n, 100 * n // percent], "right")
        assert b - a <= 1


def test_bitmap_bound_holds():
    for _ in range(50):
        a, b = (next(ngram_join.shingle_sets([prose(R.randint(5, 300)).encode()], 4)) for _ in range(2))
        bound = ngram_join.most_overlap(len(a), ngram_join.signature(a), len(b), ngram_join.signature(b))
        assert bound >= ngram_join.overlap_of(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_long_text_in_parts(monkeypatch):
    text = prose(4000).encode()
    whole = next(ngram_join.shingle_sets([text], 4))
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1000)
    assert next(ngram_join.shingle_sets([text], 4)).tolist() == whole.tolist()


def test_line_dedup(docs):
    spread, first = collections.defaultdict(set), {}
    for r in ROWS:
        for line in (r[1] or "").split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if bare:
                if r[3] is not None:
                    spread[bare].add(r[3])
                first[bare] = min([first.get(bare, None), r[0]], key=key) if bare in first else r[0]
    bad = {b for b, s in spread.items() if len(s) >= 5}
    assert bad
    want = []
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in bad or first[x.strip(" \t\n\x0b\x0c\r")] == r[0]]
        want.append((r[0], None if r[1] is None else "\n".join(kept), len(lines) - len(kept)))
    out = line_dedup.remove_boilerplate(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_packing(docs):
    capacity = 300
    got = packing.pack_documents(docs, capacity, group_rows=16).collect()
    by_doc = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    source = {r[0]: r[3] for r in ROWS}
    text = {r[0]: r[1] or "" for r in ROWS if r[0] is not None}
    for rows in bins.values():
        assert sum(r["n_chars"] for r in rows) + (len(rows) if len(rows) > 1 else 0) <= capacity
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        sources = [source[r["doc_id"]] for r in rows if r["doc_id"] is not None and source[r["doc_id"]] is not None]
        assert len(sources) == len(set(sources))
        texts = [text[r["doc_id"]] for r in rows if r["doc_id"] is not None and text[r["doc_id"]]]
        assert len(texts) == len(set(texts))
    times = collections.Counter(r[0] for r in ROWS)
    for doc_id, t in text.items():
        pieces = sorted((r["start"], r["n_chars"]) for r in by_doc[doc_id])
        assert sum(n for _, n in pieces) == len(t) * times[doc_id]
        assert len(pieces) == times[doc_id] * max(1, -(-len(t) // capacity))


def test_packer_takes_tightest_compatible_bin():
    p = packing.Packer(100)
    assert p.place(60, 1, 1)[0] == 0
    assert p.place(50, 2, 2)[0] == 1
    assert p.place(40, 1, 4)[0] == 1  # bin 0 fits better but has the source
    assert p.place(30, 4, 1)[0] == 2  # both other bins are full or have the cluster
    assert p.place(40)[0] == 0


def brute_packing(rows: list[tuple], capacity: int) -> list[tuple]:
    """doc_id, bin, slot and offset of each rest, by a look at all bins."""
    bins: list[list] = []  # room, rows
    out = []
    rest = [(i, r) for i, r in enumerate(rows) if r[1] % capacity or not r[1]]
    for i, (doc_id, n, source, cluster) in sorted(rest, key=lambda x: (-(x[1][1] % capacity), x[1][0] is None, x[1][0] or 0, x[0])):
        need = min(n % capacity + 1, capacity)
        clash = lambda b: any((source is not None and r[2] == source) or (cluster is not None and r[3] == cluster) for r in b[1])  # noqa: B023, E731
        fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= need and not clash(b)]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append([capacity, []])
        out.append((doc_id, k, len(bins[k][1]), capacity - bins[k][0]))
        bins[k][0] -= need
        bins[k][1].append(rows[i])
    return out


@pytest.mark.parametrize("hot", [0.0, 0.4, 0.9])
def test_packing_places_as_brute_force(monkeypatch, hot):
    """The very bin, slot and offset of every piece, with hot sources and clusters; blocks are small, so that they split, empty and are passed."""
    monkeypatch.setattr(packing, "BLOCK", 3)
    for _ in range(6):
        rows = [(i, R.randint(0, 400), "hot" if R.random() < hot else R.choice([None, *"abcdef"]), R.choice([None, R.randrange(40), 0 if R.random() < hot else 1])) for i in range(300)]
        got = [(r[0], r[4], r[5], r[6]) for r in packing.pack_group(rows, 128) if r[3] < 128]
        assert got == brute_packing(rows, 128)


def test_packing_rounds(spark, docs):
    """Several groups: bins keep to room and conflicts over the rounds, and few are lost against one group."""
    rows = [(i, "x" * R.randint(1, 90), f"s{R.randrange(30)}", R.randrange(200)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, near long")
    one = packing.pack_documents(df, 100, "near").collect()
    got = packing.pack_documents(df, 100, "near", group_rows=150).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == sorted((r["doc_id"], r["n_chars"]) for r in one)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert all(a["bin_offset"] + a["n_chars"] + 1 == b["bin_offset"] for a, b in zip(own, own[1:], strict=False)) and own[0]["bin_offset"] == 0
        assert own[-1]["bin_offset"] + own[-1]["n_chars"] <= 100
        for c in (2, 3):
            assert len({rows[r["doc_id"]][c] for r in own}) == len(own)
    assert len(bins) <= 1.05 * len({r["bin_id"] for r in one})


def test_packing_keeps_near_copies_apart(spark):
    """Folded copies by default; groups of the near-duplicate join if they are given."""
    base = prose(40)
    rows = [(1, base, "a"), (2, base.upper().replace(" ", ", "), "b"), (3, base + " one more", "c"), (4, prose(9), "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = {r["doc_id"]: r["bin_id"] for r in packing.pack_documents(df).collect()}
    assert of[1] != of[2] and len(set(of.values())) == 2
    near = ngram_join.near_duplicates(df).select("doc_id", "component_id")
    of = {r["doc_id"]: r["bin_id"] for r in packing.pack_documents(df.join(near, "doc_id"), cluster="component_id").collect()}
    assert of[1] != of[3]


def test_language_id(spark):
    words = {"en": "the of and to in that is was for with", "de": "der die und das ist nicht mit auf für ein", "fr": "le la les des et est une dans pour que", "es": "el los las del una por con para como más"}
    rows = []
    for i in range(600):
        lang = R.choice(list(words))
        text = " ".join(R.choice([*words[lang].split(), *(R.choice(words[lang].split()) + "x",)]) for _ in range(R.randint(4, 40)))
        rows.append((i, text, None if i % 10 == 0 else lang, lang))
    rows += [(9001, None, "en", "und"), (9002, "", "en", "und"), (9003, "12 34 !", "fr", "und"), (None, "the and of that", "en", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = language_id.identify(df).collect()
    truth = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert {r["lang_pred"] for r in got if r["doc_id"] in (9001, 9002, 9003)} == {"und"}
    kept = language_id.keep_determined(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == list(range(600))


def test_language_stage_rejects_other_languages(spark):
    """Texts of letters in no learned language go by their score; those of learned ones stay."""
    import corpus_pipeline

    words = {"en": "the of and to in that is was for with", "de": "der die und das ist nicht mit auf für ein", "fr": "le la les des et est une dans pour que", "es": "el los las del una por con para como más"}
    rows = [(i, " ".join(R.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(sorted(words) * 60)]
    other = ["όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "人人生而自由在尊严和权利上一律平等", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan"]
    df = spark.createDataFrame(rows + [(9000 + i, t, None) for i, t in enumerate(other)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, "").collect()) == list(range(len(rows)))


def test_language_prediction_ignores_labels(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the of and", "en"), ("der die das", "de")] * 30)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    one = language_id.predict_languages(spark.createDataFrame([(1, "the of and", "de")], "doc_id long, text string, lang string"), model).first()
    two = language_id.predict_languages(spark.createDataFrame([(7, "the of and", None)], "doc_id long, text string, lang string"), model).first()
    assert one["lang_pred"] == two["lang_pred"] == "en" and one["score"] == two["score"]


def test_fingerprints(docs):
    got = fingerprints.compare_edited(docs).collect()
    assert len(got) == len(ROWS)
    by_print = collections.defaultdict(set)
    ids = {r[0] for r in ROWS if r[0] is not None}
    text = {r[0]: r[1] or "" for r in ROWS if r[0] is not None}
    order = sorted(ids, reverse=True)
    nulls = [r[1] or "" for r in ROWS if r[0] is None]
    errors = []
    for r in got:
        if r["doc_id"] is None:
            continue
        own = text[r["doc_id"]]
        by_print[own].add(r["fingerprint"])
        at = order.index(r["doc_id"])
        following = [text[order[at + 1]]] if at + 1 < len(order) else nulls
        cut = len(own) // 3
        edited = [own[: len(own) - cut] + t[:cut] for t in following]
        assert r["n_chars"] == len(own) and r["edited_sha256"] in [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        if len(edited) == 1:
            errors += [r["near_edited"] - jaccard(own, edited[0]), r["near_next"] - jaccard(own, following[0])]
    assert all(len(p) == 1 for p in by_print.values())
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.35


def jaccard(a: str, b: str) -> float:
    x, y = (collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    keys = set(x) | set(y)
    return 1.0 if not keys else sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


def hash64(spark, values: list) -> dict:
    """Spark's 64-bit hash of each value tuple."""
    kind = {int: "long", str: "string"}
    schema = ", ".join(f"c{i} {kind[type(v)] if i < 1 or len(values[0]) < 2 else 'int'}" for i, v in enumerate(values[0]))
    df = spark.createDataFrame(values, schema)
    return {tuple(r)[:-1]: r["h"] for r in df.withColumn("h", F.xxhash64(*df.columns)).collect()}


def test_fingerprints_by_a_second_sampler(spark):
    """Every sample of some texts, computed term by term in plain Python from the published formula."""
    texts = ["a b b c", "a b c c c c c", "one", "", " ".join(VOCABULARY[:50] * 3 + VOCABULARY[20:40])]
    counts = [collections.Counter(t.split()) for t in texts]
    term = hash64(spark, sorted({(w,) for c in counts for w in c}))
    bits = hash64(spark, sorted({(t, k) for t in term.values() for k in range(fingerprints.SAMPLES)}))
    unit = lambda b, shift, width: (((b & (2**64 - 1)) >> shift) % 2**width + 0.5) / 2**width
    want = []
    for c in counts:
        signature = []
        for k in range(fingerprints.SAMPLES) if c else ():
            best = None
            for w, n in c.items():
                b = bits[term[w,], k]
                part, rest = -math.log(unit(b, 0, 20)), -math.log(unit(b, 20, 14))  # a Gamma(2, 1) in two parts, of which beta is one's share
                r, beta, g = part + rest, rest / (part + rest), -math.log(unit(b, 34, 15) * unit(b, 49, 15))
                t = math.floor(math.log(n) / r + beta)
                packed = (math.floor(math.exp(math.log(g) - r * (t - beta + 1)) * 2**34) << 24) | ((b ^ t * 7919) & (2**24 - 1))
                best = packed if best is None else min(best, packed)
            signature.append(best)
        want.append(signature)
    short = hash64(spark, sorted({(x,) for s in want for x in s}))
    strings = ["".join(f"{short[x,] & 0x7FFFFFFF:08x}" for x in s) or "-" for s in want]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_texts(df).collect()}
    same = [a == b for i, s in enumerate(strings) for a, b in zip((s[j : j + 8] for j in range(0, len(s), 8)), (got[i][j : j + 8] for j in range(0, len(s), 8)), strict=True)]
    assert sum(same) >= len(same) - 2  # the last bit of a logarithm may differ
    compared = {r["doc_id"]: r for r in fingerprints.compare_edited(df).collect()}
    assert {i: r["fingerprint"] for i, r in compared.items()} == got


def test_fingerprint_of_texts_agrees(docs):
    one = {r["fingerprint"] for r in fingerprints.fingerprint_texts(docs).collect()}
    two = {r["fingerprint"] for r in fingerprints.compare_edited(docs).collect()}
    assert one == two


def test_chat_format(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> there"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "aside"), (2, 0, "system", "alone"), (None, 0, "eve", "x"), (3, 5, "ann", "5"), (3, 1, "bob", "1")]
    turns += [(4, i, ("p", "q", "r")[i % 3], f"t{i}") for i in range(25)]
    turns += [(5, i, R.choice(["system", None, "", "x y", " <|z \t z", "é😀"]), R.choice([None, "", "<|<|", "w" * 50_000, "é😀\n"])) for i in range(60)]
    turns += [(6, 0, "u", ""), (6, 1, "u", None), (None, 1, "eve", "y"), (None, None, "eve", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat_format.format_conversations(df, block_turns=10).collect()
    views = collections.defaultdict(list)
    for r in got:
        views[r["conv_id"], r["perspective"]].append(r)
    five = {(5, r) for _, _, r, _ in turns if r in ("x y", " <|z \t z", "é😀")}
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "eve"), (3, "ann"), (3, "bob"), (4, "p"), (4, "q"), (4, "r"), (6, "u")} | five
    for _, speaker in five:
        said = [t[2:] for t in turns if t[0] == 5]
        text, mask, _ = chat_format.render(said, speaker)
        own = sorted(views[5, speaker], key=lambda r: r["block"])
        assert "".join(r["rendered"] for r in own) == text and [(m["start"], m["stop"]) for r in own for m in r["mask"]] == mask
    ann = views[1, "ann"][0]
    assert ann["n_turns"] == 5 and ann["n_assistant"] == 1
    assert [ann["rendered"][m["start"] : m["stop"]] for m in ann["mask"]] == ["hi < |im_end|> there<|im_end|>"]
    assert "<|im_start|>user name=bob\n<|im_end|>\n" in ann["rendered"] and ann["rendered"].startswith("<|im_start|>system\nbe kind")
    long = sorted(views[4, "q"], key=lambda r: r["block"])
    assert [r["n_turns"] for r in long] == [10, 10, 5]
    text, mask, _ = chat_format.render([t[2:] for t in turns if t[0] == 4], "q")
    assert "".join(r["rendered"] for r in long) == text and [(m["start"], m["stop"]) for r in long for m in r["mask"]] == mask
    for view in views.values():  # blocks are storage only
        view.sort(key=lambda r: r["block"])
        assert [r["block_start"] for r in view] == [sum(len(r["rendered"]) for r in view[:i]) for i in range(len(view))]
    said = "".join(r["rendered"] for r in long)
    assert re.findall(r"t[0-9]+", said) == [f"t{i}" for i in range(25)]
    assert said.count("<|im_start|>assistant\n") == sum(r["n_assistant"] for r in long) == 8
    assert views[3, "ann"][0]["rendered"].index("1<|") < views[3, "ann"][0]["rendered"].index("5<|")


def test_pipeline_as_brute_force(spark, tmp_path):
    """Rows, places and offsets of the whole pipeline against the stages done row by row."""
    import corpus_pipeline

    words = {"en": "the of and to in that is was for with", "de": "der die und das ist nicht mit auf für ein"}
    said = lambda lang, n: " ".join(R.choice(words[lang].split()) for _ in range(n))
    rows = []
    for i in range(90):
        text = "\n".join(said(("en", "de")[i % 2], R.randint(15, 60)) for _ in range(R.randint(1, 4)))
        rows.append((i, text + ("\nread more of that in the news" if i % 4 == 0 else ""), ("en", "de")[i % 2], f"s{i % 9}", len(text)))
    rows += [(200 + i, rows[3 * i][1].replace("the", "this", 1), "en", f"t{i}", 1) for i in range(6)]  # near copies
    rows += [(300 + i, rows[7][1], "de", f"u{i}", 1) for i in range(7)]  # copies over many sources
    rows += [(400, "1 2 3 ...", "en", "s1", 9), (401, None, "en", "s1", None), (402, "", None, None, 0), (403, "Ελλάδα και όλοι οι άνθρωποι " * 5, None, "s2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")

    scored = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    left = [r for r in rows if scored[r[0]]["lang_pred"] != "und" and scored[r[0]]["score"] >= language_id.LEAST_SCORE]
    assert {r[0] for r in rows if r[0] < 400} <= {r[0] for r in left} and not {400, 401, 402} & {r[0] for r in left}
    spread, first = collections.defaultdict(set), {}
    for r in sorted(left, key=lambda r: -r[0]):
        for bare in filter(None, (x.strip(" ") for x in r[1].split("\n"))):
            spread[bare].add(r[3])
            first[bare] = r[0]
    lined = []
    for r in left:
        kept = [x for x in r[1].split("\n") if len(spread[x.strip(" ")]) < 5 or first[x.strip(" ")] == r[0]]
        if any(x.strip() for x in kept):
            lined.append((r[0], "\n".join(kept), *r[2:]))
    assert len(lined) < len(left)
    least: dict[int, int] = {}
    groups = brute_groups(lined, 5, 80)
    for r, g in zip(lined, groups, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    single = [r for r, g in zip(lined, groups, strict=True) if r[0] == least[g]]
    assert len(single) < len(lined)
    fold = lambda t: re.sub(r"[\W_]+", " ", t).lower().strip() or None
    want = brute_packing([(r[0], len(r[1]), r[3], fold(r[1])) for r in single], packing.CAPACITY)
    got = [(r["doc_id"], r["bin_id"], r["slot"], r["bin_offset"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want)


def test_empty_tables(nothing, spark):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert sharding.shard_documents(nothing).count() == 0
    assert ngram_join.near_duplicates(nothing).count() == 0
    assert ngram_join.keep_one(nothing).count() == 0
    assert line_dedup.remove_boilerplate(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert language_id.identify(nothing).count() == 0
    assert sentencepiece_codec.encode_documents(nothing, piece_model()).count() == 0
    assert fingerprints.compare_edited(nothing).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
