"""WARC archives, SentencePiece and the pipeline."""

from __future__ import annotations

import hashlib
import random

import pytest

from lakeloom.llm import sentencepiece_codec, warc
from lakeloom.llm.queries import piece_model

R = random.Random(9)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(piece_model())


def test_encoding_equals_the_library(codec, library):
    letters = "abcdeth inonthe▁ \n\t0123éß中国😀한글́\x00  "
    texts = ["", " ", "   ", "a▁b", "x" * 300, "ab" * 400, " " * 37 + "x", "=====", "<s>", "</s>", "<0x41>"]
    texts += ["".join(R.choice(letters) for _ in range(R.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_eos=True)
        assert codec.encode(t) == want
        assert codec.decode(want) == library.decode(want)
        n, ids, decoded = codec.digest(t)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want))


def test_decoding_any_ids(codec, library):
    for _ in range(300):
        ids = [R.randrange(3, 32_000) for _ in range(R.randint(0, 12))]
        if not any(i in codec.byte_of for i in ids):
            assert codec.decode(ids) == library.decode(ids)


def test_memo_generations(codec, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMO_UNITS", 20)
    for _ in range(60):
        t = " ".join("".join(R.choice("abcdefgh") for _ in range(R.randint(1, 70))) for _ in range(15))
        want = library.encode(t, add_eos=True)
        assert codec.digest(t)[1] == " ".join(map(str, want))


def test_memo_keeps_units_that_decode_otherwise(codec, monkeypatch):
    """A unit whose decoded text is not itself stays so when the memo turns over."""
    monkeypatch.setattr(sentencepiece_codec, "MEMO_UNITS", 3)
    raw = codec._raw_text
    monkeypatch.setattr(codec, "_raw_text", lambda ids: raw(ids).replace("q", "Q"))
    for t in ["qq", "a b c d e", "qq", "f g h i j", "qq", "k l m n o"]:
        assert codec.digest(t)[2] == t.replace("q", "Q")


def test_encode_documents(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "x"), (None, "é" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_codec.encode_documents(df, piece_model()).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = [library.encode(t or "", add_eos=True) for _, t, _ in rows]
    want = sorted((str(i), len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for (i, _, _), x in zip(rows, ids, strict=True))
    assert got == want
    out = {r["doc_id"]: r for r in sentencepiece_codec.tokenize(df, piece_model()).collect()}
    assert list(out[3]["ids"]) == ids[2] and out[3]["decoded"] == "Hello  world\n"


BIG, OTHER = "<p>" + "big " * 400, "<p>" + "other " * 300
PAGES = [(1, "http://a/1", BIG), (5, "http://a/5 \r\n x", BIG), (3, None, BIG), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "é", "é" * 500), (9, "é", "é" * 500)]
PAGES += [(None, "n", OTHER), (None, "n", OTHER), (10, "x", "x" * 3_000_000), (11, "x", "x" * 3_000_000), (11, "x", "x" * 3_000_000)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df, path, archive_bytes=2000)
    got = warc.read_archives(spark, path).collect()
    want = []
    for page, url, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        last = max(same, default=None) if len(data) >= 1000 else None
        revisit = last is not None and last != page
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, " ".join((url or "").split())))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    import gzip

    for f in (tmp_path / "warc").glob("part-*"):
        with gzip.open(f) as archive:  # other gzip readers take the files, the closing zero byte included
            assert archive.read().startswith(b"WARC/1.1\r\n")


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0


def record(payload: bytes = b"payload") -> bytes:
    return warc.make_record(1, "http://a", payload, hashlib.sha1(payload).hexdigest(), None)


def test_warc_reader_refuses_damage():
    good = warc.gzip_member(record())
    assert [p for _, p in warc.read_archive(good + good + b"\0\0")] == [b"payload"] * 2
    bad = [
        good[:-9],
        warc.gzip_member(record().replace(b"payload\r\n", b"paYload\r\n")),
        warc.gzip_member(record()[:-1]),
        warc.gzip_member(record() + b"more"),
        warc.gzip_member(b"no version\r\n\r\n"),
        good[:20] + bytes([good[20] ^ 255]) + good[21:],
    ]
    for data in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data))


def test_warc_reader_takes_what_others_write(spark, tmp_path):
    """Records of other types, digests of other kinds or none, hexadecimal ones, and blocks that are no HTTP."""

    def other(kind: bytes, block: bytes, *lines: bytes) -> bytes:
        return warc.gzip_member(b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, *lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    is_http = b"Content-Type: application/http;msgtype=response"
    data = other(b"warcinfo", b"software: x\r\n") + other(b"request", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http; msgtype=request")
    data += other(b"response", http, is_http, b"WARC-Target-URI: http://a") + other(b"response", http, is_http, b"WARC-Payload-Digest: sha256:00")
    data += other(b"response", http, is_http, b"WARC-Payload-Digest: SHA1:" + hashlib.sha1(b"body").hexdigest().encode())
    data += other(b"response", b"dns\r\n\r\nanswer", b"Content-Type: text/dns") + other(b"revisit", b"", b"WARC-Profile: p")
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = sorted((tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()), key=str)
    body = hashlib.sha1(b"body").hexdigest()
    want = [(None, 4, body, "response", None, u) for u in ("http://a", None, None)]
    want += [(None, 13 + 2 - 2 + 0, hashlib.sha1(b"dns\r\n\r\nanswer").hexdigest(), "response", None, None), (None, None, None, "revisit", None, None)]
    assert got == sorted(want, key=str)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(other(b"response", http, is_http, b"WARC-Payload-Digest: sha1:" + b"0" * 40)))


def test_warc_repeated_rows_have_identifiers_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x")] * 3, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a")
    data = b"".join(f.read_bytes() for f in (tmp_path / "a").glob("part-*"))
    assert len({h["warc-record-id"] for h, _ in warc.read_archive(data)}) == 3


def test_warc_reader_is_incremental():
    payload = bytes(R.randrange(256) for _ in range(200_000))
    data = warc.gzip_member(record(payload))
    pieces = list(next(warc.members(data)))
    assert len(pieces) > 1
    assert list(warc.read_archive(data))[0][1] == payload


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"words number {i} of a text that is all its own " + " ".join(str(R.random()) for _ in range(20)), "en", f"s{i % 6}", 1) for i in range(30)]
    rows += [(100 + i, rows[0][1], "en", f"s{i}", 1) for i in range(6)] + [(200, "12 34", "en", "s0", 5), (201, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"file://{tmp_path}")
        assert kept.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = {r["doc_id"] for r in packed}
    assert {r[0] for r in rows[:30]} <= ids and not {200, 201} & ids


def test_pipeline_leaves_one_of_each_copy_group(spark, tmp_path):
    """Copies over few and over many sources: one document of each group is left, and none without characters."""
    import corpus_pipeline

    def text(i):
        return "\n".join(f"line {j} of text {i} " + " ".join(str(R.random()) for _ in range(9)) for j in range(3))

    rows = [(i, text(i), "en", f"s{i % 6}", 1) for i in range(20)]
    groups = {100: 3, 200: 6, 300: 40}
    for first, n in groups.items():
        copy = text(first)
        rows += [(first + i, copy + ("\n \n" if i == 1 else ""), "en", f"s{i}", 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in packed} == {*range(20), *groups} and all(r["n_chars"] for r in packed)


def test_line_dedup_drops_only_what_it_empties(spark):
    from lakeloom.llm import line_dedup

    rows = [(i, "a line of many sites", f"s{i}") for i in range(6)] + [(10, " \n", "s1"), (11, "", "s2"), (12, None, "s3"), (13, "a line of many sites\nand its own", "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, drop_emptied=True).collect()}
    assert got == {0: "a line of many sites", 10: " \n", 11: "", 12: None, 13: "and its own"}
    assert line_dedup.remove_boilerplate(docs).count() == len(rows)
