"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The encoder is exact without running the merge queue over the text.  A token
sequence is the merge result of its text if and only if every pair of
neighbours is the merge result of its own two-token text: the merges inside two
neighbours happen in the same relative order in the text as in the pair, so the
first merge across their border would show in the pair as well.  Encoding is
therefore a search for a path of compatible tokens:

* an Aho-Corasick automaton over the vocabulary gives the longest piece that
  starts at each position;
* a piece is accepted if re-merging it together with its left neighbour gives
  those two tokens back (results are memoised);
* otherwise the next shorter piece at that position is tried, then the
  neighbour is taken back; positions from which no continuation exists are
  bits of an integer, so that none is explored twice.

No piece of the supported models has the space mark after another character, so
no merge crosses the border between a character and a following space mark, and
a text is encoded one unit (space marks, then other characters) at a time.
Units are memoised in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5  # piece types in the model format
MEMO_UNITS, MEMO_PAIRS, MEMO_CHARS = 300_000, 1_000_000, 48  # units in a generation of the memo, pairs, longest unit kept
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SLICE_ROWS = 256


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message, as (number, raw value)."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"not a SentencePiece model: wire type {kind}")
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Codec:
    """Encoder and decoder of one model file's bytes.

    Supported: BPE models with the identity normaliser, byte fallback, a dummy
    space before the text and white space kept; anything else is refused, since
    the result could differ from the library's.
    """

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(model):
            if number == 1:
                d = dict(_fields(value))
                score = struct.unpack("<f", d[2])[0] if 2 in d else 0.0
                self.pieces.append((d[1].decode("utf-8"), score, d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = {k for _, _, k in self.pieces}
        inner = any(k == NORMAL and MARK in p.lstrip(MARK) for p, _, k in self.pieces)
        if trainer.get(3) != 2 or not trainer.get(35) or kinds & {USER_DEFINED, UNUSED} or inner:
            raise ValueError("only BPE models with byte fallback and no user-defined, unused or many-word pieces are supported")
        if normalizer.get(2) or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1:
            raise ValueError("only the identity normaliser with a dummy prefix and kept white space is supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.score = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.end_id = next(i for i, (p, _, k) in enumerate(self.pieces) if k == CONTROL and p == "</s>")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self._id_text = [str(i) for i in range(len(self.pieces))]
        self._piece_text = [p.replace(MARK, " ") if k == NORMAL else None for p, _, k in self.pieces]
        self._shorter: dict[str, str | None] = {}
        self._pair: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}
        self._odd: dict[str, str] = {}
        self._units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def merge(self, text: str) -> list[str]:
        """The library's rule itself: merge the best-scored pair, leftmost first, until none is left."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        score, queue = self.score, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, b, len(part[a]), len(part[b])))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, size_a, size_b = heapq.heappop(queue)
            if len(part[a]) != size_a or len(part[b]) != size_b or right[a] != b:
                continue
            part[a] += part[b]
            part[b] = ""
            right[a] = right[b]
            if right[a] < len(part):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def _compatible(self, one: str, two: str) -> bool:
        """Whether the text of both tokens merges to just these two (``one`` may be empty)."""
        self._pairs += 1
        if self._pairs > MEMO_PAIRS:
            self._pair.clear()
            self._pairs = 0
        found = self._pair.setdefault(one, {})[two] = self.merge(one + two) == ([one, two] if one else [two])
        return found

    def _next_shorter(self, piece: str) -> str | None:
        found = self._shorter.get(piece, "")
        if found == "":
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
            self._shorter[piece] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """Pieces of a text whose spaces are marks; a character outside the vocabulary stands alone."""
        longest = {}  # an end comes after all ends before it, so the last piece kept for a start is the longest
        for end, size in self.automaton.iter(text):
            longest[end - size] = end
        out: list[str] = []
        at, size, failed = 0, len(text), 0
        compatible, pair, before = self._compatible, self._pair, ""
        token: str | None = text[: longest.get(-1, 0) + 1]
        while True:
            known = pair.get(before)
            while token is not None:
                end = at + len(token)
                if not (failed and failed >> end & 1):
                    ok = known.get(token) if known is not None else None
                    if ok or (ok is None and compatible(before, token)):
                        break
                token = self._next_shorter(token)
            if token is not None:
                out.append(token)
                if end == size:
                    return out
                at, before = end, token
                token = text[at : longest.get(at - 1, at) + 1]
                continue
            failed |= 1 << at
            token = out.pop()  # never empty: single characters always are a tokenisation
            at -= len(token)
            before = out[-1] if out else ""
            token = self._next_shorter(token)

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a whole text, as the library gives them, with the end id if asked for."""
        out: list[int] = []
        if text:
            for unit in self._units.findall(MARK + text.replace(" ", MARK)):
                out += self._unit_to_ids(unit)
        return out + [self.end_id] if end else out

    def _unit_to_ids(self, unit: str) -> list[int]:
        ids = self.ids
        tokens = self.tokens(unit)
        try:
            return [ids[t] for t in tokens]
        except KeyError:  # a character outside the vocabulary becomes its bytes
            return [i for t in tokens for i in ([ids[t]] if t in ids else [self.byte_id[b] for b in t.encode("utf-8")])]

    def _raw_text(self, ids: list[int]) -> str:
        """Text of ids before the dummy space is taken off; neighbouring byte pieces are read as UTF-8 together."""
        texts = [self._piece_text[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out, run = [], bytearray()
        for i, text in zip(ids, texts, strict=True):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            kind = self.pieces[i][2]
            out.append(text if kind == NORMAL else " ⁇ " if kind == UNKNOWN else "")
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy space before the first piece goes."""
        text = self._raw_text(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids (end id included), the ids in decimal, and the text decoded from them.

        Units go through a memo of two generations of bounded size.  A unit is
        decoded from its ids when it enters the memo; the few whose decoded text
        differs from themselves are kept aside, so that the others need no
        second look-up.
        """
        if not text:
            return 1, str(self.end_id), ""
        units = self._units.findall(MARK + text.replace(" ", MARK))
        if len(self._young) > MEMO_UNITS:
            self._old, self._young = self._young, {}
            self._odd = {u: t for u, t in self._odd.items() if u in self._old}
        young, old, large = self._young, self._old, []
        for unit in set(units).difference(young):
            known = old.get(unit)
            if known is not None:
                young[unit] = known
                continue
            ids = self._unit_to_ids(unit)
            young[unit] = " ".join([self._id_text[i] for i in ids]) + " "
            decoded = self._raw_text(ids)
            if decoded != unit.replace(MARK, " "):
                self._odd[unit] = decoded
            if len(unit) > MEMO_CHARS:
                large.append(unit)
        ids = "".join([young[u] for u in units]) + str(self.end_id)
        if self._odd:
            decoded = "".join([self._odd.get(u) or u.replace(MARK, " ") for u in units])
        else:
            decoded = "".join(units).replace(MARK, " ")
        for unit in large:
            del young[unit]
            self._odd.pop(unit, None)
        return ids.count(" ") + 1, ids, decoded[1:] if decoded.startswith(" ") else decoded


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, kept for the life of a Python worker."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One narrow pass without a shuffle; repeated rows give repeated results.  A
    null text counts as empty (one end id); other columns are not read.  A null
    doc_id stays null.  ``model_path`` must exist on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                n_tokens, ids_sha, text_sha = [], [], []
                for text in part.column(1):
                    n, ids, decoded = own.digest(text.as_py() or "")
                    n_tokens.append(n)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def tokenize(docs: DataFrame, model_path: str) -> DataFrame:
    """The ids themselves: doc_id, ids (array of int), decoded text.  Nulls as in :func:`encode_documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = [own.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"]
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
