"""Language identification by hierarchical discrimination.

A text's language family is predicted first, by linear support vector machines
one against the rest; within the family, one-versus-one linear support vector
machines separate each pair of close languages and their votes decide.  All see
the same features: relative frequencies of hashed byte bigrams and trigrams of
the lower-cased text, so a score is a mean of per-gram weights and any length of
text takes one pass with bounded memory.

Learning uses a bounded, documented sample of labelled rows (``per_language``
rows a language, chosen by a hash of doc_id); prediction covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_LANGUAGE = 800  # labelled rows to learn from, for each language
MOST_LANGUAGES = 64  # languages learned: those with the most labelled rows, ties in alphabetical order
MOST_SAMPLED = 20_000  # labelled rows in all: with more than 25 languages, each has fewer
BIGRAMS, TRIGRAMS = 1 << 12, 1 << 13  # buckets of hashed grams
GRAMS = BIGRAMS + TRIGRAMS
SLICE_BYTES = 4_000_000  # bytes of text handled at once; a longer single text is handled alone
UNDETERMINED = "und"
LEAST_SCORE = 0.6  # below this score a language is not determined; of the held-out rows of sf0.1, 5 of 3,358 are below it, four of them in two languages
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

# Families of common ISO 639-1 codes.  Others share one family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa sa si ur",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "yue zh",
}
OTHER_FAMILY = "other"


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), OTHER_FAMILY)


def _symbols() -> np.ndarray:
    """Byte to symbol: ASCII letters and bytes of other characters stay, all else is a space."""
    table = np.full(256, 32, np.uint32)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


SYMBOLS = _symbols()


def gram_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and trigram buckets at each byte of the texts, and where each text starts.

    Every text stands between spaces, so its grams don't depend on its neighbours.
    """
    data = b" " + b"  ".join(texts) + b"    "
    raw = SYMBOLS[np.frombuffer(data, np.uint8)]
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    end = int(sizes.sum())
    pair = raw[:-1] * np.uint32(256) + raw[1:]
    two = ((pair[:end] * np.uint32(2654435769)) >> np.uint32(20)).astype(np.int32)  # multiplicative hashing to 12 bits
    three = ((((pair[:end] << np.uint32(8)) | raw[2 : end + 2]) * np.uint32(2246822519)) >> np.uint32(19)).astype(np.int32) + BIGRAMS
    return two, three, starts


@dataclass
class Model:
    """Weights by bucket: a column for each family, then one for each pair within a family."""

    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Decision values, a row for each text."""
        two, three, starts = gram_ids(texts)
        sizes = np.diff(np.append(starts, len(two)))
        out = np.empty((len(texts), self.weights.shape[1]))
        for j in range(out.shape[1]):
            w = np.ascontiguousarray(self.weights[:, j])
            mean = np.add.reduceat(w[two] + w[three], starts, dtype=np.float64) / sizes
            out[:, j] = mean + self.bias[j]
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not texts:
            return []
        if len(self.languages) < 2:
            return [(self.languages[0], 1.0) if self.languages else (UNDETERMINED, 0.0)] * len(texts)
        values = self.scores(texts)
        sure = 1 / (1 + np.exp(-4 * np.clip(values, -30, 30)))
        n = len(self.families)
        members = [[x for x in self.languages if family_of(x) == f] for f in self.families]
        chosen = values[:, :n].argmax(axis=1) if n > 1 else np.zeros(len(texts), int)
        out = []
        for i, f in enumerate(chosen):
            own = members[f]
            score = sure[i, f] if n > 1 else 1.0
            if len(own) == 1:
                out.append((own[0], float(score)))
                continue
            votes = dict.fromkeys(own, 0)
            margin = dict.fromkeys(own, 0.0)
            least = {x: 1.0 for x in own}
            for j, (a, b) in enumerate(self.pairs, n):
                if a in votes and b in votes:
                    v = values[i, j]
                    votes[a if v > 0 else b] += 1
                    margin[a] += v
                    margin[b] -= v
                    least[a], least[b] = min(least[a], sure[i, j]), min(least[b], 1 - sure[i, j])
            best = max(own, key=lambda x: (votes[x], margin[x]))
            out.append((best, float(score * least[best])))
        return out


Row = tuple[np.ndarray, np.ndarray]  # buckets of a text's grams, and their values


def linear_svm(rows: list[Row], y: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge linear SVM by dual coordinate descent on sparse rows; y is +1 or -1."""
    rng = np.random.default_rng(seed)
    n = len(y)
    share = {s: cost * n / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}  # balances the classes
    diag = [1 / (2 * share[int(s)]) for s in y]
    w, b, alpha = np.zeros(GRAMS), 0.0, [0.0] * n
    norm = [float(v @ v) + 1 + d for (_, v), d in zip(rows, diag, strict=True)]
    for _ in range(passes):
        for i in rng.permutation(n):
            ids, v = rows[i]
            g = y[i] * (v @ w[ids] + b) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * v
                b += step
                alpha[i] = new
    return w, b


def fit(sampled: list[tuple[str, bytes, bytes, int]]) -> Model:
    """Learn from (language, gram buckets, their counts, number of positions) of sampled rows."""
    languages = sorted({r[0] for r in sampled})
    if len(languages) < 2:
        return Model(languages)
    rows: list[Row] = []
    total, squares = np.zeros(GRAMS), np.zeros(GRAMS)
    for _, ids, counts, size in sampled:
        at, v = np.frombuffer(ids, np.uint16).astype(np.int32), np.frombuffer(counts, np.uint32) / np.float64(size)
        total[at] += v
        squares[at] += v * v
        rows.append((at, v))
    n = len(rows)
    spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    scale = 1 / (np.sqrt(GRAMS) * (spread + 1e-4))
    rows = [(at, v * scale[at]) for at, v in rows]
    lang = np.array([r[0] for r in sampled])
    family = np.array([family_of(v) for v in lang])
    families = sorted(set(family))
    columns, bias, pairs = [], [], []
    if len(families) > 1:
        for f in families:
            w, b = linear_svm(rows, np.where(family == f, 1, -1))
            columns.append(w * scale)
            bias.append(b)
    else:
        columns.append(np.zeros(GRAMS))
        bias.append(0.0)
    for f in families:
        for one, two in combinations(sorted(set(lang[family == f])), 2):
            at = np.flatnonzero((lang == one) | (lang == two))
            w, b = linear_svm([rows[i] for i in at], np.where(lang[at] == one, 1, -1))
            pairs.append((str(one), str(two)))
            columns.append(w * scale)
            bias.append(b)
    return Model(languages, [str(f) for f in families], pairs, np.stack(columns, axis=1).astype(np.float32), np.array(bias))


def held_out(doc_id):
    """Whether crc32 of the decimal doc_id leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about SLICE_BYTES with their lower-cased texts."""
    texts = pc.utf8_lower(batch.column(at)).cast(pa.binary()).to_pylist()
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or b"") > SLICE_BYTES:
            yield first, i, [x or b"" for x in texts[first:i]]
            first, size = i, 0
        size += len(t or b"")
    if texts:
        yield first, len(texts), [x or b"" for x in texts[first:]]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language among rows with a lang that are not held out.

    The rows are those whose hashed doc_id falls in a fraction set by the
    language's count, so the choice needs no sort and no task holds a language.
    Of very many lang values, as dirty labels make them, MOST_LANGUAGES are learned.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    labels = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r[0]: r[1] for r in labels.collect()}
    if not counts:
        return Model()
    if len(counts) == 1:
        return Model(list(counts))
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000))
    per_language = max(1, min(per_language, MOST_SAMPLED // len(counts)))
    limit = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1_000_000, per_language * 1_000_000 // n + 1))])
    chosen = rows.filter(spread < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, _, texts in _slices(batch, 1):
                for i, text in enumerate(texts):
                    if any(map(str.isalpha, text.decode())):
                        two, three, _ = gram_ids([text])
                        ids, n = np.unique(np.concatenate((two, three)), return_counts=True)
                        out.append((batch.column(0)[first + i].as_py(), ids.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes(), len(two)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)],
                    names=["lang", "ids", "counts", "size"],
                )

    sampled = chosen.mapInArrow(count, "lang string, ids binary, counts binary, size long").collect()
    return fit(sorted((r[0], bytes(r[1]), bytes(r[2]), r[3]) for r in sampled))


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Only the text decides.  A null, empty or letterless text is ``und`` with
    score 0, as is everything when nothing was learned.  Equal decision values
    or votes go to the family or language that is first in the alphabet.  Repeated rows give
    repeated results.  Narrow: no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB a family or pair; documents don't enlarge it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, _, texts in _slices(batch, 1):
                clear = [any(map(str.isalpha, t.decode())) for t in texts]
                found = iter(own.predict([t for t, ok in zip(texts, clear, strict=True) if ok]))
                for ok in clear:
                    lang, score = next(found) if ok else (UNDETERMINED, 0.0)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.column(2)], names=["doc_id", "lang_pred", "score", "held_out"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, held_out boolean").select("doc_id", "held_out", "lang_pred", "score")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict every row."""
    return predict_languages(docs, learn(docs, per_language))


def keep_determined(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: list[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """All columns of the documents whose language is determined, and, if ``languages`` is given, is one of them.

    Rows without a letter (null, empty, digits or punctuation only) go, and so do
    texts that the model gives a score below ``least_score``: those of no learned
    language, or of several.  All other rows stay as they are, whatever their
    source or labels.  With fewer than two learned languages there is nothing to
    tell apart, so that every text with a letter stays.
    """
    model = learn(docs, per_language)
    sent = docs.sparkSession.sparkContext.broadcast((model, None if languages is None else frozenset(languages)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = sent.value
        told = len(own.languages) > 1
        for batch in batches:
            keep: list[bool] = []
            for _, _, texts in _slices(batch, at):
                clear = [any(map(str.isalpha, t.decode())) for t in texts]
                found = iter(own.predict([t for t, ok in zip(texts, clear, strict=True) if ok]))
                for ok in clear:
                    lang, score = next(found) if ok else (UNDETERMINED, 0.0)
                    keep.append(ok and (score >= least_score or not told) and (wanted is None or lang in wanted))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
