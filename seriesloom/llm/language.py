"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (2 to 5 characters, presence only) that both hold, over the geometric
mean of the numbers each holds: a blended-spectrum presence kernel. Nyström landmarks, drawn evenly from the languages of
the training sample, give each text a feature vector K(x, landmarks) K(landmarks, landmarks)^(-1/2); one-versus-rest kernel
ridge regression is a linear ridge regression on it. n-grams are hashed into ``BUCKETS`` buckets.

Presence says little about a long text, which holds nearly every n-gram and would fill the buckets. A text is therefore cut
into equal pieces of at most ``PIECE`` characters (neighbours share the n-grams across their border), and its kernel with a
landmark is the mean over all its pieces, when fitting and when scoring. Pieces of many texts make up one 0/1 matrix.

The fit uses a bounded sample: at most ``per_language`` whole training texts of each label, chosen by a hash of the id, and
fewer than that where labels are so many that the sample exceeded ``SAMPLE`` texts, but one at least. Every label that occurs
is learned, with ``landmarks`` shared out over the labels, one at least each. The driver sees a packed bit row per landmark
and a row of kernel values per sampled text. Scoring reads every whole text.

Null texts and texts without a letter are ``und`` with score 0. So is everything if nothing can be learned (an empty table,
no labels). Rows with a null label are scored but not learned from. Repeated rows get equal results; a row's answer depends
on its text alone. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.shingles import A, B
from seriesloom.llm.tables import stored

BUCKETS = 1 << 14
LENGTHS = (2, 3, 4, 5)
PER_LANGUAGE = 200
LANDMARKS = 96
#: Sampled texts over all languages, unless there are more languages than that.
SAMPLE = 12_800
#: Characters of a piece; about 4 n-grams a character then leave most buckets empty.
PIECE = 2000
RIDGE = 1e-2
BATCH = 64


def presence(text: str) -> np.ndarray:
    """0/1 by bucket: the n-grams of the lower-cased text, white space taken as one blank."""
    row = np.zeros(BUCKETS, np.float32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c <= 32) | (c == 160), np.uint32(32), c)
    if len(c):
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    x = c.astype(np.uint64) * B
    h = x
    for n in range(2, max(LENGTHS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * A + x[n - 1 :]
        if n in LENGTHS:
            row[((h ^ (h >> np.uint64(29))) * A >> np.uint64(50)).astype(np.int64)] = 1
    return row


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in equal pieces of at most ``size`` characters, each prolonged so that no n-gram is cut."""
    n = max(1, -(-len(text) // size))
    edges = [len(text) * i // n for i in range(n + 1)]
    return [text[a : b + max(LENGTHS) - 1] for a, b in zip(edges, edges[1:])]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams of presence rows over the geometric mean of their numbers."""
    return (a @ b.T) / (np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1)))


def kernels(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    """One row a text: the mean over its pieces of the kernel with each landmark."""
    out = np.zeros((len(texts), len(landmarks)))
    count = np.zeros(len(texts))
    rows, of = [], []

    def flush() -> None:
        if rows:
            np.add.at(out, of, kernel(np.stack(rows), landmarks))
            np.add.at(count, of, 1)
        rows.clear()
        of.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            rows.append(presence(piece))
            of.append(i)
            if len(rows) == BATCH:
                flush()
    flush()
    return out / np.maximum(count, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # 0/1, one row per landmark
    weights: np.ndarray  # landmarks by languages: K(x, landmarks) @ weights are the scores
    slope: float  # of the logistic that turns a margin into a probability

    def scores(self, texts: list[str]) -> np.ndarray:
        """Shares over the languages for each text."""
        raw = kernels(texts, self.landmarks) @ self.weights
        e = np.exp(self.slope * (raw - raw.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _packed(batches):
    """The packed presence of one piece of each text, the middle one."""
    for batch in batches:
        cut = [pieces(t) for t in batch.column(1).to_pylist()]
        bits = [np.packbits(presence(p[len(p) // 2]).astype(bool)).tobytes() for p in cut]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])


def _kernel_rows(landmarks: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            rows = [r.astype(np.float32).tobytes() for r in kernels(batch.column(1).to_pylist(), landmarks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "row"])

    return run


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """``lang, text, rank``: at most ``per_language`` texts of each label, ranked by a hash of the row's id.

    Labels are counted first, so that a share of each label a little above what is needed is ranked, not the label.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    count = stored(rows.groupBy("lang").count(), "language-counts")
    bound = max(1, min(per_language, SAMPLE // max(1, count.count())))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # a label with few texts is ranked whole, as a share of them could be none
    share = F.when(F.col("count") <= 20 * bound + 200, 1.0).otherwise(2.0 * bound / F.col("count") + 100.0 / F.col("count"))
    some = rows.withColumn("u", u).join(count, "lang").where(F.col("u") < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))
    return some.withColumn("rank", rank).where(F.col("rank") <= bound).select("lang", "text", "rank")


def fit(
    rows: DataFrame,
    per_language: int = PER_LANGUAGE,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> Model | None:
    """A model from ``doc_id, text, lang``; None if no row has a text and a label."""
    some = stored(sample(rows, per_language), "language-sample")
    languages = tuple(sorted(r["lang"] for r in some.select("lang").distinct().collect()))
    if not languages:
        return None
    each = max(1, landmarks // len(languages))
    packed = some.where(F.col("rank") <= each).select("lang", "text").mapInArrow(_packed, "lang string, bits binary")
    bits = sorted((r["lang"], bytes(r["bits"])) for r in packed.collect())  # 2 KB a landmark
    marks = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for _, b in bits]).astype(np.float32)
    got = sorted((r["lang"], bytes(r["row"])) for r in some.select("lang", "text").mapInArrow(_kernel_rows(marks), "lang string, row binary").collect())
    k = np.stack([np.frombuffer(b, np.float32) for _, b in got]).astype(np.float64)
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[lang] for lang, _ in got])
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K(landmarks, landmarks)^(-1/2) on its range
    z = k @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ target)
    return Model(languages, marks, (root @ w).astype(np.float32), 4.0)


def _score(model: Model | None) -> Callable:
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
            for at in range(0, len(known), BATCH):
                some = known[at : at + BATCH]
                shares = model.scores([texts[i] for i in some])
                for i, k, s in zip(some, shares.argmax(1).tolist(), shares.max(1).tolist(), strict=True):
                    lang[i], score[i] = model.languages[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (``doc_id``, ``text``)."""
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, lang_pred string, score double")
