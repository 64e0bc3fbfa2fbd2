"""A quality classifier by co-training of two views.

One logistic classifier sees what a text says and how (hashed words, telling words, shape), the other sees what is known
about the document (language, source and length). Over ``ROUNDS`` rounds each hands the other its most confident labels for
unlabelled documents, in the class proportions of the labelled ones: every round scores all unlabelled documents and takes the
most confident anew. Both views are calibrated on held-out labelled documents, and a small logistic model over the two
calibrated views scores all documents. Several heads (say, quality and toxic) are fitted and scored in the same passes.

What a fit brings to the driver is bounded: ``LABELLED`` labelled documents, chosen by a hash of the id, as ``WIDTH`` numbers
each; the ``TELLING`` words for each head that tell its classes apart best among these; and ``CONFIDENT`` documents a round,
view and head. Executors read whole texts, once for the unlabelled ones, whose numbers are written and read back by each round.
Near copies count as one among the labelled documents, and equal ones among the confident, so a group of copies decides nothing.

A null text is an empty text; null language, source or length are values like others. A label other than 0 and 1 and a
label without a document are left out; a document with two different labels counts once with each. Rows of one id with
different texts are documents of their own with the same label; repeated rows are one when fitting. With fewer than two
classes among the labels every document gets their share as its score (0.5 without labels). Repeated rows get equal scores. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.shingles import alnum_words, hash_words, shingle_hashes
from seriesloom.llm.tables import stored

LABELLED = 4000
ROUNDS, CONFIDENT = 4, 200
#: Words that tell the classes of a head apart: their number, the labelled documents that hold one at least, and by how many
#: standard errors its shares must differ.
TELLING, LEAST, SURE = 128, 5, 5.0
WORDS, SHAPES = 256, 10
META = 96
L2 = 1e-2
#: Ids of labelled documents up to this number are sent to all tasks; beyond, Spark joins them.
BROADCAST_IDS = 4_000_000
#: Results of tasks are first reduced in so many parts.
PARTS = 32


class Views:
    """Where a document's numbers come from. ``telling``: a place for each telling word."""

    def __init__(self, telling: dict[bytes, int]) -> None:
        self.telling = telling
        self.text = WORDS + SHAPES + len(telling)
        self.width = self.text + META
        self.columns = (slice(0, self.text), slice(self.text, self.width))

    def text_view(self, text: str | None) -> np.ndarray:
        """Hashed word shares, the shape of a whole text, and which telling words it holds."""
        out = np.zeros(self.text, np.float32)
        out[: WORDS + SHAPES] = _shape_and_words(text or "")
        if self.telling:
            for w in self.telling.keys() & set(alnum_words(text)):
                out[WORDS + SHAPES + self.telling[w]] = 1
        return out

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """The views of rows whose first four columns are text, lang, source, n_chars."""
        x = np.zeros((batch.num_rows, self.width), np.float32)
        for i, (t, *meta) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
            x[i, : self.text] = self.text_view(t)
            x[i, self.text :] = meta_view(*meta)
        return x.astype(np.float16).astype(np.float32)  # as the written ones


def _shape_and_words(text: str) -> np.ndarray:
    words = text.split()
    out = np.zeros(WORDS + SHAPES, np.float32)
    n = max(1, len(words))
    if words:
        w = np.empty(len(words), dtype=object)
        w[:] = words
        out[:WORDS] = np.sqrt(np.bincount(pd.util.hash_array(w, categorize=False) % np.uint64(WORDS), minlength=WORDS) / n)
    lines = [x for x in text.split("\n") if x.strip()]
    c = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(c, minlength=256) / max(1, len(c)) if len(c) else np.zeros(256)
    upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    out[WORDS:] = (
        np.log1p(n) / 10,
        len(set(words)) / n,
        min(4, len(text) / n / 10),
        1 - len(set(lines)) / max(1, len(lines)),
        upper,
        lower,
        digit,
        kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum(),
        kinds[128:].sum(),
        np.log1p(len(lines)) / 10,
    )
    return out


def meta_view(lang, source, n_chars) -> np.ndarray:
    out = np.zeros(META, np.float32)
    names = np.array([f"lang={lang}", f"source={source}"], dtype=object)
    a, b = pd.util.hash_array(names, categorize=False)
    out[int(a % np.uint64(16))] = 1
    out[16 + int(b % np.uint64(64))] = 1
    size = -1 if n_chars is None or n_chars < 0 else int(np.log2(n_chars + 1) / 2)
    out[80 + min(15, size + 1)] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = L2) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(len(w), l2 * len(x) / 10)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass(frozen=True)
class Model:
    """One head: weights of both views, their calibration, and the joint model over the calibrated logits."""

    weights: Sequence[np.ndarray]
    calibration: Sequence[np.ndarray]
    joint: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray, columns: Sequence[slice]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-_logit(self.views(x, columns), self.joint)))

    def views(self, x: np.ndarray, columns: Sequence[slice]) -> np.ndarray:
        """Calibrated logits of both views."""
        raw = (_logit(x[:, c], w) for c, w in zip(columns, self.weights, strict=True))
        return np.stack([_logit(r[:, None], c) for r, c in zip(raw, self.calibration, strict=True)], axis=1)


class Trainer:
    """The labelled rows of one head; every fourth is held out for calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, columns: Sequence[slice]) -> None:
        self.columns = columns
        held = np.arange(len(y)) % 4 == 3
        self.x, self.y, self.held_x, self.held_y = x[~held], y[~held], x[held], y[held]
        self.share = float(np.mean(y)) if len(y) else 0.5
        self.constant = len(set(self.y)) < 2 or len(set(self.held_y)) < 2

    def weights(self, given: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Weights of both views; ``given``: for each view the rows and labels that the other one handed over."""
        out = []
        for cols, (x, y) in zip(self.columns, given, strict=True):
            weight = np.r_[np.ones(len(self.y)), np.full(len(y), 0.3)]
            out.append(_logistic(np.concatenate([self.x[:, cols], x[:, cols]]), np.concatenate([self.y, y]), weight))
        return out

    def model(self, weights: Sequence[np.ndarray]) -> Model:
        if self.constant:
            return Model((), (), np.zeros(0), self.share)
        raw = [_logit(self.held_x[:, c], w) for c, w in zip(self.columns, weights, strict=True)]
        calibration = [_logistic(r[:, None], self.held_y, l2=1e-4) for r in raw]
        model = Model(weights, calibration, np.zeros(3))
        return Model(weights, calibration, _logistic(model.views(self.held_x, self.columns), self.held_y, l2=1e-3))


@dataclass(frozen=True)
class Classifier:
    views: Views
    heads: dict[str, Model]


_COLUMNS = ("text", "lang", "source", "n_chars")


def _first(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows by a hash of ``columns``; only these and the hash are sorted, a few per task."""
    u = F.xxhash64(*columns, F.lit("co-training"))
    return rows.select(*columns).distinct().withColumn("_u", u).orderBy("_u", *columns).limit(n).drop("_u")


def _with_group() -> Callable:
    """Rows whose first column is a text, and one more: the smallest hash of the text's five-word shingles.

    Near copies mostly share it, so that they can count as one.
    """

    def run(batches):
        for batch in batches:
            group = []
            for t in batch.column(0).to_pylist():
                words = alnum_words(t)
                h = shingle_hashes(hash_words(words), min(5, len(words))) if words else np.zeros(1, np.uint64)
                group.append(int(h.min().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int64())], names=[*batch.schema.names, "group"])

    return run


def _distinct_words(heads: int) -> Callable:
    """(text, labels ...) to the distinct words of each text with its labels."""

    def run(batches):
        for batch in batches:
            words = [sorted(set(alnum_words(t))) for t in batch.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(words)), [len(w) for w in words]))
            labels = [batch.column(1 + h).take(at) for h in range(heads)]
            flat = pa.array([w for ws in words for w in ws], pa.binary())
            yield pa.RecordBatch.from_arrays([flat, *labels], names=["word", *[f"l{h}" for h in range(heads)]])

    return run


def telling_words(rows: DataFrame, heads: Sequence[str], n: int = TELLING) -> list[bytes]:
    """For each head at most ``n`` words whose shares among its classes differ most, in standard errors."""
    schema = ", ".join(["word binary", *[f"l{i} int" for i in range(len(heads))]])
    words = rows.select("text", *heads).mapInArrow(_distinct_words(len(heads)), schema)
    counts = []
    for i in range(len(heads)):
        counts += [F.count_if(F.col(f"l{i}") == c).alias(f"n{i}{c}") for c in (0, 1)]
    found = stored(words.groupBy("word").agg(*counts), "word-counts")
    totals = rows.agg(*[F.count_if(F.col(h) == c).alias(f"t{i}{c}") for i, h in enumerate(heads) for c in (0, 1)]).first()
    out: set[bytes] = set()
    for i in range(len(heads)):
        t0, t1 = totals[f"t{i}0"], totals[f"t{i}1"]
        if not t0 or not t1:
            continue
        n0, n1 = F.col(f"n{i}0"), F.col(f"n{i}1")
        p = (n0 + n1 + 1) / (t0 + t1 + 2)
        z = F.abs(n1 / t1 - n0 / t0) / F.sqrt(p * (1 - p) * (1 / t0 + 1 / t1))
        best = found.where(n0 + n1 >= LEAST).select("word", z.alias("z")).where(F.col("z") >= SURE)
        best = best.orderBy(F.desc("z"), "word").limit(n)
        out |= {bytes(r["word"]) for r in best.collect()}
    return sorted(out)


def _features(views: Views, kept: int) -> Callable:
    """The numbers of each row, and the last ``kept`` columns as they are."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = pa.array([r.tobytes() for r in views.matrix(part).astype(np.float16)], pa.binary())
                rest = part.columns[4 : 4 + kept]
                yield pa.RecordBatch.from_arrays([rows, *rest], names=["x", *[f"l{i}" for i in range(kept)]])

    return run


def _rows(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, width).astype(np.float32)


def _confident(weights: dict[str, list[np.ndarray]], wanted: dict[str, tuple[int, int]], views: Views) -> Callable:
    """(x, key) of unlabelled rows to the keys of each task's most confident ones: (head, view, label, sure, key), each key once."""

    def run(batches):
        best: dict[tuple[str, int, int], dict[int, float]] = {}
        for batch in batches:
            key = batch.column(1).to_pylist()
            if not key:
                continue
            x = _rows(batch.column(0).to_pylist(), views.width)
            for head, both in weights.items():
                for view, (cols, w) in enumerate(zip(views.columns, both, strict=True)):
                    logit = _logit(x[:, cols], w)
                    for label, sign in ((0, -1), (1, 1)):
                        sure, n = sign * logit, wanted[head][label]
                        top = best.setdefault((head, view, label), {})
                        for i in np.argsort(-sure, kind="stable"):
                            if sure[i] <= 2 or len(top) >= 2 * n:
                                break
                            top[key[i]] = float(sure[i])
                        if len(top) > n:
                            order = sorted(top.items(), key=lambda kv: (-kv[1], kv[0]))
                            best[head, view, label] = dict(order[:n])
        flat = [(h, v, c, s, k) for (h, v, c), top in best.items() for k, s in top.items()]
        for at in range(0, len(flat), 8192):
            cols = zip(*flat[at : at + 8192], strict=True)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["head", "view", "label", "sure", "key"]
            )

    return run


def _handed_over(free: DataFrame, weights: dict, trainers: dict[str, Trainer], n: int, views: Views) -> dict:
    """For each head and view the ``n`` rows of all of ``free`` (x, key: its hash) of which it is surest, in the proportions
    of the labels. Keys are sorted out first; only the rows chosen in the end are fetched.
    """
    wanted = {h: (max(1, round(n * (1 - t.share))), max(1, round(n * t.share))) for h, t in trainers.items() if h in weights}
    schema = "head string, view int, label int, sure double, key long"
    found = free.select("x", "key").mapInArrow(_confident(weights, wanted, views), schema)
    limit = F.lit(0)
    for h, (low, high) in wanted.items():
        limit = F.when(F.col("head") == h, F.when(F.col("label") == 0, low).otherwise(high)).otherwise(limit)
    slot = ["head", "view", "label"]
    found = found.dropDuplicates([*slot, "key"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    for keys in ([*slot, "part"], slot):
        order = Window.partitionBy(*keys).orderBy(F.desc("sure"), "key")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")
    chosen = stored(found.drop("part"), "confident")  # n rows for each head and view
    some = free.join(F.broadcast(chosen.select("key").distinct()), "key").groupBy("key").agg(F.first("x").alias("x"))
    x_of = {r["key"]: bytes(r["x"]) for r in some.collect()}
    out: dict[tuple[str, int], list] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["label"], -r["sure"], r["key"])):
        out.setdefault((r["head"], r["view"]), []).append((x_of[r["key"]], r["label"]))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, heads: Sequence[str] = ("quality",), labelled: int = LABELLED, confident: int = CONFIDENT
) -> Classifier:
    """A classifier from ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, one column per head)."""
    label = [F.when(F.col(h).isin(0, 1), F.col(h)).cast("int").alias(h) for h in heads]
    known = labels.select("doc_id", *label).where(F.col("doc_id").isNotNull()).dropna("all", subset=list(heads))
    ids = F.broadcast(stored(_first(known.join(docs.select("doc_id"), "doc_id", "left_semi"), labelled, "doc_id"), "labelled"))
    named = docs.select("doc_id", *_COLUMNS, F.xxhash64(*_COLUMNS).alias("_row"))
    rows = F.broadcast(stored(_first(named.join(ids, "doc_id"), labelled, "doc_id", "_row"), "labelled-rows"))
    own = named.join(rows, ["doc_id", "_row"]).dropDuplicates(["doc_id", "_row"])
    own = own.join(known.join(ids, "doc_id").distinct(), "doc_id").select(*_COLUMNS, *heads)
    schema = ", ".join(f"{n} {t}" for n, t in own.dtypes) + ", group long"
    own = own.mapInArrow(_with_group(), schema).dropDuplicates(["group", *heads])
    own = stored(own.drop("group"), "labelled-texts")
    views = Views({w: i for i, w in enumerate(telling_words(own, heads))})

    got = own.select(*_COLUMNS, *heads).mapInArrow(
        _features(views, len(heads)), ", ".join(["x binary", *[f"l{i} int" for i in range(len(heads))]])
    )
    got = sorted((bytes(r["x"]), *[-1 if v is None else v for v in r[1:]]) for r in got.collect())
    got = [got[i] for i in np.random.default_rng(7).permutation(len(got))]
    trainers = {}
    for i, h in enumerate(heads):
        mine = [r for r in got if r[1 + i] >= 0]
        x = _rows([r[0] for r in mine], views.width) if mine else np.zeros((0, views.width), np.float32)
        trainers[h] = Trainer(x, np.array([r[1 + i] for r in mine], float), views.columns)

    nothing = (np.zeros((0, views.width), np.float32), np.zeros(0))
    live = [h for h in heads if not trainers[h].constant]
    weights = {h: trainers[h].weights([nothing, nothing]) for h in live}
    if live:
        taken = known.select("doc_id").distinct()
        if taken.count() <= BROADCAST_IDS:
            taken = F.broadcast(taken)  # else every text would be shuffled for it
        free = docs.select("doc_id", *_COLUMNS).join(taken, "doc_id", "left_anti")
        free = free.select(*_COLUMNS).mapInArrow(_features(views, 0), "x binary")
        free = stored(free.withColumn("key", F.xxhash64("x")), "unlabelled")
        for r in range(1, ROUNDS + 1):
            found = _handed_over(free, weights, trainers, confident * r, views)
            for h in live:
                given = []
                for view in (0, 1):  # what the other view is sure of
                    pairs = found.get((h, 1 - view), [])
                    x = _rows([k for k, _ in pairs], views.width) if pairs else nothing[0]
                    given.append((x, np.array([c for _, c in pairs], float)))
                weights[h] = trainers[h].weights(given)
    return Classifier(views, {h: trainers[h].model(weights.get(h, ())) for h in heads})


def _score(model: Classifier) -> Callable:
    def run(batches):
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 256):
                x = model.views.matrix(batch.slice(at, 256))
                parts.append(np.stack([m.score(x, model.views.columns) for m in model.heads.values()], axis=1))
            score = np.concatenate(parts) if parts else np.zeros((0, len(model.heads)))
            columns = [pa.array(np.ascontiguousarray(score[:, i]), pa.float64()) for i in range(len(model.heads))]
            yield pa.RecordBatch.from_arrays([batch.column(4), *columns], names=["doc_id", *_names(model)])

    return run


def _names(model: Classifier) -> list[str]:
    return [f"score_{h}" if i else "score" for i, h in enumerate(model.heads)]


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the probability that the first head's label is 1; for each further head
    a column ``score_<head>``.
    """
    columns = ", ".join(["doc_id long", *[f"{c} double" for c in _names(model)]])
    return docs.select(*_COLUMNS, "doc_id").mapInArrow(_score(model), columns)
