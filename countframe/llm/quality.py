"""Quality classifier (operator 6): co-training of two views.

View "content" describes the words of a text (distinct and repeated words,
their lengths, case and endings); view "page" its metadata (source and
language, hashed; length, lines, and the shares of character classes).  Each
view has a logistic classifier.  In every round both label the unlabelled
pool, and each hands its most confident pseudo-labels (an equal share of
either class as in the labels) to the other's training set.  Afterwards both
views are calibrated on labelled rows kept apart, and a logistic curve over
the two calibrated log odds scores all documents, row-locally.

Learning uses bounded samples, chosen by a hash of the id: about ``max_docs``
labelled rows of each class and ``max_pool`` other rows (all of them where
there are fewer), as small dense vectors.

Cases: null and empty texts have the vector of no words; null source or
language is a value of its own.  Repeated labels of a document count as good
if one says so; null labels are not learned from.  Without both classes every
text scores the share of good labels (0 without labels).  Extra columns pass
through; input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.llm.toxicity import fit_logistic
from countframe.session import ship_library

ROUNDS = 5
MAX_DOCS = 5_000         # labelled rows learned from, per class
MAX_POOL = 10_000        # unlabelled rows that receive pseudo-labels
CONFIDENT = 0.95
SOURCES, LANGS = 8, 4    # hash buckets of the metadata values

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",;:", b"!?", b"|", b"%#*$&@^~+=<>"]
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i + 1
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2


def bucket(value: str | None, n: int) -> int:
    """Bucket 0 is null; others by a 64-bit hash of the value."""
    if value is None:
        return 0
    w = ta.Words(next(ta.blocks(pa.array([value or " "]))), np.ones(256, bool), lower=False)
    return 1 + int(w.hash[0] % np.uint64(n - 1))


def views(text, source, lang) -> tuple[np.ndarray, np.ndarray]:
    """(content, page) vectors of a batch."""
    content, page = [], []
    for block in ta.blocks(text):
        w = ta.Words(block, ta.NON_SPACE)
        n = np.maximum(w.counts, 1).astype(float)
        share = lambda flag: np.bincount(w.row, flag, block.n) / n  # noqa: B023,E731
        _, one = np.unique(ta.mix64(w.hash ^ (w.row.astype(np.uint64) * np.uint64(ta._Q))), return_index=True)
        again = np.zeros(len(w.hash))
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        length = w.end - w.start
        kind = _CLASS[block.data]
        last = kind[w.end - 1] if len(w.end) else w.end
        second = kind[np.minimum(w.start + 1, w.end - 1)] if len(w.end) else w.end
        content.append(np.stack([
            np.log1p(w.counts), np.bincount(w.row[one], minlength=block.n) / n, share(again), np.log1p(share(length)),
            share((last >= 7) & (last <= 9)), share(length == 1), share(second == 1), share(length > 20)], axis=1))
        size = np.diff(block.offsets)
        row = np.repeat(np.arange(block.n), size)
        counts = np.bincount(row * _N_CLASSES + kind, minlength=block.n * _N_CLASSES).reshape(block.n, _N_CLASSES)
        shares = counts[:, 1:] / np.maximum(size, 1)[:, None]
        lines = counts[:, 4] + 1.0
        page.append(np.column_stack([shares, np.log1p(size), np.log1p(lines), np.log1p(size / lines)]))
    content = np.concatenate(content) if content else np.zeros((0, 8))
    page = np.concatenate(page) if page else np.zeros((0, _N_CLASSES + 2))
    names: dict = {}
    spot = lambda v, k: names.setdefault((v, k), bucket(v, k))
    tags = np.zeros((len(text), SOURCES + LANGS))
    tags[np.arange(len(text)), [spot(v, SOURCES) for v in source.to_pylist()]] = 1
    tags[np.arange(len(text)), [SOURCES + spot(v, LANGS) for v in lang.to_pylist()]] = 1
    return np.column_stack([content, content ** 2]), np.column_stack([page, page[:, :-3] ** 2, tags])


class View:
    """One standardised logistic classifier and its calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = fit_logistic((x - self.mean) / self.spread, y, weight, ridge=1.0)
        self.curve = np.array([1.0, 0.0])
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.w[:-1] + self.w[-1]
        return np.clip(z, -30, 30) * self.curve[0] + self.curve[1]


class Model:
    def __init__(self, content: View, page: View, mix: np.ndarray):
        self.content, self.page, self.mix = content, page, mix

    def scores(self, text, source, lang) -> np.ndarray:
        a, b = views(text, source, lang)
        z = np.column_stack([self.content.log_odds(a), self.page.log_odds(b)]) @ self.mix[:2] + self.mix[2]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, text, source, lang) -> np.ndarray:
        return np.full(len(text), self.share)


def _vectors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a bounded frame (y, draw, text, source, lang), on the driver
    in a fixed order: (y, content, page)."""

    def describe(batches):
        for b in batches:
            x, z = views(b.column("text"), b.column("source"), b.column("lang"))
            both = np.column_stack([x, z])
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), b.column("draw"), pa.array(list(both), pa.list_(pa.float64()))],
                                             ["y", "draw", "v"])

    got = rows.mapInArrow(describe, "y int, draw double, v array<double>").orderBy("draw", "y").toArrow()
    v = np.array(got["v"].to_pylist()).reshape(got.num_rows, -1)
    return np.array(got["y"].to_pylist(), float), v[:, :16], v[:, 16:]


def co_train(y, a, b, pool_a, pool_b, rounds: int, confident: float) -> tuple[View, View]:
    """Two views that teach each other on the pool."""
    sets = [(a, y), (b, y)]
    free = np.ones(len(pool_a), bool)
    fit = lambda x, t: View().fit(x, t, np.where(t == 1, 0.5 / max(1e-9, t.mean()), 0.5 / max(1e-9, 1 - t.mean())))
    one, two = (fit(*s) for s in sets)
    for _ in range(rounds):
        at = np.flatnonzero(free)
        if not len(at):
            break
        take = max(1, len(pool_a) // (4 * rounds))
        for teacher, x, learner, own in ((one, pool_a, 1, pool_b), (two, pool_b, 0, pool_a)):
            z = teacher.log_odds(x[at])
            limit = np.log(confident / (1 - confident))
            good, bad = at[np.argsort(-z, kind="stable")], at[np.argsort(z, kind="stable")]
            n_good = max(1, int(round(take * y.mean())))
            good = good[: min(n_good, int((z > limit).sum()))]
            bad = bad[: min(max(1, take - n_good), int((z < -limit).sum()))]
            x0, y0 = sets[learner]
            sets[learner] = (np.concatenate([x0, own[good], own[bad]]), np.concatenate([y0, np.ones(len(good)), np.zeros(len(bad))]))
            free[good] = free[bad] = False
        one, two = (fit(*s) for s in sets)
    return one, two


def train(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "quality",
          source: str = "source", lang: str = "lang", rounds: int = ROUNDS, max_docs: int = MAX_DOCS,
          max_pool: int = MAX_POOL) -> Model | Constant:
    ship_library(docs.sparkSession)
    packed = docs.select(F.col(row_id).alias("k"), F.struct(
        F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang")).alias("p"))
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    y = (labels.select(F.col(row_id).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
         .groupBy("k").agg(F.max("y").alias("y")))
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Constant(float(sizes.get(1, 0) > 0))
    share = F.when(F.col("y") == 1, min(1.0, max_docs / sizes[1])).otherwise(min(1.0, max_docs / sizes[0]))
    chosen = y.where(draw < share)                       # bounded: about 2 max_docs rows
    columns = ["y", draw.alias("draw"), "p.text", "p.source", "p.lang"]
    yl, a, b = _vectors(packed.join(F.broadcast(chosen), "k").select(*columns))
    total = docs.count()
    pool = packed.where(draw < min(1.0, max_pool / max(1, total))).join(y, "k", "left_anti").withColumn("y", F.lit(-1))
    _, pool_a, pool_b = _vectors(pool.select(*columns))
    if len(np.unique(yl)) < 2:
        return Constant(sizes[1] / (sizes[0] + sizes[1]))
    # every fifth labelled row is kept for calibration
    held = np.arange(len(yl)) % 5 == 0
    if len(np.unique(yl[held])) < 2 or len(np.unique(yl[~held])) < 2:
        held = np.zeros(len(yl), bool)
    cal = held if held.any() else ~held
    one, two = co_train(yl[~held], a[~held], b[~held], pool_a, pool_b, rounds, CONFIDENT)
    weight = np.where(yl == 1, sizes[1] / max(1, (yl == 1).sum()), sizes[0] / max(1, (yl == 0).sum()))[cal]
    weight = weight / weight.mean()
    for view, x in ((one, a), (two, b)):
        view.curve = fit_logistic(view.log_odds(x[cal])[:, None], yl[cal], weight)
    mix = fit_logistic(np.column_stack([one.log_odds(a[cal]), two.log_odds(b[cal])]), yl[cal], weight)
    return Model(one, two, mix)


def score(docs: DataFrame, model: Model | Constant, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``docs`` plus score (0 to 1, higher: good likelier) and predicted."""
    ship_library(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(t: pa.Array, s: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(t, s, g), pa.float64())

    return (docs.withColumn("score", run(*(F.col(c).cast("string") for c in (text, source, lang))))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
