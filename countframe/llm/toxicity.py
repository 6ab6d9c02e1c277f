"""Toxicity (operator 2): a subsequence string-kernel SVM with Nystroem
landmarks.

Instances are the tokens of a text (letters, digits and bytes of other
scripts; punctuation inside a token and the blanks in runs of single letters
are dropped, so ``i d i o t`` and ``id*iot`` are one token).  Two tokens are
compared by the normalised gap-weighted count of common 3-symbol
subsequences (decay per covered position, span at most ``SPAN``), which
tolerates gaps and inserted characters.  Landmark tokens span the Nystroem
feature map K_mm^-1/2 k(x, landmarks); a linear SVM (squared hinge, Newton
steps) separates tokens typical of toxic labelled texts from the others, and
a logistic curve turns a text's strongest token decisions into a score.

Learning uses a bounded sample of labelled rows (``max_docs`` of each class,
chosen by a hash of the id) and of their tokens (``max_tokens``); the model
(``landmarks`` x at most 32 768 subsequences) is broadcast.  Scoring is
row-local over whole texts; tokens longer than 24 symbols are scored in
overlapping pieces, equal tokens once per block.

Cases: null and empty texts are scored as texts without tokens.  Labels that
repeat a document count as toxic if one of them says so; null labels are not
learned from.  Without both classes every text scores the share of toxic
labels (0 without labels).  Extra columns pass through; input columns named
like an output column are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.session import cut_lineage, ship_library

DECAY = 0.6
SPAN = 8                 # longest stretch a 3-symbol subsequence may cover
PIECE, STRIDE = 24, 12   # long tokens are scored in pieces
LANDMARKS = 160
MAX_DOCS = 6_000         # labelled texts learned from, per class
MAX_TOKENS = 6_000       # distinct tokens learned from, per class
CHANCE = 0.05            # chance tokens expected among those called toxic
_CACHE = 1 << 20         # remembered token decisions per worker

# symbols: a-z 1..26, digits 27, bytes of other scripts 28..31, 0 = dropped
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28 + np.arange(128) % 4


# tokens ----------------------------------------------------------------------
class Tokens:
    """Tokens of a block: symbols ``sym``, token t = sym[first[t]:first[t + 1]],
    its row and its hash."""

    def __init__(self, block: ta.Block):
        words = ta.Words(block, ta.NON_SPACE, lower=False)
        value = _SYMBOL[block.data]
        at = np.flatnonzero(value)
        word = np.searchsorted(words.start, at, "right") - 1
        length = np.bincount(word, minlength=len(words.start))
        single = length == 1
        single_next = np.zeros(len(single), bool)
        single_next[:-1] = single[1:] & single[:-1] & (words.row[1:] == words.row[:-1])
        # join a single with the one before if a third single stands beside them
        before = np.concatenate([[False], single_next[:-1]]) if len(single) else single
        triple = single_next & before
        joined = before & (triple | np.concatenate([[False], triple[:-1]]) | np.concatenate([single_next[1:] & before[1:], [False]])
                           ) if len(single) else single
        token = np.cumsum(~joined) - 1 if len(single) else np.zeros(0, np.int64)
        owner = token[word] if len(word) else word
        new = np.ones(len(at), bool)
        new[1:] = owner[1:] != owner[:-1]
        self.sym = value[at]
        start = np.flatnonzero(new)
        self.first = np.append(start, len(at))
        self.row = words.row[word[start]] if len(start) else start
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(ta._BYTE[self.sym] * ta._powers(ta._P, len(at)), out=total[1:])
        h = (total[self.first[1:]] - total[self.first[:-1]]) * ta._powers(ta._P_INV, len(at) + 1)[self.first[:-1]]
        self.hash = ta.mix64(h ^ np.diff(self.first).astype(np.uint64))

    def symbols(self, t: int) -> bytes:
        return self.sym[self.first[t]:self.first[t + 1]].tobytes()


# the kernel --------------------------------------------------------------------
_STEPS = (DECAY ** np.arange(3, 11)).astype(np.float32)      # weight by span


@lru_cache(maxsize=PIECE + 1)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k with k - i < SPAN, and their weights."""
    got = [(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = np.array(got, np.int64).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def subsequences(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight): each row's distinct 3-symbol subsequences with
    their summed weights; ``sym`` is (tokens x length)."""
    n, length = sym.shape
    i, j, k, w = _triples(length)
    if not len(w) or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    s = sym.astype(np.int64)
    key = (np.arange(n)[:, None] << 15 | s[:, i] << 10 | s[:, j] << 5 | s[:, k]).ravel()
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(np.tile(w, n)[order], at)
    return key[at] >> 15, key[at] & 32767, total


class Model:
    """Landmarks, SVM and calibration; pickled to the tasks."""

    def __init__(self, landmarks: list[bytes]):
        self.lut = np.zeros(1 << 15, np.int32)
        rows, cols, vals = [], [], []
        for m, z in enumerate(landmarks):
            _, code, w = subsequences(np.frombuffer(z, np.uint8)[None])
            rows.append(code)
            cols.append(np.full(len(code), m))
            vals.append(w / np.sqrt((w * w).sum()))
        code, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        used = np.unique(code)
        self.lut[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        self.table[self.lut[code], col] = val
        k = self.kernel_of([np.frombuffer(z, np.uint8) for z in landmarks])
        value, vector = np.linalg.eigh((k + k.T) / 2)
        keep = value > 1e-4 * value.max()
        self.project = vector[:, keep] / np.sqrt(value[keep])       # K_mm^-1/2 in its eigenbasis
        self.weight = np.zeros(len(landmarks), np.float32)          # of the kernel values
        self.bias, self.curve = 0.0, np.zeros(5)

    def kernel(self, sym: np.ndarray) -> np.ndarray:
        """Normalised kernel of (tokens x length) with every landmark."""
        out = np.zeros((len(sym), self.table.shape[1]), np.float32)
        row, code, w = subsequences(sym)
        if not len(row):
            return out
        norm = np.sqrt(np.bincount(row, w.astype(float) ** 2, len(sym)))
        ids = self.lut[code]
        hit = np.flatnonzero(ids)
        if len(hit):
            row = row[hit]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[at]] = np.add.reduceat(self.table[ids[hit]] * w[hit, None], at, axis=0)
            out /= np.maximum(norm, 1e-12)[:, None]
        return out

    def decide(self, sym: np.ndarray) -> np.ndarray:
        """kernel(sym) @ weight + bias without the kernel rows: the weights are
        summed per subsequence once (``value``), rows are sorted in place for
        their norms."""
        n, length = sym.shape
        i, j, k, w = _triples(length)
        if not len(w):
            return np.full(n, self.bias, np.float32)
        s = sym.astype(np.int32)
        key = (s[:, i] << 10 | s[:, j] << 5 | s[:, k]) << 3 | (k - i - 2).astype(np.int32)
        key.sort(axis=1)
        weight = _STEPS[key & 7]
        code = key >> 3
        top = (self.value[code] * weight).sum(axis=1)
        new = np.ones(key.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(weight.ravel(), at)
        norm = np.add.reduceat(total * total, np.cumsum(new.sum(axis=1)) - new.sum(axis=1))
        return (top / np.sqrt(norm) + np.float32(self.bias)).astype(np.float32)

    def kernel_of(self, tokens: list[np.ndarray]) -> np.ndarray:
        """Kernel rows of tokens of any length (at most PIECE symbols)."""
        out = np.zeros((len(tokens), self.table.shape[1]), np.float32)
        size = np.array([len(t) for t in tokens])
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            out[at] = self.kernel(np.stack([tokens[i] for i in at]))
        return out

    def decisions(self, tokens: Tokens) -> np.ndarray:
        """SVM decision of every token of a block (equal tokens once)."""
        h, index, back = np.unique(tokens.hash, return_index=True, return_inverse=True)
        if "cache" not in self.__dict__:
            self.value = (self.table @ self.weight)[self.lut]
            self.cache = (np.zeros(_CACHE, np.uint64), np.zeros(_CACHE, np.float32))
        keys, vals = self.cache
        slot = (h >> np.uint64(44)).astype(np.int64)
        known = keys[slot] == h
        score = np.where(known, vals[slot], np.float32(self.bias)).astype(np.float32)
        todo = np.flatnonzero(~known)
        start, size = tokens.first[index[todo]], np.diff(tokens.first)[index[todo]]
        piece_of = [todo[size <= PIECE]]
        begin, span = [start[size <= PIECE]], [size[size <= PIECE]]
        for t, s, n in zip(todo[size > PIECE], start[size > PIECE], size[size > PIECE]):
            b = np.append(np.arange(0, n - PIECE, STRIDE), n - PIECE)
            piece_of.append(np.full(len(b), t))
            begin.append(s + b)
            span.append(np.full(len(b), PIECE))
        piece_of, begin, span = np.concatenate(piece_of), np.concatenate(begin), np.concatenate(span)
        score[todo] = -np.inf
        for length in np.unique(span):
            at = np.flatnonzero(span == length)
            for part in np.array_split(at, -(-len(at) // 2048)):
                sym = tokens.sym[begin[part][:, None] + np.arange(length)]
                np.maximum.at(score, piece_of[part], self.decide(sym))
        keys[slot[todo]], vals[slot[todo]] = h[todo], score[todo]
        return score[back]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "value")}

    def features(self, column) -> np.ndarray:
        """Per text: strongest token decision, second strongest, log of 1 +
        the number of tokens on the toxic side, log of 1 + all tokens."""
        out = np.tile(np.array([self.bias, self.bias, 0.0, 0.0]), (len(column), 1))
        for block in ta.blocks(column):
            tokens = Tokens(block)
            if not len(tokens.row):
                continue
            f = self.decisions(tokens)
            order = np.lexsort((-f, tokens.row))
            row, f = tokens.row[order], f[order]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            own = row[at]
            out[block.first + own, 0] = f[at]
            two = np.flatnonzero(np.append(at[1:], len(row)) - at > 1)
            out[block.first + own[two], 1] = f[at[two] + 1]
            out[block.first + own, 2] = np.log1p(np.add.reduceat(f > 0, at, dtype=np.int64))
            out[block.first + own, 3] = np.log1p(np.diff(np.append(at, len(row))))
        return out

    def scores(self, column) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.features(column) @ self.curve[:-1] + self.curve[-1], -30, 30)))


class Constant:
    """Without two classes: one score for all."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, column) -> np.ndarray:
        return np.full(len(column), self.share)


# learning ------------------------------------------------------------------------
def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Linear SVM, squared hinge, by Newton steps on the active rows; the last
    entry of the result is the bias.  y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; bias last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, row_id: str, label: str,
                    max_docs: int) -> tuple[DataFrame, dict[int, int]]:
    """(y, text) of about ``max_docs`` labelled documents per class (all of a
    smaller class), and the classes' sizes."""
    y = (labels.select(F.col(row_id).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
         .groupBy("k").agg(F.max("y").alias("y")))
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, max_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_docs / max(1, sizes.get(0, 0))))
    chosen = y.where(draw < share)              # bounded: about 2 max_docs rows
    texts = docs.select(F.col(row_id).alias("k"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "k").select("y", "text"), sizes


def train(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "toxic",
          max_docs: int = MAX_DOCS, max_tokens: int = MAX_TOKENS, landmarks: int = LANDMARKS) -> Model | Constant:
    spark = docs.sparkSession
    ship_library(spark)
    sample, sizes = labelled_sample(docs, labels, text, row_id, label, max_docs)
    if not (sizes.get(0) and sizes.get(1)):
        return Constant(float(sizes.get(1, 0) > 0))

    def contexts(batches):
        """(token, hash of its two neighbours, class), once per text block."""
        for batch in batches:
            y = np.array(batch.column("y").to_pylist(), np.int64)
            for block in ta.blocks(batch.column("text")):
                tokens = Tokens(block)
                n = len(tokens.row)
                same = tokens.row[1:] == tokens.row[:-1]
                beside = np.zeros(n, np.uint64)
                beside[1:] += np.where(same, tokens.hash[:-1], np.uint64(0)) * np.uint64(ta._Q)
                beside[:-1] += np.where(same, tokens.hash[1:], np.uint64(0))
                own = y[block.first:block.first + block.n][tokens.row]
                size = np.diff(tokens.first)
                _, one = np.unique(ta.mix64(beside) ^ tokens.hash ^ own.astype(np.uint64), return_index=True)
                one = one[(size[one] >= 3) & (size[one] <= PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens.symbols(t) for t in one], pa.binary()), pa.array(beside[one].view(np.int64)),
                     pa.array(own[one])], ["token", "beside", "y"])

    # a token counts once per distinct context, so that the many copies of one
    # toxic text do not make its ordinary words look typical
    tokens = (sample.mapInArrow(contexts, "token binary, beside bigint, y bigint")
              .groupBy("token", "beside").agg(F.max(1 - F.col("y")).alias("neg"), F.max("y").alias("pos"))
              .groupBy("token").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    tokens = cut_lineage(tokens)
    total = tokens.agg(F.sum("neg"), F.sum("pos"), F.count(F.lit(1))).first()
    share = min(max((total[1] or 0) / max(1, (total[0] or 0) + (total[1] or 0)), 1e-9), 1 - 1e-9)
    # evidence: log likelihood ratio of the token's own share of toxic contexts
    # against the share over all tokens; Bonferroni keeps chance tokens out
    n = F.col("pos") + F.col("neg")
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * q))).otherwise(0.0)
    tokens = (tokens.withColumn("odds", F.log((F.col("pos") + 0.5) / share) - F.log((F.col("neg") + 0.5) / (1 - share)))
              .withColumn("sure", part("pos", share) + part("neg", 1 - share)))
    # bounded: the tokens most typical of toxic texts, and a hashed choice of the others
    toxic = tokens.where("pos >= 2 AND odds > 1.0").orderBy(F.desc("sure"), "token").limit(max_tokens).collect()
    plain = tokens.where("odds < 0.5").orderBy(F.xxhash64("token"), "token").limit(max_tokens).collect()
    strong = [r for r in toxic if r["sure"] > np.log(max(1, total[2]) / CHANCE)]
    if not strong:
        strong = toxic[:1] or plain[:1]
    if not strong:
        return Constant(sizes[1] / (sizes[0] + sizes[1]))
    # landmarks: spread over the toxic tokens, and some ordinary ones
    take = np.unique(np.linspace(0, len(strong) - 1, 3 * landmarks // 4).astype(int))
    chosen = [bytes(strong[i]["token"]) for i in take] + [bytes(r["token"]) for r in plain[:landmarks // 4]]
    model = Model(list(dict.fromkeys(chosen)))
    learn = {bytes(r["token"]): (1.0, r["pos"]) for r in strong}
    learn |= {bytes(r["token"]): (-1.0, r["neg"] + 1) for r in plain if bytes(r["token"]) not in learn}
    x = model.kernel_of([np.frombuffer(t, np.uint8) for t in learn]) @ model.project
    y = np.array([v[0] for v in learn.values()])
    cost = np.log1p(np.array([v[1] for v in learn.values()], float))
    for side in (-1.0, 1.0):
        cost[y == side] *= 20.0 * len(y) / max(1e-9, 2 * cost[y == side].sum())
    w = fit_svm(x, y, cost)
    model.weight = (model.project @ w[:-1]).astype(np.float32)
    model.bias = float(w[-1])

    shared = spark.sparkContext.broadcast(model)

    def describe(batches):
        for batch in batches:
            f = shared.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32())] + [pa.array(c, pa.float64()) for c in f.T],
                                             ["y", "a", "b", "c", "d"])

    got = sample.mapInArrow(describe, "y int, a double, b double, c double, d double").toArrow()
    y = got["y"].to_numpy().astype(float)
    x = np.stack([got[c].to_numpy() for c in ("a", "b", "c", "d")], axis=1)
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    model.curve = fit_logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model | Constant, text: str = "text") -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 if score >= 0.5)."""
    ship_library(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(column), pa.float64())

    return (docs.withColumn("score", run(F.col(text).cast("string")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
