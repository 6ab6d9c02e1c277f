"""Language identification (operator 3): multinomial naive Bayes over hashed
character n-grams.

Training counts hashed 1-, 2- and 3-grams of lower-cased letters (every run
of other characters is one word boundary) per language, in Spark, over a
bounded sample of labelled rows: at most about ``max_docs`` texts of each
language, chosen by a hash of the row's id (languages below the bound use
all their rows).  The log-probability matrix (languages x 2^bits, a fixed
size per language) is broadcast and texts are scored row-locally in numpy
from their sparse n-gram lists.

Cases: a null text, or one without a letter, is ``und`` with score 0.  Rows
without a label or without id are never learned from.  With no labelled row
every text is ``und``.  Equal scores go to the alphabetically first language.
Repeated rows are scored alike.  Extra columns pass through; an input column
named like an output column is replaced by the output.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.session import ship_library

BITS = 16
ORDERS = (1, 2, 3)
MAX_DOCS = 20_000        # labelled texts learned from, per language
BLOCK_BYTES = 1 << 17    # of text whose n-grams are held at once; a longer text is held alone
SMOOTHING = 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(block: ta.Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, has_letter): the hashed n-grams of a block's texts; row
    r owns bucket[first[r]:first[r + 1]]."""
    texts = [block.text(r).decode().lower() for r in range(block.n)]
    codes = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le"), np.uint32)
    start = np.cumsum([0] + [len(t) + 1 for t in texts])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                     # the first non-letter after a letter: a boundary
    keep[start[:-1]] = True                     # and one before each text
    at = np.flatnonzero(keep)
    letter = letter[at]
    seq = np.where(letter, codes[at], np.uint32(32))
    row = np.repeat(np.arange(block.n, dtype=np.int32), np.diff(np.searchsorted(at, start)))
    sizes, buckets = np.zeros((len(ORDERS), block.n), np.int64), []
    for k, n in enumerate(ORDERS):
        size = max(0, len(seq) - n + 1)
        acc = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            acc = (acc ^ seq[j:j + size]) * np.uint32(0x01000193)
            acc ^= acc >> np.uint32(15)
        acc *= np.uint32(0x85EBCA6B)
        some = letter[:size].copy()             # at least one letter, none of it in another text
        for j in range(1, n):
            some |= letter[j:j + size]
        some &= row[:size] == row[n - 1:n - 1 + size]
        sizes[k] = np.bincount(row[:size][some], minlength=block.n)
        buckets.append((acc >> np.uint32(32 - bits))[some].astype(np.int32))
    first = np.concatenate([[0], np.cumsum(sizes.sum(axis=0))])
    bucket = np.empty(first[-1], np.int32)
    begin = first[:-1].copy()                   # of each row, where its n-grams of this order go
    for own, found in zip(sizes, buckets):
        bucket[np.arange(len(found)) + np.repeat(begin - (np.cumsum(own) - own), own)] = found
        begin += own
    return first, bucket, np.diff(first) > 0


class NaiveBayes:
    """Languages, their log priors and the log-probability matrix."""

    def __init__(self, languages: list[str], prior: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.prior = np.log(prior / prior.sum()) if len(languages) else prior
        total = counts.sum(axis=1, keepdims=True)
        self.log_p = np.log((counts + SMOOTHING) / (total + SMOOTHING * counts.shape[1]))

    def predict(self, column) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for block in ta.blocks(column, BLOCK_BYTES):
            first, bucket, some = grams(block, int(np.log2(self.log_p.shape[1])))
            best, score = np.full(block.n, -1), np.zeros(block.n)
            if self.languages and some.any():
                at = first[:-1][some]
                fit = np.stack([np.add.reduceat(p[bucket], at) + q for p, q in zip(self.log_p, self.prior)], axis=1)
                best[some] = fit.argmax(axis=1)
                fit -= fit.max(axis=1, keepdims=True)
                score[some] = 1.0 / np.exp(fit).sum(axis=1)
            langs += [self.languages[b] if b >= 0 else UNKNOWN for b in best]
            scores += score.tolist()
        return langs, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id",
          max_docs: int = MAX_DOCS, bits: int = BITS) -> NaiveBayes:
    """Learn from the labelled rows of ``docs``."""
    ship_library(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(row_id).cast("string").alias("id"),
                       F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND id IS NOT NULL")
    # the class list: one row per language
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    counts = np.zeros((len(languages), 1 << bits))
    if languages:
        share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs / sizes[k]))])
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

        def count(batches):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                names = batch.column(0).to_pylist()
                for block in ta.blocks(batch.column(1), BLOCK_BYTES):
                    first, bucket, _ = grams(block, bits)
                    own = np.array(names[block.first:block.first + block.n], object)
                    for name in set(own):
                        mine = np.repeat(own == name, np.diff(first))
                        sums.setdefault(name, np.zeros(1 << bits, np.int64))
                        sums[name] += np.bincount(bucket[mine], minlength=1 << bits)
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                    ["lang", "bucket", "n"])

        got = (sample.mapInArrow(count, "lang string, bucket int, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())   # at most languages x 2^bits rows
        index = {k: i for i, k in enumerate(languages)}
        at = np.array([index[k] for k in got["lang"].to_pylist()], np.int64)
        counts[at, got["bucket"].to_numpy()] = got["n"].to_numpy()
    return NaiveBayes(languages, np.array([sizes[k] for k in languages], float), counts)


def predict(docs: DataFrame, model: NaiveBayes, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (the posterior of that language)."""
    ship_library(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def score(column: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(column)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return (docs.withColumn("__cf_lang", score(F.col(text).cast("string")))
            .withColumn("lang_pred", F.col("__cf_lang.lang")).withColumn("score", F.col("__cf_lang.score"))
            .drop("__cf_lang"))


def remainder(row_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null without id)."""
    return F.crc32(F.col(row_id).cast("string").cast("binary")) % mod
