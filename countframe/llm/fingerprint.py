"""Document fingerprints (operator 10): one-permutation MinHash.

Every 5-word shingle is hashed once; the top bits choose a bin and each bin
keeps its smallest hash.  Empty bins are filled by optimal densification:
an empty bin borrows from bins named by a fixed 2-universal sequence of
(bin, attempt) until one was filled originally.  The low ``bits`` of each
bin are packed into the stored fingerprint (hex); the likeness of two
fingerprints corrects the matches expected by chance, 2^-bits.

Cases: a text without words (null, empty, blanks) has the empty fingerprint;
two of these are alike with 1, one of these and another text with 0.  Fewer
than five words make one shingle.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.session import ship_library

BINS = 256
BITS = 8
SHINGLE = 5
MAX_TRIES = 1 << 13
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(rows: int, row: np.ndarray, h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(rows x bins) smallest hash of each bin; all ones where none fell."""
    out = np.full(rows * bins, _EMPTY)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    np.minimum.at(out, row * bins + (h >> shift).astype(np.int64), h)
    return out.reshape(rows, bins)


def lender(bins: int, tries: np.ndarray, attempt: int) -> np.ndarray:
    """Which bin each of ``tries`` asks at this attempt."""
    key = tries.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key += np.uint64(attempt * 0xD1B54A32D192ED03 % (1 << 64))
    return (ta.mix64(key) >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has a filled one."""
    out, bins = minima.copy(), minima.shape[1]
    filled = minima != _EMPTY
    row, at = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for attempt in range(1, MAX_TRIES + 1):
        if not len(row):
            return out
        ask = lender(bins, at, attempt)
        got = filled[row, ask]
        out[row[got], at[got]] = minima[row[got], ask[got]]
        row, at = row[~got], at[~got]
    first = filled.argmax(axis=1)                # not reached in practice: the first filled bin
    out[row, at] = minima[row, first[row]]
    return out


class Sketches:
    """Fingerprints of a list of texts: low bits (n x bins) and which are empty."""

    def __init__(self, column, bins: int = BINS, bits: int = BITS):
        self.bits = bits
        low, some = [], []
        for block in ta.blocks(column):
            row, h = ta.shingles(ta.Words(block, ta.NON_SPACE), SHINGLE)
            minima = bin_minima(block.n, row, h, bins)
            some.append((minima != _EMPTY).any(axis=1))
            low.append((densify(minima) & np.uint64((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16))
        self.low = np.concatenate(low) if low else np.zeros((0, bins), np.uint8)
        self.some = np.concatenate(some) if some else np.zeros(0, bool)

    def hex(self) -> list[str]:
        return [pack(v, self.bits) if s else "" for v, s in zip(self.low, self.some)]


def pack(low: np.ndarray, bits: int = BITS) -> str:
    """Hex of the bins' low bits, packed one after another."""
    planes = (low[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(planes.astype(np.uint8)).tobytes().hex()


def unpack(packed: str, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(bytes.fromhex(packed), np.uint8))[:bins * bits].reshape(bins, bits)
    return planes.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: np.ndarray, b: np.ndarray, a_some: np.ndarray, b_some: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows of low bits, corrected for chance."""
    chance = 2.0 ** -bits
    alike = np.clip(((a == b).mean(axis=1) - chance) / (1.0 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, alike, np.where(a_some | b_some, 0.0, 1.0))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint",
                bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` plus the packed fingerprint of each text."""
    ship_library(docs.sparkSession)

    @F.arrow_udf("string")
    def sketch(column: pa.Array) -> pa.Array:
        return pa.array(Sketches(column, bins, bits).hex(), pa.string())

    return docs.withColumn(out, sketch(F.col(text).cast("string")))


def packed_likeness(a: str, b: str, bins: int = BINS, bits: int = BITS):
    """Column: the likeness of two fingerprint columns."""

    @F.arrow_udf("double")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist()):
            u, v = (unpack(z, bins, bits)[None] if z else np.zeros((1, bins), np.int64) for z in (p, q))
            out.append(float(likeness(u, v, np.array([bool(p)]), np.array([bool(q)]), bits)[0]))
        return pa.array(out, pa.float64())

    return alike(F.col(a), F.col(b))


# each document beside the next one ------------------------------------------
def with_next(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, text, part, tail) in which, within a part, the row after a
    document is the next one by descending id (null ids last, then by text;
    after the last: the first).  The ids are cut into ranges at approximate
    quantiles; a range's first row is also sent, as its tail, to the range
    before it.  One shuffle of the texts; the driver sees one id per range."""
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted(set(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts))), float)

    def part_of(ids: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        v = ids.fill_null(0).to_numpy().astype(float)
        return np.where(known, len(cuts) - np.searchsorted(cuts, v, "right"), len(cuts) + 1)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids), pa.int32())

    firsts = {r["part"]: r["id"] for r in
              rows.select("id").groupBy(part("id").alias("part")).agg(F.max("id").alias("id")).collect()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        return pa.array([[int(p), before[int(p)]] if firsts[int(p)] == i else [int(p)]
                         for i, p in zip(ids.to_pylist(), part_of(ids))], pa.list_(pa.int32()))

    return (rows.select("id", "text", F.posexplode(places("id")).alias("tail", "part"))
            .repartition(parts, "part")
            .sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), "text"))


def edited(own: str, following: str) -> str:
    """``own`` with its last floor(n / 2) characters replaced by the first as
    many of ``following`` (or all, if it has fewer)."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


def compare_with_next(docs: DataFrame, row_id: str = "doc_id", text: str = "text",
                      bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the
    likeness of its fingerprint to the edited text's and the next document's."""
    ship_library(docs.sparkSession)

    def report(ids, texts, parts, tails):
        """Rows of all but the last of the given consecutive rows."""
        own = Sketches(pa.array(texts, pa.large_string()), bins, bits)
        take = [i for i in range(len(ids) - 1) if not tails[i] and parts[i] == parts[i + 1]]
        if not take:
            return None
        new = [edited(texts[i], texts[i + 1]) for i in take]
        changed = Sketches(pa.array(new, pa.large_string()), bins, bits)
        at = np.array(take)
        names = own.hex()
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in take], pa.int64()), pa.array([len(texts[i]) for i in take], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array([names[i] for i in take], pa.string()), pa.array(changed.hex(), pa.string()),
            pa.array(likeness(own.low[at], changed.low, own.some[at], changed.some, bits), pa.float64()),
            pa.array(likeness(own.low[at], own.low[at + 1], own.some[at], own.some[at + 1], bits), pa.float64()),
        ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held: list[list] = [[], [], [], []]
        for batch in batches:
            ids, parts, tails = (batch.column(c).to_pylist() for c in ("id", "part", "tail"))
            for block in ta.blocks(batch.column("text")):
                stop = block.first + block.n
                held[0] += ids[block.first:stop]
                held[1] += [block.text(r).decode() for r in range(block.n)]
                held[2] += parts[block.first:stop]
                held[3] += tails[block.first:stop]
                if (out := report(*held)) is not None:
                    yield out
                held = [x[-1:] for x in held]

    return with_next(docs, row_id, text).mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
