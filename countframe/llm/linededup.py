"""Line dedup by winnowing (operator 5), DataFrame functions only.

A text is cut into units: lines, and sentences inside a line, in scripts with
other full stops too; short ones come in groups that depend on their content
(``with_units``).  Joining all units gives the text back.  Units are compared
without the white space around lines and sentences.  A run of units with at
least ``min_chars`` characters that also starts at an earlier place (by
document, then position; in any document, or in the same one) is a repeat and
deleted; the first occurrence of every run stays.

1.  Windows are the shortest runs of at least ``min_chars`` characters from
    every unit on, and up to every unit.  A run of that many characters, where
    it ends or differs around, is all such windows inside it.
2.  Winnowing: a window's fingerprint is the least hash of its units.  Equal
    windows have equal fingerprints, so only windows whose fingerprint occurs
    twice among the selected units go on.  A unit is selected if it is not
    larger than one of its neighbours, or a window by itself: that holds for
    every window's least unit.
3.  Positions of a fingerprint are joined by the window around it: every
    occurrence meets the first occurrence of an equal window.  Windows that
    occurred before and overlap or touch are united, which extends a match
    both ways as far as any earlier text goes along with it, whichever
    document that is; the united runs are deleted.

The result is exact.  Windows are compared by 128 bits: their fingerprint and
a hash of all their units.

Scale: selected units are counted with partial aggregation, so a hot line is
one row a task; windows meet the repeated fingerprints and their first
occurrences in joins that can be split.  No pairs are made.  Documents get
numbers in the order of their ids by a range sort of narrow rows (at most
2^24 documents in each of 32 767 ranges, 2^24 units a text), so a place is
one long.  Texts move once, to meet their deletions.

Cases: null texts stay null, empty texts empty; a text that loses all but
white space is ``emptied``.  Ids can be null (last) and of any type with an
order; documents of one id are ordered by 128 bits of their text, and rows
equal in id and text are one document and get the same result.  Equal runs
inside one document are later repeats as well.  An empty table gives an empty
one.  Extra columns pass through; input columns named like an output are
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countframe.session import cut_lineage

MIN_CHARS = 160          # shortest run that is deleted, about 25 words
# A unit ends after a newline, after a full stop and a space, and in scripts that
# put no space there after full stops and a mark that closes a quotation or bracket.
STOPS, OTHER_STOPS = ".!?", "…।॥۔؟։"
_CJK, _CLOSERS = "。！？｡።។", "”’」』）》】"
_NO_SPACE = rf"[{_CJK}](?: |[{_CLOSERS}]?(?=[^\s{_CJK}{_CLOSERS}]))"
UNIT_END = rf"(?<=\n)|(?<=[{STOPS}{OTHER_STOPS}{_CJK}] )|(?<=[{_CJK}]|[{_CJK}][{_CLOSERS}])(?=[^\s{_CJK}{_CLOSERS}])"
_MARK = "\ue000"         # private use: a text that holds it is cut by UNIT_END itself
BLANKS = " \t\n\r\x0b\x0c"
SHORT, AHEAD = 24, 7     # pieces of fewer characters are grouped, about eight to a unit


def pieces(text: Column) -> Column:
    """The text cut after every end.  Marks are put in by plain replacements,
    which take a tenth of the time of a pattern; a pattern is for rare texts."""
    def marked(ends):
        return reduce(lambda t, end: F.replace(t, F.lit(end), F.lit(end + _MARK)), ends, text)

    ascii_ends = ["\n", *(c + " " for c in STOPS)]
    every = marked([*ascii_ends, *(c + " " for c in OTHER_STOPS)])
    no_space = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in _CJK])
    cut = (F.when(F.octet_length(text) == F.length(text), F.split(marked(ascii_ends), _MARK))
           .when(F.contains(text, F.lit(_MARK)), F.split(text, UNIT_END))
           .when(no_space, F.split(F.regexp_replace(every, _NO_SPACE, "$0" + _MARK), _MARK))
           .otherwise(F.split(every, _MARK)))
    return F.array_remove(cut, "")


def with_units(frame: DataFrame, text: str) -> DataFrame:
    """``frame`` plus u, the units of column ``text``, and b, what is compared
    of them: their pieces without white space around, joined by a space.

    A piece ends a unit if it or the next one has ``SHORT`` characters, or if
    its hash is not larger than those of the next ``AHEAD`` pieces; the last
    one does.  So short lines and sentences come in groups that depend on
    their content only, as in content-defined chunking, and long ones are
    units; blank ones go to the next unit."""
    cut = frame.withColumn("__p", pieces(F.col(text))).withColumn("__t", F.transform("__p", lambda u: F.btrim(u, F.lit(BLANKS))))
    cut = cut.withColumn("__h", F.when(F.exists("__t", lambda x: F.length(x) < SHORT), F.transform("__t", lambda x: F.xxhash64(x))))
    place = F.sequence(F.lit(0), F.size("__p") - 1)
    long = lambda i: F.coalesce(F.length(F.get("__t", i)) >= SHORT, F.lit(True))
    least = lambda i: F.get("__h", i) <= F.array_min(F.slice("__h", i + 2, AHEAD))
    ends = F.filter(place, lambda i: long(i) | (i == F.size("__p") - 1) | ((F.get("__t", i) != "") & (long(i + 1) | least(i))))
    cut = cut.withColumn("__e", F.when(F.col("__h").isNotNull(), ends))

    def group(column, join):
        start = lambda j: F.when(j == 0, 0).otherwise(F.get("__e", j - 1) + 1)
        return F.transform("__e", lambda e, j: join(F.slice(column, start(j) + 1, e - start(j) + 1)))

    cut = cut.withColumn("u", F.when(F.col("__e").isNull(), F.col("__p")).otherwise(group("__p", lambda x: F.array_join(x, ""))))
    cut = cut.withColumn("b", F.when(F.col("__e").isNull(), F.col("__t")).otherwise(group("__t", lambda x: F.array_join(F.array_remove(x, ""), " "))))
    return cut.drop("__p", "__t", "__h", "__e")


# documents and places -----------------------------------------------------------------
_ROW_BITS, _UNIT_BITS, _MAX_RANGES = 24, 24, (1 << 15) - 1
_RANGE_ROWS = 4_000_000
_NAME = ["__cf_id", "__cf_t1", "__cf_t2"]


def _names(row_id: Column, text: Column) -> list[Column]:
    return [row_id.alias(_NAME[0]), F.xxhash64(text).alias(_NAME[1]), F.xxhash64(F.lit(1), text).alias(_NAME[2])]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in _NAME])


def numbered(names: DataFrame) -> DataFrame:
    """Distinct names with ``base``, a long that orders them and leaves room
    for positions below, and ``copies``."""
    spark = names.sparkSession
    distinct = cut_lineage(names.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("copies")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // _RANGE_ROWS))
    if ranges > _MAX_RANGES:
        raise ValueError(f"{ranges} ranges of documents: more than {_MAX_RANGES}")
    order = [F.col(_NAME[0]).asc_nulls_last(), *_NAME[1:]]
    n = F.monotonically_increasing_id()           # range << 33 | row
    base = F.shiftright(n, 33) * F.lit(1 << (_ROW_BITS + _UNIT_BITS)) + n.bitwiseAND(F.lit((1 << 33) - 1)) * F.lit(1 << _UNIT_BITS)
    return cut_lineage(distinct.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("base", base))


def _base(place: Column) -> Column:
    return place.bitwiseAND(F.lit(~((1 << _UNIT_BITS) - 1)))


def _position(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _UNIT_BITS) - 1)).cast("int")


# windows ------------------------------------------------------------------------------
_UNROLLED = 4            # units of a window read one by one: enough in prose, and small enough to be compiled


def _windows(doc: DataFrame, need: int, step: int) -> DataFrame:
    """(f, g, place, n): fingerprint, hash, first unit and length of the
    windows from every unit on (step 1), and of those up to every unit (step
    -1) that are not also windows of the first kind."""
    unit = doc.select("base", "h", "bare", F.posexplode("h").alias("pos", "x"))
    near = unit.select("base", "h", "bare", "pos", *[F.get(c, F.col("pos") + step * j).alias(f"{c}{j}") for c in ("bare", "h") for j in range(_UNROLLED)])
    total, few, inner = F.col("bare0"), F.when(F.col("bare0") >= need, 1), F.when(F.col("bare0") >= need, 0)
    for j in range(1, _UNROLLED):
        total = total + F.col(f"bare{j}")
        few, inner = few.when(total >= need, j + 1), inner.when(total >= need, total - F.col("bare0"))
    near = near.withColumn("n", few)
    short = near.where("n IS NOT NULL")
    if step < 0:
        short = short.where(inner >= need)
    own = [F.col(f"h{j}") for j in range(_UNROLLED)]
    hashed = [F.xxhash64(*own[:n][::step]) for n in range(1, _UNROLLED + 1)]
    least = F.least(own[0], F.lit((1 << 63) - 1), *[F.when(F.col("n") > j, own[j]) for j in range(1, _UNROLLED)])
    g = reduce(lambda c, n: c.when(F.col("n") == n, hashed[n - 1]), range(2, _UNROLLED), F.when(F.col("n") == 1, hashed[0])).otherwise(hashed[-1])
    start = F.col("base") + F.col("pos") - (F.col("n") - 1 if step < 0 else 0)
    short = short.select(least.alias("f"), g.alias("g"), start.alias("place"), "n")

    # Windows of more units, made inside the arrays: a lambda behind the generator
    # would copy a document's arrays for each of its units.
    long = doc.select("base", F.explode(F.filter(F.transform("h", lambda x, i: _long_window(i, need, step)), lambda w: w.isNotNull())).alias("w"))
    return short.unionByName(long.select("w.f", "w.g", (F.col("base") + F.col("w.first")).alias("place"), "w.n"))


def _long_window(i: Column, need: int, step: int) -> Column:
    """struct<f, g, first, n> of the window from unit i on (up to it) if it
    has more than _UNROLLED units; null otherwise."""
    # characters and units so far are one number, which costs a tenth of a struct;
    # every unit holds a character, so ``need`` are enough
    one, full = F.lit(1 << _UNIT_BITS).cast("bigint"), F.lit(need << _UNIT_BITS).cast("bigint")

    def reached(most):
        if step > 0:
            ahead = F.slice("bare", i + 1, most)
        else:
            low = F.greatest(i - (most - 1), F.lit(0))
            ahead = F.reverse(F.slice("bare", low + 1, i - low + 1))
        return F.aggregate(ahead, F.lit(0).cast("bigint"), lambda a, b: F.when(a < full, a + b * one + 1).otherwise(a), lambda a: F.when(a >= full, a))

    def bound(value, use):               # ``use`` of a value that is computed once
        return F.get(F.transform(F.array(value), use), 0)

    def made(total):
        n = _position(total)
        first = i if step > 0 else i - n + 1
        ends_right = F.lit(True) if step > 0 else F.shiftright(total, _UNIT_BITS) - F.get("bare", i) >= need
        window = bound(F.slice("h", first + 1, n), lambda own: F.struct(
            F.array_min(own).alias("f"), F.xxhash64(own).alias("g"), first.alias("first"), n.alias("n")))
        return F.when(total.isNotNull() & ends_right, window)

    few = reduce(Column.__add__, [F.get("bare", i + step * j) for j in range(_UNROLLED)])
    far = i + step * 4 * _UNROLLED
    more = (far < F.size("bare")) & (far >= 0)
    # null at the end of the text: no window of that many units
    return F.when(few < need, bound(F.coalesce(reached(4 * _UNROLLED), F.when(more, reached(need))), made))


def _once(frame: DataFrame, *values: Column) -> DataFrame:
    """``frame`` with more columns that are computed once, however often they
    are used: a generator is not merged with what follows."""
    made = frame.select("*", F.explode(F.array(F.struct(*values))).alias("__cf_v"))
    return made.select(*frame.columns, "__cf_v.*")


def _selected(doc: DataFrame, need: int) -> DataFrame:
    """(f): units that may be the least of a window."""
    unit = doc.select("h", "bare", F.posexplode("h").alias("pos", "f"))
    beside = lambda j: F.coalesce(F.col("f") <= F.get("h", F.col("pos") + j), F.lit(False))
    return unit.where(beside(-1) | beside(1) | (F.get("bare", F.col("pos")) >= need)).select("f")


def repeated_runs(docs: DataFrame, text: str = "text", row_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document with repeats, by its name: ``runs``, array<struct<s, e>>
    of first and last positions of units to delete."""
    need = max(1, min_chars)
    body = F.col(f"`{text}`").cast("string")
    rows = docs.where(F.length(body) >= need).select(*_names(F.col(f"`{row_id}`"), body), body.alias("t"))
    names = numbered(rows.select(*_NAME))
    own = with_units(rows, "t").select(*_NAME, F.array_remove("b", "").alias("b"))          # only a last unit can be blank
    own = own.select(*_NAME, F.transform("b", lambda u: F.xxhash64(u)).alias("h"), F.transform("b", F.length).alias("bare"))
    doc = own.join(names, _same(own, names)).select("base", "copies", "h", "bare")
    doc = cut_lineage(doc)
    if not names.where("copies > 1").isEmpty():                # rows equal in id and text become one
        doc = cut_lineage(doc.where("copies = 1").unionByName(doc.where("copies > 1").dropDuplicates(["base"])))

    twice = _selected(doc, need).groupBy("f").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("f")
    every = _windows(doc, need, 1).unionByName(_windows(doc, need, -1))
    window = cut_lineage(every.join(twice, "f", "left_semi"))
    first = window.groupBy("f", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = window.join(first.select("f", "g", "first"), ["f", "g"]).where("first < place")
    # in order of their starts, and so of their ends
    spans = F.array_sort(F.collect_list(F.struct(_position(F.col("place")).alias("s"), (_position(F.col("place")) + F.col("n") - 1).alias("e"))))
    met = found.groupBy(_base(F.col("place")).alias("base")).agg(spans.alias("w"))
    # unite those that overlap or touch
    apart = lambda a, b: a.isNull() | b.isNull() | (b["s"] > a["e"] + 1)
    opens = F.filter("w", lambda x, j: apart(F.get("w", j - 1), x))
    closes = F.filter("w", lambda x, j: apart(x, F.get("w", j + 1)))
    runs = met.select("base", F.zip_with(opens, closes, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e"))).alias("runs"))
    return cut_lineage(runs.join(names, "base").select(*_NAME, "runs"))


_RUNS = "array<struct<first:int,last:int,chars:bigint>>"


def dedup(docs: DataFrame, text: str = "text", row_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text after deletion, plus n_deleted (units),
    deleted_chars, runs (array<struct<first, last, chars>>: positions of
    units, and characters) and emptied (all of a non-empty text was deleted)."""
    added = ("n_deleted", "deleted_chars", "runs", "emptied")
    names = [c for c in docs.columns if c not in added]
    runs = repeated_runs(docs, text, row_id, min_chars)
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__cf_{i}") for i, c in enumerate(names) if c != text], body.alias("__cf_text"),
                       *_names(F.col(f"`{row_id}`"), body))
    met = rows.join(runs, _same(rows, runs), "left").drop(*[runs[c] for c in _NAME], *[rows[c] for c in _NAME])
    # cut again where something goes
    met = with_units(met.withColumn("__cf_cut", F.when(F.col("runs").isNotNull(), F.col("__cf_text"))), "__cf_cut").drop("b")
    joined = lambda a, b: F.array_join(F.slice("u", a + 1, b - a), "")
    left = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda j: joined(
        F.when(j == 0, 0).otherwise(F.get("runs", j - 1)["e"] + 1), F.when(j == F.size("runs"), F.size("u")).otherwise(F.get("runs", j)["s"])))
    kept = F.when(F.col("runs").isNull(), F.col("__cf_text")).otherwise(F.array_join(left, ""))
    told = F.transform("runs", lambda r: F.struct(r["s"].alias("first"), r["e"].alias("last"), F.length(joined(r["s"], r["e"] + 1)).cast("bigint").alias("chars")))
    units_gone = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + (r["e"] - r["s"] + 1).cast("bigint"))
    # a filter on the result must not be pushed into all this
    done = _once(met, kept.alias("kept"), F.coalesce(told, F.array().cast(_RUNS)).alias("told"), F.coalesce(units_gone, F.lit(0).cast("bigint")).alias("units_gone"))
    empty = F.coalesce(F.btrim("kept", F.lit(BLANKS)) == "", F.lit(False))
    return done.select(
        *[F.col("kept" if c == text else f"__cf_{i}").alias(c) for i, c in enumerate(names)], F.col("units_gone").alias("n_deleted"),
        F.coalesce(F.length("__cf_text") - F.length("kept"), F.lit(0)).cast("bigint").alias("deleted_chars"),
        F.col("told").alias("runs"), ((F.size("told") > 0) & empty).alias("emptied"))
