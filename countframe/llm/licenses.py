"""License scans (operator 7), DataFrame functions only.

Every line of a text, and the whole text, is normalised (ASCII lower case,
words of letters and digits of any script) and compared with licence
templates by the Dice coefficient over distinct word bigrams,
2 |A and B| / (|A| + |B|).  Size bounds prune first: a Dice coefficient of at
least t needs |B| between t / (2 - t) |A| and (2 - t) / t |A|; w words with d
distinct ones have between d - 1 and w - 1 distinct bigrams, so lines out of
reach are never cut into bigrams.  Row-local: nothing shuffles; the templates are literals
(a fixed list, bounded by ``MAX_TEMPLATES``).

Cases: null and empty texts match nothing.  A line of one word has no
bigrams and matches nothing; repeated lines and rows each match.  Equal
coefficients go to the first template by name.  Extra columns pass through;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75
MAX_TEMPLATES = 2_000

# The customary short notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All rights reserved": "All rights reserved. No part of this work may be reproduced without permission.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def bigrams(w: Column) -> Column:
    """Distinct neighbouring word pairs."""
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return F.array_distinct(pairs)


def template_table(spark, templates: dict[str, str]) -> list[tuple[str, list[str]]]:
    """(name, bigrams) of the templates, by the same normalisation."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates: scan in several passes")
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    got = rows.select("name", bigrams(words(F.col("text"))).alias("b")).where("size(b) > 0").orderBy("name").collect()
    return [(r["name"], list(r["b"])) for r in got]


def matches(line: Column, table: list[tuple[str, list[str]]], threshold: float) -> Column:
    """array<struct<license, dice>> of the templates that a line matches."""
    low = min(len(b) for _, b in table) * threshold / (2 - threshold)
    high = max(len(b) for _, b in table) * (2 - threshold) / threshold
    literal = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("b")) for n, b in table])

    def compare(b):
        fit = F.filter(literal, lambda t: (F.size(t["b"]) * threshold <= F.size(b) * (2 - threshold))
                       & (F.size(b) * threshold <= F.size(t["b"]) * (2 - threshold)))
        dice = F.transform(fit, lambda t: F.struct(t["license"].alias("license"), (
            F.size(F.array_intersect(b, t["b"])) * 2.0 / (F.size(b) + F.size(t["b"]))).alias("dice")))
        return F.filter(dice, lambda m: m["dice"] >= threshold)

    # words before bigrams: w words have at most w - 1 distinct bigrams, and d
    # distinct words at least d - 1
    def of_words(w):
        return F.when((F.size(w) - 1 >= low) & (F.size(F.array_distinct(w)) - 1 <= high),
                      F.flatten(F.transform(F.array(bigrams(w)), compare)))

    # a word has at least one character: lines out of reach are not split at all
    short = F.length(line) >= 2 * low
    return F.when(short, F.flatten(F.transform(F.array(words(line)), of_words)))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus licenses (array<struct<license, dice, line>>; line -1 is
    the whole text), n_matches, license (the best, null if none) and dice."""
    table = template_table(docs.sparkSession, templates or TEMPLATES)
    body = F.col(f"`{text}`").cast("string")
    none = F.array().cast("array<struct<license:string,dice:double>>")
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(body))).otherwise(lines)
    found = F.flatten(F.transform(units, lambda u, i: F.transform(
        F.coalesce(matches(u, table, threshold), none),
        lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice"),
                           F.when((i == F.size(lines)), -1).otherwise(i).alias("line")))))
    out = docs.withColumn("licenses", found)
    best = F.array_sort(F.transform("licenses", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("n"))))
    return (out.withColumn("n_matches", F.size("licenses").cast("bigint"))
            .withColumn("license", F.get(best, F.lit(0))["n"]).withColumn("dice", -F.get(best, F.lit(0))["d"]))
