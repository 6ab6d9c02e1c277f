import regex
import xxhash
from pyspark.sql import functions as F

from countframe.llm import linededup as ld
from tests.llm.helpers import docs_frame, hostile_rows


def pieces(text):
    return [u for u in regex.split(ld.UNIT_END, text, flags=regex.V1) if u]


def digest(x):
    return (xxhash.xxh64_intdigest(x.encode(), seed=42) + (1 << 63)) % (1 << 64)           # in the order of signed longs


def units(text):
    """[(unit, what is compared of it)]."""
    parts = pieces(text)
    bare = [u.strip(ld.BLANKS) for u in parts]
    h = [digest(x) for x in bare]
    out, start = [], 0
    for i, x in enumerate(bare):
        if len(x) >= ld.SHORT or i + 1 == len(bare) or (x and (len(bare[i + 1]) >= ld.SHORT or all(h[i] <= y for y in h[i + 1:i + 1 + ld.AHEAD]))):
            out.append(("".join(parts[start:i + 1]), " ".join(y for y in bare[start:i + 1] if y)))
            start = i + 1
    return out


def exact(rows, min_chars=ld.MIN_CHARS):
    """Every run of units with min_chars characters that starts at an earlier
    place as well, compared unit by unit: {id: remaining text}.  Ids are unique."""
    docs = {i: units(t) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])) if t}
    bare = {i: [b for _, b in us if b] for i, us in docs.items()}
    at = {}
    for i, us in bare.items():
        for p, u in enumerate(us):
            at.setdefault(u, []).append((i, p))
    out, order = {}, {i: n for n, i in enumerate(docs)}
    for i, us in bare.items():
        gone, after = set(), {}                  # after: (units, characters) in common from p + 1 on, by earlier place
        for p in range(len(us) - 1, -1, -1):
            here, far = {}, 0
            for f, q in at[us[p]]:
                if (order[f], q) >= (order[i], p):
                    break
                n, chars = after.get((f, q + 1), (0, 0))
                here[f, q] = n + 1, chars + len(us[p])
                if here[f, q][1] >= min_chars:
                    far = max(far, n + 1)
            gone.update(range(p, p + far))
            after = here
        out[i] = "".join(u for p, (u, _) in enumerate(docs[i]) if p not in gone)
    return out


def sentence(i, n=9):
    return " ".join(f"w{i}x{k}" for k in range(n)) + "."


PASSAGE = " ".join(sentence(900 + k) for k in range(6))          # 54 words


def corpus():
    rows = [(i, "\n".join(sentence(100 * i + k) + " " + sentence(100 * i + k + 50) for k in range(8))) for i in range(1, 8)]
    rows += [(20, f"{sentence(2001)} start of a sentence {PASSAGE} and on it goes. {sentence(2002)}"),
             (21, f"{sentence(2101)}\n{PASSAGE}\n{sentence(2102)}"),
             (22, f"Clean text with a common short line.\nShort line.\n{sentence(2201)}"),
             (23, f"Another clean one.\nShort line.\n{sentence(2301)}"),
             (24, rows[0][1]), (25, rows[0][1] + "\nOne more line at the end of it."),
             (26, "Repeat. " * 60), (27, "a" * 200), (28, "b\n" + "a" * 200 + "\nc"), (29, "\n\n\n"), (30, rows[1][1][:300])]
    return rows


def test_equals_brute_force_and_catches_passages(spark):
    rows = corpus()
    got = {r.doc_id: r for r in ld.dedup(docs_frame(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == exact(rows)
    assert got[20].n_deleted == 0 and sentence(902) not in got[21].text
    assert got[22].n_deleted == got[23].n_deleted == 0
    assert got[24].emptied and got[24].text == "" and got[25].text == "One more line at the end of it."
    assert "a" * 200 not in got[28].text and got[26].deleted_chars >= 400 and "Repeat. " in got[26].text
    assert all("".join(u for u, _ in units(t)) == t for _, t in rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in ld.dedup(docs).where("text <> '' OR emptied").collect()}
    assert got == exact(rows)


def test_edge_cases(spark):
    docs = docs_frame(spark, hostile_rows())
    got = ld.dedup(docs).collect()
    assert len(got) == len(hostile_rows())
    same = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert same == sorted(((r[0], r[1]) for r in hostile_rows()), key=str)
    assert ld.dedup(docs.limit(0)).count() == 0
    two = docs_frame(spark, [(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (-4, PASSAGE), (3, "x. " + PASSAGE)])
    texts = sorted((str(r.doc_id), r.text) for r in ld.dedup(two).collect())
    assert texts == sorted([("None", ""), ("3", ""), ("3", ""), ("-4", PASSAGE), ("3", "x. ")])     # equal rows are one document
    clash = docs.selectExpr("doc_id", "text", "1 AS runs", "2 AS k", "3 AS h", "4 AS emptied")
    assert ld.dedup(clash).columns == ["doc_id", "text", "k", "h", "n_deleted", "deleted_chars", "runs", "emptied"]


def deduped(spark, rows, **how):
    return {r.doc_id: r.text for r in ld.dedup(docs_frame(spark, rows), **how).collect()}


def test_copy_with_one_edited_sentence(spark):
    lines = [f"{sentence(i, 7)}\n" for i in range(3000, 3008)]
    rows = [(1, "".join(lines)), (2, "".join(lines[:2] + [sentence(3100) + "\n"] + lines[3:]))]
    got = deduped(spark, rows)
    assert got == exact(rows) and got[2] == "".join(lines[:2]) + sentence(3100) + "\n"


def test_every_comparison_is_made(spark):
    """Random texts of few different units, white space of different widths."""
    import random

    draw = random.Random(5)
    stock = [sentence(i, n) for i, n in zip(range(4000, 4012), (1, 2, 3, 5, 7, 9, 2, 4, 30, 1, 6, 3))]
    rows = [(i, "".join(draw.choice(stock) + draw.choice([" ", "\n", "\n\n", "\n     ", " \n"]) for _ in range(draw.randrange(1, 40))))
            for i in range(60)]
    assert deduped(spark, rows) == exact(rows)
    assert deduped(spark, rows, min_chars=60) == exact(rows, 60)


def test_passage_whose_pairs_were_seen_elsewhere(spark):
    five = [sentence(i) for i in range(5000, 5005)]
    rows = [(i + 1, f"{sentence(5100 + i)}\n{five[i]}\n{five[i + 1]}") for i in range(4)]
    rows += [(10, sentence(5200) + "\n" + "\n".join(five)), (11, sentence(5300) + "\n" + "\n".join(five))]
    got = deduped(spark, rows)
    assert got == exact(rows) and got[10] == rows[4][1] and got[11] == sentence(5300) + "\n"


def test_indented_lines_and_other_full_stops(spark):
    block = "".join(f"{' ' * 8}{sentence(i, 8)}\n" for i in range(6000, 6004))
    tabs = "".join(f"\t\t\t\t\t{sentence(i, 8)}\r\n" for i in range(6100, 6104))
    han = "".join(chr(0x4E00 + i) * 50 + "。" for i in range(4))
    hindi = "".join(f"{chr(0x0915 + i) * 50}। " for i in range(4))
    bodies = [block, tabs, han, hindi]
    rows = [(i, f"{sentence(6200 + i)}{sep}{body}") for i, (body, sep) in enumerate(
        [(body, "" if body is han else "\n") for body in bodies] * 2)]
    rows[2], rows[6] = (2, "甲乙。「丙丁。」" + han), (6, "戊己。「庚辛。」" + han)
    got = deduped(spark, rows)
    assert got == exact(rows)
    assert [got[i] for i in (4, 5, 6, 7)] == [sentence(6204) + "\n", sentence(6205) + "\n", "戊己。「庚辛。」", sentence(6207) + "\n"]
    assert all("".join(u for u, _ in units(t)) == t for _, t in rows)


def test_units_of_all_scripts_and_of_marks(spark):
    import random

    draw = random.Random(8)
    parts = ["a", "Bc d", ".", "!", "? ", ". ", "\n", "\n\n", "  ", "\t", "。", "。」", "！？", "？ ", "。\n", "。。」』", "… ", "। ", "।", "؟ ", "é", "中文", ".\n", ". \n x", "", "\r\n"]
    texts = ["".join(draw.choice(parts[:k]) for _ in range(draw.randrange(1, 30))) for k in (6, 10, 24, 26) for _ in range(150)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in ld.with_units(frame.withColumn("p", ld.pieces(F.col("t"))), "t").collect():
        assert r.p == pieces(r.t) and list(zip(r.u, r.b)) == units(r.t)


def test_ids_of_other_types_and_null_ids(spark):
    body = "\n".join(sentence(7000 + k) for k in range(6))
    rows = [("k2", sentence(7100) + "\n" + body), ("k10", sentence(7101) + "\n" + body), ("k1", "short"), ("k3", body[:150])]
    frame = spark.createDataFrame(rows + [(None, body + "\nalone")], "doc_id string, text string")
    got = {r.doc_id: r.text for r in ld.dedup(frame).collect()}
    assert got == exact(rows + [(None, body + "\nalone")]) | {"k1": "short"}
    assert got["k10"] == rows[1][1] and got["k2"] == rows[0][1][:len(sentence(7100)) + 1] and got[None] == "alone"
    none = [f"{sentence(7200 + i)}\n{body}" for i in range(40)]
    texts = sorted(r.text for r in ld.dedup(spark.createDataFrame([(None, t) for t in none], "doc_id int, text string")).collect())
    assert sum(body in t for t in texts) == 1 and sorted(t.split("\n")[0] for t in texts) == sorted(t.split("\n")[0] for t in none)


def test_hot_line_and_stretches_of_short_units(spark):
    """A line in every document, and repeats made of many short units."""
    hot = sentence(8000, 30)
    rows = [(i, f"{sentence(8100 + i)}\n{hot}\n{sentence(8300 + i)}") for i in range(60)]
    short = "".join(f"x{k % 23} y.\n" for k in range(70))
    rows += [(100, short), (101, "Begin.\n" + short + "end"), (102, "\n  \n".join(short.split("\n")[5:60])), (103, "a. " * 90), (104, "b. " + "a. " * 61)]
    got = deduped(spark, rows)
    assert got == exact(rows) and all(hot not in got[i] for i in range(1, 60)) and hot in got[0]
    assert got[101].startswith("Begin.\n") and got[101].endswith("\nend") and len(got[101]) < 60       # groups begin a little later
