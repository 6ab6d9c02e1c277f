from countframe.llm import licenses
from tests.llm.helpers import ALNUM, LOWER, docs_frame, hostile_rows


def pairs(text):
    w = ALNUM.findall(text.translate(LOWER))
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(text, templates, t=licenses.THRESHOLD):
    if text is None:
        return []
    lines = text.split("\n")
    out = []
    for i, unit in list(enumerate(lines)) + ([(-1, text)] if len(lines) > 1 else []):
        a = pairs(unit)
        for name, body in templates.items():
            b = pairs(body)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
            if dice >= t:
                out.append((name, round(dice, 9), i))
    return sorted(out)


ROWS = hostile_rows() + [
    (20, "Licensed under the Apache License, Version 2.0.\nMore text here."), (21, "LICENSED UNDER THE APACHE LICENSE VERSION 2 0"),
    (22, "intro\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
    (23, "Licensed under the\nApache License, Version 2.0."), (24, "Released under the MIT License. " * 40),
    (25, "This text is licensed to nobody at all."), (26, "License"), (27, "\n".join(licenses.TEMPLATES.values()))]


def test_equals_brute_force(spark):
    got = licenses.scan(docs_frame(spark, ROWS)).collect()
    have = sorted(((r.doc_id, r.text, sorted((m.license, round(m.dice, 9), m.line) for m in r.licenses)) for r in got), key=str)
    assert have == sorted(((r[0], r[1], brute(r[1], licenses.TEMPLATES)) for r in ROWS), key=str)
    best = {r.doc_id: r.license for r in got}
    assert best[20] == best[21] == best[23] == "Apache-2.0" and best[24] == "MIT" and best[25] is None and best[22] is not None


def test_edge_cases(spark):
    docs = docs_frame(spark, ROWS)
    assert licenses.scan(docs.limit(0)).count() == 0
    one = licenses.scan(docs, templates={"x": "only these words", "none": "single"}).where("n_matches > 0")
    assert one.count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS dice", "2 AS license", "3 AS name")
    assert licenses.scan(clash).columns == ["doc_id", "text", "dice", "license", "name", "licenses", "n_matches"]
