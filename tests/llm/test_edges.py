"""Odd tables for the operators on texts: null and equal ids, repeated rows, a very long text, clashing columns."""

import pytest
from colloquy.llm.decontaminate import contaminated
from colloquy.llm.langid import identify
from colloquy.llm.lines import dedup_lines, line_decisions
from colloquy.llm.neardup import near_duplicates
from colloquy.llm.pieces import decode_texts, encode_texts
from colloquy.llm.suffixes import repeated_runs
from colloquy.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def odd(prose):
    """(id, text): two texts of no id, two of one id and one of them again, a copy, a near copy, a very long text, an empty one and none."""
    a, b, c, d = (prose(120, 60_000 + n) for n in range(4))
    near = c.split()
    near[40] = "changed"
    return [(None, a), (None, b), (1, c), (1, d), (1, c), (2, a), (3, " ".join(near)), (4, prose(120_000, 61_000)), (5, ""), (6, None)]


def test_pieces(docs, odd):
    encoded = encode_texts(docs(odd))
    rows = encoded.collect()
    assert len(rows) == len(odd) and all(r.lossless for r in rows)
    back = sorted(((r.doc_id or 0), r.text or "") for r in decode_texts(encoded).collect())
    assert back == sorted((i or 0, t or "") for i, t in odd)


def test_near_duplicates(docs, odd):
    rows = near_duplicates(docs(odd)).collect()
    assert len(rows) == len(odd)
    classes = {}
    for r in rows:
        classes.setdefault(r.class_key, []).append(r.doc_id)
    classes.pop(None, None)
    found = sorted(sorted(str(i) for i in ids) for ids in classes.values() if len(ids) > 1)
    assert ["1", "1", "3"] in found and ["2", "None"] in found and len([f for f in found if "4" in f]) == 0


def test_lines(docs, odd):
    frame = docs(odd)
    rows = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_decisions(frame).collect())
    assert len(rows) == len(odd)
    # the copy and the near copy go; rows of equal id and text are one document; a null id is the least
    assert [(i, n) for i, _, n in rows if n] == [(2, 1), (3, 1)]
    assert dedup_lines(frame).columns == frame.columns


def test_suffix_runs(docs, odd):
    rows = sorted((str(r.doc_id), r.begin, r.length) for r in repeated_runs(docs(odd), span=50).collect())
    assert rows == [("1", 0, 120), ("1", 0, 120), ("2", 0, 120), ("3", 41, 79), ("None", 0, 120)]


def test_language(spark, docs, odd):
    train = spark.createDataFrame([(None, "the house and the river", "en"), (1, "la maison et le fleuve", "fr"), (1, "the river and all of them", "en"), (2, None, "fr"), (3, "x", None)] * 2, "doc_id long, text string, lang string")
    rows = identify(docs(odd), train).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (5, 6)} == {"und"} and {r.lang_pred for r in rows if r.doc_id not in (5, 6)} <= {"en", "fr"}
    # equal texts are told alike, and of equal totals the first language is taken
    same = identify(docs([(1, "house maison"), (2, "house maison")]), train).collect()
    assert len({(r.lang_pred, r.score) for r in same}) == 1


def test_toxicity(spark, docs, odd, prose):
    learn = spark.createDataFrame([(n, prose(30, 70_000 + n) + (" vileword nastyterm" if n % 2 else "")) for n in range(120)] + [(None, "no id"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(100)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity(docs([*odd, (8, "vileword nastyterm vileword")]), learn, labels).collect()
    assert len(rows) == len(odd) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert max(rows, key=lambda r: r.score).doc_id == 8


def test_decontamination(spark, docs, odd, prose):
    item, other = " ".join(odd[0][1].split()[20:60]), prose(40, 90_000)
    items = spark.createDataFrame([(1, item), (2, other), (None, "no id"), (3, None), (4, "")], "item_id long, text string")
    rows = contaminated(docs([*odd, (9, prose(5_000, 91_000) + " " + other)]), items).select("doc_id").distinct().collect()
    assert sorted(str(r.doc_id) for r in rows) == ["2", "9", "None"]
