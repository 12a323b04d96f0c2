"""Scanned pages, chunks, placeholders, byte layers: values that a table of random rows doesn't hold."""

import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from quillveil.functions import placeholders as P
from quillveil.functions import text as T
from quillveil.operators import masking, scan, verify
from quillveil.sources import files


def words(*rows):
    return [{"text": t, "x0": float(x), "y0": float(y), "x1": float(x + 60), "y1": float(y + 20)} for t, x, y in rows]


# Labels of fields.
@pytest.mark.parametrize("page, want", [
    (words(("שם", 0, 0), ("דנה", 70, 0)), [([0], [1], "PERSON")]),
    (words(("שם", 0, 0), ("דנה", 900, 0)), []),  # too far
    (words(("שם", 0, 0), ("דנה", 70, 50)), []),  # another line
    (words(("שם", 0, 0), ("הלקוח", 70, 0), ("דנה", 140, 0)), [([0, 1], [2], "PERSON")]),  # the longer label
    (words(("דנה", 0, 0), ("טלפון", 70, 0)), [([1], [0], "IL_PHONE")]),  # to the left
    (words(("שם", 0, 0), ("a", 70, 0), ("b", 140, 0), ("c", 210, 0), ("d", 280, 0)), [([0], [1, 2, 3], "PERSON")]),  # three at most
    (words(("שם", 0, 0), ("a", 70, 0), ("נייד", 140, 0), ("b", 210, 0)), [([0], [1], "PERSON"), ([2], [3, 1], "IL_PHONE")]),  # a label ends a value
    (words(("טלפון0521", 0, 0)), [([], [0], "IL_PHONE")]),
    (words(("שם", 0, 0), (" ", 70, 0)), []),
])
def test_labels_and_their_values(page, want):
    assert scan.anchored(page) == want


@pytest.mark.parametrize("text, found", [("12345678", True), ("1234567", False), ("1234567890", True), ("12345678901", False), ("12/12345678", False), ("123 45-67.8", True), ("1234\n5678", False)])
def test_long_numbers(text, found):
    assert bool(scan._NUMBER.search(text)) == found


def test_union_keeps_coverage_and_the_stronger_type():
    a, b = (0, 9, "ORGANIZATION", 0.9, None), (5, 12, "ISRAELI_ID", 0.5, None)
    assert scan.united([b, a]) == [(0, 12, "ISRAELI_ID", 0.9, None)]
    assert scan.united([(0, 5, "PERSON", 0.5, None), (5, 9, "PERSON", 0.5, None)]) == [(0, 5, "PERSON", 0.5, None), (5, 9, "PERSON", 0.5, None)]
    # a newcomer is held against the best score so far
    assert scan.united([(0, 9, "LOCATION", 0.9, None), (1, 9, "ORGANIZATION", 0.8, None)])[0][2] == "LOCATION"


@pytest.mark.parametrize("at, first", [(199, 400), (200, 400), (201, 202), (300, 301)])
def test_chunks_break_beyond_the_middle(at, first):
    text = "x" * at + " " + "y" * 600
    cut = files.chunks(text)
    assert len(cut[0]["text"]) == first and "".join(c["text"] for c in cut) == text
    assert files.chunks("a b") == [{"text": "a b", "offset": 0}] and files.chunks("") == [] == files.chunks(None)


def test_placeholders_in_any_canonical_form(spark):
    composed, apart = "[CLIÉNT_1]", unicodedata.normalize("NFD", "[CLIÉNT_1]")
    rows = spark.createDataFrame([(f"a {apart} b {composed} c [CLIENT_1]", [(composed, "Dana", "MANUAL")]), (f"{composed}", [(apart, "Dana", "MANUAL")])], f"t string, key {masking.KEY}")
    whole, unknown = masking.restored(F.col("t"), F.col("key"))
    got = rows.select(whole.alias("w"), unknown.alias("u")).collect()
    assert got[0].w == "a Dana b Dana c [CLIENT_1]" and got[0].u == ["[CLIENT_1]"] and got[1].w == "Dana"


def test_places_and_marks(spark):
    row = spark.createDataFrame([("(Dana's) [NAME_1], b-c",)], "t string")
    at = lambda n: P.word_at(F.col("t"), F.lit(n))
    got = row.select(*(at(n).alias(f"c{n}") for n in (0, 3, 8, 9, 11, 17, 19, 22))).first()
    assert tuple(got) == ("Dana's", "Dana's", "Dana's", None, None, None, "b-c", "b-c")
    assert row.select(P.name_pattern(F.lit("דנה")).alias("a"), P.name_pattern(F.lit("12 34")).alias("b")).first() == (None, None)


@pytest.mark.parametrize("content, found", [
    (b"x Dan y", ["Dan [utf-8]"]), ("Dan".encode("utf-16-le"), ["Dan [utf-16le]"]), (b"naD", ["Dan [utf-8 (reversed)]"]),
    (b"1 0 obj<<>>stream\n" + zlib.compress(b"Dan") + b"\nendstream", ["Dan [utf-8]"]), (b"1 0 obj<</Subtype /Image>>stream\n" + zlib.compress(b"Dan") + b"endstream", []),
    (b"1 0 obj<<>>stream\n" + zlib.compress(b"Dan")[2:-4] + b"endstream", ["Dan [utf-8]"]), (b"", []),
])
def test_bytes(content, found):
    assert verify.bytes_hold(content, ["Dan", ""]) == found


def test_string_and_column_forms_of_leak_rules_agree(spark):
    texts = ["כהן פגש את מכהן", "05-2-1 (052) 1.2", "Dana Levi, Dana-Levi DanaLevi", "", "9121 1219", "Dana  Levi"]
    values = [("כהן", "PERSON"), ("0521", "IL_BAR"), ("Dana Levi", "PERSON"), (" Levi ", "PERSON"), ("9 12-1", "IL_BAR"), ("", "MANUAL")]
    rows = spark.createDataFrame([(t, [("[X_1]", v, k) for v, k in values]) for t in texts], f"t string, key {masking.KEY}")
    got = rows.select("t", verify.leak_spans(F.col("t"), F.col("key")).alias("s"), verify.leaks(F.col("t"), F.transform("key", lambda k: k["original"])).alias("n"), verify.part_leaks(F.create_map(F.lit("a.xml"), F.col("t")), F.transform("key", lambda k: k["original"])).alias("p")).collect()
    for r in got:
        spans = {s for v, k in values for s in verify.plain_leak_spans(r.t, v, k)}
        assert {(s.start, s.end, s.type, s.score, s.label) for s in r.s} == spans
        assert r.n == [v for v, _ in values if verify.plain_survives(r.t, v)]
        assert [p.needle for p in r.p] == verify.plain_part_leaks(r.t, [v for v, _ in values])


def test_shadow_folds_and_maps_back(spark):
    text = "א­1​2３٤ שּׁ 123456709"
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(T.shadow(F.col("t"))).first()[0].startswith("א1234 ")
    found = masking.with_found(rows.withColumnRenamed("t", "text"), "text").first()._found
    assert [(text[s.start : s.end], s.type) for s in found] == [("123456709", "ISRAELI_ID")]
