import random

import pytest
from pyspark.sql import functions as F

from quillveil.functions import validators as V
from quillveil.operators import document as D
from quillveil.operators import keys, masking, recognizers
from quillveil.sources import files


def test_resolution_prefers_priority_then_score_then_length():
    person, number = (0, 20, "PERSON", 0.99, None), (5, 14, "ISRAELI_ID", 1.0, None)
    assert D.resolved([person, number]) == [number]
    assert D.resolved([(0, 9, "IL_PHONE", 1.0, None), (0, 9, "ISRAELI_ID", 1.0, None)])[0][2] == "ISRAELI_ID"
    assert D.resolved([(0, 9, "ISRAELI_ID", 1.0, None), (0, 9, "IL_COMPANY", 1.0, None)])[0][2] == "IL_COMPANY"


def test_resolution_leaves_no_overlap_and_no_span_uncovered():
    rng = random.Random(5)
    for _ in range(200):
        found = [(a, a + rng.randint(1, 9), rng.choice(list(D.LABEL)), rng.choice([0.5, 0.9, 1.0]), None) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 12)))]
        kept = D.resolved(found)
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
        assert all(any(D.overlap(k, s) for k in kept) for s in found)


def test_remainders_completion_and_numbering():
    text = "Dana Levi 123456709 Dana Levi, [ID_1] Levi"
    used, key, out = D.process(text, [(0, 19, "PERSON", 0.9, None), (10, 19, "ISRAELI_ID", 1.0, None)], remainders=True)
    assert out == "[NAME_1] [ID_2] [NAME_1], [ID_1] Levi"
    assert key == [("[NAME_1]", "Dana Levi", "PERSON"), ("[ID_2]", "123456709", "ISRAELI_ID")]
    assert D.process(text, [(10, 19, "ISRAELI_ID", 1.0, None)], disabled=("ISRAELI_ID",))[2] == text
    assert D.process("", [])[2] == ""


@pytest.mark.parametrize("check, good, bad", [
    (V.israeli_id, ["123456709", "876543208", "203040506", "111111100", "998877609"], ["123456700", "876543209", "000000000", "", "1234567090"]),
    (V.israeli_company, ["512345679", "500000005", "587654328", "555555556", "510203045"], ["512345670", "123456709"]),
    (V.israeli_phone, ["052-1234567", "050 123 4567", "054.123.4567", "03-1234567", "+972-52-1234567", "+972-3-1234567"], ["06-1234567", "071-1234567", "052-12345", "1234567"]),
    (V.israeli_iban, ["IL620108000000099999999"], ["IL620108000000099999998", "IL000108000000099999999", "DE89370400440532013000"]),
])
def test_validators(spark, check, good, bad):
    rows = spark.createDataFrame([(v, v in good) for v in good + bad], "v string, ok boolean").select("v", "ok", check(F.col("v")).alias("got")).collect()
    assert [(r.v, bool(r.got)) for r in rows] == [(r.v, r.ok) for r in rows]


def test_masking_and_restoring(spark):
    texts = ["מייל dana@example.com טל 052-1234567 ושוב dana@example.com", "", None, "אין כאן דבר", 'נגד גלים כהן בע"מ, ת"ז 12345-6709', "החברה בע\"מ הודיעה"]
    rows = masking.anonymize_deterministic(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    back, unknown = masking.restored(F.col("anonymized"), F.col("key"))
    got = rows.select("i", "text", "anonymized", back.alias("back"), F.size(unknown).alias("n")).orderBy("i").collect()
    assert got[0].anonymized == "מייל [EMAIL_1] טל [PHONE_1] ושוב [EMAIL_1]"
    assert got[4].anonymized == "נגד [ORG_1], ת\"ז [ID_1]"
    assert got[5].anonymized == texts[5]
    assert [r.back for r in got] == texts
    loose = spark.createDataFrame([("[‏EMAIL_1 ] x [FOO_9]", [("[EMAIL_1]", "a@b.co", "EMAIL_ADDRESS")])], f"t string, key {masking.KEY}")
    back, unknown = masking.restored(F.col("t"), F.col("key"))
    assert tuple(loose.select(back, unknown).first()) == ("a@b.co x [FOO_9]", ["[FOO_9]"])


def test_ner_alignment():
    text = "Shalom to Dana Levi of Acme and Dana"
    raw = [{"raw": "B-PER", "surface": "Dana Le", "score": 0.9}, {"raw": "ORG", "surface": "Acme", "score": 0.8}, {"raw": "PER", "surface": "Dana", "score": 0.7}, {"raw": "MISC", "surface": "of", "score": 1}]
    assert [text[s["start"] : s["end"]] for s in recognizers.align_ner(text, raw)] == ["Dana Levi", "Acme", "Dana"]


def test_keys_and_files():
    assert keys.parse_csv('placeholder,original,type\r\n[A_1],"\'=x, ""y""\nz",PERSON\r\nshort,row\r\n[B_1],b,NOVEL') == [
        {"placeholder": "[A_1]", "original": '=x, "y"\nz', "type": "PERSON"}, {"placeholder": "[B_1]", "original": "b", "type": "MANUAL"}]
    docx = files.token_docx("שלום [NAME_1]\n\na < b & c")
    assert files.plain_text(docx) == "שלום [NAME_1]\na < b & c"
    assert files.plain_text(files.rewritten(docx, lambda t: t.replace("[NAME_1]", "דנה <>"))) == "שלום דנה <>\na < b & c"
    text = "word " * 300 + "x" * 1000
    assert "".join(c["text"] for c in files.chunks(text)) == text and max(len(c["text"]) for c in files.chunks(text)) <= 400
