"""The public names, functions in Spark SQL, readers, and keys that are saved."""

import datetime as dt
import json

from pyspark.sql import functions as F

import quillveil
from quillveil.operators import keys, scan
from quillveil.sources import files


def test_functions_in_sql(spark):
    names = quillveil.register(spark)
    assert "qv_mask" in names and "qv_is_card" in names
    row = spark.sql("SELECT qv_mask(t).anonymized AS a, qv_is_israeli_id('123456709') AS i, qv_is_israeli_phone('+972-052-1234567') AS p, qv_shadow('1​２') AS s, qv_mask(NULL).anonymized AS n FROM VALUES ('mail dana@example.com') AS v(t)").first()
    assert tuple(row) == ("mail [EMAIL_1]", True, False, "12", None)
    rows = spark.sql("SELECT s.* FROM VALUES ('x 123456709, a@b.co') AS v(t), LATERAL qv_spans(t) AS s ORDER BY start").collect()
    assert [(r.type, r.value) for r in rows] == [("ISRAELI_ID", "123456709"), ("EMAIL_ADDRESS", "a@b.co")]


def test_rules_of_ones_own():
    detect = quillveil.with_rules([quillveil.Rule("EMPLOYEE", "E-[0-9]{4}", before="(?<![A-Z])")])
    assert [(s[2], s[:2]) for s in detect("E-1234 123456709")] == [("ISRAELI_ID", (7, 16)), ("EMPLOYEE", (0, 6))]
    used, key, out = quillveil.process("E-1234 x", detect("E-1234 x"))
    assert out == "[EMPLOYEE_1] x" and key == [("[EMPLOYEE_1]", "E-1234", "EMPLOYEE")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one\ntwo \n")
    (tmp_path / "b.txt").write_text(" \n")
    (tmp_path / "g.json").write_text(json.dumps([{"text": "Dana met Levi", "gold": [{"text": "Dana", "type": "PERSON"}, {"text": "Levi", "type": "PERSON"}]}, {"text": "none", "gold": []}]))
    got = files.read_text(spark, f"file://{tmp_path}/*.txt").collect()
    assert [(r.path.rsplit("/", 1)[1], r.text.strip()) for r in got] == [("a.txt", "one\ntwo")]
    assert files.read_binary(spark, f"file://{tmp_path}/*.txt", most=5).count() == 1
    assert [(r.text, r.type, r.surface) for r in files.read_gold(spark, f"file://{tmp_path}/g.json").collect()] == [("Dana met Levi", "PERSON", "Dana"), ("Dana met Levi", "PERSON", "Levi")]


def test_words_of_nested_pages(spark):
    word = lambda t: {"text": t, "confidence": 90.0}
    nested = [{"paragraphs": [{"lines": [{"words": [word("a"), word("b")]}, {"words": [word("c")]}]}]}, {"paragraphs": []}]
    line = "struct<words:array<struct<text:string,confidence:double>>>"
    deep = spark.createDataFrame([(1, nested)], f"page int, blocks array<struct<paragraphs:array<struct<lines:array<{line}>>>>>")
    flat = spark.createDataFrame([(1, [word("a"), word("b"), word("c")])], "page int, words array<struct<text:string,confidence:double>>")
    assert [tuple(r) for r in scan.words_of(deep, "page").collect()] == [tuple(r) for r in scan.words_of(flat, "page").collect()] == [(1, k, t, 90.0) for k, t in enumerate("abc")]


def test_saving_begins_a_keys_time_anew(spark):
    now = dt.datetime(2024, 1, 2, 12)
    old = [("[A_1]", "a", now - dt.timedelta(hours=3)), ("[A_2]", "b", now - dt.timedelta(hours=30))]
    rows = spark.createDataFrame(old, "placeholder string, original string, seen_at timestamp")
    new = spark.createDataFrame([("[A_1]", "other"), ("[A_3]", "c")], "placeholder string, original string")
    got = keys.saved(rows, new, F.lit(now)).orderBy("placeholder").collect()
    assert [tuple(r) for r in got] == [("[A_1]", "a", now), ("[A_3]", "c", now)]


def test_the_key_is_not_in_the_plan(spark):
    rows = keys.encrypted(spark.createDataFrame([("x",)], "v string"), "v", "pass", 100_000)
    plan = rows._jdf.queryExecution().toString()
    envelope = json.loads(rows.first().envelope)
    secret = keys._derived("pass", __import__("base64").b64decode(envelope["kdf"]["salt"]), 100_000)
    assert secret.hex().upper() not in plan.upper() and str(list(secret))[1:-1] not in plan
