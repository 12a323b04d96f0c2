"""Registered queries and their oracle SQL.

Values of Israeli formats don't occur in the tables, so their texts are planted: built from customer keys by the same rule in
both engines, which tells type, place and validity of each value by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as T
from ..functions import validators as V
from ..operators import keys, masking, recognizers, scan, sessions, spans, verify
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# ---- planted values -------------------------------------------------------------------------------------------------------

#: DuckDB: stem, valid 9-digit id, company number, phone and IBAN of each customer.
PLANTED_SQL = """
WITH p0 AS (SELECT c_custkey AS k, lpad(((c_custkey * 7919 + 1000003) % 100000000)::VARCHAR, 8, '0') AS stem FROM customer),
p1 AS (SELECT k, stem, '5' || substr(stem, 1, 7) AS cstem, lpad((k % 10000000)::VARCHAR, 7, '0') AS seven, '010800000' || lpad(k::VARCHAR, 10, '0') AS bban FROM p0),
p AS (SELECT k, seven, stem || ((10 - list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 1 THEN substr(stem, i, 1)::INT ELSE (substr(stem, i, 1)::INT * 2) // 10 + (substr(stem, i, 1)::INT * 2) % 10 END)) % 10) % 10)::INT::VARCHAR AS id,
      cstem || ((10 - list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 1 THEN substr(cstem, i, 1)::INT ELSE (substr(cstem, i, 1)::INT * 2) // 10 + (substr(cstem, i, 1)::INT * 2) % 10 END)) % 10) % 10)::INT::VARCHAR AS company,
      '05' || (k % 10)::VARCHAR || '-' || seven AS phone, 'IL' || lpad((98 - (bban || '182100')::HUGEINT % 97)::VARCHAR, 2, '0') || bban AS iban FROM p1)
"""


def _check_digit(stem: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substring(stem, i, F.lit(1)).cast("int")).otherwise((F.substring(stem, i, F.lit(1)).cast("int") * 2 / 10).cast("int") + F.substring(stem, i, F.lit(1)).cast("int") * 2 % 10))
    return ((10 - total % 10) % 10).cast("string")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, seven, id, company, phone, iban of each customer; id, company and iban are valid."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lpad(((F.col("c_custkey") * 7919 + 1000003) % 100000000).cast("string"), 8, "0").alias("stem"))
    p = p.withColumns({"cstem": F.concat(F.lit("5"), F.substring("stem", 1, 7)), "seven": F.lpad((F.col("k") % 10000000).cast("string"), 7, "0"), "bban": F.concat(F.lit("010800000"), F.lpad(F.col("k").cast("string"), 10, "0"))})
    check = F.lpad((98 - F.concat("bban", F.lit("182100")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    return p.select("k", "seven", F.concat("stem", _check_digit(F.col("stem"))).alias("id"), F.concat("cstem", _check_digit(F.col("cstem"))).alias("company"), F.concat(F.lit("05"), (F.col("k") % 10).cast("string"), F.lit("-"), "seven").alias("phone"), F.concat(F.lit("IL"), check, "bban").alias("iban")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")  # texts built from these are then worked out once, on all cores


#: Texts planted for each key: name, prefix, value (a column of planted, or SQL for both engines), suffix, type found (None: nothing).
VARIANTS = [
    ("id", "ללקוח ", "id", " נמסר", "ISRAELI_ID"),
    ("id_long", "ללקוח 0", "id", " נמסר", None),
    ("id_context", "ת\"ז: ", "concat(substr(id, 1, 4), '-', substr(id, 5, 5))", ".", "ISRAELI_ID"),
    ("label_any", "תעודת זהות ", "seven", ";", "ISRAELI_ID"),
    ("label_far", "תעודת זהות שנמסרה ביום שני בשעה שבע ", "seven", ";", None),
    ("passport", "דרכון ", "seven", " בתוקף", "IL_PASSPORT"),
    ("bar", "מספר רישיון עו\"ד ", "substr(seven, 3, 5)", ".", "IL_BAR"),
    ("birth", "תאריך לידה: ", "concat('1', k % 9, '.07.1981')", ",", "DATE_OF_BIRTH"),
    ("iban", "לחשבון", "iban", " הועבר", "IL_IBAN"),
    ("case", "תיק מספר ", "concat(substr(seven, 2, 6), '/21')", " נסגר", "IL_CASE"),
    ("case_net", "ראו ", "concat(seven, '-03-22')", " לעיל", "IL_CASE"),
    ("land", "נכס ", "concat('גוש ', 1 + k % 9999, ' חלקה ', 1 + k % 99)", " בחיפה", "IL_LAND"),
    ("policy", "פוליסת ביטוח מספר ", "concat(seven, '/7')", " בתוקף", "IL_POLICY"),
    ("insured", "מבוטח מספר ", "seven", ";", "IL_INSURED"),
    ("ssn", "no. ", "concat('1', substr(seven, 6, 2), '-11-2', substr(seven, 4, 3))", " on file", "US_SSN"),
    ("organisation", "נגד ", "concat('גלים ', substr('אבגדהוזחטיכלמנסעפצקר', CAST(1 + k % 20 AS INT), 1), 'לון בע\"מ')", " הוגשה", "ORGANIZATION"),
    ("invisible", "ללקוח ", "concat(substr(id, 1, 3), '‏', substr(id, 4, 6))", " נמסר", "ISRAELI_ID"),
]




@query(
    PLANTED_SQL
    + "SELECT k, name, type, start::INT AS start, (start + length(value))::INT AS \"end\", value FROM ("
    + " UNION ALL ".join(f"SELECT k, '{n}' AS name, '{t}' AS type, length('{p.replace(chr(39), chr(39) * 2)}') AS start, {v} AS value FROM p" for n, p, v, _, t in VARIANTS if t)
    + ")"
)
def planted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on planted texts: the spans after resolution, with their places and surfaces."""
    rows = planted(spark, sf_dir).withColumn("v", F.array(*(F.struct(F.lit(n).alias("name"), F.concat(F.lit(p), F.expr(v)).alias("head"), F.lit(s).alias("tail")) for n, p, v, s, _ in VARIANTS)))
    rows = rows.select("k", F.explode("v").alias("v")).select("k", "v.name", F.concat("v.head", "v.tail").alias("text"))
    rows = masking.with_found(rows, "text").withColumn("s", F.explode(spans.resolved(F.col("_found"))))
    return rows.select("k", "name", F.col("s.type").alias("type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), T.surface(F.col("text"), F.col("s")).alias("value"))


@query(PLANTED_SQL + "SELECT k, true AS id_ok, false AS id_bad, true AS company_ok, false AS id_as_company, true AS iban_ok, false AS iban_bad, true AS mobile_ok, '05' || (k % 10) || seven AS national FROM p")
def planted_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted(spark, sf_dir)
    wrong = lambda c: F.concat(F.substring(c, F.lit(1), F.length(c) - 1), ((F.substring(c, -1, 1).cast("int") + 1) % 10).cast("string"))
    other = F.concat(F.lit("4"), F.expr("substring(company, 2)"))
    mobile = F.concat(F.lit("+972-"), F.expr("substring(phone, 2)"))
    return p.select("k", V.israeli_id(F.col("id")).alias("id_ok"), V.israeli_id(wrong(F.col("id"))).alias("id_bad"), V.israeli_company(F.col("company")).alias("company_ok"), V.israeli_company(other).alias("id_as_company"), V.israeli_iban(F.col("iban")).alias("iban_ok"), V.israeli_iban(wrong(F.col("iban"))).alias("iban_bad"), V.israeli_phone(mobile).alias("mobile_ok"), V.phone_digits(mobile).alias("national"))


@query(PLANTED_SQL + "SELECT k, 'פנו אל [PHONE_1] או [PHONE_1], ת\"ז [ID_2], וכן [ID_1] [ID_01]' AS anonymized, 2::BIGINT AS n_keys, true AS same FROM p")
def planted_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering, repeated values and placeholders that are in the text already; restoring gives the text back."""
    p = planted(spark, sf_dir)
    rows = p.select("k", F.concat(F.lit("פנו אל "), "phone", F.lit(" או "), "phone", F.lit(', ת"ז '), "id", F.lit(", וכן [ID_1] [ID_01]")).alias("text"))
    rows = masking.anonymize_deterministic(rows)
    return rows.select("k", "anonymized", F.size("key").cast("long").alias("n_keys"), (masking.restored(F.col("anonymized"), F.col("key"))[0] == F.col("text")).alias("same"))


@query(PLANTED_SQL + "SELECT k, 'phone_off' AS option, 'ת\"ז [ID_1] טל ' || phone AS anonymized FROM p UNION ALL SELECT k, 'id_revealed', CASE WHEN substr(id, 1, 1) = '5' THEN 'ת\"ז [COMPANY_1] טל [PHONE_1]' WHEN substr(id, 1, 2) IN ('02', '03', '04', '08', '09') THEN 'ת\"ז [PHONE_1] טל [PHONE_2]' ELSE 'ת\"ז ' || id || ' טל [PHONE_1]' END FROM p UNION ALL SELECT k, 'with_term', '[CLIENT_1] טל [PHONE_1]' FROM p")
def planted_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type switched off, and the user's own term with its label, which beats an id inside it; a surface excluded by a join."""
    p = planted(spark, sf_dir).select("k", "id", F.concat(F.lit('ת"ז '), "id", F.lit(" טל "), "phone").alias("text"))
    label = T.span(F.lit(0), F.lit(4) + F.length("id"), "MANUAL", 1.0, F.lit("CLIENT"))
    off = masking.anonymize_with(p, disabled=["IL_PHONE"]).select("k", F.lit("phone_off").alias("option"), "anonymized")
    shown = masking.anonymize_with(p, disabled=["ISRAELI_ID"]).select("k", F.lit("id_revealed").alias("option"), "anonymized")
    own = masking.anonymize_with(p, extra=F.array(label)).select("k", F.lit("with_term").alias("option"), "anonymized")
    return off.unionByName(shown).unionByName(own)


@query(PLANTED_SQL + "SELECT k, [id] AS leaked, []::VARCHAR[] AS clean, [id] AS backwards FROM p")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles that survive in other formats; a longer number that holds one is no leak."""
    p = planted(spark, sf_dir)
    needles = F.array("id", F.lit("כהן"))
    hyphens = F.concat(F.lit("מספר "), F.substring("id", 1, 2), F.lit("-"), F.substring("id", 3, 3), F.lit(" "), F.substring("id", 6, 4), F.lit(" מכהן"))
    return p.select("k", verify.leaks(hyphens, needles).alias("leaked"), verify.leaks(F.concat("id", F.lit("7")), needles).alias("clean"), verify.leaks(F.reverse("id"), F.array("id")).alias("backwards"))


@query(PLANTED_SQL + "SELECT k, [id] AS found, substr(id, 1, 2) || '-' || substr(id, 3, 3) || '-' || substr(id, 6, 4) AS written FROM p")
def leak_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value written in another format is found again by its digits."""
    p = planted(spark, sf_dir).withColumn("written", F.concat(F.substring("id", 1, 2), F.lit("-"), F.substring("id", 3, 3), F.lit("-"), F.substring("id", 6, 4))).withColumn("text", F.concat(F.lit("ראו "), "written", F.lit(" לעיל")))
    key = F.array(F.struct(F.lit("[ID_1]").alias("placeholder"), F.col("id").alias("original"), F.lit("ISRAELI_ID").alias("type")))
    found = F.transform(verify.leak_spans(F.col("text"), key), lambda s: T.digits(T.surface(F.col("text"), s)))
    return p.select("k", found.alias("found"), "written")


@query(
    PLANTED_SQL
    + """, t AS (SELECT k, 'גלים ' || substr('אבגדהוזחטיכלמנסעפצקר', (1 + k % 20)::INT, 1) || 'לון' AS name, iban, '+972-5' || (k % 10) || '-' || seven AS mobile FROM p),
s AS (SELECT *, length(name) + 6 AS a, 2 * length(name) + 8 AS b, 2 * length(name) + length(iban) + 9 AS c FROM t)
SELECT k, 'PERSON' AS type, a::INT AS start, (a + length(name))::INT AS "end", name AS value FROM s UNION ALL SELECT k, 'IL_IBAN', b::INT, (b + length(iban))::INT, iban FROM s UNION ALL SELECT k, 'IL_PHONE', c::INT, (c + length(mobile))::INT, mobile FROM s"""
)
def leak_heal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surviving name, IBAN and +972 phone are found as whole words; the name inside a longer word isn't."""
    name = F.expr("concat('גלים ', substr('אבגדהוזחטיכלמנסעפצקר', CAST(1 + k % 20 AS INT), 1), 'לון')")
    p = planted(spark, sf_dir).select("k", name.alias("name"), "iban", F.concat(F.lit("+972-"), F.expr("substring(phone, 2)")).alias("mobile"))
    p = p.withColumn("text", F.concat(F.lit("ו"), "name", F.lit(" ראו "), "name", F.lit(", "), "iban", F.lit(" "), "mobile", F.lit(".")))
    row = lambda c, t: F.struct(F.lit(f"[{t}_1]").alias("placeholder"), F.col(c).alias("original"), F.lit(t).alias("type"))
    key = F.array(row("name", "PERSON"), row("iban", "IL_IBAN"), row("mobile", "IL_PHONE"))
    s = p.select("k", "text", F.explode(verify.leak_spans(F.col("text"), key)).alias("s"))
    return s.select("k", "s.type", "s.start", "s.end", T.surface(F.col("text"), F.col("s")).alias("value"))


@query(PLANTED_SQL + "SELECT k, 'validated' AS id, 'ocr' AS short_id, 'validated' AS iban, 'unreadable' AS lost, 'ocr' AS person, (k % 100000 > 9999) AS survivor FROM p")
def scan_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted(spark, sf_dir)
    row = F.struct((F.col("k") % 100000).cast("string").alias("original"), F.lit("IL_BAR").alias("type"))
    return p.select("k", verify.fidelity(F.lit("ISRAELI_ID"), F.col("id")).alias("id"), verify.fidelity(F.lit("ISRAELI_ID"), F.lit("123456700")).alias("short_id"), verify.fidelity(F.lit("IL_IBAN"), F.col("iban")).alias("iban"), verify.fidelity(F.lit("IL_PHONE"), F.lit("טלפון")).alias("lost"), verify.fidelity(F.lit("PERSON"), F.lit("x")).alias("person"), verify.high_confidence(row).alias("survivor"))


# ---- documents ------------------------------------------------------------------------------------------------------------

EMAIL_RE2 = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE_RE2 = r"(?:^|[^A-Za-z0-9_+])((?:\+?1[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4})(?:[^A-Za-z0-9_]|$)"
CARD_RE2 = r"(?:^|[^\d-])(\d(?:[ -]?\d){12,18})(?:[^\d-]|$)"


def _surfaces(rows: DataFrame, found: Column) -> DataFrame:
    s = rows.select("doc_id", "text", F.explode(found).alias("s"))
    return s.select("doc_id", T.surface(F.col("text"), F.col("s")).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE2}')) AS value FROM documents) GROUP BY ALL")
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).where(F.col("text").contains("@"))
    return _surfaces(rows, T.spans_of(F.col("text"), recognizers.EMAIL, "EMAIL_ADDRESS", before="(?<![A-Za-z0-9_.%+-])"))


@query(f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE_RE2}', 1)) AS value FROM documents) GROUP BY ALL")
def us_phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surfaces(docs(spark, sf_dir), T.spans_of(F.col("text"), recognizers.US_PHONE, "US_PHONE", before="(?<![A-Za-z0-9_+])"))


@query(
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD_RE2}', 1)) AS value FROM documents), d AS (SELECT *, reverse(regexp_replace(value, '[ -]', '', 'g')) AS r FROM c)
SELECT DISTINCT doc_id, value FROM d WHERE list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(r, i, 1)::INT ELSE (substr(r, i, 1)::INT * 2) // 10 + (substr(r, i, 1)::INT * 2) % 10 END)) % 10 = 0"""
)
def card_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surfaces(docs(spark, sf_dir), T.spans_of(F.col("text"), recognizers.CARD, "CREDIT_CARD", before="(?<![0-9-])", ok=V.card)).drop("n")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.anonymize_deterministic(docs(spark, sf_dir))


@query()
def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document masked."""
    return _masked(spark, sf_dir).select("doc_id", "anonymized", F.size("spans").cast("long").alias("n_spans"), F.to_json("key").alias("key"))


@query("SELECT count(*) AS n_docs, 0::BIGINT AS n_broken, 0::BIGINT AS n_unknown FROM documents")
def roundtrip_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _masked(spark, sf_dir)
    whole, unknown = masking.restored(F.col("anonymized"), F.col("key"))
    rows = rows.select((whole != F.col("text")).cast("long").alias("broken"), F.size(unknown).alias("unknown"))
    return rows.agg(F.count("*").alias("n_docs"), F.sum("broken").alias("n_broken"), F.sum("unknown").cast("long").alias("n_unknown"))


@query("SELECT 0::BIGINT AS n_overlaps, 0::BIGINT AS n_leaks")
def no_leak_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No two spans overlap, and no masked value survives as a whole word."""
    rows = _masked(spark, sf_dir).where(F.size("spans") > 0)
    overlaps = F.size(F.filter(F.zip_with(F.slice("spans", F.lit(1), F.size("spans") - 1), F.slice("spans", F.lit(2), F.size("spans")), lambda a, b: a["end"] > b["start"]), lambda x: x))
    leaked = F.size(F.filter("key", lambda k: T.has_word(F.col("anonymized"), k["original"])))
    return rows.agg(F.coalesce(F.sum(overlaps), F.lit(0)).cast("long").alias("n_overlaps"), F.coalesce(F.sum(leaked), F.lit(0)).cast("long").alias("n_leaks"))


@query(
    """SELECT lang, count(*) AS n, sum(CASE WHEN length(regexp_replace(text, '[^֐-׿]', '', 'g')) >= greatest(1, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) THEN 1 ELSE 0 END)::BIGINT AS hebrew FROM documents WHERE text IS NOT NULL GROUP BY lang"""
)
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("text is not null")
    he, latin = F.regexp_count("text", F.lit("[\\u0590-\\u05FF]")), F.regexp_count("text", F.lit("[A-Za-z]"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.sum((he >= F.greatest(F.lit(1), latin)).cast("long")).alias("hebrew"))


@query("SELECT doc_id, true AS whole, true AS contiguous, true AS bounded FROM documents WHERE length(text) > 0")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together are the text, begin where the last one ended, and stay within the limit."""
    rows = docs(spark, sf_dir).where(F.length("text") > 0).withColumn("c", files.chunked("text"))
    joined = F.array_join(F.transform("c", lambda x: x["text"]), "") == F.col("text")
    return rows.select("doc_id", joined.alias("whole"), F.forall("c", lambda x: F.substring(F.col("text"), x["offset"] + 1, F.length(x["text"])) == x["text"]).alias("contiguous"), F.forall("c", lambda x: F.length(x["text"]) <= 400).alias("bounded"))


# ---- keys and sessions ----------------------------------------------------------------------------------------------------


@query(
    "SELECT c_custkey AS k, 'placeholder,original,type' || chr(13) || chr(10) || '[NAME_1],\"''=' || c_name || ',\"\"x\"\"\",PERSON' AS csv FROM customer"
)
def key_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value with a formula sign, a comma and quotes as CSV."""
    key = F.array(F.struct(F.lit("[NAME_1]").alias("placeholder"), F.concat(F.lit("="), "c_name", F.lit(',"x"')).alias("original"), F.lit("PERSON").alias("type")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), keys.to_csv(key).alias("csv"))


@query("SELECT c_custkey AS k, '=' || c_name || ',\"x\"' AS original, 'PERSON' AS csv_type, c_name AS json_original, 'MANUAL' AS json_type, true AS bad_version FROM customer")
def key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys through CSV and JSON; unknown types become the user's own."""
    c = table(spark, sf_dir, "customer")
    key = F.array(F.struct(F.lit("[NAME_1]").alias("placeholder"), F.concat(F.lit("="), "c_name", F.lit(',"x"')).alias("original"), F.lit("PERSON").alias("type")))
    other = F.array(F.struct(F.lit("[NAME_1]").alias("placeholder"), F.col("c_name").alias("original"), F.lit("NOVEL").alias("type")))
    c = c.select(F.col("c_custkey").alias("k"), keys.from_csv(keys.to_csv(key)).alias("csv"), keys.from_json(keys.to_json(other)).alias("json"), keys.from_json(F.lit('{"version":"key.v9","rows":[]}')).isNull().alias("bad_version"))
    return c.select("k", F.col("csv")[0]["original"].alias("original"), F.col("csv")[0]["type"].alias("csv_type"), F.col("json")[0]["original"].alias("json_original"), F.col("json")[0]["type"].alias("json_type"), "bad_version")


@query("SELECT c_custkey AS k, c_name AS plain, 'ok' AS status, 'WRONG_PASSPHRASE' AS wrong, 'INVALID_KEY_FILE' AS invalid FROM customer")
def key_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted keys: the right passphrase, a wrong one, and a broken envelope."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    c = keys.encrypted(c, "c_name", "correct horse")
    right = keys.decrypted(c, "envelope", "correct horse").select("k", "envelope", F.col("plain").alias("own"), F.col("status").alias("right"))
    wrong = keys.decrypted(right, "envelope", "battery staple").select("k", "own", "right", F.col("status").alias("wrong"), F.lit("{}").alias("envelope"))
    return keys.decrypted(wrong, "envelope", "x").select("k", F.col("own").alias("plain"), F.col("right").alias("status"), "wrong", F.col("status").alias("invalid"))


@query("SELECT '[N_' || c_custkey || ']' AS placeholder, c_name AS original FROM customer UNION ALL SELECT '[N_' || s_suppkey || ']', s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing rows win; new ones are added by an anti join."""
    token = lambda c: F.concat(F.lit("[N_"), F.col(c).cast("string"), F.lit("]")).alias("placeholder")
    return keys.merged(table(spark, sf_dir, "customer").select(token("c_custkey"), F.col("c_name").alias("original")), table(spark, sf_dir, "supplier").select(token("s_suppkey"), F.col("s_name").alias("original")))


@query("SELECT user_id, max(ts) AS seen_at FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 24 HOURS > (SELECT max(ts) FROM events)")
def key_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys last used in the 24 hours before the last event."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return keys.alive(e.groupBy("user_id").agg(F.max("ts").alias("seen_at")), F.lit(now)).select("user_id", "seen_at")


@query(
    """WITH f AS (SELECT user_id AS session, event_type AS label, props AS original, min(ts) AS t, min(event_id) FILTER (WHERE true) AS e FROM events GROUP BY ALL)
SELECT session, label, original, '[' || label || '_' || row_number() OVER (PARTITION BY session, label ORDER BY t, e, original) || ']' AS placeholder FROM (SELECT e.session, e.label, e.original, e.t, (SELECT min(event_id) FROM events x WHERE x.user_id = e.session AND x.event_type = e.label AND x.props IS NOT DISTINCT FROM e.original AND x.ts = e.t) AS e FROM f e)"""
)
def session_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable numbers by session and label, in order of first appearance."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("step"), F.col("event_id").alias("pos"), F.col("event_type").alias("label"), F.col("props").alias("original"), F.col("event_type").alias("type"))
    return sessions.session_key(e).select("session", "label", "original", "placeholder")


# ---- pages read by OCR: lineitem as words -----------------------------------------------------------------------------------

WORDS_SQL = "WITH w AS (SELECT l_orderkey AS page, l_linenumber AS word_idx, l_partkey::VARCHAR AS text, 100 - l_quantity AS confidence, l_linenumber * 50.0 AS x0, l_orderkey % 7 * 20.0 AS y0, l_linenumber * 50.0 + 40 AS x1, l_orderkey % 7 * 20.0 + 12 AS y1 FROM lineitem)\n"


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_linenumber") * 50.0, F.col("l_orderkey") % 7 * 20.0
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word_idx"), F.col("l_partkey").cast("string").alias("text"), (100 - F.col("l_quantity")).alias("confidence"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 12).alias("y1"))


@query(
    WORDS_SQL
    + "SELECT page, count(*) AS n_words, avg(confidence) AS mean_confidence, avg(CASE WHEN confidence < 60 THEN 1.0::DOUBLE ELSE 0 END) AS low_ratio, count(*) >= 2 AND avg(confidence) >= 75 AND avg(CASE WHEN confidence < 60 THEN 1.0::DOUBLE ELSE 0 END) <= 0.12 AS readable FROM w GROUP BY page"
)
def scan_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.quality(ocr_words(spark, sf_dir), "page")


@query(WORDS_SQL + "SELECT page, word_idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY page ORDER BY word_idx, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM w")
def ocr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.page_text(ocr_words(spark, sf_dir), "page").select("page", "word_idx", "start")


@query(
    WORDS_SQL
    + """, r AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY page ORDER BY word_idx, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r WHERE s < 9 AND s + length(text) > 3 GROUP BY page"""
)
def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of the words that a span of each page's text covers."""
    ranges = scan.page_text(ocr_words(spark, sf_dir), "page")
    own = ranges.select("page").distinct().select("page", F.lit(3).alias("start"), F.lit(9).alias("end"))
    return scan.box_of(scan.words_in(ranges, own, "page"), "page")


@query(
    """WITH s AS (SELECT l_suppkey AS page, (l_partkey % 500)::INT AS "start", (l_partkey % 500 + 1 + l_linenumber)::INT AS "end" FROM lineitem),
m AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY page ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start" THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT page, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY page, island"""
)
def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 500
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), start.cast("int").alias("start"), (start + 1 + F.col("l_linenumber")).cast("int").alias("end"))
    return scan.islands(rows, "page")


@query(WORDS_SQL + "SELECT page, word_idx, greatest(x0 - 1.8, 0) * 0.36 AS x0, greatest(y0 - 1.8, 0) * 0.36 AS y0, least(x1 + 1.8, 1700) * 0.36 AS x1, least(y1 + 1.8, 2200) * 0.36 AS y1 FROM w")
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes, padded and in page points."""
    size = (F.lit(1700.0), F.lit(2200.0))
    box = scan.padded(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), *size)
    page = scan.to_page(box, size, (F.lit(612.0), F.lit(792.0)), (F.lit(0.0), F.lit(0.0)))
    return ocr_words(spark, sf_dir).select("page", "word_idx", *(c.alias(n) for c, n in zip(page, ("x0", "y0", "x1", "y1"))))


# ---- dimensions and quality -------------------------------------------------------------------------------------------------


@query(
    "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' ELSE 'other' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN []::VARCHAR[] ELSE ['IL_PHONE', 'EMAIL_ADDRESS'] END AS toggled FROM customer"
)
def format_and_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File kinds by ending, and the contact family's switch on a list that has it whole or not at all."""
    k = F.col("c_custkey")
    ending = F.when(k % 4 == 0, "PDF").when(k % 4 == 1, "docx").when(k % 4 == 2, "xls").otherwise("bin")
    disabled = F.when(k % 2 == 0, F.array(F.lit("IL_PHONE"), F.lit("EMAIL_ADDRESS"))).otherwise(F.expr("cast(array() as array<string>)"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), files.kind_of(F.concat(F.lit("a/b."), ending)).alias("kind"), E.toggled(disabled, "contact").alias("toggled"))


@query(
    """WITH g AS (SELECT l_returnflag AS type, l_linenumber <= 3 AS gold, l_quantity > 10 AS found FROM lineitem)
SELECT coalesce(type, 'all') AS type, sum(CASE WHEN gold THEN 1 ELSE 0 END)::BIGINT AS n_gold, avg(CASE WHEN gold THEN CASE WHEN found THEN 1.0::DOUBLE ELSE 0 END END) AS recall, avg(CASE WHEN found THEN CASE WHEN gold THEN 1.0::DOUBLE ELSE 0 END END) AS "precision" FROM g GROUP BY ROLLUP (type)"""
)
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision by type and over all, in one pass."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_linenumber") <= 3).alias("gold"), (F.col("l_quantity") > 10).alias("found"))
    out = g.rollup("type").agg(F.sum(F.col("gold").cast("long")).alias("n_gold"), F.avg(F.when(F.col("gold"), F.col("found").cast("double"))).alias("recall"), F.avg(F.when(F.col("found"), F.col("gold").cast("double"))).alias("precision"))
    return out.withColumn("type", F.coalesce("type", F.lit("all")))
