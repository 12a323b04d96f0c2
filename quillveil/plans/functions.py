"""Registered queries of scalar functions, predicates and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import placeholders as P
from ..functions import policy
from ..functions import text as T
from ..operators import masking, overlay
from ..sources import files
from .catalog import PLANTED_SQL, docs, planted, query, table

#: White space of the matching rules, in DuckDB's notation.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    r"""WITH t AS (SELECT c_custkey AS k, '[NAME_' || c_custkey % 7 || '] a [ID_' || c_custkey || ' ] b [NAME_' || c_custkey % 7 || ']' || CASE WHEN c_custkey % 3 = 0 THEN ' [X_Y_2]' ELSE ' [x]' END AS text FROM customer),
a AS (SELECT k, regexp_extract_all(text, '\[[^\[\]]*_[0-9]+ *\]') AS tokens FROM t)
SELECT k, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct, len(tokens) >= 2 AS returned, greatest(0, len(tokens) - 1) AS restored, regexp_extract(tokens[-1], '^\[(.*)_[^_]*\]$', 1) AS label, regexp_extract(tokens[-1], '_([0-9]+) *\]$', 1)::BIGINT AS number FROM a"""
)
def token_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and parts of placeholders."""
    k = F.col("c_custkey").cast("string")
    seven = (F.col("c_custkey") % 7).cast("string")
    text = F.concat(F.lit("[NAME_"), seven, F.lit("] a [ID_"), k, F.lit(" ] b [NAME_"), seven, F.lit("]"), F.when(F.col("c_custkey") % 3 == 0, " [X_Y_2]").otherwise(" [x]"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.alias("text")).withColumn("last", F.element_at(T.placeholders(F.col("text")), -1))
    c = F.col("text")
    return t.select("k", P.n_tokens(c).alias("n_tokens"), P.n_distinct(c).alias("n_distinct"), P.looks_returned(c).alias("returned"), P.n_restored(c, F.array(F.lit("[ID_1]"))).alias("restored"), P.label_of(F.col("last")).alias("label"), P.index_of(F.col("last")).alias("number"))


@query("SELECT c_nationkey AS session, 'L' || c_custkey % 3 AS label, max(c_custkey) AS highest FROM customer GROUP BY ALL")
def highest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    token = F.concat(F.lit("[L"), (k % 3).cast("string"), F.lit("_"), k.cast("string"), F.lit("]"))
    return P.highest_index(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), token.alias("placeholder")), "session")


@query(
    """WITH t AS (SELECT c_custkey AS k, c_name, 'Mr. (' || c_name || '), [ID_' || c_custkey || '] end' AS text FROM customer)
SELECT k, '[ID_' || k || ']' AS token, NULL::VARCHAR AS no_token, c_name AS word, c_name AS at_edge, 'Mr' AS first, NULL::VARCHAR AS inside, 'end' AS last FROM t"""
)
def places_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placeholder and the word at an offset."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.length("c_name").alias("n"), F.concat(F.lit("Mr. ("), "c_name", F.lit("), [ID_"), F.col("c_custkey").cast("string"), F.lit("] end")).alias("text"))
    text, n = F.col("text"), F.col("n")
    return t.select("k", P.token_at(text, n + 8).alias("token"), P.token_at(text, F.lit(6)).alias("no_token"), P.word_at(text, F.lit(9)).alias("word"), P.word_at(text, n + 7).alias("at_edge"), P.word_at(text, F.lit(3)).alias("first"), P.word_at(text, n + 10).alias("inside"), P.word_at(text, F.length("text")).alias("last"))


@query(
    r"""SELECT doc_id, len(u) AS n_units, coalesce(list_sum(list_transform(u, lambda x: length(x))), 0)::BIGINT AS n_chars, coalesce(max(x), '') AS longest FROM (SELECT doc_id, u, unnest(CASE WHEN len(u) > 0 THEN u ELSE [''] END) AS x FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z֐-׿]+(?:[''’׳״][A-Za-z֐-׿]+)*|[0-9]+(?:[./-][0-9]+)*') AS u FROM documents)) GROUP BY doc_id, u"""
)
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and numbers of whole documents: how many, how long, and the last by code point."""
    t = docs(spark, sf_dir).select("doc_id", P.units(F.col("text")).alias("u"))
    chars = F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return t.select("doc_id", F.size("u").alias("n_units"), chars.alias("n_chars"), F.coalesce(F.array_max("u"), F.lit("")).alias("longest"))


@query(
    rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, text || CASE WHEN lang = 'en' THEN {_quoted(P.NOTES["en"])} ELSE {_quoted(P.NOTES["he"])} END AS noted FROM t),
s AS (SELECT doc_id, text, noted, regexp_replace(regexp_replace(noted, '\n*—{{3,}}(.|\n)*$', ''), '\[[A-Za-z]+_[0-9]+\]', ' ', 'g') AS plain FROM n),
c AS (SELECT doc_id, md5(noted) AS noted, md5(regexp_replace(noted, '\n*—{{3,}}(.|\n)*$', '')) AS back, length(regexp_replace(plain, '[^֐-׿]', '', 'g')) AS he, length(regexp_replace(plain, '[^A-Za-z]', '', 'g')) AS en FROM s)
SELECT doc_id, noted, noted AS again, back, CASE WHEN he = 0 AND en = 0 THEN 'en' WHEN he >= en THEN 'he' ELSE 'en' END AS language FROM c"""
)
def notes_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note to a model: added once, taken off, and never counted in the language of a text."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("lang") == "en", "en").otherwise("he").alias("lang"))
    t = t.withColumn("noted", P.with_note(F.col("text"), F.col("lang")))
    return t.select("doc_id", F.md5("noted").alias("noted"), F.md5(P.with_note(F.col("noted"), "en")).alias("again"), F.md5(P.without_note(F.col("noted"))).alias("back"), P.content_language(F.col("noted"), "en").alias("language"))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '["''׳״‘’]', '', 'g'), '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')) AS form FROM documents""")
def gold_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(P.gold_form(F.col("text"))).alias("form"))


@query(
    """SELECT c_custkey AS k, 'see |' || c_name || '1*| or |' || c_name || '*|.' AS parts, 'a' || chr(10) || chr(10) || 'b' || chr(10) || c_name AS blocks,
(SELECT string_agg(printf('%02X00', ascii(x)), '' ORDER BY i) FROM (SELECT unnest(string_split(c_name, '')) AS x, unnest(range(1, length(c_name) + 1)) AS i)) AS little, [3, 5, 9].list_filter(lambda x: x < c_custkey % 11).len()::INT AS n_before FROM customer"""
)
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked values (longest first), joined blocks, UTF-16 bytes, places before a place."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    longer = F.concat("c_name", F.lit("1"))
    text = F.concat(F.lit("see "), longer, F.lit(" or "), "c_name", F.lit("."))
    blocks = F.array(F.lit("a\n"), F.lit("\n\n"), F.lit("b"), F.concat("c_name", F.lit("\n\n")))
    return t.select("k", F.array_join(F.transform(P.marked(text, F.array("c_name", longer, F.lit(""), F.col("c_name"))), lambda x: F.concat(x["part"], F.when(x["hit"], "*").otherwise(""))), "|").alias("parts"), P.blocks_text(blocks).alias("blocks"), F.hex(P.utf16(F.col("c_name"))).alias("little"), P.n_before(F.array(F.lit(3), F.lit(5), F.lit(9)), F.col("k") % 11).alias("n_before"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'text/csv;charset=utf-8' ELSE 'application/octet-stream' END AS mime,
CASE c_custkey % 5 WHEN 2 THEN 'LEGACY_XLS_UNSUPPORTED' WHEN 4 THEN 'UNSUPPORTED' END AS refusal,
CASE WHEN c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 4 = 0) THEN 'hidden' WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN 'retry' WHEN c_custkey % 3 <> 0 AND (c_custkey % 7 = 1 OR c_custkey % 11 = 0) THEN 'pending' ELSE 'ready' END AS gate,
CASE c_custkey % 3 WHEN 0 THEN 'lowQuality' WHEN 1 THEN 'unsafe' END AS notice, CASE WHEN c_custkey % 2 = 0 THEN 'up' ELSE 'own' END AS active, CASE WHEN c_custkey % 3 <> 0 THEN 'up' END AS uploaded FROM customer"""
)
def small_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files, refusals, the download gate, notices, and which key is used."""
    k = F.col("k")
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    path = F.concat(F.lit("a.b/c."), F.element_at(F.array(*map(F.lit, ["PDF", "docx", "xls", "csv", "exe"])), (k % 5 + 1).cast("int")))
    ner = F.when(k % 7 == 0, "error").when(k % 7 == 1, "loading").otherwise("ready")
    gate = policy.download_gate(k % 2 != 0, k % 3 == 0, k % 4, F.lit("file"), ner, k % 11 == 0)
    message = F.when(k % 3 == 0, "Error: SCAN_LOW_CONFIDENCE (2)").when(k % 3 == 1, "SCAN_SELFVERIFY_FAILED").otherwise("other")
    up = F.when(k % 2 == 0, "up")
    return t.select("k", policy.mime_of(path).alias("mime"), policy.refusal(path).alias("refusal"), gate.alias("gate"), policy.scan_notice(message).alias("notice"), policy.active_key(up, F.lit("own")).alias("active"), policy.uploaded_after(F.lit("up"), k % 3 == 0).alias("uploaded"))


@query(
    r"""WITH u AS (SELECT page_id, unnest(['page', 'model', 'near', 'relative', 'blob', 'beacon', 'bad']) AS kind, url FROM pages),
v AS (SELECT page_id, kind, CASE kind WHEN 'page' THEN url WHEN 'model' THEN regexp_replace(url, '[a-z]+\.(com|net|org)', 'huggingface.co') WHEN 'near' THEN regexp_replace(url, '[a-z.-]+\.(com|net|org)', 'nothf.co') WHEN 'relative' THEN '/x/' || page_id WHEN 'blob' THEN 'blob:' || url WHEN 'beacon' THEN regexp_extract(url, '^(https?://[^/]*)', 1) || '/_vercel/insights/view' ELSE 'https:' END AS url FROM u),
h AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS own, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM v)
SELECT page_id, kind, kind IN ('blob', 'relative') OR own = 'https://blog.thin.example.com' OR host = 'huggingface.co' OR host LIKE '%.huggingface.co' AS allowed, kind = 'beacon' AND own = 'https://blog.thin.example.com' AS beacon FROM h"""
)
def request_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests may leave a page of one origin."""
    kinds = ["page", "model", "near", "relative", "blob", "beacon", "bad"]
    t = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "url")
    own = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    cases = {"page": F.col("url"), "model": F.expr("regexp_replace(url, '[a-z]+[.](com|net|org)', 'huggingface.co', 1)"), "near": F.regexp_replace("url", "[a-z.-]+\\.(com|net|org)", "nothf.co"), "relative": F.concat(F.lit("/x/"), F.col("page_id").cast("string")), "blob": F.concat(F.lit("blob:"), "url"), "beacon": F.concat(own, F.lit("/_vercel/insights/view")), "bad": F.lit("https:")}
    url = F.coalesce(*(F.when(F.col("kind") == n, c) for n, c in cases.items()))
    origin = F.lit("https://blog.thin.example.com")
    return t.select("page_id", "kind", policy.allowed_request(url, origin).alias("allowed"), policy.usage_beacon(url, origin).alias("beacon"))


@query(
    PLANTED_SQL + """SELECT k, [id] AS plain, ['גלים לון'] AS name_gap, ['גלים לון'] AS name_merged, []::VARCHAR[] AS name_inside, []::VARCHAR[] AS not_text, ['גלים לון', id] AS both FROM p"""
)
def part_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values left in the text parts of a file; names of several words with other gaps, or none."""
    from ..operators import verify

    p = planted(spark, sf_dir)
    needles = F.array(F.lit("גלים לון"), "id")
    found = lambda path, text: F.transform(verify.part_leaks(F.create_map(F.lit(path), text), needles), lambda h: h["needle"])
    return p.select(
        "k", found("word/a.xml", F.concat(F.lit("x "), F.substring("id", 1, 4), F.lit(" "), F.substring("id", 5, 5))).alias("plain"), found("a.rels", F.lit("עם גלים-לון.")).alias("name_gap"),
        found("a.XML", F.lit("עם גליםלון")).alias("name_merged"), found("a.xml", F.lit("מגלים לונה")).alias("name_inside"), found("a.png", F.col("id")).alias("not_text"), found("a.xml", F.concat(F.lit("גלים לון "), "id")).alias("both"),
    )


@query(
    """WITH t AS (SELECT c_custkey AS k, c_name AS text, 8 + c_custkey % 7 AS e FROM customer)
SELECT k, [substr(text, 1, 4) || '[P]', substr(text, (greatest(e, 6) + 1)::INT, greatest(0, 12 - greatest(e, 6))::INT), substr(text, (greatest(e, 12) + 1)::INT, greatest(0, 18 - greatest(e, 12))::INT)] AS segments, substr(text, 1, 4) || '[P]' || substr(text, (e + 1)::INT, (18 - e)::INT) AS whole, NULL::VARCHAR AS untouched FROM t"""
)
def overlay_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value over several segments: its placeholder in the first, its characters gone from all."""
    place = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("text"))
    reps = F.array(F.struct(F.lit(4).alias("start"), (8 + F.col("k") % 7).cast("int").alias("end"), F.lit("[P]").alias("placeholder")))
    tiles = F.array(*(place(F.lit(a), F.lit(a + 6)) for a in (0, 6, 12)))
    text = F.col("text")
    return t.select("k", overlay.overlaid(text, tiles, reps).alias("segments"), overlay.rewritten_range(text, reps, F.lit(0), F.lit(18)).alias("whole"), overlay.rewritten_range(text, reps, F.lit(5), F.lit(18)).alias("untouched"))


@query("SELECT count(*) AS n_docs, 0::BIGINT AS n_broken FROM documents")
def overlay_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's replacements laid over it in pieces of 50 characters give its masked text again."""
    t = masking.anonymize_deterministic(docs(spark, sf_dir)).where("text is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(50))
    tiles = F.transform(starts, lambda a: F.struct(a.alias("start"), F.least(a + 50, F.length("text")).alias("end")))
    laid = F.array_join(overlay.overlaid(F.col("text"), tiles, overlay.replacements(F.col("text"), F.col("spans"), F.col("key"))), "")
    return t.select((laid != F.col("anonymized")).cast("long").alias("broken")).agg(F.count("*").alias("n_docs"), F.sum("broken").alias("n_broken"))


@query(
    """WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS "start", l_linenumber * 10 + 7 AS "end", l_partkey AS seg FROM lineitem), r AS (SELECT o_orderkey AS doc, (o_custkey % 60)::INT AS a, (o_custkey % 60 + 9)::INT AS b FROM orders)
SELECT s.doc, seg, "start", a, a >= "start" AS begins FROM s JOIN r ON s.doc = r.doc AND a < "end" AND b > "start\""""
)
def segment_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements and the segments that they touch, as an interval join inside a document."""
    n, a = F.col("l_linenumber"), F.col("o_custkey") % 60
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (n * 10).alias("start"), (n * 10 + 7).alias("end"), F.col("l_partkey").alias("seg"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), a.cast("int").alias("start"), (a + 9).cast("int").alias("end"))
    return overlay.in_segments(s, r, "doc").select("doc", "seg", "start", F.col("r_start").alias("a"), "begins")


@query(
    """SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, string_agg(s::VARCHAR, ',' ORDER BY turn, text) AS starts FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM conversations) GROUP BY conv_id"""
)
def pages_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as pages of one text, a span of each moved."""
    own = F.array(T.span(F.lit(0), F.length("text"), "MANUAL", 1.0))
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text", own.alias("spans"))
    return overlay.one_document(t, "conv_id").select("conv_id", "text", F.array_join(F.transform("spans", lambda s: s["start"].cast("string")), ",").alias("starts"))


@query(
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE text IS NOT NULL AND length(text) > 0) SELECT doc_id, length(text)::INT AS reach, (length(text) - 1)::INT AS last_start FROM t"
)
def chunk_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans found in chunks, moved back: the last character of each chunk, of which the last is the text's."""
    from ..streaming import live

    t = docs(spark, sf_dir).where(F.length("text") > 0).withColumn("c", F.explode(files.chunked("text")))
    n = F.length("c.text")
    rows = t.select("doc_id", F.col("c.offset").alias("offset"), F.array(T.span(n - 1, n, "MANUAL", 1.0)).alias("spans"))
    last = F.element_at("spans", -1)
    return live.from_chunks(rows, "doc_id").select("doc_id", last["end"].alias("reach"), last["start"].alias("last_start"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'identifiers' WHEN 1 THEN 'people' WHEN 2 THEN 'places' END AS family, CASE WHEN c_custkey % 2 = 0 THEN ['IL_PHONE'] ELSE []::VARCHAR[] END AS known, c_custkey % 2 = 0 AS off FROM customer"""
)
def family_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of types, the stored list without what isn't known, and whether a family is off as a whole."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ["IL_BAR", "PERSON", "LOCATION", "CREDIT_CARD"])), (k % 4 + 1).cast("int"))
    stored = F.when(k % 2 == 0, F.array(F.lit("IL_PHONE"), F.lit("NOVEL"))).otherwise(F.array(F.lit("NOVEL")))
    off = F.when(k % 2 == 0, F.array(F.lit("IL_PHONE"), F.lit("EMAIL_ADDRESS"))).otherwise(F.array(F.lit("IL_PHONE")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), E.family_of(kind).alias("family"), E.known_types(stored).alias("known"), E.family_off(off, "contact").alias("off"))


@query(PLANTED_SQL + "SELECT k, 'רק [CLIENT_1] ו-[TERM_1], לא ' || id || '9 או ' || id AS anonymized FROM p")
def manual_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's own terms alone, with and without a label; a term inside a longer word isn't one."""
    p = planted(spark, sf_dir).select("k", F.concat(F.lit("רק Acme ו-Dana, לא "), "id", F.lit("9 או "), "id").alias("text"))
    return masking.anonymize_manual(p, [(" Acme ", "CLIENT"), ("Dana", None), ("", None)]).select("k", "anonymized")


@query(PLANTED_SQL + "SELECT k, '[COMPANY_1] [PASSPORT_1] [CASE_1] [SSN_1] [CARD_1]' AS anonymized FROM p")
def more_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that other planted texts lack: a labelled company number, a passport of nine digits, a prefixed case, SSN and card with separators."""
    parts = F.concat(F.lit("ח.פ "), "company", F.lit(" דרכון 1"), "seven", F.lit("3 ע\"א "), F.expr("substr(seven, 3)"), F.lit("/21 no. 123-45-6789 4111-1111-1111-1111"))
    p = masking.anonymize_deterministic(planted(spark, sf_dir).select("k", parts.alias("text")))
    return p.select("k", F.regexp_replace("anonymized", "ח\\.פ |דרכון |ע\"א |no\\. ", "").alias("anonymized"))


@query(PLANTED_SQL + "SELECT k, true AS ssn, true AS card, false AS short, true AS two_words, false AS one_word, true AS structured, false AS trunk, true AS trunk_ok FROM p")
def confidence_and_trunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors that count by their leak form, and +972 numbers with a 0 too many."""
    from ..functions import validators as V
    from ..operators import verify

    sure = lambda value, kind: verify.high_confidence(F.struct(value.alias("original"), F.lit(kind).alias("type")))
    p = planted(spark, sf_dir)
    return p.select("k", sure(F.concat(F.lit("123-45-6"), F.substring("seven", 5, 3)), "US_SSN").alias("ssn"), sure(F.lit("4111-1111-1111-1111"), "CREDIT_CARD").alias("card"), sure(F.lit("1-23"), "IL_BAR").alias("short"), sure(F.lit(" Dana  Levi "), "PERSON").alias("two_words"), sure(F.lit("Dana"), "PERSON").alias("one_word"), sure(F.lit("a@b.co"), "EMAIL_ADDRESS").alias("structured"), V.israeli_phone(F.concat(F.lit("+972-052-"), "seven")).alias("trunk"), V.israeli_phone(F.concat(F.lit("+972-52-"), "seven")).alias("trunk_ok"))


@query(PLANTED_SQL + "SELECT k, 'x ' || id || ' y' AS text, id AS number, recognised FROM (SELECT *, true AS recognised FROM p)")
def safe_to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a guard would hold back."""
    from ..streaming import live

    p = planted(spark, sf_dir).select("k", F.concat(F.lit("x "), "id", F.lit(" y")).alias("text"), F.col("id").alias("number"))
    return p.withColumn("recognised", ~live.safe_to_send(F.col("text")))

