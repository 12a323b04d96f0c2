"""Detection in its two forms, and whole masking against a plain model."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillveil.functions import entities as E
from quillveil.functions import text as T
from quillveil.operators import document, masking, recognizers

PIECES = [
    "123456709", "12345670-9", "052-1234567", "+972-52-1234567", "+972-052-1234567", "(02) 624-1234", "512345679", "IL620108000000099999999", "IL62 0108-0000 0009 9999 999",
    "ת\"ז: 1234-56709", "תעודת זהות 0375412", "ח.פ 514872903", "דרכון 31847205", "דרכון 123456709", "מ.ר. 42817", "מספר רישיון עו\"ד 42817", "יליד 14.07.1981", "תיק מספר 12345/21",
    "1234567-03-22", "ע\"א 123/21", "בג\"ץ 1234-05-20", "רע\"א  77/98", "גוש 123, חלקה 45/6", "פוליסת ביטוח מספר 123456/7", "מבוטח מס' 12345", "4111-1111-1111-1111", "4111 1111 1111 1112",
    "123-45-6789", "666-45-6789", "(212) 555-0199", "+1 212-555-0199", "dana@example.com", "x.y@z.co.il,", "נגד גלים כהן בע\"מ", "החברה בע\"מ", "12‏3456709", "１２３４５６７０９", "٠٥٢١٢٣٤٥٦٧",
    "plain words", "שלום לכולם", "\n", "2024", "[ID_1]", "עמותת אור ע״ר", "­052­1234567",
]


def texts(n=250):
    rng = random.Random(11)
    return [rng.choice(["", " ", ", ", "; "]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)] + ["", "x", "9" * 400, "ת\"ז" * 50, "0" * 60]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i int, text string").repartition(3)


def test_both_forms_of_detection_agree(rows):
    native = {r.i: [tuple(s) for s in r._found] for r in masking.with_found_native(rows, "text").collect()}
    arrow = {r.i: [tuple(s) for s in r._found] for r in masking.with_found(rows, "text").collect()}
    own = {i: recognizers.found(t) for i, t in enumerate(texts())}
    assert arrow == {i: [tuple(s) for s in f] for i, f in own.items()}
    assert native == arrow and sum(map(len, native.values())) > 400
    assert {s[2] for f in arrow.values() for s in f} >= {r.kind for r in recognizers.RULES} | {"EMAIL_ADDRESS", "ORGANIZATION"}


def weaker(a, b):
    """Whether span a loses to span b."""
    priority = {t[0]: t[2] for t in E.TYPES}
    x, y = ((-priority[s[2]], -s[3], s[0] - s[1], s[0]) for s in (a, b))
    if x != y:
        return x > y
    if {a[2], b[2]} == {"ISRAELI_ID", "IL_PHONE"}:
        return a[2] == "IL_PHONE"
    return a[2] > b[2]


def model(text):
    """Masking by the rules' plain words: strongest first, every whole-word occurrence, numbers by first appearance."""
    def resolve(spans):
        left, kept = list(spans), []
        while left:
            best = left[0]
            for s in left[1:]:
                if weaker(best, s):
                    best = s
            kept.append(best)
            left = [s for s in left if s[1] <= best[0] or best[1] <= s[0]]
        return sorted(kept)

    base = resolve([s[:4] for s in recognizers.found(text)])
    word = re.compile(f"[{document.WORD}]")
    more = []
    for a, b, kind, score in base:
        v = text[a:b]
        for k in range(len(text) - len(v) + 1):
            if text[k : k + len(v)] == v and not (k and word.match(text[k - 1])) and not (k + len(v) < len(text) and word.match(text[k + len(v)])):
                more.append((k, k + len(v), kind, score))
    used = resolve(base + more)
    key, out, at = {}, "", 0
    present = {re.sub("[\\s\"'‎‏]", "", t) for t in re.findall(r"\[[^\[\]]*_[0-9]+\s*\]", text)}
    for a, b, kind, _ in used:
        label = dict((t[0], t[1]) for t in E.TYPES)[kind]
        if (label, text[a:b]) not in key:
            n = max([int(v.rsplit("_", 1)[1][:-1]) for (x, _), v in key.items() if x == label], default=0) + 1
            while f"[{label}_{n}]" in present:
                n += 1
            key[label, text[a:b]] = f"[{label}_{n}]"
        out += text[at:a] + key[label, text[a:b]]
        at = b
    return out + text[at:], list(key.values())


def test_masking_matches_a_plain_model(rows):
    got = {r.i: (r.anonymized, [k.placeholder for k in r.key]) for r in masking.anonymize_deterministic(rows).collect()}
    want = {i: model(t) for i, t in enumerate(texts())}
    assert got == want


def test_masking_whole_documents_matches_the_plain_model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: (r.anonymized, [k.placeholder for k in r.key]) for r in masking.anonymize_deterministic(rows).collect()}
    assert got == {r.doc_id: model(r.text) for r in rows.collect()}


@pytest.mark.parametrize("pair, wins", [
    (("IL_PASSPORT", "ISRAELI_ID"), "IL_PASSPORT"), (("IL_PASSPORT", "IL_PHONE"), "IL_PASSPORT"), (("ISRAELI_ID", "IL_PHONE"), "ISRAELI_ID"), (("IL_COMPANY", "ISRAELI_ID"), "IL_COMPANY"), (("IL_BAR", "IL_INSURED"), "IL_BAR"),
])
def test_types_on_one_span_go_by_name(spark, pair, wins):
    from quillveil.operators import spans

    for order in (pair, pair[::-1]):
        found = [(0, 9, t, 1.0, None) for t in order]
        assert [s[2] for s in document.resolved(found)] == [wins]
        row = spark.createDataFrame([(found,)], f"s {T.SPANS}")
        assert [s.type for s in row.select(spans.resolved(F.col("s")).alias("s")).first().s] == [wins]


def test_a_labelled_passport_of_nine_digits_is_a_passport(spark):
    rows = masking.anonymize_deterministic(spark.createDataFrame([("דרכון 123456709 בתוקף",)], "text string"))
    assert rows.first().anonymized == "דרכון [PASSPORT_1] בתוקף"


def test_one_mark_in_a_long_text_costs_little(spark):
    """Native places of a long text with a direction mark: in proportion to its length."""
    def took(n, mark):
        text = ("מילה " * n)[:n] + mark + " 123456709"
        row = spark.createDataFrame([(text,)], "text string").select("text", F.array(T.span(F.lit(3), F.lit(4), "ISRAELI_ID", 1.0)).alias("s"))
        began = time.time()
        got = row.select(T.from_shadow(F.col("text"), F.col("s")).alias("s")).first().s
        return got, time.time() - began

    took(100, "‏")
    assert took(400_000, "‏")[0] == [(3, 4, "ISRAELI_ID", 1.0, None)]
    assert took(400_000, "‏")[1] < 5
