"""Queries do their job on all rows, with the operators' own settings."""

from pyspark.sql import functions as F

from quillveil.operators import keys, masking, verify
from quillveil.plans import catalog

SF = "/root/testdata/sf0.001"


def test_key_encryption_takes_every_customer_and_the_full_derivation(spark, monkeypatch):
    rounds, derived = [], keys._derived
    monkeypatch.setattr(keys, "_derived", lambda passphrase, salt, iterations: (rounds.append(iterations), derived(passphrase, salt, iterations))[1])
    got = catalog.key_encryption(spark, SF).collect()
    names = {r.c_custkey: r.c_name for r in catalog.table(spark, SF, "customer").collect()}
    assert {r.k: r.plain for r in got} == names and len(got) == len(names)
    assert {(r.status, r.wrong, r.invalid) for r in got} == {("ok", "WRONG_PASSPHRASE", "INVALID_KEY_FILE")}
    assert rounds == [600_000]


def test_leak_spans_find_words_and_numbers(spark):
    text = "כהן פגש את מכהן, mail dana@example.com (a@dana@example.com) a a a +972-52-1234567; 05-2-1 גלים בע\"מ \\Q.\\E 12.07.1981"
    key = [("כהן", "PERSON"), (" dana@example.com ", "EMAIL_ADDRESS"), ("a a", "MANUAL"), ("+972-52-1234567", "IL_PHONE"), ("0521", "IL_BAR"), ("גלים בע\"מ", "ORGANIZATION"), ("\\Q.\\E", "MANUAL"), ("12.07.1981", "DATE_OF_BIRTH"), ("", "MANUAL"), (" ", "MANUAL"), (None, "MANUAL"), ("absent", "MANUAL")]
    rows = spark.createDataFrame([(text, [("[X_1]", o, t) for o, t in key]), (None, []), ("", [("[X_1]", "x", "MANUAL")])], f"text string, key {masking.KEY}")
    got = rows.select(verify.leak_spans(F.col("text"), F.col("key")).alias("s")).collect()
    found = sorted((s.start, text[s.start : s.end], s.type) for s in got[0].s)
    mail = text.index("dana@")
    assert found == sorted([(0, "כהן", "PERSON"), (mail, "dana@example.com", "EMAIL_ADDRESS"), (text.index("a@dana") + 2, "dana@example.com", "EMAIL_ADDRESS"), (text.index("a a a"), "a a", "MANUAL"), (text.index("a a a") + 2, "a a", "MANUAL"), (text.index("+972"), "+972-52-1234567", "IL_PHONE"), (text.index("05-2"), "05-2-1", "IL_BAR"), (text.index("גלים"), "גלים בע\"מ", "ORGANIZATION"), (text.index("\\Q"), "\\Q.\\E", "MANUAL"), (text.index("12.07"), "12.07.1981", "DATE_OF_BIRTH")])
    assert not got[1].s and not got[2].s


def test_planted_filters_reveal_every_customers_id(spark, monkeypatch):
    customers = [*range(50, 1300, 50), *range(6190, 7450, 90), 9000, 15000]
    monkeypatch.setattr(catalog, "table", lambda *a: spark.createDataFrame([(k,) for k in customers], "c_custkey long"))
    rows = {r.k: r for r in catalog.planted(spark, SF).collect()}
    got = {r.k: r.anonymized for r in catalog.planted_filters(spark, SF).where("option = 'id_revealed'").collect()}

    def want(r):
        if r.id[0] == "5":  # the checksum of company numbers is that of ids
            return 'ת"ז [COMPANY_1] טל [PHONE_1]'
        return 'ת"ז [PHONE_1] טל [PHONE_2]' if r.id[:2] in ("02", "03", "04", "08", "09") else f'ת"ז {r.id} טל [PHONE_1]'

    assert {r.id[:2] for r in rows.values()} >= {f"0{d}" for d in range(1, 10)} | {"50", "59"}
    assert got == {k: want(r) for k, r in rows.items()}
