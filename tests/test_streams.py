"""Sessions as tables and as streams: one key a session, numbers that go on, state that expires."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillveil.operators import keys, masking, sessions
from quillveil.streaming import live

TEXTS = [
    ("a", 0, "טל 052-1234567 ומייל dana@example.com"), ("a", 1, "שוב dana@example.com וגם 052-7654321, [PHONE_3]"), ("a", 2, "עוד 054-1111111 ו-052-1234567"),
    ("b", 0, "מייל x@y.co"), ("b", 1, "אין כאן דבר"), ("b", 2, "x@y.co z@y.co"),
]


def plain_session(texts):
    """One text after the other, by hand."""
    own = live.SessionKey([])
    return [own.masked(t) for t in texts], own.rows


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "session string, step long, text string").repartition(3)


def test_a_session_keeps_its_placeholders(texts):
    out, key = sessions.redacted(texts)
    got = {(r.session, r.step): r.anonymized for r in out.collect()}
    for s in "ab":
        want, rows = plain_session([t for x, _, t in TEXTS if x == s])
        assert [got[s, n] for n in range(3)] == want
        assert sorted((r.placeholder, r.original, r.type) for r in key.where(F.col("session") == s).collect()) == sorted(map(tuple, rows))
    assert got["a", 0] == "טל [PHONE_1] ומייל [EMAIL_1]" and got["a", 1] == "שוב [EMAIL_1] וגם [PHONE_2], [PHONE_3]" and got["a", 2].startswith("עוד [PHONE_")
    back = sessions.restored(out.select("session", "step", F.col("text").alias("source"), F.col("anonymized").alias("text")), key)
    assert all(r.restored.replace("[PHONE_3]", "x") == r.source.replace("[PHONE_3]", "x") or r.step == 1 for r in back.collect())


def test_numbers_go_on_and_skip_what_stands_in_a_text(spark):
    known = spark.createDataFrame([("a", "IL_PHONE", "old", "[PHONE_7]"), ("a", "PERSON", "n", "[NAME_2]"), ("b", "IL_PHONE", "z", "[PHONE_1]")], "session string, type string, original string, placeholder string")
    steps = [("a", 0, 0, "PHONE", "old", "IL_PHONE", ["[PHONE_8]"]), ("a", 0, 1, "PHONE", "p1", "IL_PHONE", ["[PHONE_8]", "[PHONE_9]"]), ("a", 1, 0, "PHONE", "p2", "IL_PHONE", []), ("a", 1, 1, "PHONE", "p1", "IL_PHONE", []), ("a", 2, 0, "NAME", "m", "PERSON", []), ("c", 0, 0, "NAME", "n", "PERSON", [])]
    rows = spark.createDataFrame(steps, "session string, step int, pos int, label string, original string, type string, present array<string>")
    got = {(r.session, r.original): r.placeholder for r in sessions.session_key(rows, known).collect()}
    assert got == {("a", "p1"): "[PHONE_10]", ("a", "p2"): "[PHONE_11]", ("a", "m"): "[NAME_3]", ("c", "n"): "[NAME_1]"}
    assert sessions.session_key(rows.limit(0), known).count() == 0
    whole = keys.merged(known.select("session", "placeholder"), sessions.session_key(rows, known).select("session", "placeholder"), ["session", "placeholder"])
    assert whole.count() == 7 and sessions.cleared(whole, spark.createDataFrame([("a",)], "session string")).count() == 2


def feed(tmp_path, name, rows):
    """A file of rows; a stream reads files in order of their times."""
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_700_000_000 + int(path.stem),) * 2)


def run(stream, tmp_path, name, rows=None):
    """What a stream gives for the files that are there; one that waits for timeouts doesn't end by itself, but has ``rows`` to give."""
    out = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"check-{name}"))
    q = (out if rows else out.trigger(availableNow=True)).start()
    if rows:
        until = time.time() + 60
        while time.time() < until and q.isActive and stream.sparkSession.table(name).count() < rows:
            time.sleep(0.5)
        q.stop()
    else:
        assert q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def read(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(str(path))


def test_a_stream_of_sessions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):  # a batch for each step
        feed(src, f"{n}.json", [{"session": s, "step": k, "text": t} for s, k, t in TEXTS if k == n])
    got = {(r.session, r.step): (r.anonymized, r.n_key) for r in run(live.session_stream(read(spark, src, "session string, step long, text string")), tmp_path, "sessions", rows=len(TEXTS))}
    for s in "ab":
        want, rows = plain_session([t for x, _, t in TEXTS if x == s])
        assert [got[s, n][0] for n in range(3)] == want and got[s, 2][1] == len(rows)


def test_masking_and_restoring_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    feed(src, "0.json", [{"session": "a", "text": "mail dana@example.com"}, {"session": "b", "text": "[EMAIL_1] [NAME_9]"}])
    stream = read(spark, src, "session string, text string")
    masked = run(live.masked_stream(stream).select("session", "anonymized"), tmp_path, "masked")
    assert {r.session: r.anonymized for r in masked} == {"a": "mail [EMAIL_1]", "b": "[EMAIL_1] [NAME_9]"}
    static = spark.createDataFrame([("b", [("[EMAIL_1]", "x@y.co", "EMAIL_ADDRESS")])], f"session string, key {masking.KEY}")
    back = run(live.restored_stream(stream, static), tmp_path, "back")
    assert {r.session: (r.restored, r.unmatched) for r in back} == {"a": ("mail dana@example.com", []), "b": ("x@y.co [NAME_9]", ["[NAME_9]"])}


def test_uses_of_a_key_close_after_their_time(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    times = [("a", "2024-01-01T00:00:00"), ("a", "2024-01-01T20:00:00"), ("a", "2024-01-03T00:00:00"), ("b", "2024-01-01T05:00:00"), ("b", "2024-01-10T00:00:00")]
    for n, (s, t) in enumerate(times):
        feed(src, f"{n}.json", [{"session": s, "ts": t}])
    feed(src, "9.json", [{"session": "z", "ts": "2024-02-01T00:00:00"}])
    rows = run(live.key_uses(read(spark, src, "session string, ts timestamp", files=10)), tmp_path, "uses")
    assert sorted((r.session, r.uses, str(r.seen_at)) for r in rows) == [("a", 1, "2024-01-03 00:00:00"), ("a", 2, "2024-01-01 20:00:00"), ("b", 1, "2024-01-01 05:00:00"), ("b", 1, "2024-01-10 00:00:00")]


class Timed:
    """A group's state that has run out."""

    hasTimedOut, exists, removed = True, True, False

    def remove(self):
        self.removed = True


def test_a_key_that_ran_out_is_gone():
    state = Timed()
    assert list(live._masked(("a",), iter([]), state, 1)) == [] and state.removed
