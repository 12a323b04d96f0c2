"""Pages and channels masked as one document; recorded names."""

import pytest
from pyspark.sql import functions as F

from quillveil.operators import layered, recognizers

LINES = {1: {0: ["דרכון 31847205", "tel 052-1234567"], 1: ["x 31-847-205"]}, 2: {0: ["  "]}, 3: {0: ["nothing here"]}}


def test_layers_share_one_key(spark):
    rows = [(d, p, n, k, c, [10.0 * k, 20.0 * n, 10.0 * k + 8, 20.0 * n, 10.0 * k + 8, 20.0 * n + 12, 10.0 * k, 20.0 * n + 12]) for d, ps in LINES.items() for p, ls in ps.items() for n, t in enumerate(ls) for k, c in enumerate(t)]
    glyphs = spark.createDataFrame(rows, "doc int, page int, line int, pos int, ch string, quad array<double>").repartition(3)
    beside = spark.createDataFrame([(1, "outline", 0, "About 052-1234567"), (1, "outline", 1, "Plain"), (1, "form", 0, "a@b.co"), (3, "form", 0, "")], "doc int, channel string, ord int, value string")
    docs, rects, new = layered.redacted(glyphs, beside)
    got = {r.doc: r for r in docs.collect()}
    assert got[1].anonymized == "דרכון [PASSPORT_1]\ntel [PHONE_1]\n\nx [PASSPORT_2]\n[EMAIL_1]\nAbout [PHONE_1]\nPlain" and got[1].left == [] and got[1].error is None
    assert got[2].error == layered.NO_TEXT and got[3].anonymized.startswith("nothing here") and not got[3].key
    assert sorted((r.page, r.token, r.x0, r.y0, r.x1, r.y1) for r in rects.collect()) == [(0, "[PASSPORT_1]", 60.0, 0.0, 138.0, 12.0), (0, "[PHONE_1]", 40.0, 20.0, 148.0, 32.0), (1, "[PASSPORT_2]", 20.0, 0.0, 118.0, 12.0)]
    assert sorted((r.channel, r.ord, r.value) for r in new.collect()) == [("form", 0, "[EMAIL_1]"), ("outline", 0, "About [PHONE_1]")]
    assert docs.where(F.size("left") > 0).count() == 0


@pytest.mark.parametrize("text, raw, lang, want", [
    ("דָּנָה  לוי פה", [("B-PER", "דנה לוי")], None, ["דָּנָה  לוי"]),
    ("דנה\nלוי", [("PER", "דנה לוי")], "he", ["דנה\nלוי"]),
    ("Dana Levinson", [("PER", "Dana Lev ##in")], "en", ["Dana Levinson"]),
    ("Dana Levinson", [("PER", "Dana Lev")], "he", ["Dana Lev"]),
    ("Dana, Dana", [("PER", "Dana"), ("PER", "Dana"), ("PER", "Dana")], None, ["Dana", "Dana", "Dana"]),
    ("a", [("PER", "absent"), ("MISC", "a"), ("PER", " ##"), ("", "a")], None, []),
])
def test_recorded_names(text, raw, lang, want):
    got = recognizers.align_ner(text, [{"raw": t, "surface": s, "score": 1.0} for t, s in raw], lang)
    assert [text[s["start"] : s["end"]] for s in got] == want
