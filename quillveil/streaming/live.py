"""Streams: masking and restoring are projections, so they run on a stream as on a table; a session's key is state that expires."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import document, masking, recognizers

HOURS = 24


def masked_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans, key and anonymized to a stream of documents."""
    return masking.anonymize_deterministic(rows, text)


def restored_stream(answers: DataFrame, keys: DataFrame, by: str = "session", text: str = "text") -> DataFrame:
    """A stream of answers joined with a static table (session, key), with restored and unmatched added."""
    rows = answers.join(keys, by, "left")
    whole, unknown = masking.restored(F.col(text), F.coalesce("key", F.expr(f"cast(array() as {masking.KEY})")))
    return rows.withColumn("restored", whole).withColumn("unmatched", unknown).drop("key")


def safe_to_send(text: Column) -> Column:
    """Whether a text holds nothing that a rule finds: what guards a draft before it goes out."""
    return ~(text.rlike(recognizers.CANDIDATE) | text.rlike(T.UNUSUAL)) | (F.size(masking._found(text)) == 0)


def key_uses(events: DataFrame, hours: int = HOURS, delay: str = "1 hour") -> DataFrame:
    """Per session the use of its key in windows that close after ``hours`` without use."""
    return events.withWatermark("ts", delay).groupBy("session", F.session_window("ts", f"{hours} hours")).agg(F.count("*").alias("uses"), F.max("ts").alias("seen_at"))


class SessionKey:
    """A session's key as a stream sees it: values and their placeholders, the highest number of each label."""

    def __init__(self, rows: list[list[str]]) -> None:
        self.rows = rows
        self.tokens = {(kind, value): token for token, value, kind in rows}
        self.highest: dict[str, int] = {}
        for token, _, _ in rows:
            self._seen(token)

    def _seen(self, token: str) -> None:
        label, n = token[1:-1].rsplit("_", 1)
        if n.isdigit():
            self.highest[label] = max(self.highest.get(label, 0), int(n))

    def masked(self, text: str) -> str:
        """The text masked with this key, which takes up its new values."""
        _, own, out = document.process(text, recognizers.found(text), remainders=True)
        taken = {document.plain_token(t) for t in document.TOKEN.findall(text)}
        swap = {}
        for token, value, kind in own:
            if (kind, value) not in self.tokens:
                label = token[1:].rsplit("_", 1)[0]
                n = self.highest.get(label, 0) + 1
                while document.plain_token(f"[{label}_{n}]") in taken:
                    n += 1
                self.tokens[kind, value] = f"[{label}_{n}]"
                self.rows.append([self.tokens[kind, value], value, kind])
                self._seen(self.tokens[kind, value])
            swap[token] = self.tokens[kind, value]
        return document.TOKEN.sub(lambda m: swap.get(m[0], m[0]), out)


MASKED, STATE = "session string, step long, anonymized string, n_key int", "key string"


def _masked(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, millis: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # nobody came for so long: the key is gone
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("step", ignore_index=True)
    own = SessionKey(json.loads(state.get[0]) if state.exists else [])
    texts = [own.masked(t or "") for t in rows["text"]]
    state.update((json.dumps(own.rows),))
    state.setTimeoutDuration(millis)
    yield pd.DataFrame({"session": key[0], "step": rows["step"], "anonymized": texts, "n_key": len(own.rows)})


def session_stream(rows: DataFrame, hours: float = HOURS) -> DataFrame:
    """A stream of texts (session, step, text) masked with one key a session, which lives until ``hours`` without use: session, step, anonymized, n_key."""
    millis = int(hours * 3_600_000)
    run = lambda key, batches, state: _masked(key, batches, state, millis)
    return rows.groupBy("session").applyInPandasWithState(run, MASKED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def upgraded(first: DataFrame, second: DataFrame, by: str = "doc_id") -> DataFrame:
    """Results in two steps: the second step's rows stand instead of the first's where they have come."""
    return first.join(second.select(by), by, "left_anti").unionByName(second.select(*first.columns))


def with_names(rows: DataFrame, names: str = "names", text: str = "text") -> DataFrame:
    """Masks with the spans of a model that may not have answered: null means it hasn't, an empty array that it found no names."""
    done = masking.anonymize_with(rows, extra=F.coalesce(F.col(names), T.no_spans()), text=text)
    return done.withColumn("names_checked", F.col(names).isNotNull())


def once_a_text(rows: DataFrame, found: Column, text: str = "text", out: str = "found") -> DataFrame:
    """Adds ``found``, worked out once for each distinct text."""
    known = rows.select(text).distinct().withColumn(out, found).withColumnRenamed(text, "_text")
    return rows.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def from_chunks(chunks: DataFrame, *keys: str) -> DataFrame:
    """Spans of the chunks of a text (keys, offset, spans) as spans of the text: keys, spans. The order is that of the text."""
    moved = F.transform("spans", lambda s: T.span(s["start"] + F.col("offset"), s["end"] + F.col("offset"), s["type"], s["score"], s["label"]))
    return chunks.withColumn("spans", moved).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
