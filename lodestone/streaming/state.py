"""Operators that keep state of their own for each key of a stream: answers that are checked as they are sent, and memories that expire.

Both run as transformWithState, whose state lies in RocksDB and is restored from the stream's checkpoint after a loss.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import safety

#: Characters that stay back at least, and at most: a possible secret that is longer than that counts as one.
OVERLAP, MOST_HELD = 32, 1 << 16
#: The state store that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = [*safety.SECRETS, *safety.PERSONAL]
#: Characters that may stand inside a secret or personal value; a text is only cut behind others.
_INSIDE = regex.compile(r"[A-Za-z0-9._%+\-@:/]")


@lru_cache(None)
def _rules() -> list[tuple[regex.Pattern, str, bool]]:
    return [(regex.compile(p, regex.A), name, k < len(safety.SECRETS)) for k, (p, name) in enumerate(_KINDS)]


def cut_of(pending: str, last: bool, overlap: int = OVERLAP) -> int:
    """How much of the text can be judged now: no match, and nothing that may become one, goes over the cut."""
    if last:
        return len(pending)
    cut = len(pending) - overlap
    spans = []
    for rule, _, _ in _rules():
        for m in rule.finditer(pending, partial=True):
            spans.append((m.start(), len(pending) + 1 if m.partial or m.end() == len(pending) else m.end()))
    while cut > 0:
        if _INSIDE.match(pending, cut - 1) and cut < len(pending):
            cut -= 1
            continue
        over = min((s for s, e in spans if s < cut < e), default=None)
        if over is None:
            return cut
        cut = over
    return 0


def judged(text: str, strict: bool) -> tuple[str, str, list[str]]:
    """(action, what may be sent, kinds) of a piece of an answer that is cut by cut_of()."""
    out, kinds, secret, personal = text, [], False, False
    for rule, name, is_secret in _rules():
        if rule.search(text):
            kinds.append(name)
            secret |= is_secret
            personal |= not is_secret
            if is_secret or strict:
                out = rule.sub(f"[REDACTED:{name.upper()}]", out)
    if strict and secret:
        return "block", "", kinds
    return ("redact" if secret or strict and personal else "allow"), out, kinds


class AnswerCheck(StatefulProcessor):
    """Sends a stream of chunks on as soon as nothing in them can be part of a secret. What blocks is never sent, nor is anything after it.

    Chunks are numbered from 0; one that is early waits for those before it, one that came before is left out, so a source that repeats itself
    does no harm. The state of an answer goes with its last chunk, but for its number of chunks.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "pending string, next int, blocked boolean, sent int, done boolean")
        self.early = handle.getMapState("early", "seq int", "text string, last boolean, strict boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pending, expected, blocked, sent, done = self.held.get() if self.held.exists() else ("", 0, False, 0, False)
        for r in rows:
            if r["seq"] >= expected and not done:
                self.early.updateValue((r["seq"],), (r["text"], r["last"], r["strict"]))
        out = []
        while not done and self.early.containsKey((expected,)):
            text, last, strict = self.early.getValue((expected,))
            self.early.removeKey((expected,))
            expected += 1
            done = bool(last)
            if blocked:
                continue
            pending += text or ""
            cut = cut_of(pending, done)
            action, content, kinds = judged(pending[:cut], strict)
            if not cut and len(pending) > MOST_HELD:  # what may be a secret is taken for one
                action, content, kinds, cut = ("block" if strict else "redact"), ("" if strict else "[REDACTED:TOO_LONG]"), ["too_long"], len(pending)
            pending = pending[cut:]
            if action == "block":
                blocked, pending = True, ""
            if content or action == "block":
                out.append((key[0], sent, action, content, kinds))
                sent += 1
        self.held.update((pending, expected, blocked, sent, done))
        return iter([Row(stream_id=k, part=p, action=a, content=c, kinds=n) for k, p, a, c, n in out])

    def close(self) -> None:
        pass


def checked_answers(chunks: DataFrame) -> DataFrame:
    """(stream_id, part, action, content, kinds): the parts of each answer that may be sent, in order of part.

    chunks: a stream of (stream_id long, seq int, text, last boolean, strict boolean). Needs the RocksDB state store: see PROVIDER.
    """
    slim = chunks.select(F.col("stream_id").cast("long"), F.col("seq").cast("int"), "text", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce("strict", F.lit(True)).alias("strict"))
    return slim.groupBy("stream_id").transformWithState(AnswerCheck(), "stream_id long, part int, action string, content string, kinds array<string>", "append", "none")


class SessionMemory(StatefulProcessor):
    """The last entries of a session, none older than `ttl` behind its latest; a session without entries for so long is forgotten.

    Its state never holds more than `most` entries. Each change gives the session's entries anew under the next version, an expiry an empty one.
    """

    def __init__(self, most: int, ttl: datetime.timedelta):
        self.most, self.ttl = most, ttl // datetime.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "micros long, entry_id long")
        self.version = handle.getValueState("version", "version long, timer long")

    def _rows(self, key, version: int, entries: list) -> Iterator[Row]:
        if not entries:
            return iter([Row(session_id=key[0], version=version, entry_id=None)])
        return iter([Row(session_id=key[0], version=version, entry_id=e) for _, e in entries])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [(e[0], e[1]) for e in self.entries.get()] if self.entries.exists() else []
        version, timer = self.version.get() if self.version.exists() else (0, 0)
        known += [(r["micros"], r["entry_id"]) for r in rows]
        known = sorted(set(known))
        known = [e for e in known if e[0] > known[-1][0] - self.ttl][-self.most :]
        if timer:
            self.handle.deleteTimer(timer)
        due = (known[-1][0] + self.ttl) // 1000 + 1
        self.handle.registerTimer(due)
        self.entries.put(known)
        self.version.update((version + 1, due))
        return self._rows(key, version + 1, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, _ = self.version.get()
        self.entries.clear()
        self.version.update((version + 1, 0))
        return self._rows(key, version + 1, [])

    def close(self) -> None:
        pass


def session_memory(entries: DataFrame, most: int = 4, ttl: datetime.timedelta = datetime.timedelta(hours=48), late: str = "0 seconds") -> DataFrame:
    """(session_id, version, entry_id): what each session's memory holds after each change; entry_id null where it holds nothing.

    entries: a stream of (session_id long, entry_id long, ts timestamp).
    """
    timed = entries.select(F.col("session_id").cast("long"), F.col("entry_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("session_id").transformWithState(SessionMemory(most, ttl), "session_id long, version long, entry_id long", "append", "EventTime")


def newest(versions: DataFrame) -> DataFrame:
    """(session_id, entry_id) of the last version of each session, from all rows that session_memory() gave."""
    last = versions.groupBy("session_id").agg(F.max("version").alias("version"))
    return versions.join(last, ["session_id", "version"]).where("entry_id is not null").select("session_id", "entry_id")
