"""Model answers that arrive in chunks: each stream is cut at its end marker, wherever the chunks break."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PIECES = "stream string, seq long, piece string, status string"


def fallback_lengths(marker: str) -> list[int]:
    """For each prefix of the marker, the length of its longest proper prefix that it also ends with."""
    table, k = [0] * len(marker), 0
    for i in range(1, len(marker)):
        while k and marker[i] != marker[k]:
            k = table[k - 1]
        k += marker[i] == marker[k]
        table[i] = k
    return table


class MarkerCutter:
    """Finds the first marker in a text that comes in chunks, keeping only how much of the marker the end may have begun."""

    def __init__(self, marker: str, matched: int = 0) -> None:
        self.marker, self.table, self.matched = marker, fallback_lengths(marker), matched

    def feed(self, chunk: str) -> tuple[str, bool]:
        """(text that is certain now, whether the marker is complete); what follows the marker is left out."""
        held, k, marker = self.matched, self.matched, self.marker
        if not marker:
            return chunk, False
        for i, c in enumerate(chunk):
            while k and c != marker[k]:
                k = self.table[k - 1]
            k += c == marker[k]
            if k == len(marker):
                self.matched = 0
                return (marker[:held] + chunk[: i + 1])[: held + i + 1 - k], True
        self.matched = k
        whole = marker[:held] + chunk
        return whole[: len(whole) - k], False

    def rest(self) -> str:
        """What was held back, when no more comes."""
        held, self.matched = self.marker[: self.matched], 0
        return held


def _processor(marker: str, idle_ms: int) -> StatefulProcessor:
    class AnswerProcessor(StatefulProcessor):
        """State of a stream: the next chunk's number, how much of the marker is held back, whether it is over; chunks that came early; a timer."""

        def init(self, handle) -> None:
            self.handle = handle
            self.at = handle.getValueState("at", "next long, matched int, over boolean, timer long")
            self.early = handle.getMapState("early", "seq long", "chunk string, last boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = self.at.get() if self.at.exists() else None
            following, matched, over, timer = (0, 0, False, -1) if known is None else known
            came, latest = {}, timer
            for frame in rows:
                for seq, chunk, last, ms in zip(frame["seq"].tolist(), frame["chunk"].tolist(), frame["last"].tolist(), frame["ms"].tolist()):
                    latest = max(latest, ms + idle_ms)
                    if not over and seq >= following:  # a number that has passed is a repeat
                        came[seq] = (chunk or "", bool(last))
            out, cutter = [], MarkerCutter(marker, matched)
            while not over:
                if following in came:
                    chunk, last = came.pop(following)
                elif known is not None and (held := self.early.getValue((following,))) is not None:
                    chunk, last = held
                    self.early.removeKey((following,))
                else:
                    break
                piece, cut = cutter.feed(chunk)
                over = cut or last
                if last and not cut:
                    piece += cutter.rest()
                out.append((key[0], following, piece, "cut" if cut else "end" if last else "open"))
                following += 1
            if over:
                self.early.clear()
            else:
                for seq, value in came.items():
                    self.early.updateValue((seq,), value)
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if latest > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(latest)
                self.at.update((following, cutter.matched, over, latest))
            else:  # the whole row is older than the watermark allows
                self.at.update((following, cutter.matched, over, -1))
            yield pd.DataFrame(out, columns=["stream", "seq", "piece", "status"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            following, matched, over, _ = self.at.get()
            out = [] if over else [(key[0], following, MarkerCutter(marker, matched).rest(), "abandoned")]
            self.at.clear()
            self.early.clear()
            yield pd.DataFrame(out, columns=["stream", "seq", "piece", "status"])

        def close(self) -> None:
            pass

    return AnswerProcessor()


def cut_streams(chunks: DataFrame, marker: str, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Pieces (stream, seq, piece, status) of chunk streams (stream, seq from 0, chunk, last, ts), cut at the first ``marker``.

    The pieces of a stream in the order of ``seq`` make up its text before the marker; the end of a chunk that may begin the
    marker is held back until it is decided. ``status`` is open, cut (the marker came), end (the last chunk came without
    it) or abandoned. Chunks may come in any order and repeatedly; a gap holds back what follows it. A stream without a chunk for
    ``idle`` of event time, beyond the watermark's ``late``, gives what was held back as its abandoned end and loses its
    state, chunks after a gap included; one that has ended loses its state in the same way. Null chunks count as empty.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = ["stream", "seq", "chunk", "last", F.unix_millis("ts").alias("ms")]
    keyed = chunks.withWatermark("ts", late).select("ts", *columns)
    return keyed.groupBy("stream").transformWithStateInPandas(
        statefulProcessor=_processor(marker, idle_ms), outputStructType=PIECES, outputMode="Append", timeMode="EventTime"
    )
