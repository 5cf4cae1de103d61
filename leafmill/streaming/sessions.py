"""Incremental sessions: documents that come in versions, with the lines that each version keeps from the one before.

`replay` is the batch form, over a table of versions. `stream` is the same over a stream, with state per document. A
version that is not newer than the last one of its document is late, and is reported instead of applied, since its edits are
in coordinates that are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.text_trees import LINE

COUNTERS = "doc_id bigint, version bigint, queries bigint, hits bigint, hit_bytes bigint, late boolean"


def replay(versions: DataFrame) -> DataFrame:
    """versions (doc_id, version, text): per version the lines asked for, those that its predecessor has, and their bytes."""
    lines = F.regexp_extract_all("text", F.lit(LINE), F.lit(0))
    w = Window.partitionBy("doc_id").orderBy("version")
    rows = versions.select("doc_id", "version", lines.alias("lines")).withColumn("old", F.coalesce(F.lag("lines").over(w), F.array().cast("array<string>")))
    kept = F.filter("lines", lambda x: F.array_contains("old", x))
    size = F.aggregate(F.transform("kept", F.octet_length), F.lit(0), lambda a, b: a + b)
    return rows.withColumn("kept", kept).select("doc_id", "version", F.size("lines").cast("bigint").alias("queries"), F.size("kept").cast("bigint").alias("hits"), size.cast("bigint").alias("hit_bytes"))


def advance(state: tuple | None, version: int, text: str) -> tuple[tuple, tuple]:
    """(new state, counters) for one version; state is (version, lines)."""
    import re

    if state is not None and version <= state[0]:
        return state, (version, 0, 0, 0, True)
    lines = re.findall(LINE, text or "")
    old = set(state[1]) if state else set()
    kept = [x for x in lines if x in old]
    return (version, lines), (version, len(lines), len(kept), sum(len(x.encode()) for x in kept), False)


def stream(versions: DataFrame, watermark: str | None = None, at: str = "at") -> DataFrame:
    """COUNTERS for a stream of versions (doc_id, version, text and, with a watermark, a time `at`, past which state of silent documents goes)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = (state.get[0], list(state.get[1])) if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values("version")
        for version, text in zip(rows["version"], rows["text"]):
            own, counters = advance(own, int(version), text)
            out.append((key[0], *counters))
        if own is not None:
            state.update((own[0], own[1]))
        if watermark:
            state.setTimeoutTimestamp(max(int(rows[at].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COUNTERS.split(", ")])

    df = versions.withWatermark(at, watermark) if watermark else versions
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return df.groupBy("doc_id").applyInPandasWithState(run, COUNTERS, "version bigint, lines array<string>", "append", timeout)
