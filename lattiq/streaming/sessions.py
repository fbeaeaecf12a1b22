"""Event-time extensions: windowed counts, sessions and a stateful dialogue over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; works on a batch and on a stream."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, stop, n) of each user's runs of events less than ``gap`` apart."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def dialogue_state(answers: DataFrame) -> DataFrame:
    """Running (case, confirmed, denied, asked) from a stream of answers (case, p, yes), kept as state between batches.

    A finding asked again counts once; the first answer stands."""
    from pyspark.sql.streaming.state import GroupState

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yes, no, asked = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in frames:
            for p, y in zip(pdf.p, pdf.yes):
                if p not in asked:
                    asked.append(p)
                    (yes if y else no).append(p)
        state.update((yes, no, asked))
        yield pd.DataFrame({"case": [key[0]], "confirmed": [len(yes)], "denied": [len(no)], "asked": [len(asked)]})

    return answers.groupBy("case").applyInPandasWithState(step, "case string, confirmed long, denied long, asked long", "yes array<string>, no array<string>, asked array<string>", "update", "NoTimeout")
