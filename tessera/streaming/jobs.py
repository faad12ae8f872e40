"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import changefeed


def apply_stream(ops: DataFrame, state_dir: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of operations to the published state, one version per micro-batch.

    A batch that runs again after a failure changes nothing, as repeats of a change lose.
    """

    def step(batch: DataFrame, _: int) -> None:
        changefeed.apply_changes(changefeed.social_changes(batch), state_dir)

    return ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_messages(messages: DataFrame, keys: list[str], at: str, within: str = "2 minutes") -> DataFrame:
    """Messages whose keys did not come within the span before; state older than that is dropped."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def frame_faults(frames: DataFrame, session: str, sequence: str) -> DataFrame:
    """(session, expected, got) for frames that do not carry their session's next number; those are not taken.

    The state of a session is the number it expects. Frames of one micro-batch are taken in order of number.
    """

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (expected,) = state.get if state.exists else (0,)
        out = []
        for n in sorted(int(x) for b in batches for x in b[sequence]):
            if n == expected:
                expected += 1
            else:
                out.append((str(key[0]), expected, n))
        state.update((expected,))
        yield pd.DataFrame(out, columns=["session", "expected", "got"])

    return frames.groupBy(session).applyInPandasWithState(check, "session string, expected long, got long", "expected long", "append", GroupStateTimeout.NoTimeout)
