"""The per-key score of turns: one fold, in batch over sorted turns and in streams over keyed state.

State: score (decays to 0 after idle turns, clamped), last turn, cooldown, failures in a row, the turn
that a bad run began, and the best delta so far. Batch carries the state along a
partition's sorted turns; the stream keeps the same fields for each key and takes turns as they come,
late ones too, in the order of arrival.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import score as S

STATE = "score double, last_turn long, cooldown long, failures long, bad_turn long, best double"
TURN = "turn long, words int, duration_ms double, cost_usd double, structured boolean"
Turn = namedtuple("Turn", [f.split()[0] for f in TURN.split(", ")])
START = (0.0, 0, 0, 0, None, None)
RESULT = "turn long, score double, delta double, quality_target int, recovery_turns long, regret double, cooldown long, failures long"


def folded(turns: DataFrame, key: str) -> DataFrame:
    """Every turn of every key with its results; ``turns``: key and the fields of TURN.

    The turns of a key follow each other in one sorted partition and only the state is carried along,
    so no key's history is held. Turns of a null key are a key's. Null words, times and costs count as
    in ``step``; a null turn comes first and never counts as idle.
    """
    fields = [f.split() for f in TURN.split(", ")]
    typed = turns.select(key, *(F.col(n).cast(t).alias(n) for n, t in fields))
    order = [key, *(n for n, _ in fields)]
    return typed.repartition(key).sortWithinPartitions(*order).mapInArrow(_folds(key), f"`{key}` {typed.schema[key].dataType.simpleString()}, {RESULT}")


def _folds(key: str):
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, START
        for batch in batches:
            out = []
            for k, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != own:
                    own, state = k, START
                state, result = step(state, Turn(*turn))
                out.append(result)
            results = [pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *results], [key, *(f.split()[0] for f in RESULT.split(", "))])

    return run


def step(state: tuple, turn) -> tuple[tuple, tuple]:
    """The state after a turn, and what the turn gave. Null words are strong and without quality of their own."""
    score, last, cooldown, failures, bad, best = state
    words, dollars, millis = (0.0 if pd.isna(x) else float(x) for x in (turn.words, turn.cost_usd, turn.duration_ms))
    rel = next((name for name, below in S.RELIABILITY if turn.words is not None and turn.words < below), "ok_strong")
    ok, strong = rel in ("ok_weak", "ok_strong"), rel == "ok_strong"
    known = turn.turn is not None
    score = 0.0 if known and last is not None and turn.turn - last > S.IDLE_TURNS else score
    failures = 0 if ok else failures + 1
    latency = min(millis / S.MILLIS, 1.0)
    parts = (1.0, latency * S.STRUCTURED_LATENCY, 0.0) if turn.structured else (min(words / S.WORDS, 1.0), latency, min(dollars / S.DOLLARS, 1.0))
    delta = _half_up(parts[0] - S.LATENCY_WEIGHT * parts[1] - S.COST_WEIGHT * parts[2] + (S.REPEATED_FAILURE if failures >= 2 else 0.0))
    clamp = lambda x: max(S.LEAST_SCORE, min(S.MOST_SCORE, x))
    score = clamp(_half_up(score + delta))
    score = clamp(score + S.STRUCTURED_BONUS) if turn.structured and strong else score
    recovery = turn.turn - bad if ok and known and bad is not None else None
    best = delta if best is None else max(best, delta)
    cooldown = S.COOLDOWN if strong else max(0, cooldown - 1)
    return (score, turn.turn, cooldown, failures, None if ok else turn.turn, best), (turn.turn, score, delta, int(strong), recovery, _half_up(best - delta), cooldown, failures)


def _half_up(x: float) -> float:
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(f"{x:.9f}").quantize(Decimal("0.001"), ROUND_HALF_UP)) + 0.0  # no negative zero


def tracked(turns: DataFrame, key: str, kind: str = "string"):
    """A stream of turns as a stream of their results; state is kept for each key."""

    def run(keys, frames, state: GroupState):
        now = state.get if state.exists else START
        now = tuple(None if x is not None and pd.isna(x) else x for x in now)
        for frame in frames:
            out = []
            for turn in frame.sort_values("turn").itertuples():
                now, result = step(now, turn)
                out.append((keys[0], *result))
            yield pd.DataFrame(out, columns=[key, *(f.split()[0] for f in RESULT.split(", "))]).astype({"recovery_turns": "Int64"})
        state.update(now)

    return turns.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {RESULT}", STATE, "append", GroupStateTimeout.NoTimeout)


def live_dashboard(events: DataFrame, time: str = "ts", width: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """A stream's events counted by window and type; windows close once the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
