"""History-dependent scores on streams, with keyed state in the state store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NOVELTY = "agent_id bigint, step bigint, novelty double, history_size bigint"
TASTED = NOVELTY + ", taste_similarity double, taste_shift double, n_updates bigint, drift double"
ALERT = "agent_id bigint, stop_step bigint, mean double, late bigint"


@dataclass(frozen=True)
class Taste:
    """Encounters with a novelty of threshold or more pull a key's taste by rate. start: with the key's "first" vector or from "zero"."""

    rate: float
    threshold: float
    start: str = "first"

    def __post_init__(self) -> None:
        if not 0 < self.rate <= 1:
            raise ValueError("rate must be above 0 and at most 1")
        if self.start not in ("first", "zero"):
            raise ValueError("start must be first or zero")


@dataclass
class Palate:
    """One key's taste and the taste that its drift is measured from; None for none."""

    taste: np.ndarray | None = None
    first: np.ndarray | None = None
    n_updates: int = 0

    def visit(self, how: Taste, v: np.ndarray, novelty: float | None) -> tuple[float | None, float | None, int, float | None]:
        """(similarity to the taste so far, shift where this visit moves it, updates so far, drift since the start)."""
        before, shift = self.taste, None
        if novelty is None and before is None and how.start == "first":
            self.taste = self.first = v
        elif novelty is not None and novelty >= how.threshold:
            pulled = how.rate * novelty * v + (0 if before is None else (1 - how.rate) * before)
            norm = np.linalg.norm(pulled)
            self.taste = pulled / norm if norm > 0 else None
            self.n_updates += 1
            shift = 1.0 if before is None else 1.0 if self.taste is None else float(1 - before @ self.taste)
            self.first = self.taste if self.first is None else self.first
        drift = None if self.taste is None or self.first is None else float(1 - self.taste @ self.first)
        return None if before is None else float(v @ before), shift, self.n_updates, drift


class NoveltyProcessor(StatefulProcessor):
    """Each vector against the key's earlier ones: the mean of the j smallest distances, null for the first. Rows of a batch are taken in order of step.

    max_history bounds the state: beyond it the oldest vectors are forgotten, which changes the scores; None keeps all.
    taste: the key's taste is kept as well, and told of each visit.
    """

    def __init__(self, j: int, max_history: int | None = None, taste: Taste | None = None):
        self.j, self.max_history, self.taste = j, max_history, taste

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "vec array<double>")
        if self.taste:
            self.palate = handle.getValueState("palate", "taste array<double>, first array<double>, n_updates bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        visits = pd.concat(list(rows)).sort_values("step")
        yield self.scored(key, zip(visits["step"], visits["embedding"], strict=True))

    def scored(self, key, visits: Iterable[tuple[int, Sequence[float]]]) -> pd.DataFrame:
        """Scores the visits, in the order given, and adds them to the key's history."""
        past = [np.asarray(r[0], float) for r in self.history.get()] if self.history.exists() else []
        palate = Palate()
        if self.taste and self.palate.exists():
            *vectors, n = self.palate.get()
            palate = Palate(*[None if v is None else np.asarray(v, float) for v in vectors], n)
        known, out = len(past), []
        for step, embedding in visits:
            v = np.asarray(embedding, float)
            novelty = None
            if past:
                distances = 1 - np.round(np.stack(past) @ v, 9)
                novelty = float(np.sort(distances)[: self.j].mean())
            out.append((key[0], step, novelty, len(past) + 1, *(palate.visit(self.taste, v, novelty) if self.taste else ())))
            past.append(v)
        if self.max_history is not None and len(past) > self.max_history:
            self.history.put([(v.tolist(),) for v in past[-self.max_history :]])
        else:
            self.history.appendList([(v.tolist(),) for v in past[known:]])
        if self.taste:
            self.palate.update((*[None if v is None else v.tolist() for v in (palate.taste, palate.first)], palate.n_updates))
        names = ["agent_id", "step", "novelty", "history_size"]
        return pd.DataFrame(out, columns=names + ["taste_similarity", "taste_shift", "n_updates", "drift"] * bool(self.taste))

    def close(self) -> None:
        pass


class OrderedNoveltyProcessor(NoveltyProcessor):
    """The same for rows that arrive in any order: each waits, keyed by its step, until the watermark has passed its time, and those that are due are then scored in order of step.

    A row whose time the watermark has already passed, or whose step isn't above those that have been scored, would change
    scores that are out: it is left out and counted in late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "step bigint", "ms bigint, vec array<double>")
        self.reached = handle.getValueState("reached", "step bigint, late bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        passed = timer.getCurrentWatermarkInMs()
        reached, late = self.reached.get() if self.reached.exists() else (None, 0)
        before = late
        for batch in rows:
            for step, ms, v in zip(batch["step"].tolist(), batch["ms"].tolist(), batch["embedding"], strict=True):
                if ms <= passed or reached is not None and step <= reached:
                    late += 1
                else:
                    self.waiting.updateValue((step,), (ms, [float(x) for x in v]))
                    self.handle.registerTimer(ms)
        if late > before:
            self.reached.update((reached, late))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((step, vec) for (step,), (ms, vec) in self.waiting.iterator() if ms <= now)
        if not due:
            return
        for step, _ in due:
            self.waiting.removeKey((step,))
        _, late = self.reached.get() if self.reached.exists() else (None, 0)
        self.reached.update((due[-1][0], late))
        yield self.scored(key, due).assign(late=late)


def online_novelty(stream: DataFrame, j: int, max_history: int | None = None, taste: Taste | None = None) -> DataFrame:
    """stream (agent_id, step, embedding) to (agent_id, step, novelty, history_size). Needs the RocksDB state store.

    taste: adds taste_similarity (to the taste before the visit), taste_shift (null where the visit didn't move it),
    n_updates and drift (from the taste at the start, or, from zero, from the first one).
    """
    return stream.groupBy("agent_id").transformWithStateInPandas(NoveltyProcessor(j, max_history, taste), TASTED if taste else NOVELTY, "Append", "None")


def ordered_novelty(stream: DataFrame, j: int, lateness: str, time_col: str = "ts", max_history: int | None = None, taste: Taste | None = None) -> DataFrame:
    """online_novelty for rows in any order of arrival, with late: the key's rows left out so far because they came too late.

    stream also has time_col, which grows with an agent's step. A row is scored once the watermark, lateness behind the
    newest time, has passed it: the scores are those of a replay of all rows that came in time. Steps without a time are left out.
    """
    timed = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, lateness)
    timed = timed.select("agent_id", "step", "embedding", F.unix_millis(time_col).alias("ms"), time_col)
    schema = (TASTED if taste else NOVELTY) + ", late bigint"
    return timed.groupBy("agent_id").transformWithStateInPandas(OrderedNoveltyProcessor(j, max_history, taste), schema, "Append", "EventTime")


class BoredomProcessor(StatefulProcessor):
    """One alert an agent, when the mean of its last window novelties falls below threshold. A step at or before the last one seen is dropped and counted as late."""

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold = window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "values array<double>, last bigint, late bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        values, last, late, told = self.state.get() if self.state.exists() else ([], -1, 0, False)
        values, out = list(values), []
        for r in pd.concat(list(rows)).sort_values("step").itertuples(index=False):
            if r.step <= last:
                late += 1
                continue
            last = int(r.step)
            values = [*values, None if pd.isna(r.novelty) else float(r.novelty)][-self.window :]
            if not told and len(values) == self.window and None not in values and sum(values) / self.window < self.threshold:
                told = True
                out.append((key[0], last, sum(values) / self.window, late))
        self.state.update((values, last, late, told))
        yield pd.DataFrame(out, columns=["agent_id", "stop_step", "mean", "late"])

    def close(self) -> None:
        pass


def boredom_alerts(stream: DataFrame, window: int, threshold: float) -> DataFrame:
    """stream (agent_id, step, novelty) to one row (agent_id, stop_step, mean, late) for each bored agent."""
    return stream.groupBy("agent_id").transformWithStateInPandas(BoredomProcessor(window, threshold), ALERT, "Append", "None")
