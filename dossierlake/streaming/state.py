"""Keyed state over event streams: admissions with cool-down and budget, one live session, alerts that hold.

State is list and value state of ``transformWithState``; event-time timers let it go when nothing can depend on it
any more. Rows of a key are taken in order of time within a batch, batches as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import attrgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COOLDOWN, BUDGET, HOUR = 60, 5, 3600  # fixed values: seconds between codes, codes an hour, its seconds
SESSION_HOURS = 12
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, as several states of a key need it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    return sorted(rows, key=attrgetter(*by))


def _move_timer(handle: StatefulProcessorHandle, before: int | None, at: int | None) -> None:
    """The timer of a key, which is at ``before`` if it has one, is at ``at`` from now on. It is known, so that none are listed."""
    if before != at:
        if before is not None:
            handle.deleteTimer(before)
        if at is not None:
            handle.registerTimer(at)


def _millis(us: int) -> int:
    return -(-us // 1000)


class _Admissions(StatefulProcessor):
    """Times of the admitted requests of a key that still count."""

    def __init__(self, cooldown: int, budget: int, span: int):
        self.cooldown, self.budget, self.span = cooldown * 1_000_000, budget, span * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "us long")

    def handleInputRows(self, key, rows, timerValues):
        times = [r[0] for r in self.admitted.get()]
        out, before = [], self._end(times)
        for event_id, us in ((r.event_id, r.us) for r in _in_order(rows, "us", "event_id")):
            times = [t for t in times if us - t <= self.span]
            if times and us - times[-1] < self.cooldown:
                gate = "COOLDOWN"
            elif len(times) >= self.budget:
                gate = "BUDGET"
            else:
                gate = "OK"
                times.append(us)
            out.append(Row(event_id=event_id, user_id=key[0], gate=gate))
        if times:
            self.admitted.put([(t,) for t in times])
            _move_timer(self.handle, before, self._end(times))
        elif before is not None:
            self.admitted.clear()
        return iter(out)

    def _end(self, times: list[int]) -> int | None:
        return _millis(times[-1] + self.span) + 1 if times else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.admitted.clear()  # none counts any more
        return iter([])

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, cooldown: int = COOLDOWN, budget: int = BUDGET, span: int = HOUR, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, gate) of a stream of requests (event_id, ts, user_id).

    COOLDOWN: the user's last admitted request is under ``cooldown`` seconds old; BUDGET: ``budget`` were
    admitted in the ``span`` seconds before; else OK, and admitted. A refused request counts for nothing later.
    """
    rows = requests.withWatermark("ts", late).select("event_id", "ts", "user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithState(_Admissions(cooldown, budget, span), "event_id long, user_id long, gate string", "append", "eventTime")


class _Sessions(StatefulProcessor):
    """The live session of a key; a timer ends it."""

    def __init__(self, hours: int):
        self.life = hours * HOUR * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "event_id long, us long")

    def handleInputRows(self, key, rows, timerValues):
        live = self.live.get()
        out, before = [], self._end(live)
        for event_id, us in ((r.event_id, r.us) for r in _in_order(rows, "us", "event_id")):
            if live is not None:
                ended = live[1] + self.life
                out.append(self._row(live[0], key[0], "EXPIRED", ended) if ended <= us else self._row(live[0], key[0], "REVOKED", us, event_id))
            out.append(self._row(event_id, key[0], "OPENED", us))
            live = (event_id, us)
        if live is not None:
            self.live.update(live)
            _move_timer(self.handle, before, self._end(live))
        return iter(out)

    def _end(self, live: tuple | None) -> int | None:
        return None if live is None else _millis(live[1] + self.life)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        live, out = self.live.get(), []
        if live is not None:
            out.append(self._row(live[0], key[0], "EXPIRED", live[1] + self.life))
            self.live.clear()
        return iter(out)

    @staticmethod
    def _row(event_id: int, user_id: int, what: str, us: int, by: int | None = None) -> Row:
        return Row(event_id=event_id, user_id=user_id, what=what, us=us, by=by)

    def close(self) -> None:
        pass


def sessions(logins: DataFrame, hours: int = SESSION_HOURS, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, what, us, by) of a stream of logins (event_id, ts, user_id): each session is OPENED, and at most once
    REVOKED, ``by`` the user's next login, or EXPIRED, ``hours`` after it began, whichever is first. ``us``: when, in microseconds.

    A session expires when the watermark passes its end, or a later login shows that it has.
    """
    rows = logins.withWatermark("ts", late).select("event_id", "ts", "user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithState(_Sessions(hours), "event_id long, user_id long, what string, us long, by long", "append", "eventTime")


class _Once(StatefulProcessor):
    """Whether a key was seen; the store itself forgets it after a time."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "event_id long", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.get() is not None:
            return iter([])
        first = min(rows, key=attrgetter("us", "event_id"))
        self.seen.update((first.event_id,))
        return iter([Row(event_id=first.event_id, key=key[0], us=first.us)])

    def close(self) -> None:
        pass


def once_within(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(event_id, key, us) of a stream of events (event_id, ts, ``key``): the first event of a key, by time within a batch.

    A key that was let through is remembered for ``seconds`` of the clock (state with a time to live), however late its
    other events are; after that its next event counts as new. Keys are text.
    """
    rows = events.select("event_id", F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"))
    return rows.groupBy("key").transformWithState(_Once(seconds), "event_id long, key string, us long", "append", "processingTime")


class _Alerts(StatefulProcessor):
    """Since when a rule's condition holds, and whether it fires. A timer resolves it when no more windows come."""

    def __init__(self, step: int, holds: dict[str, int]):
        self.step, self.holds = step, holds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "since long, last long, peak double")

    def _end(self, rule: str, since: int, last: int, peak: float) -> Row:
        hold = self.holds[rule]
        return Row(rule=rule, since=since, firing=since + hold if last - since >= hold else None, resolved=last + self.step, peak=peak)

    def handleInputRows(self, key, rows, timerValues):
        rule, out = key[0], []
        now = self.state.get()
        before = self._resolves(now)
        for at, ratio, held in ((r.at, r.ratio, r.held) for r in _in_order(rows, "at")):
            if now is not None and (not held or at != now[1] + self.step):
                out.append(self._end(rule, *now))
                now = None
            if held:
                now = (at, at, ratio) if now is None else (now[0], at, max(now[2], ratio))
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)
        _move_timer(self.handle, before, self._resolves(now))
        return iter(out)

    def _resolves(self, now: tuple | None) -> int | None:
        return None if now is None else (now[1] + 2 * self.step) * 1000  # the next window ends before that

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out = self.state.get(), []
        if now is not None:
            out.append(self._end(key[0], *now))
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def alert_intervals(rates: DataFrame, step: int, holds: dict[str, int], late: str = "0 seconds") -> DataFrame:
    """(rule, since, firing, resolved, peak) of a stream of evaluations (rule, ts, at, ratio, held), ``step`` seconds apart.

    All times are in seconds since 1970. An alert is pending from the first evaluation that holds, fires after
    its hold, and is resolved at the first evaluation that does not hold or is missing. ``firing`` is null where
    it never came to that. Intervals come out when they end.
    """
    rows = rates.withWatermark("ts", late).select("rule", "ts", "at", "ratio", "held")
    return rows.groupBy("rule").transformWithState(_Alerts(step, holds), "rule string, since long, firing long, resolved long, peak double", "append", "eventTime")
