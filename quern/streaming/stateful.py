"""Stateful processors of the streams: typed state that is written once for each event, and goes by the watermark.

Where order matters, many keys share one group of state, so that calls and timers go by groups and not by keys. Events wait in
map state by (slot of event time, part): what a micro-batch brings for a slot is a part of its own and never written
again. A timer of event time at the end of each slot releases it once the watermark has passed it, in order of time and
id, and deletes it. So what a micro-batch writes follows its own events, however many wait; a slot's release writes anew
what is kept of its group's keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

#: What a fold keeps of a key: its fields after ``seen``, the microsecond of its last event.
Kept = tuple | None
#: fold(kept, microseconds, ids, values) -> (kept, columns of results as lists).
Fold = Callable[[Kept, list[int], list[int], list[str | None]], tuple[tuple, dict[str, list]]]
#: Makes columns of a frame of lists, by name.
Shapes = dict[str, Callable[[list], object]]


def _text(column: pd.Series) -> list[str | None]:
    return [v if isinstance(v, str) else None for v in column.tolist()]


def _rows(batch: pd.DataFrame) -> list[tuple[int, int, str | None]]:
    times = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
    return list(zip(times, batch["id"].astype("int64").tolist(), _text(batch["value"]), strict=True))


class _Keyed(StatefulProcessor):
    def __init__(self, fold: Fold, shapes: Shapes):
        self.fold, self.shapes = fold, shapes

    def _folded(self, before: Kept, rows: list[tuple]) -> tuple[tuple, dict[str, list]]:
        """What is kept now, ``seen`` first, and columns of results."""
        rows.sort(key=lambda r: r[:2])
        times, ids, values = (list(x) for x in zip(*rows, strict=True))
        kept, columns = self.fold(before[1:] if before else None, times, ids, values)
        return (times[-1], *kept), columns

    def _frame(self, keys: list, columns: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), **{name: self.shapes.get(name, list)(x) for name, x in columns.items()}})

    def close(self) -> None:
        pass


class OnArrival(_Keyed):
    """Folds what a micro-batch brings for a key, in order of time and id. ``ttl_ms``: how long state lives without a new
    event, by the clock; needs the time mode ``ProcessingTime``."""

    def __init__(self, fold: Fold, shapes: Shapes, kept: str, ttl_ms: int | None = None):
        super().__init__(fold, shapes)
        self.schema, self.ttl_ms = f"seen long, {kept}", ttl_ms

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, columns = self._folded(self.kept.get() if self.kept.exists() else None, [r for batch in rows for r in _rows(batch)])
        self.kept.update(kept)
        n = len(next(iter(columns.values())))
        if n:
            yield self._frame([key[0]] * n, columns)


class InOrder(_Keyed):
    """Folds events of a group of keys (rows have their ``key`` as text) slot by slot, key by key, once the watermark has
    passed a slot's end. ``expire_ms``: what is kept of a key goes when the watermark is so far beyond its last event, at the
    end of a slot; ``ending`` may make last results of what goes."""

    def __init__(self, fold: Fold, shapes: Shapes, kept: str, slot_ms: int, expire_ms: int | None = None, ending: Callable[[tuple], dict[str, list]] | None = None):
        super().__init__(fold, shapes)
        self.schema, self.slot_ms, self.expire_ms, self.ending = f"seen long, {kept}", slot_ms, expire_ms, ending

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"key array<string>, kept array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in self.schema.split(','))}>>")
        self.waiting = handle.getMapState("waiting", "slot long, part int", "key array<string>, t array<long>, id array<long>, value array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[int, int] = {}
        for batch in rows:
            slots: dict[int, list] = {}
            for name, row in zip(_text(batch["key"]), _rows(batch), strict=True):
                slots.setdefault(row[0] // 1000 // self.slot_ms, []).append((name, *row))
            for slot, events in slots.items():
                part = parts.get(slot, 0)
                while self.waiting.containsKey((slot, part)):
                    part += 1
                self.waiting.updateValue((slot, part), tuple(list(x) for x in zip(*events, strict=True)))
                if not part:
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
                parts[slot] = part + 1
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot, part, events = now // self.slot_ms - 1, 0, {}
        while self.waiting.containsKey((slot, part)):
            for name, *row in zip(*self.waiting.getValue((slot, part)), strict=True):
                events.setdefault(name, []).append(tuple(row))
            self.waiting.removeKey((slot, part))
            part += 1
        held = {name: tuple(x) for name, x in zip(*self.kept.get(), strict=True)} if self.kept.exists() else {}
        names: list[str | None] = []
        columns: dict[str, list] = {}

        def told(name: str | None, more: dict[str, list]) -> None:
            for column, x in more.items():
                columns.setdefault(column, []).extend(x)
            names.extend([name] * len(x))

        for name, some in events.items():
            held[name], found = self._folded(held.get(name), some)
            told(name, found)
        # Looked at when a slot ends, so that all events before have been released.
        gone = [name for name, x in held.items() if self.expire_ms is not None and self._end(x[0]) <= now]
        for name in gone:
            last = held.pop(name)
            if self.ending:
                told(name, self.ending(last))
        if events and self.expire_ms is not None:
            for end in sorted({self._end(held[name][0]) for name in events if name in held}):
                self.handle.registerTimer(end)
        if held and (events or gone):
            self.kept.update((list(held), list(held.values())))
        elif gone:
            self.kept.clear()
        if names:
            yield self._frame(names, columns)

    def _end(self, seen: int) -> int:
        """The end of the slot in which a key that was seen last at this microsecond expires."""
        return -(-(seen + 1000 * self.expire_ms) // (1000 * self.slot_ms)) * self.slot_ms


class Newest(StatefulProcessor):
    """The newest ``n`` events of each key of a group (rows have their ``key`` as text) as map state of blocks, by key and (time,
    id) of a block's last event: new ones are put in, those with none of the newest taken out, the rest is not touched.
    Gives a key's ids, oldest first, whenever they change.

    Calls cost more than all else. So a micro-batch has one call a group, which reads what the group holds; and m events
    of a key that come at once are blocks of m * m / n, one at least: some n / m blocks, never more than one an event, and a
    key keeps fewer outdated events than came with them.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "key string, t long, id long", "t array<long>, id array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str | None, set[tuple[int, int]]] = {}
        for batch in rows:
            for name, row in zip(_text(batch["key"]), _rows(batch), strict=True):
                events = new.setdefault(name, set())
                events.add(row[:2])
                if len(events) > 4 * self.n + 64:
                    new[name] = set(sorted(events)[-self.n :])
        held: dict[str | None, dict[tuple, list[tuple[int, int]]]] = {}
        for (name, *last), block in self.held.iterator():
            if name in new:
                held.setdefault(name, {})[(name, *last)] = list(zip(*block, strict=True))
        out: dict[str | None, list[int]] = {}
        for name, events in new.items():
            own = held.get(name, {})
            before = {event for block in own.values() for event in block}
            newest = sorted(before | events)[-self.n :]
            kept = set(newest)
            for last, block in own.items():
                if kept.isdisjoint(block):
                    self.held.removeKey(last)
            come = sorted(kept - before)
            size = max(1, len(come) ** 2 // self.n)
            for k in range(0, len(come), size):
                block = come[k : k + size]
                self.held.updateValue((name, *block[-1]), tuple(list(x) for x in zip(*block, strict=True)))
            if come:
                out[name] = [i for _, i in newest]
        if out:
            yield pd.DataFrame({"key": pd.Series(list(out), dtype=object), "ids": list(out.values())})

    def close(self) -> None:
        pass


class Frames(StatefulProcessor):
    """Puts server-sent events together from chunks of bytes, cut anywhere, of a group of captures (rows have their ``key`` as
    text). State of a capture: the bytes after its last blank line (a carriage return at their end may be half of a line
    end), how many blocks there were, and whether it is done; only captures that chunks come of are read and written."""

    def init(self, handle) -> None:
        self.open = handle.getMapState("open", "key string", "tail binary, pos long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str | None, list[tuple]] = {}
        for batch in rows:
            for name, *chunk in zip(_text(batch["key"]), batch["seq"].tolist(), batch["chunk"].tolist(), strict=True):
                came.setdefault(name, []).append(tuple(chunk))
        out: list[tuple] = []
        for name, chunks in came.items():
            tail, pos, done = self.open.getValue((name,)) or (b"", 0, False)
            if done:
                continue
            chunks.sort(key=lambda r: r[0])
            found, tail, done = blocks(bytes(tail) + b"".join(bytes(c) for _, c in chunks if c is not None))
            out += [(name, pos + k, payload, readable(payload)) for k, payload in enumerate(found) if payload is not None]
            # What is done needs no tail, but stays marked: chunks may still come.
            self.open.updateValue((name,), (b"" if done else tail, pos + len(found), done))
        if out:
            yield pd.DataFrame(out, columns=["key", "pos", "json", "ok"])

    def close(self) -> None:
        pass


def blocks(data: bytes) -> tuple[list[str | None], bytes, bool]:
    """The payload of each finished block (None without data lines), the unfinished rest, and whether the end was told, which
    is no payload."""
    half = data.endswith(b"\r")
    *whole, rest = (data[:-1] if half else data).replace(b"\r\n", b"\n").split(b"\n\n")
    out: list[str | None] = []
    for block in whole:
        lines = block.decode("utf-8", errors="replace").split("\n")
        data_lines = [line[5:].lstrip() for line in lines if line.startswith("data:")]
        payload = "\n".join(data_lines).strip() if data_lines else None
        if payload == "[DONE]":
            return out, b"", True
        out.append(payload)
    return out, rest + b"\r" * half, False


def readable(payload: str) -> bool:
    try:
        json.loads(payload)
    except (ValueError, RecursionError):
        return False
    return True
