"""Parameter decks: text blocks of ``name = value`` with typed getters, overrides, checks and output times."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable


class Deck:
    """Blocks of named string values, in order. Values are typed when asked for."""

    def __init__(self, blocks: dict[str, dict[str, str]] | None = None):
        self.blocks = blocks or {}

    @classmethod
    def parse(cls, text: str) -> Deck:
        """``<block>`` lines begin blocks, ``#`` comments, ``&`` at a line's end continues its value on the next; ``<par_end>`` ends."""
        deck, block, pending = cls(), None, None
        for number, line in enumerate(text.replace("\t", "").splitlines(), 1):
            line = line.partition("#")[0].strip()
            if not line:
                continue
            if line.startswith("<"):
                end = line.find(">")
                if end < 0:
                    raise ValueError(f"line {number}: a block's name is not closed")
                block = line[1:end].strip()
                if block == "par_end":
                    break
                deck.blocks.setdefault(block, {})
                pending = None
                continue
            if block is None:
                raise ValueError(f"line {number}: a parameter outside of any block")
            if pending is not None:
                more, pending_name = line, pending
                deck.blocks[block][pending_name] += more.rstrip("&").strip()
                pending = pending_name if more.endswith("&") else None
                continue
            name, equals, value = line.partition("=")
            if not equals:
                raise ValueError(f"line {number}: no value for {name.strip()}")
            name, value = name.strip(), value.strip()
            pending = name if value.endswith("&") else None
            deck.blocks[block][name] = value.rstrip("&").strip()
        return deck

    def override(self, arguments: Iterable[str]) -> list[str]:
        """Apply ``block/name=value`` arguments; warnings for those that were not there, which are added."""
        warnings = []
        for argument in arguments:
            path, equals, value = argument.partition("=")
            block, slash, name = path.rpartition("/")
            if not equals or not slash:
                raise ValueError(f"{argument} is not block/name=value")
            if name not in self.blocks.get(block, {}):
                warnings.append(f"{path} was not in the deck")
            self.blocks.setdefault(block, {})[name] = value
        return warnings

    def has(self, block: str, name: str) -> bool:
        return name in self.blocks.get(block, {})

    def _get(self, kind: Callable, block: str, name: str, default=None, allowed: Iterable = ()):
        if not self.has(block, name):
            if default is None:
                raise KeyError(f"{block}/{name} is required")
            self.blocks.setdefault(block, {})[name] = _text(default)
            return default
        value = kind(self.blocks[block][name])
        allowed = list(allowed)
        if allowed and value not in allowed:
            raise ValueError(f"{block}/{name} = {value} is none of {allowed}")
        return value

    def integer(self, block: str, name: str, default: int | None = None, allowed: Iterable[int] = ()) -> int:
        return self._get(int, block, name, default, allowed)

    def real(self, block: str, name: str, default: float | None = None) -> float:
        return self._get(float, block, name, default)

    def boolean(self, block: str, name: str, default: bool | None = None) -> bool:
        return self._get(_boolean, block, name, default)

    def string(self, block: str, name: str, default: str | None = None, allowed: Iterable[str] = ()) -> str:
        return self._get(str, block, name, default, allowed)

    def vector(self, block: str, name: str, kind: Callable = str, default: list | None = None) -> list:
        return self._get(lambda v: [kind(x.strip()) for x in v.split(",")], block, name, default)

    def require(self, block: str, *names: str) -> None:
        missing = [n for n in names if not self.has(block, n)]
        if missing:
            raise KeyError(f"{block} lacks {missing}")

    def desire(self, block: str, *names: str) -> list[str]:
        return [f"{block}/{n} is recommended" for n in names if not self.has(block, n)]

    def dump(self) -> str:
        lines = ["#-------------------------- parameters --------------------------"]
        for block, values in self.blocks.items():
            lines += [f"<{block}>", *(f"{n} = {v}" for n, v in values.items()), ""]
        return "\n".join([*lines, "<par_end>"])

    def digest(self) -> str:
        """Equal for decks with equal values, whatever their order."""
        rows = sorted((b, n, v) for b, values in self.blocks.items() for n, v in values.items())
        return hashlib.sha256(repr(rows).encode()).hexdigest()

    def outputs(self) -> list[str]:
        return [b for b in self.blocks if b.rpartition("/")[2].startswith("output")]

    def roll_next_times(self, now: float, direction: int) -> None:
        """Move each output's next time back (-1) to, or forward (+1) past, the time that is now, by whole periods."""
        for block in self.outputs():
            dt = self.real(block, "dt", -1.0)
            if dt <= 0 or not self.has(block, "next_time"):
                continue
            at = self.real(block, "next_time")
            if direction < 0:
                while at - dt > now:
                    at -= dt
            else:
                while at <= now:
                    at += dt
            self.blocks[block]["next_time"] = repr(at)


def _boolean(value: str) -> bool:
    lowered = value.strip().lower()
    if lowered in ("true", "1", "yes", "on"):
        return True
    if lowered in ("false", "0", "no", "off"):
        return False
    raise ValueError(f"{value} is no boolean")


def _text(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return ", ".join(map(_text, value)) if isinstance(value, list) else str(value)


class Schedule:
    """When an output is due: at the start, each ``dt``, at the end, or on a signal. A negative dt never, 0 always."""

    def __init__(self, dt: float, next_time: float = 0.0):
        self.dt, self.next_time = dt, next_time

    def due(self, time: float, tlim: float, signal: str = "none") -> bool:
        if self.dt < 0:
            return False
        return signal in ("now", "final", "analysis") or time >= self.next_time or time >= tlim or time == 0.0

    def wrote(self, time: float, signal: str = "none") -> None:
        """Advance past what was written; a signal out of turn leaves the cadence as it is."""
        if self.dt > 0 and time >= self.next_time and signal != "now":
            while self.next_time <= time:
                self.next_time += self.dt
