"""Durations and points in time as integer seconds."""

from __future__ import annotations

import re
import time as clock
from datetime import datetime, timezone

_SECONDS = {"ms": 0, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}
_PART = re.compile(r"(\d+(?:\.\d+)?)(ms|[smhdwy])")


class DurationError(ValueError):
    """A text that is not a duration or a time."""


def parse_duration(text: str) -> int:
    """Seconds of '5m', '1h30m' or '1y' (365 days); milliseconds count as 0."""
    parts = _PART.findall(text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise DurationError(f"not a duration: {text!r}")
    return int(sum(float(a) * _SECONDS[b] for a, b in parts))


def parse_config_duration(text: str) -> int:
    """Seconds of a configured interval: a duration, a bare number of seconds, or smaller units that round to 0."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    return 0 if re.fullmatch(r"\d+(ns|us|µs)", text) else parse_duration(text)


def format_duration(seconds: int) -> str:
    """The shortest compound form, '1h30m' for 5400; '0s' for nothing."""
    out = ""
    for unit in ("d", "h", "m", "s"):
        n, seconds = divmod(seconds, _SECONDS[unit])
        out += f"{n}{unit}" if n else ""
    return out or "0s"


def parse_time(text: str, now: float | None = None) -> int:
    """Unix seconds of 'now', 'now-1h', 'now+2d', a number, or an RFC 3339 time."""
    text = text.strip()
    if match := re.fullmatch(r"now(?:([+-])(\w+))?", text):
        base = int(clock.time() if now is None else now)
        return base + (parse_duration(match[2]) * (1 if match[1] == "+" else -1) if match[1] else 0)
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?", text):
        return int(float(text))
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise DurationError(f"not a time: {text!r}") from None
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def automatic_step(seconds: int, rate: bool = False) -> int:
    """The step for a range of so many seconds: short ranges are drawn finely, rates at least every 15 seconds."""
    if rate:
        return 15 if seconds <= 3600 else 60 if seconds <= 86_400 else 300
    return 3600 if seconds > 604_800 else 600 if seconds > 86_400 else 60 if seconds > 3600 else 15
