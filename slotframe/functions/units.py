"""Sizes, durations, epochs, ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_SLOTS = 432_000
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}


def parse_bytes(text: str) -> int:
    """'4GiB', '512mb', '1_000': units are powers of 1024."""
    m = re.fullmatch(r"([\d_]+)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in _UNITS or not m[1].strip("_"):
        raise ValueError(f"not a size: {text!r}")
    return int(m[1].replace("_", "")) * _UNITS[m[2]]


def format_bytes(n: int) -> str:
    for name, unit in (("TiB", 1 << 40), ("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)):
        if n >= unit:
            return f"{n / unit:.2f} {name}"
    return f"{n} B"


def thousands(n: int) -> str:
    return f"{n:,}"


def format_duration(seconds: int) -> str:
    d, s = divmod(int(seconds), 86400)
    h, s = divmod(s, 3600)
    m, s = divmod(s, 60)
    return " ".join(f"{v}{u}" for v, u in ((d, "d"), (h, "h"), (m, "m"), (s, "s")) if v) or "0s"


def epoch_range(epoch: int, size: int = EPOCH_SLOTS) -> tuple[int, int]:
    """First and last slot."""
    return epoch * size, (epoch + 1) * size - 1


def slot_epoch(slot: int, size: int = EPOCH_SLOTS) -> int:
    return slot // size


def worker_count(cores: int, free_mb: int) -> int:
    """Four workers a core, as many as 285 MB each allow, one at least."""
    return max(1, min(cores * 4, free_mb // 285))


def split_range(start: int, end: int, parts: int) -> list[tuple[int, int]]:
    """[start, end) in even half-open parts; the first ones are longer by one."""
    size, rest = divmod(max(0, end - start), parts)
    out, at = [], start
    for i in range(parts):
        to = at + size + (i < rest)
        out.append((at, to))
        at = to
    return out


def parse_range(text: str, size: int = EPOCH_SLOTS) -> tuple[int, int]:
    """Half-open slots of '7' (an epoch), '3-5' (epochs, both ends), 'a:b' (slots, both ends), 'a..b' or 'a..=b' (epochs)."""
    for sign, last in (("..=", 1), ("..", 0), ("-", 1)):
        if sign in text:
            a, b = (int(x.replace("_", "")) for x in text.split(sign, 1))
            if b + last <= a:
                raise ValueError(f"empty or reversed range: {text}")
            return a * size, (b + last) * size
    if ":" in text:
        a, b = (int(x.replace("_", "")) for x in text.split(":", 1))
        if b < a:
            raise ValueError(f"reversed range: {text}")
        return a, b + 1
    e = int(text.replace("_", ""))
    return e * size, (e + 1) * size


def check_replay_range(start: int, end: int, size: int = EPOCH_SLOTS) -> None:
    """A replay needs a slot before its first one, and ends in the same epoch."""
    if start <= 0 or end < start or start // size != end // size:
        raise ValueError(f"bad replay range {start}:{end}")


def valid_replay_range(start: Column, end: Column, size: int = EPOCH_SLOTS) -> Column:
    """The same rule for columns."""
    epoch = lambda c: F.floor(c / F.lit(size))
    return (start > 0) & (end >= start) & (epoch(start) == epoch(end))


def _bytes(values: Column) -> Column:
    """An array of numbers 0 to 255 as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _width(value: Column, bits: int) -> Column:
    """How many groups of ``bits`` a number that isn't negative takes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(value), "^0+", "")) / bits)).cast("int")


def base128(value: Column) -> Column:
    """Seven bits a byte, the least first, the top bit on all but the last."""
    last = _width(value, 7) - 1
    group = lambda i: F.call_function("shiftright", value, 7 * i).bitwiseAND(F.lit(127))
    return _bytes(F.transform(F.sequence(F.lit(0), last), lambda i: group(i) + F.when(i < last, 128).otherwise(0)))


def counted(value: Column) -> Column:
    """One byte below 128, else the top bit and a count, and that many bytes, the least first."""
    n = _width(value, 8)
    body = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", value, 8 * i).bitwiseAND(F.lit(255)))
    return F.when(value < 128, _bytes(F.array(value))).otherwise(_bytes(F.concat(F.array((n + 128).cast("bigint")), body)))


def from_counted(data: Column) -> Column:
    """The number that :func:`counted` wrote; more than eight bytes are an error."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("bigint")
    first = byte(F.lit(1))
    n = (first - 128).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.call_function("shiftleft", byte(i + 2), 8 * i))
    return F.when(first < 128, first).when(n <= 8, total).otherwise(F.raise_error(F.lit("a number of more than eight bytes")))
