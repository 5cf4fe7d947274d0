"""Parsers of switch values; they run on the driver, over single strings."""

from __future__ import annotations

import re
import time
from datetime import datetime

_BINARY = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def size(text: str, default_unit: str = "b") -> int:
    """Bytes; units are powers of 1024, none means ``default_unit``."""
    m = re.fullmatch(r"(\d+)([bkmgt]?)", text.strip().lower())
    if not m:
        raise ValueError(f"bad size: {text!r}")
    return int(m[1]) * _BINARY[m[2] or default_unit]


def dedup_size(text: str) -> int:
    """Lower-case units are powers of 1024, upper-case units powers of 1000."""
    m = re.fullmatch(r"(\d+)([bkmgtBKMGT]?)", text.strip())
    if not m:
        raise ValueError(f"bad size: {text!r}")
    unit = m[2]
    return int(m[1]) * (1000 ** "bkmgt".index(unit.lower()) if unit.isupper() else _BINARY[unit])


def dictionary(text: str) -> tuple[int | None, int]:
    """(logarithm over 128 KiB or None, bytes); a number without unit is in MiB.

    Up to 4 GiB only powers of two are allowed; beyond it any size up to 126 GiB.
    """
    n = size(text, "m")
    if n > 126 << 30 or n < 128 << 10:
        raise ValueError(f"dictionary out of range: {text!r}")
    if n <= 4 << 30:
        if n & (n - 1):
            raise ValueError(f"dictionary is no power of two: {text!r}")
        return n.bit_length() - 18, n
    return None, n


def period(text: str) -> int:
    """Seconds of ``NdNhNmNs``, a unit without a number counting none; 0 if it isn't one."""
    if not re.fullmatch(r"([0-9]*[dhms])+", text):
        return 0
    return sum(int(n or 0) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[unit] for n, unit in re.findall(r"([0-9]*)([dhms])", text))


def date(text: str) -> int:
    """Epoch seconds of the local ``YYYY[MM[DD[HH[MM[SS]]]]]``; other characters separate.

    Days beyond the month's end run on into the next; what 32 bits don't hold is refused.
    """
    digits = re.sub("[^0-9]", "", text)
    if len(digits) not in (4, 6, 8, 10, 12, 14):
        raise ValueError(f"bad date: {text!r}")
    parts = [int(digits[:4]), *(int(digits[k : k + 2]) for k in range(4, len(digits), 2))]
    y, m, d, hour, minute, second = parts + [1, 1, 0, 0, 0][len(parts) - 1 :]
    if not (1 <= m <= 12 and 1 <= d <= 31 and hour < 24 and minute < 60 and second < 60):
        raise ValueError(f"bad date: {text!r}")
    if y < 1970:
        return 0
    if y > 2106:
        raise ValueError(f"date out of range: {text!r}")
    seconds = int(time.mktime((y, m, d, hour, minute, second, 0, 0, -1)))
    if seconds >= 1 << 32:
        raise ValueError(f"date out of range: {text!r}")
    return max(0, seconds)


def time_filter(text: str) -> tuple[str, bool, str]:
    """The kinds of time (of m, c and a; m if none is named), whether it joins the OR group, and the rest."""
    head = re.match("[mcao]*", text)[0]
    return "".join(ch for ch in head if ch != "o") or "m", "o" in head, text[len(head) :]


def auto_name(template: str, moment: datetime) -> str:
    """A stamp for names: ``YYYY MM DD HH mm SS`` are replaced; all of them without a template."""
    out = template or "YYYYMMDDHHmmSS"
    for mark, value in (("YYYY", f"{moment.year:04}"), ("MM", f"{moment.month:02}"), ("DD", f"{moment.day:02}"), ("HH", f"{moment.hour:02}"), ("mm", f"{moment.minute:02}"), ("SS", f"{moment.second:02}")):
        out = out.replace(mark, value)
    return out


def volume_name(stem: str, part: int, count: int, old: bool = False) -> str:
    if old:
        return f"{stem}.rar" if part == 1 else f"{stem}.{chr(ord('r') + (part - 2) // 100)}{(part - 2) % 100:02d}"
    return f"{stem}.part{part:0{len(str(count))}d}.rar"
