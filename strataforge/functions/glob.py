"""Ignore globs compiled to one regular expression on the driver.

A pattern is matched segment by segment and anchored at both ends: ``*`` and
``?`` stay inside a segment, ``[..]`` is a character class (``^`` negates), a
backslash quotes, ``**`` as a whole segment stands for any number of segments,
also none. Empty segments at the end of a pattern vanish. A malformed segment
matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names every repository ignores: its own folder and the pointer to it.
ALWAYS = (".strata", ".strata-pointer")


class Malformed(ValueError):
    """The glob of one segment cannot be read."""


def _class(segment: str, at: int) -> tuple[str, int]:
    """Regex of the class starting behind ``[`` and the place behind its ``]``."""
    out, n = "[", len(segment)
    if at < n and segment[at] == "^":
        out, at = "[^/", at + 1
    ranges = 0
    while True:
        if at < n and segment[at] == "]" and ranges:
            return (r"[^\s\S]" if out == "[" else out + "]"), at + 1  # only empty ranges: nothing
        ends = []
        for _ in range(2):
            if at >= n or segment[at] in "]-":
                raise Malformed(segment)
            if segment[at] == "\\":
                at += 1
                if at >= n:
                    raise Malformed(segment)
            ends.append(segment[at])
            at += 1
            if len(ends) == 2 or at >= n or segment[at] != "-":
                break
            at += 1
        if at >= n:
            raise Malformed(segment)
        low, high = ends[0], ends[-1]
        if low <= high:
            out += re.escape(low) + "-" + re.escape(high)
        ranges += 1


def segment_regex(segment: str) -> str:
    """Regex of one segment without anchors."""
    out, at = "", 0
    while at < len(segment):
        c = segment[at]
        at += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            part, at = _class(segment, at)
            out += part
        elif c == "\\":
            if at >= len(segment):
                raise Malformed(segment)
            out += re.escape(segment[at])
            at += 1
        else:
            out += re.escape(c)
    return out


def glob_regex(pattern: str) -> str | None:
    """Anchored regex of a whole pattern; null if it can match nothing."""
    parts = pattern.split("/")
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    try:
        body = [None if p == "**" else segment_regex(p) for p in parts]
    except Malformed:
        return None
    body = [b for i, b in enumerate(body) if b is not None or i == 0 or body[i - 1] is not None]
    if body == [None]:
        return "^.*$"
    out = ""
    for i, b in enumerate(body):
        last = i == len(body) - 1
        if b is None:
            # between two segments, at the start, or everything below a directory
            out += "(?:/.*)?" if last else "(?:[^/]*/)*"
        else:
            out += b + ("" if last or (body[i + 1] is None and i + 1 == len(body) - 1) else "/")
    return f"^{out}$"


def rules(lines: Iterable[str]) -> tuple[list[str], list[str]]:
    """(static names, patterns) of an ignore file; blanks and ``#`` lines are skipped."""
    static, patterns = list(ALWAYS), []
    for line in lines:
        line = line.strip()
        if line and not line.startswith("#"):
            (patterns if any(c in line for c in "*?[") else static).append(line)
    return static, patterns


def ignored(path: Column, static: Iterable[str], patterns: Iterable[str]) -> Column:
    """True if a path is a static name or matches any pattern; null paths are not."""
    found = [r for p in patterns if (r := glob_regex(p))]
    test = path.isin(list(static))
    if found:
        test = test | path.rlike("|".join(f"(?:{r})" for r in found))
    return F.coalesce(test, F.lit(False))
