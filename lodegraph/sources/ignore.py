"""Ignore patterns as regular expressions, and which pattern of all has the last word on a path."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    regex: str
    include: bool  # true: the path is ignored


def compile_pattern(line: str) -> Pattern | None:
    """One line of an ignore file as a regular expression over relative paths (the whole path); None for blanks and comments."""
    line = line.rstrip("\n\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#") or line == "/":
        return None
    include = True
    if line.startswith("!"):
        include, line = False, line[1:]
    elif line.startswith(("\\#", "\\!")):
        line = line[1:]
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    anchored = "/" in line
    parts = [p for p in line.lstrip("/").split("/")]
    out = "" if anchored else "(?:.+/)?"
    last = len(parts) - 1
    for k, part in enumerate(parts):
        if part == "**":
            if k == last:
                out += ".+" if out in ("", "(?:.+/)?") or out.endswith("/") else "/.+"
                continue
            out += "(?:.+/)?"
            continue
        out += _glob(part) + ("/" if k < last else "")
    end = "/.*" if only_dirs else "(?:/.*)?"
    if parts[last] == "**":
        end = ""
    return Pattern(f"^{out}{end}$", include)


def _glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        i += 1
        if c == "*":
            while i < len(part) and part[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(part):
            out += re.escape(part[i])
            i += 1
        elif c == "[":
            j = i + 1 if i < len(part) and part[i] in "!^" else i
            j = part.find("]", j + 1 if j < len(part) and part[j] == "]" else j)
            if j < 0:
                out += r"\["
            else:
                body = part[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += "[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]"
                i = j + 1
        else:
            out += re.escape(c)
    return out


def compile_lines(lines: list[str]) -> list[Pattern]:
    return [p for line in lines if (p := compile_pattern(line)) is not None]


def ignored(path: Column, specs: list[tuple[str, list[Pattern]]]) -> Column:
    """The last pattern that matches decides, over all ignore files in the order of the walk; each sees paths below its own directory."""
    verdict = F.lit(False)
    for base, patterns in specs:
        below = F.startswith(path, F.lit(base + "/")) if base else F.lit(True)
        relative = F.substring(path, len(base) + 2, 1 << 30) if base else path
        for p in patterns:
            verdict = F.when(below & relative.rlike(p.regex), F.lit(p.include)).otherwise(verdict)
    return verdict


def matches(path: Column, patterns: list[Pattern]) -> Column:
    """The last of the patterns that matches decides."""
    return ignored(path, [("", patterns)])
