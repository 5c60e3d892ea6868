"""Patterns written once, in Python's syntax, for the JVM and for Python kernels alike.

Java's classes are ASCII without (?U) and still differ with it; see `java`.
"""

from __future__ import annotations

import re

_W = r"\p{L}\p{N}_"
_S = r"\s\x1C-\x1F"
_EDGE = rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
#: What only word characters match, as the next or the last thing beside a word boundary: half of the test is then known.
_NEXT = re.compile(r"\\[dw]|[^\W_]|\[(?:[^\W_](?:-[^\W_])?|\\[dw])+\]")
_LAST = re.compile(r"(?:\\[dw]|(?<![\\\w])[^\W_]|\[(?:[^\W_](?:-[^\W_])?|\\[dw])+\])(?:\{[1-9]\d*(?:,\d*)?\}|\+)?$")


def _edge(pattern: str, i: int) -> str:
    """A word boundary at pattern[i:i + 2]; cheaper where the atom beside it settles one side."""
    after = _NEXT.match(pattern, i + 2)
    if after and pattern[after.end() : after.end() + 1] not in ("?", "*") and pattern[after.end() : after.end() + 2] != "{0":
        return f"(?<![{_W}])"
    return f"(?![{_W}])" if _LAST.search(pattern[:i]) else _EDGE


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The Java pattern that finds what Python's `re` finds for `pattern` in a str."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e == "w":
                out.append(_W if inside else f"[{_W}]")
            elif e == "W":
                out.append(f"[^{_W}]")
            elif e == "s":
                out.append(_S if inside else f"[{_S}]")
            elif e == "S":
                out.append(f"[^{_S}]")
            elif e == "b" and not inside:
                out.append(_edge(pattern, i))
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[" and inside:
            out.append("\\[")
        else:
            if c == "[":
                inside = True
                if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                    raise ValueError("escape ] in a class")
            elif c == "]":
                inside = False
            out.append(c)
        i += 1
    return f"(?dU{'i' if ignore_case else ''}{'m' if multiline else ''})" + "".join(out)
