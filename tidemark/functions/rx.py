"""Python regular expressions as Java ones: named groups by index, Unicode classes, end anchors, backreferences."""

from __future__ import annotations

import re
from typing import NamedTuple


class Translated(NamedTuple):
    java: str
    groups: dict[str, int]


def translate(pattern: str) -> Translated:
    """Raises ValueError on constructs that Java has no equal of."""
    groups = dict(re.compile(pattern).groupindex)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            if not in_class and nxt == "Z":
                out.append(r"\z")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if in_class:
            if c == "[":
                out.append(r"\[")
            else:
                out.append(c)
                in_class = c != "]" or pattern[i - 1] == "["
        elif c == "[":
            in_class = True
            out.append(c)
        elif pattern.startswith("(?P<", i):
            out.append("(")
            i = pattern.index(">", i)
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\{groups[pattern[i + 4 : end]]}")
            i = end
        elif pattern.startswith("(?(", i):
            raise ValueError("conditional groups are not supported")
        elif c == "$":
            out.append(r"(?=\n?\z)")
        else:
            out.append(c)
        i += 1
    return Translated("(?U)" + "".join(out), groups)


def replacement(text: str, groups: dict[str, int]) -> str:
    r"""``\1`` and ``\g<name>`` as ``$1``; dollar signs stay literal."""
    text = text.replace("$", r"\$")
    text = re.sub(r"\\g<(\w+)>", lambda m: f"${groups.get(m[1], m[1])}", text)
    return re.sub(r"\\(\d)", r"$\1", text)
