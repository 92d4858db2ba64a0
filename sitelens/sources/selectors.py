"""CSS selectors, compiled to tests of the elements that a parser has open.

Known: type and universal selectors, #id, .class, [attribute] with = ~= |= ^= $= *=, the descendant and child combinators, and lists. Any
other selector is an error, as a malformed one is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
PART = re.compile(rf"""\#(?P<id>(?:{NAME}|[\w-]+)) | \.(?P<cls>{NAME}) | \[\s*(?P<attr>{NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<v>[\w-]+))\s*)?\]""", re.X)
TYPE = re.compile(rf"\*|{NAME}")
NEXT = re.compile(r"\s*(>)\s*|(\s+)")

TESTS = {
    None: lambda have, want: True,
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
}


@dataclass(frozen=True)
class Compound:
    """What one element must be, and how the compound before it stands to it: '>' for the parent, ' ' for any element around it."""

    tag: str | None
    tests: tuple[tuple[str, str | None, str], ...]
    before: str = ""

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        return (self.tag is None or self.tag == tag) and all(name in attrs and TESTS[op](attrs[name], want) for name, op, want in self.tests)


def compiled(selector: str) -> list[list[Compound]]:
    """The selectors of a list, each as its compounds from left to right."""
    return [_chain(part.strip()) for part in _split(selector)]


def _split(selector: str) -> list[str]:
    """The parts between commas that no brackets or quotes are around."""
    parts, depth, quote = [""], 0, ""
    for c in selector:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        elif c == "," and not depth:
            parts.append("")
            continue
        parts[-1] += c
    return parts


def _chain(text: str) -> list[Compound]:
    found, at, before = [], 0, ""
    while True:
        start, tag, tests = at, None, []
        if m := TYPE.match(text, at):
            tag, at = m[0].lower() if m[0] != "*" else None, m.end()
        while m := PART.match(text, at):
            at = m.end()
            if m["id"]:
                tests.append(("id", "=", m["id"]))
            elif m["cls"]:
                tests.append(("class", "~=", m["cls"]))
            else:
                tests.append((m["attr"].lower(), m["op"], next((m[k] for k in ("q", "a", "v") if m[k] is not None), "")))
        if at == start:
            raise ValueError(f"not a selector: {text!r}")
        found.append(Compound(tag, tuple(tests), before))
        if at == len(text):
            return found
        m = NEXT.match(text, at)
        if not m:
            raise ValueError(f"not a selector: {text!r}")
        before, at = ">" if m[1] else " ", m.end()


def chain_fits(chain: list[Compound], stack: list[tuple[str, dict[str, str]]]) -> bool:
    """Whether the last element of a stack of open elements fits a chain, whose other compounds fit elements around it."""
    if not chain[-1].fits(*stack[-1]):
        return False

    def rest(i: int, j: int) -> bool:  # chain[:i + 1] is still to fit elements up to stack[j]; chain[i + 1] has fitted stack[j + 1]
        if i < 0:
            return True
        if chain[i + 1].before == ">":
            return j >= 0 and chain[i].fits(*stack[j]) and rest(i - 1, j - 1)
        return any(chain[i].fits(*stack[k]) and rest(i - 1, k - 1) for k in range(j, -1, -1))

    return rest(len(chain) - 2, len(stack) - 2)
