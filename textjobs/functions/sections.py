"""The section parse and item normalisation of one text, for use inside
Arrow-batched UDFs.

``operators.parse`` has the same steps as JVM expressions, in which every line
and item passes some twenty interpreted expressions; here a text is cut by
whole-string methods and a distinct item is worked on once.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from textjobs.functions.fixed import UNITS

#: Results that a worker keeps per function.
KEPT = 150_000

# The patterns of operators.parse.  str.strip() and \s take the white space of functions.text.
_QUANTITY = r"[\d½¼¾\s/.\-]+"
_AMOUNT = re.compile(rf"{_QUANTITY}(?:(?:{'|'.join(UNITS)})s?\s+(?:{_QUANTITY})?)?")
_MARKS = "-*•"
# Over a text in lower case; what may stand before a header does not move its end.
_LOOSE_ITEMS = re.compile(r"ingredients?[*_]*:?[*_]*\s*\n")
_LOOSE_END = re.compile(r"\n\s*(?:#{1,3}\s*)?[*_]*instructions?")
_LOOSE_BODY = re.compile(r"instructions?[*_]*:?[*_]*\s*\n")
_DOTTED = "İ"  # the one letter that is longer in lower case


class Kept(dict):
    """Results of a function by argument; it starts anew when it is full."""

    def __init__(self, function: Callable[[str], str]):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        self[key] = found = self.function(key)
        return found


def _parts(text: str, separator: str) -> list[str]:
    return [s for part in text.split(separator) if (s := part.strip())]


def _lines(block: str) -> list[str]:
    return _parts(block, "\n")


def _marked(lines: Iterable[str]) -> list[str]:
    return [s for line in lines if (s := line[1:].strip() if line[0] in _MARKS else line)]


def split_items(lines: list[str]) -> list[str]:
    """Items of a block's lines without blank ones: several are bullet lines
    that may hold comma lists; one is a comma list."""
    bare = _marked(lines) if len(lines) > 1 else lines
    return [item for line in bare for item in (_parts(line, ",") if "," in line else (line,))]


def normalise_item(item: str) -> str:
    """Lower case without the leading quantity and unit."""
    plain = item.lower().strip()
    amount = _AMOUNT.match(plain)
    return plain[amount.end():].strip() if amount else plain


#: By item, and by line of a block of several lines, where it has no comma.
_of_item = Kept(normalise_item)
_of_line = Kept(lambda line: normalise_item(line[1:] if line[0] in _MARKS else line))


def normal_items(lines: list[str]) -> set[str]:
    """The normalised items of a block's lines, blanks left out; what comes
    again is looked up, an item with the white space around it."""
    distinct = set(lines)
    listed = [line for line in distinct if "," in line]
    if listed:
        distinct.difference_update(listed)
        bare = _marked(listed) if len(lines) > 1 else listed
    found = set(map((_of_line if len(lines) > 1 else _of_item).__getitem__, distinct))
    if listed:
        found.update(map(_of_item.__getitem__, set().union(*(line.split(",") for line in bare))))
    found.discard("")
    return found


def sections(text: str) -> tuple[str, list[str], str]:
    """(title, lines of the item block without blank ones, body).

    The strict form needs bold headers.  Where it finds no items or no body, a
    looser pattern over the whole text fills just that field."""
    t = text.strip()
    if not t:
        return "", [], ""
    heads, bolds, title = [], [], None
    at = t.find("**")
    while at >= 0:  # once per line that holds two stars
        start, end = t.rfind("\n", 0, at) + 1, t.find("\n", at)
        end = len(t) if end < 0 else end
        if at == start or not t[start:at].strip():
            line = t[at:end].rstrip()
            low, closed = line.lower(), line.endswith("**")
            names = "i" if "ingredient" in low else "b" if "instruction" in low else None
            if names:
                heads.append((start, end + 1, names))
            else:
                if closed and len(line) >= 4 or line in ("**", "***"):
                    bolds.append(start)
                if title is None and closed and len(line) >= 5:
                    title = line.strip("*").strip()
        at = t.find("**", end)
    blocks: dict[str, list[str]] = {"i": [], "b": []}
    for (_, low, names), high in zip(heads, [start for start, _, _ in heads[1:]] + [len(t)]):
        if names == "i":
            high = min((b for b in bolds if low <= b < high), default=high)
        blocks[names].append(t[low:high])
    lines, body = _lines("\n".join(blocks["i"])), "\n".join(_lines("\n".join(blocks["b"])))
    if not split_items(lines[:2]) and not split_items(lines):
        lines = _lines(_loose(text, _LOOSE_ITEMS, _LOOSE_END))
    return title or "", lines, body or _loose(text, _LOOSE_BODY).strip()


def _loose(text: str, head: re.Pattern, end: re.Pattern | None = None) -> str:
    """What stands behind the first match of ``head``, up to ``end`` if it comes; headers are of ASCII letters in either case."""
    low = text.replace(_DOTTED, ".").lower()
    found = head.search(low)
    if not found:
        return ""
    stop = end.search(low, found.end()) if end else None
    return text[found.end():stop.start() if stop else len(text)]
