"""Pieces of a text that a pre-tokenising BPE encodes independently, and caches over them.

The pre-token patterns here never join a space and a following non-space to what is
before them, so cutting a text before such spaces changes no id; nor does cutting around
a lone line feed, or between a letter or digit and the ASCII punctuation that ends a word.
Words repeat, so each distinct piece goes through the library once and is then looked up.
"""

from __future__ import annotations

import string
from collections.abc import Callable

#: Marks that may be cut from the end of a word; the apostrophe opens contractions and is none.
ENDS = string.punctuation.replace("'", "")
VERBATIM = "\n\n"


def _line_units(line: str) -> list[str]:
    parts = line.split(" ")
    if line.split() == parts:  # single spaces between words, and no other white space
        return [parts[0], *[" " + p for p in parts[1:]]]
    units = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            units.append(" " + p)
        else:
            units[-1] += " " + p
    return units if units[0] else units[1:]


def split_units(text: str) -> list[str]:
    """Cut before every space that a non-space follows, and around every lone line feed between non-spaces.

    The pieces concatenate to ``text``. White space here is the widest notion
    (``str.isspace``): cutting less is always safe.
    """
    lines = text.split("\n")
    units: list[str] = []
    held = ""
    last = len(lines) - 1
    for i, line in enumerate(lines):
        held += line
        if i < last:
            after = lines[i + 1]
            if not line or not after or line[-1].isspace() or after[0].isspace():
                held += "\n"  # not a lone line feed: no cut here
                continue
            units += _line_units(held)
            units.append("\n")
        elif held:
            units += _line_units(held)
        held = ""
    return units


def unit_of(key: str) -> str:
    """The piece of text that a key stands for."""
    if key.startswith(VERBATIM):
        return key[len(VERBATIM) :]
    return key if key[:1] == "\n" else " " + key


def quick_keys(text: str) -> list[str] | None:
    """A key for each piece: ``w`` for a space and w, line feed and w for these, VERBATIM and u for u itself.

    Right for texts whose white space is single spaces and lone line feeds; other texts give
    keys that are no ``regular`` ones, or None.
    """
    keys = text.replace("\n", " \n").split(" ")
    first = keys[0]
    if not first:
        return keys[1:]
    if first.split() != [first]:
        return None
    keys[0] = VERBATIM + first
    return keys


def slow_keys(text: str) -> list[str]:
    """Keys of any text."""
    return [u[1:] if is_plain(u) else VERBATIM + u for u in split_units(text)]


def regular(key: str) -> bool:
    word = unit_of(key)[1:] if not key.startswith(VERBATIM) else "w"
    return word.split() == [word]


class UnitCache:
    """Values of a text's pieces. ``fill`` computes those of new pieces, ``join`` that of a word and what ends it.

    Bounded: two generations of at most ``most`` pieces each. A full one becomes the old
    one, and of the one before only pieces that were met meanwhile are kept.
    """

    def __init__(self, fill: Callable[[list[str]], list], join: Callable[[object, object], object], most: int):
        self.fill, self.join, self.most = fill, join, most
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def _promoted(self, keys: set[str]) -> set[str]:
        """Takes what the old generation knows into the new one; the keys that are left."""
        known = keys & self.old.keys()
        self.new.update((k, self.old[k]) for k in known)
        return keys - known

    def _learn(self, keys: list[str]) -> None:
        parts: dict[str, tuple[str, str]] = {}
        wanted: dict[str, None] = {}
        for k in keys:
            base = k if k.startswith(VERBATIM) else k.rstrip(ENDS)
            if base and len(base) < len(k) and base[-1].isalnum():
                parts[k] = base, VERBATIM + k[len(base) :]
                wanted.update(dict.fromkeys(parts[k]))
            else:
                wanted[k] = None
        fresh = list(self._promoted(wanted.keys() - self.new.keys()))
        for start in range(0, len(fresh), 20_000):
            some = fresh[start : start + 20_000]
            self.new.update(zip(some, self.fill([unit_of(k) for k in some]), strict=True))
        for k, (base, end) in parts.items():
            self.new[k] = self.join(self.new[base], self.new[end])

    def lookup(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        cut = [quick_keys(t) for t in texts]
        for i, keys in enumerate(cut):
            if keys is None:
                cut[i] = slow_keys(texts[i])
        fresh = self._promoted(set().union(*cut).difference(self.new))
        if odd := {k for k in fresh if not regular(k)}:
            for i, keys in enumerate(cut):
                if not odd.isdisjoint(keys):
                    cut[i] = slow_keys(texts[i])
            fresh = self._promoted(set().union(*cut).difference(self.new))
        self._learn(list(fresh))
        get = self.new.__getitem__
        return [list(map(get, keys)) for keys in cut]


def is_plain(unit: str) -> bool:
    """One leading space and no other white space."""
    return unit[0] == " " and is_bare(unit[1:])


def is_bare(unit: str) -> bool:
    """No white space."""
    return unit.split() == [unit]


def in_blocks(texts: list[str | None], most_chars: int = 4 << 20):
    """(start, texts) blocks of about ``most_chars`` characters; null counts as empty."""
    start, held, block = 0, 0, []
    for i, t in enumerate(texts):
        block.append(t or "")
        held += len(t or "")
        if held >= most_chars:
            yield start, block
            start, held, block = i + 1, 0, []
    if block:
        yield start, block
