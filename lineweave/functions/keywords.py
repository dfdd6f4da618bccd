"""Case folding, keywords and path keywords outside the JVM: the same as in ``text``, each word taken apart once."""

from __future__ import annotations

import re

from lineweave.functions.text import FOLDS, STOPWORDS, TERM

_TERM, _CUT, _PATH, _STOP = re.compile(TERM), re.compile("[.-]+"), re.compile("[A-Za-z0-9]+"), frozenset(STOPWORDS)


def casefold(text: str) -> str:
    """Case folding as far as ASCII letters can come of it."""
    if not text.isascii():
        for a, b in FOLDS:
            text = text.replace(a, b)
    return text.lower()


def physical_lines(text: str) -> list[str]:
    """Lines without their ends; a final line end makes no further line, an empty text has none."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def path_keywords(path: str) -> list[str]:
    """Distinct alphanumeric components of a path without stop words."""
    return [t for t in dict.fromkeys(_PATH.findall(casefold(path))) if t not in _STOP]


class Keywords:
    """Remembers words within a bound."""

    LIMIT = 500_000

    def __init__(self) -> None:
        self.known: dict[str, list[str]] = {}

    def _parts(self, word: str) -> list[str]:
        k = word.strip(".-")
        if not k or k in _STOP:
            return []
        parts = _CUT.split(k)
        return [t for t in dict.fromkeys([k, *parts, *(x for p in parts for x in p.split("_"))]) if t and t not in _STOP]

    def of(self, text: str) -> list[str]:
        """Distinct keywords in order of occurrence, each followed by its components and these components' parts."""
        out: dict[str, None] = {}
        for w in dict.fromkeys(_TERM.findall(casefold(text))):
            if (found := self.known.get(w)) is None:
                if len(self.known) >= self.LIMIT:
                    self.known.clear()
                found = self.known[w] = self._parts(w)
            out.update(dict.fromkeys(found))
        return list(out)
