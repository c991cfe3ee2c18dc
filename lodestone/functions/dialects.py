"""Delimiter-and-quote dialects of fields that hold several values, and code lengths of values (plain Python)."""

from __future__ import annotations

import re
from itertools import combinations
from math import log2

#: Delimiters a dialect may use, by their letter. A slash only counts between white space.
DELIMITERS = {"p": "|", "s": ";", "c": ",", "t": "\t", "n": "\n", "w": "；", "b": "¦", "l": "/"}
QUOTES = '"“”„'


_COMPILED: dict = {}  # not lru_cache, whose wrapper wouldn't travel to the workers


def _patterns(letters: str):
    if letters in _COMPILED:
        return _COMPILED[letters]
    single = "".join(re.escape(DELIMITERS[x]) for x in letters if x != "l")
    blank = "".join(DELIMITERS[x] for x in letters if x in "tn")
    ws = f"[^\\S{re.escape(blank)}]" if blank else r"\s"
    either = [f"[{single}]"] * bool(single) + [r"(?:(?<=\s)|(?<![\s\S]))/(?=\s|\Z)"] * ("l" in letters)
    delimiter = "|".join(either) or r"(?!)"
    quoted = rf'{ws}*(?:"((?:[^"]|"")*)"|[“„]((?:[^”]|””)*)”){ws}*(?=\Z|{delimiter})'
    _COMPILED[letters] = re.compile(delimiter), re.compile(quoted)
    return _COMPILED[letters]


def parse(text: str, letters: str, quotes: bool) -> tuple[list[str], list[str]]:
    """Values of a field (empty ones too) and the delimiters between them under a dialect."""
    delimiter, quoted = _patterns(letters)
    values, between, at = [], [], 0
    while True:
        m = quoted.match(text, at) if quotes else None
        if m:
            value = m[1].replace('""', '"') if m[1] is not None else m[2].replace("””", "”")
            values.append(value.strip())
            at = m.end()
            d = delimiter.match(text, at)
        else:
            d = delimiter.search(text, at)
            values.append(text[at : d.start() if d else len(text)].strip())
        if not d:
            return values, between
        between.append(d[0])
        at = d.end()


def dialects(text: str) -> list[tuple[str, bool]]:
    """Dialects worth scoring: all subsets of the delimiters that divide the field under the finest parse, with and without quoting."""
    used = set(parse(text, "".join(DELIMITERS), True)[1])
    letters = [x for x, d in DELIMITERS.items() if d in used]
    sets = ["".join(c) for k in range(len(letters) + 1) for c in combinations(letters, k)]
    return [(s, q) for s in sets for q in ([True, False] if any(c in text for c in QUOTES) else [True])]


def kind(c: str) -> str:
    """Class of a character in the model of values that aren't in the dictionary."""
    return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() and c not in "\t\n" else c if c in "|;,\t\n；¦/\"“”'()[]-._:" else "#"


#: Bits to name a character within its class.
WITHIN = {"A": log2(26), "a": log2(26), "9": log2(10), "#": 12.0}


def steps(value: str) -> list[str]:
    """Transitions of the order-2 model over runs of classes; ^ and $ are the ends."""
    s = "^^" + "".join(kind(c) for c in value) + "$"
    return [s[i - 2 : i + 1] for i in range(2, len(s))]


def novel_bits(value: str, model: dict[str, float]) -> float:
    return sum(model.get(t, 12.0) for t in steps(value)) + sum(WITHIN.get(kind(c), 0.0) for c in value)


def model_from(counts: dict[str, int]) -> dict[str, float]:
    """Bits of every transition, from transition counts (smoothed over the classes)."""
    total: dict[str, int] = {}
    for t, n in counts.items():
        total[t[:2]] = total.get(t[:2], 0) + n
    return {t: -log2((n + 0.1) / (total[t[:2]] + 3)) for t, n in counts.items()}
