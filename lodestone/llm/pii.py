"""Personal items in free text: a semi-Markov conditional random field over whole candidate spans.

Each line of a text is a sequence in which segments are either single personal items or ordinary text. Proposal grammars list
candidate segments with several boundaries (e-mail addresses, number runs, street addresses, runs of capitalised
words); a candidate's score is the sum of the weights of its whole-span features: its shape, its structure and the
words around it. Dynamic programming over the candidates of a line, of which only segments without overlap
combine, chooses boundaries and kinds together, with weights for a kind following another. ``pii_training`` fits the
weights; they are kept in ``pii_weights.json``.

Defined results: null and empty texts have no items and stay as they are. Texts are read whole, in lines, however long;
a candidate has at most ``LONGEST`` characters. Equal items of one text are listed once by ``found``, and each is replaced.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "identity_number", "street_address", "name")
LONGEST = 160
#: Digits of a number.
FEWEST, MOST = 6, 34


def _letters(*kinds: str) -> str:
    """The characters of Unicode categories, as ranges of a character class."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in kinds]
    first = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    last = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))


_UP, _LOW = _letters("Lu", "Lt"), _letters("Ll", "Mn")
_CAP = rf"[{_UP}][{_LOW}'’]+"
_WORD = rf"(?:{_CAP}|[{_UP}]{{2,}})"
_PART = r"(?:(?:von|van|de la|dos|da|del|di|de|VON|VAN|DE LA|DOS|DA|DEL|DI|DE) )?"
_ELEMENT = rf"{_PART}(?:{_WORD}(?:-{_WORD})*|[{_UP}]\.)"
_TOWN = rf"{_CAP}(?: {_CAP}){{0,2}}"
_POSTCODE = r"[A-Z]{1,2}\d{1,2} \d[A-Z]{2}"


class Grammar:
    """Compiled proposal patterns."""

    def __init__(self):
        self.at = re.compile(r"@|[\[(]at[\])]", re.I)
        self.mailbox = re.compile(r"[\w.+-]+ ?\Z")
        self.domain = re.compile(r" ?[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?)[\w-]+)+", re.I)
        self.run = re.compile(r"(?<![\w@.,/-])(?:[A-Z]{2} )?(?:[A-Z]\d|[+(]?\d)[0-9A-Z]*(?:[ ./()-]{1,3}\d[0-9A-Z]*|[ -][A-Z](?![\w.]))*")
        self.groups = re.compile(r"[0-9A-Z]+")
        self.chain = re.compile(rf"(?<![\w-]){_ELEMENT}(?:,? {_ELEMENT})+(?![\w-])")
        self.element = re.compile(rf"(?<![\w-]){_ELEMENT}")
        unit = r"(?:(?:Flat|Suite|Unit|Apartment|Apt\.) \w{1,5}, )?"
        english = rf"{unit}(?:{_CAP} House, )?\d{{1,4}}[a-z]? {_CAP}(?: {_CAP})? ?(?:(?<=Road)|(?<=Street)|(?<=Lane)|(?<=Hill)|(?<=Drive)|(?<=Ave)\.?|(?<=Avenue)|(?<=Way)|(?<=Court)|(?<=Close)|(?<=Place)|(?<=Square))(?:, Suite \d+)?"
        french = rf"\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse) (?:des |de la |du |de )?{_CAP}(?: {_CAP})?"
        german = rf"{_CAP}(?:(?<=straße)|(?<=strasse)|(?<=str)\.|(?<=weg)|(?<=platz)|(?<=allee)|(?<=gasse)|(?<=ring)) \d{{1,4}} ?[a-z]?(?![\w])"
        spanish = rf"(?:Calle|Avenida|Plaza|Paseo|Camino) (?:de la |del |de )?{_CAP}(?: {_CAP})? \d{{1,4}}(?:, \d+º ?[A-Z])?"
        self.street = re.compile(rf"(?<![\w-])(?:{english}|{french}|{german}|{spanish})")
        self.street_hint = re.compile(r"House|Road|Street|Lane|Hill|Drive|Ave|Way|Court|Close|Place|Square|rue |avenue |boulevard |place |chemin |quai |impasse |stra(?:ß|ss)e |str\. |weg |platz |allee |gasse |ring |Calle |Avenida |Plaza |Paseo |Camino ")
        self.rest = re.compile(rf", (?:(?:[A-Z]{{1,2}}-)?\d{{4,5}} )?({_TOWN})(?: {_POSTCODE})?(?:, \d{{5}}(?!\d))?")
        self.before = re.compile(r"(?:[^\W\d_]+|\d+|[^\w\s])\Z")
        self.word = re.compile(r"[^\W\d_]+\.?|\d+|[^\w\s]")
        self.shape = re.compile(r"\d+")


def _around(g: Grammar, line: str, start: int, end: int) -> tuple[str, str, str, str]:
    """The two tokens before and after a span, numbers as 0, lower case."""
    left = g.word.findall(line[max(0, start - 40) : start])
    right = g.word.findall(line[end : end + 30])
    t = ["0" if x[0].isdigit() else x.lower() for x in (*left[-2:], *right[:2])]
    k = len(left[-2:])
    l, r = t[:k], t[k:]
    return (l[-1] if l else "^"), (l[-2] if len(l) > 1 else "^"), (r[0] if r else "$"), (r[1] if len(r) > 1 else "$")


def _class(c: str) -> str:
    """The kind of a character beside a span, itself if it is a mark."""
    return "^" if not c else "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c


def _candidate(g, line, start, end, kind, own):
    l1, l2, r1, r2 = _around(g, line, start, end)
    f = [f"{kind}|bias", f"{kind}|lc={_class(line[max(0, start - 4) : start].rstrip()[-1:])}", f"{kind}|rc={_class(line[end : end + 2].lstrip()[:1])}", f"{kind}|l1={l1}", f"{kind}|l2={l2} {l1}", f"{kind}|r1={r1}", f"{kind}|r2={r1} {r2}", *(f"{kind}|{x}" for x in own)]
    return start, end, kind, f


def proposals(g: Grammar, line: str) -> list:
    """(start, end, kind, features) of the candidate segments of a line."""
    out = []
    for m in g.at.finditer(line):
        low = max(0, m.start() - 64)
        left, right = g.mailbox.search(line[low : m.start()]), g.domain.match(line[m.end() : m.end() + 100])
        if left and right:
            end = m.end() + right.end()
            last = re.findall(r"[\w-]+", right[0])[-1]
            out.append(_candidate(g, line, low + left.start(), end, "email", ["letters" if last.isalpha() else "digits", f"at={m[0].lower()}"]))
    for m in g.run.finditer(line):
        text = m[0]
        if sum(c.isdigit() for c in text) < FEWEST:
            continue
        groups = [(x.start(), x.end()) for x in g.groups.finditer(text)]
        for a in range(len(groups)):
            for b in range(a, len(groups)):
                s, e = groups[a][0], groups[b][1]
                while s and text[s - 1] in "+(" and a == 0:
                    s -= 1
                span = text[s : min(e, s + LONGEST + 1)]
                digits = sum(c.isdigit() for c in span)
                if digits > MOST or e - s > LONGEST:
                    break  # as are all that end later
                if digits < FEWEST:
                    continue
                shape = g.shape.sub(lambda d: f"d{len(d[0])}", re.sub(r"[A-Z]", "A", span))
                inner = "whole" if s == 0 and e == len(text) else "part"
                for kind in ("phone", "identity_number"):
                    out.append(_candidate(g, line, m.start() + s, m.start() + e, kind, [f"shape={shape}", f"n={digits}", inner, f"first={span[0] if not span[0].isalnum() else span[:2] if span[0] == '0' else 'A' if span[0].isalpha() else 'd'}"]))
    if g.street_hint.search(line):
        for m in g.street.finditer(line):
            starts, ends = [m.start()], {m.end(): "street"}
            comma = line.find(", ", m.start(), m.end())
            if comma > 0:
                starts.append(comma + 2)
            rest = g.rest.match(line, m.end())
            if rest:
                for cutoff in {rest.end(), rest.end(1), rest.start(1) + len(rest[1].split(" ")[0]), rest.start(1) + len(" ".join(rest[1].split(" ")[:2]))}:
                    ends[cutoff] = "full" if cutoff == rest.end() else "town" if cutoff == rest.end(1) else "part"
            for s in starts:
                for e, how in ends.items():
                    if e - s <= LONGEST:
                        more = bool(re.match(rf"(?: {_POSTCODE}|, \d{{5}})", line[e : e + 10]))
                        out.append(_candidate(g, line, s, e, "street_address", [f"end={how}", "first" if s == m.start() else "inner", "more" if more else "no more"]))
    for m in g.chain.finditer(line):
        parts = [(x.start() + m.start(), x.end() + m.start()) for x in g.element.finditer(m[0])]
        n = len(parts)
        for a in range(n - 1):
            first = line[parts[a][0] : parts[a][1]]
            # a particle before the first word may belong to the sentence
            for s in {parts[a][0], parts[a][1] - len(first.split(" ")[-1])}:
                for b in range(a + 1, n):
                    e = parts[b][1]
                    if e - s > LONGEST:
                        break
                    pattern, previous, cores = [], s, []
                    for x, y in ((s, parts[a][1]), *parts[a + 1 : b + 1]):
                        words = line[x:y].split(" ")
                        core = words[-1]
                        cores.append(core)
                        pattern.append(("," if "," in line[previous:x] else "") + ("p" if len(words) > 1 else "") + ("I" if core.endswith(".") else "U" if core.isupper() and len(core) > 1 else "C"))
                        previous = y
                    p = " ".join(pattern)
                    if p.count(",") > 1 or "C" not in p and "U" not in p:
                        continue
                    l1, l2, r1, r2 = _around(g, line, s, e)
                    edge = ("a" if a == 0 else "") + ("b" if b == n - 1 else "")
                    f = [f"name|p={p}", f"name|lc={_class(line[max(0, s - 4) : s].rstrip()[-1:])}", f"name|rc={_class(line[e : e + 2].lstrip()[:1])}", f"name|l1={l1}", f"name|l2={l2} {l1}", f"name|r1={r1}", f"name|r2={r1} {r2}", "name|bias", f"name|edge={edge}", f"name|pl={p} {l1}"]
                    # short words at the ends may be titles or labels
                    f += [f"name|{at}={w.lower()}" for at, w in (("fw", line[s:e].split(" ")[0]), ("lw", cores[-1])) if len(w) <= 4]
                    if len(set(cores)) < len(cores):
                        f.append("name|twice")
                    out.append((s, e, "name", f))
    out.sort(key=lambda c: (c[0], c[1]))
    return out


def decode(candidates: list, weights: dict[str, float]) -> list:
    """The best set of segments without overlap: Viterbi over candidates, given the kind of the one before."""
    scored = []
    moves = [w for k in KINDS for b in ("^", *KINDS) if (w := weights.get(f"{b}>{k}"))]
    # a candidate below this only lowers a parse, whatever its neighbours
    least = -(2 * max(moves, default=0.0) - min(0.0, *moves)) - 1e-9 if len(moves) > 1 else -1e9
    for s, e, kind, f in candidates:
        v = 0.0
        for x in f:
            v += weights.get(x, 0.0)
        if v > min(least, 0.0):
            scored.append((s, e, kind, v))
    if not scored:
        return []
    # candidates are in order of their starts; by_end brings in those that ended before, whose best scores are known by then
    best, tops, passed = [], {}, 0
    by_end = sorted(range(len(scored)), key=lambda k: scored[k][1])
    for s, _, kind, v in scored:
        while scored[by_end[passed]][1] <= s:
            i = by_end[passed]
            if best[i][0] > tops.get(scored[i][2], (float("-inf"),))[0]:
                tops[scored[i][2]] = best[i][0], i
            passed += 1
        top, back = weights.get(f"^>{kind}", 0.0), -1
        for before, (score, i) in tops.items():
            t = score + weights.get(f"{before}>{kind}", 0.0)
            if t > top:
                top, back = t, i
        best.append((v + top, back))
    k = max(range(len(best)), key=lambda i: best[i][0])
    out = []
    if best[k][0] <= 0:
        return out
    while k >= 0:
        out.append(scored[k][:3])
        k = best[k][1]
    return out[::-1]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


def gradient(candidates: list, gold: set, weights: dict[str, float]) -> dict[str, float]:
    """Gradient of the log-likelihood of a line's gold segments {(start, end, kind)}."""
    n = len(candidates)
    v = [sum(weights.get(x, 0.0) for x in c[3]) for c in candidates]
    move = lambda a, b: weights.get(f"{a}>{b}", 0.0)
    before = [[j for j in range(k) if candidates[j][1] <= candidates[k][0]] for k in range(n)]
    alpha = []
    for k, c in enumerate(candidates):
        alpha.append(v[k] + _logsum([move("^", c[2]), *(alpha[j] + move(candidates[j][2], c[2]) for j in before[k])]))
    z = _logsum([0.0, *alpha])
    after: list[list[int]] = [[] for _ in range(n)]
    for k in range(n):
        for j in before[k]:
            after[j].append(k)
    beta = [0.0] * n
    for k in reversed(range(n)):
        beta[k] = _logsum([0.0, *(move(candidates[k][2], candidates[m][2]) + v[m] + beta[m] for m in after[k])])
    g: dict[str, float] = {}
    last = "^"
    for c in candidates:
        if c[:3] in gold:
            for x in (*c[3], f"{last}>{c[2]}"):
                g[x] = g.get(x, 0.0) + 1
            last = c[2]
    for k, c in enumerate(candidates):
        p = exp(alpha[k] + beta[k] - z)
        for x in c[3]:
            g[x] = g.get(x, 0.0) - p
        first = exp(move("^", c[2]) + v[k] + beta[k] - z)
        g[f"^>{c[2]}"] = g.get(f"^>{c[2]}", 0.0) - first
        for j in before[k]:
            q = exp(alpha[j] + move(candidates[j][2], c[2]) + v[k] + beta[k] - z)
            key = f"{candidates[j][2]}>{c[2]}"
            g[key] = g.get(key, 0.0) - q
    return g


def load_weights(path: str | None = None) -> dict[str, float]:
    with open(path or os.path.join(os.path.dirname(__file__), "pii_weights.json")) as f:
        return json.load(f)


def items(g: Grammar, text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal items of a text."""
    out, at = [], 0
    for line in text.split("\n"):
        found = proposals(g, line)
        if found:
            out += [(at + s, at + e, k) for s, e, k in decode(found, weights)]
        at += len(line) + 1
    return out


def find_items(df: DataFrame, identifier: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(identifier, kind, found, start) of every personal item."""
    weights = weights or load_weights()
    rows = df.select(F.col(f"`{identifier}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null and t <> ''")

    def run(batches):
        g = Grammar()
        for pdf in batches:
            out = [(i, k, t[s:e], s) for i, t in zip(pdf["i"], pdf["t"]) for s, e, k in items(g, t, weights)]
            yield pd.DataFrame(out, columns=["i", "kind", "found", "start"])

    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInPandas(run, f"i {kind}, kind string, found string, start int").withColumnRenamed("i", identifier)


def redact(df: DataFrame, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with every personal item of ``text`` replaced by a placeholder such as [EMAIL]; the rest is unchanged."""
    weights = weights or load_weights()

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        g = Grammar()

        def one(t):
            if not t:
                return t
            parts, at = [], 0
            for s, e, k in items(g, t, weights):
                parts += [t[at:s], f"[{k.upper()}]"]
                at = e
            return "".join(parts) + t[at:]

        return column.map(one)

    return df.withColumn(text, clean(F.col(f"`{text}`")))
