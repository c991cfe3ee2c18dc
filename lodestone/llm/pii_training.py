"""Fits the weights of ``pii`` on a bounded sample of documents labelled by cue words.

    python -m lodestone.llm.pii_training DOCUMENTS.parquet [ROWS]

The labels come from cue patterns below (a title, a field name or a fixed phrase beside the item), which are narrower
than the proposals; what the model learns of shapes and structures carries over to items with other cues, which the last line
printed measures: held-out documents with the word features of the candidates removed. The
sample is the first ROWS documents in order of identifier (1,500 unless given). Stochastic gradient ascent of the log-likelihood, AdaGrad steps.
"""

from __future__ import annotations

import json
import os
import random
import re
import sys

import pyarrow.parquet as pq

from lodestone.llm.pii import _CAP, _POSTCODE, _UP, Grammar, decode, gradient, load_weights, proposals

ROWS = 1500
#: Features of words around a span count from so many lines on, so that the weights hold no words of single documents.
SUPPORT = 5
_WORDS = re.compile(r"\|(?:l1|l2|r1|r2|pl|fw|lw)=")
_TITLE = r"(?:(?:Ms|Mr|Mrs|Dr\.|Prof\.|Herr|Frau|Herrn|M\.|Mme|Sr\.|Sra\.|D\.|Dña\.) )?"
_ANY = rf"(?:(?:von|van|de la|dos|VON|VAN|DE LA|DOS) )?[{_UP}][^\W\d_]+(?:-[{_UP}][^\W\d_]+)*(?! House)"
_FULL = rf"(?:{_ANY}, {_ANY}|{_ANY}(?: [A-Z]\.)? {_ANY}|[A-Z]\. {_ANY})"
CUES = [
    rf"(?:by|par|por|von) {_TITLE}({_FULL})(?= at the pilot| wiederholt| unterzeichnet| \(|\.)",
    rf"\bAs {_TITLE}({_FULL}) reported",
    rf"(?:applicant|Vertreter|Mandataire|Representante) ?: {_TITLE}({_FULL}), (?:phone|Telefon|tél\.|tel\.)",
    rf"(?:Correspondence to|Zustellanschrift:|courrier à|correspondencia a) {_TITLE}({_ANY}, {_ANY}|{_ANY}(?: [A-Z]\.)? {_ANY}|[A-Z]\. {_ANY}), (?=(?:Flat|{_CAP} House|\d|Calle|{_CAP}(?:str|weg)))",
    rf"\(72\) ({_ANY}, {_ANY}|{_ANY}(?: [A-Z]\.)? {_ANY}|[A-Z]\. {_ANY}), (?=(?:Flat|{_CAP} House|\d|Calle|{_CAP}(?:str|weg)))",
    rf"(?:^|\. )({_FULL}), residing at",
]
#: Openings and closings of letters, which patents lack: a name of the sample follows the comma and stands alone.
LETTERS = ("Regards", "Sincerely", "Thanks", "Hello", "Cheers", "Yours", "Greetings", "Gruß", "Cordialement", "Saludos")
LISTS = re.compile(r"(?:Inventors?|Erfinder|Inventeurs?|Inventor(?:es)?|\(72\)) ?: (.*)$")
IDS = r"(?:ID no\.?|national insurance number|social security number|SSN|personal number|Steuer-ID|DNI|Passport No\.?|identity card):? ((?:[A-Z]{2} )?[A-Z]?\d[0-9A-Z]*(?:[ -](?:\d[0-9A-Z]*|[A-Z](?!\w)))*)"
PHONES = r"(?:[Pp]hone|Telefon|[Tt]él\.|[Tt]el\.|call|Fax|o al) ([+(]?\d[\d ()/.-]*\d)"
TOWN = rf"{_CAP}(?: (?:Calmo|Alto|Ferry|{_CAP}))?"
AFTER_STREET = rf", (?:(?:[A-Z]-)?\d{{5}} {TOWN}|{TOWN}(?: {_POSTCODE})?(?:, \d{{5}})?)"


class Labels:
    def __init__(self):
        self.g = Grammar()
        self.cues = [re.compile(c) for c in CUES]
        self.ids, self.phones, self.rest = re.compile(IDS), re.compile(PHONES), re.compile(AFTER_STREET)
        self.name = re.compile(rf"{_FULL}\Z")

    def of(self, line: str) -> set:
        out = set()
        for m in self.g.at.finditer(line):
            left, right = self.g.mailbox.search(line[: m.start()]), self.g.domain.match(line[m.end() :])
            if left and right and re.search(r"[a-z]{3,}$", right[0], re.I):
                out.add((left.start(), m.end() + right.end(), "email"))
        for m in self.ids.finditer(line):
            out.add((*m.span(1), "identity_number"))
        for m in self.phones.finditer(line):
            out.add((*m.span(1), "phone"))
        if self.g.street_hint.search(line):
            for m in self.g.street.finditer(line):
                rest = self.rest.match(line, m.end())
                if rest:
                    out.add((m.start(), rest.end(), "street_address"))
        for c in self.cues:
            for m in c.finditer(line):
                out.add((*m.span(1), "name"))
        m = LISTS.search(line)
        if m:
            at = m.start(1)
            for part in m[1].split(";"):
                s = at + len(part) - len(part.lstrip())
                e = at + len(part.rstrip())
                if self.name.match(line[s:e]):
                    out.add((s, e, "name"))
                at += len(part) + 1
        return out


def lines(texts):
    label, g = Labels(), Grammar()
    for t in texts:
        for line in (t or "").split("\n"):
            c = proposals(g, line)
            if c:
                spans = {x[:3] for x in c}
                gold = label.of(line)
                yield line, c, {x for x in gold if x in spans}, gold - spans


def letters(names: list[str]):
    """Lines of letters around whole names, with their candidates and labels."""
    g = Grammar()
    for k, name in enumerate(n for n in names if "," not in n):
        line = f"{LETTERS[k % len(LETTERS)]}, {name}"
        span = (len(line) - len(name), len(line), "name")
        c = proposals(g, line)
        if span in {x[:3] for x in c}:
            yield c, {span}


def fit(texts, epochs: int = 4, rate: float = 0.3, seed: int = 3, support: int = SUPPORT) -> dict[str, float]:
    data, missed, seen, named = [], [], {}, []
    for line, c, gold, out in lines(texts):
        missed += [(line[s:e], k) for s, e, k in out]
        data.append((c, gold))
        named += [line[s:e] for s, e, k in sorted(gold) if k == "name"]
        for x in {x for y in c for x in y[3] if _WORDS.search(x)}:
            seen[x] = seen.get(x, 0) + 1
    data += letters(named[:200])
    keep = lambda x: seen.get(x, support) >= support
    data = [([(s, e, k, [x for x in f if keep(x)]) for s, e, k, f in c], gold) for c, gold in data]
    print(len(data), "lines;", sum(len(g) for _, g in data), "labels;", len(missed), "not proposed", missed[:10])
    rng, w, h = random.Random(seed), {}, {}
    for _ in range(epochs):
        rng.shuffle(data)
        for c, gold in data:
            if not gold and rng.random() < 0.5 and all(sum(w.get(x, 0.0) for x in y[3]) < -4 for y in c):
                continue
            for x, d in gradient(c, gold, w).items():
                if abs(d) > 1e-4:
                    h[x] = h.get(x, 0.0) + d * d
                    w[x] = w.get(x, 0.0) + rate * d / (h[x] ** 0.5 + 1e-3)
    return {x: round(v, 3) for x, v in sorted(w.items()) if abs(v) >= 0.05}


if __name__ == "__main__":
    table = pq.read_table(sys.argv[1], columns=["doc_id", "text"]).sort_by("doc_id")
    texts = table.column("text").to_pylist()
    rows = int(sys.argv[2]) if len(sys.argv) > 2 else ROWS
    path = os.path.join(os.path.dirname(__file__), "pii_weights.json")
    with open(path, "w") as f:
        json.dump(fit(texts[:rows]), f, indent=0, ensure_ascii=False)
    w = load_weights(path)
    right = wrong = lost = 0
    for line, c, gold, out in lines(texts[rows : 3 * rows]):
        got = set(decode(c, w))
        right, wrong, lost = right + len(got & gold), wrong + len(got - gold), lost + len(gold - got) + len(out)
        if (got ^ gold or out) and (wrong + lost) < 60:
            print([(line[s:e], k) for s, e, k in got - gold], [(line[s:e], k) for s, e, k in (gold - got) | out], "|", line[:150])
    print(len(w), "weights; held out:", right, "right", wrong, "wrong", lost, "lost")
    right = wrong = lost = 0
    for line, c, gold, out in lines(texts[rows : 3 * rows]):
        got = set(decode([(s, e, k, [x for x in f if not _WORDS.search(x)]) for s, e, k, f in c], w))
        right, wrong, lost = right + len(got & gold), wrong + len(got - gold), lost + len(gold - got) + len(out)
    print("without the words around:", right, "right", wrong, "wrong", lost, "lost")
