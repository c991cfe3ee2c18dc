import pytest

from lodestone.llm.pii import Grammar, decode, find_items, gradient, items, load_weights, proposals, redact
from lodestone.llm.pii_training import fit

TEXTS = {
    "Inventors: Zanlin Vostwell; HADLIN D. de la Farrovic": [("name", "Zanlin Vostwell"), ("name", "HADLIN D. de la Farrovic")],
    "Agent for the applicant: Quenström, Bexandra, phone +49 30 23125 888, vost-71 [at] calder [dot] example": [("name", "Quenström, Bexandra"), ("phone", "+49 30 23125 888"), ("email", "vost-71 [at] calder [dot] example")],
    "(72) Maelin Farrgren, Flat 24, 203 Copperbank Road, Vaumont": [("name", "Maelin Farrgren"), ("street_address", "Flat 24, 203 Copperbank Road, Vaumont")],
    "The declaration was signed by Ms Y. Kolvby (SSN: 968-73-1319).": [("name", "Y. Kolvby"), ("identity_number", "968-73-1319")],
    "Samples were sent to Harrowstraße 5b, D-98248 Puerto Calmo and stored there.": [("street_address", "Harrowstraße 5b, D-98248 Puerto Calmo")],
    "The Tarrowby equation holds up to 81 kPa. Serial no. 182-591824 of the pump was used at node@cell67.": [],
}


def test_items():
    g, w = Grammar(), load_weights()
    for text, want in TEXTS.items():
        assert [(k, text[s:e]) for s, e, k in items(g, text, w)] == want


def test_find_and_redact(spark):
    rows = [*enumerate(TEXTS), (100, None), (101, ""), (102, "x " * 200_000 + "\nInventor: Zanlin Vostwell"), (0, next(iter(TEXTS)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as t", "'x' as kind")
    got = {(r["doc_id"], r["kind"], r["found"]) for r in find_items(df, "doc_id", "text").collect()}
    assert {(i, k, f) for i, t in enumerate(TEXTS) for k, f in TEXTS[t]} | {(102, "name", "Zanlin Vostwell")} == got
    clean = {r["doc_id"]: r["text"] for r in redact(df, "text").collect()}
    assert clean[3] == "The declaration was signed by Ms [NAME] (SSN: [IDENTITY_NUMBER])." and clean[100] is None and clean[101] == "" and clean[5] == rows[5][1]
    assert find_items(df.limit(0), "doc_id", "text").count() == 0


def test_gradient_is_that_of_the_likelihood():
    from math import exp, log

    c = [(0, 3, "a", ["x"]), (2, 5, "b", ["y"]), (6, 8, "a", ["x", "z"])]
    gold = {(0, 3, "a"), (6, 8, "a")}

    def likelihood(w):
        def score(parts):
            kinds = ["^", *[p[2] for p in parts]]
            return sum(w.get(f, 0) for p in parts for f in p[3]) + sum(w.get(f"{a}>{b}", 0) for a, b in zip(kinds, kinds[1:]))

        sets = [[], [c[0]], [c[1]], [c[2]], [c[0], c[2]], [c[1], c[2]]]
        return score([c[0], c[2]]) - log(sum(exp(score(s)) for s in sets))

    w = {"x": 0.3, "y": -0.2, "a>a": 0.5, "^>b": 0.1, "z": 0.7}
    g = gradient(c, gold, w)
    for f in ("x", "y", "z", "a>a", "b>a", "^>a", "^>b"):
        up, down = dict(w), dict(w)
        up[f], down[f] = w.get(f, 0) + 1e-5, w.get(f, 0) - 1e-5
        assert g.get(f, 0) == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, abs=1e-6)
    assert decode(c, {"x": 2.0, "y": 3.0, "z": 1.0}) == [(2, 5, "b"), (6, 8, "a")]


def test_training_on_a_few_lines():
    w = fit([f"Inventor: {a} {b}\nA Device for {b} Handling was used" for a in ("Anna", "Boris", "Clara") for b in ("Mulden", "Norrby", "Ostrom")], epochs=8)
    g = Grammar()
    line = "Inventor: Dora Pellby"
    assert [line[s:e] for s, e, _ in decode(proposals(g, line), w)] == ["Dora Pellby"]
    assert decode(proposals(g, "A Device for Pellby Handling was used"), w) == []
