"""Candidates of personal items that stand in long runs or in other letters."""

from lodestone.llm.pii import Grammar, decode, load_weights, proposals


def _spans(line, kind):
    return {line[s:e] for s, e, k, _ in proposals(Grammar(), line) if k == kind}


def test_each_number_of_a_run_is_a_candidate():
    assert {"01 23 45 67 89", "01 98 76 54 32"} <= _spans("01 23 45 67 89 / 01 98 76 54 32", "phone")
    assert {"030 23125 291", "030 23125 888"} <= _spans("030 23125 291 / 030 23125 888", "phone")


def test_candidates_of_a_long_run_grow_with_its_length():
    few, many = (len(proposals(Grammar(), " ".join(["12"] * n))) for n in (100, 200))
    assert many < 2.2 * few


def test_names_are_proposed_whole_and_in_any_cased_letters():
    assert "Ana Maria Lucia Lopez Garcia Vega" in _spans("by Ana Maria Lucia Lopez Garcia Vega today", "name")
    assert "Łukasz Šimůnek" in _spans("for Łukasz Šimůnek", "name") and "Иван Петров" in _spans("for Иван Петров", "name")
    line = "Regards, Łucja Nowak"
    assert [line[s:e] for s, e, _ in decode(proposals(Grammar(), line), load_weights())] == ["Łucja Nowak"]
