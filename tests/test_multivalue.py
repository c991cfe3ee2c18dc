from lodestone.functions.dialects import DELIMITERS, dialects, parse
from lodestone.operators.multivalue import split_values

ALL = "".join(DELIMITERS)


def test_parse_quotes_and_delimiters():
    assert parse('a|"b; c"|“d, e”', ALL, True)[0] == ["a", "b; c", "d, e"]
    assert parse('"say ""x"" now";y;;', ALL, True)[0] == ['say "x" now', "y", "", ""]
    assert parse("x-A/y / z 3'-end", ALL, True)[0] == ["x-A/y", "z 3'-end"]
    assert parse("a;b,c", "s", True)[0] == ["a", "b,c"]
    assert parse("a / / b", ALL, True)[0] == ["a", "", "b"]
    assert parse('"a" b;c', ALL, True)[0] == ['"a" b', "c"]


def test_dialects_are_those_present():
    assert dialects("plain") == [("", True)]
    assert set(dialects("a;b|c")) == {("", True), ("p", True), ("s", True), ("ps", True)}


def test_split_values(spark):
    many = ["Abc1;Def2", "Abc1|Def2|Ghi3", "Ghi3, Jkl4", "Jkl4；Abc1", "Def2 / Ghi3"] * 5
    rows = [(i, f, "x") for i, f in enumerate(many)] + [(100, '"Abc1, short form";Def2', ""), (101, None, ""), (102, "  ", ""), (103, ";Abc1;", ""), (103, ";Abc1;", ""), (None, "Abc1", ""), (104, ";".join(["Abc1"] * 5000), "")]
    df = spark.createDataFrame(rows, "rec_id long, field string, v string")
    got = {}
    for i, pos, v in split_values(df, "rec_id", "field", "name").collect():
        assert (i, pos) not in got
        got[i, pos] = v
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): "Abc1", (1, 2): "Def2", (1, 3): "Ghi3"}
    assert {k: v for k, v in got.items() if k[0] == 100} == {(100, 1): "Abc1, short form", (100, 2): "Def2"}
    assert {k: v for k, v in got.items() if k[0] == 103} == {(103, 2): "Abc1"}
    assert got[None, 1] == "Abc1" and sum(k[0] == 104 for k in got) == 5000 and not any(k[0] in (101, 102) for k in got)
    assert split_values(df.limit(0), "rec_id", "field").count() == 0


def test_every_subset_of_many_delimiters_is_scored():
    from itertools import combinations

    from lodestone.functions.dialects import dialects

    text = "a|b;c,d\te；f"
    found = {d for d, _ in dialects(text)}
    assert found == {"".join(c) for k in range(6) for c in combinations("psctw", k)}
    assert "sc" in found and "pt" in found
