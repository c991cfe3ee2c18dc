import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.clusters import plain
from lodestone.llm.mixing import mix
from lodestone.llm.names import deletions, edit_distance, edits_for, map_records, match, tokenise
from lodestone.llm.packing import batch_plan, bucket_bounds, pack, packing_report
from lodestone.llm.sampling import canonical, draw, repair, take_first
from lodestone.llm.tokens import with_tokens


def test_tokens_are_words_or_symbols(spark):
    import re

    texts = ["", None, "a-b c_d", "über 3.5 µm…", "x y z", "😀😀 a", "12" * 4000 + "!", " ", "naïve₂ Ⅷ 四", "\x1c\x85.."]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in with_tokens(spark.createDataFrame(rows, "doc_id long, text string"), "text", ["doc_id"], 2).collect()}
    for i, t in rows:
        spans = [m.start() for m in re.finditer(r"\w+|[^\w\s]+", t or "")]
        assert got[i]["n_tokens"] == len(spans), t
        assert got[i]["cuts"] == (spans[2::2] if len(spans) > 2 else [])


def test_bounds_minimise_padding():
    h = np.zeros(20, np.int64)
    h[[2, 3, 7, 8, 15]] = [5, 1, 2, 4, 3]
    sizes = np.flatnonzero(h)
    b = bucket_bounds(h, 3)

    def padding(bounds):
        return sum(h[s] * (min(x for x in bounds if x >= s) - s) for s in sizes)

    assert padding(b) == min(padding((*c, 15)) for c in itertools.combinations(sizes[:-1], 2))
    plan = batch_plan(np.array([3, 5]), np.array([7, 4]), 11)
    assert sum(t * p.get(0, 0) for t, p in plan) == 7 and sum(t * p.get(1, 0) for t, p in plan) == 4
    assert all(p.get(0, 0) * 3 + p.get(1, 0) * 5 <= 11 for _, p in plan)


def test_pack(spark):
    rng = np.random.default_rng(0)
    n = [*rng.integers(1, 100, 300).tolist(), *[60] * 200, 100, 250, 200, 0, None]
    rows = [(i, k, "x") for i, k in enumerate(n)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, part string")
    out = pack(df, "doc_id", "n_tokens", 100, 16).toPandas()
    for i, k in enumerate(n):
        mine = out[out.doc_id == i].sort_values("part")
        assert mine.n_tokens.sum() == (k or 0) and len(mine) == -(-(k or 0) // 100)
        assert mine.first_token.tolist() == list(range(0, k or 0, 100))
    assert out.groupby("container").n_tokens.sum().max() <= 100
    assert out.container.nunique() == out.container.max() + 1
    r = packing_report(pack(df, "doc_id", "n_tokens", 100), 100).first()
    assert r["overfull"] == 0 and r["tokens"] == sum(k or 0 for k in n)
    assert pack(df.limit(0), "doc_id", "n_tokens", 100).count() == 0


def test_mix(spark):
    rows = [(i, "big", 10, 1.0) for i in range(300)] + [(1000 + i, "small", 10, 1.0) for i in range(5)] + [(2000 + i, "unlisted", 10, 1.0) for i in range(95)] + [(3000, None, 10, 1.0), (None, "big", 10, 1.0), (3001, "big", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long, w double")
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.03, 3), ("absent", 0.47, 2), ("big", 0.5, 1)], "source string, target_weight double, max_repeats int")
    sel, report = mix(docs, weights, "doc_id", "source", "n", "w")
    r = {x["source"]: x for x in report.collect()}
    assert r["big"]["used"] == 2000 and not r["big"]["short"]
    assert r["small"]["used"] == 120 and not r["small"]["short"]  # two epochs and two documents
    assert r["absent"]["short"] and r["absent"]["used"] == 0
    uses = {x["doc_id"]: x["uses"] for x in sel.collect()}
    assert sum(v for k, v in uses.items() if k < 1000) == 200 and sorted(v for k, v in uses.items() if 1000 <= k < 2000) == [2, 2, 2, 3, 3]
    assert mix(docs.limit(0), weights, "doc_id", "source", "n")[0].count() == 0
    heavy = spark.createDataFrame([(i, "a", 1, 5.0 if i < 500 else 1.0) for i in range(1000)], "doc_id long, source string, n long, w double")
    s, _ = mix(heavy, spark.createDataFrame([("a", 0.5, 1)], "source string, target_weight double, max_repeats int"), "doc_id", "source", "n", "w")
    ids = [x["doc_id"] for x in s.collect()]
    assert len(ids) == 500 and 330 < sum(i < 500 for i in ids) < 450  # the better half is taken more often, not always


def test_repair_reaches_targets():
    member = np.eye(3, dtype=bool)
    assert repair(member, np.array([100, 100, 5]), np.array([20.0, 10, 20]), np.array([0, 0, 3]), 50, 1).tolist()[2] == 5
    assert repair(member, np.array([100, 100, 50]), np.array([20.0, 10, 20]), np.array([0, 0, 3]), 50, 1).tolist() == [20, 10, 20]
    two = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]], bool)
    c = repair(two, np.array([50, 50, 50, 50]), np.array([30.0, 10, 20, 20]), np.zeros(4, int), 40, 2)
    assert (c @ two).tolist() == [30, 10, 20, 20]
    assert repair(np.zeros((0, 2), bool), np.zeros(0, int), np.ones(2), np.zeros(2, int), 5, 0).tolist() == []


def test_take_first(spark):
    df = spark.createDataFrame([(g, i, (i * 7919 % 1000) / 1000, 37) for g in "ab" for i in range(1000)], "g string, i int, u double, n int")
    got = [(r["g"], r["u"]) for r in take_first(df, ["g"], "u", "i", "n").collect()]
    assert len(got) == 74 and max(u for _, u in got) == 0.036


def test_draw(spark):
    rec = [(f"o{i}", "s" if i < 200 else "t", ["A", "B", "C"][i % 3] if i % 10 else None) for i in range(260)] + [(None, "s", "A"), ("z", None, "A"), ("o1", "s", "B")]
    records = spark.createDataFrame(rec, "i string, sample string, kind string")
    plan = [(1, "s", "kind", "A", 0.5, 40, 0), (1, "s", "kind", "B", 0.5, 40, 0), (1, "s", "kind", "B", 0.5, 40, 0), (2, "t", "kind", "C", 1.0, 60, 5), (3, "none", "kind", "A", 1.0, 5, 2), (4, "t", "kind", "A", None, None, None)]
    targets = spark.createDataFrame(plan, "draw long, sample string, attribute string, category string, share double, size long, minimum long")
    sample, report = draw(records, targets, ["kind"])
    r = {(x["draw"], x["category"]): x for x in report.collect()}
    assert r[1, "A"]["drawn"] == 20 and r[1, "B"]["drawn"] == 20 and not r[1, "A"]["short"]
    assert r[2, "C"]["short"] and r[2, "C"]["drawn"] == r[2, "C"]["available"]
    assert r[3, "A"]["short"] and r[3, "A"]["drawn"] == 0
    assert r[2, "C"]["missed"] and not r[1, "B"]["missed"]
    got = [(x["draw"], x["i"]) for x in sample.collect()]
    named = targets.withColumn("draw", F.concat(F.lit("d"), "draw"))
    assert draw(records, named, ["kind"])[0].filter("draw = 'd1'").count() == 40
    assert len(got) == len(set(got)) and sum(d == 1 for d, _ in got) == 40
    assert draw(records.limit(0), targets, ["kind"])[0].count() == 0 and draw(records, targets.limit(0), ["kind"])[1].count() == 0


def test_swaps_repair_two_attributes_at_once(spark):
    rows = [(f"i{k}", "s", "A" if k % 5 else "B", "x" if k % 3 else "y") for k in range(300)]
    records = spark.createDataFrame(rows, "i string, sample string, kind string, side string")
    plan = [(1, "s", "kind", c, 0.5, 60, 0) for c in "AB"] + [(1, "s", "side", c, 0.5, 60, 0) for c in "xy"]
    sample, report = draw(records, spark.createDataFrame(plan, "draw long, sample string, attribute string, category string, share double, size long, minimum long"), ["kind", "side"])
    assert {r["drawn"] for r in report.collect()} == {30} and sample.count() == 60


def test_canonical(spark):
    names = spark.createDataFrame([("Dorsal mural",), ("Dorsal tufted",), ("Rim",)], "name string")
    df = spark.createDataFrame([("dorsal_MURAL",), ("Dorsal m",), ("Dorsal",), ("R",), (None,), ("x",)], "c string")
    got = [r["c"] for r in canonical(df.withColumn("n", F.monotonically_increasing_id()), "c", names, "name", plain).orderBy("n").collect()]
    assert got == ["Dorsal mural", "Dorsal mural", None, "Rim", None, None]


def test_names():
    assert tokenise("ＨＩＰ-０9") == (["hip"], "9") and tokenise("2. Sep") == (["sep"], "2") and tokenise("nestral factor 9") == (["nestral", "factor"], "9")
    assert tokenise("Sü​k_7*") == (["suk"], "7") and tokenise("--") == ([], "")
    words = ["abcd", "abdc", "abc", "abcde", "abxd", "abcd", "bacd", "dabc", "ab"]
    for a in words:
        for b in words:
            near = a == b or any(b in s for s in ({a[:i] + a[i + 1 :] for i in range(len(a))}, {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abcdex"}, {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abcdex"}, {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}))
            assert (edit_distance(a, b, 1) <= 1) == near, (a, b)
            assert not near or set(deletions(a, 1)) & set(deletions(b, 1))
    assert [edits_for(n) for n in (3, 4, 8, 9, 14)] == [0, 1, 1, 2, 3]
    assert edit_distance("glutamate", "glutmaet", 2) == 2 and edit_distance("abcdefghi", "ihgfedcba", 2) == 3


def test_two_edits_and_part_of_an_entry(spark):
    ref = spark.createDataFrame([(1, "Harmonisation factor 3", True), (2, "quellin", True), (3, "quellin receptor beta 4", True)], "key long, name string, symbol boolean")
    names = spark.createDataFrame([("Harmonsiatoin facter 3",), ("receptor beta 4",), ("qellin",), ("beta 4",)], "name string")
    full = {r["name"]: r["key"] for r in match(names, ref).collect()}
    assert full == {"Harmonsiatoin facter 3": 1, "qellin": 2}
    part = {r["name"]: r["key"] for r in match(names, ref, least=0.3, cover=0.6).collect()}
    assert part["receptor beta 4"] == 3 and "beta 4" not in part


def test_map_records(spark):
    ref = spark.createDataFrame([(1, "Hizkoh10", True), (1, "nestral binding protein 9", False), (2, "Kuchoc7", True), (3, "Imbra4", True), (3, None, False), (4, "Umbra4", True)], "key long, name string, symbol boolean")
    rec = [(1, "HIZKOH-10", None), (2, "hizkho10", 99), (3, "Hizkoh11", None), (4, "nestral binding prot. 9", None), (5, "K0choc7 [rat]", None), (6, "unknown", None), (7, None, None), (8, "Imbra4", None), (9, "Kuchoc7", 2), (1, "HIZKOH-10", None), (10, "x" * 5000, None)]
    records = spark.createDataFrame(rec, "id long, name string, key long")
    syn = spark.createDataFrame([(6, 1, "clone 5"), (6, 2, "Kuchoc7"), (7, 1, "none"), (1, 1, "Kuchoc7")], "id long, pos int, name string")
    got = {r["id"]: r["key"] for r in map_records(records, ref, syn).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 2, 6: 2, 7: 0, 8: 3, 10: 0}
    assert map_records(records.limit(0), ref, syn).count() == 0
    assert {r["key"] for r in map_records(records, ref.limit(0), syn).collect()} == {0}
    assert match(records.select("name"), ref).filter("score > 1.000001").count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found", "p6_found", "p7_found", "p8_found", "p9_found"])
def test_queries_are_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
