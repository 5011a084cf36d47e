import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import agreement as A
from tallyforge.operators import counts as C
from tallyforge.operators import crosstabs as X
from tallyforge.operators import identity as I
from tallyforge.operators import mentions as M
from tallyforge.operators import relations as R
from tallyforge.operators import sampling as G
from tallyforge.operators import uptake as U


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (lambda: T.duplicate_key("x"), " Straße <b>A</b>_x000D_  b\n", "strasse a b"),
        (lambda: T.duplicate_key("x"), None, ""),
        (lambda: T.single_line("x"), None, None),
        (lambda: T.without_tail("x", ["data", "survey"]), "Labour Force survey data ", "Labour Force"),
        (lambda: T.without_acronym("x"), "Office for Things (OFT)", "Office for Things"),
        (lambda: T.without_acronym("x"), "Office (north)", "Office (north)"),
        (lambda: T.project_key("x"), "2020/001 CLOSED", "2020/001"),
        (lambda: T.prompt_safe("x", 5), "a {b}  cdef", "a (b)..."),
        (lambda: T.json_body("x"), 'x ```json\n{"a":1}\n``` y', '{"a":1}'),
        (lambda: T.json_body("x"), 'well {"a":1} end', '{"a":1}'),
        (lambda: T.broken_before("x", ["Office", "Home Office"]), "Home Office: a, b Office: c", "Home Office: a, b\nOffice: c"),
        (lambda: T.display_list("x"), None, "—"),
    ],
)
def test_text(spark, column, value, expected):
    assert one(spark, column(), value) == expected


def test_lists_and_suffixes(spark):
    assert one(spark, T.members("x"), " a ; ;b") == ["a", "b"]
    assert one(spark, T.list_literal("x"), "['a', 'b']") == ["a", "b"]
    assert one(spark, T.lines("x"), "a<br>b _x000D_, c") == ["a", "b , c"]
    assert [r[0] for r in spark.range(1, 29).select(T.row_suffix(F.col("id"))).collect()][-3:] == ["z", "aa", "ab"]
    token = one(spark, T.token("x", length=12), "a")
    assert len(token) == 12 and token == one(spark, T.token("x", length=12), "a") != one(spark, T.token("x", length=12), "b")


def test_python_functions(spark):
    assert one(spark, T.unicode_key()("x"), "ﬁ​–①") == "fi-1"
    assert one(spark, T.html_text()("x"), "a &amp; b &#233;") == "a & b é"
    assert one(spark, T.title_case()("x"), "system's end") == "System'S End"


@pytest.mark.parametrize(
    ("panel", "alpha"),
    [([(0, 0, 0), (0, 1, 1)], 3 / 8), ([(0, 0, 1), (1, 1, 0)], -1 / 9), ([(1, 1, 1), (1, 1, 1)], None)],
)
def test_alpha(spark, panel, alpha):
    rows = [(u, str(v)) for u, values in enumerate(panel) for v in values]
    got = A.krippendorff(spark.createDataFrame(rows, "u int, v string"), "u", "v", A.nominal_distance).first()
    if alpha is None:
        assert got["alpha"] is None and got["reason"] == "no expected disagreement"
    else:
        assert got["alpha"] == pytest.approx(alpha)


def test_alpha_without_pairs(spark):
    got = A.krippendorff(spark.createDataFrame([(1, "a"), (2, "b")], "u int, v string"), "u", "v", A.nominal_distance).first()
    assert got["alpha"] is None and got["reason"] == "no pairable units"


def test_sets_and_intervals(spark):
    rows = spark.createDataFrame([(["a"], ["a"]), (["a"], ["a", "b"]), (["a", "b"], ["b", "c"]), (["a"], ["b"]), ([], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in rows.select(A.jaccard(F.col("a"), F.col("b")), A.masi_weight(F.col("a"), F.col("b"))).collect()]
    assert got == [(1.0, 1.0), (0.5, pytest.approx(2 / 3)), (pytest.approx(1 / 3), pytest.approx(1 / 3)), (0.0, 0.0), (1.0, 1.0)]
    lo, hi = A.wilson(F.lit(0), F.lit(10))
    ends = spark.range(1).select(lo, hi).first()
    assert ends[0] == 0.0 and ends[1] == pytest.approx(0.2775, abs=1e-3)


def test_metrics_are_null_without_denominator(spark):
    r = A.binary_metrics(spark.createDataFrame([(False, False)], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert r["precision"] is None and r["recall"] is None and r["kappa"] is None


def test_bootstrap_draws_whole_sample(spark):
    d = A.joint_bootstrap(spark.range(7).withColumnRenamed("id", "r"), "r", 5, 1)
    assert {r["s"] for r in d.groupBy("replicate").agg(F.sum("times").alias("s")).collect()} == {7}
    short = A.bootstrap_interval(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x", 10).first()
    assert short["valid"] == 2 and short["lo"] is None


def test_header_mentions(spark):
    rows = spark.createDataFrame([(1, "Alpha: a, b and c; d\nmore\nBeta: x & y"), (2, None)], "k int, t string")
    got = M.header_mentions(rows, "k", "t", protected=["b and c"]).select("line", "header", "part").collect()
    assert sorted(map(tuple, got)) == [(0, "Alpha", "a"), (0, "Alpha", "b and c"), (0, "Alpha", "d"), (1, "Alpha", "more"), (2, "Beta", "x"), (2, "Beta", "y")]


def test_canonical_first_match_wins(spark):
    names = spark.createDataFrame([("abc one",), ("abd",), ("x;y",), ("z",)], "n string")
    rules = spark.createDataFrame([(2, "ab", "second"), (1, "abc ", None)], "priority int, pattern string, value string")
    got = {r["n"]: (r["canonical"], r["match_type"], r["needs_review"]) for r in M.canonical(names, "n", rules).collect()}
    assert got == {"abc one": ("one", "alias", 0), "abd": ("second", "alias", 0), "x;y": ("x;y", "unresolved", 1), "z": ("z", "identity", 0)}


def test_institutions_and_people(spark):
    rows = spark.createDataFrame([(1, "Ann Lee, University of X\nBo Ek, Y Institute, University of X")], "k int, t string")
    org = ["university", "institute"]
    assert {r["institution"] for r in M.institution_mentions(rows, "k", "t", org).collect()} == {"University of X", "Y Institute"}
    assert {(r["name"], r["kind"]) for r in M.people(rows, "k", "t", org).collect()} == {("Ann Lee", "person"), ("Bo Ek", "person"), ("University of X", "organisation"), ("Y Institute", "organisation")}


def test_duplicate_tiers(spark):
    rows = spark.createDataFrame(
        [(1, "p", "t", "d1", "a"), (2, "p", "t", "d1", "A "), (3, "q", "t", "d1", "a"), (4, "q", "t", "d1", "b"), (5, "r", "t", "d1", "a"), (6, "r", "t", "d2", "a"), (7, "s", "t", None, None), (8, "s", "t", "", "")],
        "i int, p string, t string, d string, v string",
    )
    tiered = I.duplicate_tiers(rows, ["p", "t"], "d", ["v"], [], "i")
    assert {r["i"]: (r["tier"], r["keep"]) for r in tiered.collect()} == {1: (1, True), 2: (1, False), 3: (2, True), 4: (2, False), 5: (3, True), 6: (3, True), 7: (1, True), 8: (1, False)}
    assert I.merge_group(tiered, ["p", "t"], "v", "i").first()["v"] == "a\nb"


def test_rulings_must_cover(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, k string")
    good = spark.createDataFrame([("a", "duplicate")], "k string, ruling string")
    assert {r["i"] for r in I.apply_rulings(rows, good, "k", "i").collect()} == {1, 3}
    with pytest.raises(R.GateError):
        I.apply_rulings(rows, good.filter("false"), "k", "i")
    with pytest.raises(R.GateError):
        I.apply_rulings(rows, good.union(spark.createDataFrame([("b", "collision")])), "k", "i")


def test_components_and_cliques(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (7, 8), (8, 9), (7, 9)], "a int, b int")
    assert {r["node"]: r["component"] for r in I.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7}
    assert {r["node"]: r["component"] for r in I.clique_groups(e).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7}


def test_greedy_cover_breaks_ties(spark):
    e = spark.createDataFrame([("b", 1), ("b", 2), ("a", 1), ("a", 2), ("c", 3)], "o string, i int")
    assert I.greedy_cover(e, "o", "i", 5) == [("a", 2, 2), ("c", 1, 3)]


def test_diffs(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, " a"), (2, "c"), (3, ""), (4, "d")], "k int, v string")
    assert {tuple(r) for r in R.snapshot_diff(old, new, "k", ["v"]).collect()} == {(2, "changed", "v"), (4, "added", "")}
    assert R.impact(R.snapshot_diff(old, old, "k", ["v"])).first()["impact"] == "none"


def test_gates(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(R.GateError):
        R.subset(rows, spark.createDataFrame([(3,)], "k int"), "k")
    with pytest.raises(R.GateError):
        R.marked(rows, spark.createDataFrame([(1,), (1,)], "k int"), "k", "m")


def test_append_only(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "s int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "c")], "s int, v string")
    assert {tuple(r) for r in I.append_only(old, new, "s").collect()} == {(2, "changed"), (4, "gap")}


def test_mixed_dates(spark):
    rows = spark.createDataFrame([("2020",), ("2020-Q3",), ("2020-05",), ("2020-05-06",), ("soon",), (None,)], "x string")
    assert [r[0] for r in rows.select(U.mixed_date(F.col("x"))).collect()] == [dt.date(2020, 1, 1), dt.date(2020, 7, 1), dt.date(2020, 5, 1), dt.date(2020, 5, 6), None, None]


def test_adoption_starts_at_first_use(spark):
    records = spark.createDataFrame([(1, dt.date(2020, 1, 5)), (2, dt.date(2020, 8, 1)), (3, dt.date(2020, 12, 1))], "record_id int, d date")
    m = spark.createDataFrame([(2, "L", "p"), (2, "L", "q"), (2, "L", "q")], "record_id int, line string, product string")
    got = [(r["period"].month, r["projects"], r["requests"], r["total"]) for r in U.adoption(m, records, "line", "product", "d").orderBy("period").collect()]
    assert got == [(7, 1, 2, 1), (10, 0, 0, 1)]


def test_counts_do_not_depend_on_order(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(30)]
    a = spark.createDataFrame(rows, "record_id int, l string, m string")
    b = spark.createDataFrame(rows[::-1], "record_id int, l string, m string").repartition(7)
    for f in (lambda d: X.cooccurrence(d.select("record_id", "l").union(d.select("record_id", "m")), "l"), lambda d: C.top_n_and_other(C.label_totals(d, "m"), "m", "n", 2), lambda d: G.stratified(d, "l", "record_id", 3, 5), lambda d: M.ranked_suffix(d, "m", ["record_id"])):
        assert sorted(map(str, f(a).collect())) == sorted(map(str, f(b).collect()))


def test_sampling(spark):
    ids = spark.range(100).withColumnRenamed("id", "k")
    assert G.registered_draw(ids, "k", 5, 3) == G.registered_draw(ids.repartition(5), "k", 5, 3)
    assert sum(G.quota_split({"a": 1, "b": 50, "c": 50}, 50, 1).values()) == 50 and G.quota_split({"a": 1, "b": 50, "c": 50}, 50, 1)["a"] == 1
    got = G.audit(ids, spark.createDataFrame([(99,)], "k long"), "k", 0.1, 4)
    assert got.filter("random").count() == 10 and got.filter("mandatory").count() == 1
    a = G.assignments(ids, spark.createDataFrame([("x",), ("y",)], "r string"), "k", "r", 2)
    assert a.groupBy("r").agg(F.countDistinct("display_order").alias("n")).filter("n = 100").count() == 2
    with pytest.raises(R.GateError):
        G.assert_disjoint(spark.createDataFrame([(1, "a"), (1, "b")], "k int, s string"), "k", "s")
