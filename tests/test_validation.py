import pytest
from pyspark.sql import functions as F

from tallyforge.operators import register as Reg
from tallyforge.operators import validation as V
from tallyforge.operators.relations import GateError


def test_decode(spark):
    rows = spark.createDataFrame([("1", "1", "0", "5"), ("2", "", "", "x"), ("3", "0", "1", " ")], "id string, d___1 string, d___2 string, n string")
    got = {r["id"]: r["s"] for r in V.checkbox_set(rows, "d", {"1": "a", "2": "b"}, "s", required=True).collect()}
    assert got == {"1": ["a"], "2": None, "3": ["b"]}
    with pytest.raises(GateError):
        V.checkbox_set(rows, "d", {"1": "a"}, "s")
    good, bad = V.typed(rows, {"n": "int"})
    assert [r["n"] for r in good.orderBy("id").collect()] == [5, None, None] and [(r["id"], r["column"]) for r in bad.collect()] == [("2", "n")]
    hidden = V.masked(spark.createDataFrame([(0, "x"), (1, "y")], "p int, q string"), {"q": ("p", F.col("p") == 1)}).orderBy("p").collect()
    assert [(r["q"], r["ignored"]) for r in hidden] == [(None, ["q"]), ("y", [])]


def test_cells_and_ids(spark):
    a = spark.createDataFrame([(1, "x", "1"), (2, "y", "2")], "r int, c string, d string")
    b = spark.createDataFrame([(1, "X", "1"), (2, "y", "3")], "r int, c string, d string")
    got = {(r["r"], r["column"], r["verdict"]) for r in V.cell_differences(a, b, "r", {"case": F.lower("a") == F.lower("b")}).collect()}
    assert got == {(1, "c", "case"), (2, "d", "unaccepted")}
    m = spark.createDataFrame([("a", "A1")], "old string, new string")
    ids = V.renamed_ids(spark.createDataFrame([("a; b;a",), (None,)], "l string"), "l", m)
    assert {r["l"] for r in ids.collect()} == {"A1; b;A1", None}


def test_gates(spark):
    rows = spark.createDataFrame([("1", "2020-01-01"), ("2", "bad")], "k string, d string")
    V.table_gate(rows, ["k"], "d", 2, 0.5)
    for args in ((["z"], "d", 1, 1.0), (["k"], "d", 3, 1.0), (["k"], "d", 1, 0.1)):
        with pytest.raises(GateError):
            V.table_gate(rows, *args)
    V.batch_gate(rows, rows, "k")
    with pytest.raises(GateError):
        V.batch_gate(rows, rows.union(rows), "k")
    with pytest.raises(GateError):
        V.metric_targets(spark.createDataFrame([(0.5,)], "m double"), {"m": 0.51})


def test_panels(spark):
    r = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("q", 1), ("q", 1), ("q", 2), ("r", 1)], "p string, c int")
    bad = V.issues(r, "p", {"late": ("fatal", F.col("c") > 5)})
    assert [x["p"] for x in V.complete_panels(r, "p", "c", bad).collect()] == ["p"]
    cases = spark.createDataFrame([("x", 1, "a"), ("x", 2, "a"), ("y", 1, "a")], "c string, r int, s string")
    assert {x["c"]: x["supported"] for x in V.adjudication(cases, "c", "r", "s", {"many": F.col("r") > 1}).collect()} == {"x": True, "y": False}
    reviews = spark.createDataFrame([(["a"], ["a"]), (["a"], ["a", "b"]), (["a"], None)], "m array<string>, h array<string>")
    assert tuple(V.review_agreement(reviews, "m", "h").first()) == (2, 1, 2)


def test_cover_with_dispositions(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3)], "o string, i int")
    away = spark.createDataFrame([("a",)], "o string")
    got = V.reachable_cover(e, "o", "i", away, 2, 3)
    assert got == [("a", 0, False), ("b", 2, True)] or got[0] == ("a", 0, False)
    log = spark.createDataFrame([(1, "a"), (2, "b")], "s int, o string")
    V.replay(log, [("a",), ("b",)], "s", "o")
    with pytest.raises(GateError):
        V.replay(log, [("b",), ("a",)], "s", "o")


def test_people(spark):
    p = spark.createDataFrame([(1, "Ann Lee"), (2, "A Lee"), (3, "Bo Lee")], "k int, n string")
    assert {tuple(r) for r in V.variant_pairs(p, "k", "n").collect()} == {(1, 2), (2, 1)}
    f = spark.createDataFrame([("a", 1, "p", 2020), ("b", 1, "p", 2020), ("a", 2, "q", 2021)], "o string, r int, p string, y int")
    assert {tuple(r) for r in V.owner_summary(f, "o", "r", "p", "y").collect()} == {("a", 2, 2, 2020, 2021, 1), ("b", 1, 1, 2020, 2020, 1)}


def raw(spark, rows):
    return spark.createDataFrame(rows, "`Project Number` string, `Project Name` string, `Accredited Researchers` string, `Legal Gateway` string, `Protected Data Accessed` string, `Processing Environment` string, `Accreditation Date` string, row_ix int")


ROWS = [
    ("1", "T", "Ann Lee, X", "Digital Economy Act", "P: a", "E", "2020-02-03", 0),
    ("1", "T", "Ann Lee, X", "Digital Economy Act", "P: b", "E", "2020-02-03", 1),
    ("2", "U", "r", "digital economy act 2017", "P: a", "E", "2021-05-01", 2),
    ("2", "V", "r", "Digital Economy Act", "P: c", "E", "2021-05-01", 3),
    ("3", "W", "r", "Other Act", "P: a", "E", "2021-05-01", 4),
    ("4", "X", "r", "Digital Economy Act", "P: a", "E", "soon", 5),
]


def test_register(spark):
    got = {r["record_id"]: (r["datasets"], r["quarter_label"]) for r in Reg.cleaned(raw(spark, ROWS)).collect()}
    assert got == {"1": ("P: a\nP: b", "Q1 2020"), "2/a": ("P: a", "Q2 2021"), "2/b": ("P: c", "Q2 2021")}
    shuffled = {r["record_id"]: r["title"] for r in Reg.cleaned(raw(spark, ROWS[::-1])).collect()}
    assert shuffled == {"1": "T", "2/a": "U", "2/b": "V"}
    clean = Reg.cleaned(raw(spark, ROWS))
    m = spark.createDataFrame([("1", "a", "P"), ("2/b", "c", "Q")], "record_id string, dataset string, provider string")
    c = spark.createDataFrame([("c", "K")], "dataset string, collection string")
    ids = lambda **k: {r["record_id"] for r in Reg.filtered(clean, m, c, **k).collect()}
    assert ids() == {"1", "2/a", "2/b"} and ids(dataset="collection::K") == {"2/b"} and ids(provider="P") == {"1"} and ids(text="ann") == {"1"}
