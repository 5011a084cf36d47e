import pytest

from tallyforge.operators import reports as P
from tallyforge.operators.relations import GateError


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame([(1, "x", ["a"]), (1, "y", ["a", "b"]), (1, "z", ["a", "b"]), (2, "x", ["c"]), (2, "y", ["c"])], "r int, c string, l array<string>")


def test_pairs_and_majority(ratings):
    got = {(r["a"], r["b"]): (r["records"], r["exact"], r["mean"]) for r in P.rater_pairs(ratings, "r", "c", "l").collect()}
    assert got == {("x", "y"): (2, 1, 0.75), ("x", "z"): (1, 0, 0.5), ("y", "z"): (1, 1, 1.0)}
    assert {r["c"]: (r["missing"], r["extra"]) for r in P.against_majority(ratings, "r", "c", "l").collect()} == {"x": (1, 0), "y": (0, 0), "z": (0, 0)}


def test_human_model(spark, ratings):
    model = spark.createDataFrame([(1, ["b", "a"])], "r int, l array<string>")
    got = {r["source"]: r["to_model"] for r in P.human_model_rows(ratings, model, "r", "c", "l").collect()}
    assert got == {"x": 0.5, "y": 1.0, "z": 1.0, "majority": 1.0}


def test_pilot(spark):
    a = spark.createDataFrame([(1, "x", "v1"), (1, "x", "v1"), (3, "y", "v0")], "r int, c string, v string")
    got = {(r["finding"], r["subject"]) for r in P.pilot_findings(a, "r", "c", spark.createDataFrame([(1,), (2,)], "r int"), "v", "v1", 2).collect()}
    assert got == {("instrument version", "3"), ("unknown record", "3"), ("missing record", "2"), ("too few raters", "1"), ("too few raters", "3"), ("repeated rating", "1")}


def test_links_members_states(spark, ratings):
    prod = spark.createDataFrame([(1, ["b", "a"]), (2, ["d"])], "r int, l array<string>")
    run = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["c"])], "r int, l array<string>")
    assert {tuple(r) for r in P.production_links(run, prod, "r", ["l"]).collect()} == {(2, "labels differ: l"), (3, "no production row")}
    P.equal_members({"a": prod, "b": prod}, "r")
    with pytest.raises(GateError):
        P.equal_members({"a": prod, "b": run}, "r")
    states, one = P.linked_state([], "s1", "h" * 64, 3)
    states, same = P.linked_state(states, "s2", "h" * 64, 3)
    assert len(states) == 1 and same["sources"] == ["s1", "s2"]
    with pytest.raises(GateError):
        P.linked_state(states, "s3", "h" * 64, 4)
    m = {"pointers": {"frozen": "s1"}, "content_snapshots": [{"snapshot_id": "s1", "csv_sha256": "c"}]}
    P.frozen_binding(m, "frozen", {"csv_sha256": "c"})
    with pytest.raises(GateError):
        P.frozen_binding(m, "frozen", {"csv_sha256": "d"})
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, sha256 string")
    tracked = spark.createDataFrame([("a", "1", False), ("b", "9", False), ("c", "3", None), ("e", "5", True)], "path string, sha256 string, restricted boolean")
    assert {tuple(r) for r in P.changed_files(files, tracked).collect()} == {("b", "changed"), ("c", "missing"), ("d", "new")}


def test_institutions(spark):
    names = spark.createDataFrame([("Univ X",), ("Univ X Ann Lee",), ("Other Institute",), ("Thing",)], "n string")
    aliases = spark.createDataFrame([("univ  x", "University of X")], "alias string, canonical string")
    got = {r["n"]: (r["canonical"], r["status"], r["needs_review"]) for r in P.institutions(names, "n", aliases, ["institute"]).collect()}
    assert got == {"Univ X": ("University of X", "alias", 0), "Univ X Ann Lee": ("University of X", "parser_cleanup", 0), "Other Institute": ("Other Institute", "identity", 0), "Thing": ("Thing", "identity", 1)}
