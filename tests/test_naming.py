"""Similar names against all pairs compared one by one."""

import os
import random
import re
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from tallyforge import plans
from tallyforge.operators import naming as N

DIR = os.environ.get("TALLYFORGE_DATA", "/root/testdata/sf0.001")

NAMES = ["The Labour Force Survey", "Labour Force Survey", "Labour Force", "labour force survey", "Office for National Statistics", "National Statistics", "Haelth Records", "Health Records", "Health", "Crime Survey Data", "Crime  survey", "Ab", "ab", "A", "Births Register", "Birth Register System", "zz", "", "  ", "Widgets \u00e9t\u00e9", "Widgets et\u00e9"]


def plain(name):
    tail = re.compile(r"\s+(?:" + "|".join(w.lower() for w in N.TRAILING_WORDS) + r")$")
    s = " ".join(name.lower().split())
    while tail.search(s):
        s = tail.sub("", s)
    return s


def alike(x, y):
    a, b, p, q = x.lower(), y.lower(), plain(x), plain(y)
    return a in b or b in a or p == q or any(SequenceMatcher(None, *f).ratio() > 0.85 for f in ((a, b), (p, q)))


def components(names):
    home = {n: n for n in names}
    for x, y in combinations(sorted(names), 2):
        if alike(x, y):
            old, new = sorted((home[x], home[y]), reverse=True)
            home = {n: new if h == old else h for n, h in home.items()}
    return {n: h for n, h in home.items() if sum(v == h for v in home.values()) > 1}


def made(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 30))) for _ in range(40)]
    changed = [s[: (i := r.randrange(len(s) + 1))] + r.choice(["x", "", "ab"]) + s[i + r.randint(0, 2) :] for s in stems for _ in range(2)]
    return stems + changed


@pytest.mark.parametrize("names", [NAMES, made(1), made(2)])
def test_clusters_equal_all_pairs(spark, names):
    rows = spark.createDataFrame([(n, 1) for n in [*names, *names[:3], None]], "n string, name int")
    got = {r["name"]: r["cluster"] for r in N.name_clusters(rows, "n").collect()}
    assert got == components({n for n in names if n.strip()})


def test_links_are_alike(spark):
    got = N.similar_names(spark.createDataFrame([(n,) for n in made(3)], "n string"), "n").collect()
    assert got and all(r["a"] < r["b"] and alike(r["a"], r["b"]) for r in got)


def test_no_names_and_low_ratio(spark):
    none = spark.createDataFrame([], "n string")
    assert N.similar_names(none, "n").isEmpty()
    with pytest.raises(ValueError):
        N.similar_names(none, "n", 0.5)


def test_renamed_and_order(spark):
    approved = spark.createDataFrame([("Office", "Office (O)")], "name string, shown string")
    rows = spark.createDataFrame([("Office", "b", 1), ("Other", "a", 2), (None, "c", 3)], "n string, kind string, c int")
    assert [r["n"] for r in N.renamed(rows, "n", approved).orderBy("c").collect()] == ["Office (O)", "Other", None]
    assert [r["kind"] for r in N.review_order(rows, "kind", ["c", "b"], "c", "n").collect()] == ["c", "b", "a"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_clusters_of_the_query(spark):
    t = plans.Tables(spark, DIR)
    names = {r[0] for r in plans.naming.names(t).collect()}
    got = {r["name"]: r["cluster"] for r in plans.QUERIES["j15_name_clusters"](spark, DIR).collect()}
    assert got and got == components(names)
