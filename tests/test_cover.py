"""Covers with more unreachable owners than steps."""

from tallyforge.operators import validation


def test_no_unreachable_owner_is_admitted(spark):
    edges = [(f"o{i:02}", 100 * i + k) for i in range(20) for k in range(40 - i)]
    incidence = spark.createDataFrame(edges, "owner string, item int")
    for gone in (range(4), range(19, -1, -1)):
        unreachable = spark.createDataFrame([(f"o{i:02}",) for i in gone for _ in range(2)], "owner string").repartition(3)
        got = validation.reachable_cover(incidence, "owner", "item", unreachable, 2, 6)
        away = {f"o{i:02}" for i in gone}
        want, good = [], 0
        for i in range(20):
            if len(want) == 6 or good == 2:
                break
            ok = f"o{i:02}" not in away
            good += ok
            want.append((f"o{i:02}", 40 - i if ok else 0, ok))
        assert got == want
