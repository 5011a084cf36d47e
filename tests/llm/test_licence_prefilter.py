"""The licence prefilter passes every text that has a trigger word."""

from tallyforge.llm import licences


def test_prefilter_passes_all_triggers(spark):
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Permission is\nhereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        *(f"x {w.upper()} y" for w in sorted(licences._TRIGGER)),
    ]
    files = spark.createDataFrame([(i, f"d{i}/a.txt", t) for i, t in enumerate(texts)], "id int, path string, text string")
    assert files.filter(files.text.rlike(licences.PREFILTER)).count() == len(texts)
    got = {r["id"]: r["licence"] for r in licences.headers(files).collect()}
    assert got[0] == "BSD-3-Clause" and got[1] == "MIT"
