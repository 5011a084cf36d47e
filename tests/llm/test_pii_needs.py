"""Cheap conditions of the personal-data patterns skip no match."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import pii

LETTERS = "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ0123456789"


@pytest.mark.parametrize("kind", pii.BASE | pii.GENERATORS)
def test_needs_skip_no_match(spark, kind):
    r = random.Random(6)
    token = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    made = {
        "email": lambda: f"{token(5)}@{token(4)}.org",
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "card": lambda: " ".join(f"{r.randrange(10000):04}" for _ in range(4)),
        "phone": lambda: f"+{r.randrange(1, 99)} {r.randrange(10**8, 10**9)}",
        "secret": lambda: f"{r.choice(['token', 'API-key', 'Pwd'])}{r.choice(':=')}{token(9)}",
        "mail": lambda: f"ann {r.choice(['[at]', '(AT)'])} host {r.choice(['[dot]', '(DOT)'])} org",
        "number": lambda: f"({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}",
        "account": lambda: r.choice([f"DE{r.randrange(10, 99)} ABCD 1234 EFGH", f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"]),
        "key": lambda: r.choice(["ghp_" + token(36), "sk-" + token(16), "AKIA" + token(16), "%032x" % r.getrandbits(128)]),
    }[kind]
    texts = spark.createDataFrame([(f"see {made()} here",) for _ in range(200)], "t string")
    got = texts.select(pii.NEEDS[kind](F.col("t")).alias("need"), F.size(pii.matches(F.col("t"), (pii.BASE | pii.GENERATORS)[kind])).alias("n")).collect()
    assert sum(x["n"] for x in got) >= 190 and all(x["need"] for x in got if x["n"])


def test_bare_keys_are_candidates(spark):
    docs = spark.createDataFrame([(1, "use ghp_ghijklmnopqrstuvwxyzghijklmnopqrstuv12 now"), (2, "or sk-ghijklmnopqrstu9 now")], "doc_id long, text string")
    more = pii.with_candidates(docs).select("doc_id", F.explode("more").alias("x")).filter("x.kind = 'key'")
    assert {x["doc_id"] for x in more.collect()} == {1, 2}
