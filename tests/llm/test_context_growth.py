"""Context trees grow with their corpus."""

from tallyforge.llm import ctw


def test_rare_contexts_are_split_off_in_large_corpora(spark):
    """A context seen twice among three million bytes has a row of its own."""
    train = spark.createDataFrame([("ab" * 1_500_000,), ("xyzzyq xyzzyr",)], "text string")
    tree = ctw.ContextTree(ctw.gram_counts(train))
    name = int.from_bytes(b"xyzzy"[::-1], "big")
    assert any(((depths == 5) & (names == name)).any() for depths, names, _ in tree.blocks())
