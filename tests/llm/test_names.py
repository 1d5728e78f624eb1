"""Columns of the input that have the names which operators use inside."""

import pytest

from tidemark.llm import jaccard, lines, mixing

NAMES = ("__size", "__source_size", "__target", "__copies", "__copy", "__source", "__of", "__kept", "__n_lines", "__n_dropped", "__number", "__row", "__id", "__key", "__text", "chunk", "turn", "place", "print", "row", "kept", "SIZE", "key", "class_id", "rep", "root")


@pytest.mark.parametrize("operator", [mixing.mixed, lines.without_repeated_lines, jaccard.one_of_each])
def test_clashing_names_are_carried(spark, operator):
    words = "a text of some seven words here".split()
    rows = [(k, " ".join(words[k % 7 :] + words[: k % 7]) + f" {k}\nsame line", "s", *(f"{n}-{k}" for n in NAMES)) for k in range(12)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None) + (None,) * len(NAMES)], ["doc_id", "text", "source", *NAMES])
    out = operator(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for r in got:
        if r.doc_id is not None:
            assert r[0] == rows[r.doc_id][0] and r[2:] == rows[r.doc_id][2:]
