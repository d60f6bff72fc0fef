import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components_of(nodes, linked):
    """Smallest member of each node's component, by plain search."""
    out = {}
    for start in sorted(nodes):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += [y for y in nodes if y not in out and linked(x, y)]
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with null and empty texts, null ids and sources, repeated rows, ties, a long text and clashing extra columns."""
    passage = " ".join(f"shared{k}" for k in range(30))
    long = " ".join(f"w{k * k % 977}" for k in range(40_000))
    texts = [None, "", " \n\t ", "one", "The cat sat on the mat.", "The cat sat on the mat.", "the the the the the the the the the the the the the the the the",
             f"begin of it {passage} and the end", f"{passage} elsewhere in the house of a friend", f"quite other {passage}", long, long, long + " tail",
             "Zürich ist schön und der See auch.\nLicensed under the Apache License, Version 2.0.\nEnde", "<|endoftext|> x <|startoftext|>", "don't  stop\x1c now  ok",
             "x" * 5000, "a b c d e f g h i j k l m", "a b c d e f g h i j k l m n", "<0x41>▁ ▁odd 漢字"]
    rows = [(i, t, "en", "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id at all", "en", "s1", 12), (None, None, None, None, None), (4, "another text under id four", "en", "s2", 26)]
    names = ("ids", "decoded", "fingerprint", "component_id", "id", "key", "n", "count", "n_words", "kept_text", "n_lines", "score", "features", "signatures", "sequence_id",
             "offset", "licences", "node", "_host", "_id", "window", "first")
    df = spark.createDataFrame(rows, DOCS)
    for name in names:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
