from __future__ import annotations

import pytest

#: Columns that documents may have beside their own, named like the operators' inner ones.
CLASHING = ["size", "fp", "shard", "slot", "chunk", "block", "row_key", "kept", "base", "tokens", "windows", "_text", "_words", "_key", "_id", "_size", "n_words", "count", "src", "place", "common", "spans", "rank", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The river ran past the old mill and on to the sea while the children of the village played in the fields by the bridge"
LONG = " ".join(f"word{i % 977} the of and{i}" for i in range(6_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and very long texts, ties and repeated rows, secrets, copies."""
    near = PROSE.replace("children", "kids")
    texts = [PROSE, PROSE, near, "", None, "   \n\t ", LONG, LONG + " end", "token = abcdefgh1 " + PROSE, "x" * 5_000, "été naïve façade déjà vu à la carte", "你好 世界", "a b", "A B", "👍 emoji 👩‍💻 text"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[4], (None, PROSE, "en", "s1", 3), (None, "nameless text of its own", None, None, None)]
    rows += [(100 + i, f"{PROSE} number {i} " + " ".join(f"w{i * j % 101}" for j in range(60)), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
