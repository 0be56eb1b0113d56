"""Near-duplicates among texts that share a passage: every copy is found, and pairs grow with the texts, not with their square. Tables of one thread outlive those of another."""

from __future__ import annotations

import random
import threading
from pathlib import Path

import numpy as np
import pytest

from foliant.llm import common, simhash


def with_passage(n, seed=1):
    """n texts of words of their own, all with one passage; each tenth has a copy with words added."""
    draw = random.Random(seed)
    passage = [f"p{k}" for k in range(25)]
    texts = []
    for k in range(n):
        own = [f"t{k}w{draw.randrange(10**6)}" for _ in range(60)]
        at = draw.randrange(60)
        texts.append(own[:at] + passage + own[at:])
        if k % 10 == 0:
            texts.append(texts[-1] + [f"n{draw.randrange(10**6)}" for _ in range(8)])
    return [" ".join(t) for t in texts]


def pairs_of(spark, texts, monkeypatch):
    """(the pairs of texts that meet at shingles at the end, the ids that go)."""
    seen = [0]

    def counted(df, name, keep=False):
        found = common.materialize(df, name, keep)
        if name == "similar-rest" and "parts" in found.columns:
            seen.append(found.groupBy("gram").count().selectExpr("sum(count * count)").first()[0] or 0)
        return found

    with monkeypatch.context() as m:
        m.setattr(simhash, "materialize", counted)
        m.setattr(simhash, "COUNTED", 10)  # one text of SHARE is counted
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        gone = {r["doc_id"] for r in simhash.similar_texts(docs).collect()}
    return sum(seen), gone


def copies(texts):
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    return {j for j in range(1, len(texts)) for i in range(max(0, j - 1), j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def test_pairs_grow_with_the_texts(spark, monkeypatch):
    found = {}
    for n in (150, 300):
        texts = with_passage(n)
        found[n], gone = pairs_of(spark, texts, monkeypatch)
        assert gone == copies(texts) and len(gone) == n // 10
    assert found[300] <= 3 * max(found[150], 300)
    monkeypatch.setattr(simhash, "commonest", lambda rows, size, width: np.zeros(0, dtype=np.int64))  # where nothing is known to be common: every two of the texts
    before, gone = pairs_of(spark, with_passage(150), monkeypatch)
    assert before > 5 * max(found[150], 300) and gone == copies(with_passage(150))


def test_tables_of_another_thread_stay(spark):
    made = []

    def other():
        made.append(common.materialize(spark.range(3).toDF("a"), "other"))

    with common.scratch(spark):
        own = common.materialize(spark.range(2).toDF("a"), "own")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert own.count() == 2
    assert made[0].count() == 3
    with pytest.raises(Exception, match="(?i)not.?exist"):
        own.count()


def test_common_shingles_are_counted_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 10)
    texts = with_passage(100) + ["one two three four five"] * 3  # equal texts count once
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _text string").selectExpr("doc_id", "_text", "xxhash64(_text) AS row_key")
    found = simhash.commonest(rows, len(texts), 5)
    grams = simhash.shingle_sets(simhash.hashed_words(rows["_text"]), simhash.hashed_words(rows["_text"]))
    held = {}
    for r in rows.dropDuplicates(["row_key"]).select(grams["grams"].alias("g")).collect():
        for g in r["g"]:
            held[g] = held.get(g, 0) + 1
    assert found.tolist()[::-1] == sorted((g for g, n in held.items() if n > 3), key=lambda g: (-held[g], g))


def test_written_tables_leave_no_shuffle_files(spark, monkeypatch):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {p.name for f in folders for p in Path(f).rglob("shuffle_*.data")}
    before, left = shuffled(), []

    def followed(df, name, keep=False):
        found = common.materialize(df, name, keep)
        left.append((name, len(shuffled() - before)))
        return found

    monkeypatch.setattr(simhash, "materialize", followed)
    docs = spark.createDataFrame(list(enumerate(with_passage(60))), "doc_id long, text string")
    with common.scratch(spark):
        simhash.similar_texts(docs)
    assert len(left) > 8 and not [x for x in left if x[1]]
