"""The stages of the corpus pipeline: columns, what goes and what stays, odd rows and empty tables."""

from __future__ import annotations

import collections
import re
from pathlib import Path

import corpus_pipeline
from foliant.llm import decontaminate, mixing, quality, simhash
from foliant.llm.common import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    """By five-word shingles, or by words with repeats where shingles are shared."""
    x, y = shingles(a), shingles(b)
    words = [collections.Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b)]
    return 5 * len(x & y) >= 4 * len(x | y) or len(x & y) and 5 * sum((words[0] & words[1]).values()) >= 4 * sum((words[0] | words[1]).values())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            want = collections.Counter(r["doc_id"] for r in quality.op5_quality(docs).filter("kept").collect())
        elif name == "near_duplicates":
            first = {r["component_id"] for r in simhash.op4_simhash(docs).collect()}
            texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
            copies = {i for i in first for j in first if j < i and similar(texts[i], texts[j])}
            gone = first - {r["doc_id"] for r in stage(spark, docs, SF).collect()}
            assert gone == copies and gone
            want = collections.Counter(first - gone)
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.op6_decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            want = collections.Counter(before - bad)
        elif name == "mixing":
            want = collections.Counter({r["doc_id"]: r["starts"] for r in mixing.taken(mixing.draw(docs)).collect() if r["starts"]})
        else:
            want = collections.Counter(r["doc_id"] for r in docs.collect())
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert collections.Counter(r["doc_id"] for r in docs.collect()) == want, name
        assert docs.columns == COLUMNS + (["shard", "slot"] if name == "sharding" else [])
    counts = collections.Counter(r["shard"] for r in docs.collect())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_stages_on_odd_rows(spark, odd, clashing, nothing):
    for docs in (odd, clashing, nothing):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            assert set(docs.columns) <= set(found.columns) | {"shard", "slot"}
            assert found.count() <= 2 * docs.count()


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and "shard" in found.columns


def test_tables_of_a_run_are_deleted(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == [f"stage-{corpus_pipeline.STAGES[-1][0]}"]


def stage(spark, name, docs):
    columns = COLUMNS + (["shard", "slot"] if name == "sharding" else [])
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert found.columns == columns
    return [tuple(r) for r in found.collect()]


def counted(rows):
    return collections.Counter(tuple(r[:5]) for r in rows)


def test_quality_of_odd_rows(spark, odd, odd_rows):
    """Rows come as they went in, equal texts together; what fails the base rules by hand is gone, and plain prose stays."""
    kept, before = counted(stage(spark, "quality", odd)), counted(odd_rows)
    assert all(kept[r] in (0, n) for r, n in before.items()) and not kept - before
    by_text = collections.defaultdict(set)
    for r in before:
        by_text[r[1]].add(r in kept)
    assert all(len(v) == 1 for v in by_text.values())
    for r in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(words) < 10 or 100 * len(covered) > 20 * len(words):
            assert r not in kept, r[0]


def test_near_duplicates_of_odd_rows(spark, odd, odd_rows):
    """One row of each text stays, the one with the smallest id; what else goes is similar to one that stays or has its fingerprint; no two that stay are similar."""
    kept = stage(spark, "near_duplicates", odd)
    assert max(counted(kept).values()) == 1
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.op4_simhash(odd.filter("doc_id IS NOT NULL")).collect()}
    place = lambda r: (r[0] is None, r[0] or 0)
    texts = {r[1] or "": r for r in kept}
    assert len(texts) == len(kept)
    for r in odd_rows:
        if tuple(r) not in counted(kept):
            same = [k for k in kept if (k[1] or "") == (r[1] or "") or similar(k[1] or "", r[1] or "") or None not in (r[0], k[0]) and (prints[r[0]] ^ prints[k[0]]).bit_count() <= 4]
            assert any(place(k) <= place(r) for k in same), r[0]
    assert not [(a[0], b[0]) for a in kept for b in kept if place(a) < place(b) and a[1] and b[1] and similar(a[1], b[1])]


def test_decontamination_of_odd_rows(spark, odd, odd_rows):
    """Texts with a benchmark item put in go, all others stay as often as they were."""
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    leaked = [(9_000, f"before {item} after", "en", "s1", 1), (9_001, item.upper(), None, None, None), (None, item, "en", "s1", 2)]
    docs = odd.union(spark.createDataFrame(leaked, odd.schema))
    assert counted(stage(spark, "decontamination", docs)) == counted(odd_rows)


def test_mixing_of_odd_rows(spark, odd, odd_rows):
    """Rows come as they went in, twice their number at most; texts without words never; each source's words near its target, but for its longest text."""
    before, after = counted(odd_rows), counted(stage(spark, "mixing", odd))
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    assert not [r for r in after if not (r[1] or "").split()]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = {r["source"]: r["target"] for r in mixing.op2_mixing(odd).join(odd.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    for source in {r[3] for r in before}:
        taken = sum(size(r) * n for r, n in after.items() if r[3] == source)
        longest = max(size(r) for r in before if r[3] == source)
        assert abs(taken - target.get(source, taken)) <= 2 * longest + 128, source


def test_sharding_of_odd_rows(spark, odd, odd_rows):
    """All rows come once, in shards of counts at most one apart, with slots without gaps."""
    found = stage(spark, "sharding", odd)
    assert counted(found) == counted(odd_rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r[5]].append(r[6])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
