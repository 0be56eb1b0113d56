"""Language identification of mixed texts: script ranges, per-word scores and Viterbi spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize, small_batches

#: Buckets of hashed letter trigrams, and letters labelled at a time.
BUCKETS, LETTERS = 1 << 15, 1_000_000
#: Languages of a model, which is broadcast: BUCKETS floats each. There are some 8,000 languages in the world; 1,024 models take 128 MB.
MAX_LANGUAGES = 1_024
# Fixed first code points of script ranges; a range ends where the next begins. The first is for other characters.
SCRIPTS = [
    ("other", 0x0), ("latin", 0x41), ("greek", 0x370), ("cyrillic", 0x400), ("armenian", 0x530), ("hebrew", 0x590), ("arabic", 0x600),
    ("other", 0x700), ("devanagari", 0x900), ("bengali", 0x980), ("other", 0xA00), ("tamil", 0xB80), ("telugu", 0xC00), ("other", 0xC80),
    ("thai", 0xE00), ("other", 0xE80), ("georgian", 0x10A0), ("hangul", 0x1100), ("other", 0x1200), ("latin", 0x1E00), ("greek", 0x1F00),
    ("other", 0x2000), ("kana", 0x3040), ("other", 0x3100), ("han", 0x3400), ("other", 0xA000), ("hangul", 0xAC00), ("other", 0xD7B0),
    ("han", 0xF900), ("other", 0xFB00), ("arabic", 0xFB50), ("other", 0xFE00), ("arabic", 0xFE70), ("other", 0xFF00), ("han", 0x20000), ("other", 0x30000),
]
NAMES = sorted({name for name, _ in SCRIPTS})


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its small letter, its script's number."""
    points = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in points), bool, len(points))
    small = np.fromiter((ord(s) if len(s := c.lower()) == 1 else ord(c) for c in points), np.uint32, len(points))
    starts = np.array([at for _, at in SCRIPTS])
    script = np.array([NAMES.index(name) for name, _ in SCRIPTS])[np.searchsorted(starts, np.arange(len(points)), side="right") - 1].astype(np.int8)
    return letter, small, script


def _letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the places of its letters, their trigram buckets, which of them begin a word, and their scripts."""
    letter, small, script = _characters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[points]
    codes = np.where(is_letter, small[points], np.uint32(32)).astype(np.uint64)
    framed = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    at = np.flatnonzero(is_letter)
    mixed = framed[at] * np.uint64(0x9E3779B1) + framed[at + 1] * np.uint64(0x85EBCA77C2B2AE63) + framed[at + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    bucket = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    return at, bucket, np.diff(at, prepend=-2) > 1, script[points[at]]


class Model:
    """Per-word scores: log chances of trigrams (bucket, language), and which scripts a language is written in."""

    def __init__(self, langs: list[str], logp: np.ndarray, written: np.ndarray):
        self.langs, self.logp, self.written = langs, logp, written


def held_out() -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def learn(docs: DataFrame, per_language: int = 3000, written_share: float = 0.005) -> Model:
    """Learns from the text and lang of documents that aren't held out: about per_language of each language, drawn by hash.

    What reaches the driver is a row of counts for each language and bucket, whatever the input's size. A table with more than MAX_LANGUAGES
    values of lang is an error, as those aren't languages. Null and empty texts and null languages teach nothing, and a table without any gives an empty model.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", F.lit("sample")).alias("h"))
    there = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(there) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not there:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    spark = docs.sparkSession
    rates = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in there.items()], "l string, rate double")
    some = usable.join(F.broadcast(rates), F.col("lang") == F.col("l")).filter(F.pmod("h", F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = seen.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                _, bucket, _, script = _letters(text)
                own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(script, minlength=len(NAMES))
        for lang, own in seen.items():
            k = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": k, "n": own[k]})

    sums = some.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(there)
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[sums["bucket"].to_numpy(np.int64), [langs.index(x) for x in sums["lang"]]] = sums["n"]
    grams, scripts = table[:BUCKETS] + 0.5, table[BUCKETS:]
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), scripts >= np.maximum(1, written_share * scripts.sum(axis=0)))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of sequences: scores (words, languages), end to end; a change of label costs penalty.

    The sequences step together, the longest first, so that a step is one operation over all of them.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    steps = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # sequences longer than t
    labels = np.zeros(len(scores), np.int32)
    came, stayed, value = [], [], scores[starts[: active[0]]] if steps else scores
    last = np.zeros(len(lengths), np.int32)
    for t in range(1, steps + 1):
        now = active[t] if t < steps else 0
        last[now : len(value)] = value[now:].argmax(axis=1)
        if not now:
            break
        before = value[:now]
        best = before.argmax(axis=1)
        moved = before[np.arange(now), best] - penalty
        stay = before >= moved[:, None]
        came.append(best)
        stayed.append(stay)
        value = scores[starts[:now] + t] + np.where(stay, before, moved[:, None])
    current = last
    for t in range(steps - 1, -1, -1):
        now = active[t]
        labels[starts[:now] + t] = current[:now]
        if t:
            stay = stayed[t - 1][np.arange(now), current[:now]]
            current[:now] = np.where(stay, current[:now], came[t - 1])
    return labels


def _label(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float, str]]:
    """(language, score, spans) of each text."""
    parts = [_letters(t) for t in texts]
    out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(texts)
    some = [k for k, p in enumerate(parts) if len(p[0])]
    if not some or not model.langs:
        return out
    n = len(model.langs)
    heads = [np.flatnonzero(parts[k][2]) for k in some]
    sizes = np.array([len(parts[k][0]) for k in some])
    words = np.concatenate([h + s for h, s in zip(heads, np.cumsum(sizes) - sizes, strict=True)])
    scores = np.add.reduceat(model.logp[np.concatenate([parts[k][1] for k in some])], words, axis=0)
    allowed = model.written[np.concatenate([parts[k][3] for k in some])[words]]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    scores = np.where(allowed, scores, scores - 1e4)
    lengths = np.array([len(h) for h in heads])
    labels = viterbi(scores, lengths, penalty)
    weight = np.diff(np.append(words, sizes.sum()))
    doc = np.repeat(np.arange(len(some)), lengths)
    share = np.bincount(doc * n + labels, weights=weight, minlength=len(some) * n).reshape(-1, n)
    ends = np.cumsum(lengths)
    for j, k in enumerate(some):
        at, begin = parts[k][0], ends[j] - lengths[j]
        own = labels[begin : ends[j]]
        turn = np.flatnonzero(np.diff(own, prepend=-1))
        first = at[heads[j][turn]]
        final = at[np.append(heads[j][turn[1:]], len(at)) - 1] + 1
        best = int(share[j].argmax())
        out[k] = (model.langs[best], float(share[j, best] / share[j].sum()), ",".join(f"{model.langs[own[t]]}:{a}:{b}" for t, a, b in zip(turn, first, final, strict=True)))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """Adds lang_pred, score and spans to documents (text) by a learned model.

    Each word scores the log chance of its letter trigrams in the languages that use its script; Viterbi labels the words, where
    a change of language costs penalty. spans lists lang:begin:end in code points; lang_pred has most letters, score is its share of them.
    A null text, one without letters, or an empty model gives und, 0 and no spans; rows stay as they are, with all their columns, whatever their names, but for
    those three, which are replaced. Very long texts are labelled whole; where languages tie, the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language

    @F.pandas_udf("lang_pred string, score double, spans string")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.fillna("")
            out = np.empty(len(texts), dtype=object)
            order = np.argsort(texts.str.len().to_numpy(), kind="stable")
            limit, group, held = LETTERS * 4 // max(4, len(shared.value.langs)), [], 0
            for k in [*order, -1]:
                if group and (k < 0 or held + len(texts.iloc[k]) > limit):
                    for i, x in zip(group, _label([texts.iloc[i] for i in group], shared.value, penalty), strict=True):
                        out[i] = x
                    group, held = [], 0
                if k >= 0:
                    group.append(k)
                    held += len(texts.iloc[k])
            yield pd.DataFrame(list(out), columns=["lang_pred", "score", "spans"])

    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    return docs.select(F.struct(*kept).alias("row"), labelled(F.col("text").cast("string")).alias("found")).select("row.*", "found.*")


def op7_language(docs: DataFrame) -> DataFrame:
    """The thin query over learn and identify."""
    with small_batches(docs.sparkSession):
        found = materialize(identify(docs.select("doc_id", "text"), learn(docs)).drop("text"), "languages")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
