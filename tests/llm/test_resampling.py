"""Importance resampling against a version in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import entries, resampling
from ledgerloom.llm.resampling import Draw

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, draw=Draw()):
    """(id, n_features, weight, score, rank) of all (id, text)."""
    def features(text):
        words = WORD.findall((text or "").translate(FOLD))
        runs = [" ".join(words[i:i + n]) for n in range(1, draw.runs + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % draw.buckets for r in runs]
    rows = [(i, *features(text)) for i, text in docs]
    s, t = Counter(b for _, _, f in rows for b in f), Counter(b for text in target for b in features(text)[1])
    s_all, t_all, k = sum(s.values()), sum(t.values()), draw.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + k) / ((s[b] + 1) * (t_all + k)))) for b in range(k)]
    out, eligible = [], []
    for at, (i, words, f) in enumerate(rows):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if words >= draw.least_words:
            eligible.append(at)
    eligible.sort(key=lambda at: (-out[at][3], out[at][0] is None, out[at][0] or 0))
    for rank, at in enumerate(eligible[:draw.percent * len(eligible) // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, docs, target):
    spark = entries.importable(spark)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")


def test_op13(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = brute(docs, target)
    assert found(entries.op13_importance_resampling(spark, sf)) == expected
    assert sum(r[4] is not None for r in expected) > 10


TEXTS = ["Alpha beta GAMMA, d1!", "", None, "é à É alpha\x00beta", "x" * 3000, "one two three " * 50, "ÀB c'd e-f 12 3"]


@pytest.mark.parametrize("draw", [Draw(least_words=0, percent=100), Draw(runs=3, least_words=3, percent=40), Draw(buckets=7, least_words=1, percent=50)])
def test_texts_of_all_kinds(spark, draw):
    docs, target = [(i, t) for i, t in enumerate(TEXTS * 3)], ["alpha beta", None, "three one", ""]
    assert found(resampling.resample(*frames(spark, docs, target), draw)) == brute(docs, target, draw)


def test_runs_across_slices(monkeypatch):
    text = b"aa bb cc dd ee ff gg"
    whole = resampling.bucket_numbers(text, 3)
    monkeypatch.setattr(resampling, "SLICE", 4)
    cut = resampling.bucket_numbers(text, 3)
    assert cut[0] == whole[0] == 7 and sorted(cut[1].tolist()) == sorted(whole[1].tolist())


def test_bracket_is_widened_and_ties_go_to_the_smaller_id(spark):
    docs = [(i % 150, "same text for all " * 9) for i in range(600)]
    draw = Draw(percent=37)
    got = resampling.resample(*frames(spark, docs, ["same"]), draw, error=0.0)
    assert found(got) == brute(docs, ["same"], draw)


def test_one_key_holds_most_rows(spark):
    docs = [(None, "w " * 30)] * 300 + [(i, "v " * 30) for i in range(100)]
    got = resampling.resample(*frames(spark, docs, ["v"]), Draw(percent=50))
    assert found(got) == brute(docs, ["v"], Draw(percent=50))


def test_empty_tables_and_other_columns(spark):
    docs, target = frames(spark, [(1, "a " * 30), (2, "b " * 30)], ["a"])
    clashing = docs.selectExpr("doc_id", "text", "1 AS score", "'x' AS rank", "3 AS id", "4 AS words", "5 AS part")
    draw = Draw(percent=50)
    assert found(resampling.resample(clashing, target, draw)) == brute([(1, "a " * 30), (2, "b " * 30)], ["a"], draw)
    assert found(resampling.resample(docs.limit(0), target)) == []
    assert found(resampling.resample(docs, target.limit(0), draw)) == brute([(1, "a " * 30), (2, "b " * 30)], [], draw)
