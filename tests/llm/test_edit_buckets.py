"""Fingerprints by a plain walk, and buckets of many unlike fingerprints, in which few pairs may be compared."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import edits, runs
from ledgerloom.llm.workers import importable


def _plain(text):
    """One step at a time, as the module says."""
    codes = np.array([ord(c) for c in text], np.uint32)
    classes = (codes * np.uint32(2_654_435_761)) >> np.uint32(24)
    level, jumps = edits.level_of(len(text)), [edits._jumps(w) for w in range(edits.WALKS)]
    out = []
    for some in (edits.sampled_steps(level), edits.sampled_steps(level + 1)):
        for rows in jumps:
            step, written = 0, []
            for code, kind in zip(codes.tolist(), classes.tolist()):
                more = int(rows[kind, step % edits.PERIOD])
                written += [code % 15 + 1] * more
                step += more
            out += [f"{written[s] if s < len(written) else 0:x}" for s in some.tolist()]
    return f"{level:02x}" + "".join(out)


def test_fingerprints_are_those_of_a_plain_walk(monkeypatch):
    rng = random.Random(17)
    alphabet = "abcdefgh é中\U0001f600"
    texts = ["", "a", "zz", "z" * 700] + ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 31, 64, 65, 300, 900]))) for _ in range(30)]
    texts.append("".join(rng.choice(alphabet) for _ in range(6000)))  # over a period
    expected = [_plain(t) for t in texts]
    assert edits.fingerprints(texts) == expected
    monkeypatch.setattr(edits, "ALONE", 0)
    assert edits.fingerprints(texts) == expected
    for name, value in (("TEXTS", 5), ("CHARACTERS", 1000), ("PLACES", 600), ("PIECE", 7)):
        monkeypatch.setattr(edits, name, value)
    assert edits.fingerprints(texts) == expected


def _all_pairs(codes, near):
    levels, digits = edits._digits_of(codes)
    ended, root = (digits == 0).sum(axis=3), list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes) - 1):
        rest = np.arange(i + 1, len(codes))
        for j in rest[edits._likeness_to(levels, digits, ended, i, rest) >= near].tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(codes))]


def test_large_bucket_compares_few_pairs(monkeypatch):
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(1100, 1900))) for _ in range(900)]
    texts += [t[:400] + "!" + t[400:] for t in texts[:60]] + [t[:1000] + t[1003:] for t in texts[40:90]]
    codes = np.array([list(bytes.fromhex(p)) for p in edits.fingerprints(texts)], np.uint8)
    made, compared = edits._likeness_in, [0]

    def counted(some):
        like = made(some)

        def likenesses(i, j, *walks):
            compared[0] += len(i)
            return like(i, j, *walks)

        return likenesses

    monkeypatch.setattr(edits, "_likeness_in", counted)
    found = edits._near_classes(codes, np.array([0, len(codes)]), 0.8)
    assert found.tolist() == _all_pairs(codes, 0.8) and len(set(found.tolist())) < len(texts) - 80
    assert compared[0] < 0.05 * len(codes) * (len(codes) - 1) / 2


def test_alike_by_a_hair_is_found():
    """Differences spread so that hardly a piece is whole, other walks unlike, ends apart, a level apart."""
    for seed, near in enumerate((0.8, 0.8, 0.8, 0.9, 0.6, 0.3, 1.0)):
        rng = np.random.default_rng(seed)
        levels, digits = rng.integers(5, 8, 150), np.zeros((150, 2, edits.WALKS, edits.SAMPLES), np.uint8)
        least = rng.choice([0, 12, 28])
        for text in digits:
            for walk in range(edits.WALKS):
                long = rng.integers(least, edits.SAMPLES)
                text[0, walk, :long] = rng.integers(1, 16, long)
                short = rng.integers(0, long + 1)
                text[1, walk, :short] = rng.integers(1, 16, short)
        other, up = digits.copy(), rng.random(150) < 0.3
        for text in other:
            kept = rng.integers(edits.WALKS)
            for walk in set(range(edits.WALKS)) - {kept}:
                text[:, walk] = np.where(text[:, walk], rng.integers(1, 16, text[:, walk].shape), 0)
            places = np.argwhere(text[:, kept])
            many = max(0, int((1 - near) * len(places) + 1e-9) + rng.integers(-1, 2))
            for level, step in places[::max(1, len(places) // max(many, 1))][:many]:
                text[level, kept, step] = text[level, kept, step] % 15 + 1
            if rng.random() < 0.3 and (end := int((text[0, kept] != 0).sum())) > 3:
                text[0, kept, end - rng.integers(1, 4):] = 0
        other[up, 0] = other[up, 1]
        digits, levels = np.concatenate([digits, other]), np.concatenate([levels, levels + up])
        codes = np.concatenate([levels[:, None], (digits[..., ::2] << 4 | digits[..., 1::2]).reshape(len(digits), -1)], axis=1).astype(np.uint8)
        codes = codes[rng.permutation(len(codes))]
        found = edits._near_classes(codes, np.array([0, len(codes)]), near)
        assert found.tolist() == _all_pairs(codes, near), (seed, near)
        # Buckets do not see each other, and small ones are the same as large ones.
        apart = edits._near_classes(codes, np.array([0, 90, 91, len(codes)]), near)
        assert apart.tolist() == _all_pairs(codes[:90], near) + [90] + [91 + k for k in _all_pairs(codes[91:], near)]


def test_whole_runs_are_cut_between_runs():
    keys = np.repeat([1, 2, 5, 9, 9, 12], [3, 1, 40, 2, 30, 4])
    part = np.repeat([0, 0, 0, 0, 1, 0], [3, 1, 40, 2, 30, 4])
    table = pa.table({"key": keys, "_part": part, "at": np.arange(len(keys))})
    for size in (1, 2, 7, 200):
        found = [(cols, bounds.tolist()) for cols, bounds in runs.whole_runs(iter(table.to_batches(size)), ["key", "_part"], 5)]
        assert np.concatenate([c["at"] for c, _ in found]).tolist() == list(range(len(keys)))
        assert [b - a for _, bounds in found for a, b in zip(bounds, bounds[1:])] == [3, 1, 40, 2, 30, 4]
    assert list(runs.whole_runs(iter([]), ["key", "_part"])) == []


def test_classes_of_split_buckets(spark, monkeypatch):
    """The same classes when buckets are dealt out as pairs of blocks."""
    importable(spark)
    rng = random.Random(29)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(500, 560))) for _ in range(40)]
    rows = list(enumerate(base + [b[:100] + "x" + b[100:] for b in base]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {r.doc_id: r.class_id for r in edits.edit_classes(df).collect()}
    assert sum(expected[k + 40] == k for k in range(40)) > 30
    monkeypatch.setattr(edits, "BUCKET", 3)
    assert {r.doc_id: r.class_id for r in edits.edit_classes(df).collect()} == expected
