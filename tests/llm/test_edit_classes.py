"""The near-text half of op1: its query, and the verification of whole runs at once."""

import random

import numpy as np
import pyarrow.parquet as pq

from ledgerloom.llm import edits, entries
from ledgerloom.llm.workers import importable


def test_likeness_of_rows_is_likeness():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 2, 5, 60, 64, 65, 120, 300]))) for _ in range(60)]
    texts += [t[:20] + "x" + t[20:] for t in texts] + [t + t[:9] for t in texts]
    prints = sorted(set(edits.fingerprints(texts)))
    levels, digits = edits._digits_of(np.array([list(bytes.fromhex(p)) for p in prints], np.uint8))
    ended, rest = (digits == 0).sum(axis=3), np.arange(len(prints))
    for i, own in enumerate(prints):
        found = edits._likeness_to(levels, digits, ended, i, np.delete(rest, i))
        assert found.tolist() == [edits.likeness(own, p) for p in prints if p != own]


def test_op1_has_classes_of_the_whole_table(spark, sf):
    """Classes against bands and likeness of all pairs by brute force."""
    rows = entries.op1_edit_fingerprints(spark, sf).collect()
    assert len(rows) == pq.read_table(f"{sf}/documents.parquet").num_rows
    prints = sorted({r.fingerprint for r in rows})
    bands = [{(int(p[:2], 16) + k, at, p[2 + k * 192 + at:10 + k * 192 + at]) for k in (0, 1) for at in range(0, 192, 8)
              if int(p[:2], 16) == 0 or p[2 + k * 192 + at:10 + k * 192 + at].strip("0")} for p in prints]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bands[i] & bands[j] and edits.likeness(prints[i], prints[j]) >= 0.8:
                root[find(i)] = find(j)
    place, least = {p: find(i) for i, p in enumerate(prints)}, {}
    for r in rows:
        least[place[r.fingerprint]] = min(r.doc_id, least.get(place[r.fingerprint], r.doc_id))
    assert {r.doc_id: r.class_id for r in rows} == {r.doc_id: least[place[r.fingerprint]] for r in rows}
    assert any(r.class_id != r.doc_id for r in rows)


def _edited(rng, text, edits_made):
    """The text with so many characters replaced, put in or taken out at random places."""
    out = list(text)
    for _ in range(edits_made):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdefghijklmnop ")]
    return "".join(out)


def test_recall_of_classes_by_rate_of_edits(spark):
    """Every pair at the stated likeness, whether it shares a band or not; and real edits by their rate."""
    importable(spark)
    rng = random.Random(41)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(2000)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    for step, made in enumerate((4, 20, 100)):     # 0.2, 1 and 5 percent
        rows += [(1000 * (step + 1) + k, _edited(rng, t, made)) for k, t in enumerate(base)]
    found = {r.doc_id: r for r in edits.edit_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(a, b) for a in found for b in found if a < b and edits.likeness(found[a].fingerprint, found[b].fingerprint) >= 0.8]
    together = sum(found[a].class_id == found[b].class_id for a, b in near)
    assert len(near) > 60 and together >= 0.98 * len(near)
    # Texts of different origin never meet.
    assert all(a % 1000 == b % 1000 for a, b in near) and all(r.class_id % 1000 == d % 1000 for d, r in found.items())
    rates = [sum(found[1000 * s + k].class_id == found[k].class_id for k in range(60)) / 60 for s in (1, 2, 3)]
    assert rates[0] >= 0.95 and rates[0] >= rates[1] >= rates[2], rates
    print("recall by rate of edits", rates, "pairs", len(near), "together", together)
