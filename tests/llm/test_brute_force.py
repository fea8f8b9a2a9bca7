"""Queries against brute-force versions on the smallest sample tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import edits, entries, mixing, packing, simhash, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(sf):
    return sorted(pq.read_table(f"{sf}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def library_ids():
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(tokens.word_file())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark, sf, documents):
    found = {r.doc_id: r for r in entries.op1_edit_fingerprints(spark, sf).collect()}
    assert len(found) == len(documents)
    for k, row in enumerate(documents):
        text, after = row["text"], documents[(k + 1) % len(documents)]["text"]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = found[row["doc_id"]]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == edits.fingerprints([text, edited])
        assert r.near_edited == edits.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == edits.likeness(r.fingerprint, edits.fingerprints([after])[0])
    assert np.mean([r.near_edited for r in found.values()]) > 0.5
    assert np.median([r.near_next for r in found.values()]) < 0.2


def test_op2(spark, sf, documents, library_ids):
    rows = entries.op2_best_fit_packing(spark, sf).collect()
    expected = set()
    for row in documents:
        ids = library_ids(row["text"]) + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected.add((row["doc_id"], piece, at, len(part), zlib.crc32(packed(part))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 2


def test_op3(spark, sf):
    turns = defaultdict(list)
    for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", entries.CONTROL_TEXT), (1, "assistant", entries.CONTROL_TEXT)]
    found = {r.conv_id: r for r in entries.op3_chat_formatting(spark, sf).collect()}
    assert found.keys() == turns.keys()
    for conv, said in turns.items():
        said.sort()
        loss = "".join(t for _, role, t in said if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in said)
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(said), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= len(whole)


def test_op4(spark, sf, documents):
    rows = entries.op4_source_mixing(spark, sf).collect()
    size, source = {}, {}
    for r in documents:
        size[r["doc_id"]], source[r["doc_id"]] = len(WORD.findall(r["text"] or "")), r["source"]
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    names = sorted(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:  # clamp and reshare until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        free -= over
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(rows) == len(documents)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(rows) == sorted(entries.op4_source_mixing(spark, sf).collect())


def test_op5(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()}
    ids = np.array(sorted(vectors))
    unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    rows = entries.op5_nearest_neighbours(spark, sf).collect()
    best, hits, asked = defaultdict(dict), 0, [i for i in ids if i % 50 == 0]
    for r in rows:
        best[r.query_id][r.rank] = (r.vec_id, r.score)
    for q in asked:
        scores = unit @ unit[np.searchsorted(ids, q)]
        exact = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:5]
        hits += len({v for v, _ in best[q].values()} & set(exact))
        assert sorted(best[q]) == [1, 2, 3, 4, 5]
        assert [s for _, (_, s) in sorted(best[q].items())] == sorted((s for _, s in best[q].values()), reverse=True)
        for v, s in best[q].values():
            assert s == pytest.approx(float(scores[np.searchsorted(ids, v)]), abs=1e-12)
    assert hits / (5 * len(asked)) >= 0.9


def test_op7(spark, sf, documents, library_ids):
    found = {r.doc_id: r for r in entries.op7_token_files(spark, sf).collect()}
    start = 0
    for row in documents:
        ids = library_ids(row["text"]) + [2]
        r = found[row["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert len(found) == len(documents)


def test_op9(spark, sf, documents):
    from xxhash import xxh64_intdigest
    prints = {}
    for row in documents:
        words = [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"]))]
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints[row["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = entries.op9_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{prints[i]:016x}", find(i)) for i in ids}
    assert len(rows) == len(ids)


def test_op10(spark, sf, documents):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = entries.op10_quality_classifier(spark, sf).collect()
    assert len(rows) == len(documents)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in held if r.doc_id in labels]
    assert np.mean([p == y for p, y in known]) >= 0.9


def test_pipeline(spark, sf, documents, library_ids):
    """Every stage on its own input, as the driver runs them."""
    import corpus_pipeline
    from ledgerloom.session import stage
    columns = list(documents[0])
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, sf), f"stage-{k}")
        seen.append([r.asDict() for r in docs.collect()])
        if k < 3:
            assert docs.columns == columns
    good, single, mixed, placed = seen
    whole = {r["doc_id"]: r for r in documents}
    assert all(r == whole[r["doc_id"]] for r in good + single) and 0 < len(good) < len(documents)
    # Near-duplicates: of each component of what came in, one document stays.
    parts = simhash.near_duplicates(spark.createDataFrame(good)).collect()
    assert {r["doc_id"] for r in single} == {r.component_id for r in parts} and len(single) == len({r.component_id for r in parts})
    # Mix: copies are whole or a prefix, words come near the targets.
    targets = {r["source"]: r["target"] for r in mixing.source_targets(
        spark.createDataFrame(single).select("source", mixing.word_count().alias("size")), "source", (5.0, 2.0, 1.0), 3.0).collect()}
    taken = Counter()
    for r in mixed:
        assert whole[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    # Packing: every piece of every copy.
    expected = Counter()
    for r in mixed:
        ids = library_ids(r["text"]) + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            expected[(r["doc_id"], piece, at, len(ids[at:at + 2048]), zlib.crc32(packed(ids[at:at + 2048])))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == expected
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == len(placed)
