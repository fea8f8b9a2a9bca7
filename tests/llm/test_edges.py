"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, edits, entries, graph, licences, mixing, neighbours, packing, quality, runs, simhash, token_files, tokens, url_filters
from ledgerloom.llm.workers import importable
from ledgerloom.session import scratch_dir, stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, target string, _row int, bin string, score double"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture(scope="module")
def messy(spark):
    """Documents of every awkward kind; extra columns have names that operators use inside."""
    importable(spark)
    texts = [(1, ""), (2, None), (3, "A b\tc  d"), (4, "a B c\nd"), (5, LONG), (5, LONG), (6, LONG + " tail"), (None, "no id"), (None, "no id"),
             (7, " \n\t "), (8, "one"), (9, "One"), (10, "\u00e9t\u00e9 \U0001f600 \x1cx\u00a0y"), (10, "other text of one id"), (None, None)]
    rows = [(i, t, None, ("s", None, "t")[k % 3], None if t is None else len(t), 7, "x", None, k, "b", float("nan")) for k, (i, t) in enumerate(texts)]
    return stage(spark.createDataFrame(rows, SCHEMA), "messy")


@pytest.fixture(scope="module")
def empty(messy):
    return stage(messy.where("false"), "empty")


def test_edit_fingerprints(spark, messy, empty):
    rows = sorted(((r.doc_id, r.text) for r in messy.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = Counter()
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = edits.edited_text(text or "", after or "")
        expected[(doc, len(text or ""), hashlib.sha256(edited.encode()).hexdigest(), *edits.fingerprints([text, edited]))] += 1
    found = edits.edited_fingerprints(messy).collect()
    assert Counter(tuple(r)[:5] for r in found) == expected
    assert edits.edited_fingerprints(empty).count() == 0
    alone = edits.edited_fingerprints(messy.where("doc_id = 8")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in alone] == [(8, hashlib.sha256(b"ono").hexdigest())]


def test_fingerprints_walk_alone_as_in_company():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) for _ in range(60)]
    assert edits.fingerprints(texts) == [edits.fingerprints([t])[0] for t in texts]
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    changed = text[:1000] + "xyz" + text[1000:3000] + text[3005:]
    near, far = edits.fingerprints([changed, "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))])
    own = edits.fingerprints([text])[0]
    assert edits.likeness(own, near) > 0.8 > 0.3 > edits.likeness(own, far)


def test_edit_classes(spark):
    importable(spark)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(1500)) for _ in range(4)]
    rows = [(k, b) for k, b in enumerate(base)] + [(10 + k, b[:700] + "!" + b[700:]) for k, b in enumerate(base)] + [(20, base[0]), (21, None), (22, "")]
    found = {r.doc_id: r.class_id for r in edits.edit_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 1, 12: 2, 13: 3, 20: 0, 21: 21, 22: 21}


def test_packing(spark, messy, empty):
    from tokenizers import Tokenizer
    library, expected = Tokenizer.from_file(tokens.word_file()), Counter()
    for r in messy.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            expected[(r.doc_id, piece, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))] += 1
    found = packing.pack_documents(messy, tokens.word_file()).collect()
    assert Counter(tuple(r)[:5] for r in found) == expected
    assert packing.pack_documents(empty, tokens.word_file()).count() == 0
    clashing = spark.createDataFrame([(1, 5, "x", 9)], "id long, length long, bin string, offset long")
    assert [(r.id, r.offset) for r in packing.pack(clashing, 10).collect()] == [(1, 0)]


def test_best_fit_and_bounds():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 101, 3000), np.full(50, 51), np.array([34] * 30 + [33] * 60), np.array([100] * 5), np.array([], int)):
        bins, offsets, used = packing.best_fit(lengths, 100)
        fill = np.zeros(used, int)
        for b, o, n in sorted(zip(bins, offsets, lengths)):
            assert o == fill[b]
            fill[b] += n
        assert (fill <= 100).all() and packing.lower_bound(lengths, 100) <= used
    assert packing.lower_bound(np.full(50, 51), 100) == 50
    assert packing.lower_bound(np.array([34] * 30), 100) == 15


def test_packing_in_rounds(spark, monkeypatch):
    """Groups that miss their bound give their open bins up; nothing is lost or placed twice."""
    importable(spark)
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(4).integers(1, 70, 900))]
    items = spark.createDataFrame(rows, "id long, length long").repartition(5)
    monkeypatch.setattr(packing, "GROUP", 100)
    found = packing.pack(items, 100).collect()
    assert sorted((r.id, r.length) for r in found) == rows
    bins = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 100 and len(bins) <= 1.1 * packing.lower_bound(np.array([n for _, n in rows]), 100)


def test_chat(spark):
    importable(spark)
    odd = "<|done|> <\\|says|> <<|turn|>\\ <|endoftext|> \n\n x"
    rows = [(1, 0, "user", odd, 1), (1, 1, "assistant", odd, 1), (1, 1, "assistant", odd, 1), (1, None, None, None, 1), (None, 0, "assistant", "\u00e9\U0001f600", 1),
            (2, 0, "assistant", "", 1), (3, 0, "assistant", LONG, 1), (4, 0, "<|says|>", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    found = {r.conv_id: r for r in chat.format_conversations(df, tokens.byte_file()).collect()}
    assert chat.parse(found[1].formatted) == [("", ""), ("user", odd), ("assistant", odd), ("assistant", odd)]
    assert chat.parse(found[4].formatted) == [("<|says|>", "x")]
    loss = {k: chat.loss_text(r.formatted, r.token_start, r.token_end, r.loss_mask) for k, r in found.items()}
    assert loss == {1: odd + odd, None: "\u00e9\U0001f600", 2: "", 3: LONG, 4: ""}
    assert chat.format_conversations(df.where("false"), tokens.byte_file()).count() == 0


def test_mixing(spark, messy, empty):
    sized = messy.select("doc_id", "source", "target", mixing.word_count().alias("size"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == messy.count()
    for source in ("s", "t", None):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.whole * r["size"] + r.extra for r in own) - own[0].target) <= 1
        assert all(0 <= r.whole * r["size"] + r.extra <= 3 * r["size"] for r in own)
    assert mixing.mix(sized.where("false")).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert {r.target for r in mixing.mix(sized.where("size = 0")).collect()} == {0.0}
    out = mixing.mixed_documents(messy)
    assert out.columns == messy.columns
    whole = {(r.doc_id, r.text) for r in messy.collect()}
    for r in out.collect():
        assert r.text is None or any(d == r.doc_id and t is not None and t.startswith(r.text) for d, t in whole)


def test_water_filling_against_steps(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 5, 50, 5000]) for k in range(rng.randrange(1, 9))}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        target, free, left = {}, set(sizes), float(sum(sizes.values()))
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            if not over:
                target.update(share)
                break
            target.update({s: 3.0 * sizes[s] for s in over})
            left -= sum(3 * sizes[s] for s in over)
            free -= over
        found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), "source", (5.0, 2.0, 1.0), 3.0)
        assert {r.source: r.target for r in found.collect()} == pytest.approx(target)


def test_neighbours(spark):
    importable(spark)
    rng = np.random.default_rng(6)
    one = [0.5, -0.25, 1.0, 2.0]
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(200)] + [(1000 + i, one, 0) for i in range(1200)]
    rows += [(5000, None, 0), (5050, [0.0] * 4, 0), (5100, [1.0, None, 2.0, 3.0], 0), (5150, [1.0, float("nan"), 2.0, 3.0], 0),
             (5200, [1.0, float("inf"), 2.0, 3.0], 0), (None, one, 0), (50, rows[50][1], 0), (6000, [1e300, 1e300, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    asked = df.where("vec_id % 50 = 0")
    found = {}
    for r in neighbours.nearest(df, asked, neighbours.Hashing(4)).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == {0, 50, 100, 150, *range(1000, 2200, 50), 6000}
    # Equal vectors: ties go to the smaller ids, the query's own left out.
    assert [v for v, _ in (found[1000][k] for k in range(1, 6))] == [1001, 1002, 1003, 1004, 1005]
    assert all(s == pytest.approx(1.0) for _, s in found[1000].values())
    assert neighbours.nearest(df.where("false"), asked.where("false"), neighbours.Hashing(4)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, few.where("vec_id = 0"), neighbours.Hashing(4, width=100.0)).count() == 2


def test_licences(spark, messy, empty):
    mit = dict(licences.KNOWN)
    rows = [(1, "Copyright (c) 2019 Someone\n" + licences._MIT.upper().replace(",", " ;")), (2, "x\nLicenced under the APACHE licence -- version 2.0\ny"),
            (3, "Released under the MIT License."), (4, None), (5, ""), (6, "..."), (3, "Released under the MIT License."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, license string, _hash int")
    known = licences.known_licences(spark)
    found = licences.scan(df, known).collect()
    assert len(found) == len(rows) and mit
    by = {r.doc_id: r for r in found}
    assert by[1].license == "MIT" and (by[2].license, by[2].notices) == (None, "Apache-2.0")
    assert [(r.license, r.notices) for r in found if r.doc_id in (3, None)] == [("MIT", "MIT")] * 3
    assert [(by[k].digest, by[k].license, by[k].notices) for k in (4, 5, 6)] == [(None, None, None)] * 3
    assert licences.scan(messy, known).count() == messy.count() and licences.scan(empty, known).count() == 0


def test_token_files(spark, messy, empty):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.word_file())
    rows = sorted(((r.doc_id, r.text or "") for r in messy.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, expected = 0, Counter()
    for doc, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        expected[(doc, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    folder = scratch_dir(spark, "tokens")
    files = token_files.write_tokens(messy, folder, tokens.word_file(), frame=4096)
    found = token_files.read_tokens(spark, folder, files)
    assert Counter(tuple(r)[:4] for r in found.collect()) == expected
    some = token_files.read_tokens(spark, folder, files, wanted=[5, 8]).collect()
    assert sorted(r.doc_id for r in some) == [5, 5, 8]
    none = scratch_dir(spark, "tokens")
    assert token_files.read_tokens(spark, none, token_files.write_tokens(empty, none, tokens.word_file())).count() == 0


def test_token_file_is_plain_zstandard_and_checked(tmp_path):
    import io

    import pyarrow as pa
    import zstandard
    path = str(tmp_path / "x.zst")
    documents = [(k, np.arange(k * 7, dtype="<u4").tobytes()) for k in range(200)] + [(None, b"")]
    with open(path, "wb") as sink:
        writer = token_files.FrameWriter(sink, frame=1000)
        for doc, ids in documents:
            writer.add(doc, ids)
        writer.close()
    data = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(ids for _, ids in documents)
    reader = token_files.FrameReader(pa.OSFile(path))
    assert len(reader.table) > 10 and [reader.read(k) for k in (199, 0, 57, 200)] == [documents[k][1] for k in (199, 0, 57, 200)]
    broken = bytearray(data)
    broken[int(reader.at[3]) + int(reader.table[3][0]) - 1] ^= 1
    with pytest.raises(Exception):
        token_files.FrameReader(pa.BufferReader(bytes(broken)))._frame(3)


def test_url_filter(spark):
    importable(spark)
    rows = [(1, None), (2, "no host"), (3, "http://A.Example.NET/en/x?q#f"), (4, "https://example.net"), (5, "x://net/"), (6, "x://de.example.com/de/"),
            (7, "x://example.com/d?/de/"), (8, "x://a.org/fr/y"), (9, "x://aorg/fr/"), (3, "http://A.Example.NET/en/x?q#f"), (None, "x://b.net/\nz"), (11, "")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    found = sorted(map(tuple, url_filters.judge(df, [("net", "/"), ("example.com", "/de/")], [("example.net", "/en/"), ("org", "/fr/")]).collect()), key=repr)
    assert found == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (4, "example.net", "", None, "allow"), (5, "net", "/", "net/", "block"), (6, "de.example.com", "/de/", "example.com/de/", "block"),
        (7, "example.com", "/d", None, "allow"), (8, "a.org", "/fr/y", "org/fr/", "allow"), (9, "aorg", "/fr/", None, "allow"),
        (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (None, "b.net", "/\nz", "net/", "block"), (11, "", "", None, "allow")], key=repr)
    assert url_filters.judge(df.where("false"), [("net", "/")], []).count() == 0
    assert {r.verdict for r in url_filters.judge(df, [], [], default="block").collect()} == {"block"}


def test_cascade_is_exact_on_its_universe():
    rng = random.Random(9)
    universe = [f"k{i}" for i in range(20_000)]
    for n in (0, 1, 500, 12_000):
        listed = rng.sample(universe, n)
        first = url_filters.first_level(listed, len(universe))
        own = set(listed)
        made = url_filters.finish(first, listed, [k for k, yes in zip(universe, first.has(universe)) if yes and k not in own])
        assert [k for k, yes in zip(universe, made.has(universe)) if yes] == [k for k in universe if k in own]


def test_simhash(spark, messy, empty):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in messy.collect()]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                    root[b] = root[a] = min(root[a], root[b])
    least = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    found = simhash.near_duplicates(messy).collect()
    assert Counter(map(tuple, found)) == Counter((d, f"{h:016x}", least[root[k]]) for k, (d, h) in enumerate(rows))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == len(set(root))
    assert {r.doc_id for r in kept.collect()} == {least[k] for k in set(root)}


def test_links_are_complete_for_any_partitions(spark, monkeypatch):
    """Clusters of near fingerprints, a hot one among them, with blocks of a few rows."""
    importable(spark)
    rng = random.Random(11)
    prints = {0, (1 << 64) - 1}
    for size in [150] + [3] * 60:
        at = rng.getrandbits(64)
        for _ in range(size):
            prints.add(at)
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | (1 << rng.randrange(64) if rng.random() < 0.3 else 0)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    expected = Counter(find(i) for i in range(len(prints)))
    df = stage(spark.createDataFrame([(s,) for s in signed], "fp long"), "prints")
    split = runs.split_hot
    for m, block in ((2, 4096), (3, 16), (4, 8)):
        monkeypatch.setattr(simhash, "partition_count", lambda n, d, m=m: m)
        monkeypatch.setattr(simhash, "split_hot", lambda rows, item, block=block: split(rows, item, block))
        found = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
        sizes = Counter(found.get(s, s) for s in signed)
        assert sorted(sizes.values()) == sorted(expected.values())


def test_thresholds():
    rng = np.random.default_rng(1)
    costs = [np.sort(rng.random((50, 5)), axis=1) for _ in range(4)]
    made = simhash.allocate(costs, 0)
    assert (made.sum(axis=1) == 0).all() and made.min() >= -1
    for r in range(50):
        best = min(sum(costs[i][r, t + 1] for i, t in enumerate(ts)) for ts in np.ndindex(5, 5, 5, 5) if sum(ts) == 4 for ts in [np.array(ts) - 1])
        assert sum(costs[i][r, made[r, i] + 1] for i in range(4)) == pytest.approx(best)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: find(i) for i in root if sum(i in p for p in pairs if p[0] != p[1])}


def test_quality(spark, messy, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (6, 5), (None, 1), (8, 1), (8, 1)], "doc_id long, quality int")
    found = quality.classify(messy, labels).collect()
    assert len(found) == messy.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(messy, labels.where("false")).collect()} == {0.5}
    kept = quality.keep_good(messy, labels, threshold=0.0)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.isotonic(np.array([0.0, 0.6, 0.4, 1.0, 0.9]), np.ones(5)).tolist() == pytest.approx([0, 0.5, 0.5, 0.95, 0.95])


def test_stages_on_messy_rows(spark, sf, messy):
    import corpus_pipeline
    docs = messy
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.where("false")):
            out = step(spark, given, sf)
            assert k == 3 or out.columns == docs.columns
        docs = stage(step(spark, docs, sf), f"messy-{k}") if k else docs  # the texts here are no prose
    assert docs.count() > 0


def test_url_filter_takes_hosts_of_any_length(spark):
    """A host of 100,000 labels has as many keys as the longest rule allows."""
    long = "a." * 100_000
    assert len(url_filters.keys_of(long + "example.net", "/en/x", [1, 4], len("example.net"))) == 4
    rows = [(1, f"http://{long}example.net/en/"), (2, f"http://{long}net/x"), (3, "http://" + "." * 50_000), (4, f"http://{long}com/")]
    df = entries.importable(spark).createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(df, [("net", "/")], [("example.net", "/en/")]).collect()}
    assert found == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_url_filter_of_many_rules(spark):
    """Rules by the hundred thousand: filters travel to the tasks, the lists do not."""
    block = [(f"h{i}.net", "/") for i in range(100_000)]
    df = entries.importable(spark).range(3000).selectExpr("id AS page_id", "concat('http://www.h', id * 67, '.net/x') AS url")
    found = {r.page_id: r.verdict for r in url_filters.judge(df, block, [("org", "/")]).collect()}
    assert found == {i: "block" if i * 67 < 100_000 else "allow" for i in range(3000)}


def test_neighbours_of_unequal_length_take_no_part(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(20)] + [(100, [1.0, 2.0]), (150, [1.0] * 7), (200, [])]
    df = entries.importable(spark).createDataFrame([(*r, "k", 1, 2) for r in rows], "vec_id long, embedding array<double>, key string, cell int, query int")
    found = neighbours.nearest(df, df.where("vec_id % 50 = 0"), neighbours.Hashing(3)).collect()
    assert {r.query_id for r in found} == {0} and {r.vec_id for r in found} <= set(range(1, 20)) and len(found) == 5
