"""Document fingerprints that follow edit distance.

A shared random walk embeds a text: it writes the current character again and again and moves
to the next one when a random bit of (step, character) says so. After a few edits the walks of
two texts meet again with good odds, so a small edit distance becomes a small Hamming distance
(Chakraborty, Goldenberg and Koucky, "Streaming algorithms for embedding and computing edit
distance", 2016). A single walk may be unlucky and stay apart, so there are three, and the best
of them counts. The fingerprint keeps the embeddings at sampled steps, the same for all texts
of a level. The level is the text's length in powers of two; each text is sampled for its own
level and the next, so that texts within twice each other's length share one. Bands of
consecutive samples are keys for near texts (Zhang and Zhang, "EmbedJoin", 2017), which are
then verified.

Defined results: a null text counts as empty; equal texts have equal fingerprints, also empty
ones (likeness 1); texts whose levels differ by over one have likeness 0. Rows that repeat,
ids that repeat and null ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.runs import split_hot, whole_runs
from ledgerloom.session import stage

WALKS = 3
SAMPLES = 64        # steps sampled for a level and walk; each is one hexadecimal digit, 0 after the end
PERIOD = 1 << 13    # the walk's random bits repeat after so many steps
SEED = 20_240_601
TOP_LEVEL = 48
PAIRS = 1 << 13     # pairs compared at once
BUCKET = 1 << 15    # half as many fingerprints of a bucket as may meet in one run
FEW = 128           # of so few fingerprints in a bucket all pairs are compared
TEXTS = 1 << 14     # most texts that walk side by side
CHARACTERS = 1 << 24  # and their characters, but for a single longer text
PLACES = 1 << 20    # places of walks that are kept at once
ALONE = 12          # so few texts walk one by one
ROUNDS = 256        # most characters that all texts walk before samples are taken
PIECE = 1 << 16     # characters put into classes at once
BYTES = 1 + WALKS * SAMPLES  # of a code: the level, and two levels of samples, two samples a byte


def _jumps(walk: int) -> np.ndarray:
    """Steps until a walk leaves a character: by character class (256) and step."""
    bits = np.random.default_rng([SEED, walk]).random((256, PERIOD)) < 0.5
    bits[:, 0] = True  # so that every row has one
    out = np.zeros((256, PERIOD), np.int64)
    gap = np.zeros(256, np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):
        gap = np.where(bits[:, step % PERIOD], 1, gap + 1)
        out[:, step % PERIOD] = gap
    return out.astype(np.int32)


_state: dict[str, object] = {}


def _table() -> tuple[np.ndarray, list[bytes]]:
    """Where a walk goes, by walk, class and step of the period, as one flat array of its own places; and its jumps."""
    if "to" not in _state:
        jumps = np.stack([_jumps(w) for w in range(WALKS)])
        assert ROUNDS * int(jumps.max()) < PERIOD
        rows = np.arange(WALKS * 256).reshape(WALKS, 256, 1) * PERIOD
        _state["to"] = (rows + ((np.arange(PERIOD) + jumps) & (PERIOD - 1))).ravel()
        _state["jumps"] = [row.tobytes() for row in jumps.astype(np.uint8).reshape(-1, PERIOD)]
    return _state["to"], _state["jumps"]


def sampled_steps(level: int) -> np.ndarray:
    """The sampled steps of a level, ascending; even over the 3 x 2^level steps a walk may take."""
    known = _state.setdefault("sampled", {})
    if level not in known:
        known[level] = np.sort((np.random.default_rng([SEED, level]).random(SAMPLES) * 3 * 2.0 ** level).astype(np.int64))
    return known[level]


def level_of(n: int) -> int:
    return max(0, (n - 1).bit_length()) if n else 0


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, one text after the other, and the class of each that steers the walk."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.empty(len(codes), np.uint8)
    for at in range(0, len(codes), PIECE):
        classes[at:at + PIECE] = (codes[at:at + PIECE] * np.uint32(2_654_435_761)) >> np.uint32(24)
    return codes, classes


def _walked(texts: list[str]) -> np.ndarray:
    """Codes of whole texts that walk side by side: a byte for the level, then samples by level, walk and step, two a byte.

    The longest texts come first, so those that still walk are the first ones. For some
    characters at a time, fewer than a walk needs for a whole period, the places that walks
    reach are kept; then the characters at the sampled steps among them are looked up.
    """
    to, jumps = _table()
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    codes, classes = _coded(texts)
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    levels = np.array([level_of(x) for x in sizes.tolist()], np.int64)
    top = int(levels.max(initial=0)) + 1
    # The sampled steps of all levels, and after them one that no walk reaches.
    sampled = np.concatenate([np.append(sampled_steps(k), 1 << 62) for k in range(top + 1)])
    out = np.zeros((n, 2, WALKS, SAMPLES), np.uint8)
    # The next sample of a walk, as a place in ``sampled`` and its step, by own and next level, walk and text.
    mine = np.broadcast_to((levels + np.array([[0], [1]]))[:, None] * (SAMPLES + 1), (2, WALKS, n))
    taken = mine.copy()
    due = sampled[taken]
    at = np.zeros((WALKS, n), np.int64)
    begin, last = 0, PERIOD - 1
    while n and begin < sizes[0]:
        live = n - int(np.searchsorted(sizes[::-1], begin, side="right"))
        lanes = live * WALKS
        # A power of two; texts that end before go on over what follows them, unread.
        rounds = min(ROUNDS, 1 << max(PLACES // lanes, 16).bit_length() - 1, 1 << (int(sizes[0]) - begin - 1).bit_length())
        start = at[:, :live].flatten()
        cells = classes.take(first[:live] + np.arange(begin, begin + rounds)[:, None], mode="clip")
        if live <= ALONE:
            places = np.empty((rounds, lanes), np.int64)
            for lane, step in enumerate((start & last).tolist()):
                walk, text = divmod(lane, live)
                rows, ends = jumps[walk * 256:walk * 256 + 256], []
                for c in cells[:, text].tolist():
                    step += rows[c][step & last]
                    ends.append(step)
                places[:, lane] = ends
        else:
            cells = cells.astype(np.int32) * PERIOD
            places, change = np.empty((2, rounds, WALKS, live), np.int64)
            change[:-1] = np.diff(cells, axis=0)[:, None]
            here = ((start & last).reshape(WALKS, live) + cells[0] + np.arange(WALKS)[:, None] * (256 * PERIOD)).ravel()
            for reached, more in zip(places.reshape(rounds, lanes), change.reshape(rounds, lanes)):
                to.take(here, None, reached, "clip")
                np.add(reached, more, here)
        places = places.ravel()
        own = np.minimum(sizes[:live] - begin, rounds)
        ends = places.take(np.tile(own - 1, WALKS) * lanes + np.arange(lanes))
        at[:, :live] = (start + ((ends - start) & last)).reshape(WALKS, live)
        level, walk, text = np.nonzero(due[:, :, :live] < at[:, :live])
        begin += rounds
        if not len(text):
            continue
        # The samples up to where a walk is now, found by halving; then the character of each, too.
        low = held = taken[level, walk, text]
        high, reached = mine[level, walk, text] + SAMPLES, at[walk, text]
        while (low < high).any():
            middle = (low + high) >> 1
            below = sampled.take(middle) < reached
            low, high = np.where(below, middle + 1, low), np.where(below, high, middle)
        taken[level, walk, text], due[level, walk, text] = low, sampled.take(low)
        many = low - held
        sample = np.arange(many.sum()) + np.repeat(held - (np.cumsum(many) - many), many)
        lane, target = np.repeat([walk * live + text, ((text * 2 + level) * WALKS + walk) * SAMPLES - mine[level, walk, text]], many, axis=1)
        text = lane % live
        begun = start.take(lane)
        wanted = sampled.take(sample) - begun
        place, half = lane, rounds >> 1
        while half:
            left = ((places.take(place + (half - 1) * lanes) - begun) & last) <= wanted
            place = place + left * (half * lanes)
            half >>= 1
        # Neighbours in the alphabet get different digits.
        out.ravel()[target + sample] = codes.take(first.take(text) + (begin - rounds) + place // lanes) % 15 + 1
    made = np.empty((n, BYTES), np.uint8)
    made[order, 0] = levels
    made[order, 1:] = (out[..., ::2] << 4 | out[..., 1::2]).reshape(n, BYTES - 1)
    return made


def codes_of(texts: list[str | None]) -> np.ndarray:
    """Codes of whole texts, a row each; as many texts at a time as may walk together."""
    made, some, held = [], [], 0
    for text in texts:
        text = text or ""
        if len(some) == TEXTS or some and held + len(text) > CHARACTERS:
            made.append(_walked(some))
            some, held = [], 0
        some.append(text)
        held += len(text)
    return np.concatenate([*made, _walked(some)])


def _written(codes: np.ndarray) -> list[str]:
    """Codes as text, in hexadecimal digits."""
    text = codes.tobytes().hex()
    return [text[at:at + 2 * BYTES] for at in range(0, len(text), 2 * BYTES)]


def fingerprints(texts: list[str | None]) -> list[str]:
    """Fingerprints of whole texts."""
    return _written(codes_of(texts))


def likeness(a: str, b: str) -> float:
    """Share of agreeing samples among those that are in either text, on the levels both have, by the best walk."""
    if a == b:
        return 1.0
    la, lb = int(a[:2], 16), int(b[:2], 16)
    if abs(la - lb) > 1:
        return 0.0
    u, v = (np.frombuffer(x[2:].encode(), np.uint8).reshape(2, WALKS, SAMPLES) for x in (a, b))
    if la != lb:
        u, v = (u[1:], v[:1]) if la < lb else (u[:1], v[1:])
    either = (u != 48) | (v != 48)
    present = either.sum(axis=(0, 2))
    return float((((u == v) & either).sum(axis=(0, 2)) / np.maximum(present, 1)).max())


# -- each document, its edited text and the next document ----------------------------------

def with_next(df: DataFrame, id_col: str, text: str, partitions: int) -> DataFrame:
    """(_bucket, _head, _key, id, text): rows dealt out by ascending id, and each bucket's follower.

    Cut points are quantiles of the ids, as many as there are partitions; the first rows of a
    bucket come once more, marked as head, at the end of the bucket before. So every bucket
    holds, in order, its rows and one row after each. Texts are read and moved once, to a task
    for each bucket.
    """
    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    keyed = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"),
                      F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    marks = [i / partitions for i in range(1, partitions)]
    cuts = keyed.select(F.col("_key").cast("double").alias("k")).approxQuantile("k", marks, 1 / (4 * partitions)) if marks else []
    bounds = np.array(sorted({int(c) for c in cuts}), dtype=np.int64)
    firsts = sorted(keyed.select("_key").groupBy(bucket("_key").alias("b")).agg(F.min("_key")).collect())  # a row per bucket
    spark = df.sparkSession
    heads = [(firsts[(i + 1) % len(firsts)][1], firsts[i][0]) for i in range(len(firsts))]
    rows = keyed.withColumn("_bucket", bucket("_key"))
    if heads:
        place = F.array(F.struct(F.col("_bucket"), F.lit(False).alias("_head")))
        again = F.array(F.struct(F.col("_before").alias("_bucket"), F.lit(True).alias("_head")))
        rows = rows.join(F.broadcast(spark.createDataFrame(heads, "_key long, _before int")), "_key", "left").select(
            F.inline(F.when(F.col("_before").isNull(), place).otherwise(F.concat(place, again))), "_key", "_id", "_text")
    else:
        rows = rows.withColumn("_head", F.lit(False))
    return rows.repartitionById(partitions, "_bucket").sortWithinPartitions("_bucket", "_head", "_key", "_text")


def edited_text(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by the first as many characters of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text: see the columns below."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        # The next document of a row is the following row, but at the end of a bucket.
        after, more = np.arange(1, n + 1), []
        for i, row in enumerate(rows):
            if i + 1 == n or rows[i + 1][1] is not row[3]:
                after[i] = 2 * n + len(more)
                more.append(row[3])
        codes = codes_of([r[1] for r in rows] + [r[2] for r in rows] + more)
        like, own = _likeness_in(codes), np.arange(n)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() for r in rows]),
            pa.array(_written(codes[:n])), pa.array(_written(codes[n:2 * n])),
            pa.array(like(own, own + n)), pa.array(like(own, after)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def task(batches: Iterator[pa.RecordBatch]):
        held, last, chars, headed = [], None, 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cols = batch.slice(at, 500).to_pydict()
                for b, head, key, value in zip(cols["_bucket"], cols["_head"], cols["_id"], cols["_text"]):
                    if last is not None and last[0] == b:
                        held.append((last[1], last[2], edited_text(last[2], value), value))
                        chars += 2 * len(last[2])
                    last = None if head else (b, key, value)
                if (chars > CHARACTERS or 2 * len(held) > TEXTS) and held:
                    yield finished(held)
                    held, chars = [], 0
        if held:
            yield finished(held)

    return with_next(df, id_col, text, partitions).select("_bucket", "_head", "_id", "_text").mapInArrow(
        task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")


# -- near texts ----------------------------------------------------------------------------

def _settled(df: DataFrame, name: str) -> DataFrame:
    """``stage``, after which Spark deletes the shuffle files of the step: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stage(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _digits_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels, and samples by row, level, walk and step, of codes."""
    digits = np.stack([codes[:, 1:] >> 4, codes[:, 1:] & 15], axis=2)
    return codes[:, 0].astype(np.int64), digits.reshape(len(codes), 2, WALKS, SAMPLES)


def _likeness_to(levels: np.ndarray, digits: np.ndarray, ended: np.ndarray, i: int, rest: np.ndarray) -> np.ndarray:
    """``likeness`` of row i to each of the rows ``rest``; ``ended`` counts the zeros of every level and walk.

    Zeros follow the end of a walk only, so the samples in neither text are the fewer zeros of the two.
    """
    out = np.zeros(len(rest))
    for shift, u, v in ((0, slice(0, 2), slice(0, 2)), (1, slice(1, 2), slice(0, 1)), (-1, slice(0, 1), slice(1, 2))):
        some = np.flatnonzero(levels[rest] - levels[i] == shift)
        if not len(some):
            continue
        same = digits[rest[some], v] == digits[i, u]
        # Eight truth values are added at a time as one word; its bytes stay below 256.
        words = np.ascontiguousarray(same).view(np.uint64).sum(axis=(1, 3), dtype=np.uint64)
        same = ((words.view(np.uint8).reshape(*words.shape, 8)).sum(axis=2)).astype(np.int64)
        neither = np.minimum(ended[rest[some], v], ended[i, u]).sum(axis=1)
        present = (u.stop - u.start) * SAMPLES - neither
        out[some] = ((same - neither) / np.maximum(present, 1)).max(axis=1)
    return out


def _likeness_in(codes: np.ndarray) -> Callable[..., np.ndarray]:
    """``likeness`` of rows i to rows j of the codes, as a function of i, j and the walks that count."""
    levels, bodies = codes[:, 0].astype(np.int8), codes[:, 1:].reshape(len(codes), 2, WALKS, SAMPLES // 2)
    # Zeros follow the end of a walk only.
    filled = ((bodies >> 4 != 0).sum(axis=3) + (bodies & 15 != 0).sum(axis=3)).astype(np.int32)
    of = {(walk, level): (filled[:, level, walk].copy(), bodies[:, level, walk].copy().view(np.uint64))
          for walk in range(WALKS) for level in (0, 1)}
    ones, quarters = np.uint64(0x1111111111111111), np.uint32(0x01010101)

    def by(walk: int, i: np.ndarray, j: np.ndarray, u: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Samples in either text and those that agree, on level u of rows i and level v of rows j."""
        (ends, words), (ends_of_j, words_of_j) = of[walk, u], of[walk, v]
        words = words.take(i, axis=0) ^ words_of_j.take(j, axis=0)
        words |= words >> np.uint64(1)
        words |= words >> np.uint64(2)
        words &= ones  # a bit for each sample that differs
        # Counts of four words are added as one.
        differ = np.bitwise_count(words).view(np.uint32)[:, 0] * quarters >> np.uint32(24)
        present = np.maximum(ends.take(i), ends_of_j.take(j))
        return present, present - differ.astype(np.int32)

    def likenesses(i: np.ndarray, j: np.ndarray, walks: Sequence[int] = range(WALKS)) -> np.ndarray:
        out = np.zeros(len(i))
        for at in range(0, len(i), PAIRS):
            a, b, best = i[at:at + PAIRS], j[at:at + PAIRS], out[at:at + PAIRS]
            shift = levels.take(b) - levels.take(a)
            for apart in (0, 1, -1):
                some = np.flatnonzero(shift == apart)
                if not len(some):
                    continue
                x, y, found, equal = a.take(some), b.take(some), np.zeros(len(some)), np.full(len(some), len(walks) == WALKS)
                for walk in walks:
                    present, same = by(walk, x, y, int(apart == 1), int(apart == -1))
                    if not apart:
                        more, agree = by(walk, x, y, 1, 1)
                        present, same = present + more, same + agree
                    found = np.maximum(found, same / np.maximum(present, 1))
                    equal &= present == 0
                if not apart:
                    found[equal] = 1.0  # without a sample they are equal
                best[some] = found
        return out

    return likenesses


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put rows i and rows j into one component each; a label is the first row of its component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _apart(group: np.ndarray, item: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of items of a group, of different components at the start, some at a time."""
    own = label[item]
    order = np.lexsort((own, group))
    group, item, own = group[order], item[order], own[order]
    new = np.append(True, group[1:] != group[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(item))[np.cumsum(new) - 1]
    new[1:] |= own[1:] != own[:-1]
    after = np.append(np.flatnonzero(new)[1:], len(item))[np.cumsum(new) - 1]
    many = ends - after
    upto = np.cumsum(many)
    begin = 0
    while begin < len(item):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 64 * PAIRS, side="right")))
        some = many[begin:stop]
        place = np.arange(some.sum()) + np.repeat(after[begin:stop] - (np.cumsum(some) - some), some)
        yield np.repeat(item[begin:stop], some), item[place]
        begin = stop


def _certain(filled: np.ndarray, near: float, size: int) -> np.ndarray:
    """Rows that share a whole piece of ``size`` samples with every row that they are alike to in ``near``.

    Of two such rows some walk has ``same`` >= near * present samples, where present >= e, the
    samples of this row. With c of them in both rows, at most c - near * e of the c differ. Of the
    c, (c - levels * (size - 1)) / size whole pieces are common at least, and if c = e, those of
    this row. If that is more than the samples that differ, one piece is the same in both. The
    difference falls with c, so that c = e - 1 and c = e decide.
    """
    levels, most = filled.shape[1], filled.sum(axis=1)
    fewer = (most - 1 - levels * (size - 1)) / size > (1 - near) * most - 1 + 1e-6
    return (fewer & ((filled // size).sum(axis=1) > (1 - near) * most + 1e-6)).all(axis=1)


def _search(rows: np.ndarray, digits: np.ndarray, near: float, linked: Callable[..., None], label: np.ndarray) -> None:
    """Offer all pairs of rows to ``linked`` that may be alike in ``near`` and are not of one component yet.

    ``digits`` are samples by row, level, walk and step. Pairs that are alike agree in a whole
    piece of some samples of the walk that says so, and it alone is looked at; but for rows too
    short for that, which meet each other.
    """
    filled = (digits != 0).sum(axis=3)
    for size in (8, 6, 5, 4, 3, 2, 1):
        certain = _certain(filled, near, size)
        if 4 * certain.sum() >= 3 * len(rows) or size == 1:
            break
    rest = rows[~certain]
    for i, j in _apart(np.zeros(len(rest), np.int64), rest, label):
        linked(i, j)
    if not certain.any():
        return
    pieces = SAMPLES // size
    for level in range(digits.shape[1]):
        for walk in range(WALKS):
            item, piece = np.nonzero((np.arange(pieces) + 1) * size <= filled[:, level, walk, None])
            value = piece
            for k in range(size):
                value = value << 4 | digits[item, level, walk, piece * size + k]
            order = np.argsort(value, kind="stable")
            item, value = rows[item[order]], value[order]
            new = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            # First each with the first of its group, which joins most of many that are alike.
            linked(item[np.flatnonzero(new)][group], item, [walk])
            for i, j in _apart(group, item, label):
                linked(i, j, [walk])


def _near_classes(codes: np.ndarray, bounds: np.ndarray, near: float) -> np.ndarray:
    """For each row the first row of its component; rows of one bucket alike in ``near`` are linked.

    A bucket is the rows between two bounds. All pairs of small ones are compared at once.
    """
    label, like, sizes = np.arange(len(codes)), _likeness_in(codes), np.diff(bounds)

    def linked(i: np.ndarray, j: np.ndarray, walks: Sequence[int] = range(WALKS)) -> None:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        found = like(i, j, walks) >= near
        _joined(label, i[found], j[found])

    few = np.flatnonzero((sizes > 1) & (sizes <= FEW))
    item = np.repeat(bounds[few], sizes[few]) + np.arange(sizes[few].sum()) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
    for i, j in _apart(np.repeat(np.arange(len(few)), sizes[few]), item, label):
        linked(i, j)
    for at in np.flatnonzero(sizes > FEW):
        rows = np.arange(bounds[at], bounds[at + 1])
        levels, digits = _digits_of(codes[rows])
        for level in np.unique(levels):
            own, above = levels == level, levels == level + 1
            _search(rows[own], digits[own], near, linked, label)
            if above.any():
                both = np.concatenate([digits[own][:, 1:], digits[above][:, :1]])
                _search(np.concatenate([rows[own], rows[above]]), both, near, linked, label)
    return label


def _classes_of(marked: DataFrame, id_col: str, near: float, band: int) -> DataFrame:
    """(fingerprint, class_id), one row per fingerprint of the staged table ``marked``.

    Bands are first met as bare keys; a fingerprint is moved only to those that it shares with
    another one, as bytes.
    """
    partitions = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = marked.groupBy("fingerprint").agg(F.min(id_col).alias("_least"))
    nodes = _settled(least.select("fingerprint", "_least", F.xxhash64("fingerprint").alias("node")), "nodes")

    def bands(batches):
        size = WALKS * SAMPLES
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), np.uint8)
            levels, digits = _digits_of(codes.reshape(-1, BYTES))
            node = batch.column(1).to_numpy()
            for k in (0, 1):
                part = digits[:, k].reshape(-1, size)
                for at in range(0, size, band):
                    some = part[:, at:at + band]
                    key = (levels + k).astype(np.uint64) * np.uint64(size) + np.uint64(at)
                    for column in some.T:
                        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    kept = (levels == 0) | some.any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[kept]), pa.array(node[kept])], names=["key", "node"])

    def connect(batches):
        for columns, bounds in whole_runs(batches, ["key", "_part"]):
            codes = np.frombuffer(b"".join(columns["code"]), np.uint8).reshape(-1, BYTES)
            label = _near_classes(codes, bounds, near)
            of = np.flatnonzero(label != np.arange(len(label)))
            if len(of):
                node = columns["node"]
                yield pa.RecordBatch.from_arrays([pa.array(node[label[of]]), pa.array(node[of])], names=["a", "b"])

    banded = nodes.select("fingerprint", "node").mapInArrow(bands, "key long, node long")
    shared = _settled(banded.groupBy("key").count().where("count > 1").select("key"), "shared")
    met = _settled(banded.join(shared, "key", "left_semi"), "met")
    met = split_hot(met, "node", BUCKET).join(nodes.select("node", F.unhex("fingerprint").alias("code")), "node")
    dealt = met.select("key", "_part", "node", "code").repartition(partitions, "key", "_part").sortWithinPartitions("key", "_part")
    links = _settled(dealt.mapInArrow(connect, "a long, b long").distinct(), "linked")
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("_least").alias("class_id"))
    return _settled(rooted.join(named, "root").select("fingerprint", "class_id"), "classes")


def edit_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", near: float = 0.8, band: int = 8) -> DataFrame:
    """(id, fingerprint, class_id) for every row: classes of texts whose fingerprints agree in ``near`` or more.

    Candidates share ``band`` consecutive samples of a walk on a level; of two fingerprints of
    which one walk agrees in 0.9 of 64 samples, 99% share one of its 8 bands of 8, and most
    have three walks and two levels to meet on. Verified links leave a bucket as
    stars; buckets over the block size are split so that their members still meet.
    """
    @F.pandas_udf("string")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist()))

    marked = stage(df.select(F.col(id_col), compute(text).alias("fingerprint")), "edits")
    return marked.join(_classes_of(marked, id_col, near, band), "fingerprint").select(id_col, "fingerprint", "class_id")


def classed_fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", near: float = 0.8, band: int = 8) -> DataFrame:
    """The rows of ``edited_fingerprints`` with the ``class_id`` of ``edit_classes``; texts are walked once."""
    made = _settled(edited_fingerprints(df, id_col, text), "edited")
    return made.join(_classes_of(made, "doc_id", near, band), "fingerprint").select(*made.columns, "class_id")
