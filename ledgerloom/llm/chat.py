"""Chat formatting with loss masks aligned by offsets.

A whole conversation is rendered to one text, encoded once, and the sorted spans of the turns
in it are intersected with the sorted spans of its tokens by binary search: a token is in the
loss if its span lies in the text of an assistant turn. The template's control strings are
added to the tokenizer, so no token reaches across one.

Template: ``<|turn|>role<|says|>text<|done|>`` for each turn. Inside roles and texts every
``<``, any number of ``\\`` and ``|`` in a row gets one more ``\\`` before the bar, so a control
string can't occur there; taking one ``\\`` away again restores the text.

Defined results: a null text or role counts as empty. Turns are ordered by turn (nulls first),
role and text; turns that repeat are all kept. Rows with a null conversation id form one
conversation. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
CONTROL = [TURN, SAYS, DONE]
_ESCAPE, _RESTORE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(DONE), re.S)
_loaded: dict[str, object] = {}

FORMATTED = """conv_id long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>,
    loss_mask array<boolean>"""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the spans of the trained role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        lead, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == trained:
            spans.append((at + len(lead), at + len(lead) + len(body)))
        parts += [lead, body, DONE]
        at += len(lead) + len(body) + len(DONE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(restore(role), restore(text)) for role, text in _TURNS.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span; both lists are sorted, each token is looked up by binary search."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    first, last = np.array(spans, np.int64).T
    k = np.searchsorted(first, starts, side="right") - 1
    return (k >= 0) & (ends <= last[np.maximum(k, 0)]) & (starts < last[np.maximum(k, 0)])


def _tokenizer(path: str):
    if path not in _loaded:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer
        made = Tokenizer.from_file(path)
        made.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
        _loaded[path] = made
    return _loaded[path]


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations from sorted rows (conv_id, role, text)."""
    now, turns, any_row = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if any_row and conv != now:
                yield now, turns
                turns = []
            now, any_row = conv, True
            turns.append((role, text))
    if any_row:
        yield now, turns


def format_conversations(df: DataFrame, tokenizer: str, trained: str = "assistant") -> DataFrame:
    """One row per conversation: rendered text, token ids, their character spans and the loss mask.

    Rows are dealt out by conversation and sorted, and a task holds one conversation at a time.
    """
    def task(batches):
        rows, size = [], 0

        def made():
            found = _tokenizer(tokenizer).encode_batch([r[1] for r in rows], add_special_tokens=False)
            ids, starts, ends, masks, bounds = [], [], [], [], [0]
            for (_, _, spans), e in zip(rows, found):
                ids.append(np.array(e.ids, np.int32))
                offsets = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(ids[-1])).reshape(-1, 2)
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                masks.append(mask(starts[-1], ends[-1], spans))
                bounds.append(bounds[-1] + len(ids[-1]))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(c))) for c in (ids, starts, ends, masks)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), *lists],
                                              names=["conv_id", "formatted", "input_ids", "token_start", "token_end", "loss_mask"])

        for conv, turns in conversations_of(batches):
            rows.append((conv, *render(turns, trained)))
            size += len(rows[-1][1])
            if size > 1_000_000:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"))
    return (turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(task, FORMATTED))


def loss_text(formatted: str, starts: np.ndarray | list[int], ends: np.ndarray | list[int],
              in_loss: np.ndarray | list[bool]) -> str:
    """All characters under the loss mask, restored span by span.

    Tokens that share a character (its bytes) count it once. Neighbouring texts are apart by
    control strings, so a gap between masked characters ends a span.
    """
    inside = np.asarray(in_loss, bool)
    a, b = np.asarray(starts, np.int64)[inside], np.asarray(ends, np.int64)[inside]
    if not len(a):
        return ""
    reach = np.maximum.accumulate(b)
    gaps = np.flatnonzero(a[1:] > reach[:-1])
    begins, stops = a[np.append(0, gaps + 1)], reach[np.append(gaps, len(a) - 1)]
    return "".join(restore(formatted[i:j]) for i, j in zip(begins.tolist(), stops.tolist()))


def list_parts(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column as arrays, without an object for each value."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    bounds = column.offsets.to_numpy() - column.offsets[0].as_py()
    return (values[i:j] for i, j in zip(bounds[:-1], bounds[1:]))
