"""Whole texts to token ids with a public tokenizer file, inside tasks.

``word_bpe_49k.json`` never joins across ASCII white space: its normalizer and splitter work
within white-space-delimited chunks. So the ids of a text are the ids of its chunks, one after
the other, and each distinct chunk is encoded by the tokenizers library once and remembered.
Chunks of plain Latin letters, with closing stops or commas, skip the normalizer and go to the
library's BPE model directly: on them the normalizer only lower-cases and the splitter keeps
the letters as one piece and the stops as another. Everything else is encoded as it is, special
strings such as <|endoftext|> as the library does by default: they hold no white space.
"""

from __future__ import annotations

import os
import re
from array import array

REMEMBERED = 500_000      # chunks, and words, kept by a Python worker (about 200 MB) before it starts anew
LATIN = "\u0250"          # below this, letters are the same in every Unicode version and in normal form
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split, ordinary characters to the tokenizer

_encoders: dict[str, "ChunkEncoder"] = {}


def words_of(text: str) -> list[bytes]:
    """Maximal runs without the six ASCII white space characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class _ByteChars(dict):
    """Characters as the byte-level step of the library spells them."""

    def __init__(self):
        from tokenizers import pre_tokenizers
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, code: int) -> str:
        self[code] = out = self.spell(chr(code))[0][0]
        return out


class ChunkEncoder:
    """Token ids of texts as packed unsigned 32-bit little-endian integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = _ByteChars()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = array(
                "I", [t.id for t in self.model.tokenize(word.translate(self.chars))]).tobytes()
        return found

    def _learn(self, chunks: set[str]) -> None:
        rest = []
        for chunk in chunks:
            lower = chunk.lower()
            word = lower.rstrip(".,")
            if word.isalpha() and max(word) < LATIN:
                stops = lower[len(word):]
                self.chunks[chunk] = self._word(word) + self._word(stops) if stops else self._word(word)
            else:
                rest.append(chunk)
        for at in range(0, len(rest), 1000):
            some = rest[at:at + 1000]
            for chunk, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.chunks[chunk] = array("I", found.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null counts as empty."""
        out = []
        for text in texts:
            split = [] if not text else text.split() if not SEPARATORS.search(text) \
                else [c.decode("utf-8", "surrogatepass") for c in words_of(text)]
            try:
                out.append(b"".join(map(self.chunks.__getitem__, split)))
            except KeyError:
                if len(self.chunks) > REMEMBERED:
                    self.chunks = {}
                if len(self.words) > REMEMBERED:
                    self.words = {}
                self._learn(set(split).difference(self.chunks))
                out.append(b"".join(map(self.chunks.__getitem__, split)))
        return out


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a file; made once per worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def word_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
