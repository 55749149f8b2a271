"""Token ids of whole texts with a public tokenizer file.

A tokenizer that cuts texts at white space before it merges gives the same ids
for a text as for its chunks one by one, so every distinct chunk is encoded once
in a worker and looked up afterwards.  For the pre-tokenizers of the two public
files, texts of ASCII and Latin-1 letters are cut into the words that the
tokenizer's model merges, and every distinct word goes to the model once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from ._common import kept

#: Unicode White_Space, which the tokenizers' patterns mean by ``\\s``.
_SPACE = "\t-\r \x85\xa0  -     　"
_WITH_SPACE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_NO_SPACE = re.compile(f"[^{_SPACE}]+")
#: Chunks of a generation; a worker remembers two, and what a generation does not meet again goes with it.
MAX_CHUNKS = 300_000
#: Texts of characters whose class is plain and which no normalizer changes but for white space and lower case.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]+")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"


def _byte_chars() -> dict[int, str]:
    """What the ByteLevel step makes of a code point up to 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(256)}


def _words_of(kind: dict) -> tuple[re.Pattern[str], bool] | None:
    """The cut of plain texts into words that equals the file's pre-tokenizer, and whether it is of lower case; None for other files."""
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
    if not kind["normalizer"] and kind["pre_tokenizer"] == level | {"use_regex": True}:
        return re.compile(f" ?[{_L}]+|{_SHORT}| ?[0-9]+| ?[^\t-\r {_L}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"), False
    lower = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    if kind["normalizer"] == {"type": "Sequence", "normalizers": lower} and \
            kind["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level | {"use_regex": False}]}:
        return re.compile(f"[{_L}]+|{_SHORT}|[0-9]|[^\t-\r {_L}0-9]+"), True
    return None


class _Words(dict):
    """Word -> packed ids by the tokenizer's model, of two generations."""

    def __init__(self, model, dtype: np.dtype):
        super().__init__()
        self.tokenize, self.dtype, self.chars = model.tokenize, dtype, _byte_chars()
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_CHUNKS:
            self.before = dict(self)
            self.clear()
        packed = self.before.get(word)
        if packed is None:
            packed = np.array([t.id for t in self.tokenize(word.translate(self.chars))], self.dtype).tobytes()
        self[word] = packed
        return packed


class Encoder:
    """Ids of texts as packed little-endian integers of ``dtype`` (no special tokens are added or recognised)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        # with a normalizer that folds white space the chunks are the words, else words with the space before them
        self.chunk = _NO_SPACE if kind.get("normalizer") else _WITH_SPACE
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.cut, self.lower = _words_of(kind) or (None, False)
        self.words = _Words(self.tok.model, self.dtype)

    def encode(self, texts: Iterable[str | None], group_chars: int = 2_000_000) -> Iterator[bytes]:
        """The packed ids of each text, in order; null is empty."""
        group: list[list[str] | bytes] = []
        size = 0
        for t in texts:
            if t and self.cut and _PLAIN.fullmatch(t):
                group.append(b"".join(map(self.words.__getitem__, self.cut.findall(t.lower() if self.lower else t))))
            else:
                group.append(self.chunk.findall(t) if t else [])
            size += len(t or "")
            if size >= group_chars:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str] | bytes]) -> Iterator[bytes]:
        if len(self.known) > MAX_CHUNKS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        missing = []
        for c in set().union(*[x for x in group if isinstance(x, list)]).difference(known):
            packed = before.get(c)
            if packed is None:
                missing.append(c)
            else:
                known[c] = packed
        for at in range(0, len(missing), 20_000):
            part = missing[at:at + 20_000]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                known[c] = np.array(e.ids, self.dtype).tobytes()
        for chunks in group:
            yield chunks if isinstance(chunks, bytes) else b"".join(map(known.__getitem__, chunks))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return kept(f"tokens {path}", lambda: Encoder(path))
