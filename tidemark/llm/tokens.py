"""Whole-text encoding with the ``tokenizers`` library, memoised per white-space chunk and per word.

The tokenizer drops white space before its merges run and none of its normalisers looks across
white space, so the ids of a text are the concatenated ids of its chunks; and a chunk is cut into words, single digits and
runs of marks, whose merges are independent too. Chunks and words repeat, so each distinct one is merged once per Python
worker; both memos are bounded and emptied when full. New words go straight to the library's merge model. Chunks with letters
beyond Latin, and texts with characters that Python and the tokenizer class differently as white space, are encoded
by the library in one piece.
"""

from __future__ import annotations

import re

import numpy as np

#: Entries kept in each memo, and the longest chunk that is kept.
MEMO_CHUNKS, MEMO_WORDS = 350_000, 350_000
MEMO_CHARS = 40
#: U+001C..U+001F are white space for ``str.split`` only.
_DISAGREE = re.compile("[\x1c-\x1f]")
#: Letters below this have no combining forms, and lower case that depends on the letter alone.
_LATIN_END = "\u0250"
#: Its lower case is two characters, one no letter.
_DOTTED = "\u0130"
#: The tokenizer's own cut of a chunk, after lower-casing.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END_MARKS = frozenset(".,;:!?")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """``encode(text)`` gives the ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cut = regex.compile(_CUT)
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", ()) if p["type"] == "Split"]
        #: Strings of added tokens are no ordinary text; and only the cut above may be done here.
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.direct = len(split) == 1 and split[0]["pattern"].get("Regex") == _CUT

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            stands = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
            got = np.array([t.id for t in self.tokenizer.model.tokenize(stands)], dtype="<u4").tobytes()
            if len(word) <= MEMO_CHARS:
                if len(self.words) >= MEMO_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        got = self.chunks.get(chunk)
        if got is not None:
            return got
        if not self.direct or not chunk.isascii() and (max(chunk) >= _LATIN_END or _DOTTED in chunk) or "<|" in chunk and any(t in chunk for t in self.special):
            got = self._library(chunk)
        elif chunk.isalpha():
            got = self._word(chunk.lower())
        elif chunk[-1] in _END_MARKS and chunk[:-1].isalpha():
            got = self._word(chunk[:-1].lower()) + self._word(chunk[-1])
        else:
            got = b"".join([self._word(w) for w in self.cut.findall(chunk.lower())])
        if len(chunk) <= MEMO_CHARS:
            if len(self.chunks) >= MEMO_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if _DISAGREE.search(text):
            return self._library(text)
        chunks = text.split()
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            return b"".join(map(self._chunk, chunks))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, so the memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drops the memos: Python workers are reused, and an operator that does not encode has no use for them."""
    _ENCODERS.clear()
