"""Tokenizers by file: ``.json`` through the tokenizers library, ``.model`` through sentencepiece.

Texts are encoded without begin, end or other added tokens, truncation or padding.  ``space_free`` says that the
tokenizer lower-cases, drops white space, treats the words between ASCII white space on their own, and cuts between
a letter and a comma or full stop; it is then called once per new word instead of once per text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np

from weftline.llm.wordids import WordIds, group_sums

BLOCK_WORDS = 64  # words per text handed to the library
CALL_WORDS = 16_384  # words per call of the library

# A comma or full stop at the end of a word is a token of its own: the word then needs no second memo entry.
_POINT = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n])")
# Case folding comes before composition here, so texts with combining marks or special strings are left as they are.
_PLAIN = re.compile(rb"\xcc|\xcd|<\|")


@dataclass(frozen=True)
class Tokenizer:
    path: str
    space_free: bool = False

    def version(self) -> str:
        """Digest of the tokenizer file: counts of another version never match."""
        with open(self.path, "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest()


class _Json:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.openings = {t.content[:2] for t in self.library.get_added_tokens_decoder().values()}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that do not influence each other: joined by spaces, told apart by the offsets."""
        parts, sizes = [], np.zeros(len(words), np.int64)
        for at in range(0, len(words), CALL_WORDS):
            called = [w.decode("utf-8", "replace") for w in words[at : at + CALL_WORDS]]
            blocks = [called[i : i + BLOCK_WORDS] for i in range(0, len(called), BLOCK_WORDS)]
            encoded = self.library.encode_batch([" ".join(b) for b in blocks], add_special_tokens=False)
            for i, (block, found) in enumerate(zip(blocks, encoded, strict=True)):
                ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1)
                begins = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.offsets))
                first = at + i * BLOCK_WORDS
                sizes[first : first + len(block)] = np.bincount(
                    np.searchsorted(ends, begins, side="right"), minlength=len(block)
                )
                parts.append(np.array(found.ids, np.uint32))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), sizes


class _Piece:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, num_threads=1), np.uint32)


class Encoder:
    """Ids of texts, loaded once per Python worker."""

    def __init__(self, tokenizer: Tokenizer):
        self.library = (_Piece if tokenizer.path.endswith(".model") else _Json)(tokenizer.path)
        self.memo = WordIds(self.library.words) if tokenizer.space_free else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.memo is None:
            each = [self.library.ids(t) for t in texts]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        slots, counts = self._slots(texts)
        ids, sizes = self.memo.gather(slots)
        return ids, group_sums(sizes, counts)

    def count(self, texts: list[str]) -> np.ndarray:
        if self.memo is None:
            return np.array([len(self.library.ids(t)) for t in texts], np.int64)
        slots, counts = self._slots(texts)
        return group_sums(self.memo.sizes[slots], counts)

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self._words(t.encode("utf-8", "replace")) for t in texts]
        return self.memo.lookup([w for words in split for w in words]), np.array([len(w) for w in split], np.int64)

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        if not _PLAIN.search(text):
            text = _POINT.sub(rb" \g<0>", text.lower())
        return text.split()  # bytes split at ASCII white space only


_loaded: dict[Tokenizer, Encoder] = {}


def encoder(tokenizer: Tokenizer) -> Encoder:
    if tokenizer not in _loaded:
        _loaded[tokenizer] = Encoder(tokenizer)
    return _loaded[tokenizer]
