"""Exact token ids and counts of whole texts at the cost of their distinct words.

Both tokenizers cut a text at its blanks: no piece or merge reaches across one. A task therefore
encodes each distinct word once, with the library, and puts texts together from what it holds. The
memo is emptied when it is full; that costs time, never results.
"""

from __future__ import annotations

import re
from functools import lru_cache


class PieceCounts(dict):
    """Words to their number of pieces in a sentencepiece model that marks blanks and adds one in front."""

    def __init__(self, processor, limit: int = 600_000, longest: int = 64):
        super().__init__()
        self.processor, self.limit, self.longest = processor, limit, longest
        # one trailing blank: the library gives nothing for the empty text, so count it behind a letter
        self.tail = len(processor.encode("a ")) - len(processor.encode("a"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace("▁", " ").split(" ")
        if "" in words:
            words, blanks, parts = [], 0, words
            for word in parts:
                if word:
                    words.append(" " * blanks + word)
                blanks = 0 if word else blanks + 1
            extra = self.tail if blanks == 1 else len(self.processor.encode(" " * (blanks - 1))) if blanks else 0
        else:
            extra = 0
        if len(self) > self.limit:
            self.clear()
        if new := [w for w in set(words) if w not in self]:
            for w, ids in zip(new, self.processor.encode(new, num_threads=1), strict=True):
                self[w] = len(ids)
        total = extra + sum(map(self.__getitem__, words))
        for w in new:
            if len(w) > self.longest:
                del self[w]
        return total


def _byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies use for each byte: its own character where that is
    visible, else the next character from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class WordIds(dict):
    """Words to their ids, as little-endian bytes, in a byte-level word BPE of the tokenizers library.

    Where all of a word's characters lie below U+0250 (and it is free of controls and of the marks of
    special tokens), it is cut with the model's own pattern here and only distinct parts go to the
    library's BPE; every other word is encoded by the library as it stands.
    """

    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ɏ]+")  # all but <, with which special tokens begin

    def __init__(self, tokenizer, width: int = 2, limit: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.tokenizer, self.width, self.limit, self.longest = tokenizer, width, limit, longest
        self.model, self.symbols, self.parts = tokenizer.model, _byte_symbols(), {}
        if any(t.content[:1] != "<" for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens must begin with <")

    def _pack(self, ids) -> bytes:
        return b"".join(i.to_bytes(self.width, "little") for i in ids)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > self.limit:
                self.parts.clear()
            tokens = self.model.tokenize(part if part.isascii() else "".join([self.symbols[b] for b in part.encode()]))
            found = self.parts[part] = self._pack([t.id for t in tokens])
        return found

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if len(word) <= self.longest and word.isascii():
            if word.isalpha():
                found = self[word] = self._part(word.lower())
                return found
            if word[-1] in ".," and word[:-1].isalpha():
                found = self[word] = self._part(word[:-1].lower()) + self._part(word[-1])
                return found
        if len(word) <= self.longest and self.PLAIN.fullmatch(word):
            normal = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
            if self.PLAIN.fullmatch(normal):
                found = self[word] = b"".join(map(self._part, self.PART.findall(normal)))
                return found
        found = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= self.longest:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str, end_id: int) -> WordIds:
    """The memo of a tokenizer's file, kept for the later tasks of the same worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordIds(tokenizer, 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
