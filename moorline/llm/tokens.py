"""Encoding whole texts by the tokenizers library with a cache of chunks.

Neither vocabulary merges across white space, so a text's ids are the ids of its chunks in a row. Frequent chunks
are encoded once in a worker. A chunk that is one word of Latin letters, perhaps with a mark behind it, is two
pre-tokens, which the library's model encodes without the other steps; the whole library encodes all else.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Chunks kept in each of the two generations of a worker's cache, and the longest that is kept.
CACHE = 300_000
LONGEST = 48
#: White space on which the two vocabularies may not be cut as below; a text with any of it goes to the library whole.
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_SPACE = _ODD_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
_CHUNKS = re.compile("[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]?[^ \n\t\r]+")
_WORD = re.compile("(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@[-`{-~]{0,3})")


def _visible_bytes() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_VISIBLE = _visible_bytes()


def _known(file: dict) -> bool:
    """Whether a vocabulary file's steps are those that the cuts below are right for; other files' texts go to the library whole."""
    normalizer, cutter = file["normalizer"], file["pre_tokenizer"] or {}
    exact = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
    if file["model"]["type"] != "BPE" or file["post_processor"] is not None or not exact:
        return False
    if normalizer is None:
        return cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter["use_regex"]
    steps = [n["type"] for n in normalizer.get("normalizers", [])]
    cuts = cutter.get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"]


class Encoder:
    """ids(text) gives the text's ids as little-endian unsigned 32-bit integers; a null text counts as empty, without ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # As the library does by default, special tokens' strings in a text are those tokens; such texts go to it whole.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = _known(json.loads(self.library.to_str()))
        self.model = self.library.model
        self.normalizer = self.library.normalizer
        self.spaced = self.normalizer is None  # else white space is dropped
        self.young: dict[str, bytes] = self._start()
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self.normalizer is not None:
            word = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
        visible = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)
        return array("I", [t.id for t in self.model.tokenize(visible)]).tobytes()

    def _find(self, chunk: str) -> bytes:
        """chunk: as it stands in a text, with the one white-space character before it if the vocabulary keeps that."""
        m = _WORD.fullmatch(chunk)
        if m is None:
            return self._encode(chunk)
        line, word, mark = m.groups()
        out = self.words.get(word) or self.old_words.get(word)
        if out is None:
            out = self._word(word)
        self.words[word] = out
        for sign in (line, mark):
            if sign and sign not in self.signs:
                self.signs[sign] = self._encode(sign)
        return self.signs[line] + out + self.signs[mark]

    def _join(self, chunks: list[str], lead: str) -> bytes:
        """lead: what stands before each chunk that doesn't begin with a line end."""
        young, old = self.young, self.old
        long = []
        for c in set(chunks).difference(young):
            found = old.get(c)
            if found is None:
                found = self._find(c if c[:1] == "\n" else lead + c)
            young[c] = found
            if len(c) > LONGEST:
                long.append(c)
        out = b"".join(map(young.__getitem__, chunks))
        for c in long:
            del young[c]
            self.words.pop(c, None)
        if len(young) > CACHE:
            self.old, self.young = young, self._start()
        if len(self.words) > CACHE // 2:
            self.old_words, self.words = self.words, {}
        return out

    def _start(self) -> dict[str, bytes]:
        return {} if self.spaced else {"": b""}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or any(t in text for t in self.special):
            return self._encode(text)
        for c in _ODD_ASCII if text.isascii() else _ODD_SPACE:
            if c in text:
                return self._encode(text)
        if not self.spaced:
            return self._join(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), "")
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS):
            return b"".join([self._find(c) for c in _CHUNKS.findall(text)])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._find(first) + self._join(rest, " ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        give_back()
    return _encoders[path]


def release() -> None:
    """Frees this process's encoders and their caches: workers outlive a stage, and the next one needs the memory."""
    _encoders.clear()
    give_back()


def give_back() -> None:
    """Returns what this process has freed to the system, which the allocators of Arrow and C keep otherwise.

    An executor has more workers than cores once a stage has run two in a task. They take turns and outlive their
    tasks, so what each of them keeps adds up beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # not every C library has it
        trim(0)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
