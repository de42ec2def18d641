"""Exact token ids of the ``tokenizers`` library with a cache of blank-delimited chunks.

Both supported layouts split a text before any merge, and a split always falls between a non-blank
and a following blank.  The ids of a text are therefore the ids of its chunks in order, and each
distinct chunk is given to the library once per worker.  Other layouts, and texts that hold the
string of an added token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from .runtime import trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points with the White_Space property, as the tokenizers' own patterns see them.
_WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LEADING = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_WORDS = re.compile(f"[^{_WS}]+")
#: Anything but single blanks and line feeds between words; then the text is cut by a pattern.
_UNEVEN = re.compile("[ \n][ \n]|[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_ODD = re.compile("[\x1c-\x1f]")
#: Bytes (estimated) of one generation of a cache; two generations are kept.  Longer chunks are never kept.
_MAX_BYTES, _LONGEST_KEY = 80_000_000, 256
#: Marks that both patterns keep together in one piece when they end a chunk of letters.
_MARKS = ".,;:!?#$%&*()+-/<=>@^_|~"
#: Below this code point Unicode's tables have long been settled, and no character changes under NFC.
_SETTLED = "\u0250"

#: The patterns of the two vocabularies' pre-tokenizers (public, see the JSON files).
_BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_open: dict[str, "ChunkEncoder"] = {}


def _byte_alphabet() -> dict[int, str]:
    """The public byte-to-character table of byte-level BPE, keyed by latin-1 code points."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class ChunkEncoder:
    """``encode(texts)`` gives, per text, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        self.layout, self.split = "", None
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.layout, self.split = "byte", regex.compile(_BYTE_PATTERN).findall
        elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            first = (pre.get("pretokenizers") or [{}])[0]
            if first.get("behavior") == "Removed" and first.get("pattern", {}).get("Regex") == _WORD_PATTERN:
                self.layout, self.split = "word", regex.compile(_WORD_PATTERN).findall
        self.alphabet = _byte_alphabet()
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str]:
        """Keys of the cache.  A leading NUL marks a chunk as it stands; without one, a blank stands before it (byte layout)."""
        if self.layout == "word":
            return text.split() if _ODD.search(text) is None else _WORDS.findall(text)
        if _UNEVEN.search(text) or "\x00" in text:
            return ["\x00" + c for c in _LEADING.findall(text)]
        found = text.replace("\n", " \n").split(" ")
        found[0] = "\x00" + found[0]
        return found

    def _known(self, key: str) -> bytes:
        ids = self.cache.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                ids = self._make(key)
            if len(key) <= _LONGEST_KEY:
                self.cache[key] = ids
                self.held += len(key) + len(ids) + 150
        return ids

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece of the pre-tokenizer, before which nothing is added."""
        spelt = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _make(self, key: str) -> bytes:
        word = self.layout == "word"
        text = key if word else key[1:] if key[:1] == "\x00" else key if key[:1] == "\n" else " " + key
        if not text:
            return b""
        if not text.isascii() and max(text) >= _SETTLED:
            return self._ids([text])[0]  # scripts for which two libraries' Unicode tables may differ
        if word:
            text = text.lower()
        bare = text[1:] if text[0] == " " else text
        if bare.isalpha():
            return self._piece(text)
        # Letters with marks behind them, the usual case, need no pattern.
        tail = len(bare.rstrip(_MARKS))
        if tail and bare[:tail].isalpha():
            end = bare[tail:]
            return self._body(text[: len(text) - len(end)]) + self._known(end if word else "\x00" + end)
        if _ODD.search(text):
            return self._ids([text])[0]
        pieces = self.split(text)
        if len(pieces) == 1:
            return self._piece(text)
        return b"".join([self._body(p) for p in pieces])

    def _body(self, piece: str) -> bytes:
        """A piece by its key: each piece of the patterns is also cut as itself."""
        if self.layout == "word":
            return self._known(piece)
        return self._known(piece[1:] if piece[0] == " " and len(piece) > 1 and piece[1] not in "\n\x00" else "\x00" + piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if not self.layout or any(a in t for a in self.added):
                out[i] = self._ids([t])[0]
                continue
            if self.held > _MAX_BYTES:
                self.older, self.cache, self.held = self.cache, {}, 0
            if self.layout == "word" and (t.isascii() or max(t) < _SETTLED):
                t = t.lower()
            chunks, cache = self._chunks(t), self.cache
            try:
                out[i] = b"".join(map(cache.__getitem__, chunks))
            except KeyError:
                long = {}
                for c in chunks:
                    if c not in cache:
                        if len(c) > _LONGEST_KEY:
                            long[c] = self._make(c)
                            continue
                        ids = self.older.get(c)
                        cache[c] = ids = self._make(c) if ids is None else ids
                        self.held += len(c) + len(ids) + 150
                out[i] = b"".join([long[c] if c in long else cache[c] for c in chunks] if long else map(cache.__getitem__, chunks))
        return out  # type: ignore[return-value]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file; loaded once per Python process."""
    if path not in _open:
        _open.clear()
        _open[path] = ChunkEncoder(path)
    return _open[path]


def settle() -> None:
    """At the end of a task: of the worker's caches only the current generation stays."""
    for enc in _open.values():
        enc.older = {}
    trim()


def encode_in_blocks(texts: Iterable[str | None], path: str, block_chars: int = 2_000_000) -> Iterator[bytes]:
    """Yield the id bytes of each text (null: empty), a bounded number of characters at a time."""
    enc, block, size = encoder(path), [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= block_chars:
            yield from enc.encode(block)
            block, size = [], 0
    if block:
        yield from enc.encode(block)
