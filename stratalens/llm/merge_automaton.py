"""Byte-pair encoding and decoding with a deterministic automaton.

**Compilation.**  The automaton reads tokens.  At first it has the 256 byte arcs and every byte may follow
every other.  The merges are then worked in one after the other, each by a gadget: for the rule (u, v) -> w

* the state that u leads to is split, and its new copy has no arc v, so that u v can no longer be read,
* every state with an arc u gets an arc w,
* w leads to where v led before.

What a token leads to depends on that token alone, so states are numbered by tokens, and the copies are
kept copy-on-write: a token remembers whose arcs it took over and when (``came``), and a rule the arc that
it cut (``cut``).  ``follows`` reads an arc out of these copies.  After the last rule each word has exactly
one path, and its labels are the tokens of the word.

**Encoding.**  Each prefix of a word has one path as well, so the last label of that path is a function of
the prefix.  ``MergeAutomaton`` determinises over bytes: a state is the set of pairs (last token, bytes read
since), of which one pair is complete and gives the label.  Transitions are entered in a table when they are
met first; when the table is full it is emptied and filled anew, so that memory is bounded.  A word is read
once, forwards, by table, and its tokens are picked up backwards from the labels.

**Decoding** emits the byte labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship_package, trim
from .tokens import ChunkEncoder

#: States of the byte table of one worker; beyond, it is emptied.  Tokens below a trie node for which pairs are told apart.
_MAX_STATES, _FEW = 120_000, 20
#: Keys of a state besides the bytes.
_LABEL, _PAIRS = -1, -2


class MergeAutomaton:
    """``arcs``: the bytes of each token id; ``merges``: (left, right, made) token ids, in order of priority."""

    def __init__(self, arcs: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        self.arcs, self.size = arcs, {t: len(b) for t, b in arcs.items()}
        self.came: dict[int, tuple[int, int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.idle: set[int] = set()
        for u, v, w in merges:
            self._gadget(u, v, w)
        self.child: dict[int, int] = {}
        self.token, self.leaf = [-1], [True]
        made = set(self.came)
        for t, label in arcs.items():
            if t in made or len(label) == 1:
                self._spell(t, label)
        self.below: list[list[int] | None] = [[] for _ in self.token]
        for t, label in arcs.items():
            if t not in made and len(label) > 1:
                continue
            node = 0
            for b in label[:-1]:
                node = self.child[node << 8 | b]
                if (under := self.below[node]) is not None:
                    under.append(t)
                    if len(under) > _FEW:
                        self.below[node] = None
        self._empty()

    def _gadget(self, u: int, v: int, w: int) -> None:
        """A rule whose pair earlier rules never leave standing makes no arc, and its token is never met."""
        if w in self.came or w in self.idle or (u, v) in self.cut:
            raise ValueError("a token or a pair stands in two merges")
        if u in self.idle or v in self.idle or not self.follows(u, v):
            self.idle.add(w)
            return
        step = len(self.cut)
        self.cut[u, v] = step
        self.came[w] = (step, u, v)

    def _spell(self, token: int, label: bytes) -> None:
        node = 0
        for b in label:
            key = node << 8 | b
            if key not in self.child:
                self.child[key] = len(self.token)
                self.token.append(-1)
                self.leaf.append(True)
                self.leaf[node] = False
            node = self.child[key]
        self.token[node] = token

    def follows(self, a: int, b: int) -> bool:
        """Whether b may be read after a, with the merges that are worked in so far."""
        before = len(self.cut)
        while True:
            cut = self.cut.get((a, b))
            if cut is not None and cut < before:
                return False
            from_a, from_b = self.came.get(a), self.came.get(b)
            if from_a is None and from_b is None:
                return True
            if from_b is None or (from_a is not None and from_a[0] > from_b[0]):
                before, _, a = from_a  # a leads to where its right part led
            elif from_a is None or from_b[0] > from_a[0]:
                before, left, right = from_b  # b stands beside its left part, unless the rule cut that arc
                if a == left == right:
                    return False
                b = left
            else:  # a token after itself
                before, b, a = from_a

    def _empty(self) -> None:
        #: A state is a dict from bytes to states; it also holds its label and its set of pairs.
        self.states: dict[tuple[tuple[int, int], ...], dict] = {}
        self.alike: dict[tuple[int, int], int] = {}
        self.first: dict[tuple[int, ...], int] = {}
        self.start = self._enter(((-1, 0),), -1)

    def _enter(self, found: tuple[tuple[int, int], ...], label: int) -> dict:
        state = self.states.get(found)
        if state is None:
            state = self.states[found] = {_LABEL: label, _PAIRS: found}
        return state

    def _stand_in(self, last: int, node: int) -> int:
        """A token after which the same tokens below ``node`` may be read as after ``last``; -2: none may."""
        found = self.alike.get((last, node))
        if found is None:
            below = self.below[node]
            if below is None or last < 0:
                found = last
            else:
                may = [t for t in below if self.follows(last, t)]
                found = self.first.setdefault((node, *may), last) if may else -2
            self.alike[last, node] = found
        return found

    def _step(self, state: dict, byte: int) -> dict:
        found, label = [], -1
        for last, node in state[_PAIRS]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            t = self.token[to]
            if label < 0 <= t and (last < 0 or self.follows(last, t)):
                label = t
            if not self.leaf[to] and (same := self._stand_in(last, to)) != -2:
                found.append((same, to))
        if label < 0:
            raise ValueError(f"no token ends at byte {byte}")
        found.append((label, 0))
        if len(self.states) >= _MAX_STATES:
            self._empty()
        to = state[byte] = self._enter(tuple(found), label)
        return to

    def encode(self, word: bytes) -> list[int]:
        state, last = self.start, []
        for b in word:
            try:
                state = state[b]
            except KeyError:
                state = self._step(state, b)
            last.append(state[_LABEL])
        ids, at = [], len(word)
        while at:
            t = last[at - 1]
            ids.append(t)
            at -= self.size[t]
        ids.reverse()
        return ids


class AutomatonEncoder(ChunkEncoder):
    """A byte-level tokenizer file: its pre-tokenizer cuts texts into words, the automaton does the rest."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if self.layout != "byte":
            raise ValueError("only byte-level BPE files without a normalizer are compiled")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("dropout, ignored merges and added tokens that strip or match words are not compiled")
        self.to_byte = {ord(c): b for b, c in self.alphabet.items()}
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        arcs = {i: t.translate(self.to_byte).encode("latin-1") for t, i in ids.items()}
        self.automaton = MergeAutomaton(arcs, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.added_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.arc = {**arcs, **{i: t.encode() for t, i in self.added_ids.items()}}
        self.decimal = {i: str(i).encode() for i in self.arc}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _piece(self, piece: str) -> bytes:
        return array("I", self.automaton.encode(piece.encode())).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids = array("I")
            for part in self.at_added.split(text) if self.at_added else [text]:
                if part in self.added_ids:
                    ids.append(self.added_ids[part])
                    continue
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else ():
                    ids.extend(self.automaton.encode(word.translate(self.to_byte).encode("latin-1")))
            out.append(ids.tobytes())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the arcs; as text they are read with errors="replace"."""
        return b"".join(map(self.arc.__getitem__, ids))


_held: dict[str, AutomatonEncoder] = {}


def automaton(path: str) -> AutomatonEncoder:
    """The worker's automaton of this file; compiled once per Python process."""
    if path not in _held:
        _held.clear()
        _held[path] = AutomatonEncoder(path)
    return _held[path]


def _settle() -> None:
    """At the end of a task the older generation of the cache goes."""
    for e in _held.values():
        e.older = {}
    trim()


def _encoded(texts: pa.Array, enc: AutomatonEncoder) -> Iterator[bytes]:
    for t in texts:
        yield enc.encode([t.as_py() or ""])[0]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ``ids``, the token ids of every whole text.

    Null and empty texts have an empty array.  Rows are mapped one to one, repeated rows alike, null
    identifiers are kept, other columns are left out, and an empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = automaton(tokenizer_path)
        for b in batches:
            for k, ids in enumerate(_encoded(b.column(1), enc)):
                values = pa.array(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=["doc_id", "ids"])
        _settle()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ``text`` from (doc_id, ids); bytes that are no UTF-8 are replaced, null ids count as none."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = automaton(tokenizer_path)
        for b in batches:
            texts = [enc.decode(ids or []).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
        _settle()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the ids decoded, in UTF-8).

    The ids are encoded and decoded in the same task, so that they are never shuffled or stored.  Rows as in
    ``encode_documents``.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = automaton(tokenizer_path)
        for b in batches:
            out: list[tuple[int, str, str]] = []
            for raw in _encoded(b.column(1), enc):
                spelt, decoded = hashlib.sha256(), b""
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                spelt.update(b",".join(map(enc.decimal.__getitem__, ids)))
                decoded = enc.decode(ids).decode("utf-8", "replace").encode()
                out.append((len(ids), spelt.hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, s, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _settle()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
