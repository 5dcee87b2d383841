"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts as one state in which every byte may follow every byte.
Each merge (u, v) in turn is a gadget: the state that u leads to is copied
without its arc v, u now leads to the copy, and wherever u may be read a new arc
labelled uv leads to where v led before.  What remains after the last merge is
exactly one path per word, the encoding of that word.

A copy differs from its original in a single removed arc, so states are stored
as differences: ``removed[u][v]`` holds the merge that took arc v from behind u,
and an arc exists unless a removal on the right spine of the token behind it
meets the left spine of the token ahead of it before either was replaced by a
longer one.

Encoding reads a word once, byte by byte, through a transition table: every
prefix of a path is the path of a prefix, so each position has one token that
may end there.  The table is filled the first time a transition is taken, and
started anew at a fixed size.  Decoding concatenates the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from layerframe.llm.common import ids_and_texts, utf8

#: The split that byte-level vocabularies of this kind are made for (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts without other characters, where the standard engine is faster.
ASCII_WORDS = WORDS.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 60
#: Texts whose ids and decoded text are held at a time.
ROWS = 512
#: The token behind the start of a word.
NONE = -1


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    """States, arcs and labels compiled from the merges of a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], most: int = 400_000):
        symbols = byte_symbols()
        self.labels = {i: bytes(symbols[c] for c in word) for word, i in vocab.items()}
        self.ids = {label: i for i, label in self.labels.items()}
        #: u -> the arcs removed behind it, each with the merge that did so
        self.removed: dict[int, dict[int, int]] = {}
        #: token -> (merge that made it, its left part, its right part)
        self.made: dict[int, tuple[int, int, int]] = {}
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self._grow()
        self.lengths = array("I", bytes(4 * (max(self.labels, default=0) + 1)))
        for i, label in self.labels.items():
            self.lengths[i] = len(label)
        self.most = most
        self.forget()

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        """Copy the state behind u without arc v; add arc uv where u may be read."""
        self.removed.setdefault(u, {}).setdefault(v, time)
        self.made.setdefault(uv, (time, u, v))

    def _grow(self) -> None:
        """Byte transitions over the labels, one node per prefix of a label.

        ``child`` leads from node and byte to the next node, ``ends`` has the
        token that ends at a node or NONE, ``inner`` tells nodes that lead on.
        """
        self.child: dict[int, int] = {}
        self.ends, self.inner = array("q", [NONE]), bytearray(1)
        for label, token in self.ids.items():
            at = 0
            for byte in label:
                to = self.child.get(at << 8 | byte)
                if to is None:
                    to = self.child[at << 8 | byte] = len(self.ends)
                    self.ends.append(NONE)
                    self.inner.append(0)
                    self.inner[at] = 1
                at = to
            self.ends[at] = token

    def arc(self, token: int, following: int) -> bool:
        """May ``following`` be read in the state behind ``token``?

        Walks from each of the two tokens to its outermost parts, together with
        the merge that covered the part; spines are not stored.
        """
        left, left_until = token, NEVER
        while True:
            gone = self.removed.get(left)
            if gone is not None:
                right, right_until = following, NEVER
                while True:
                    time = gone.get(right, NEVER)
                    if time < left_until and time <= right_until:
                        return False
                    made = self.made.get(right)
                    if made is None:
                        break
                    right_until, right = made[0], made[1]
            made = self.made.get(left)
            if made is None:
                return True
            left_until, left = made[0], made[2]

    def forget(self) -> None:
        """Start the transition table anew, with the configuration before a word."""
        self.steps: dict[int, int] = {}
        self.numbers: dict[bytes, int] = {}
        self.keys: list[bytes] = [bytes(8)]
        self.token = array("q", [NONE])

    def _step(self, at: int, byte: int) -> int:
        """Extend every token under way, and one that starts here, by ``byte``.

        A configuration is the token that ends here, and for each token under
        way its node in the byte tree and the token behind its start.  It is
        kept as bytes, eight per number, a node and a token in one number.
        """
        under_way, token = array("Q", self.keys[at]), NONE
        under_way.append(self.token[at] + 1)
        after = array("Q", [0])
        for pair in under_way[1:]:
            node, behind = self.child.get(pair >> 32 << 8 | byte), (pair & 0xFFFFFFFF) - 1
            if node is None:
                continue
            if self.inner[node]:
                after.append(node << 32 | behind + 1)
            label = self.ends[node]
            if token == NONE and label != NONE and (behind == NONE or self.arc(behind, label)):
                token = label
        if token == NONE:
            raise ValueError("the vocabulary lacks a byte of this word")
        after[0] = token
        key = after.tobytes()
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.token)
            self.token.append(token)
            self.keys.append(key)
        self.steps[at << 8 | byte] = number
        return number

    def encode(self, word: bytes) -> list[int]:
        """The labels along the path that spells ``word``."""
        if len(self.steps) > self.most:
            self.forget()
        steps, token, at, ends = self.steps, self.token, 0, []
        for byte in word:
            to = steps.get(at << 8 | byte)
            at = self._step(at, byte) if to is None else to
            ends.append(token[at])
        path, end, lengths = [], len(word), self.lengths
        while end:
            path.append(ends[end - 1])
            end -= lengths[ends[end - 1]]
        return path[::-1]


class Encoder(dict):
    """Words already encoded, as little-endian ids; others are encoded on demand.

    Holds at most about ``most`` words, half of them set aside: when the newer
    half is full the older one goes, and a word found there counts as new again,
    so frequent words stay and memory is bounded.
    """

    def __init__(self, model: str, most: int = 100_000):
        spec = json.loads(model)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.automaton = MergeAutomaton({w: i for w, i in vocab.items() if w not in added}, merges)
        self.labels = self.automaton.labels | {i: utf8(w) for w, i in added.items()}
        self.words = regex.compile(WORDS)
        self.ascii_words = re.compile(ASCII_WORDS, re.ASCII)
        self.added = {w: i.to_bytes(4, "little") for w, i in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.most = most
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.automaton.encode(utf8(word))).tobytes()
        self[word] = ids
        return ids

    def forget(self) -> None:
        """Drop the words and transitions met so far; the compiled vocabulary stays."""
        self.clear()
        self.older = {}
        self.automaton.forget()

    def split(self, text: str) -> list[str]:
        return (self.ascii_words if text.isascii() else self.words).findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text, four little-endian bytes each."""
        if 2 * len(self) > self.most:
            self.older = dict(self)
            self.clear()
        if self.special is None or not any(w in text for w in self.added):
            return b"".join(map(self.__getitem__, self.split(text)))
        out = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out.extend(map(self.__getitem__, self.split(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for; broken sequences become U+FFFD."""
        data = b"".join(map(self.labels.__getitem__, array("I", ids)))
        return utf8(data.decode("utf-8", "replace"))


_encoders: dict[str, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    """One compiled encoder per worker process and vocabulary."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def read_model(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as binary (four little-endian bytes per id).

    ``model`` is the content of a tokenizer file; it goes to the executors once,
    as a broadcast whose size is that file's.  Null and empty texts have no ids;
    repeated rows give repeated results; a null id stays null; other columns are
    not read.  Row-local: no shuffle.
    """
    return _coded(df, model, id_col, text_col, "doc_id long, ids binary, decoded string", _encoded)


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; return counts and digests of both.

    Edge cases as in ``encode_texts``.
    """
    return _coded(df, model, id_col, text_col, SCHEMA, _digested)


def _encoded(encoder: Encoder, keys: list, texts) -> pa.RecordBatch:
    ids = [encoder.encode(t.as_py()) for t in texts]
    decoded = [encoder.decode(x).decode("utf-8", "replace") for x in ids]
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(keys, pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}
    )


def _digested(encoder: Encoder, keys: list, texts) -> pa.RecordBatch:
    counts, hashes, decoded = [], [], []
    for text in texts:
        ids = encoder.encode(text.as_py())
        counts.append(len(ids) // 4)
        hashes.append(hashlib.sha256(ids).hexdigest())
        decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(keys, pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(hashes, pa.string()),
            "decoded_sha256": pa.array(decoded, pa.string()),
        }
    )


def _coded(df: DataFrame, model: str, id_col: str, text_col: str, schema: str, of) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        try:
            for batch in batches:
                for start in range(0, len(batch), ROWS):
                    part = batch.slice(start, ROWS)
                    yield of(encoder, part[0].to_pylist(), part[1])
        finally:
            # The worker outlives its task, beside whatever its executor does next.
            encoder.forget()

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, schema)
