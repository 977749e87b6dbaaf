"""Exact byte-level BPE by backtracking over longest matches, and decoding by an offset table.

Inside a pre-token, the encoder takes the longest vocabulary match at its place (from one Aho-Corasick pass), accepts
it if the pair with the token before is compatible (the merges of the two tokens' joined bytes give just these two; told
from the ranks at which symbols at their border come and go, and kept in a table), else tries shorter matches, else
steps back and marks the place as a dead end. Each place is marked at most once, so the time is linear in the bytes. For merge lists whose every token encodes to itself, a sequence of pairwise
compatible tokens is the result of the merges.

Nulls: a null text is an empty one, with no ids; an empty table gives no rows. Repeated rows each give a row. Other
columns are not read. Texts of any length are encoded whole, one in memory at a time; the piece cache is bounded. There
are no ties: of equal merges the left comes first. A vocabulary has one added token at most; more
are an error, as are a normalizer, another pre-tokenizer and other kinds of merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import pieces

#: The pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space that is not alone between other characters.
_ODD_SPACE = re.compile(r"\s | \s|^ | $")

#: What a vocabulary file says of its pre-tokens and merges where ``PATTERN`` and plain merges are its own.
_KIND = {
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}

_CACHE, _LONGEST_CACHED, _PAIRS = 200_000, 64, 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _check_kind(model: dict) -> None:
    """Raises where a vocabulary file asks for what this encoder does not do, in place of giving other ids silently."""
    if model.get("normalizer") is not None:
        raise ValueError("vocabularies without a normalizer only")
    if model.get("post_processor") not in (None, {}) and model["post_processor"].get("type") != "ByteLevel":
        raise ValueError("vocabularies without a post-processor that adds tokens only")
    for part, kind in _KIND.items():
        given = model.get(part) or {}
        # Settings that a file leaves out, but for the type, are as here.
        odd = {k: given.get(k) for k, v in kind.items() if (given.get(k, None if k == "type" else v) or None) != (v or None)}
        if odd:
            raise ValueError(f"vocabularies of plain byte-level BPE only; {part} has {odd}")
    for token in model.get("added_tokens", []):
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
            raise ValueError("added tokens that match by their text alone only")


class Encoder:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str | Path):
        model = json.loads(Path(path).read_text("utf-8"))
        _check_kind(model)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.vocabulary = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rank = {tuple(bytes(letters[c] for c in x) for x in m): r for r, m in enumerate(merges)}
        if len(special) > 1:
            raise ValueError("vocabularies with one added token at most")
        self.special, self.special_id = next(iter(special.items()), (None, None))
        self.pattern = regex.compile(PATTERN)
        size = 1 + max([*self.vocabulary.values(), *special.values()])
        table = [b""] * size
        for t, i in self.vocabulary.items():
            table[i] = t
        for t, i in special.items():
            table[i] = t.encode()
        self.table, self.size = table, [len(t) for t in table]
        #: The decoding table: all tokens' bytes end to end, and where each begins.
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocabulary.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: Next shorter vocabulary entry that begins a token, or -1.
        self.shorter = [-1] * size
        for t, i in self.vocabulary.items():
            self.shorter[i] = next((self.vocabulary[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.vocabulary), -1)
        #: Of each token, the halves of its first merge and that merge's rank; ranks by pairs of ids.
        self.halves: dict[int, tuple[int, int, int]] = {}
        self.pair_rank: dict[int, int] = {}
        for (left, right), r in self.rank.items():
            i, j = self.vocabulary[left], self.vocabulary[right]
            self.halves.setdefault(self.vocabulary[left + right], (i, j, r))
            self.pair_rank[i << 32 | j] = r
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.spaced = _Spaced(self)

    def merged(self, text: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first: the definition, for short inputs."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, k = (parts[best], parts[best + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.vocabulary[p] for p in parts]

    def _edge(self, token: int, last: bool) -> list[tuple[int, int, int]]:
        """The symbols that stand at a token's last (or first) byte while it is merged together: the token itself, its
        outer half, that one's, down to the byte; each with the ranks at which it comes to be and is merged away."""
        known = self.edges[last].get(token)
        if known is None:
            known, gone = [], len(self.rank)
            symbol = token
            while True:
                parts = self.halves.get(symbol)
                born = -1 if parts is None else parts[2]
                known.append((symbol, born, gone))
                if parts is None:
                    break
                symbol, gone = parts[1] if last else parts[0], born
            self.edges[last][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges keep this pair of tokens apart and whole: no two symbols that meet at their border, while
        both are there, are merged before either of them is merged into its own token. Of equal merges, the left comes first."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            ranks, right = self.pair_rank, self._edge(b, False)
            known = True
            for x, x_born, x_gone in self._edge(a, True):
                for y, y_born, y_gone in right:
                    if x_born < y_gone and y_born < x_gone:
                        rank = ranks.get(x << 32 | y)
                        if rank is not None and rank < x_gone and rank <= y_gone:
                            known = False
                            break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def piece(self, text: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.vocabulary.get(text)
        if whole is not None and self.shorter[whole] < 0:
            return [whole]
        n, size = len(text), self.size
        longest = [-1] * n
        # Matches come by their ends, so that of a start the last one is the longest.
        for end, token in self.automaton.iter(text.decode("latin-1")):
            longest[end + 1 - size[token]] = token
        shorter, compatible = self.shorter, self.compatible
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def packed(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers, from a bounded cache."""
        known = self.cache.get(piece)
        if known is None:
            known = np.array(self.piece(piece.encode()), "<u4").tobytes()
            if len(piece) <= _LONGEST_CACHED:
                if len(self.cache) >= _CACHE:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed as in ``packed``; the special token's string gives its id."""
        parts = text.split(self.special) if self.special else [text]
        mark = np.array([self.special_id or 0], "<u4").tobytes()
        return mark.join(map(self._plain, parts))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A pre-token ends before each single space between other characters;
        so where all spaces are such, the text is cut there, and each word is looked up with what is stuck to it."""
        if _ODD_SPACE.search(text):
            return b"".join(map(self.packed, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.packed, self.pattern.findall(first)), *map(self.spaced.__getitem__, rest)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from the offset table."""
        first, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        to = np.cumsum(sizes) - sizes
        return self.blob[np.arange(int(sizes.sum())) + np.repeat(first - to, sizes)].tobytes()


class _Spaced(dict):
    """Packed ids of words after a space, bounded as the cache of pre-tokens."""

    def __init__(self, made: Encoder):
        super().__init__()
        self.made = made

    def __missing__(self, word: str) -> bytes:
        out = b"".join(map(self.made.packed, self.made.pattern.findall(" " + word)))
        if len(word) <= _LONGEST_CACHED:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = out
        return out


_MADE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary. ``path`` is a file on every executor, or the name of one that
    ``SparkContext.addFile`` sent out."""
    if path not in _MADE:
        _MADE[path] = Encoder(path if Path(path).exists() else SparkFiles.get(Path(path).name))
    return _MADE[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (text) of every whole text: one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = [np.frombuffer(made.encode(t or ""), "<u4").astype(np.int32) for t in part.column("text").to_pylist()]
                decoded = [made.decode(i).decode("utf-8", "replace") for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Counts and digests of ids and decoded texts: ``encode`` with only digests leaving Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                packed = [made.encode(t or "") for t in part.column("text").to_pylist()]
                texts = [made.decode(np.frombuffer(p, "<u4").astype(np.int64)).decode("utf-8", "replace").encode() for p in packed]
                columns = [part.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
