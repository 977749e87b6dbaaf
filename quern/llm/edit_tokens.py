"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds some pre-tokens (their lengths in code points, and their numbers of tokens), an inner node the sums of
its subtree. An edit re-encodes pre-tokens from the last boundary safely before it (further than any look-ahead or
special token reaches) until a boundary falls on an old one behind it; from there, the text and so the pre-tokens are
the same. The new pre-tokens replace the old ones in their leaves, and sums are updated on the paths to the root.

Nulls: a null text is an empty one; a null list of edits is an empty one; an edit beyond the end of a text applies at
its end. Repeated rows each give a row, and there are no ties. An empty table gives no rows. Extra columns are not read.
Texts are counted whole, whatever their length. An edit copies its document's text once (a slice of memory); what it
encodes does not grow with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import pieces
from quern.llm.bpe import Encoder, encoder

#: Pre-tokens meant for a leaf, and at most in one; code points before an edit that may look into it.
LEAF, MOST, MARGIN = 16, 256, 16

EDITS = "array<struct<at:bigint,gone:bigint,put:string>>"


class _Parts(dict):
    """Length (lower 32 bits) and number of tokens (upper) of pre-tokens, kept for those of a usual length."""

    def __init__(self, made: Encoder):
        super().__init__()
        self.made = made

    def __missing__(self, piece: str) -> int:
        part = len(piece) | len(self.made.packed(piece)) // 4 << 32
        if len(piece) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[piece] = part
        return part


_KEPT: dict[int, _Parts] = {}


def _parts(made: Encoder) -> _Parts:
    return _KEPT.setdefault(id(made), _Parts(made))


def pre_tokens(made: Encoder, text: str, start: int) -> Iterator[tuple[int, int]]:
    """Length and number of tokens of each pre-token from a boundary on, one at a time."""
    part = _parts(made)
    while start < len(text):
        mark = text.find(made.special, start) if made.special else -1
        end = len(text) if mark < 0 else mark
        for found in made.pattern.finditer(text, start, end):
            packed = part[found.group()]
            yield packed & 0xFFFFFFFF, packed >> 32
        start = end
        if mark >= 0:
            yield len(made.special), 1
            start += len(made.special)


def all_pre_tokens(made: Encoder, text: str) -> np.ndarray:
    """The same for a whole text at once, as an array of two columns."""
    find, part, out = made.pattern.findall, _parts(made).__getitem__, []
    for k, fragment in enumerate(text.split(made.special) if made.special else [text]):
        if k:
            out.append(np.array([len(made.special) | 1 << 32], "<u8"))
        found = find(fragment)
        out.append(np.fromiter(map(part, found), "<u8", len(found)))
    return (out[0] if len(out) == 1 else np.concatenate(out)).view("<u4").reshape(-1, 2)


class CountTree:
    """Counts of one document. ``total`` is its number of tokens, ``encoded`` the code points encoded so far.

    A leaf is a slice of an array of lengths and counts until an edit reaches it, and a list from then on."""

    def __init__(self, made: Encoder, text: str, parts: np.ndarray | None = None):
        self.made, self.text, self.encoded = made, text, 0
        if parts is None:
            parts = all_pre_tokens(made, text)
            self.encoded = len(text)
        self._build(parts)

    def _build(self, parts: np.ndarray) -> None:
        starts = np.arange(0, len(parts), LEAF)
        self.leaves: list = [parts[k : k + LEAF] for k in starts.tolist()] or [parts[:0]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        sums = np.zeros((2 * self.size, 2), np.int64)
        if starts.size:
            sums[self.size : self.size + starts.size] = np.add.reduceat(parts.astype(np.int64), starts, axis=0)
        n = self.size
        while n > 1:
            sums[n // 2 : n] = sums[n : 2 * n : 2] + sums[n + 1 : 2 * n : 2]
            n //= 2
        self.chars, self.tokens = sums[:, 0].tolist(), sums[:, 1].tolist()

    def _leaf(self, k: int) -> list[tuple[int, int]]:
        if not isinstance(self.leaves[k], list):
            self.leaves[k] = list(map(tuple, self.leaves[k].tolist()))
        return self.leaves[k]

    def parts(self) -> np.ndarray:
        """Length and number of tokens of all pre-tokens."""
        out, whole = [], 0
        # Neighbouring leaves that no edit has reached are one slice.
        for k, leaf in enumerate([*self.leaves, []]):
            if isinstance(leaf, list):
                if whole < k:
                    out.append(self.leaves[whole] if k == whole + 1 else np.concatenate(self.leaves[whole:k]))
                if leaf:
                    out.append(np.fromiter(chain.from_iterable(leaf), "<u4", 2 * len(leaf)).reshape(-1, 2))
                whole = k + 1
        return np.concatenate(out) if out else np.zeros((0, 2), "<u4")

    def _sum(self, k: int, leaf: list[tuple[int, int]]) -> None:
        self.chars[self.size + k], self.tokens[self.size + k] = map(sum, zip(*leaf, strict=True)) if leaf else (0, 0)

    def _add(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it, and start of the pre-token that begins last at or before ``at``."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        leaf = self._leaf(k - self.size) if k - self.size < len(self.leaves) else []
        place = 0
        while place + 1 < len(leaf) and start + leaf[place][0] <= at:
            start += leaf[place][0]
            place += 1
        return min(k - self.size, len(self.leaves) - 1), place, start

    def before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before a place: from the sums of whole subtrees."""
        k, start, count = 1, 0, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] <= at:
                start, count, k = start + self.chars[k], count + self.tokens[k], k + 1
        for n, c in self._leaf(k - self.size) if k - self.size < len(self.leaves) else []:
            if start + n > at:
                break
            start, count = start + n, count + c
        return count

    def edit(self, at: int, gone: int, put: str) -> None:
        """Replaces ``gone`` code points at ``at`` by ``put``."""
        at = max(0, min(at, len(self.text)))
        gone = max(0, min(gone, len(self.text) - at))
        text = self.text[:at] + put + self.text[at + gone :]
        first, place, start = self._find(max(0, at - MARGIN))
        shift, settled = len(put) - gone, at + len(put)
        # Old pre-tokens from the restart on, met by new ones at an equal boundary behind the edit.
        leaf, inner, old_end = first, place, start
        fresh, end = [], start
        met = start >= len(text)
        for size, count in pre_tokens(self.made, text, start):
            fresh.append((size, count))
            end += size
            self.encoded += size
            if end >= settled:
                while old_end + shift < end and leaf < len(self.leaves):
                    if inner < len(self.leaves[leaf]):
                        old_end += self._leaf(leaf)[inner][0]
                        inner += 1
                    else:
                        leaf, inner = leaf + 1, 0
                if old_end + shift == end and old_end >= at + gone:
                    met = True
                    break
        self.text = text
        if not met or end >= len(text):
            leaf, inner = len(self.leaves), 0
        head = self._leaf(first)[:place]
        if leaf == first:
            changed = {first: head + fresh + self._leaf(first)[inner:]}
        else:
            changed = {first: head + fresh} | {k: [] for k in range(first + 1, min(leaf, len(self.leaves)))}
            if leaf < len(self.leaves):
                changed[leaf] = self._leaf(leaf)[inner:]
        for k, parts in changed.items():
            self.leaves[k] = parts
        if len(self.leaves[first]) > MOST:
            self._build(self.parts())
            return
        touched = set()
        for k in changed:
            self._sum(k, self.leaves[k])
            touched.add((self.size + k) // 2)
        while touched and touched != {0}:
            for k in touched:
                self._add(k)
            touched = {k // 2 for k in touched}

    def stored(self) -> bytes:
        """Lengths and counts of all pre-tokens, to be kept beside the document."""
        return self.parts().tobytes()

    @classmethod
    def opened(cls, made: Encoder, text: str, data: bytes) -> CountTree:
        """A tree from what ``stored`` gave: nothing is encoded again."""
        return cls(made, text, np.frombuffer(data, "<u4").reshape(-1, 2))


def trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``text``, ``n_tokens``, ``tree`` of every text, to be kept for later edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                own = [CountTree(made, t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([t.total for t in own], pa.int64()), pa.array([t.stored() for t in own], pa.binary())], ["doc_id", "text", "n_tokens", "tree"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, n_tokens long, tree binary")


def apply_edits(docs: DataFrame, vocabulary: str, with_trees: bool = True) -> DataFrame:
    """Documents after their edits, which are applied in order: ``doc_id``, ``n_tokens`` before, ``edited`` (text),
    ``edited_tokens``, ``encoded_chars`` (code points that the edits had encoded again), ``edited_tree`` (unless they are
    not wanted, for no one keeps them).

    docs: doc_id, text, ``edits``; with a column ``tree`` (as ``trees`` gives it) nothing else is encoded, without it
    the tree is built first. Each row is worked on alone: no shuffle.
    """
    has_tree = "tree" in docs.columns
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                out = []
                for row in part.to_pylist():
                    tree = CountTree.opened(made, row["text"] or "", row["tree"]) if has_tree and row["tree"] is not None else CountTree(made, row["text"] or "")
                    before, tree.encoded = tree.total, 0
                    for e in row["edits"] or ():
                        tree.edit(e["at"] or 0, e["gone"] or 0, e["put"] or "")
                    out.append((row["doc_id"], before, tree.text, tree.total, tree.encoded, *([tree.stored()] if with_trees else [])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_trees else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(*kept, *(["tree"] if has_tree else []))
    schema = "doc_id long, n_tokens long, edited string, edited_tokens long, encoded_chars long" + (", edited_tree binary" if with_trees else "")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def own_edits(text: Column) -> Column:
    """Three edits made of a text alone: at a third, a sixteenth of it is replaced by its beginning; at two thirds,
    a few code points go; at the end, its first ones are added."""
    n = F.length(text)
    start = lambda k: F.substring(text, F.lit(1), k)
    one = F.floor(n / 16).cast("int")
    edit = lambda at, gone, put: F.struct(at.cast("long").alias("at"), gone.cast("long").alias("gone"), put.alias("put"))
    return F.array(edit(F.floor(n / 3), one, start(one)), edit(F.floor(2 * n / 3), F.lit(7), F.lit("")), edit(n.cast("long"), F.lit(0), start(F.lit(9))))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
