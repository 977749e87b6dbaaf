"""Line deduplication by a sharded minimal perfect hash over the distinct lines' hashes.

A line's key is the line without white space (space, 0x09 to 0x0D) at its ends and with A-Z in lower case. A key of at
least ``least_chars`` code points that stands in at least ``least_documents`` documents is repeated: its lines go, but
for those of the largest doc_id that holds it. All other lines stay, joined by line feeds.

How it runs. (1) One scan turns documents into batches of some megabytes: the texts, compressed, and for each line the
number of its key among the batch's distinct keys (128-bit hashes), with the number of the batch's documents that hold
it and their largest id. (2) The distinct keys of each batch go to shards by their hash; a shard sums them up and
becomes one row of the index: a minimal perfect hash, a 32-bit fingerprint, a count and an id for each key, in arrays
without keys. (3) Batches send their distinct keys to the shards once more and probe the arrays; what comes back is the
numbers of repeated keys and the ids that keep them. (4) That meets the batch, which cuts its texts. So no line and no
row for a line is ever shuffled: a line that a third of all documents have is one key of each batch, and all shards get
about the same. Beside texts (once, compressed) some 20 bytes for each distinct line of a batch are moved, twice.

Shards hold about eight times the square root of the number of keys (65,536 to 4,194,304), so that the rows of keys
that batches send to shards do not become single keys. The index is a table; :func:`probe` takes one that was built
over other documents too.

A document is a row. Nulls: a null text is empty and has one empty line; null ids are below all others, so such a row
keeps repeated lines only where no row with an id holds them. Rows that repeat an id are documents of their own, and
all rows of the largest id keep their lines. An empty table gives no rows; a text of any length is read whole and is a
batch of its own if it is longer than one. A key that a document holds twice counts once and loses both lines. Other
columns are not read.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import mixed
from quern.sources.staging import staged

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Bytes of text in a batch, the fewest shards, keys of a shard (least and most), bits for each key that a level of the hash has.
BATCH_BYTES, LEAST_SHARDS, SHARD_KEYS, GAMMA = 8 << 20, 16, (1 << 16, 1 << 22), 2
_SPACE = b" \t\n\v\f\r"
_NO_ID = -(1 << 63)

_BATCH = "batch string, doc_ids array<long>, n_bytes array<long>, n_lines array<int>, texts binary, lines binary, keys binary, counts binary, ids binary"
_PART = "shard int, batch string, places binary, keys binary, counts binary, ids binary"
_INDEX = "shard int, keys long, arrays binary"
_TOLD = "shard int, batch string, places binary, ids binary"


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """Hash of a line's key (16 bytes), or None if the key is too short to count."""
    key = line.strip(_SPACE)
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower() changes A-Z only


class _Batch:
    """Documents of a batch as they come: texts, lines as numbers of keys, and what is known of each key."""

    def __init__(self, least_chars: int):
        self.least_chars, self.n_bytes = least_chars, 0
        self.ids: list[int | None] = []
        self.texts: list[bytes] = []
        self.n_lines: list[int] = []
        self.lines: list[int] = []
        self.number: dict[bytes, int] = {}
        self.counts: list[int] = []
        self.largest: list[int] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        lines, at = text.split(b"\n"), _NO_ID if doc_id is None else doc_id
        start = len(self.lines)
        for line in lines:
            key = line_key(line, self.least_chars)
            if key is None:
                self.lines.append(-1)
                continue
            n = self.number.setdefault(key, len(self.number))
            if n == len(self.counts):
                self.counts.append(0)
                self.largest.append(at)
            self.lines.append(n)
        for n in set(self.lines[start:]) - {-1}:
            self.counts[n] += 1
            self.largest[n] = max(self.largest[n], at)
        self.ids.append(doc_id)
        self.texts.append(text)
        self.n_lines.append(len(lines))
        self.n_bytes += len(text)

    def row(self) -> pa.RecordBatch:
        blob = lambda x, kind: np.array(x, kind).tobytes()
        texts = zstandard.ZstdCompressor(level=1).compress(b"".join(self.texts))
        columns = [
            pa.array([uuid.uuid4().hex]),
            pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([[len(t) for t in self.texts]], pa.list_(pa.int64())),
            pa.array([self.n_lines], pa.list_(pa.int32())),
            *(pa.array([x], pa.binary()) for x in (texts, blob(self.lines, "<i4"), b"".join(self.number), blob(self.counts, "<u4"), blob(self.largest, "<i8"))),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in _BATCH.split(", ")])


def _batches(docs: DataFrame, least_chars: int, batch_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batch(least_chars)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                text = text.as_py() or b""
                if held.ids and held.n_bytes + len(text) > batch_bytes:
                    yield held.row()
                    held = _Batch(least_chars)
                held.add(doc_id, text)
        if held.ids:
            yield held.row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BATCH)


def _hashes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8").reshape(-1, 2)


class MinimalHash:
    """A minimal perfect hash of 128-bit keys: levels of bits, each set where just one of the keys that are left falls;
    a key's number is how many bits are set before its own. Other keys get a number too, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of 64-bit words
        self.before, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        seed = mixed(np.array([level + 1], np.uint64))[0]
        return mixed(mixed(keys[:, 0] + seed) ^ keys[:, 1]) % np.uint64(64 * words)

    @classmethod
    def of(cls, keys: np.ndarray) -> MinimalHash:
        """keys: distinct rows of two 64-bit words."""
        levels: list[np.ndarray] = []
        while len(keys):
            words = max(1, GAMMA * len(keys) // 64)
            place = cls._place(keys, len(levels), words)
            alone = np.bincount(place.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[place]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            if not left.size:
                break
            place = self._place(keys[left], level, words.size)
            word, bit = words[place >> np.uint64(6)], place & np.uint64(63)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = before[place >> np.uint64(6)][here] + below[here]
            left = left[~here]
        return out


class LineIndex:
    """A shard's arrays: minimal perfect hash, fingerprint, number of documents and largest id of each key."""

    def __init__(self, hashed: MinimalHash, prints: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.hashed, self.prints, self.counts, self.ids = hashed, prints, counts, ids

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys[:, 1]) >> np.uint64(32)).astype("<u4")

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> LineIndex:
        """Parallel arrays; equal keys are summed up."""
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, counts, ids = keys[order], counts[order], ids[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(axis=1)]))
        if first.size:
            keys, counts, ids = keys[first], np.add.reduceat(counts.astype(np.int64), first).clip(max=(1 << 32) - 1), np.maximum.reduceat(ids, first)
        hashed = MinimalHash.of(keys)
        place = np.empty(len(keys), np.int64)
        place[hashed.numbers(keys)] = np.arange(len(keys))
        return cls(hashed, cls._print(keys)[place], counts[place].astype("<u4"), ids[place].astype("<i8"))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (0 for a key that is not in the index) and largest id of each key."""
        at = self.hashed.numbers(keys)
        there = np.flatnonzero(at >= 0)
        there = there[self.prints[at[there]] == self._print(keys[there])]
        counts, ids = np.zeros(len(keys), np.int64), np.full(len(keys), _NO_ID)
        counts[there], ids[there] = self.counts[at[there]], self.ids[at[there]]
        return counts, ids

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, ids=self.ids, **{f"level{k}": x for k, x in enumerate(self.hashed.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> LineIndex:
        x = np.load(io.BytesIO(blob))
        return cls(MinimalHash([x[f"level{k}"] for k in range(len(x.files) - 3)]), x["prints"], x["counts"], x["ids"])


def _dealt(batches: DataFrame, shards: int) -> DataFrame:
    """The distinct keys of each batch, a row for each shard that has some."""
    names = [f.split(" ")[0] for f in _PART.split(", ")]
    kinds = [pa.int32(), pa.string(), *[pa.binary()] * 4]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, blob, counts, ids in zip(*(part.column(c).to_pylist() for c in ("batch", "keys", "counts", "ids")), strict=True):
                keys, counts, ids = _hashes(blob), np.frombuffer(counts, "<u4"), np.frombuffer(ids, "<i8")
                shard = (mixed(keys[:, 0]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) > 0, [True]])) if order.size else np.zeros(0, np.int64)
                rows = [(int(shard[p[0]]), batch, p.astype("<i4").tobytes(), keys[p].tobytes(), counts[p].tobytes(), ids[p].tobytes()) for p in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return batches.select("batch", "keys", "counts", "ids").mapInArrow(run, _PART)


def _built(table: pa.Table) -> pa.Table:
    joined = lambda c: b"".join(table[c].to_pylist())
    index = LineIndex.of(_hashes(joined("keys")), np.frombuffer(joined("counts"), "<u4"), np.frombuffer(joined("ids"), "<i8"))
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "keys": pa.array([index.ids.size], pa.int64()), "arrays": pa.array([index.to_bytes()], pa.binary())})


def _shards(batches: DataFrame) -> int:
    keys = batches.select(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // 16
    return max(LEAST_SHARDS, -(-keys // min(SHARD_KEYS[1], max(SHARD_KEYS[0], 8 * math.isqrt(keys)))))


def _index(batches: DataFrame, shards: int) -> DataFrame:
    """A row for each shard; one without a key has none."""
    parts = _dealt(batches, shards)
    built = staged(parts.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_built, _INDEX), "lines")
    return built.withColumn("shards", F.lit(shards))


def build(docs: DataFrame, least_chars: int = LEAST_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The index of all lines of ``docs`` (doc_id, text): ``shard``, ``keys``, ``arrays``, ``shards``. Save it as a table."""
    batches = staged(_batches(docs, least_chars, batch_bytes), "batches")
    return _index(batches, _shards(batches))


def _teller(least_documents: int):
    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            index = LineIndex.from_bytes(left["arrays"][0].as_py())
            for batch, places, keys in zip(*(right[c].to_pylist() for c in ("batch", "places", "keys")), strict=True):
                counts, ids = index.look_up(_hashes(keys))
                some = np.flatnonzero(counts >= least_documents)
                if some.size:
                    rows.append((left["shard"][0].as_py(), batch, np.frombuffer(places, "<i4")[some].tobytes(), ids[some].astype("<i8").tobytes()))
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split(" ")[0] for f in _TOLD.split(", ")])

    return tell


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """A batch's documents without the lines that the answers name: a row for each document."""
    names = ["doc_id", "text", "n_lines", "dropped"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())]
    if not left.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
    row = {c: left[c][0].as_py() for c in left.column_names}
    keepers = {p: i for places, ids in zip(right["places"].to_pylist(), right["ids"].to_pylist(), strict=True) for p, i in zip(np.frombuffer(places, "<i4").tolist(), np.frombuffer(ids, "<i8").tolist(), strict=True)}
    data, lines = zstandard.ZstdDecompressor().decompress(row["texts"]), np.frombuffer(row["lines"], "<i4").tolist()
    out, byte, line = [], 0, 0
    for doc_id, size, n in zip(row["doc_ids"], row["n_bytes"], row["n_lines"], strict=True):
        text, own, at = data[byte : byte + size], lines[line : line + n], _NO_ID if doc_id is None else doc_id
        byte, line = byte + size, line + n
        gone = [k for k, key in enumerate(own) if keepers.get(key, at) != at]
        if gone:
            away = set(gone)
            text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in away)
        out.append((doc_id, text.decode(), n, gone))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _probed(batches: DataFrame, index: DataFrame, shards: int, least_documents: int) -> DataFrame:
    asked = _dealt(batches, shards).select("shard", "batch", "places", "keys")
    told = index.select("shard", "arrays").groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_teller(least_documents), _TOLD)
    own = batches.select("batch", "doc_ids", "n_bytes", "n_lines", "texts", "lines")
    cut = own.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_cut, "doc_id long, text string, n_lines long, dropped array<int>")
    return cut.select("doc_id", "text", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def probe(docs: DataFrame, index: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without the lines that the index counts in at least ``least_documents`` documents and whose largest
    holder is another id: ``doc_id``, ``text``, ``n_lines`` (before), ``n_dropped``, ``dropped`` (their places, from 0).
    A line that the index does not have is taken for one of its with a chance of 2^-32."""
    shards = index.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]
    return _probed(staged(_batches(docs, least_chars, batch_bytes), "batches"), index, shards, least_documents)


def dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """:func:`probe` of documents against the index of their own lines; every line is in it, so nothing is mistaken."""
    batches = staged(_batches(docs, least_chars, batch_bytes), "batches")
    shards = _shards(batches)
    return _probed(batches, _index(batches, shards), shards, least_documents)
