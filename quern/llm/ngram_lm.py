"""Language-model scoring with an Elias-Fano trie of word bigrams, in shards that Spark builds and queries.

Tokens are lower-cased (A-Z) words between white space, then one end. The model interpolates:
p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), over training texts; the word
before the first is a begin mark. So probabilities over the V words and one unknown sum to one in each context.

How it runs. (1) One scan turns texts into batches: ids of tokens in a batch's own vocabulary, that vocabulary as
64-bit hashes, its training counts. Batches are staged in buckets by name, so that steps 3 and 5 read them in place
and only what joins them moves; the texts are not read again. (2) Batches' vocabularies meet
by ranges of the hash, are counted, and the counts go back to the batches. (3) Each batch sends its distinct bigrams,
with training counts, to shards by the hash of the context; each shard is one task of its own. (4) That task sums the
counts, builds the trie, looks up what the batches ask, and returns a quantised log probability for each bigram.
(5) Answers meet the batch's tokens again and are summed by text. So what is sent grows with the distinct bigrams of the batches; beside them each pair of
a batch and a shard costs a row of some hundred bytes.
Only two totals (N, V) reach the driver, and nothing is broadcast. A word or bigram occurs once in what a batch
sends, however frequent it is; the successors of a context with over 1/shards of all tokens are dealt to several
shards, by the successor's hash.

In a shard, contexts are a sorted level of hashes with monotone pointers to their successors. Successors are numbers
in the shard's own vocabulary, offset by their context so that the level increases; a bigram is found by successor
search in the range that its context's pointers give. Probabilities are quantised to steps of 1/4000 of log10. Levels are Elias-Fano coded
and memory-mapped.

Order two is a choice of cost. Measured over all documents of sf0.1 (4.0 million tokens, batches of 8 MB): batches would
send 1.25 distinct trigrams for each distinct bigram, under 4.1 times as many contexts; held-out texts without an exact
copy in training score -3.98 a token with trigrams interpolated, -4.09 with bigrams, -4.27 with words alone.
Words are told apart by 64-bit hashes; in a shard, contexts by their leading 48 bits and successors inside a context by
40, so that of a context with n successors about n^2 / 2^41 pairs are taken for one.

Nulls: a null text is empty and has one token, the end; an empty table gives no rows. There are no ties. Texts of any
length are read whole; one that is longer than a batch is a batch. A null ``held_out`` trains. Rows with null or repeated ids
are scored each on its own. Without training texts, p(w) is the same for all words. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import LOWER, SPACED, buffer, hashes, mixed, pieces, words
from quern.sources.staging import bucketed, staged
from quern.llm.elias_fano import EliasFano, mapped

MU, ADD, STEP = 20.0, 0.1, 4000.0
#: Bytes of text in a batch, tokens meant for a shard, the fewest shards, and bigrams that wait to be merged.
BATCH_BYTES, SHARD_TOKENS, LEAST_SHARDS, MERGE_ROWS = 8 << 20, 2_000_000, 16, 1_000_000
#: Leading bytes that tell contexts apart in a shard, and successors in a context.
CONTEXT_BYTES, WORD_BYTES = 6, 5
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

_BATCH = "batch string, doc_ids array<long>, held array<boolean>, sizes array<int>, vocabulary binary, counts binary, tokens binary"
_ASKED = "shard int, batch string, n_known array<long>, base array<double>, ways binary, sent array<binary>"
_TOLD = "shard int, batch string, n_known array<long>, base array<double>, ways binary, codes binary"


def _planes(x: np.ndarray) -> bytes:
    """Little-endian bytes by significance, compressed: what is sent is close to its entropy."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(x.size, -1).T.tobytes())


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _ascending(h: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, "<u8"), dtype=np.uint64)


def _leading(h: np.ndarray, size: int) -> bytes:
    """The leading ``size`` bytes of hashes, which no codec makes smaller."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _from_leading(data: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(data) // size, 8), np.uint8)
    wide[:, 8 - size :] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return wide.view(">u8").ravel().astype(np.uint64)


def _filled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of nearly ``most`` bytes of text, however few rows come at once: a word that repeats in
    a batch is sent once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= most:
            *full, rest = pieces(pa.Table.from_batches(held).combine_chunks().to_batches()[0], "text", most)
            yield from full
            held, size = [rest], rest.column("text").nbytes
    some = [b for b in held if b.num_rows]
    if some:
        yield from pieces(pa.Table.from_batches(some).combine_chunks().to_batches()[0], "text", most)


def _batches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, serial = TaskContext.get(), 0
        for part in _filled(batches, BATCH_BYTES):
            data, offsets = buffer(part.column("text"))
            data, n = LOWER[data], part.num_rows
            starts, ends, owner = words(data, offsets, SPACED)
            sizes = np.bincount(owner, minlength=n) + 1
            token = np.empty(starts.size + n, np.uint64)
            token[np.arange(starts.size) + owner] = hashes(data, starts, ends)
            token[np.cumsum(sizes) - 1] = _END
            held = part.column("held").to_pylist()
            trains = np.repeat(np.array([not h for h in held]), sizes)
            vocabulary, local = np.unique(token, return_inverse=True)
            counts = np.bincount(local[trains], minlength=vocabulary.size).astype("<u4")
            row = [f"{context.partitionId()}-{serial}", part.column("doc_ids").to_pylist(), held, sizes.astype(np.int32), _ascending(vocabulary), _planes(counts), _planes(local.astype("<u4"))]
            serial += 1
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split(" ")[0] for f in _BATCH.split(", ")])

    return docs.mapInArrow(run, _BATCH)


def _range(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of sorted hashes by their leading bits: ascending."""
    return ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _unigrams(batches: DataFrame, shards: int) -> DataFrame:
    """Per batch and shard the training counts of the batch's words, in its order; per shard its N and V."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, vocabulary, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, c = _summed(vocabulary), _unplaned(counts, "<u4")
                cuts = np.searchsorted(_range(h, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([name] * some.size, pa.string()), pa.array([_ascending(h[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()), pa.array([_planes(c[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())], ["shard", "batch", "words", "counts"]
                )

    def count(table: pa.Table) -> pa.Table:
        h = [_summed(x) for x in table["words"].to_pylist()]
        c = np.concatenate([_unplaned(x, "<u4") for x in table["counts"].to_pylist()])
        word, inverse = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(inverse, weights=c, minlength=word.size).astype("<u8")
        cuts = np.cumsum([0, *map(len, h)])
        back = [_planes(total[inverse[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        shard = table["shard"][0].as_py()
        n = len(back)
        return pa.table({"batch": pa.array([*table["batch"].to_pylist(), None], pa.string()), "shard": pa.array([shard] * (n + 1), pa.int32()), "counts": pa.array([*back, None], pa.binary()), "n": pa.array([None] * n + [int(total.sum())], pa.int64()), "v": pa.array([None] * n + [int((total > 0).sum())], pa.int64())})

    sent = batches.select("batch", "vocabulary", "counts").mapInArrow(send, "shard int, batch string, words binary, counts binary")
    return sent.groupBy("shard").applyInArrow(count, "batch string, shard int, counts binary, n long, v long")


def _pairs(sizes: np.ndarray, local: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams of a batch as places of both words in its vocabulary, in their order, and the bigram of each
    token. The begin mark's place is ``n``, one past the vocabulary."""
    before = np.empty_like(local)
    before[1:] = local[:-1]
    before[np.cumsum(sizes) - sizes] = n
    pair, inverse = np.unique(before * n + local, return_inverse=True)
    return pair // n, pair % n, inverse


def _dealt(vocabulary: np.ndarray, ways: np.ndarray, v: np.ndarray, w: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's bigrams in the order of their shards, and the shard of each: by the context's hash, and in one of
    ``ways`` of a context also by the successor's."""
    h = np.append(vocabulary, _BEGIN)
    shard = (mixed(h[v] + mixed(h[w]) % ways[v].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), shard


def _asker(n_all: int, v_all: int, shards: int):
    floor = n_all + ADD * (v_all + 1)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        count = np.concatenate([_unplaned(x, "<u8") for x in right["counts"].to_pylist()]).astype(np.int64)
        batch, held = (left[c][0].as_py() for c in ("batch", "held"))
        sizes = np.array(left["sizes"][0].as_py())
        vocabulary, local = _summed(left["vocabulary"][0].as_py()), _unplaned(left["tokens"][0].as_py(), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(sizes.size), sizes)
        log1 = np.log10((count + ADD) / floor)
        base = np.bincount(owner, weights=log1[local], minlength=sizes.size)
        known = np.bincount(owner[count[local] > 0], minlength=sizes.size)
        trains = np.repeat(~np.array([bool(h) for h in held]), sizes)
        v, w, inverse = _pairs(sizes, local, vocabulary.size)
        trained = np.bincount(inverse[trains], minlength=v.size).astype("<u4")
        # The begin mark occurs as often as the end. A context of over 1/shards of all tokens goes to several shards.
        before = np.append(count, count[np.searchsorted(vocabulary, _END)])
        ways = np.maximum(1, -(-before * shards // max(1, n_all))).astype("<u4")
        order, shard = _dealt(vocabulary, ways, v, w, shards)
        v_hash, w_hash = _leading(np.append(vocabulary, _BEGIN), CONTEXT_BYTES), _leading(vocabulary, WORD_BYTES)
        v_hash, w_hash = np.frombuffer(v_hash, (np.void, CONTEXT_BYTES)), np.frombuffer(w_hash, (np.void, WORD_BYTES))
        code = _code(log1)
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[k] : cuts[k + 1]]
            v_at, w_at = v[at], w[at]
            new = np.flatnonzero(np.concatenate([[True], v_at[1:] != v_at[:-1]]))
            sent = [v_hash[v_at[new]].tobytes(), _planes(np.diff(np.append(new, at.size)).astype("<u4")), _planes(before[v_at[new]].astype("<u8")), w_hash[w_at].tobytes(), _planes(code[w_at]), _planes(trained[at])]
            rows.append((int(k), batch, None, None, None, sent))
        own = int(mixed(np.array([hash_of(batch)], np.uint64))[0] % np.uint64(shards))
        rows.append((own, batch, known.tolist(), base.tolist(), _planes(ways), None))
        kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.binary())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in _ASKED.split(", ")])

    return ask


def _code(log: np.ndarray) -> np.ndarray:
    """Log probabilities in steps of 1/STEP."""
    return np.round(-log * STEP).clip(0, 65535).astype("<u2")


def hash_of(name: str) -> int:
    data = np.frombuffer(name.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([data.size]))[0])


class Trie:
    """A shard's bigrams: contexts, pointers, successors relative to their context, quantised probabilities."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, context_count: np.ndarray, mu: float):
        """Parallel arrays of training bigrams; equal ones are summed. ``word`` has 40 bits, ``context`` 48."""
        self.words = EliasFano(local := np.unique(word), 1 << 8 * WORD_BYTES)
        level = np.unique(context)
        self.contexts = EliasFano(level, 1 << 8 * CONTEXT_BYTES)
        self.stride = max(1, int(local.size))
        key = np.searchsorted(level, context) * self.stride + np.searchsorted(local, word)
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=key.size)
        self.pointers = EliasFano(np.searchsorted(key, np.arange(level.size + 1) * self.stride), key.size + 1)
        self.successors = EliasFano(key, max(1, level.size) * self.stride)
        share = total / (context_count[first] + mu)
        self.codes = mapped(np.round(-np.log10(share) * STEP).clip(0, 65535).astype("<u2"))

    def share(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """c(v w) / (c(v) + mu) of each bigram, 0 where it did not occur in training: the context's pointers give the
        range of its successors, and the word is searched in that range, relative to the context."""
        out = np.zeros(word.size)
        # Queries come in runs of one context, whose pointers are looked up once.
        level, inverse = np.unique(context, return_inverse=True)
        v, is_v = self.contexts.successor(level)
        known = np.flatnonzero(is_v)
        first, last = np.zeros(level.size, np.int64), np.zeros(level.size, np.int64)
        first[known], last[known] = self.pointers.at(v[known]).astype(np.int64), self.pointers.at(v[known] + 1).astype(np.int64)
        w, is_w = self.words.successor(word)
        both = np.flatnonzero(is_w & is_v[inverse])
        of = inverse[both]
        at, found = self.successors.successor_within(first[of], last[of], v[of].astype(np.uint64) * np.uint64(self.stride) + w[both].astype(np.uint64))
        out[both[found]] = 10.0 ** (self.codes[at[found]] / -STEP)
        return out


def _opened(sent: list[bytes]) -> dict[str, np.ndarray]:
    """A blob's bigrams, a row each."""
    v, runs, c_v, w, code, trained = sent
    runs = _unplaned(runs, "<u4")
    return {"v": np.repeat(_from_leading(v, CONTEXT_BYTES), runs), "c_v": np.repeat(_unplaned(c_v, "<u8"), runs), "w": _from_leading(w, WORD_BYTES), "code": _unplaned(code, "<u2"), "trained": _unplaned(trained, "<u4")}


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Bigrams (context, word, count, context's count) with those that are equal summed."""
    v, w, c, c_v = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, v.size), bool), (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    return v[first], w[first], np.add.reduceat(c[order], first) if first.size else c, c_v[order][first]


def _trie(asked: list[list[bytes]], mu: float) -> Trie:
    """Batches are merged as they come, so that memory follows the shard's distinct bigrams."""
    parts: list[tuple[np.ndarray, ...]] = []
    waiting = merged = 0
    for sent in asked:
        x = _opened(sent)
        some = x["trained"] > 0
        parts.append((x["v"][some], x["w"][some], x["trained"][some].astype(np.int64), x["c_v"][some]))
        waiting += int(some.sum())
        if waiting > max(MERGE_ROWS, merged):
            parts = [_merged(parts)]
            waiting, merged = 0, parts[0][0].size
    return Trie(*(np.concatenate(p) for p in zip(*parts, strict=True)), mu)


def _answerer(mu: float):
    def answer(table: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
        names = [f.split(" ")[0] for f in _TOLD.split(", ")]
        is_bigram = pa.compute.is_valid(table["sent"])
        rows = [(*(r[n] for n in names[:5]), None) for r in table.filter(pa.compute.invert(is_bigram)).to_pylist()]
        asked = table.filter(is_bigram)
        batches, sent = asked["batch"].to_pylist(), asked["sent"].to_pylist()
        if sent:
            trie, shard = _trie(sent, mu), asked["shard"][0].as_py()
            for batch, one in zip(batches, sent, strict=True):
                x = _opened(one)
                rest = mu / (x["c_v"] + mu) * 10.0 ** (x["code"] / -STEP)
                rows.append((shard, batch, None, None, None, _planes(_code(np.log10(trie.share(x["v"], x["w"]) + rest)))))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return answer


def _totaller(shards: int):
    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        """A batch's answers, laid on its tokens and added up: a row for each of its texts."""
        about = right.filter(pa.compute.is_valid(right["base"]))
        codes = right.filter(pa.compute.is_valid(right["codes"])).sort_by("shard")["codes"].to_pylist()
        sizes = np.array(left["sizes"][0].as_py())
        vocabulary, local = _summed(left["vocabulary"][0].as_py()), _unplaned(left["tokens"][0].as_py(), "<u4").astype(np.int64)
        v, w, inverse = _pairs(sizes, local, vocabulary.size)
        order, _ = _dealt(vocabulary, _unplaned(about["ways"][0].as_py(), "<u4"), v, w, shards)
        log = np.empty(order.size)
        log[order] = np.concatenate([_unplaned(x, "<u2") for x in codes]) / -STEP
        score = np.bincount(np.repeat(np.arange(sizes.size), sizes), weights=log[inverse], minlength=sizes.size)
        doc_ids, held = left["doc_ids"][0].as_py(), left["held"][0].as_py()
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(about["n_known"][0].as_py(), pa.int64()), "base_score": pa.array(about["base"][0].as_py(), pa.float64()), "score": pa.array(score)})

    return total


def _asked(docs: DataFrame, held_out: str) -> tuple[DataFrame, DataFrame, int, int]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_ids"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"))
    batches = bucketed(_batches(rows), "batches", "batch")
    tokens = batches.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS))
    counted = staged(_unigrams(batches, shards), "unigrams")
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    back = counted.where("batch is not null").select("batch", "shard", "counts")
    asked = batches.drop("counts", "doc_ids").groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_asker(n, v, shards), _ASKED)
    return batches.drop("counts"), asked.repartitionById(shards, "shard"), n, shards


def score(docs: DataFrame, held_out: str = "held_out", mu: float = MU) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    docs: doc_id, text, and a boolean column named ``held_out`` that tells which texts do not train.
    """
    batches, asked, n, shards = _asked(docs, held_out)
    told = asked.groupBy("shard").applyInArrow(_answerer(mu), _TOLD)
    totals = batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_totaller(shards), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return totals.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def sizes(docs: DataFrame, held_out: str = "held_out", mu: float = MU) -> DataFrame:
    """Size of the model by shard: contexts, bigrams, bytes of its levels."""

    def measure(table: pa.Table) -> pa.Table:
        sent = table["sent"].drop_null().to_pylist()
        trie = _trie(sent, mu) if sent else None
        total = sum(x.nbytes for x in (trie.words, trie.contexts, trie.pointers, trie.successors, trie.codes)) if trie else 0
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "contexts": pa.array([trie.contexts.n if trie else 0], pa.int64()), "bigrams": pa.array([trie.successors.n if trie else 0], pa.int64()), "bytes": pa.array([total], pa.int64())})

    return _asked(docs, held_out)[1].groupBy("shard").applyInArrow(measure, "shard int, contexts long, bigrams long, bytes long")
