"""SimHash near-duplicate groups: fingerprints from word shingles, linked by a self-join of binary tries.

A fingerprint bit is set if it is set in over half of the shingle hashes. Of ``budget + c`` blocks of bits, two
fingerprints at ``budget`` or fewer differing bits agree in ``c``; so each is dealt out once for each choice of c blocks,
turned so that these lead, and those that agree in them form the subtree of a binary trie. c is 1 for few fingerprints
and grows with their number, so that subtrees stay small. A subtree that is crowded even so (very many fingerprints that
begin alike) is not one task's: its bits that are left are cut into blocks in their turn, and its fingerprints are dealt out
again, until no subtree is crowded. Inside a task, a sorted array of keys is the trie (a node is a
range of it). Node pairs are descended together, differing bits are added up along the path, and a pair is dropped as
soon as the sum exceeds the budget.

Nulls: a null text is an empty one. A text without a word has fingerprint zero and is linked like any other.
Rows with a null id take part; groups made of them alone have a null component. Repeated rows are in one group and
stay rows. Very long texts are read whole, one in memory at a time. Ties: a bit that is set in exactly half of the
hashes is not set; of equal ids the group has one name. An empty table gives no rows. Other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import LOWER, SPACED, buffer, hashes, joined, mixed, pieces, words
from quern.sources.staging import staged
from quern.llm.components import connected

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
#: Sizes below which a node pair is compared key by key, key pairs compared and node pairs descended at once.
_LEAF, _AT_ONCE, _PAIRS = 32, 1 << 20, 200_000

#: Random fingerprints that may agree in the leading blocks before more blocks have to, and fingerprints of one subtree
#: beyond which it is dealt out again.
GROUP, CROWD = 4096, 16_384


def shingle_spans(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of ``size`` words, or of the whole sequence where a text has fewer."""
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    each = np.where(count > 0, np.maximum(1, count - size + 1), 0)
    owner = np.repeat(np.arange(n), each)
    at = np.arange(owner.size) - np.repeat(np.cumsum(each) - each, each) + first[owner]
    last = np.minimum(at + size, (first + count)[owner]) - 1
    return starts[at], ends[last], owner


def majority(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text the 64-bit word whose bits are set in over half of its values."""
    octets = values.view(np.uint8).reshape(-1, 8)
    total = np.bincount(owner, minlength=n).astype(np.float32)
    out = np.zeros((n, 8), np.uint8)
    for lo in range(0, n, 2048):
        hi = min(n, lo + 2048)
        a, b = np.searchsorted(owner, [lo, hi])
        for k in range(8):
            seen = np.bincount((owner[a:b] - lo) * 256 + octets[a:b, k], minlength=(hi - lo) * 256).reshape(-1, 256)
            out[lo:hi, k] = np.packbits(2 * (seen.astype(np.float32) @ _BITS) > total[lo:hi, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8")[:, 0]


def _fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, folded into one word per text."""
    data, offsets = buffer(texts)
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, doc = words(data, offsets, SPACED)
    text, starts, ends = joined(data, starts, ends)
    starts, ends, owner = shingle_spans(starts, ends, doc, n, size)
    view, hashed = memoryview(text), xxhash.xxh64_intdigest
    values = np.fromiter((hashed(view[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, starts.size)
    return majority(values, owner, n)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (long) of every whole text: one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                made = _fingerprints(part.column("text"), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made)], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


class Forest:
    """Disjoint sets over 0..n-1, merged by arrays of links; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        #: How often links were added, and whether all parents are roots.
        self.version, self.flat = 0, True

    def roots(self) -> np.ndarray:
        while not self.flat:
            up = self.parent[self.parent]
            self.flat = np.array_equal(up, self.parent)
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            parent = self.roots()
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            if a.size:
                self.parent = parent.copy()
                np.minimum.at(self.parent, b, a)
                self.version, self.flat = self.version + 1, False


def trie_links(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int) -> Forest:
    """Sets of keys that chains of links join; a link has at most ``budget`` differing bits.

    keys: sorted unsigned words; lo, hi: the trie nodes (ranges of keys that share ``depth`` leading bits) whose
    inner pairs are wanted. Node pairs whose keys are all in one set already are not descended, so a dense family costs
    about its size and not its square. What tells one set is worked out anew only after new links.
    """
    forest = Forest(keys.size)
    stack = [(lo, hi, lo, hi, np.zeros(lo.size, np.int8), depth)]
    seen, root, steps = -1, forest.parent, forest.parent
    while stack:
        al, ah, bl, bh, used, depth = stack.pop()
        if al.size > _PAIRS:
            half = al.size // 2
            stack += [tuple(x[half:] for x in (al, ah, bl, bh, used)) + (depth,), tuple(x[:half] for x in (al, ah, bl, bh, used)) + (depth,)]
            continue
        if seen != forest.version:
            seen, root = forest.version, forest.roots()
            steps = np.cumsum(np.concatenate([[0], root[1:] != root[:-1]]))
        one_set = (steps[al] == steps[ah - 1]) & (steps[bl] == steps[bh - 1]) & (root[al] == root[bl])
        al, ah, bl, bh, used = (x[~one_set] for x in (al, ah, bl, bh, used))
        leaf = (ah - al <= _LEAF) & (bh - bl <= _LEAF)
        _compare(keys, *(x[leaf] for x in (al, ah, bl, bh)), budget, forest)
        al, ah, bl, bh, used = (x[~leaf] for x in (al, ah, bl, bh, used))
        if not al.size:
            continue
        am, bm = _middle(keys, al, ah, depth), _middle(keys, bl, bh, depth)
        own = al == bl
        apart = 1 if depth < 64 else 0
        ways = [(al, am, bl, bm, used), (am, ah, bm, bh, used), (al, am, bm, bh, used + apart), (am, ah, bl, bm, used + apart)]
        keep = [(w[1] > w[0]) & (w[3] > w[2]) & (w[4] <= budget) & (~own if k == 3 else True) for k, w in enumerate(ways)]
        parts = [[x[k] for x in w] for w, k in zip(ways, keep, strict=True)]
        stack.append(tuple(np.concatenate(x) for x in zip(*parts[2:], strict=True)) + (min(64, depth + 1),))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts[:2], strict=True)) + (min(64, depth + 1),))
    return forest


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the second child of each node begins; nodes of equal keys are halved."""
    if depth >= 64:
        return (lo + hi + 1) // 2
    bit = np.uint64(1 << (63 - depth))
    return np.searchsorted(keys, (keys[lo] & ~np.uint64((1 << (64 - depth)) - 1) if depth else np.zeros_like(keys[lo])) | bit).clip(lo, hi)


def _compare(keys, al, ah, bl, bh, budget, forest) -> None:
    """All key pairs of pairs of small nodes, a bounded number at a time."""
    pairs = np.cumsum((ah - al) * (bh - bl))
    at = 0
    while at < al.size:
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + _AT_ONCE, side="right")))
        a0, na, b0, nb = al[at:to], (ah - al)[at:to], bl[at:to], (bh - bl)[at:to]
        which = np.repeat(np.arange(to - at), na * nb)
        k = np.arange(which.size) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        i, j = a0[which] + k // nb[which], b0[which] + k % nb[which]
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        i, j = i[near], j[near]
        if i.size:
            parent = forest.roots()
            apart = parent[i] != parent[j]
            forest.link(i[apart], j[apart])
        at = to


def _turns(budget: int, agreeing: int, done: int = 0) -> list[list[tuple[int, int]]]:
    """For each choice of ``agreeing`` of ``budget + agreeing`` blocks of the bits from ``done`` on: first bit and size of all
    blocks, those chosen in front."""
    n = budget + agreeing
    cuts = [done + (64 - done) * k // n for k in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [[*(blocks[k] for k in some), *(b for k, b in enumerate(blocks) if k not in some)] for some in combinations(range(n), agreeing)]


def _agreeing(nodes: int, budget: int, bits: int = 64) -> int:
    """How many blocks have to agree, so that about ``GROUP`` of so many random fingerprints do; one to three."""
    return next((c for c in (1, 2) if nodes >> (bits // (budget + c)) * c <= GROUP), 3)


def _turned(key: str, turn: list[tuple[int, int]], done: int) -> Column:
    """The key with its first ``done`` bits in place and the blocks after them in the order of the turn. Bit 0 is the highest."""
    out, to = F.shiftleft(F.shiftrightunsigned(key, 64 - done), 64 - done) if done else F.lit(0).cast("long"), done
    for at, size in turn:
        block = F.shiftrightunsigned(F.shiftleft(F.col(key), at), 64 - size)
        out, to = out.bitwiseOR(F.shiftleft(block, 64 - to - size)), to + size
    return out


def links(nodes: DataFrame, budget: int, agreeing: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Links that join all fingerprints at ``budget`` or fewer differing bits, without writing all pairs of a family.

    nodes: ``node``, distinct fingerprints. Returns ``src``, ``dst``: per task and turn a star for each set that the links
    found there join, which keeps exactly the components of all links. ``agreeing`` (1 to 3 blocks) follows the number of
    nodes; the components are the same for each.

    Subtrees of more than ``crowd`` fingerprints are counted out and dealt again by blocks of their other bits: two of them
    within the budget differ in these bits only, so they agree in enough of the new blocks. Each time at least a tenth of
    what is left joins the prefix, and the fingerprints are distinct, so this ends.
    """
    # turn: numbers the choices made so far; key: the node's bits in their order.
    rows, most, done, out = nodes.select(F.lit(0).alias("turn"), F.col("node").alias("key"), "node"), nodes.count(), 0, None
    while True:
        turns = _turns(budget, agreeing or _agreeing(most, budget, 64 - done), done)
        chosen = len(turns[0]) - budget
        lead = [done + sum(size for _, size in turn[:chosen]) for turn in turns]
        least = min(lead)
        moved = F.array(*(F.struct((F.col("turn") * len(turns) + t).alias("turn"), _turned("key", turn, done).alias("key")) for t, turn in enumerate(turns)))
        dealt = rows.select("node", F.explode(moved).alias("x")).select("x.turn", "x.key", "node", F.shiftrightunsigned("x.key", 64 - least).alias("prefix"))
        crowded = None
        if most > crowd and 64 - least > 2 * (budget + 3):
            crowded = staged(dealt.groupBy("turn", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded")
            number, most = crowded.agg(F.count("*"), F.max("n")).first()
            crowded = F.broadcast(crowded.drop("n")) if 0 < number <= BROADCAST_ROWS else crowded.drop("n").hint("merge") if number else None
        here = dealt if crowded is None else dealt.join(crowded, ["turn", "prefix"], "left_anti")
        found = _subtrees(here, lead, budget)
        out = found if out is None else out.unionByName(found)
        if crowded is None:
            return out.distinct()
        rows, done = staged(dealt.join(crowded, ["turn", "prefix"], "left_semi").select("turn", "key", "node"), "dealt"), least


def _subtrees(dealt: DataFrame, lead: list[int], budget: int) -> DataFrame:
    """Stars of the links inside subtrees. dealt: ``turn``, ``prefix``, ``key``, ``node``; lead: leading bits that agree, by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        turn, key, node = rows["turn"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["node"].to_numpy()
        order = np.lexsort((key, turn))
        turn, key, node = turn[order], key[order], node[order]
        cuts = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k, own, depth = key[a:b], node[a:b], lead[turn[a] % len(lead)]
            prefix = k >> np.uint64(64 - depth)
            lo = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            root = trie_links(k, lo, np.append(lo[1:], k.size), depth, budget).roots()
            members = np.flatnonzero(np.bincount(root, minlength=root.size)[root] > 1)
            if not members.size:
                continue
            # The smallest node of a set is its centre, so that tasks that see the same set send the same star.
            centre = np.full(root.size, np.iinfo(np.int64).max)
            np.minimum.at(centre, root[members], own[members])
            centre = centre[root[members]]
            out = own[members] != centre
            yield pa.RecordBatch.from_arrays([pa.array(own[members][out]), pa.array(centre[out])], ["src", "dst"])

    return dealt.repartition("turn", "prefix").select("turn", "key", "node").mapInArrow(run, "src long, dst long")


def _grouped(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """rows: ``doc_id``, ``node``, ...; nodes: ``node``, ``first_id``. Adds ``component_id``."""
    reach = nodes.join(connected(found), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    reach = staged(reach, "reach")
    # Roots of one node need no lookup; the others' smallest ids combine before the shuffle.
    least = staged(reach.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    named = staged(reach.join(least, "root", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")), "named")
    return rows.join(named, "node")


def near_duplicates(docs: DataFrame, size: int = 4, budget: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id reachable) of every row.

    The texts are read once. Fingerprints and ids are staged; each distinct fingerprint is a node, so copies need no
    links. The last join brings components back to rows from two staged tables, so AQE can split a hot fingerprint.
    """
    rows = staged(fingerprints(docs, size=size).withColumnRenamed("fingerprint", "node"), "fingerprints")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = links(nodes.select("node"), budget)
    return _grouped(rows, nodes, found).select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# -- near duplicates by similarity ------------------------------------------------------------------------------

#: Shingle size, likeness, differing bits of SimHash fingerprints, tables for pairs beyond these (bands), and the share of
#: pairs exactly at the likeness that may miss all bands.
SHINGLE, LIKENESS, BUDGET, BANDS, MISSED = 5, 0.8, 4, 24, 5e-4

#: Row numbers (of eight bytes) that are broadcast at most.
BROADCAST_ROWS = 1_000_000

#: Bytes of shingle sets that one task holds, twice that where two blocks of a larger unit meet.
FAMILY_BYTES = 16 << 20
#: A member of one in so many sets goes into the matrices; columns of these, rows and sets that are multiplied at once.
_MANY, _SLICE, _ROWS, _COLUMNS = 16, 2048, 128, 8192
_ROW = "__row"


def band_rows(likeness: float) -> int:
    """Minima in a band: the most, up to eight, at which pairs of this likeness miss all bands as rarely as allowed."""
    return max([r for r in range(1, 9) if (1 - likeness**r) ** BANDS <= MISSED], default=1)


def _shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and the n + 1 offsets."""
    data, offsets = buffer(texts)
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, doc = words(data, offsets, SPACED)
    word = hashes(data, starts, ends)
    first, last, owner = shingle_spans(np.arange(starts.size), np.arange(starts.size), doc, n, size)
    h = np.zeros(owner.size, np.uint64)
    for k in range(size):
        at = np.minimum(first + k, last)
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15) + np.where(first + k <= last, word[at], np.uint64(k)))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(n + 1))


def _bands(values: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """Per set ``BANDS`` keys, each of the minima of ``rows`` re-hashings; zeros for an empty set."""
    out = np.zeros((offsets.size - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if not some.size:
        return out
    seeds = mixed(np.arange(1, BANDS * rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    for band in range(BANDS):
        key = np.full(some.size, band + 1, np.uint64)
        for seed in seeds[band * rows : (band + 1) * rows]:
            key = mixed(key + np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * seed, offsets[some]))
        out[some, band] = key
    return out


class _Common:
    """How many members several sets have in common, for blocks of pairs: exact, by a product of 0/1 matrices for members
    that many of the sets have, and along lists of holders for the others. Members of one set only count for nothing."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = n = len(sets)
        owner = np.repeat(np.arange(n), [x.size for x in sets])
        _, member, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        many = count >= max(2, n // _MANY)
        some = many[member]
        column = np.cumsum(many) - 1
        self.dense = np.zeros((n, int(many.sum())), np.uint8)
        self.dense[owner[some], column[member[some]]] = 1
        few = ~some & (count[member] > 1)
        self.member, owner = member[few], owner[few]
        self.start = np.searchsorted(owner, np.arange(n + 1))
        self.holders = owner[np.argsort(self.member, kind="stable")]
        size = np.bincount(self.member, minlength=count.size)
        self.first = np.cumsum(size) - size
        self.size = size

    def of(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        both = np.zeros((rows.size, columns.size), np.float32)
        for lo in range(0, self.dense.shape[1], _SLICE):
            part = self.dense[:, lo : lo + _SLICE]
            both += part[rows].astype(np.float32) @ part[columns].astype(np.float32).T
        at = np.full(self.n, -1)
        at[columns] = np.arange(columns.size)
        for k, row in enumerate(rows):
            member = self.member[self.start[row] : self.start[row + 1]]
            size = self.size[member]
            total = np.cumsum(size)
            if member.size:
                place = np.arange(total[-1]) + np.repeat(self.first[member] - (total - size), size)
                column = at[self.holders[place]]
                both[k] += np.bincount(column[column >= 0], minlength=columns.size)
        return both


def jaccard_links(sets: list[np.ndarray], likeness: float, side: np.ndarray | None = None) -> Forest:
    """Sets of the sets that chains of links join; a link is a pair of this Jaccard likeness. ``side``: with two different
    values, only pairs across count.

    Sets are taken by size, and each is held against those that are not too large for the likeness. Rows whose whole
    block is in one set of the forest are not held against what is in it too, so a dense family costs about its size.
    """
    forest, sizes, common = Forest(len(sets)), np.array([x.size for x in sets], np.int64), _Common(sets)
    order = np.argsort(sizes, kind="stable")
    across = side is not None and len(set(side.tolist())) > 1
    rows, columns = (order[side[order] == v] for v in np.unique(side)) if across else (order, order)
    a, step = 0, 1
    while a < rows.size:
        own = rows[a : a + step]
        low, high = sizes[own[0]], sizes[own[-1]]
        first = np.searchsorted(sizes[columns], low * likeness - 1e-9) if across else a
        others = columns[first : np.searchsorted(sizes[columns], high / likeness + 1e-9, side="right")]
        root = forest.roots()
        if (root[own] == root[own[0]]).all():
            others = others[root[others] != root[own[0]]]
        for lo in range(0, others.size, _COLUMNS):
            some = others[lo : lo + _COLUMNS]
            both = common.of(own, some)
            i, j = np.nonzero(both + 1e-9 >= likeness * (sizes[own][:, None] + sizes[some][None, :] - both))
            forest.link(own[i], some[j])
        a, step = a + own.size, min(_ROWS, 2 * step)
    return forest


def _verified(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Stars of the links within each group; rows come sorted by ``group``, and a group is held at a time."""
    held: dict[int, tuple[int, bytes]] = {}
    group = None

    def stars() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        node = np.array(list(held), np.int64)
        root = jaccard_links([np.frombuffer(s, np.uint64) for _, s in held.values()], likeness, np.array([k for k, _ in held.values()])).roots()
        centre = np.full(root.size, np.iinfo(np.int64).max)
        np.minimum.at(centre, root, node)
        centre = centre[root]
        out = node != centre
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(centre[out])], ["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, nodes, sides, shingles = (batch.column(c) for c in ("group", "node", "side", "shingles"))
        for k, (g, node, side) in enumerate(zip(groups.to_pylist(), nodes.to_pylist(), sides.to_pylist(), strict=True)):
            if g != group:
                yield from stars()
                group, held = g, {}
            held.setdefault(node, (side, shingles[k].as_py()))
    yield from stars()


def _alike(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``node``, ``key`` of nodes whose SimHash fingerprints chains of links join to another node's; those joined have one key.

    nodes: ``node``, ``print``. Fingerprints are linked by the trie join of :func:`links`; nodes of one fingerprint
    need none.
    """
    prints = staged(nodes.groupBy(F.col("print").alias("node")).agg(F.count("*").alias("n")), "prints")
    roots = prints.join(connected(links(prints.select("node"), budget)), "node", "left").where("root is not null or n > 1")
    roots = staged(roots.select(F.col("node").alias("print"), F.coalesce("root", "node").alias("key")), "roots")
    return nodes.select("node", "print").join(roots, "print").select("node", "key")


def _units(members: DataFrame, family_bytes: int) -> DataFrame:
    """Which sets meet in one task: ``group``, ``side``, ``first_row``.

    A family of at most ``family_bytes`` is one unit. A larger one is one too if its buckets (members with an equal
    key) have more pairs in all than the family itself; else each bucket of two or more members is. A unit beyond
    ``family_bytes`` is cut into blocks by hash, and each pair of blocks is a group, in which only pairs across count.
    """
    families = members.groupBy("root").agg(F.sum("bytes").alias("family_size"), F.count("*").alias("n"))
    # Staged, so that joins read plain tables and AQE may split a family with very many members.
    large = staged(families.where(F.col("family_size") > family_bytes).withColumnRenamed("root", "of"), "large")
    own = members.join(large, F.col("root") == F.col("of"))
    dealt = own.select("of", "n", "node", "bytes", F.explode("keys").alias("key"))
    buckets = staged(dealt.groupBy("of", "key").agg(F.count("*").alias("b"), F.sum("bytes").alias("unit_bytes"), F.first("n").alias("n")).where("b > 1"), "buckets")
    by_bucket = staged(buckets.groupBy("of").agg(F.sum(F.col("b") * (F.col("b") - 1)).alias("pairs"), F.first("n").alias("n")).where(F.col("pairs") < F.col("n") * (F.col("n") - 1)).select("of"), "by_bucket")
    rows = ["unit", "unit_bytes", "node", F.col("first_id.row").alias("first_row")]
    apart = members.join(by_bucket, F.col("root") == F.col("of"), "left_anti")
    apart = apart.join(large, F.col("root") == F.col("of"), "left").select(F.col("root").alias("unit"), F.coalesce("family_size", F.lit(0)).alias("unit_bytes"), "node", "first_id").select(*rows)
    cut = members.join(by_bucket, F.col("root") == F.col("of")).select("of", "node", "first_id", F.explode("keys").alias("key"))
    cut = cut.join(buckets.select("of", "key", "unit_bytes"), ["of", "key"]).withColumn("unit", F.xxhash64("of", "key")).select(*rows)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("unit_bytes") / family_bytes)).cast("int")
    dealt = apart.unionByName(cut).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other")).alias("group"), (F.col("other") < F.col("block")).cast("int").alias("side"), "first_row")


def _near(rows: DataFrame, likeness: float, family_bytes: int) -> DataFrame:
    """rows: ``row`` (a number of its own), ``doc_id``, ``text``. Gives ``row``, ``doc_id`` and ``first``, the first of its
    group: a struct of ``no_id``, ``doc_id``, ``row``."""
    minima = band_rows(likeness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                values, offsets = _shingle_sets(part.column("text"))
                n = offsets.size - 1
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(_bands(values, offsets, minima).view(np.int64).ravel()))
                held = values.tobytes()
                sets = [held[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                node = np.array([xxhash.xxh64_intdigest(x, 42) for x in sets], np.uint64).view(np.int64)
                prints = majority(values, np.repeat(np.arange(n), np.diff(offsets)), n).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(node), pa.array(prints), keys, pa.array(sets, pa.binary())], ["row", "doc_id", "node", "print", "keys", "shingles"])

    texts = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = staged(texts.mapInArrow(run, "row long, doc_id long, node long, print long, keys array<long>, shingles binary"), "shingles", 16 << 20)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = made.groupBy("node").agg(F.min(first).alias("first_id"), F.any_value("print").alias("print"), F.any_value("keys").alias("keys"), F.max(F.length("shingles")).cast("long").alias("bytes"))
    nodes = staged(nodes, "nodes")
    alike = staged(_alike(nodes), "alike")
    dealt = alike.unionByName(nodes.select("node", F.explode("keys").alias("key")))
    centres = staged(dealt.groupBy("key").agg(F.min("node").alias("dst"), F.max("node").alias("other")).where("dst <> other").select("key", "dst"), "centres")
    families = connected(dealt.join(centres, "key").select(F.col("node").alias("src"), "dst").where("src <> dst").distinct())
    members = families.join(nodes, "node").join(alike, "node", "left").withColumn("keys", F.concat("keys", F.array_compact(F.array("key"))))
    units = staged(_units(staged(members.select("node", "root", "first_id", "keys", "bytes"), "members"), family_bytes), "grouped")
    few = units.count() <= BROADCAST_ROWS
    sets = made.join(F.broadcast(units) if few else units.hint("merge"), F.col("row") == F.col("first_row")).select("group", "node", "side", "shingles")
    found = sets.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _verified(batches, likeness), "src long, dst long")
    return _grouped(made.select("row", "doc_id", "node"), nodes.select("node", "first_id"), found).select("row", "doc_id", F.col("component_id").alias("first"))


def near_copies(docs: DataFrame, likeness: float = LIKENESS, family_bytes: int = FAMILY_BYTES) -> DataFrame:
    """``doc_id`` and ``component_id`` of documents by likeness of their sets of five-word shingles.

    Candidates are texts whose SimHash fingerprints, of the same shingles, the trie join links at ``BUDGET`` or fewer
    differing bits. One 64-bit fingerprint cannot hold a likeness of 0.8 within a budget that a trie prunes by (about 10 of
    64 bits differ), and no number of bits decides exactly. So texts with equal minima of re-hashed shingles in one of 24
    bands (at a likeness of exactly 0.8, in five minima each, 0.99993 of all pairs) are candidates too, and a candidate pair
    is a link if the Jaccard likeness of the two whole sets is at least ``likeness``. Texts with equal sets (copies) are one
    node.

    Candidates are first joined to families, whose sets meet in tasks as :func:`_units` deals them. Pairs that share no
    key are decided too where they meet.

    Null texts are empty; texts without a word are all one group. Null ids are after all others, and a group of them
    alone has a null component. Repeated rows are in one group and stay rows. An empty table gives no rows. A text of any
    length is read whole; its set is one cell. Other columns are not read.
    """
    found = _near(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), likeness, family_bytes)
    return found.select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, and of several the first by number.
    All columns are kept.

    Rows are numbered, staged, and decided by number, whatever their ids: a unique text under a repeated id stays, and
    of equal rows one does. Texts without a word (null ones too) are one group. Only numbers of rows that go are joined to
    the texts, as an anti-join. They are counted: up to ``BROADCAST_ROWS`` they are broadcast, so that no text moves;
    beyond that, both sides are shuffled by number.
    """
    numbered = staged(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    found = _near(numbered.select(F.col(_ROW).alias("row"), "doc_id", "text"), likeness, FAMILY_BYTES)
    gone = staged(found.where(F.col("row") != F.col("first.row")).select(F.col("row").alias("__gone")), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return numbered.join(F.broadcast(gone) if few else gone.hint("merge"), F.col(_ROW) == F.col("__gone"), "left_anti").select(*[numbered[c] for c in docs.columns])
