"""Line dedup, conversation repair and hard negatives against brute-force versions, and their odd cases."""

import hashlib
import itertools
import json
import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import conversation_repair as repairs
from quern.llm import bpe, hard_negatives, langid, licenses, line_dedup, queries, sharding, simhash
from quern.llm.components import connected

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


# -- 11 -----------------------------------------------------------------------------------------------------------


def lines_by_hand(rows, least_documents=3, least_chars=20):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    low = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(low(i))
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(holders[key(x)]) >= least_documents and max(holders[key(x)]) != low(i))]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=str)


COMMON, OTHER = "All rights reserved, whatever you do.", "é" * 19
ODD = [None, "", "\n\n", COMMON, f"  {COMMON.upper()}\r\nown line of this text, which stays\n{COMMON}", f"a\n{COMMON}\t\nb", OTHER, f"{OTHER}\n{OTHER}", f"x\n{OTHER}é", f"{OTHER}É\n{OTHER}é", f"{OTHER}é\x00", "w " * 400_000 + "\n" + COMMON, f"\n{COMMON}\n"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, f"{COMMON}\nno id", None), (12, COMMON, None), (12, COMMON, None), (3, f"{OTHER}é", None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"batch": F.lit(1), "shard": F.lit("s"), "keys": F.lit(2), "n_lines": F.lit("q"), "ids": F.lit(None).cast("string")})


@pytest.mark.parametrize("batch_bytes", [1, 200, 8 << 20])
def test_lines(odd_docs, batch_bytes):
    want = lines_by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    found = line_dedup.dedup(odd_docs, batch_bytes=batch_bytes).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=str) == want
    assert all(len(r.dropped) == r.n_dropped for r in found) and sum(w[3] for w in want) > 5


def test_lines_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup(docs, batch_bytes=1 << 14).collect()), key=str) == want


def test_lines_of_nothing_and_of_rows_without_ids(spark):
    assert line_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = spark.createDataFrame([(None, COMMON, None)] * 3, SCHEMA)
    assert [r.n_dropped for r in line_dedup.dedup(bare).collect()] == [0, 0, 0]


def test_a_line_that_most_documents_have_is_one_key_of_a_batch(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{COMMON}\ntext with a number of its own "), "id").alias("text"))
    batches = line_dedup._batches(docs, 20, 20_000)
    keys = batches.select(F.sum(F.length("keys") / 16)).first()[0]
    assert keys < 4000 + 2 * batches.count()
    assert line_dedup.dedup(docs, batch_bytes=20_000).agg(F.sum("n_dropped")).first()[0] == 3999


def test_an_index_serves_other_documents(spark):
    known = spark.createDataFrame([(k, COMMON, None) for k in range(5)], SCHEMA)
    index = line_dedup.build(known).cache()
    other = spark.createDataFrame([(4, f"{COMMON}\nnew text of a document", None), (9, f"another one of these lines\n{COMMON}", None)], SCHEMA)
    assert [(r.doc_id, r.dropped) for r in line_dedup.probe(other, index).orderBy("doc_id").collect()] == [(4, []), (9, [1])]
    assert line_dedup.probe(other, index, least_documents=6).where("n_dropped > 0").count() == 0
    assert line_dedup.probe(other, line_dedup.build(spark.createDataFrame([], SCHEMA))).where("n_dropped > 0").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_minimal_hash_numbers_all_keys(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 1 << 64, (n, 2), dtype=np.uint64), axis=0)
    if n > 100:
        keys[: n // 2, 0] = keys[0, 0]  # halves alone tell nothing apart
    hashed = line_dedup.MinimalHash.of(keys)
    assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys)))
    index = line_dedup.LineIndex.of(np.concatenate([keys, keys]), np.ones(2 * len(keys), np.uint32), np.arange(2 * len(keys), dtype=np.int64))
    again = line_dedup.LineIndex.from_bytes(index.to_bytes())
    counts, ids = again.look_up(keys)
    assert (counts == 2).all() and (np.sort(ids) == np.arange(len(keys), 2 * len(keys))).all()
    assert (again.look_up(rnd.integers(0, 1 << 64, (100, 2), dtype=np.uint64))[0] == 0).all()


# -- 12 -----------------------------------------------------------------------------------------------------------


def cheapest(rows):
    """rows: (role, text, must go, truncated). All ways of editing, as (cost, audit, repaired)."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            cost, audit, out, state, ok = 5 * sum(inserts), "", [], "", True
            for n, edit, row in itertools.zip_longest(inserts, edits, rows):
                for _ in range(n):
                    role = "assistant" if state == "u" else "user"
                    audit, state = audit + "I", role[0]
                    out.append(role + ":")
                if edit is None:
                    continue
                role, text, gone, truncated = row
                audit += edit
                if edit == "D":
                    cost += 2
                    continue
                if gone:
                    ok = False
                    break
                if edit == "R":
                    role, cost = ("assistant" if state == "u" else "user"), cost + 1
                cost += 5 * truncated
                if (state, role[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    ok = False
                    break
                state = role[:1]
                out.append(f"{role}:{text}")
            if ok and state in ("", "a"):
                way = (cost, audit, "\n".join(out))
                best = way if best is None else min(best, way)
    return best


def repaired_by_hand(rows):
    """rows: (conv_id, turn, role, text) after damage, or None for one that is dropped."""
    talks = defaultdict(list)
    for conv, turn, role, text, there in rows:
        talks[conv] += [(turn, role, text)] if there else []
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in talk:
            bare = text.strip(WHITE)
            kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                faults[kind] += 1
            marked.append((role, text, kind < 2, kind == 2))
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
        cost, audit, body = cheapest(marked)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def shown(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


TURNS = "conv_id long, turn long, role string, text string"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text, fate != 0)] * (2 if fate == 3 else 1)
    return out


def test_repairs_are_the_cheapest(spark):
    rnd = random.Random(3)
    rows = []
    for conv in range(260):
        turns = rnd.sample(range(8), rnd.randint(1, 4))
        rows += [(conv, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rnd.choice(["Yes.", "No!", "cut of", "  ", "", None, "Well.\n", "Yes."])) for t in turns]
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (-5, None, "assistant", "A."), (1 << 62, 3, "user", "x")]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"kind": F.lit(7), "at": F.lit("x"), "known": F.lit(None).cast("string"), "h1": F.lit(0), "fate": F.lit(3), "dropped": F.lit(True)})
    assert shown(repairs.repair(repairs.damaged(turns), "dropped")) == repaired_by_hand(damaged_by_hand(rows))
    whole = repaired_by_hand([(c, t, " " if r is None else r, " " if x is None else x, True) for c, t, r, x in rows])
    assert shown(repairs.repair(turns)) == whole
    assert shown(repairs.repair(turns.repartition(5), spill=8)) == whole


def test_real_conversations_with_gentle_brute_force(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = damaged_by_hand([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    count = defaultdict(int)
    for r in rows:
        count[r[0]] += r[4]
    short = {c for c, n in count.items() if n <= 4}
    found = shown(queries.op12_conversation_repair(spark, "/root/testdata/sf0.001"))
    assert found.keys() == count.keys() and len(short) > 5
    assert {c: found[c] for c in short} == repaired_by_hand([r for r in rows if r[0] in short])


def test_dropped_conversations_and_nothing(spark):
    turns = spark.createDataFrame([(7, 1, "user", "A.")], TURNS).withColumn("gone", F.lit(True))
    assert shown(repairs.repair(turns, "gone")) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repairs.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_a_giant_conversation_streams_and_spills(spark):
    n = 60_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id") % 50_000, F.lit(".")).alias("text"))
    row = repairs.repair(turns, spill=4096).first()
    assert (row.gaps, row.duplicate, row.illegal, row.cost) == (0, 10_000, 0, 20_000)
    assert row.audit == "K" * 50_000 + "D" * 10_000
    body = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:Turn {k}." for k in range(50_000))
    assert row.repaired_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_blocks_of_backpointers_are_read_from_the_end(monkeypatch):
    monkeypatch.setattr(repairs, "BLOCK", 12)
    rnd = random.Random(5)
    for n in (0, 1, 2, 3, 7, 50):
        rows = [(k, rnd.choice(["user", "assistant"]), "Yes.", False) for k in range(n)]
        texts = []
        for spill in (4, 12, 1 << 20):
            talk = repairs.Conversation(repairs._Steps(), spill)
            for r in rows:
                talk.add(*r)
            texts.append(talk.result())
        assert texts[0] == texts[1] == texts[2] and len(texts[0][6]) >= n


# -- 13 -----------------------------------------------------------------------------------------------------------


def mined_by_hand(rows, is_anchor):
    import math

    fine = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, a in fine:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, c)), j, k) for j, k, c in fine if j != i and len(c) == len(a))
        for p, j, k in [s for s in scored if s[2] == label][:5]:
            near = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, n + 1, s[1], -p, -s[0]) for n, s in enumerate(near)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(df, where="id % 50 = 0"):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, where).collect())


def test_negatives_by_hand(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(k, [rnd.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.3]) for _ in range(6)], rnd.randint(0, 3)) for k in range(400)]
    rows += [(400, None, 1), (450, [0.1] * 6, None), (None, [0.5] * 6, 1), (401, [float("nan")] + [0.5] * 5, 1), (402, [None] + [0.5] * 5, 1), (403, [float("inf")] + [0.5] * 5, 1), (500, [], 1), (501, [], 2), (550, [0.5] * 3, 1), (551, [0.4] * 3, 2), (552, [0.5] * 3, 1), (50, [0.5] * 6, 2), (60, [0.5] * 6, 2), (60, [0.5] * 6, 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit("x"), "number": F.lit(1), "vector": F.lit(2), "found": F.lit(3), "score": F.lit(4)})
    want = mined_by_hand([(i, label, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, label in rows], lambda i: i % 50 == 0)
    assert mined(df) == want and len(want) > 50
    for name, value in (("AT_ONCE", 7), ("BLOCK_BYTES", 300), ("WAITING", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(df.repartition(3)) == want


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mined(none) == [] and mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], VECTORS)) == []


@pytest.mark.parametrize("bits", [0, 13, 17, 26, 53, 60, 90])
@pytest.mark.parametrize("reach", [1, 300, 1 << 22, 1 << 39])
def test_packed_products_are_exact(bits, reach):
    rnd = np.random.default_rng(bits + reach)
    for n, m, d in ((1, 1, 1), (7, 3, 5), (40, 11, 64)):
        c, a = (rnd.integers(-reach, reach + 1, (k, d)).astype(np.float64) for k in (n, m))
        want = np.clip(c.astype(object).astype(int).astype(object) @ a.astype(np.int64).astype(object).T, -(1 << 63), (1 << 63) - 1)
        assert (hard_negatives.packed_scores(c, a, bits) == want.astype(np.int64)).all()
    assert hard_negatives.packed_scores(np.zeros((3, 0)), np.zeros((2, 0))).tolist() == [[0, 0]] * 3


def test_several_candidates_share_a_multiplication():
    c, a = np.full((10, 64), 128.0), np.full((3, 64), -128.0)
    c[0], a[0] = -128.0, 128.0
    assert hard_negatives.field_bits(c, a) * 2 <= hard_negatives.EXACT_BITS
    assert (hard_negatives.packed_scores(c, a) == c @ a.T).all()


def test_huge_components_neither_crash_nor_lose_order(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [2e38, 1.0], 1), (2, [1e30, 0.0], 2), (3, [1.7e308, 0.0], 2), (4, [-1e300, 0.0], 1)]
    out = mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert all(-(1 << 63) <= s < 1 << 63 for r in out for s in r[4:])


# -- near copies by row, and families of one template --------------------------------------------------------------


def words_of(rnd, n):
    return [f"w{rnd.randrange(1 << 30)}" for _ in range(n)]


def test_copies_go_by_row_and_unique_texts_stay(spark):
    rnd = random.Random(2)
    a, b, c = (" ".join(words_of(rnd, 40)) for _ in range(3))
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, c, "p"), (7, c, "p"), (None, b + " more", "q"), (None, "only here, with no id", "r"), (None, None, "s"), (8, "", "t"), (8, "  ", "t")]
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "node": F.lit("n"), "first": F.lit(2)}))
    assert sorted((r.doc_id, r.text, r.lang) for r in out.collect() if r.doc_id != 8 and r.doc_id is not None) == [(3, a, "x"), (5, b, "z"), (7, c, "p")]
    assert sorted(str(r.doc_id) + r.lang for r in out.collect() if r.doc_id == 8 or r.doc_id is None) == ["8t", "Noner"]
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("family_bytes", [1 << 40, 1 << 16, 1 << 12])
def test_links_of_template_pages_as_by_brute_force(spark, family_bytes):
    """500 pages alike in 0.7, some with a twin alike in 0.8 or more, however their family is dealt out."""
    rnd = random.Random(7)
    common = words_of(rnd, 170)
    texts = []
    for k in range(400):
        own = common + words_of(rnd, 36)
        texts.append(own)
        if k % 4 == 0:
            texts.append(own[:-rnd.randrange(12, 30)] + words_of(rnd, 20))
    sets = [np.unique(np.array([hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)], np.int64).view(np.uint64)) for w in texts]
    forest = simhash.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if both >= 0.8 * (sets[i].size + sets[j].size - both):
                forest.link(np.array([j]), np.array([i]))
    want = forest.roots().tolist()
    assert 20 < sum(k != r for k, r in enumerate(want)) < 120
    docs = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs, family_bytes=family_bytes).collect()}
    assert [found[k] for k in range(len(texts))] == want



def test_near_copies_take_the_trie_join_of_their_fingerprints(spark, monkeypatch):
    """Chains of at most four differing bits, and equal fingerprints, are candidates; before, only bands were."""
    prints = [0, 0b1111, 0b11111111, 0x5555555555555555, 0x5555555555555555, 0x0F0F0F0F00000000]
    nodes = spark.createDataFrame([(k + 1, v) for k, v in enumerate(prints)], "node long, print long")
    found = defaultdict(set)
    for r in simhash._alike(nodes).collect():
        found[r.key].add(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [4, 5]]
    seen, plain = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda nodes: seen.append([r.key for r in plain(nodes).collect()]) or plain(nodes))
    rnd = random.Random(5)
    a, b = words_of(rnd, 400), words_of(rnd, 400)
    rows = [(1, " ".join(a), "x"), (2, " ".join(a[:-1] + words_of(rnd, 1)), "x"), (3, " ".join(b), "x")]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3]
    assert len(seen) == 1 and len(seen[0]) == 2 and len(set(seen[0])) == 1


def test_common_members_are_counted_exactly():
    rnd = np.random.default_rng(6)
    for n, universe in ((2, 5), (40, 60), (90, 4000)):
        sets = [np.unique(rnd.integers(0, universe, rnd.integers(0, 50), dtype=np.uint64)) for _ in range(n)]
        common = simhash._Common(sets)
        want = [[np.intersect1d(a, b).size for b in sets[1::2]] for a in sets[::2]]
        assert (common.of(np.arange(0, n, 2), np.arange(1, n, 2)) == np.array(want)).all()


# -- Earlier operators ----------------------------------------------------------------------------------------------


def test_language_counts_are_bounded_over_all_languages(spark, monkeypatch):
    rows = [(f"wort {k} {chr(97 + k % 26) * 3} zu {chr(97 + k // 26 % 26) * 2} ende", f"l{k % 40}") for k in range(2000)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    whole = sorted(map(tuple, langid.gram_counts(df).collect()))
    monkeypatch.setattr(langid, "_HELD", 50)
    monkeypatch.setattr(langid, "pieces", lambda batch, column: (batch.slice(k, 20) for k in range(0, batch.num_rows, 20)))
    assert sorted(map(tuple, langid.gram_counts(df).collect())) == whole


def test_rows_equal_to_very_many_are_numbered_apart(spark, monkeypatch):
    rows = [(None, None)] * 3000 + [(7, "same")] * 1500 + [(k, f"text {k}") for k in range(2500)] + [(None, "")] * 500
    df = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0])
    plain = sorted(map(tuple, sharding.shard(df, 7).select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    monkeypatch.setattr(sharding, "STRETCH_BITS", 6)
    out = sharding.shard(df.repartition(3), 7).collect()
    assert sorted(x.row for x in out) == list(range(len(rows)))
    assert min(x.row for x in out if x.doc_id is None) == 2500 and min(x.row for x in out if x.doc_id == 7) <= 6000
    assert sorted(out, key=str) == sorted(sharding.shard(df.repartition(5), 7).collect(), key=str)
    count = lambda rows: sorted((x[0] or -1, x[1], x[2]) for x in rows)
    assert count(out) == count(plain)
    assert all(sharding.locate(x.row, len(rows), 7) == (x.shard, x.slot) for x in out)


@pytest.mark.parametrize(
    ("part", "setting"),
    [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("pre_tokenizer", None), ("model", {"type": "WordPiece"}), ("model", {"type": "BPE", "end_of_word_suffix": "</w>"}), ("model", {"type": "BPE", "ignore_merges": True}), ("post_processor", {"type": "TemplateProcessing"}), ("added_tokens", [{"id": 1, "content": "x", "lstrip": True}])],
)
def test_vocabularies_of_another_kind_are_refused(tmp_path, part, setting):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        given = json.load(f)
    if part == "model":
        setting = given["model"] | setting
    (tmp_path / "v.json").write_text(json.dumps(given | {part: setting}))
    with pytest.raises(ValueError, match="only"):
        bpe.Encoder(tmp_path / "v.json")


def test_long_licences_are_told_without_their_titles(spark):
    """Files of passages alone, wrapped, indented or as comments, with other paragraphs around them."""
    rows, want = [], []
    for k, (name, passages) in enumerate(sorted(licenses.PASSAGES.items())):
        for j, mark in enumerate(("", "   ", " * ")):
            shown = "\n\n".join(textwrap.fill(x, 70, initial_indent=mark, subsequent_indent=mark) for x in (passages[j % len(passages)], "Something else that nobody has said before."))
            rows.append((3 * k + j, f"d{k}/LICENSE{j}", shown))
            want.append(name)
    rows += [(1000 + k, f"e/{k}.c", f"A copy of the work number {k} may be made by you and by any other person") for k in range(200)]
    got = {x.doc_id: x.own_license for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[k] for k in range(len(want))] == want
    assert not any(got[1000 + k] for k in range(200))


@pytest.mark.parametrize("crowd, broadcast", [(40, simhash.BROADCAST_ROWS), (120, -1)])
def test_crowded_subtrees_are_dealt_again(spark, crowd, broadcast, monkeypatch):
    """Fingerprints that begin alike, families among them, against all pairs; several rounds of dealing."""
    rng = np.random.default_rng(29)
    flip = lambda b, k: b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64))
    head = np.uint64(0xABCDE << 44)
    base = rng.integers(0, 1 << 44, 250, dtype=np.uint64) | head
    family = [flip(base[0], k) for k in (1, 2, 3) for _ in range(80)]
    keys = np.unique(np.concatenate([base, [flip(b, k) for b in base[1:90] for k in (3, 4, 5)], family, rng.integers(0, 1 << 64, 60, dtype=np.uint64)]))
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    forest = simhash.Forest(keys.size)
    forest.link(*np.nonzero(np.triu(near, 1)))
    signed = keys.view(np.int64)
    nodes = spark.createDataFrame([(int(k),) for k in signed], "node long")

    def groups(pairs):
        held = {}
        for k, r in pairs:
            held.setdefault(r, []).append(int(k))
        return sorted(sorted(g) for g in held.values() if len(g) > 1)

    want = groups(zip(signed, forest.roots().tolist(), strict=True))
    rounds, plain = [], simhash._subtrees
    monkeypatch.setattr(simhash, "_subtrees", lambda *a: rounds.append(1) or plain(*a))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    assert groups((x.node, x.root) for x in connected(simhash.links(nodes, 4, crowd=crowd)).collect()) == want
    assert len(rounds) > 1
