"""Operators against brute-force versions, round trips, and the cases that the given tables do not have."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe, components, decontaminate, edit_tokens, fingerprint, langid, licenses, ngram_lm, queries, sharding, simhash, warc
from quern.llm._bytes import ALNUM, SPACED, buffer, hashes, joined, pieces, words
from quern.llm.components import connected
from quern.llm.elias_fano import EliasFano

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 5_000
AWKWARD = [None, "", "   \n", "a", "A b", "one two three four five six", "ünï çödé 漢字 🙂", LONG, "\x00 nul \x7f", "one two three four five six", "THE the thé", "<|endoftext|> x<|endoftext|>"]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id", "fr", None, None), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1)]
    # Extra columns with names that the operators use inside.
    return spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "component_id": F.lit(1), "fingerprint": F.lit("y"), "id": F.lit(9), "bucket": F.lit(2), "shard": F.lit(3), "sent": F.lit(True), "held": F.lit(None).cast("boolean"), "score": F.lit(0.0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# -- bytes --------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB é\t\n漢") for _ in range(rnd.randint(0, 40))) for _ in range(200)] + [None, "", "z" * 700]
    data, offsets = buffer(pa.array(texts))
    starts, ends, owner = words(data, offsets, SPACED)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    want = [(k, w.encode()) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(owner.tolist(), found)) == want
    h = hashes(data, starts, ends)
    assert len(set(zip(h.tolist(), found))) == len(set(found)) == len(set(h.tolist()))
    text, a, b = joined(data, starts, ends)
    assert [text[x:y].tobytes() for x, y in zip(a, b)] == found
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert pa.Table.from_batches(pieces(batch, "text", 64))["text"].to_pylist() == texts


def test_elias_fano_successor():
    rnd = np.random.default_rng(2)
    for universe in (10, 1 << 20, 1 << 48):
        v = np.unique(rnd.integers(0, universe, 3000, dtype=np.uint64))
        e = EliasFano(v, universe)
        q = np.concatenate([v, rnd.integers(0, universe, 3000, dtype=np.uint64)])
        at, equal = e.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


# -- 1 ------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.98 * len(found)
    assert all(0 <= x.score <= 1 for x in found)


def test_language_edges(docs, empty):
    model = langid.train(docs.select("text", "lang"))
    out = langid.predict(docs, model).collect()
    assert len(out) == docs.count()
    by = {x.doc_id: x for x in out}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[0].score == 0
    assert by[6].lang_pred in ("en", "fr")
    none = langid.train(empty.select("text", "lang"))
    assert {x.lang_pred for x in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {0, 1, 2}.isdisjoint(x.doc_id for x in kept.collect())


def test_language_masks_have_no_false_negatives():
    names = ["a", "b"]
    f = langid.Filters(names, np.zeros((1 << 12, 1), np.uint64))
    h = np.random.default_rng(0).integers(0, 1 << 63, 200, dtype=np.uint64)
    for slot in f.slots(h[:100]):
        np.bitwise_or.at(f.masks, slot, np.uint64(2))
    assert (f.containing(h[:100]) & np.uint64(2)).all()


# -- 2 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = sharding.Permutation(n, 7)
    place = p.place(np.arange(n))
    assert sorted(place) == list(range(n)) and (p.row(place) == np.arange(n)).all()


def test_shards(docs, empty, real):
    for df in (docs, real):
        out = sharding.shard(df, 7).collect()
        sizes = [sum(x.shard == k for x in out) for k in range(7)]
        assert len(out) == df.count() and max(sizes) - min(sizes) <= 1
        for k in range(7):
            assert sorted(x.slot for x in out if x.shard == k) == list(range(sizes[k]))
        assert all(sharding.locate(x.row, len(out), 7) == (x.shard, x.slot) and sharding.row_at(x.shard, x.slot, len(out), 7) == x.row for x in out)
    assert sorted(out) == sorted(sharding.shard(real.repartition(5), 7).collect())
    own = {x.doc_id: x for x in sharding.shard(docs, 3).collect()}
    assert own[0]["size"] == 16 and own[0].text_crc32 == 0 and own[6].text_crc32 == zlib.crc32(AWKWARD[6].encode())
    assert sharding.shard(empty, 3).count() == 0


def test_written_shards(spark, real, tmp_path):
    sharding.write_shards(real, f"file://{tmp_path}/s", 3)
    assert spark.read.parquet(f"file://{tmp_path}/s").groupBy("shard").count().count() == 3


# -- 3 ------------------------------------------------------------------------------------------------------------


def test_archive(spark, tmp_path):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, small), (4, "http://d", small), (5, "u", None), (6, "u", ""), (7, "u", big + "!"), (2, "http://b\r\nX: y", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path)
    out = back.collect()
    assert len(out) == len(rows) and all(x.verified for x in out)
    by = {x.page_id: x for x in out}
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[2].record_type == "response" and by[2].refers_to is None
    assert by[None].refers_to == 2 and {by[k].record_type for k in (3, 4, 5, 6, 7)} == {"response"}
    assert by[1].payload_bytes == 1200 and by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and bytes(by[1].payload) == big.encode()
    assert by[2].url == "http://b\r\nX: y" and by[3].url is None
    stored = spark.read.parquet(f"{path}/payloads").count()
    assert stored == 4
    record = {x.page_id: bytes(x.record) for x in warc.record_bytes(back).collect()}
    assert record[7].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record[7].endswith(b"\r\n\r\n" + (big + "!").encode() + b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:2>" in record[1] and record[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    warc.write_archive(pages.limit(0), f"{path}0")
    assert warc.read_archive(spark, f"{path}0").count() == 0


# -- 4 ------------------------------------------------------------------------------------------------------------


def test_archive_of_equal_pages_without_ids(spark, tmp_path):
    rows = [(None, f"u{k}", "x" * 2000) for k in range(3)] + [(1, "u", "y" * 2000)]
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    back = warc.read_archive(spark, path).collect()
    assert sorted(x.url for x in back) == ["u", "u0", "u1", "u2"] and {x.record_type for x in back} == {"response"}
    assert spark.read.parquet(f"{path}/payloads").count() == 2


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "r/LICENSE", mit), (2, "r/a/b/x.py", "code here\nand more"), (3, "r/a/COPYING.txt", "Foo\n\n" + gpl), (4, "r/a/b/y.py", "text\n# " + gpl), (5, "q/z.py", None), (6, None, mit), (7, "r/a/b/LICENSE", "nothing of the kind"), (8, "top.py", LONG), (8, "top.py", LONG)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir", F.lit("clash"))
    out = {x.doc_id: x for x in licenses.scan(files).collect()}
    assert licenses.scan(files).count() == len(rows)
    assert out[1].own_license == "MIT" and out[1].own_score == 1.0
    assert out[2].own_license is None and (out[2].license, out[2].inherited_from) == ("GPL-3.0", "r/a/COPYING.txt")
    assert out[4].own_license == out[4].license == "GPL-3.0"
    assert out[5].license is None and out[6].license == "MIT" and out[6].inherited_license is None
    assert out[7].own_license is None and out[8].license is None
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_scores_are_tfidf_cosines(spark, real):
    files = real.select("doc_id", F.lit("a/b").alias("path"), "text")
    got = {x.doc_id: x.score for x in licenses.own_licenses(files).collect()}
    rows = real.select("doc_id", "text").collect()
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    texts = [t for n in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[n]]
    vocabulary = {w for t in texts for w in tokens(t)}
    df = {w: 0 for w in vocabulary}
    for r in rows:
        for w in vocabulary & set(tokens(r.text)):
            df[w] += 1
    weight = lambda w: 1 + np.log((1 + len(rows)) / (1 + df.get(w, 0)))

    def vector(t):
        return {w: tokens(t).count(w) * weight(w) for w in set(tokens(t))}

    known = [vector(t) for t in texts]
    length = lambda v: np.sqrt(sum(x * x for x in v.values()))
    for r in rows[:40]:
        best = 0.0
        for s in {*r.text.split("\n"), *r.text.split("\n\n"), r.text}:
            v = vector(s)
            if v:
                best = max([best, *(sum(v.get(w, 0) * x for w, x in k.items()) / length(v) / length(k) for k in known)])
        assert got[r.doc_id] == pytest.approx(best, abs=1e-6)


# -- 5 ------------------------------------------------------------------------------------------------------------


def brute_lm(rows, mu=ngram_lm.MU):
    from collections import Counter

    tokens = [[*split(t), "\0"] for _, t, _ in rows]
    train = [w for w, (_, _, held) in zip(tokens, rows) if not held]
    c, b = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["\1", *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    one = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for w in tokens:
        s = sum(np.log10((b[p] + mu * one(p[1])) / ((len(train) if p[0] == "\1" else c[p[0]]) + mu)) for p in zip(["\1", *w[:-1]], w))
        out.append((len(w), sum(c[x] > 0 for x in w), n, sum(np.log10(one(x)) for x in w), s))
    return out


def test_lm(spark, docs, empty, real):
    rows = real.select("doc_id", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    got = {x.doc_id: x for x in ngram_lm.score(rows).collect()}
    local = rows.collect()
    for r, (n, known, total, base, score) in zip(local, brute_lm([tuple(x) for x in local])):
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (n, known, total, r.held_out)
        assert x.base_score == pytest.approx(base, abs=1e-6) and x.score == pytest.approx(score, abs=2e-4 * n + 1e-3)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    edge = ngram_lm.score(docs.withColumn("held_out", F.col("doc_id") % 2 == 0)).collect()
    assert len(edge) == docs.count() and {x.doc_id: x.n_tokens for x in edge}[0] == 1
    assert ngram_lm.score(empty.withColumn("held_out", F.lit(False))).count() == 0
    none = ngram_lm.score(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(x.n_known == 0 and x.train_tokens == 0 and np.isfinite(x.score) for x in none)


# -- 6 ------------------------------------------------------------------------------------------------------------


def test_edited_counts_are_exact():
    made, rnd = bpe.encoder(queries.vocabulary()), random.Random(5)
    letters = [*"ab  \n\t1're!é漢", "<|endoftext|>", "'ll"]
    some = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    for _ in range(60):
        text = some(800)
        tree = edit_tokens.CountTree(made, text)
        for _ in range(5):
            at, gone, put = rnd.randint(0, len(text) + 2), rnd.randint(0, rnd.choice([2, 90])), some(rnd.choice([1, 60]))
            a = min(at, len(text))
            text = text[:a] + put + text[a + gone :]
            tree.edit(at, gone, put)
            assert tree.text == text and tree.total == len(made.encode(text)) // 4
            assert list(map(tuple, tree.parts().tolist())) == list(edit_tokens.pre_tokens(made, text, 0))
        at = rnd.randint(0, len(text))
        done, count = 0, 0
        for n, c in edit_tokens.pre_tokens(made, text, 0):
            done += n
            count += c if done <= at else 0
        assert tree.before(at) == count
        again = edit_tokens.CountTree.opened(made, text, tree.stored())
        assert again.total == tree.total and again.encoded == 0 and again.stored() == tree.stored() == edit_tokens.CountTree(made, text).stored()


def test_edits_encode_little(docs, empty, real):
    vocabulary = queries.vocabulary()
    made = bpe.encoder(vocabulary)
    out = edit_tokens.apply_edits(real.withColumn("edits", edit_tokens.own_edits(F.col("text"))), vocabulary).collect()
    assert all(x.edited_tokens == len(made.encode(x.edited)) // 4 for x in out)
    assert sum(x.encoded_chars for x in out) < 0.3 * sum(len(x.edited) for x in out)
    # From stored trees, the same; and the trees that come out are those of the edited texts.
    stored = edit_tokens.apply_edits(edit_tokens.trees(real, vocabulary).withColumn("edits", edit_tokens.own_edits(F.col("text"))), vocabulary).collect()
    assert sorted(stored) == sorted(out)
    assert all(x.edited_tree == edit_tokens.CountTree(made, x.edited).stored() for x in stored)
    kept = edit_tokens.trees(docs, vocabulary).withColumn("edits", F.lit(None))
    rows = edit_tokens.apply_edits(kept, vocabulary).collect()
    assert len(rows) == docs.count() and all(x.encoded_chars == 0 and x.n_tokens == x.edited_tokens for x in rows)
    assert edit_tokens.apply_edits(empty.withColumn("edits", F.lit(None)), vocabulary).count() == 0


# -- 7 ------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, empty, real):
    rows = sorted(real.collect())
    out = {x.doc_id: x for x in fingerprint.edited(real).collect()}
    kinds = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for i in range(max(1, len(w) - 4)) if w}
    for k, r in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)].text, len(r.text)
        changed = r.text[: n - n // 4] + after[: n // 4]
        x = out[r.doc_id]
        assert x.n_chars == n and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = kinds(r.text), kinds(changed), kinds(after)
        assert x.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.2) and x.near_next == pytest.approx(len(a & c) / len(a | c), abs=0.1)
    edge = fingerprint.edited(docs).collect()
    assert len(edge) == docs.count()
    by = {x.doc_id: x for x in edge}
    assert by[0].own == [] and by[0].n_chars == 0 and by[0].near_next == 1.0 and by[3].near_edited >= 0
    assert fingerprint.edited(empty).count() == 0
    alone = fingerprint.edited(docs.where("doc_id = 5")).collect()[0]
    assert alone.near_next == 1.0


def test_sketches_merge_and_count(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(a, b))) for i, (a, b) in enumerate([(0, 3000), (1500, 4500), (0, 4500), (0, 50)])]
    s = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    a, b, both, few = (x.sketch for x in sorted(s))
    df = spark.createDataFrame([(a, b, both, few)], "a array<long>, b array<long>, c array<long>, d array<long>")
    c = F.col
    x = df.select(fingerprint.merged(c("a"), c("b")).alias("m"), fingerprint.distinct_shingles(c("a")).alias("n"), fingerprint.distinct_shingles(c("d")).alias("few"), fingerprint.resemblance(c("a"), c("b")).alias("r"), fingerprint.containment(c("d"), c("a")).alias("in_"), fingerprint.containment(c("a"), c("c")).alias("in2")).collect()[0]
    # Only the shingles across the seam are missing from the parts; they may be in the whole's sketch.
    assert len(set(x.m) & set(both)) >= 126
    assert x.n == pytest.approx(2996, rel=0.3) and x.few == 46 and x.r == pytest.approx(1 / 3, abs=0.15) and x.in2 > 0.8


# -- 8 ------------------------------------------------------------------------------------------------------------


def test_bpe_as_the_library(docs, empty, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    rnd = random.Random(9)
    odd = ["".join(rnd.choice(["a", " ", "\n", "\t", "é", "漢", "🙂", "'s", "1", "!", "ſ", " ", "‍", "zzz", "<|endoftext|>"]) for _ in range(80)) for _ in range(300)] + ["a" * 3000, " " * 3000, "=" * 999]
    made = bpe.encoder(queries.vocabulary())
    for text in odd + [x for x in AWKWARD if x] + [x.text for x in real.collect()]:
        want = t.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(made.encode(text), "<u4")
        assert got.tolist() == want
        assert made.decode(got.astype(np.int64)).decode("utf-8", "replace") == t.decode(want, skip_special_tokens=False)
    out = {x.doc_id: x for x in bpe.digests(docs, queries.vocabulary()).collect()}
    assert out[0].n_tokens == 0 and out[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and out[11].n_tokens == 3
    rows = bpe.encode(docs, queries.vocabulary()).collect()
    assert {x.doc_id: x.decoded for x in rows if x.doc_id is not None} == {i: (x or "") for i, x in enumerate(AWKWARD)}
    assert bpe.digests(empty, queries.vocabulary()).count() == 0


def test_pieces_equal_merges():
    made, rnd = bpe.encoder(queries.vocabulary()), random.Random(3)
    for _ in range(500):
        piece = "".join(rnd.choice("abcdeinstABé ") for _ in range(rnd.randint(1, 30))).encode()
        assert made.piece(piece) == made.merged(piece)


# -- 9 ------------------------------------------------------------------------------------------------------------


def reach(ids, near):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def simhash_of(text):
    w = split(text)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, empty, real):
    base = real.collect()[:80]
    rnd = random.Random(4)
    rows = [(x.doc_id, x.text) for x in base]
    for k, x in enumerate(base[:40]):
        w = x.text.split(" ")
        for m in range(k % 4):
            w[rnd.randrange(len(w))] = f"new{m}"
        rows.append((10_000 + k, " ".join(w)))
    prints = {i: simhash_of(t) for i, t in rows}
    want = reach([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.fingerprint for x in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {x.doc_id: x.component_id for x in got} == want and len(set(want.values())) < len(rows)
    edge = simhash.near_duplicates(docs).collect()
    by = {x.doc_id: x for x in edge}
    assert len(edge) == docs.count() and by[0].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == 0 and by[9].component_id == 5
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n,budget", [(1, 4), (300, 4), (3000, 2)])
def test_trie_links_are_whole(n, budget):
    rnd = np.random.default_rng(n)
    centre = rnd.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)
    keys = rnd.choice(centre, n)
    for _ in range(3):
        keys ^= np.uint64(1) << rnd.integers(0, 64, n, dtype=np.uint64)
    keys = np.unique(keys)
    root = simhash.trie_links(keys, np.array([0]), np.array([keys.size]), 0, budget).roots()
    forest = simhash.Forest(keys.size)
    for i in range(keys.size):
        j = np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= budget) + i + 1
        forest.link(np.full(j.size, i), j)
    assert (root == forest.roots()).all()


def test_chain_and_star_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(5, 5), (None, 3)]
    out = {x.node: x.root for x in components.connected(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert out == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 150)}
    assert components.connected(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_copies_by_likeness(spark, real):
    rows = [(x.doc_id, x.text) for x in real.collect() if x.n_chars > 1500][:60]
    rnd = random.Random(8)
    twins = []
    for i, t in rows:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 100)):  # about a twentieth of the shingles
            w[rnd.randrange(len(w))] = "changed"
        twins.append((i + 100_000, " ".join(w)))
    found = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows + twins, "doc_id long, text string")).collect()}
    caught = sum(found[i + 100_000] == found[i] for i, _ in rows)
    assert caught >= 0.95 * len(rows)
    shingles = {i: {tuple(w[k : k + 5]) for w in [split(t)] for k in range(max(1, len(w) - 4))} for i, t in rows}
    for i, _ in rows:
        if found[i] != i:
            assert len(shingles[i] & shingles[found[i]]) / len(shingles[i] | shingles[found[i]]) > 0.6


def five_words(w):
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("family_bytes", [simhash.FAMILY_BYTES, 1])
def test_near_copies_are_exact(spark, family_bytes):
    """Replaced passages and tails at 0.80 to 0.85 are linked, pairs at 0.70 to 0.79 are not."""
    rnd = random.Random(11)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 20_000}"
    rows, near, far = [], [], []
    for k in range(240):
        n = rnd.choice((60, 200, 800))
        w = [word() for _ in range(n)]
        low, high = ((0.8, 0.85), (0.7, 0.79))[k % 4 == 3]
        want = rnd.uniform(low, high)
        if k % 2:
            twin = w + [word() for _ in range(round(n / want) - n)]
        else:
            m = round(n * (1 - want) / (1 + want)) - 2
            at = rnd.randrange(n - m)
            twin = w[:at] + [word() for _ in range(m)] + w[at + m :]
        likeness = jaccard(w, twin)
        rows += [(k, " ".join(w)), (k + 1000, " ".join(twin))]
        if 0.8 <= likeness < 0.86:
            near.append(k)
        elif 0.69 < likeness < 0.8:
            far.append(k)
    found = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), family_bytes=family_bytes).collect()}
    assert len(near) > 100 and len(far) > 40
    assert [k for k in near if found[k + 1000] != k] == [] and [k for k in far if found[k + 1000] != k + 1000] == []


def test_jaccard_links_join_all_pairs_of_a_bucket():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.choice(60, 40, replace=False).astype(np.uint64)) for _ in range(60)] + [np.arange(40, dtype=np.uint64)] * 3
    root = simhash.jaccard_links(sets, 0.6).roots()
    forest = simhash.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j])):
                forest.link(np.array([j]), np.array([i]))
    assert (root == forest.roots()).all()


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    ids = [x.doc_id for x in kept.collect()]
    assert kept.columns == docs.columns and 5 in ids and 9 not in ids and None in ids and ids.count(3) == 1


def test_keep_one_is_the_same_without_a_broadcast(docs, monkeypatch):
    """Beyond ``BROADCAST_ROWS`` dropped ids, both sides are shuffled by number, with the same result."""
    ids = lambda df: sorted((x.doc_id for x in df.select("doc_id").collect()), key=str)
    want = ids(simhash.keep_one(docs))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    shuffled = simhash.keep_one(docs)
    assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert ids(shuffled) == want


# -- 10 -----------------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, empty):
    items = [(1, "one two three"), (2, "Word word WORD word word word word word word word word word"), (10, "a"), (11, ""), (12, None), (None, "five six"), (3, "漢字!"), (3, "漢字!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    for block in (1 << 20, 1):
        out = decontaminate.summary(decontaminate.scan(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), benchmark, 10, block)).collect()
        for x in out:
            n, hit, found = brute_hits(AWKWARD[x.doc_id], known)
            assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (n, hit, len(found), decontaminate.digest(found), hit > 0)
    assert decontaminate.summary(decontaminate.scan(docs, benchmark)).count() == docs.count()
    assert {x.n_hit for x in decontaminate.summary(decontaminate.scan(docs, benchmark.limit(0))).collect()} == {0}
    assert decontaminate.scan(empty, benchmark).count() == 0
    kept = {x.doc_id: x for x in decontaminate.remove(docs, benchmark).collect()}
    assert 7 not in kept and kept[8].text == AWKWARD[8]
    rest = spark.createDataFrame([(1, "Start here, ONE two, three; then much more of it goes on.", 57)], "doc_id long, text string, n_chars long")
    cut = decontaminate.remove(rest, benchmark).collect()[0]
    assert cut.text == "Start here, ; then much more of it goes on." and cut.n_chars == len(cut.text)


def test_blocks_of_a_benchmark_do_not_change_results(spark, docs):
    items = [(1, "one two three"), (2, "a"), (3, "five six"), (4, "b c d e f g h i j k l m"), (5, "k l m n o p q r s t u v"), (6, "z y x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    fill = " ".join(f"w{k}" for k in range(40))
    more = [(50, f"{fill} b c d e f g h i j k l m n o p q r s t u v end", None, None, 0), (50, "one two three five six zz yy xx vv uu", None, None, 0), (51, "one two three five six seven", None, None, 0), (None, f"{fill} z one two three y x", None, None, 0), (None, "a b b", None, None, 0)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA))
    ordered = lambda df: sorted(map(repr, df.collect()))
    assert ordered(decontaminate.scan(rows, benchmark, block_bytes=1)) == ordered(decontaminate.scan(rows, benchmark))
    whole = ordered(decontaminate.remove(rows, benchmark))
    assert ordered(decontaminate.remove(rows, benchmark, block_bytes=1)) == whole
    assert len(whole) < rows.count()


# -- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns, name
    texts = [x.text for x in out.collect()]
    assert len(texts) == len(set(texts)) and 0.7 * docs.count() < len(texts) < docs.count()
    assert corpus_pipeline.run(spark, sf).count() == len(texts)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_of_odd_rows(spark, docs, real, tmp_path):
    """Null, empty, repeated and very long texts, null and repeated ids, columns with names used inside: each stage gives
    rows of the stage before, and texts in a language that is known are kept once."""
    import corpus_pipeline

    extra = [c for c in docs.columns if c not in real.columns]
    plain = real.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000)
    twice = plain.where("doc_id < 1003").withColumn("doc_id", F.lit(None).cast("long"))
    huge = plain.where("doc_id = 1003").withColumns({"doc_id": F.lit(5000).cast("long"), "text": F.repeat(F.concat("text", F.lit(" ")), F.lit(3000))})
    other = plain.unionByName(twice).unionByName(huge)
    every = docs.unionByName(other.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in extra]))
    folder = f"file://{tmp_path}"
    every.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, before, folder).write.parquet(path)
        after = spark.read.parquet(path)
        stages[name] = after
        key = ["doc_id"] if name in ("decontamination", "tokens") else before.columns
        assert after.select(key).exceptAll(before.select(key)).count() == 0, name
        before = after
    assert all(any(c.isalpha() for c in x.text) for x in stages["language"].collect())
    ids = [x.doc_id for x in stages["tokens"].select("doc_id").collect()]
    assert 5000 in ids or 1003 in ids
    assert sorted(map(str, ids)) == sorted(str(x.doc_id) for x in corpus_pipeline.run(spark, folder).collect())


# -- by brute force, and hot or odd keys ---------------------------------------------------------------------------


def letter_trigrams(text):
    """Trigrams of letters in lower case, with one space for what is between; spaces only at the ends."""
    out = " "
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            out += low if len(low) == 1 else c
        elif out[-1] != " ":
            out += " "
    out += "" if out[-1] == " " else " "
    return [out[k : k + 3] for k in range(len(out) - 2) if out[k + 1] != " "]


def test_languages_by_brute_force(spark, real):
    rows = [(x.text, x.lang) for x in real.select("text", "lang").collect()] + [("zwei zwei", None), (None, "en"), ("", "fr"), ("aa bb", "xx"), ("aa bb", "yy")]
    df = spark.createDataFrame(rows, "text string, lang string")
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(letter_trigrams(text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = lambda x, g: counts[x][g] / total[x]
    own = {x: set() for x in counts if total[x]}
    for g in set().union(*counts.values()):
        most = max(share(x, g) for x in own)
        for x in own:
            if counts[x][g] and share(x, g) >= langid.LEAST_SHARE and share(x, g) >= langid.CONTRAST * most:
                own[x].add(g)
    model = langid.train(df)
    assert model.languages == sorted(own)
    texts = [t for t, _ in rows]
    got, _, _, totals = model.predict(pa.array(texts, pa.string()))
    for text, lang, n in zip(texts, got, totals, strict=True):
        grams = letter_trigrams(text)
        assert n == len(grams)
        hits = {x: sum(g in own[x] for g in grams) for x in sorted(own)}
        if not any(c.isalpha() for c in text or ""):
            assert lang == "und"
        elif len(grams) > 50 or text == "aa bb":
            # A few false hits of the filters are taken off as expected numbers; of equal languages the first by name wins.
            assert lang == max(hits, key=lambda x: (hits[x], -sorted(own).index(x)))


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(f"{a}{b}q {a}{b}x {b}{a}w", f"l{k:03}") for k, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqr")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 80 and model.masks.shape[1] == 2
    assert model.predict(pa.array([t for t, _ in rows]))[0] == [x for _, x in rows]


def test_language_stage_drops_junk_and_keeps_the_rest(spark, real):
    rng = random.Random(3)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300)) for _ in range(50)] + [" ".join("".join(rng.choice("абвгдежзик") for _ in range(6)) for _ in range(40)) for _ in range(20)] + ["12345 --- 678", "", None]
    model = langid.train(real.select("text", "lang"))
    bad = spark.createDataFrame([(k, t) for k, t in enumerate(junk)], "doc_id long, text string")
    assert langid.keep_known(bad, model).count() == 0
    assert langid.keep_known(real, model).count() == real.count()


def test_urls_of_an_archive_are_exact(spark, tmp_path):
    given = ["http://a/b?c=%0A", "http://x\r\nWARC-Type: revisit", "", None, "a%\nb%0D", "é\t"]
    pages = spark.createDataFrame([(k, u, "x" * (500 * k), 1) for k, u in enumerate(given)], "page_id long, url string, html string, extra int")
    warc.write_archive(pages, str(tmp_path / "a"))
    back = {x.page_id: x for x in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert [back[k].url for k in range(len(given))] == given
    assert all(x.verified and x.record_type == "response" for x in back.values())


@pytest.mark.parametrize("ids", [[*range(2999), 10**15], [None] * 1500 + list(range(1500)), [7] * 1500 + list(range(1500)), [5] * 3000])
def test_next_texts_and_buckets_of_odd_ids(spark, ids):
    rows = [(i, f"t{k % 2500}", k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = fingerprint.with_next(df).collect()
    assert len(got) == len(rows) and all(x.next_text is not None for x in got)
    # Each text is next once for each time that it occurs, and never that of a lower id, but once around.
    assert Counter(x.next_text for x in got) == Counter(t for _, t, _ in rows)
    low = lambda i: -(10**18) if i is None else i
    of = {}
    for i, t, _ in rows:
        of.setdefault(t, []).append(low(i))
    assert sum(max(of[x.next_text]) < low(x.doc_id) for x in got) <= 1
    keyed = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    sizes = [x["count"] for x in keyed.groupBy(fingerprint.buckets_by_rank(keyed, len(rows)).alias("b")).count().collect()]
    assert max(sizes) < 1500


@pytest.mark.parametrize("agreeing", [1, 2, 3])
def test_links_are_the_same_for_each_choice_of_blocks(spark, agreeing):
    rng = np.random.default_rng(agreeing)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for b in base for k in (3, 4, 5)]
    keys = np.unique(np.concatenate([base, np.array(near, np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]]))
    nodes = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "node long")
    found = {(x.node): x.root for x in connected(simhash.links(nodes, 4, agreeing)).collect()}
    forest = simhash.Forest(keys.size)
    i, j = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4, 1))
    forest.link(i, j)
    root = forest.roots()
    groups = lambda pairs: sorted(sorted(g) for g in pairs.values() if len(g) > 1)
    want, got = {}, {}
    for k, r in zip(keys.view(np.int64).tolist(), root.tolist(), strict=True):
        want.setdefault(r, []).append(k)
    for k, r in found.items():
        got.setdefault(r, []).append(k)
    assert groups(got) == groups(want)


def test_windows_as_arrays(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij".split())
    items = [(str(k % 7), " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for k in range(40)]
    made = decontaminate.ItemWindows([i for i, _ in items], pa.array([t for _, t in items], pa.large_string()), 4)
    texts = [" ".join(word() for _ in range(rng.choice([0, 2, 5, 60]))) for _ in range(30)] + ["", None]
    count, hits, found = made.scan(pa.array(texts, pa.string()))
    for text, c, h, f in zip(texts, count, hits, found, strict=True):
        w, want, of = (text or "").split(), set(), set()
        for item, t in items:
            v = t.split()
            n = min(4, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        want |= set(range(b, b + n))
                        of.add(item)
        assert (c, set(h.tolist()), f) == (len(w), want, sorted(of))


def test_elias_fano_access_and_search_in_a_range():
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (500, 900), (3000, 1 << 40)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        coded = EliasFano(values, top)
        assert (coded.at(np.arange(values.size)) == values).all()
        lo = rng.integers(0, values.size, 200)
        hi = np.minimum(values.size, lo + rng.integers(0, 50, 200))
        want = rng.integers(0, top, 200, dtype=np.uint64)
        want[::2] = values[lo[::2]]
        at, equal = coded.successor_within(lo, hi, want)
        for k in range(200):
            place = lo[k] + int(np.searchsorted(values[lo[k] : hi[k]], want[k]))
            assert at[k] == place and equal[k] == (place < hi[k] and values[place] == want[k])


def test_licences_and_their_near_neighbours(spark):
    year = "Copyright (c) 2019 Some One"
    gpl = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    files = {
        "GPL-3.0": gpl.format(":", "", 3),
        "GPL-2.0": gpl.format(";", "", 2),
        "AGPL-3.0": gpl.format(":", "Affero ", 3),
        "LGPL-3.0": gpl.format(":", "Lesser ", 3),
        "MIT": f"MIT License\n\n{year}\n\n" + licenses.TEMPLATES["MIT"][-2],
        "BSD-2-Clause": f"{year}\nAll rights reserved.\n" + licenses.TEMPLATES["BSD-2-Clause"][0],
        "BSD-3-Clause": f"{year}\nAll rights reserved.\n" + licenses.TEMPLATES["BSD-3-Clause"][0],
        "ISC": f"ISC License\n\n{year}\n\n" + licenses.TEMPLATES["ISC"][0],
        "Zlib": "// SPDX-License-Identifier: Zlib\nint x;\n",
    }
    rows = [(k, f"d{k}/{'LICENSE' if k % 2 else 'a.c'}", t) for k, t in enumerate(files.values())] + [(100 + k, f"e/{k}.c", f"int main {k} return zero nothing to see") for k in range(200)]
    got = {x.doc_id: x.own_license for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[k] for k in range(len(files))] == list(files)
    assert not any(got[100 + k] for k in range(200))


def test_licence_ties_go_by_name_and_path(spark):
    two = {"B": ["alpha beta gamma"], "A": ["alpha beta gamma"]}
    rows = [(1, "p/LICENSE.b", "alpha beta gamma"), (2, "p/LICENSE.a", "alpha beta gamma"), (3, "p/q/x.c", "none"), (4, None, "alpha beta gamma"), (5, "p/y.c", None), (5, "p/y.c", None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), two).collect()
    assert {x.own_license for x in out if x.doc_id in (1, 2, 4)} == {"A"} and len(out) == 6
    assert {x.inherited_from for x in out if x.doc_id in (3, 5)} == {"p/LICENSE.a"}
