"""Language identification with n-gram filters: one bit-sliced Bloom filter answers for all languages at once.

Training counts the character n-grams of each language over all labelled rows on Spark. An n-gram is put into a
language's filter if its share of that language's n-grams is at least ``least_share`` and at least ``contrast`` times
its largest share in any language; so a language has at most 1/least_share n-grams, whatever the corpus, and the
model a proven size. In the filter, slot j is a bit mask with one bit a language: the masks at the k slots of an
n-gram, and-ed, are the languages that contain it (a slot has as many 64-bit words as the languages need). Per text
and language the hits are counted, the expected number of false hits is taken off, and the language with most
corrected hits wins.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0. A text none of whose n-grams is
known gets the language with most training n-grams, with score 0. Ties go to the language first by name. Rows without
label or text train nothing; without any training row, every text is ``und``. An empty table gives no rows. Repeated
rows count as often as they occur. Very long texts are read whole; one is held in memory at a time. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import mixed, pieces
from quern.sources.staging import staged

UNKNOWN = "und"
N, LEAST_SHARE, CONTRAST, HASHES, BITS_PER_GRAM = 3, 1e-5, 0.5, 4, 12
#: Share of a text's n-grams that its language has to know. Random letters reach about a tenth.
LEAST_RATE = 0.2
#: N-grams that a task counts before it sends partial sums on.
_HELD = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its lower-case form, and whether it is a letter (first plane)."""
    points = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in points], np.uint32)
    return lower, np.array([c.isalpha() for c in points])


_LOWER, _LETTER = _tables()


def grams(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams (n >= 3) of all texts and their text numbers, and per text whether it has a letter.

    Letters are lower-cased, each run of anything else is one space, a text begins and ends with one, and spaces
    stand only at the ends of an n-gram.
    """
    raw = [t or "" for t in texts.to_pylist()]
    code = np.frombuffer(("\n" + "\n".join(raw) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(code, 0xFFFF)
    letter = np.where(code < 0x10000, _LETTER[low], False)
    if (far := code >= 0x10000).any():
        points, inverse = np.unique(code[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in points.tolist()])[inverse]
    owner = np.concatenate([[0], np.repeat(np.arange(len(raw)), [len(t) + 1 for t in raw])])
    has_letter = np.bincount(owner[letter], minlength=len(raw)) > 0
    code = np.where(letter, np.where(far, code, _LOWER[low]), np.uint32(32))
    keep = letter.copy()
    keep[0], keep[1:] = True, letter[1:] | letter[:-1]
    code, owner, letter = code[keep].astype(np.uint64), owner[keep], letter[keep]
    if code.size < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter
    count = code.size - n + 1
    h, inner = np.zeros(count, np.uint64), np.ones(count, bool)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + count]
        if 0 < k < n - 1:
            inner &= letter[k : k + count]
    return mixed(h[inner]), owner[1 : 1 + count][inner], has_letter


def has(masks: np.ndarray, language: int) -> np.ndarray:
    """Whether the language's bit is set in each row of words."""
    return (masks[:, language // 64] >> np.uint64(language % 64) & np.uint64(1)).astype(bool)


@dataclass
class Filters:
    """The model: languages, the masks (slots x words of 64 languages), and each language's share of set bits."""

    languages: list[str]
    masks: np.ndarray
    n: int = N
    hashes: int = HASHES
    usual: int = 0
    filled: np.ndarray = field(init=False)

    def __post_init__(self):
        self.filled = np.array([np.count_nonzero(has(self.masks, k)) / len(self.masks) for k in range(len(self.languages))])

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.masks) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(self.hashes):
            yield (h + np.uint64(k) * step) & size

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Bit mask (a row of words) of the languages that contain each n-gram."""
        out = np.full((h.size, self.masks.shape[1]), ~np.uint64(0))
        for slot in self.slots(h):
            out &= self.masks[slot]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text the language, its share of the corrected hits of all, its corrected hits per n-gram, and the number
        of n-grams."""
        h, owner, letters = grams(texts, self.n)
        n, k = len(texts), len(self.languages)
        if not k:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        found = self.containing(h)
        total = np.bincount(owner, minlength=n)
        hits = np.stack([np.bincount(owner[has(found, i)], minlength=n) for i in range(k)], axis=1).astype(float)
        false = self.filled**self.hashes
        right = np.maximum(0, (hits - total[:, None] * false) / np.maximum(1e-9, 1 - false))
        best, all_ = right.argmax(axis=1), right.sum(axis=1)
        best = np.where(all_ > 0, best, self.usual)
        top = right[np.arange(n), best]
        score = np.where((all_ > 0) & letters, top / np.maximum(all_, 1e-9), 0.0)
        rate = np.where(letters, top / np.maximum(1, total), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score.clip(0, 1), rate.clip(0, 1), total


def gram_counts(labelled: DataFrame, n: int = N) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all rows of ``labelled`` (text, lang); tasks send sums, not occurrences. What a task
    holds is bounded over all its languages together, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(lang: str) -> tuple[np.ndarray, np.ndarray]:
            h, inverse = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
            return h, np.bincount(inverse, weights=np.concatenate([c for _, c in held[lang]])).astype(np.int64)

        def out(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                h, c = summed(lang)
                del held[lang]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * h.size, pa.string()), pa.array(h.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

        total = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                h, owner, _ = grams(part.column("text"), n)
                langs = part.column("lang").dictionary_encode()
                number = langs.indices.to_numpy()[owner]
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    x, c = np.unique(h[number == k], return_counts=True)
                    held.setdefault(lang, []).append((x, c))
                    total += x.size
                if total > _HELD:
                    for lang in held:
                        held[lang] = [summed(lang)]
                    total = sum(x.size for (x, _), in held.values())
                    if total > _HELD // 2:
                        yield from out(list(held))
                        total = 0
        yield from out(list(held))

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, n: int = N, least_share: float = LEAST_SHARE, contrast: float = CONTRAST) -> Filters:
    """Filters from all rows of ``labelled``. What reaches the driver is at most 1/least_share n-grams a language."""
    counts = staged(gram_counts(labelled, n), "grams")
    by_gram = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    sums = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sums)
    if not languages:
        return Filters([], np.zeros((64, 1), np.uint64), n)
    share = {x: F.coalesce(F.col("by_lang")[x], F.lit(0)) / F.lit(float(sums[x])) for x in languages}
    most = F.greatest(*share.values()) if len(share) > 1 else share[languages[0]]
    own = {x: (share[x] >= least_share) & (share[x] >= contrast * most) for x in languages}
    bit = lambda k: F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
    none = F.lit(0).cast("long")
    masks = [sum((F.when(own[x], bit(k)).otherwise(none) for k, x in enumerate(languages[lo : lo + 64])), none).alias(f"m{lo // 64}") for lo in range(0, len(languages), 64)]
    kept = by_gram.select("gram", *masks)
    kept = kept.where(F.greatest(*[kept[c] != 0 for c in kept.columns[1:]], F.lit(False))).toPandas()
    gram, bits = kept["gram"].to_numpy(np.int64).view(np.uint64), kept.iloc[:, 1:].to_numpy(np.int64).view(np.uint64)
    size = 1 << max(10, (BITS_PER_GRAM * max(1, gram.size) - 1).bit_length())
    filters = Filters(languages, np.zeros((size, len(masks)), np.uint64), n, usual=max(range(len(languages)), key=lambda k: (sums[languages[k]], -k)))
    for slot in filters.slots(gram):
        np.bitwise_or.at(filters.masks, slot, bits)
    filters.__post_init__()
    return filters


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``rate`` of every whole text: one scan, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lang, score, rate, _ = model.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "rate"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rate double")


def keep_known(docs: DataFrame, filters: Filters, least_rate: float = LEAST_RATE) -> DataFrame:
    """Rows of ``docs``, unchanged, whose text is in one of the languages: it has a letter, and ``least_rate`` or more
    of its n-grams are in the filter of the language predicted. A short text, whose few n-grams say little, goes only if
    its rate is below by two standard errors.

    Only the text goes to Python, and one boolean comes back; rows wait in the JVM.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        out = []
        for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            lang, _, rate, total = model.value.predict(part.column("text"))
            error = np.sqrt(least_rate * (1 - least_rate) / np.maximum(1, total))
            out.append(np.array([x != UNKNOWN for x in lang], bool) & (rate >= least_rate - 2 * error))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(known(F.col("text").cast("string")))
