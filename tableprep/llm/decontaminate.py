"""Benchmark passages in documents, by latent semantic search and exact checks.

Words are hashed to ``TERMS`` terms. A passage is a stretch of words, its
vector their TF-IDF weights. The matrix of all passages of the corpus is never
built: each passage that differs from all others is added once, with a random
sign, to one of ``SKETCH`` rows chosen by its hash, so that copies do not weigh
more. These rows times the passages is the random projection of
a randomised singular value decomposition; it is summed over all tasks, scaled
by the inverse document frequencies, and its right singular vectors, found on
the driver, span the latent space. The projection has a fixed size at any size
of the corpus.

Each passage of a document is then compared with each passage of a benchmark
item by the cosine in that space. Candidates are checked on the words: enough
words of the text around the passage must be words of the item, and the
longest common subsequence of the item and the text around the passage must
cover most of the item, or a good part of it and the whole answer, which is
the last sentence of the item.

The benchmark is read in blocks of bounded size; its vectors go to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, documents, map_batches, map_rows, text_of
from tableprep.llm.words import HASHED, Hasher, Words, mixed, pieces

TERMS = 8192
SKETCH = RANK = 192
#: Share of the variance that the directions kept have.
ENERGY = 0.95
#: Bytes of text whose words are mapped to the latent space at a time.
MAPPED = 1 << 18
#: Words of a passage, and from one passage to the next in the search.
PASSAGE, STEP = 32, 16
#: Least cosine of a candidate of full length, as a shorter one fills part of a passage only; least
#: share of the item in the common subsequence; that with the answer.
COSINE, COVERED, ANSWERED = 0.45, 0.75, 0.55
#: Items of a block.
BLOCK = 4000

#: Bytes of the passages that are held together when each is counted once.
HELD = 8 << 20
#: Texts that are taken out of a batch at a time.
ROWS = 1 << 10
#: Passages whose terms are counted at a time, and stretches around passages that are looked at together.
AT_ONCE, AROUND = 1 << 14, 512

SUMS = "row int, sums binary"
PASSAGES = "part int, hashes binary, sizes binary, terms binary"
SENTENCE = re.compile(rb"[.!?]\s+")


def _terms(words: Words) -> np.ndarray:
    return (words.hashes % np.uint64(TERMS)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a batch; few at a time stand beside it."""
    for a in range(0, batch.num_rows, ROWS):
        yield from pieces(batch.column("text").slice(a, ROWS).cast(pa.binary()).to_pylist(), HASHED)


def _text_of_word(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def _sum_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "sums"]
    )


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rows of equal number added up; a task adds rows as they come, so it holds a few of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column("row").to_pylist(), batch.column("sums"), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(data.as_py(), np.int64)
        yield _sum_rows(sums)

    found = map_batches(rows.repartition("row"), add, SUMS).collect()
    return {r.row: np.frombuffer(r.sums, np.int64) for r in found}


def _term_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies of all terms and the number of documents, copies included."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        seen, total = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, texts in _texts(batch):
                words = hasher.words(texts)
                total += len(texts)
                text, term = _text_of_word(words), _terms(words)
                for a in range(0, len(texts), 64):  # few enough that the table stays in a core's cache
                    b = min(a + 64, len(texts))
                    here = slice(words.first[a], words.first[b])
                    there = np.zeros((b - a, TERMS), bool)
                    there[text[here] - a, term[here]] = True
                    seen += np.count_nonzero(there, axis=0)
        yield _sum_rows({0: seen, 1: np.array([total])})

    sums = _added(map_batches(docs.select("text"), measure, SUMS))
    return sums.get(0, np.zeros(TERMS, np.int64)), int(sums.get(1, [0])[0])


def _passage_rows(docs: DataFrame, parts: int) -> DataFrame:
    """Hash, size and terms of the passages, packed by part of the hash; once for equal ones read together."""
    out = arrow_schema(PASSAGES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, texts in _texts(batch):
                words = hasher.words(texts)
                if not len(words.hashes):
                    continue
                inner = np.arange(len(words.hashes)) - words.first[_text_of_word(words)]
                start = np.flatnonzero(inner % PASSAGE == 0)
                size = np.diff(np.r_[start, len(inner)])
                dealt = mixed(np.add.reduceat(words.hashes * (inner + 1).astype(np.uint64), start), 5)
                dealt, first = np.unique(dealt, return_index=True)
                part = ((dealt >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                dealt, first, part = dealt[order], first[order], part[order]
                size, start = size[first], start[first]
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
                terms = _terms(words)[at].astype(np.uint16)
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                cells = (
                    [x.tobytes() for x in np.split(dealt, cuts[1:])],
                    [x.tobytes() for x in np.split(size.astype(np.uint8), cuts[1:])],
                    [x.tobytes() for x in np.split(terms, ends[cuts[1:] - 1])],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts], pa.int32()), *(pa.array(x, pa.binary()) for x in cells)], schema=out
                )

    return map_batches(docs.select("text"), cut, PASSAGES)


def _sketched(passages: DataFrame, parts: int) -> DataFrame:
    """The rows of the sketch from the passages, each different one counted once."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["part"], []).append((row["hashes"], row["sizes"], row["terms"]))
        if not held:
            return
        sums = np.zeros(SKETCH * TERMS, np.int64)
        while held:
            _, rows = held.popitem()
            hashes, sizes, terms = (b"".join(x) for x in zip(*rows, strict=True))
            dealt, size = np.frombuffer(hashes, np.uint64), np.frombuffer(sizes, np.uint8).astype(np.int64)
            term = np.frombuffer(terms, np.uint16)
            ends = np.cumsum(size)
            once = np.sort(np.unique(dealt, return_index=True)[1])
            for few in np.split(once, range(AT_ONCE, len(once), AT_ONCE)):
                n = size[few]
                at = np.arange(n.sum()) + np.repeat(ends[few] - np.cumsum(n), n)
                row = (dealt[few] % np.uint64(SKETCH)).astype(np.int64)
                sign = 1 - 2 * (dealt[few] >> np.uint64(63)).astype(np.int64)
                np.add.at(sums, np.repeat(row * TERMS, n) + term[at], np.repeat(sign, n))
        yield _sum_rows(dict(enumerate(sums.reshape(SKETCH, TERMS))))

    return map_batches(passages.repartition(parts, "part"), sketch, SUMS)


def corpus_sums(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sketch of all different passages, document frequencies of all terms, and the number of documents."""
    seen, total = _term_counts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // (2 * HELD)  # a passage takes less than half the bytes of its text
    sums = _added(_sketched(_passage_rows(docs, parts), parts))
    none = np.zeros(TERMS, np.int64)
    return np.stack([sums.get(i, none) for i in range(SKETCH)]), seen, total


def latent_space(sketch: np.ndarray, seen: np.ndarray, total: int) -> np.ndarray:
    """Maps term counts to latent coordinates of unit variance: terms by ``RANK``."""
    idf = np.log((1 + total) / (1 + seen)) + 0.1
    _, values, vectors = np.linalg.svd(sketch * idf, full_matrices=False)
    # The weakest directions are single rare terms, or noise; at unit variance they would drown the rest.
    energy = np.cumsum(values**2)
    kept = (energy <= ENERGY * energy[-1])[:RANK] & (values[:RANK] > 0)
    kept[0] = values[0] > 0
    basis = vectors[:RANK][kept] / values[:RANK][kept, None]
    scale = np.sqrt(max(len(basis), 1)) * max(values[0], 1e-300)
    return (idf[:, None] * basis.T * scale).astype(np.float32)


def _passages(words: Words, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the passages of some texts, the text and the first word of each."""
    text = _text_of_word(words)
    if not len(text):
        return np.zeros((0, space.shape[1]), np.float32), text, text
    inner = np.arange(len(text)) - words.first[text]
    start = np.flatnonzero(inner % STEP == 0)
    # Half passages are summed once; a passage is a half and the next one of the same text.
    # The words of a half are added one place at a time; places behind its end add the last row, zeros.
    spaces = np.ascontiguousarray(np.r_[space, np.zeros((1, space.shape[1]), space.dtype)])  # by rows, as they are read
    places = np.full((len(start), STEP), len(space))
    places[np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(text)])), inner % STEP] = _terms(words)
    half = spaces[places[:, 0]]
    for a in range(0, len(start), 128):  # few enough to stay in a core's cache
        here, at = half[a : a + 128], np.ascontiguousarray(places[a : a + 128].T)
        for i in range(1, STEP):
            here += spaces[at[i]]
    owner = text[start]
    follows = np.r_[owner[1:] == owner[:-1], False]
    whole = half.copy()
    whole[follows] += half[1:][follows[:-1]]
    # The last half of a longer text is part of the passage before.
    kept = follows | (inner[start] == 0)
    whole, start, owner = whole[kept], start[kept], owner[kept]
    whole /= np.linalg.norm(whole, axis=1, keepdims=True) + 1e-12
    return whole, owner, start


@dataclass
class Items:
    """A block of the benchmark: ids, words and answer of each item; vector, item and least cosine of each passage."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def __post_init__(self) -> None:
        #: All words of the block in order; the places of each item's words among them, and how often it has them.
        self.vocabulary = np.unique(np.concatenate(self.words))
        each = [np.unique(np.searchsorted(self.vocabulary, x), return_counts=True) for x in self.words]
        self.places, self.times = [x for x, _ in each], [x for _, x in each]
        self.sizes = np.array([len(x) for x in self.words], np.int64)


def prepare(rows: list[tuple[object, str]], space: np.ndarray) -> Items:
    hasher = Hasher()
    texts = [x.encode() for _, x in rows]
    words = hasher.words(texts)
    split = np.split(words.hashes, words.first[1:-1])
    vectors, owner, start = _passages(words, space)
    size = np.minimum(words.first[owner + 1] - start, PASSAGE)
    least = (COSINE * np.sqrt(size / PASSAGE)).astype(np.float32)
    ends = [[s for s in SENTENCE.split(x) if s.strip()][-1:] or [b""] for x in texts]
    last = hasher.words([x[0] for x in ends])
    return Items([i for i, _ in rows], split, np.split(last.hashes, last.first[1:-1]), vectors, owner, least)


def common(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence; the bits of a number are the row of the table."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for x in text.tolist():
        both = row & where.get(x, 0)
        row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def _holds(text: np.ndarray, part: np.ndarray) -> bool:
    n = len(part)
    if not n or n > len(text):
        return False
    at = np.flatnonzero(text[: len(text) - n + 1] == part[0])
    return any((text[i : i + n] == part).all() for i in at)


def _candidates(
    words: Words, vectors: np.ndarray, owner: np.ndarray, start: np.ndarray, items: Items
) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, first and last word of the stretches that are near an item and have enough of its words."""
    near = [np.argwhere(vectors[a : a + 4096] @ items.vectors.T >= items.least) + [a, 0] for a in range(0, len(vectors), 4096)]
    if not near:
        return
    at, passage = np.concatenate(near).T
    item, text = items.owner[passage], owner[at]
    low = np.maximum(start[at] - items.sizes[item], words.first[text])
    high = np.minimum(start[at] + PASSAGE + items.sizes[item], words.first[text + 1])
    place = np.searchsorted(items.vocabulary, words.hashes)
    known = items.vocabulary[np.minimum(place, len(items.vocabulary) - 1)] == words.hashes
    place[~known] = len(items.vocabulary)
    order = np.argsort(item, kind="stable")
    kept = np.zeros(len(item), bool)
    own = np.full(len(items.vocabulary) + 1, -1)
    bit = np.zeros(len(items.vocabulary) + 1, np.uint64)
    ahead = np.r_[place, np.full(PASSAGE + 2 * items.sizes.max(), len(items.vocabulary))]
    stretches: dict[int, np.ndarray] = {}
    # No common subsequence is longer than the words of the item that are there at all.
    for some in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        if not len(some):
            continue
        i = item[some[0]]
        width, number = PASSAGE + 2 * items.sizes[i], np.arange(len(items.places[i]))
        own[items.places[i]] = number
        # First whether there could be enough: words share 64 bits, and stretches are not cut at their ends.
        bit[items.places[i]] = np.uint64(1) << (number % 64).astype(np.uint64)
        bits = ANSWERED * items.sizes[i] - (items.sizes[i] - min(len(number), 64))
        if width not in stretches:
            stretches[width] = np.lib.stride_tricks.sliding_window_view(ahead, width)
        maybe = []
        for a in range(0, len(some), AROUND):
            few = some[a : a + AROUND]
            there = np.bitwise_or.reduce(bit[stretches[width][low[few]]], axis=1)
            maybe.append(few[np.bitwise_count(there) >= bits])
        bit[items.places[i]] = 0
        some = np.concatenate(maybe)
        for a in range(0, len(some), 4096):
            few = some[a : a + 4096]
            at = low[few, None] + np.arange(width)
            found = own[place[np.minimum(at, len(place) - 1)]]
            found[at >= high[few, None]] = -1
            there = np.zeros((len(few), len(items.places[i]) + 1), bool)  # the last column is for other words
            there[np.arange(len(few))[:, None], found] = True
            kept[few] = there[:, :-1] @ items.times[i] >= ANSWERED * items.sizes[i]
        own[items.places[i]] = -1
    yield from zip(*(x[kept].tolist() for x in (text, item, low, high)), strict=True)


def matches(texts: list[str], items: Items, space: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Text, item and covered share of every item found in some texts, once each."""
    hasher = Hasher()
    for base, some in pieces([x.encode() for x in texts], MAPPED):
        words = hasher.words(some)
        best: dict[tuple[int, int], float] = {}
        tested: dict[tuple[int, int], int] = {}
        for text, item, low, high in _candidates(words, *_passages(words, space), items):
            # The stretch of the passage before covers the same place of the item.
            if tested.get((text, item)) == low or best.get((text, item), 0) == 1:
                continue
            tested[text, item] = low
            word, around = items.words[item], words.hashes[low:high]
            share = common(word, around) / len(word)
            if share >= COVERED or (share >= ANSWERED and _holds(around, items.answers[item])):
                best[text, item] = max(share, best.get((text, item), 0))
        for (text, item), share in sorted(best.items()):
            yield base + text, item, share


def _blocks(benchmark: DataFrame, space: np.ndarray) -> Iterator[Items]:
    """The items with words, in blocks by the hash of their id."""
    items = benchmark.select(F.col("item_id").alias("item_id"), text_of().alias("text"))
    n = -(-max(items.count(), 1) // BLOCK)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        block = prepare([tuple(r) for r in rows], space)
        if len(block.vectors):
            yield block


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` and ``covered`` for every item found in a document.

    A null or blank text or item has no words and is never found. Repeated
    rows of either table give rows of their own. Rows without an id are
    searched as well and reported with a null id. Other columns are not read.
    An empty table gives an empty result.
    """
    docs = documents(docs)
    space = latent_space(*corpus_sums(docs))
    schema = f"doc_id bigint, item_id {benchmark.schema['item_id'].dataType.simpleString()}, covered double"
    out = arrow_schema(schema)
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, space):

        def search(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            rows = list(matches(batch.column("text").to_pylist(), items, space))
            texts = pa.array([t for t, *_ in rows], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(texts),
                    pa.array([items.ids[i] for _, i, _ in rows], out.field("item_id").type),
                    pa.array([x for *_, x in rows], pa.float64()),
                ],
                schema=out,
            )

        found = found.union(map_rows(docs, search, schema, ROWS))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept."""
    space = latent_space(*corpus_sums(documents(docs)))
    for items in _blocks(benchmark, space):

        def drop(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            found = {t for t, *_ in matches(texts, items, space)}
            return batch.filter(pa.array([i not in found for i in range(len(texts))], pa.bool_()))

        docs = map_rows(docs, drop, docs.schema, ROWS)
    return docs
