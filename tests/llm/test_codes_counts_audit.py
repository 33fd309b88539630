"""Vector codes, token counts and the filter audit against plain computations."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from conftest import CLASHING
from helpers import rows
from pyspark.sql import functions as F

from tableprep.llm import filter_audit, token_counts, vector_codes

NAN, INF = float("nan"), float("inf")

# -- vector codes -------------------------------------------------------------


def plain_codes(table, parts, entries, rounds):
    """Rows (id, vector, label) compared with every entry, in Python's whole numbers."""
    good = [(i, v, x) for i, v, x in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return []
    widths = Counter(len(v) for _, v, _ in good)
    width = min(widths, key=lambda w: (-widths[w], w))
    good = [(i, [math.floor(Fraction(c) * 1024) for c in v], x) for i, v, x in good if len(v) == width]
    cut = [slice(width * p // parts, width * (p + 1) // parts) for p in range(parts)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[c] for _, v, _ in first] for c in cut]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[cut[p]], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in good:
            for p in range(parts):
                members[p, nearest(v, p)[1]].append(v[cut[p]])
        for (p, k), vs in members.items():
            books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    coded = []
    for i, v, x in good:
        found = [nearest(v, p) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), x))
    by_label = defaultdict(list)
    for _, _, d, x in coded:
        by_label[x].append(d)
    most = 2**63 - 1
    numbers = ",".join(str(c) for book in books for e in book for c in e)
    sha = hashlib.sha256(numbers.encode()).hexdigest()
    out = []
    for i, code, d, x in coded:
        total = sum(by_label[x]) if max(by_label[x]) <= most and sum(by_label[x]) <= most else None
        out.append((i, code, d if d <= most else None, total, sha))
    return sorted(out, key=repr)


def vectors(seed, n, width, spread=0.3):
    random_ = random.Random(seed)
    return [[random_.gauss(0, spread) for _ in range(width)] for _ in range(n)]


ODD = [
    (900, None, 1), (901, [0.1, None, 0.2, 0.3, 0.0, 0.0, 0.0, 0.0], 1), (902, [NAN] * 8, 1), (903, [INF] + [0.0] * 7, 2),
    (904, [0.5], 1), (905, [0.0] * 8, None), (905, [0.0] * 8, None), (None, [0.25] * 8, None), (2, [0.1] * 8, 0), (2, [0.1] * 8, 0),
]


def codes(spark, table, kind="double", **options):
    df = spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>, label int")
    df = df.withColumns({c: F.lit(7) for c in (*CLASHING, "vector", "code", "error", "of_label", "width")})
    return rows(vector_codes.compress(df.repartition(3), **options))


def test_codes_equal_a_full_comparison(spark):
    table = [(i, v, i % 3 or None) for i, v in enumerate(vectors(1, 120, 8))] + ODD
    table += [(200 + i, [float(x) for x in np.round(v, 1)], 5) for i, v in enumerate(vectors(2, 80, 8))]  # many ties
    for entries, rounds in ((16, 3), (256, 4)):
        assert codes(spark, table, entries=entries, rounds=rounds) == plain_codes(table, 4, entries, rounds)


def test_codes_of_numbers_of_any_size(spark):
    sizes = [1e30, -1e200, 1.7e308, 2.0**14, -(2.0**15), 1e-300, 3e6, -0.0, 4e6]
    table = [(i, v, i % 2) for i, v in enumerate(vectors(3, 30, 8))]
    table += [(40 + i, [x, 1.0, -x, 0.5, 0.0, x / 3, 2.0, x], 3) for i, x in enumerate(sizes)]
    table += [(-1, [1e25] * 8, 4), (-2, [2e4, -2e4] * 4, 4)]  # among the first entries
    assert codes(spark, table, entries=6, rounds=2) == plain_codes(table, 4, 6, 2)
    wide = [(i, [1e20 * (i + 1)] * 4, 0) for i in range(5)]
    assert codes(spark, wide, entries=2, rounds=2) == plain_codes(wide, 4, 2, 2)


def test_codes_of_floats_odd_widths_and_few_rows(spark):
    table = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors(4, 20, 7))]
    assert codes(spark, table, "float", parts=3, entries=4, rounds=1) == plain_codes(table, 3, 4, 1)
    assert codes(spark, [], entries=4) == []
    assert codes(spark, [(1, None, 1), (2, [NAN], 1)]) == []
    one = codes(spark, [(7, [], None)])
    assert one == plain_codes([(7, [], None)], 4, 256, 4) and one[0][1] == "00000000"


@pytest.mark.parametrize("cells", [1, 1 << 16])
def test_cells_keep_the_nearest_entry(cells):
    """Clustered, scattered and repeated parts; a store of one cell starts over each time."""
    draw = np.random.default_rng(5)
    entries = draw.integers(-300, 300, (40, 6))
    entries[7] = entries[3]
    x = np.concatenate([draw.integers(-600, 600, (300, 6)), entries[draw.integers(0, 40, 300)] + draw.integers(-3, 4, (300, 6))])
    book = vector_codes.PartBook(entries.tolist(), cells)
    for _ in range(2):
        index, error = book.nearest(x)
        apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
    assert all(len(c) for c in book.cells.values())
    assert np.mean([len(c) for c in book._open(np.unique(x[300:] >> book.shift, axis=0))]) < 30  # many are ruled out


# -- token counts -------------------------------------------------------------

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")


def by_library(name, texts):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(name))
        return [len(x) for x in whole.encode_batch(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    whole = SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [len(whole.encode(x)) for x in texts]


def counter(name, **options):
    with open(public_tokenizers.path(name), "rb") as file:
        return token_counts.TokenCounter(token_counts.load(name, file.read()), **options)


@pytest.mark.parametrize("name", FILES)
def test_cut_texts_count_as_whole_ones(name):
    random_ = random.Random(6)
    atoms = [
        "a", "b", "'s", "'", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xe9", "\xdf", "123", ".", "...", "don't", "THE", "word", "\0",
        "<|endoftext|>", "<|startoftext|>", "<s>", "</s>",
        *map(chr, (0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0x301, 0x3A3, 0x4E2D, 0x130, 0x1E9B, 0x323, 0x2581, 0xFEFF, 0x180E, 0x1F600)),
    ]
    texts = ["".join(random_.choice(atoms) for _ in range(random_.randrange(40))) for _ in range(3000)]
    whole = by_library(name, texts)
    for stretch, most, kept in ((1, 50, 20), (5, 400, 1000), (1 << 16, 1 << 20, 1 << 19)):
        assert counter(name, stretch=stretch, most=most, kept=kept).counts(texts) == whole


@pytest.mark.parametrize("name", FILES)
def test_tokens_of_documents(spark, docs, corpus, empty, name):
    found = token_counts.count_tokens(docs, public_tokenizers.path(name), limit=100)
    texts = [t or "" for _, t, _ in corpus]
    wanted = [(i, len(t.encode()), n, n > 100) for (i, _, _), t, n in zip(corpus, texts, by_library(name, texts))]
    assert rows(found) == sorted(wanted, key=repr)
    assert rows(token_counts.count_tokens(empty, public_tokenizers.path(name))) == []


def test_texts_that_have_no_boundary_and_unknown_tokenizers():
    texts = ["x" * 300_000, chr(0x4E2D) * 100_000, "", "a b " * 200_000]
    assert counter(FILES[0], stretch=100).counts(texts) == by_library(FILES[0], texts)
    known = {"added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}}
    assert token_counts.ends_before_blanks(known)
    assert not token_counts.ends_before_blanks({"pre_tokenizer": None})
    assert not token_counts.ends_before_blanks({"pre_tokenizer": {"type": "Metaspace"}})
    strips = [{"content": "<m>", "lstrip": True, "rstrip": False}]
    assert not token_counts.ends_before_blanks({**known, "added_tokens": strips})
    crossing = {"type": "Split", "pattern": {"Regex": r"\w+\s?"}, "behavior": "Removed", "invert": True}
    assert not token_counts.ends_before_blanks({"pre_tokenizer": crossing})
    with pytest.raises(ValueError):
        token_counts.load("words.txt", b"")


def test_runs_have_about_equal_bytes():
    parts = [(i, "x" * n) for i, n in enumerate([400, 700, 100, 2500, 1, 1])]
    runs = [[i for i, _ in run] for run in token_counts.balanced(parts, 1000)]
    assert runs == [[0], [1, 2], [3], [4, 5]]
    text = "aa bbb  cccc\nd"
    cut = list(token_counts.stretches(text, token_counts.BEFORE_BLANKS, 1))
    assert cut == ["aa", " bbb", "  cccc", "\nd"] and "".join(cut) == text


# -- filter audit -------------------------------------------------------------


def plain_counts(text):
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return [len(words), len(set(words)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)]


def plain_audit(table, labels):
    """Every order applied document by document."""
    least = {}
    for i, text, _ in table:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in table}:
        members = []
        for i, text, source in table:
            if (source or "") != part:
                continue
            words, distinct, points, capitals, marks = plain_counts(text or "")
            fails = {x for x, test in zip("ABCD", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, marks > 0)) if test}
            if i is not None and least[text or ""] < i:
                fails.add("E")
            members.append((fails, i in good, i in toxic))
        removed = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = members
            for step, x in enumerate(order, 1):
                lost = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                removed[x] += len(lost)
                failing = sum(x in m[0] for m in members)
                steps.append((x, (part, "".join(order), step, len(left), len(lost), failing - len(lost), sum(m[0] == {x} for m in members),
                                  sum(m[1] for m in lost), sum(m[2] for m in lost))))
        out += [(*row, removed[x]) for x, row in steps]
    return sorted(out, key=repr)


LABELS = "doc_id long, quality int, toxic int"


def test_audit_equals_every_order_walked(spark, docs, corpus, empty):
    extra = [(300, "Loud WORDS " * 40, "s1"), (301, "a# b$ " * 60, "s2"), (302, "a# b$ " * 60, None), (299, "a# b$ " * 60, ""), (303, "SOS", "s1")]
    more = spark.createDataFrame(extra, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASHING})
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 320, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame(labels, LABELS).withColumns({c: F.lit(2) for c in ("source", "text", "n", "part")})
    found = filter_audit.audit(docs.unionByName(more), table)
    assert rows(found) == plain_audit(corpus + extra, labels)
    none = spark.createDataFrame([], LABELS)
    assert rows(filter_audit.audit(empty, table)) == []
    assert rows(filter_audit.audit(docs, none)) == plain_audit(corpus, [])


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 64)


TEXTS = [
    "", " ", "a", "A a A", "one two one\x0btwo\r\n", "\xe9\xe9 \xc9 " + chr(0x1F600) * 3, "#$%&*| x#", "\xa0a\x85b\x1cc",
    "word " * 500, " ".join(f"w{i % 97}" for i in range(700)), "x" * 5000, "x" * 3000 + " y " + "x" * 3000, "\t" * 400,
]


def test_transducer_counts_like_python():
    found = filter_audit.Transducer().counts([t.encode() for t in TEXTS])
    assert found.tolist() == [plain_counts(t) for t in TEXTS]


def test_long_texts_are_counted_in_parts(small_pieces):
    machine = filter_audit.Transducer()
    for text in TEXTS:
        if text:
            assert machine._long(text.encode()).tolist() == plain_counts(text)
            assert b"".join(filter_audit.blank_cuts(text.encode(), 64)) == text.encode()


@pytest.mark.parametrize("modulus", [1, 3])
def test_words_of_equal_hash_are_told_apart(monkeypatch, modulus):
    plain = filter_audit.Transducer._hashes
    monkeypatch.setattr(filter_audit.Transducer, "_hashes", lambda *a: plain(*a) % np.uint64(modulus))
    found = filter_audit.Transducer().counts([t.encode() for t in TEXTS])
    assert found.tolist() == [plain_counts(t) for t in TEXTS]
