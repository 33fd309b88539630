import random
import zlib
from collections import Counter

import numpy as np
from conftest import WORDS, edited, prose

from tableprep.llm import ann, decontaminate, toxicity


def test_toxic_words_are_learned(spark, docs, corpus, empty):
    bad = ["zzorg", "krumpf", "wexil"]
    random_ = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        words = [random_.choice(WORDS) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                words[random_.randrange(60)] = random_.choice(bad) + random_.choice(["", "a", "ish"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    labels += [(3, None, "x"), (None, 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, size string")
    model = toxicity.train(table, known)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, int(i % 3 == 0)) for i in got if got[i].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.97
    kept = {r.doc_id for r in toxicity.drop(table, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    scored = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in scored) == Counter(r[0] for r in corpus)
    assert all(0 <= r.score <= 1 for r in scored)
    assert toxicity.drop(docs, model).columns == docs.columns
    assert toxicity.score(empty, model).collect() == []


def test_rare_short_signed_and_upper_case_toxic_words_count(spark):
    random_ = random.Random(4)
    common = ["zzorgamon", "krumpfel"]
    rare = ["zxq", "vyk", "wuj", "k1llz", "h8erz", "4rsk", "$kum", "w@nkz", "ГНУСЬ", "МЕРЗ", "ÖDLÄRSCH", "ÜBLÉK"]
    rows = []
    for i in range(1200):
        words = [random_.choice(WORDS) for _ in range(50)]
        for _ in range(4 if i % 3 == 0 else 0):
            words[random_.randrange(50)] = random_.choice(rare if i % 2 else common)
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect() if r.held_out}
    assert np.mean([got[i] for i in got if i % 6 == 3]) >= 0.9
    assert np.mean([got[i] for i in got if i % 3]) <= 0.03


def test_without_calibration_rows_the_prior_holds(spark):
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(300).where((F.xxhash64("id") % 2 == 0) & (F.crc32(F.col("id").cast("string")) % 5 != 0)).collect()]
    table = spark.createDataFrame([(i, prose(i, 20)) for i in ids], "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame([(i, int(n % 9 == 0)) for n, i in enumerate(ids)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(table, model).collect()} == {0}


def test_without_labels_nothing_is_toxic(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    one_class = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, one_class)).collect()} == {0}


def test_contaminated_documents_are_found(spark, docs, corpus, empty):
    items = [(i, prose(5000 + i, 20 + 3 * i) + ". " + prose(6000 + i, 6)) for i in range(12)]
    rows = [(i, prose(7000 + i, 150)) for i in range(60)]
    for i in range(12):
        rows.append((100 + i, prose(8000 + i, 90) + " " + items[i][1] + " " + prose(8100 + i, 90)))
        rows.append((200 + i, prose(8200 + i, 33) + "\n" + edited(items[i][1], i, 0.1) + "\n" + prose(8300 + i, 61)))
    rows += [(300, None), (301, ""), (302, items[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find(table, bench).collect())
    want = {(100 + i, i) for i in range(12)} | {(200 + i, i) for i in range(12)} | {(302, 0), (None, 1)}
    assert got == Counter(want)
    clean = {r.doc_id for r in decontaminate.clean(table, bench).collect()}
    assert clean == set(range(60)) | {300, 301}
    assert decontaminate.clean(docs, bench).count() == len(corpus)
    assert decontaminate.find(empty, bench).collect() == []
    assert decontaminate.find(table, bench.limit(0)).collect() == []


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    random_ = np.random.default_rng(4)
    for _ in range(60):
        a, b = (random_.integers(0, 5, random_.integers(1, 90)) for _ in range(2))
        assert decontaminate.common(a, b) == longest(a.tolist(), b.tolist())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, query, k=10):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    d = sorted((float(np.sqrt(((v - x[query]) ** 2).sum())), i) for i, v in x.items() if i != query)
    return d[:k]


def test_neighbours_are_found(spark):
    random_ = np.random.default_rng(5)
    centres = random_.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + random_.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    got = ann.search(vectors(spark, [(*r, 0) for r in rows]), sample=300).collect()
    hits = total = 0
    for q in [i for i, _ in rows if i % 100 == 0]:
        mine = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        best = brute(rows, q)
        assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == list(range(1, 11))
        assert mine == sorted(mine) and len(mine) == 10
        hits += len({i for _, i in mine} & {i for _, i in best})
        total += 10
        assert np.allclose([s for s, _ in mine[:1]], [best[0][0]]) or hits / total > 0.8
    assert hits / total >= 0.9


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0),
            (5, [None, 1.0], 0), (6, [1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 0.0], 0), (8, [1.0, 0.0], 0)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, rows)).collect())
    far = float(np.sqrt(2.0))
    assert got == [(0, 1, 7, 0.0), (0, 2, 8, 0.0), (0, 3, 100, far), (100, 1, 0, far), (100, 2, 7, far), (100, 3, 8, far)]
    assert ann.search(vectors(spark, rows).limit(0)).collect() == []


def test_parts_are_balanced():
    x = np.random.default_rng(6).normal(size=(900, 8))
    part = ann.balanced_parts(x, ann.nearest(x, 10), 9)
    assert np.bincount(part, minlength=9).max() <= np.ceil(1.1 * 100)


def test_two_dictionaries_are_trained_and_windows_are_measured_with_both(spark):
    import zstandard

    random_ = random.Random(9)
    rows = [
        (i, " ".join(random_.choice(WORDS) if random_.random() > 0.08 else "velmarine" if i % 4 else "grombulate" for _ in range(80)))
        for i in range(900)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert b"grombulate" in model.toxic and b"grombulate" not in model.ordinary
    assert b"velmarine" in model.ordinary[: -toxicity.COMMON // 2]
    assert model.ordinary not in model.toxic and model.toxic not in model.ordinary

    def length(window, content):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, source_size=2 * toxicity.WINDOW, dict_size=len(content), min_match=toxicity.LEAST_MATCH,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=words, compression_params=parameters).compress(window))

    text = rows[0][1].upper() + " ÄÖ " + "x" * 2000 + " a\tb\n c"
    pieces = toxicity.windows(text.encode())
    whole = (" " + " ".join(text.lower().split()) + " ").encode()
    assert pieces[0] + b"".join(x[1:] for x in pieces[1:]) == whole  # the byte at a cut is in both
    assert max(map(len, pieces)) <= 4 * toxicity.WINDOW + 1
    saved = np.array([length(x, model.ordinary) - length(x, model.toxic) for x in pieces], float)
    got = toxicity.features(text.encode(), toxicity._Savings(model))
    assert got[0] == saved.max() and abs(got[2] - saved.mean()) < 1e-12 and abs(got[4] - saved.std()) < 1e-12
    held = [r for r in toxicity.score(table, model).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) >= 0.95


def test_copies_of_a_passage_do_not_weigh_in_the_latent_space(spark):
    rows = [(i, prose(300 + i, 32 + 16 * (i % 5))) for i in range(150)]
    copies = [(1000 + i, rows[3][1]) for i in range(3000)]
    few, _, total = decontaminate.corpus_sums(spark.createDataFrame(rows, "doc_id long, text string"))
    many, seen, more = decontaminate.corpus_sums(spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(7))
    assert (few == many).all() and few.any()
    assert (total, more) == (150, 3150) and seen.max() >= 3000  # frequencies count every document


def test_word_test_of_candidates_is_that_of_sets(spark):
    items = [(i, prose(40 + i, 18 + i)) for i in range(8)]
    texts = [prose(90 + i, 60) + " " + (items[i % 8][1] if i % 2 else "") + " " + prose(80 + i, 40) for i in range(24)] + ["", "a"]
    hasher = decontaminate.Hasher()
    words = hasher.words([x.encode() for x in texts])
    sums = decontaminate.corpus_sums(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    space = decontaminate.latent_space(*sums)
    block = decontaminate.prepare(items, space)
    vectors, owner, start = decontaminate._passages(words, space)
    expected = []
    for p, q in np.argwhere(vectors @ block.vectors.T >= block.least).tolist():
        text, item = int(owner[p]), int(block.owner[q])
        size = len(block.words[item])
        low = max(int(start[p]) - size, int(words.first[text]))
        high = min(int(start[p]) + decontaminate.PASSAGE + size, int(words.first[text + 1]))
        there = set(words.hashes[low:high].tolist())
        if sum(x in there for x in block.words[item].tolist()) >= decontaminate.ANSWERED * size:
            expected.append((text, item, low, high))
    assert expected and list(decontaminate._candidates(words, vectors, owner, start, block)) == expected


def test_word_test_of_items_with_more_words_than_bits():
    item = " ".join(f"w{i}" for i in range(90))
    texts = [prose(1, 50) + " " + " ".join(f"w{i}" for i in range(n)) + " " + prose(2, 50) for n in (20, 48, 51, 90)]
    words = decontaminate.Hasher().words([x.encode() for x in texts])
    space = np.asfortranarray(np.random.default_rng(5).normal(size=(decontaminate.TERMS, 64)).astype(np.float32))
    block = decontaminate.prepare([(0, item)], space)
    found = decontaminate._candidates(words, *decontaminate._passages(words, space), block)
    assert {text for text, *_ in found} == {2, 3}
