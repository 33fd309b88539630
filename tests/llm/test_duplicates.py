import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest import WORDS, prose

from tableprep.llm import decontaminate, line_dedup, ngram_join, suffix_dedup
from tableprep.llm.common import documents
from tableprep.llm.words import Hasher


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    """Component of each row by comparing all pairs; rows are told apart by their place."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, row in enumerate(rows):
        ids[find(i)].append(row[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def test_join_equals_all_pairs(docs, corpus, empty):
    assert Counter(tuple(r) for r in ngram_join.link(docs).collect()) == classes(corpus)
    assert ngram_join.link(empty).collect() == []


def test_chains_of_near_copies_are_followed(spark):
    """Each copy is near the one before; far ends are linked through the middle only."""
    words = prose(1, 120).split()
    rows = []
    for i in range(30):
        words = words[4:] + prose(500 + i, 4).split()
        rows.append((30 - i, " ".join(words)))
    rows += [(100 + i, prose(900 + i, 12) + " " + prose(2, 40)) for i in range(25)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == classes(rows)


def test_blocks_of_linked_sets_meet():
    random = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 7, 9, 13, 20, 40, 100, 257, 300, 700, 2000):
        for _ in range(20):
            a = np.unique(random.integers(0, 1 << 62, n).astype(np.uint64))
            gone = random.integers(0, n // 7 + 1)
            b = np.unique(np.r_[a[gone:], random.integers(0, 1 << 62, random.integers(0, n // 7 + 1)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.block_keys(a, 0.75), ngram_join.block_keys(b, 0.75)))


def test_hashes_follow_words_not_places():
    hasher = Hasher()
    one = hasher.words([b"a bc  def", b"", b"DEF\tbc a"])
    assert one.first.tolist() == [0, 3, 3, 6]
    assert one.hashes[:3].tolist() == one.hashes[3:][::-1].tolist()
    assert len(set(one.hashes.tolist())) == 3


def removed(rows):
    """By the definition: strings of 50 bytes that start in a smaller id."""
    first = {}
    for own, text, *_ in rows:
        data, own = (text or "").encode(), np.inf if own is None else own
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(first.get(data[k : k + 50], np.inf), own)
    out = Counter()
    for row in rows:
        data, own = (row[1] or "").encode(), np.inf if row[0] is None else row[0]
        mask = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < own:
                mask[k : k + 50] = True
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        spans = int((mask & ~np.r_[False, mask[:-1]][: len(mask)]).sum())
        out[row[0], len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_removed_bytes_equal_the_definition(docs, corpus, empty):
    got = suffix_dedup.remove_repeats(docs, digest=True)
    assert Counter(tuple(r) for r in got.collect()) == removed(corpus)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_periodic_and_binary_like_texts(spark):
    rows = [(1, "ab" * 100), (2, "x" + "ab" * 40), (3, "\0" * 120), (4, "a\0" + "\0" * 70), (5, "ab" * 30 + "\U0001f600" * 30), (6, "\U0001f600" * 25)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)
    assert Counter(tuple(r) for r in got.collect()) == removed(rows)


def test_merged_transforms_order_all_strings(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    random = np.random.default_rng(2)
    texts = [bytes(random.integers(97, 99, random.integers(50, 90)).astype(np.uint8)) for _ in range(40)]
    texts += [texts[3][5:60], texts[7] + b"tail"]
    texts = [t for t in texts if len(t) >= 50]
    least = random.permutation(len(texts)).astype(np.int64)
    found, first = suffix_dedup.least_ids(texts, least)
    best = {}
    for t, m in zip(texts, least, strict=True):
        for k in range(len(t) - 49):
            best[t[k : k + 50]] = min(best.get(t[k : k + 50], 10**9), int(m))
    for i, t in enumerate(texts):
        assert found[first[i] : first[i + 1]].tolist() == [best[t[k : k + 50]] for k in range(len(t) - 49)]


def test_lines_recur_by_template(spark):
    vary = ["node", "disk", "port", "link", "host", "rack"]
    rows = [(i, f"own line {prose(i, 8)}\nservice restarted after {vary[i]} timeout number {i}\n\nplain footer") for i in range(6)]
    rows += [(10, "plain footer once\nplain footer once\nplain footer once"), (11, None), (12, ""), (None, "plain  footer\nmine alone here")]
    got = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert got[i].text.split("\n") == [rows[i][1].split("\n")[0], ""]
        assert (got[i].n_lines, got[i].n_dropped) == (4, 2)
    assert got[10].text == rows[6][1] and got[10].n_dropped == 0
    assert got[None].text == "mine alone here"
    assert [(got[i].text, got[i].n_lines) for i in (11, 12)] == [("", 0), ("", 0)]


def test_a_leaf_holds_several_templates_whatever_its_size(spark):
    name = lambda i: WORDS[i % 80] + WORDS[(i * 7 + i // 80) % 80]
    kinds = ["user {} logged in", "disk {} is full", "host {} went away", "port {} was closed", "link {} came up", "rack {} lost power"]
    rows = [(i, f"2024-01-01 12:00:00 INFO {kinds[i % 6].format(name(i))}\nown {name(i)} {name(i + 900)} {name(2 * i)}") for i in range(60)]
    # Ten documents of a template among 400 whose lines of that length and beginning are their own.
    rows += [(100 + i, f"the daemon at {name(300 + i)} has stopped working now") for i in range(10)]
    rows += [(200 + i, "the daemon at " + " ".join(name(400 * j + i) + str.join("", "abcde"[j:]) for j in range(5))) for i in range(400)]
    # The words that vary are more frequent in the leaf than those that stay.
    rows += [(700 + i, f"we now say {'red' if i < 40 else WORDS[i]} {name(i)} x{'abcdefgh'[i % 8]} z") for i in range(40)]
    rows += [(800 + i, f"we now say {x} odd pair here") for i, x in enumerate(["red", "lo", "mi"])]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == [rows[i][1].split("\n")[1] for i in range(60)]
    assert [got[100 + i] for i in range(10)] == [""] * 10
    assert [got[i] for i in range(200, 600)] == [t for i, t in rows if 200 <= i < 600]
    assert [got[800 + i] for i in range(3)] == [""] * 3


def test_lines_of_every_row(docs, corpus, empty):
    got = line_dedup.drop_recurring(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus)
    shape = lambda x: " ".join("<*>" if re.search("[0-9]", t) else t for t in x.split())
    documents = Counter()
    for _, text in {(r[0], r[1] or "") for r in corpus}:
        documents.update({shape(x) for x in text.split("\n") if x.strip()})
    kept = Counter()
    for r in got:
        kept.update({shape(x) for x in r.text.split("\n") if x.strip()})
    assert not [x for x in kept if documents[x] >= 3]
    assert line_dedup.drop_recurring(empty).collect() == []


def test_packed_buckets_list_only_their_own_sets(docs):
    """Lists of all sets of a batch, once a part, would grow with the batches times the parts."""
    blocks = ngram_join.block_rows(documents(docs), 5, 0.75, 4096).where("entries IS NOT NULL")
    sizes = blocks.selectExpr("octet_length(sets) AS sets", "octet_length(entries) AS entries").collect()
    assert sizes and all(0 < r.sets <= r.entries for r in sizes)


def test_only_segments_that_may_share_a_string_are_sorted():
    """Of segments of one anchor most differ right beside it; those were sorted as well."""
    random = np.random.default_rng(4)
    some = lambda n: bytes(random.integers(97, 123, n).astype(np.uint8))
    runs = suffix_dedup.Runs(some(4000), [4000], [1])
    texts = [runs.data[a : a + n + 49] for a, n in zip(runs.start.tolist(), runs.count.tolist(), strict=True) if n > 20]
    assert not suffix_dedup.may_share(texts).any()
    # Bytes before the string may differ, or behind it, as long as the anchor stays the first least one.
    other = [t[1:] for t in texts] + [t[:-1] for t in texts]
    assert suffix_dedup.may_share(texts + other).all()
    # The anchor is the least hash of the 16-byte strings, wherever it stands; both sides of it are changed.
    upper = suffix_dedup._hashes(runs.data, 16) >> np.uint64(32)
    changed = []
    for a in runs.start[runs.count > 20].tolist():
        at = a + int(upper[a : a + 35].argmin())
        data = bytearray(runs.data)
        for i in (at - 9, at + 24):
            if 0 <= i < len(data):
                data[i] = 35
        t = bytes(data[a : at + 16 + 34])
        if len(t) >= 50 and (suffix_dedup._hashes(t, 16)[:35] >> np.uint64(32)).argmin() == at - a:
            changed.append((runs.data[a : at + 16 + 34], t))
    assert len(changed) > 20
    assert not suffix_dedup.may_share([x for pair in changed for x in pair]).any()


def test_strings_are_found_beside_few_common_bytes(spark):
    """Passages of just over and just under the length, at many places of other texts."""
    rows = [(i, prose(i, 14)[: 20 + 3 * i] + prose(900, 40)[7 * i : 7 * i + 44 + i] + prose(100 + i, 14)[i:]) for i in range(25)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), digest=True)
    assert Counter(tuple(r) for r in got.collect()) == removed(rows)


def test_buckets_of_one_set_or_of_two_need_no_more(spark):
    """Copies in several batches share all buckets with themselves; a pair is settled when it is compared."""
    near = lambda i, n: [(i + k, prose(i, 120) + f" tail{k if k else ''}") for k in range(n)]
    alone, two, three = [(i, prose(1, 80)) for i in range(6)], near(100, 2), near(200, 3)
    df = spark.createDataFrame(alone + two + three, "doc_id long, text string").repartition(4)
    found = ngram_join.members(ngram_join.block_rows(documents(df), 5, 0.75, 3), 3).collect()
    sets, more = defaultdict(set), defaultdict(set)
    for r in found:
        sets[r.bucket].add(r.set_id)
        more[r.bucket].add(r.more)
    assert {len(x) for x in sets.values()} >= {2, 3} and min(map(len, sets.values())) > 1
    assert all(x == {True} for b, x in more.items() if len(sets[b]) > 2)


def test_texts_of_a_batch_are_taken_out_a_few_at_a_time():
    """All texts of a batch stood beside it, as strings and as bytes."""
    texts = [prose(i % 50, 300) for i in range(30_000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    tracemalloc.start()
    n = sum(len(some) for _, some in decontaminate._texts(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and 3 * peak < batch.nbytes
