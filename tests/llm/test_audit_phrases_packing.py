"""Filter audit, phrases and packing on small tables against brute force."""

import random
import re
import struct
from collections import Counter, defaultdict
from itertools import permutations
from math import gcd

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import filter_audit, packing, phrases
from strandline.llm.bloom import Bloom
from tests.llm.test_operators import corpus, table

BYTES = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus() + ["Many $ words " * 90, "UPPER " * 150 + "x", "w" * 1_000_000, " ".join(map(str, range(120_000)))]
    return table(spark, texts + [texts[0], texts[3], None], [*range(len(texts)), 0, None, None])


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# 11 --------------------------------------------------------------------------------------------------------------


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_audit(spark, docs, rows):
    labels = [(0, 1, 0, "x"), (1, 1, 1, "x"), (1, 0, 0, "x"), (2, 0, None, "x"), (5, None, 1, "x"), (None, 1, 1, "x"), (7, 1, 0, "x"), (9, 1, 1, "x")]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint, text string")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, labels).collect()}
    good, toxic = {0, 1, 7, 9}, {1, 5, 9}
    facts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = split(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        facts[lang or ""].append((f, i in good, i in toxic))
    assert len(got) == len(facts) * 600
    for part, found in facts.items():
        removals = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(found)
            for step, x in enumerate(order, 1):
                out = [y for y in left if y[0][x]]
                left = [y for y in left if not y[0][x]]
                removals[x] += len(out)
                r = got[part, "".join(order), step]
                alone = sum(y[0][x] and sum(y[0].values()) == 1 for y in found)
                want = (len(left), len(out), sum(y[0][x] for y in found) - len(out), alone, sum(y[1] for y in out), sum(y[2] for y in out))
                assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                assert got[part, "".join(order), step].shapley == removals[x]


def test_audit_of_other_filters(spark):
    """Any filters, many parts, null parts and marks."""
    rng = random.Random(3)
    data = [(rng.choice(["p", "q", None, *map(str, range(40))]), rng.randrange(8), rng.choice([True, False, None])) for _ in range(3000)]
    counts = filter_audit.subset_counts(spark.createDataFrame(data, "part string, bits int, mark boolean"), "part", "bits", ["mark"], 3)
    got = {(r.part, r.passed): (r.n, r["mark"]) for r in counts.collect()}
    for part in {p for p, _, _ in data}:
        for s in range(8):
            passing = [m for p, b, m in data if p == part and not b & s]
            assert got[part, s] == (len(passing), sum(bool(m) for m in passing))


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint")
    assert filter_audit.audit(empty, labels).count() == 0


# 12 --------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    """Counts of all phrases, then the rules one by one; the parts' counts are taken from all texts."""
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        inside = lambda p: any(len(q) > len(p) and 100 * b >= 100 * often[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items())
        found = []
        for p, a in often.items():
            if not inside(p):
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], n[lang], score))
        out += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top", [(4, 5, 2000), (2, 4, 60), (3, 3, 2000)])
def test_phrases(docs, rows, least, longest, top):
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, longest, top).collect())
    assert got == brute_phrases(rows, least, longest, top) and got


def test_phrases_in_small_shards(docs, rows, monkeypatch):
    """Shards, numbers and batches that begin anew after a few words give the same."""
    for name, value in (("MOST_PLACES", 300), ("SHARD_WORDS", 50), ("KNOWN", 40), ("MOST_WORDS", 20)):
        monkeypatch.setattr(phrases, name, value)
    assert not list(phrases._shards(iter([]), None))
    batch = pa.RecordBatch.from_pylist([{"lang": l or "und", "text": (t or "").encode()} for _, t, l in rows])

    class All:
        def held(self, f):
            return f == f

    total = Counter()
    for shard in phrases._shards(iter([batch]), All()):
        for lang, x, at, keys in shard.parts():
            words = shard.numbers.words
            total.update((lang, words[x[i]], words[x[i + 1]]) for i in at.tolist())
            assert len(set(keys.tolist())) == len({(words[x[i]], words[x[i + 1]]) for i in at.tolist()})
    f = Counter()
    for _, t, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (t or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            f.update((lang or "und", a, b) for a, b in zip(w, w[1:]))
    assert total == f


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(60):
        runs = Counter({tuple(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 4) for _ in range(6)})
        a = phrases.SuffixAutomaton()
        for run, weight in runs.items():
            a.add(run, weight)
        a.counted()
        f, before, after = Counter(), defaultdict(Counter), defaultdict(Counter)
        for run, weight in runs.items():
            for i in range(len(run)):
                for j in range(i + 1, min(len(run), i + 4) + 1):
                    f[run[i:j]] += weight
                    before[run[i:j]][run[i - 1] if i else None] += weight
                    after[run[i:j]][run[j] if j < len(run) else None] += weight
        sole = lambda c: next(iter(c)) if len(c) == 1 else None
        got = {s: (n, b, e) for s, n, b, e in a.substrings(1, 4)}
        assert got == {s: (n, sole(before[s]) if len(s) < 4 else None, sole(after[s]) if len(s) < 4 else None) for s, n in f.items()}


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 64 bits."""
    n, a, l, r = 9_999_999_999_999_999, 123_456_789_012_345, 987_654_321_098_765, 222_333_444_555_666_777
    parts = spark.createDataFrame([("x", "p", l), ("x", "q", r)], "lang string, phrase string, a bigint")
    got = phrases.scored(spark.createDataFrame([("x", "p q", a)], "lang string, phrase string, a bigint"), parts, spark.createDataFrame([("x", n)], "lang string, n bigint")).collect()
    assert [x.score for x in got] == [1000 * a * n // (l * r)] and gcd(a, n) and 1000 * a * n > 2**64 and l * r > 2**64


def test_phrases_of_nothing(spark, empty, docs):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(docs.select("doc_id", "text", "lang"), 10**6).count() == 0


def test_bloom_loses_nothing(spark):
    ids = spark.range(5000).select(F.xxhash64("id").alias("f"))
    bloom = Bloom.of(ids, 5000)
    assert bloom.held(np.array([r.f for r in ids.collect()], np.int64)).all()


# 13 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def ids_of(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def check_packing(tokenizer, rows, pieces, size, end):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 1 <= p.length <= size and len(p.ids) == 4 * p.length
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(ids_of(tokenizer, t or "") + struct.pack("<I", end))
    assert set(docs) == set(want)
    for i, texts in want.items():
        if len(texts) == 1:
            at = 0
            for p in sorted(docs[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0]) // 4
                at += p.length
            assert b"".join(p.ids for p in sorted(docs[i], key=lambda p: p.start)) == texts[0]
        else:  # rows of one doc_id: each is there whole
            found = Counter((p.start, p.ids) for p in docs[i])
            assert sum(p.length for p in docs[i]) == sum(map(len, texts)) // 4
            assert all(n <= len(texts) for n in found.values())
    padding = 0
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / sum(p.length for p in pieces)


@pytest.mark.parametrize("size,end", [(1024, 0), (64, 50256), (1, 7)])
def test_packing(docs, rows, tokenizer, size, end):
    small = docs if size > 1 else docs.filter("length(text) < 3000 or text is null")
    kept = rows if size > 1 else [r for r in rows if len(r[1] or "") < 3000]
    pieces = packing.pack_documents(small, BYTES, end, size).collect()
    assert check_packing(tokenizer, kept, pieces, size, end) < 0.01


def test_packing_in_small_batches(docs, rows, tokenizer):
    pieces = packing.pack_documents(docs.coalesce(1), BYTES, 0, 1024, batch_ids=900).collect()
    assert check_packing(tokenizer, rows, pieces, 1024, 0) < 0.01


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, BYTES).count() == 0


def test_tightest_window():
    rng = random.Random(2)
    tree, held = packing.OpenWindows(100), []
    for k in range(3000):
        if rng.random() < 0.5:
            held.append((rng.randrange(1, 101), k))
            tree.put(*held[-1])
        n = rng.randrange(1, 101)
        found = tree.tightest(n)
        assert (found is None) == all(c < n for c, _ in held)
        if found:
            assert found[0] == min(c for c, _ in held if c >= n)
            held.remove(found)


def test_pack_is_best_fit_decreasing():
    """Without topping up: each item, longest first, goes to the tightest window that takes it."""
    rng = random.Random(9)
    lengths = [rng.randrange(1, 129) for _ in range(400)]
    rooms, where = [], {}
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(room, w) for w, room in enumerate(rooms) if room >= lengths[item]]
        if not fits:
            rooms.append(128)
            fits = [(128, len(rooms) - 1)]
        room, w = min(fits)
        rooms[w] -= lengths[item]
        where[item] = w
    got = packing.pack(lengths, 128, slack=128)
    assert sorted(128 - sum(n for _, _, n in w) for w in got) == sorted(rooms)
    assert all(sum(n for _, _, n in w) <= 128 for w in got) and sorted(i for w in got for i, _, _ in w) == sorted(where)


def test_spaced_coder_is_the_library(tokenizer):
    coder = packing.spaced_coder(BYTES)
    assert coder.by_spaces
    rng = random.Random(1)
    parts = ["a", "B", "the", " ", " ", "  ", "\n", "\t", "'s", "'ll", "'", "é", "ß", "日本", "1", "23", ".", ",", "!?", "\x1c", "　", "\xa0", " ", "<|", "<|endoftext|>", "\r", "*", "$", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for t in [*corpus(), *texts]:
        assert coder.encode(t or "") == ids_of(tokenizer, t or "")
