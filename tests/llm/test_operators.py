"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names, against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, bpe, jaccard_join, langid, line_dedup, mixing, quality_model, quality_rules, substring_dedup, token_files
from strandline.llm.components import components
from strandline.llm.rtree import CountTree

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, key string, size string, rank string, `f` string"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "tu", "été", "ß") for b in ("ra", "so", "ti", "vu", "x")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200]))]
        if i % 4 == 1:
            words = words[:20] + passage.split() + words[20:]
        lines = [" ".join(words[k : k + 9]) + "." for k in range(0, len(words), 9)]
        texts.append("\n".join(lines))
    texts += [texts[5], texts[5], texts[8].replace("kara", "KARA", 2), texts[3] + "\n\n" + texts[3], "", " \n\t ", None, "ka", "As. " * 300, "日本語 <|endoftext|> a b\x1cc", "x" * 3000]
    near = max(texts[:40], key=lambda t: len(t)).split(" ")
    for k in range(6):
        copy = list(near)
        copy[k * 3] = f"edit{k}"
        texts.append(" ".join(copy))
    return texts


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, [None, "b", "a"][k % 3], None, "clash", "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    return table(spark, texts + [texts[0]], [*range(len(texts)), 0])  # the last row repeats the first


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().split()


# 1 ---------------------------------------------------------------------------------------------------------------


def shingles(t, k):
    w = words((t or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, docs, k, num):
    rows = texts_of(docs)
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = jaccard_join.similar_texts(docs, k, num, 100, leaf_points=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.similar_texts(empty).count() == 0


def test_null_ids_are_never_smallest(spark):
    t = " ".join(f"w{i}" for i in range(40))
    got = jaccard_join.similar_texts(table(spark, [t, t, None], [None, 7, None])).collect()
    assert sorted(str(r.component_id) for r in got) == ["7", "7", "None"]


def test_leaves_meet_for_every_linked_pair():
    rng, bands = np.random.default_rng(1), jaccard_join.Bands(90, 100)
    for n in (9, 10, 20, 57, 200, 999):
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            m = int(rng.integers(0, n // 10 + 1))
            b = np.concatenate([a[m:], rng.integers(0, 2**63, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)])
            if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
                assert np.intersect1d(bands.leaves(np.sort(a)), bands.leaves(np.sort(b))).size


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    counts = rng.poisson(2, (300, 16)).astype(np.uint32)
    counts[100:140] = counts[99] + rng.integers(0, 2, (40, 16)).astype(np.uint32)
    sizes = counts.sum(axis=1).astype(np.int64)
    want = {(i, j) for i in range(300) for j in range(i) if np.minimum(counts[i], counts[j]).sum() * 19 >= 9 * (sizes[i] + sizes[j]) and 10 * sizes[i] >= 9 * sizes[j] and 10 * sizes[j] >= 9 * sizes[i]}
    assert {(max(p), min(p)) for p in CountTree(sizes, counts).pairs(9, 10).tolist()} == want


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 202), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), f"file://{tmp_path}", "t").collect()}
    assert set(got.values()) == {1, 200} and got[100] == 1 and got[202] == 200


# 2 ---------------------------------------------------------------------------------------------------------------


def without_repeated_lines(rows, run=3, long_words=None):
    """{(doc_id, text): (lines with a word, lines removed, text left)} by looking at every window in order."""
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0])):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        dead = set()
        for n in range(1 if long_words else run, run + 1):
            for k in range(len(at) - n + 1):
                w = tuple(lines[at[k + j]] for j in range(n))
                if n < run and sum(len(words(x)) for x in w) < long_words:
                    continue
                dead |= {at[k + j] for j in range(n)} if w in seen else set()
                seen.add(w)
        want[i, t] = (len(at), len(dead), t if not dead else "\n".join(x for k, x in enumerate(lines) if k not in dead))
    return want


@pytest.mark.parametrize("run,long_words", [(1, None), (3, None), (3, 12), (4, 30)])
def test_line_dedup(spark, docs, run, long_words):
    long = [f"{name} " + " ".join(f"w{k}" for k in range(n)) for name, n in (("a", 11), ("b", 5), ("c", 29), ("d", 40))]
    more = [long[3], f"x\n{long[3]}", long[0], f"{long[0]}\ny", f"{long[1]}\n\n{long[1]}\nz", f"q\n{long[1]}\n{long[1]}", f"{long[2]}\n{long[3]}", f"{long[1]}\n{long[2]}\n{long[1]}"]
    docs = docs.union(table(spark, more, range(1000, 1000 + len(more))))
    want = without_repeated_lines(texts_of(docs), run, long_words)
    by_id = {i: x for (i, _), x in want.items()}
    got = line_dedup.remove_lines(docs, run, long_words)
    assert got.columns == [*[c for c in docs.columns], "n_lines", "n_removed"]
    assert all((r.n_lines, r.n_removed, r.text) == by_id[r.doc_id] for r in got.collect()) and got.count() == docs.count()


def test_line_dedup_of_nothing(empty):
    assert line_dedup.remove_lines(empty).count() == 0


# 3 and 9 ---------------------------------------------------------------------------------------------------------


def test_byte_bpe(docs):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, own.encode_ordinary(t or "") and tuple(own.encode_ordinary(t or "")) or (), (t or "").encode()) for i, t in texts_of(docs))
    got = bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    digest = bpe.encode_documents(docs, RANKS, P.PATTERN, digest=True).first()
    assert digest.decoded_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts_of(docs)}


def test_byte_bpe_on_odd_white_space():
    import tiktoken

    coder = bpe.coder(RANKS, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng, letters = random.Random(3), list(" \n\tab1.,'é\x00\x1c　x漢s")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["ab" * 3000, "aab" * 700 + "b" * 777, "".join(rng.choice("etaoinshrdlu") for _ in range(4000)), "x" * 30_000]
    ids = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [own.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]
    assert P.PATTERN == bpe.BY_SPACES and all(coder._heap_merge(t) == [r] for t, r in coder.ranks.items() if len(t) < 40)
    other = bpe.Coder(RANKS, r"\S+ \S+|.|\n")
    own = tiktoken.Encoding("own", pat_str=r"\S+ \S+|.|\n", mergeable_ranks=coder.ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(["a b c d", "one two"])] == [own.encode_ordinary(t) for t in ("a b c d", "one two")]


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    rows = sorted(texts_of(docs), key=lambda x: (x[0], x[1] or ""))
    ids = [e.ids + [2] for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    got = token_files.round_trip(docs, WORDS, 2, f"file://{tmp_path}", file_ids=500).collect()
    want = [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids)]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert token_files.round_trip(empty, WORDS, 2, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 8, 511, 512, 513, 5000])
def test_codes_are_addressable(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    data, asked = token_files.build(ids, [None], [n]), []
    file = token_files.TokenFile(lambda at, size: asked.append(size) or data[at : at + size])
    assert file.doc_ids == [None] and (file.document(0) == ids).all()
    for p in rng.integers(0, max(n, 1), 20 if n else 0):
        del asked[:]
        assert file.at(p) == ids[p] and sum(asked) <= 3 * 3 + 2 * (1 + 4 + token_files.BLOCK // 8)
    for a, b in rng.integers(0, n + 1, (20, 2)).tolist():
        assert (file.span(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


# 4, 8, 10 --------------------------------------------------------------------------------------------------------


def junk_and_prose(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(["the", "house", "river", "walks", "slowly", "green", "over", "under"]) + rng.choice(["", "s", "ed"]) for _ in range(120)]
        bad, toxic = i % 5 == 0, i % 11 == 0
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            w[7:9] = ["you", "idiot"]
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return spark.createDataFrame(rows + [(None, None), (n, "")], "doc_id bigint, text string"), spark.createDataFrame(labels[: n // 2] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = junk_and_prose(spark)
    got = {r.doc_id: r for r in quality_model.classify(docs, labels).collect()}
    right = [got[i].kept == (i % 5 != 0 and i % 11 != 0) for i in range(200, 400)]
    assert np.mean(right) > 0.95 and None in got and 400 in got
    assert quality_model.classify(docs.limit(0), labels.limit(0)).count() == 0
    assert quality_model.classify(docs, labels.limit(0)).count() == 402


def test_quality_classifier_learns_from_unlabelled_documents(spark):
    docs, labels = junk_and_prose(spark)
    good = labels.filter("quality = 1")  # the junk is among the documents without a label
    got = {r.doc_id: r for r in quality_model.classify(docs, good).collect()}
    assert np.mean([(got[i].quality >= 0.5) == (i % 5 != 0) for i in range(400)]) > 0.95


def test_language_id(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        lang, parts = [("aa", ["kora", "mitu", "salo"]), ("bb", ["brunk", "stelz", "dorf"]), ("cc", ["elio", "aunei", "oua"])][i % 3]
        rows.append((i, " ".join(rng.choice(parts) + rng.choice(["", "n", "s"]) for _ in range(12)), lang))
    rows += [(300, None, "aa"), (301, "... 123", "aa"), (302, "unseenword", None), (None, "kora mitu", "bb")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(303))
    assert all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 for i in range(300))
    assert got[300].lang_pred == got[301].lang_pred == "und" and got[302].lang_pred in ("aa", "bb", "cc") and got[None].lang_pred == "aa"
    assert langid.identify(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_long_words_are_read_whole(spark):
    rng = random.Random(5)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = "y" * 70 + "z"
    rows = [(text("日本語文字" if i % 2 else "ไทยกขค", 300), "ja" if i % 2 else "th", i) for i in range(40)] + [(f"{word} {word}", "th", 50), ("y" * 90, "ja", 51)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string, mark bigint"))
    mixed = [(0, text("日本語文字", 70) + text("ไทยกขค", 3000)), (1, text("ไทยกขค", 70) + text("日本語文字", 3000)), (2, word)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(mixed, "doc_id bigint, text string"), model, ["doc_id"]).collect()}
    assert got == {0: "th", 1: "ja", 2: "th"}
    for size in (1, 62, 63, 64, 65, 122, 123, 124, 125, 126, 500):
        whole = text("abcdefghij", size)
        for n in langid.LENGTHS:
            padded = f"\x02{whole}\x03" if n > 1 else whole
            assert [g for p in langid.pieces(whole) for g in langid.grams(p, n)] == [padded[i : i + n] for i in range(len(padded) - n + 1)]
    assert langid.pieces(word)[0] in model["words"]


def test_quality_measures(docs):
    def measure(t):
        t = t or ""
        w = [x.decode() for x in words(t)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    got = quality_rules.judge(docs).collect()
    want = Counter((i, *measure(t)) for i, t in texts_of(docs))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)


def verdicts(texts):
    """Whether each text is kept: votes, expectation-maximisation and posterior row by row, in numpy."""
    votes, failed = [], []
    for t in texts:
        t = t or ""
        w = [x.decode() for x in words(t)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
        lines, symbols, n = [x for x in t.split("\n") if words(x)], sum(c in "#*$%&|<>" for c in t), max(1, len(w))
        ended = sum(x.strip(" \t\n\x0b\x0c\r")[-1] in ".!?:;\"')…。]" for x in lines)
        twice, mean, m = len(lines) - len(set(lines)), sum(map(len, w)) / n, max(1, len(lines))
        failed.append(len(w) < 50 or 2 * repeated > len(w))
        votes.append([
            -(len(w) < 50), -(mean < 2.5 or mean > 12), -(symbols > 0.1 * n), -(twice > 0.3 * m and twice >= 3), -(repeated > 0.4 * n),
            -1 if ended < 0.1 * m else int(ended >= 0.5 * m), int(3 <= mean <= 9 and symbols <= 0.02 * n and repeated <= 0.35 * n),
        ])
    votes = np.array(votes)
    prior, weight = {-1: (0.3, 0.02), 0: (0.6, 0.38), 1: (0.1, 0.6)}, 1 + 0.02 * len(votes)
    belief = np.where((votes == -1).any(axis=1), 0.15, 0.95)
    for _ in range(50):
        share, z = (belief.sum() + 1) / (len(belief) + 2), 0
        for r in range(votes.shape[1]):
            rate = {v: (((1 - belief)[votes[:, r] == v].sum() + weight * prior[v][0]) / ((1 - belief).sum() + weight), (belief[votes[:, r] == v].sum() + weight * prior[v][1]) / (belief.sum() + weight)) for v in (-1, 0, 1)}
            odds = {v: np.log(good / bad) for v, (bad, good) in rate.items()}
            z = z + np.select([votes[:, r] == -1, votes[:, r] == 1], [min(0, odds[-1]), max(0, odds[1])], odds[0])
        belief = 1 / (1 + np.exp(-(z + np.log(share / (1 - share)))))
    return [bool(b >= 0.5 and not f) for b, f in zip(belief, failed)]


def test_quality_verdict_against_brute_force(spark, docs):
    rng, made = random.Random(5), texts_of(docs)
    kinds = {  # documents of several kinds between good and bad, so that the posterior decides
        "prose": lambda: "\n".join(" ".join(rng.choice(["river", "stone", "lamp", "under", "seven", "garden", f"n{rng.randrange(999)}"]) for _ in range(12)) + "." for _ in range(7)),
        "open": lambda: "\n".join(" ".join(f"word{rng.randrange(9999)}" for _ in range(9)) for _ in range(8)),
        "marks": lambda: " ".join(rng.choice(["#", "a%", "$x|", f"k{rng.randrange(99)}"]) for _ in range(80)),
        "long": lambda: ". ".join("z" * rng.randrange(9, 20) + str(k) for k in range(60)) + ".",
        "twice": lambda: "\n".join(f"line {k % 5} of {rng.randrange(2)} again." for k in range(20)),
        "short": lambda: " ".join(f"s{rng.randrange(99)}" for _ in range(rng.randrange(40, 60))),
    }
    made += [(2000 + k, kinds[rng.choice([*kinds, "prose", "prose"])]()) for k in range(300)]
    got = quality_rules.judge(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    want = Counter((i, v) for (i, _), v in zip(made, verdicts([t for _, t in made])))
    assert Counter((r.doc_id, r.kept) for r in got) == want and 50 < sum(r.kept for r in got) < 290
    assert any(not r.kept and not r.base_failed for r in got)


def test_quality_rules_catch_junk(spark, empty):
    docs, _ = junk_and_prose(spark)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not any(got[i] for i in range(0, 400, 5)) and all(got[i] for i in range(400) if i % 5)
    assert quality_rules.judge(empty).count() == 0


def test_estimate_matches_expectation_maximisation_by_rows():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.stack([np.where(good, np.where(rng.random(4000) < 0.9, 1, 0), np.where(rng.random(4000) < 0.7, -1, 0)) for _ in range(4)], axis=1)
    share, rates = quality_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), 4)
    assert share == pytest.approx(0.8, abs=0.03) and all(abs(r[-1][0] - 0.7) < 0.1 and abs(r[1][1] - 0.9) < 0.05 for r in rates)


@pytest.mark.parametrize("share", [0.1, 0.3, 0.9])
def test_estimate_is_expectation_maximisation_by_rows(share):
    rng = np.random.default_rng(7)
    good = rng.random(3000) < share
    votes = np.stack([np.where(good, rng.choice([-1, 0, 1], 3000, p=[0.05, 0.25, 0.7]), rng.choice([-1, 0, 1], 3000, p=[0.7, 0.2, 0.1])) for _ in range(5)], axis=1)
    got, rates = quality_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), 5, rounds=30)
    prior, weight = {-1: (0.3, 0.02), 0: (0.6, 0.38), 1: (0.1, 0.6)}, 1 + 0.02 * 3000
    belief = np.where((votes == -1).any(axis=1), 0.15, 0.95)
    for _ in range(30):  # one row at a time in spirit: no counts of patterns
        pi = (belief.sum() + 1) / (len(belief) + 2)
        table = [{v: (((1 - belief)[votes[:, r] == v].sum() + weight * prior[v][0]) / ((1 - belief).sum() + weight), (belief[votes[:, r] == v].sum() + weight * prior[v][1]) / (belief.sum() + weight)) for v in (-1, 0, 1)} for r in range(5)]
        z = np.full(len(votes), np.log(pi / (1 - pi)))
        for r in range(5):
            for v in (-1, 0, 1):
                x = np.log(table[r][v][1] / table[r][v][0])
                z[votes[:, r] == v] += min(0, x) if v < 0 else max(0, x) if v > 0 else x
        belief = 1 / (1 + np.exp(-z))
    assert got == pytest.approx(pi, rel=1e-6) and abs(got - share) < 0.05
    assert all(rates[r][v] == pytest.approx(table[r][v], rel=1e-6) for r in range(5) for v in (-1, 0, 1))


def test_quality_classifier_trains_on_posteriors(spark, monkeypatch):
    docs, labels = junk_and_prose(spark)
    real = quality_rules.estimate
    swapped = lambda *a, **k: (real(*a, **k)[0], [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in real(*a, **k)[1]])
    before = {r.doc_id: r.quality for r in quality_model.classify(docs, labels).collect()}
    monkeypatch.setattr(quality_rules, "estimate", swapped)
    after = {r.doc_id: r.quality for r in quality_model.classify(docs, labels).collect()}
    assert np.mean([abs(before[i] - after[i]) > 0.1 for i in range(400)]) > 0.15


def test_language_id_against_brute_force(spark):
    rng, rows = random.Random(11), []
    for i in range(90):
        parts = [["kora", "mitu", "salo"], ["brunk", "stelz", "dorf"], ["elio", "aunei", "oua"]][i % 3]
        rows.append((i, " ".join(rng.choice(parts) + rng.choice(["", "n", "s", "x" * 70]) for _ in range(9)), "abc"[i % 3] * 2))
    rows += [(i, t, "aa") for i, t in ((90, "korastelz unknown zzz"), (91, "ou kor bru"), (92, "elio! 99 (mitu)"))]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    counts = [Counter() for _ in range(5)]
    for _, text, lang in learned:
        for chunk in text.split():
            for w in langid.pieces(langid.clean(chunk)):
                counts[0][w, lang] += 1
                for n in langid.LENGTHS:
                    for g in langid.grams(w, n):
                        counts[n][g, lang] += 1
    langs = sorted({r[2] for r in learned})
    items = [{x for x, _ in c} for c in counts]
    log = lambda n, x: np.array([np.log((counts[n][x, lang] + 0.5) / (sum(c for (_, g), c in counts[n].items() if g == lang) + 0.5 * (len(items[n]) + 1))) for lang in langs])
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    for i, text, _ in rows[::7] + rows[-3:]:
        z = np.zeros(len(langs))
        for chunk in text.split():
            for w in langid.pieces(langid.clean(chunk)):
                if w in items[0]:
                    z += log(0, w)
                else:
                    known = next((k for n in langid.LENGTHS if (k := [log(n, g) for g in langid.grams(w, n) if g in items[n]])), [np.zeros(len(langs))])
                    z += np.mean(known, axis=0)
        assert got[i].lang_pred == langs[int(z.argmax())] and got[i].score == pytest.approx(1 / np.exp(z - z.max()).sum(), rel=1e-3)


def test_language_sample_is_shared_out():
    assert langid.shares({"a": 10**11, "b": 10**11}, 8_000) == {"a": 4_000 / 10**11, "b": 4_000 / 10**11}
    assert langid.shares({"a": 1_000_000, "b": 50, "c": 3_000}, 1_000) == pytest.approx({"b": 1, "c": 475 / 3_000, "a": 475 / 1_000_000})


def test_very_long_texts(spark):
    rng = random.Random(3)
    many = " ".join(f"w{rng.randrange(50_000)}" + ("\n" if k % 40 == 0 else "") for k in range(250_000))
    texts = [many, "x" * 1_000_000, many + " end"]
    docs = table(spark, texts)
    n = [len(words(t)) for t in texts]
    got = {r.doc_id: r for r in jaccard_join.similar_texts(docs).collect()}
    assert [got[i].component_id for i in range(3)] == [0, 1, 0] and got[1].n_shingles == 1
    assert [r.n_words for r in quality_rules.judge(docs).orderBy("doc_id").collect()] == n
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs, digest=True).orderBy("doc_id").collect()] == [n[0], 0, n[0]]
    assert [r.n_removed > 0 for r in line_dedup.remove_lines(docs).orderBy("doc_id").collect()] == [False, False, True]
    assert [r.decoded_sha256 for r in bpe.encode_documents(docs, RANKS, P.PATTERN, digest=True).orderBy("doc_id").collect()] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert token_files.round_trip(docs, WORDS).count() == 3 and langid.identify(docs).count() == 3 and quality_model.classify(docs).count() == 3


# 5 ---------------------------------------------------------------------------------------------------------------


def test_equal_rows_are_told_apart(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(100)), "a", x) for x in "pqr"] + [(2, "z " * 60, "b", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key string")
    taken = Counter()
    for r in mixing.mix(docs, block_words=8).collect():
        taken[r.doc_id] += r.taken
    held = Counter()
    for r in mixing.mixed_documents(docs, block_words=8).collect():
        held[r.doc_id] += len(words(r.text))
    assert held == taken


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, block_words=8, shard_words=700).collect()
    sizes = Counter((r.doc_id, r.source, r.size) for r in got)
    assert sizes == Counter((r.doc_id, r.source, len(words(r.text))) for r in docs.collect())
    per = {}
    for r in got:
        s = per.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(per, key=lambda s: (s is None, s))
    left, want, free = 1.5 * sum(s[0] for s in per.values()), {}, dict(zip(order, [3, 1, 2] * 9))
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * per[s][0]] or list(free)
        for s in over:
            want[s] = min(2 * per[s][0], level * free[s])
        stop = len(over) == len(free)
        for s in over:
            left -= want[s]
            del free[s]
        if stop:
            break
    for s, (size, taken, target, source_size) in per.items():
        assert size == source_size and target == pytest.approx(want[s]) and abs(taken - target) <= 100
    again = mixing.mix(docs, block_words=8, shard_words=700).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    for weights, seats in (([53, 24, 23], 10), ([1, 1, 1, 1], 6), ([1000, 1, 1], 5), ([7, 0, 3], 4), ([5], 0)):
        df = spark.createDataFrame([(0, i, float(w), seats) for i, w in enumerate(weights)], "g int, i int, w double, seats bigint")
        got = {r.i: r.out for r in mixing.apportion(df, ["g"], "w", "seats", [F.col("i")], "out").collect()}
        won = Counter()
        for _ in range(seats):
            won[max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
        assert got == {i: won[i] for i in range(len(weights))}


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs, block_words=8)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.mix(docs, block_words=8).collect():
        taken[r.doc_id] += r.taken
    held = Counter()
    for r in out.collect():
        held[r.doc_id] += len(words(r.text))
    assert all(abs(held[i] - n) <= 1 for i, n in taken.items())


# 6 ---------------------------------------------------------------------------------------------------------------


def vectors(spark, n, d=8, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    v[1] = v[0]
    rows = [(i, [float(x) for x in v[i]], "clash") for i in range(n)]
    odd = [(5000, None, ""), (5020, [0.0] * d, ""), (5040, [float("nan")] * d, ""), (5060, [float("inf")] * d, ""), (5080, [1.0, None] + [1.0] * (d - 2), ""), (None, [1.0] * d, ""), (5100, [1.0], "")]
    return v.astype(float), spark.createDataFrame(rows + odd + rows[:2], "vec_id bigint, embedding array<float>, score string")


@pytest.mark.parametrize("n", [3, 15, 900])
def test_nearest_neighbours(spark, n):
    v, df = vectors(spark, n)
    got = {}
    for r in ann.search(df, "vec_id", "embedding", list_rows=100, cell_rows=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, n, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[: min(20, n - 1)]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1)) and q not in {i for _, i, _ in mine}
        assert all(x == pytest.approx(s[i], abs=1e-12) for _, i, x in mine)
        hits, total = hits + len(set(best) & {i for _, i, _ in mine}), total + len(best)
    assert set(got) == set(range(0, n, 20)) and hits >= 0.9 * total


def test_equal_vectors_tie_by_id(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64)).astype(np.float32)
    v = base[rng.integers(0, 40, 1000)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(1000)], "vec_id bigint, embedding array<float>")
    of, hits, total = [tuple(x) for x in v.tolist()], 0, 0
    for q, rows in _by_query(ann.search(df, "vec_id", "embedding", list_rows=100)).items():
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows) and len(rows) == 20
        scores = {}
        for _, i, s in rows:
            assert scores.setdefault(of[i], s) == s  # equal vectors, equal scores
        exact = ann.inner(v.astype(float), v[q].astype(float))
        assert all(exact[i] == s for _, i, s in rows)
        for c in scores:  # of equal vectors those of smallest id
            mine = [i for _, i, _ in rows if of[i] == c]
            assert mine == [i for i in range(1000) if of[i] == c and i != q][: len(mine)]
        hits += sum(s >= np.sort(np.delete(exact, q))[-20] for _, _, s in rows)
        total += 20
    assert hits >= 0.9 * total


def _by_query(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in got.items()}


def test_nearest_neighbours_of_nothing(spark):
    assert ann.search(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>"), "vec_id", "embedding").count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window,anchor", [(35, 8), (5, 2)])
def test_substring_dedup(docs, empty, window, anchor):
    rows = texts_of(docs)
    cut = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in cut for k in range(len(w) - window + 1))
    want = Counter()
    for i, w in cut:
        dead = {k + j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(window)}
        want[i, len(w), len(dead), b" ".join(x for k, x in enumerate(w) if k not in dead).decode()] += 1
    got = substring_dedup.remove_repeats(docs, window, anchor).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_samples_of_very_large_tables_are_not_empty(spark):
    """Of 10 ** 11 documents a language, and of 10 ** 15 vectors, the thresholds still let the sample's share through."""
    from strandline.llm.common import sampled, threshold

    for n in (10**4, 10**9, 10**11, 10**15):
        share = 4_000 / n if n > 4_000 else 1
        below = threshold(share)
        assert -(2**63) < below < 2**63 and abs((below + 2**63) / 2**64 * n - 4_000) < 1
    marks = spark.range(1000).select((F.lit(-(2**63) + 1) + F.col("id") * (2**64 // 10**11)).alias("mark"))
    assert marks.filter(sampled(F.col("mark"), 400 / 10**11)).count() in (400, 401)  # the step is rounded down
    assert marks.filter(sampled(F.col("mark"), 1)).count() == 1000


def test_many_languages(spark, monkeypatch):
    """300 languages, one of them with nine tenths of the rows: all are learned, whether rows are made at once or when asked for."""
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    rows = [(f"l{k:03d}", " ".join(letters[3 * k + rng.randrange(3)] * rng.randrange(1, 4) for _ in range(12))) for k in range(300) for _ in range(3)]
    rows += [("l000", " ".join(letters[rng.randrange(3)] for _ in range(10))) for _ in range(8_000)]
    train = spark.createDataFrame(rows, "lang string, text string").withColumn("mark", F.xxhash64(F.monotonically_increasing_id()))
    model = langid.train(train, 500)
    assert len(model["langs"]) == 300
    found = []
    for cells in (langid.CELLS, 10):
        monkeypatch.setattr(langid, "CELLS", cells if cells > 10 else 300 * 400)
        scorer = langid.Scorer(model)
        assert bool(scorer.base) == (cells > 10)
        found.append([scorer.score(text) for _, text in rows[:900]])
    assert [a for a, _ in found[0]] == [b for b, _ in found[1]] == [lang for lang, _ in rows[:900]]
    assert np.allclose([a for _, a in found[0]], [b for _, b in found[1]], atol=1e-5)


def test_a_language_without_a_sample_is_an_error(spark):
    rows = spark.createDataFrame([("aa", "some words", 2**63 - 1)] * 100_000, "lang string, text string, mark bigint")
    with pytest.raises(ValueError, match="aa"):
        langid.train(rows, 100)
