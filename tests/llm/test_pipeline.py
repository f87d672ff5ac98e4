import base64
import os
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm.common import noted, work_dir

from .test_operators import RANKS, shingles, verdicts, without_repeated_lines, words


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The first documents of the smallest table, with some nulls and a repeated row."""
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 120).to_pylist()
    t[3] = t[3] | {"text": None}
    t[4] = t[4] | {"lang": None, "source": None}
    t.append(dict(t[6]))
    passage = " ".join(f"shared{k}" for k in range(60)) + "."  # in one line of several documents, and a document of its own
    t += [dict(t[k], doc_id=10**6 + k, text=f"{t[k]['text']} {k}\n{passage}\nend {k}.") for k in (10, 11, 12)]
    t.append(dict(t[13], doc_id=10**6 + 13, text=passage))
    out = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.Table.from_pylist(t), out / "documents.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, folder).cache()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        a, b = before.collect(), docs.collect()
        assert b
        if k == 0:
            assert Counter(map(str, b)) == Counter(str(r) for r, v in zip(a, verdicts([r.text for r in a])) if v)
        if k == 1:
            left = without_repeated_lines([(r.doc_id, r.text) for r in a], 3, 50)
            want = [(r.doc_id, left[r.doc_id, r.text][2]) for r in a]
            assert Counter((r.doc_id, r.text) for r in b) == Counter((i, t) for i, t in want if words(t))
            assert sum("shared30" in r.text for r in a) > 2 and sum("shared30" in r.text for r in b) == 1
        if k == 2:
            sets = {(r.doc_id, r.text): shingles(r.text, 5) for r in a}
            group = {x: x for x in sets}  # the smallest member known of each group, until nothing changes
            links = [(x, y) for x in sets for y in sets if x < y and sets[x] and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])]
            while any(group[x] != group[y] for x, y in links):
                for x, y in links:
                    group[x] = group[y] = min(group[x], group[y])
            assert Counter((r.doc_id, r.text) for r in b) == Counter(x for x in sets if group[x] == x) and len(b) < len(a)
        if k == 3:
            old, taken, source = {r.doc_id: words(r.text) for r in a}, Counter(), Counter()
            for r in b:
                assert words(r.text) == old[r.doc_id][: len(words(r.text))] and r.n_chars == len(r.text)
                taken[r.doc_id] += len(words(r.text))
                source[r.source] += len(words(r.text))
            assert all(n <= 2 * len(old[i]) for i, n in taken.items())
            sizes, names = Counter(), sorted({r.source for r in a}, key=lambda x: (x is None, x))
            for r in a:
                sizes[r.source] += len(old[r.doc_id])
            want, left, free = {}, 1.5 * sum(sizes.values()), dict(zip(names, [3, 1, 2] * 9))
            while free:
                level = left / sum(free.values())
                stop = [x for x in free if level * free[x] > 2 * sizes[x]] or list(free)
                for x in stop:
                    want[x] = min(2 * sizes[x], level * free[x])
                left -= sum(want[x] for x in stop)
                free = {x: w for x, w in free.items() if x not in stop}
            assert all(abs(source[x] - want[x]) <= 64 * 2 for x in names)
        if k == 4:
            with open(RANKS, "rb") as f:
                ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            ids = Counter((r.doc_id, r.text, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.n_tokens) for r in b)
            assert ids == Counter((r.doc_id, r.text, tuple(x := own.encode_ordinary(r.text)), len(x)) for r in a)


def test_other_columns_pass_through(spark, folder):
    names = ["n_words", "kept", "quality", "vote_length", "__key", "key", "n_lines", "n_removed", "row", "size", "taken", "copy", "starts", "of", "a.b"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    docs = docs.select("*", *[F.lit(c).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[-len(names) :] == names
        assert docs.count() and all(list(r)[-len(names) :] == names for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_of_rows_equal_in_id_and_text_the_same_stays(spark):
    rows = [(1, "one two three four five six", x, {"k": y}) for x, y in (("b", 1), ("a", 2), (None, 3), ("a", 1))]
    rows += [(None, "seven eight nine ten eleven", "z", None), (None, None, "y", None), (None, None, "x", None)]
    for part, order in ((1, rows), (4, rows[::-1])):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string, more map<string, int>").repartition(part)
        got = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
        assert sorted(((r.doc_id, r.lang, r.more) for r in got), key=str) == [(1, "a", {"k": 1}), (None, "x", None), (None, "z", None)]


def test_two_runs_in_one_driver(spark, folder):
    with noted() as inner:
        one = corpus_pipeline.run(spark, folder)
    two = corpus_pipeline.run(spark, folder)
    assert len(corpus_pipeline.STAGES) == 5 and one.count() > 0
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    with noted() as others:
        mine = work_dir(spark)
    assert others == [mine] and mine not in inner and len(inner) > 3
    kept = [x for x in inner if os.path.isdir(x.removeprefix("file://"))]
    assert len(kept) <= 2  # the folder of the run, whose last table is read, and what the last stage made
