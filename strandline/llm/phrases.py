"""Collocations: phrases of up to five words that occur often and more than their parts let one expect.

Three passes over the texts, none of which holds more than a shard of them, and what they leave:

1. Words are counted in each task and then over all. A Bloom filter of the frequent ones goes to the tasks.
2. Pairs of neighbouring frequent words are counted by 64-bit hashes, which gives a Bloom filter of pairs that may be
   frequent. A phrase is frequent only if all its words and pairs are, so pieces are cut wherever a pair is not.
3. Equal runs of words between the cuts are counted. Triples of words in them are then counted as pairs were, and runs cut
   on at those that are not frequent, so that the middle word ends one part and begins the next.
4. The parts of a shard go into a generalised suffix automaton. Its states are sets of end places; their sizes, summed
   along suffix links from the longest, are the counts of all substrings, which a walk of bounded depth enumerates.
   Counts of shards are summed by the phrases themselves.

A phrase is subsumed by a longer one that occurs as often. Then every one of its places is followed, or is preceded, by the
same word, in each shard. In an automaton it is preceded by one word where it is not the longest of its state (its suffix
link starts below it), and followed by one where a transition leads to a state of the same size. Shards hand these two
words on with the counts; a phrase is subsumed if they all name one.

Scale: filters let more through when their bits do not suffice, but lose nothing; results are the same. Everything that
is shuffled has been counted in a shard before, so that a passage in a third of all rows is one row a shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .bloom import Bloom
from .common import drop, save, ship, work_dir

#: Distinct words that a task counts, and word places whose pairs it counts, before it hands the counts on.
MOST_WORDS, MOST_PLACES = 250_000, 2_000_000
#: Words of the distinct runs in one automaton, at most (or one longer run); distinct words that a task knows by number, and
#: phrases whose counts it holds, before it hands the counts on.
SHARD_WORDS, KNOWN, MOST_PHRASES = 60_000, 250_000, 250_000

#: Characters that end a piece become line feeds, a tab a space.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Generalised suffix automaton of weighted sequences: its states are the sets of places where substrings end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.where = [0]  # one end place, in all sequences one after another
        self.text: list[int] = []

    def _state(self, length: int, where: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        self.where.append(where)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest of p with c: that p leads to, or a copy of it for the shorter substrings."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.where[q], dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Sequence[int], weight: int) -> None:
        last = 0
        for place, c in enumerate(sequence, len(self.text)):
            if c in self.next[last]:  # known from an earlier sequence
                last = self._split(last, c)
            else:
                state, p = self._state(self.length[last] + 1, place, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = state
                    p = self.link[p]
                if p >= 0:
                    self.link[state] = self._split(p, c)
                last = state
            self.count[last] += weight
        self.text += sequence

    def counted(self) -> None:
        """Give each state the number of its end places; once, after the last sequence."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def substrings(self, shortest: int, longest: int) -> Iterator[tuple[tuple[int, ...], int, int | None, int | None]]:
        """(substring, count, what precedes it everywhere, what follows it everywhere) of each; the last two for those below ``longest``."""
        stack: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        while stack:
            v, string = stack.pop()
            n, before, after = len(string), None, None
            if n < longest:
                for c, u in self.next[v].items():
                    stack.append((u, (*string, c)))
                    if self.count[u] == self.count[v]:
                        after = c
                if 0 < n < self.length[v]:  # longer substrings end in all the same places
                    before = self.text[self.where[v] - n]
            if n >= shortest:
                yield string, self.count[v], before, after


class _Numbers(dict):
    """Words by number, with their hashes; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})
        self.words: list[bytes] = [b"\n"]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n

    def places(self, text: bytes) -> np.ndarray:
        """Numbers of the words of a text, 0 between pieces and at the end."""
        cut = text.lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
        out = np.fromiter(map(self.__getitem__, cut), np.int32, len(cut))
        return np.append(out[out >= 0], np.int32(0))


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=7))


def word_keys(lang: str, hashes: np.ndarray) -> np.ndarray:
    """64-bit keys of words in a language."""
    return wordhash.mix(hashes ^ _salt(lang)).view(np.int64)


def pair_keys(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of words in a language."""
    return wordhash.mix(wordhash.mix(first ^ _salt(lang)) * _PAIR + second).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, a) of (lang, text): occurrences over all texts; the row of word null has all words of the language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def out() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, c in held.items():
                langs += [lang] * (len(c) + 1)
                words += [*c, None]
                counts += [*c.values(), c.total()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "a"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(text.as_py().lower().translate(_ENDS).split())
                if sum(map(len, held.values())) > MOST_WORDS:
                    yield out()
        if held:
            yield out()

    return texts.mapInArrow(work, "lang string, word string, a bigint").groupBy("lang", "word").agg(F.sum("a").alias("a"))


class _Shard:
    """Numbered texts of some languages, and which of the numbered words pass a filter in each."""

    def __init__(self, frequent: Bloom):
        self.frequent, self.numbers, self.size = frequent, _Numbers(), 0
        self.held: dict[str, list[np.ndarray]] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.known: dict[str, np.ndarray] = {}

    def add(self, lang: str, text: bytes) -> None:
        x = self.numbers.places(text)
        self.held.setdefault(lang, []).append(x)
        self.size += len(x)

    def parts(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(language, places, where pairs of frequent words begin, their keys) of what was added; leaves the shard empty."""
        new = np.array(self.numbers.hashes[len(self.hashes) :], np.uint64)
        self.hashes = np.concatenate([self.hashes, new])
        for lang, arrays in self.held.items():
            before = self.known.get(lang, np.zeros(0, bool))
            self.known[lang] = known = np.concatenate([before, self.frequent.held(word_keys(lang, self.hashes[len(before) :]))])
            known[0] = False  # the end of a piece
            x = np.concatenate(arrays)
            ok = known[x]
            at = np.flatnonzero(ok[:-1] & ok[1:])
            yield lang, x, at, pair_keys(lang, self.hashes[x[at]], self.hashes[x[at + 1]])
        self.held, self.size = {}, 0


def _shards(batches: Iterator[pa.RecordBatch], frequent: Bloom) -> Iterator[_Shard]:
    """Shards of about ``MOST_PLACES`` words, whose ``parts`` are to be taken; one goes on with its numbers up to ``KNOWN`` words."""
    shard = _Shard(frequent)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard.add(lang, text.as_py())
            if shard.size > MOST_PLACES or len(shard.numbers) > KNOWN:
                yield shard
                if len(shard.numbers) > KNOWN:
                    shard = _Shard(frequent)
    if shard.held:
        yield shard


def count_pairs(texts: DataFrame, frequent: Broadcast) -> DataFrame:
    """(f, n): occurrences of pairs of neighbouring words that pass the filter ``frequent``, by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, frequent.value):
            for _, _, _, found in shard.parts():
                keys, n = np.unique(found, return_counts=True)
                for k in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["f", "n"])

    return texts.mapInArrow(work, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))


def count_runs(texts: DataFrame, frequent: Broadcast, pairs: Broadcast) -> DataFrame:
    """(lang, run, n): longest runs of words all whose words and pairs pass the filters, joined by spaces, and how often each is there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}  # runs as bytes of 32-bit numbers
        last: _Numbers | None = None

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                items = iter(found.items())
                while rows := list(islice(items, 20_000)):
                    runs = [b" ".join([last.words[c] for c in np.frombuffer(x, np.int32).tolist()]) for x, _ in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(runs, pa.binary()).cast(pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "run", "n"])
            held.clear()

        for shard in _shards(batches, frequent.value):
            if last is not None and (shard.numbers is not last or sum(map(len, held.values())) > MOST_WORDS):
                yield from out()
            last = shard.numbers
            for lang, x, at, found in shard.parts():
                at = at[pairs.value.held(found)]
                if len(at):
                    cuts = np.flatnonzero(np.diff(at) > 1) + 1
                    places = x.tobytes()
                    ends = zip(at[np.concatenate([[0], cuts])].tolist(), at[np.concatenate([cuts - 1, [len(at) - 1]])].tolist())
                    held.setdefault(lang, Counter()).update([places[4 * a : 4 * b + 8] for a, b in ends])
        yield from out()

    return texts.mapInArrow(work, "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _triples(lang: str, runs: list[bytes], numbers: _Numbers) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Runs as numbers, the keys of their neighbouring triples one after another, and the number of triples of each run."""
    places = [[numbers[w] for w in r.split(b" ")] for r in runs]
    counts = np.array([max(0, len(p) - 2) for p in places], np.int64)
    flat = np.fromiter(chain.from_iterable(places), np.int64, sum(map(len, places)))
    lengths = np.array([len(p) for p in places], np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # words from here to the run's end
    at = np.flatnonzero(left >= 3)
    hashes = np.array(numbers.hashes, np.uint64)[flat]
    first = pair_keys(lang, hashes[at], hashes[at + 1]).view(np.uint64)
    return places, wordhash.mix(first * _PAIR + hashes[at + 2]).view(np.int64), counts


def _by_lang(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, runs, numbers of each) of portions of batches (lang, run, n)."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            part = batch.slice(k, most)
            langs = part.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                here = part.filter(pc.equal(langs.indices, code))
                yield lang, here.column(1).cast(pa.binary()).to_pylist(), here.column(2).to_numpy()


def count_triples(runs: DataFrame) -> DataFrame:
    """(f, n): occurrences of three neighbouring words in the runs (lang, run, n), by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found, n in _by_lang(batches):
            _, keys, counts = _triples(lang, found, _Numbers())
            if len(keys):
                keys, place = np.unique(keys, return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, np.repeat(n, counts))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], names=["f", "n"])

    return runs.mapInArrow(work, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))


def count_phrases(runs: DataFrame, triples: Broadcast, longest: int = 5) -> DataFrame:
    """(lang, phrase, a, before, after) of phrases of 2 to ``longest`` words of the runs (lang, run, n) all whose triples pass the filter.

    Words of a phrase are joined by spaces. ``before`` and ``after``: whether one word precedes or follows it at all its
    places, so that a phrase longer by one, of ``longest`` words at most, occurs as often.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, sizes = _Numbers(), {}, Counter()
        # What the automata of this task have counted: by phrase, its number and the words about it, if they all name one.
        counted: dict[str, dict[tuple[int, ...], list[int | None]]] = {}

        def count(lang: str) -> None:
            automaton, known = SuffixAutomaton(), counted.setdefault(lang, {})
            for run, weight in held[lang].items():
                automaton.add(run, weight)
            held[lang].clear()
            sizes[lang] = 0
            automaton.counted()
            for string, n, before, after in automaton.substrings(2, longest):
                if (seen := known.get(string)) is None:
                    known[string] = [n, before, after]
                else:
                    seen[0] += n
                    seen[1] = before if seen[1] == before else None
                    seen[2] = after if seen[2] == after else None

        def out() -> Iterator[pa.RecordBatch]:
            words = numbers.words
            for lang, known in counted.items():
                found = iter(known.items())
                while rows := list(islice(found, 20_000)):
                    strings, facts = zip(*rows)
                    counts, before, after = zip(*facts)
                    columns = [pa.array([lang] * len(rows)), pa.array([b" ".join([words[c] for c in x]) for x in strings], pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
                    columns += [pa.array([None if c is None else words[c] for c in x], pa.binary()).cast(pa.string()) for x in (before, after)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n", "before", "after"])
            counted.clear()

        for lang, found, n in _by_lang(batches):
            if len(numbers) > KNOWN or sum(map(len, counted.values())) > MOST_PHRASES:  # begin anew
                for other in held:
                    count(other)
                yield from out()
                numbers = _Numbers()
            places, keys, counts = _triples(lang, found, numbers)
            good = triples.value.held(keys).tolist()
            own, at = held.setdefault(lang, Counter()), 0
            for run, k, weight in zip(places, counts.tolist(), n.tolist()):
                # Cut where three words are not frequent together: the middle one ends a part and begins the next.
                parts, start = [], 0
                for i in range(k):
                    if not good[at + i]:
                        parts.append(tuple(run[start : i + 2]))
                        start = i + 1
                at += k
                for part in (*parts, tuple(run[start:])):
                    if part not in own:
                        sizes[lang] += len(part)
                    own[part] += weight
                if sizes[lang] > SHARD_WORDS:
                    count(lang)
        for lang in held:
            count(lang)
        yield from out()

    rows = runs.mapInArrow(work, "lang string, phrase string, n bigint, before string, after string")

    def one(word: str) -> Column:
        """The same word in all shards."""
        return (F.count(word) == F.count(F.lit(1))) & (F.min(word) == F.max(word))

    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.coalesce(one("before"), F.lit(False)).alias("before"), F.coalesce(one("after"), F.lit(False)).alias("after"))


def scored(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of ``candidates`` (lang, phrase, a): the lowest-scoring cut into two parts.

    ``parts`` (lang, phrase, a) has every part of every candidate, ``totals`` (lang, n) the words of each language. The
    score is floor(1000 * a * n / (l * r)) in exact decimals; of equal scores the cut after the fewest words counts.
    """
    w = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"), w.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        known = parts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias(name))
        cuts = cuts.join(known, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part", side)
    cuts = cuts.join(totals.select(F.col("lang").alias("of"), "n"), F.col("lang") == F.col("of")).drop("of")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(18,0)) * 1000 * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    ``docs`` has text and lang; other columns are ignored. A null text counts as empty, a null lang as ``und``. Pieces end at
    ``.,;:!?`` and line ends, words at spaces and tabs; A-Z are lower-cased. A phrase that occurs ``least`` times is a
    candidate; one that lies in a longer candidate which occurs as often is left out. Best score first, then the more
    frequent, then by the phrase's bytes. Repeated rows count each. An empty table, or one without candidates, gives an
    empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    folder, texts = work_dir(spark), _texts(docs)
    # Under the least count only the row of all words is kept.
    words = save(count_words(texts).filter(F.col("word").isNull() | (F.col("a") >= least)), folder, "words")
    totals, words = words.filter(F.col("word").isNull()).select("lang", F.col("a").alias("n")), words.filter(F.col("word").isNotNull())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(word_keys(lang, np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))[0]) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["f"])

    frequent = spark.sparkContext.broadcast(Bloom.of(words.select("lang", F.col("word").cast("binary").alias("word")).mapInArrow(keys, "f bigint"), words.count()))
    pairs = save(count_pairs(texts, frequent).filter(F.col("n") >= least).select("f"), folder, "pairs")
    often = spark.sparkContext.broadcast(Bloom.of(pairs, pairs.count()))
    drop(spark, f"{folder}/pairs")
    runs = save(count_runs(texts, frequent, often), folder, "runs")
    triples = save(count_triples(runs).filter(F.col("n") >= least).select("f"), folder, "triples")
    threes = spark.sparkContext.broadcast(Bloom.of(triples, triples.count()))
    phrases = save(count_phrases(runs, threes, longest).filter(F.col("a") >= least), folder, "phrases")
    drop(spark, f"{folder}/runs")
    parts = words.select("lang", F.col("word").alias("phrase"), "a").unionByName(phrases.select("lang", "phrase", "a"))
    ranked = scored(phrases.filter(~F.col("before") & ~F.col("after")).select("lang", "phrase", "a"), parts, totals)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return ranked.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
