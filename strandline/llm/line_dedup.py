"""Removal of repeated runs of lines by winnowing.

DataFrame functions only. Lines without a word are left alone and stand in no run. Of every ``run`` consecutive lines of
a text the one of smallest hash (leftmost on ties) is selected: the selected places are the text's fingerprints, of which
any run of that length holds one. Equal runs select equal fingerprints, so only places whose fingerprint stands at
another place too are joined. Each of them carries the windows that selected it, the lines before and after it, as two
independent hashes of all their lines; of equal windows the first by (doc_id, place) stays and the lines that the later
ones cover are deleted. Windows overlap, so a longer run goes as a whole. Matches are not followed further from pair to
pair: every window that equals an earlier one anywhere must go, which would take all pairs of a fingerprint's places.
Shorter runs can take part where they hold many words (``long_words``): a passage may stand in one or two lines.

Scale: one row for each selected place is stored, about half of the lines; most are dropped after counting fingerprints
(combined before the shuffle). Tables are stored between joins, so hot lines are split by the skewed-join rule. The
texts meet their deletions in one join by row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, drop, row_key, save, unwrapped, whole, word_count, work_dir

RUN = 3


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE)) != ""


def later_runs(docs: DataFrame, folder: str, run: int, least_words: int = 0) -> DataFrame:
    """(key, gone): for each row key the places (among lines with a word, from 0) that later windows cover.

    Windows have ``run`` lines, and ``least_words`` words or more. Only the result stays in ``folder``.
    """
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), _has_word)
    count = word_count if least_words else lambda x: F.lit(0)
    two = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), count(x).cast("long").alias("c")))
    hashed = docs.select("key", "doc_id", two.alias("h")).filter(F.size("h") >= run)
    inner = F.sequence(F.lit(1), F.greatest(F.size("h") - (run - 1), F.lit(1)))

    def parts(i: Column, name: str) -> list[Column]:
        return [F.element_at("h", i + k)[name] for k in range(run)]

    def window(i: Column) -> Column:
        least = F.least(*parts(i, "a")) if run > 1 else parts(i, "a")[0]
        place = (i - 2 + F.array_position(F.array(*parts(i, "a")), least)).cast("int")
        return F.struct((i - 1).alias("at"), F.xxhash64(*parts(i, "a")).alias("w1"), F.xxhash64(*parts(i, "b")).alias("w2"), sum(parts(i, "c"), F.lit(0)).alias("c"), least.alias("print"), place.alias("place"))

    cut = hashed.select("key", "doc_id", F.transform(inner, window).alias("w"))
    # Selected places never go back, so the windows that selected one follow each other, at most ``run`` of them.
    fresh = F.filter("w", lambda x, i: (i == 0) | (F.get("w", i - 1)["place"] != x["place"]))
    around = lambda x: F.filter(F.slice("w", x["at"] + 1, F.lit(run)), lambda y: (y["place"] == x["place"]) & (y["c"] >= least_words))
    chosen = F.transform(fresh, lambda x: F.struct(x["print"].alias("print"), x["place"].alias("place"), F.transform(around(x), lambda y: F.struct(y["at"].alias("at"), y["w1"].alias("w1"), y["w2"].alias("w2"))).alias("windows")))
    chosen = F.filter(chosen, lambda x: F.size(x["windows"]) > 0) if least_words else chosen
    prints = save(cut.select("key", "doc_id", F.explode(chosen).alias("x")).select("key", "doc_id", "x.*"), folder, "prints")
    spot = F.struct("key", "place")
    repeats = prints.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b"))
    repeats = save(repeats.filter("a <> b").select("print"), folder, "repeats")
    near = prints.join(repeats, "print").select("key", "doc_id", F.explode("windows").alias("x")).select("key", "doc_id", "x.*")
    near = save(near, folder, "near")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "at")
    first = save(near.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2", "first"), folder, "first")
    later = near.join(first, ["w1", "w2"]).filter((F.col("key") != F.col("first.key")) | (F.col("at") != F.col("first.at")))
    covered = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_set("at")), lambda s: F.sequence(s, s + run - 1))))
    out = save(later.groupBy("key").agg(covered.alias("gone")), folder, "later")
    drop(docs.sparkSession, *[f"{folder}/{name}" for name in ("prints", "repeats", "near", "first")])
    return out


def remove_lines(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) with their later repeated runs of ``run`` or more lines deleted.

    With ``long_words`` later runs of fewer lines go too where they hold that many words or more, in texts of any length.

    Adds n_lines (lines with a word) and n_removed. A later run is one of which an equal run stands earlier: at a
    smaller doc_id (nulls last), or before it in the same text; windows are judged on the input. Rows equal in doc_id
    and text are one text and are treated alike. Lines without a word stay. A null text stays null; text left without
    any line becomes empty. Existing columns n_lines and n_removed are replaced, others stay under any name; an empty
    table gives an empty one.
    """
    folder = work_dir(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    key = row_key("doc_id", "text").alias("key")
    keyed = docs.select(whole(docs, "text"), "text", key)
    texts = docs.select(key, "doc_id", "text")
    later = later_runs(texts, folder, run)
    for k in range(1, run if long_words else 1):
        later = later.union(later_runs(texts, f"{folder}/{k}", k, long_words))
    later = later.groupBy(F.col("key").alias("of")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")) if long_words else later.withColumnRenamed("key", "of")
    # The same plan at every size: a small table of deletions would be broadcast, a large one not.
    joined = keyed.join(later.hint("merge"), F.col("key") == F.col("of"), "left").select("row", "text", "gone")
    joined = joined.withColumn("lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    size = F.size(F.filter("lines", _has_word)).cast("long")
    numbered = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: _has_word(s["x"])), lambda s, k: F.struct(s["i"].alias("i"), k.alias("k")))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    joined = joined.withColumn("n_lines", size).withColumn("numbered", F.when(F.col("gone").isNotNull(), numbered)).withColumn("gone", gone)
    # From places among the lines with a word to places among all lines.
    dead = F.when(F.size("numbered") > 0, F.transform("gone", lambda k: F.element_at("numbered", k + 1)["i"])).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("dead", dead).drop("numbered")
    marked = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dead"))
    left = F.array_join(F.transform(marked, lambda i: F.element_at("lines", i + 1)), "\n")
    joined = joined.withColumn("n_removed", F.size("gone").cast("long"))
    joined = joined.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text")))
    return joined.select(*unwrapped(docs, text=F.col("text")), "n_lines", "n_removed")
