"""Spelling variants: words one inserted, deleted or replaced code point apart, by a dictionary of trie-node pairs.

1. Words are the runs of letters of all texts, counted (``words``).
2. The nodes of a trie of all words, and of one of all reversed words, are numbered (``numbered``): each
   word gets the numbers of its prefixes and of its suffixes. Down to eight letters a node's number is its
   path, as digits; deeper nodes are counted in the order of the sorted words. Words with the same first
   eight letters stand in one partition, through which the trie's current path is carried.
3. The dictionary holds a word once for each position skipped, under (node of the prefix before it, node
   of the suffix after it), and once for each position between letters, under (node of the prefix up
   to there, node of the suffix from there). Two words of one skipped key differ by that letter; a
   word whose skipped key is another's inserted position has one letter more. A key fixes all letters
   but one, so it holds one whole word and at most as many skipped ones as there are letters: 90.
4. In each key the skipped words are counted and ranked, so a word finds the number of its near words
   and the best of them without a row for each pair. A letter of a run of equal ones is taken out at
   the run's end only, so a pair of lengths n and n + 1 meets once.
5. A form has at least ``ratio`` times the occurrences of its word, so chains are short; roots are found
   by doubling, in as many steps as the logarithm of the longest chain.

Null text counts as empty, a null id as the empty string. Repeated rows count each. Ties go to the word
first in code-point order. An empty table, or words without near ones, give no form. Only the named columns are
read, and texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import partitions, written

#: The letters of a word, those that are lower-cased, and the share of runs that lose a letter.
LETTERS, UPPER, LOWER, DIVISOR = "[A-Za-z\\u00C0-\\u00FF]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 199
PATH, BASE = 8, 91  # a..z and U+00C0..U+00FF are 90 letters; 91 ** 8 is below 2 ** 53


def noisy(doc_id: Column, run: Column) -> Column:
    """The run, less one letter where the checksum of ``doc_id:run`` says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DIVISOR == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(df: DataFrame, id_col: str, text_col: str, length: int = 6, least: int = 5) -> DataFrame:
    """word, n: the words of ``length`` letters or more and their occurrences, ``least`` or more; shorter runs can't give one."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))
    found = df.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    found = found.select(noisy(F.col("id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return found.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def digit(letter: str) -> int:
    """1 to 90."""
    return ord(letter) - 0x60 if letter < "\x80" else ord(letter) - 0xC0 + 27


def _nodes(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted words, the first column, with the numbers of their prefixes, the empty one first."""
    count, task, before, path = 0, TaskContext.get().partitionId(), "", [0]
    for batch in batches:
        out = []
        for word in batch.column(0).to_pylist():
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            del path[same + 1 :]
            for i in range(same, len(word)):
                if i < PATH:
                    path.append(path[-1] * BASE + digit(word[i]))
                else:
                    count += 1
                    path.append(-((task << 40) + count))
            before = word
            out.append(path.copy())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, whose first column is a word, and the column ``name``."""
    dealt = rows.repartition(partitions(rows.sparkSession), F.substring(F.col(rows.columns[0]), 1, PATH)).sortWithinPartitions(rows.columns[0])
    names = [*rows.columns, name]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return dealt.mapInArrow(lambda batches: _nodes(batches, names), f"{kinds}, `{name}` array<long>")


def numbered(found: DataFrame) -> DataFrame:
    """word, n, p, s: the numbers of the prefixes by length, and of the suffixes by length."""
    ahead = _numbered(found.select("word", "n"), "p")
    back = _numbered(ahead.select(F.reverse("word").alias("drow"), "word", "n", "p"), "s")
    return back.select("word", "n", "p", "s")


def dictionary(nodes: DataFrame) -> DataFrame:
    """p, s, skip, once, word, n: see step 3. once: whether the letter skipped ends a run of equal ones."""
    size = F.length("word")
    skipped = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(F.get("p", i).alias("p"), F.get("s", size - 1 - i).alias("s"), F.lit(True).alias("skip"), (F.substring(F.col("word"), i + 1, F.lit(1)) != F.substring(F.col("word"), i + 2, F.lit(1))).alias("once")),
    )
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("p", i).alias("p"), F.get("s", size - i).alias("s"), F.lit(False).alias("skip"), F.lit(False).alias("once")))
    return nodes.select("word", "n", F.explode(F.concat(skipped, whole)).alias("e")).select("e.*", "word", "n")


def neighbours(found: DataFrame) -> DataFrame:
    """word, n_near, best, best_n for the words that have near ones."""
    key = Window.partitionBy("p", "s")
    order = [F.desc("n"), F.asc("word")]
    here = F.struct("n", "word")
    entries = dictionary(numbered(found)).withColumn("place", F.row_number().over(Window.partitionBy("p", "s", "skip").orderBy(*order)))
    only = lambda test, value: F.when(test, value)
    entries = entries.select(
        "word", "n", "skip", "once",
        F.count_if(F.col("skip")).over(key).alias("skips"),
        F.count_if(F.col("once")).over(key).alias("inserts"),
        F.max(only(F.col("skip") & (F.col("place") == 1), here)).over(key).alias("first"),
        F.max(only(F.col("skip") & (F.col("place") == 2), here)).over(key).alias("second"),
        F.max(only(~F.col("skip"), here)).over(key).alias("shorter"),
        F.min(only(F.col("once"), F.struct((-F.col("n")).alias("m"), "word"))).over(key).alias("longer"),
    )
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    longer = F.when(F.col("longer").isNotNull(), F.struct((-F.col("longer.m")).alias("n"), F.col("longer.word").alias("word")))
    shorter = F.when(F.col("once"), F.col("shorter"))
    near = F.when(F.col("skip"), F.col("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("inserts"))
    options = F.array_compact(F.when(F.col("skip"), F.array(other, shorter)).otherwise(F.array(longer)))
    rows = entries.select("word", near.alias("near"), options.alias("options")).where("near > 0")
    best = F.transform("options", lambda o: F.struct((-o["n"]).alias("m"), o["word"].alias("word")))
    rows = rows.select("word", "near", F.array_min(best).alias("best"))
    out = rows.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows word, form: the last word that forms lead to."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(found: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n), which are distinct."""
    found = written(found, "words")
    near = found.join(neighbours(found), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "near")
    out = near.join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
