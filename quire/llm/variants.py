"""Spelling variants of a corpus' words, by permuterm rotations.

Method. A word is closed by a terminator and turned: for each split x|y of the word the rotation is ``y$x``. Two words
that differ by one replaced character agree in a rotation but for its last character, the edited one;
if one lacks a character of the other, its whole rotation is what the other's has before
that character. So neighbours stand in one range of the sorted rotations, that of a prefix which skips the edited
character: the word of the prefix itself, if there is one, and the words with one character more. The ranges are
dealt over tasks by their prefix and scanned; a range has no more words than the alphabet has letters, and one.
Each word of a range gets how many others it meets there and the best of them, so no pairs are listed. A
character of a run of equal ones can be left out at several places with one result; only the first place of a run
counts for that, so each pair meets once.

Words come from all texts: runs of letters, A-Z in lower case, some altered as
``altered`` says. Equal words are counted before they move. Words are numbered in their order, and only numbers
travel. Rotations of words over ``LONGEST_TEXT`` letters go by a fingerprint modulo a prime of 127 bits,
so their rows stay short and their time grows with the word. Forms are followed to their last one by
doubling: each round every word takes over the form of its form.

Edge cases. Null and empty texts have no words. A null doc_id counts as an empty one where runs are altered. Long
texts are handled whole. Repeated rows count each time. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

RUNS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMINATOR = "$"
LONGEST_TEXT = 64
_PRIME = (1 << 127) - 1
_BASE = 0x2F1B9D3C5A77E6840D91C2B3A4F5E617


def altered(run: Column, doc_id: Column, part: int) -> Column:
    """The run without its code point at h % length, where ``part`` divides h, the CRC of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % part == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, shortest: int, least: int, part: int | None) -> DataFrame:
    """word, n of the words with at least ``shortest`` code points and ``least`` occurrences."""
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run")
    )
    # A run that is cut too short is dropped here, before anything is hashed.
    runs = runs.where(F.length("run") >= shortest)
    word = altered(F.col("run"), F.col("doc_id"), part) if part else F.col("run")
    counts = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word")
    return counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """range, edited, lead, rank, n: every rotation, by the prefix that skips its last character.

    ``edited`` tells that there is such a character; the other rotations are the whole prefix. ``lead``
    tells that the character opens a run of equal ones.
    """
    word, i = F.col("word"), F.col("i")
    before, after = word.substr(F.lit(1), i), word.substr(i + 2, F.length(word))
    short = words.where(F.length("word") <= LONGEST_TEXT)
    at = short.select("*", F.explode(F.sequence(F.lit(0), F.length(word) - 1)).alias("i"))
    character = word.substr(i + 1, F.lit(1))
    skipped = at.select(
        F.concat(after, F.lit(TERMINATOR), before).alias("range"),
        F.lit(True).alias("edited"),
        ((i == 0) | (word.substr(i, F.lit(1)) != character)).alias("lead"),
        "rank",
        "n",
    )
    upto = short.select("*", F.explode(F.sequence(F.lit(0), F.length(word))).alias("i"))
    whole = upto.select(
        F.concat(word.substr(i + 1, F.length(word)), F.lit(TERMINATOR), before).alias("range"),
        F.lit(False).alias("edited"),
        F.lit(False).alias("lead"),
        "rank",
        "n",
    )
    long = words.where(F.length("word") > LONGEST_TEXT)
    return skipped.unionByName(whole).unionByName(_long_rotations(long))


def fingerprints(word: str) -> tuple[list[int], list[int]]:
    """Polynomials of the rotations of ``word$`` without and with their last character, by its place."""
    powers, prefix = [1], [0]
    for c in word:
        powers.append(powers[-1] * _BASE % _PRIME)
        prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)
    size, mark = len(word), ord(TERMINATOR)

    def turned(end: int, start: int) -> int:
        """Of the word from ``start``, the terminator, and the word up to ``end``."""
        tail = (prefix[size] - prefix[start] * powers[size - start]) % _PRIME
        return ((tail * _BASE + mark) * powers[end] + prefix[end]) % _PRIME

    return [turned(i, i + 1) for i in range(size)], [turned(i, i) for i in range(size + 1)]


def _long_rotations(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "edited", "lead", "rank", "n"]
        for batch in batches:
            for row in batch.to_pylist():
                word, size = row["word"], len(row["word"])
                skips, wholes = fingerprints(word)
                if size == LONGEST_TEXT + 1:  # the ranges that the longest of the others have too
                    skips = [word[i + 1 :] + TERMINATOR + word[:i] for i in range(size)]
                else:
                    skips = [f"#{f:x}" for f in skips]
                leads = [i == 0 or word[i] != word[i - 1] for i in range(size)] + [False] * (size + 1)
                edited = [True] * size + [False] * (size + 1)
                ranges = [*skips, *(f"#{f:x}" for f in wholes)]
                both = [pa.array([row[c]] * len(ranges), pa.int64()) for c in ("rank", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(edited), pa.array(leads), *both], names)

    return words.select("rank", "word", "n").mapInArrow(run, "range string, edited boolean, lead boolean, rank long, n long")


def _best(entries: Column) -> Column:
    """n and rank of the entry of largest n, of equal ones the first in order."""
    none = F.struct(F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("rank"))
    better = lambda a, e: (e["n"] > a["n"]) | ((e["n"] == a["n"]) & (e["rank"] < a["rank"]))
    return F.aggregate(
        entries, none, lambda a, e: F.when(better(a, e), F.struct(e["n"].alias("n"), e["rank"].alias("rank"))).otherwise(a)
    )


def near_words(words: DataFrame) -> DataFrame:
    """rank, n_near, near (rank of the near word of largest n, the first of equals), near_n, of words with any."""
    entry = F.struct("rank", "n", "edited", "lead")
    ranges = rotations(words).groupBy("range").agg(F.collect_list(entry).alias("entries"))
    ranges = ranges.where(F.size("entries") > 1)
    ranges = ranges.select(
        F.filter("entries", lambda e: e["edited"]).alias("edited"),
        F.filter("entries", lambda e: ~e["edited"]).alias("whole"),
    )
    leads = F.filter("edited", lambda e: e["lead"])
    ranges = ranges.withColumns({"first": _best(F.col("edited")), "lead_best": _best(leads), "leads": F.size(leads)})
    # What the best word itself meets is the best of the rest.
    ranges = ranges.withColumn("second", _best(F.filter("edited", lambda e: e["rank"] != F.col("first.rank"))))

    def met_by_edited(e: Column) -> Column:
        other = F.when(e["rank"] == F.col("first.rank"), F.col("second")).otherwise(F.col("first"))
        shorter = F.when(e["lead"], F.col("whole")).otherwise(F.filter("whole", lambda w: F.lit(False)))
        plain = F.transform(shorter, lambda w: F.struct(w["n"].alias("n"), w["rank"].alias("rank")))
        return F.struct(
            e["rank"].alias("rank"),
            (F.size("edited") - 1 + F.size(shorter)).alias("n_near"),
            _best(F.concat(F.array(other), plain)).alias("best"),
        )

    def met_by_whole(w: Column) -> Column:
        return F.struct(w["rank"].alias("rank"), F.col("leads").alias("n_near"), F.col("lead_best").alias("best"))

    met = ranges.select(F.explode(F.concat(F.transform("edited", met_by_edited), F.transform("whole", met_by_whole))).alias("m"))
    met = met.where(F.col("m.n_near") > 0).select("m.*")
    most = met.groupBy("rank").agg(
        F.sum("n_near").cast("long").alias("n_near"),
        F.min(F.struct((-F.col("best.n")).alias("less"), F.col("best.rank").alias("rank"))).alias("b"),
    )
    return most.select("rank", "n_near", F.col("b.rank").alias("near"), (-F.col("b.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """rank, root: the last word on the way from form to form. ``links`` has rank and form, not null."""
    links, left = materialize(links.withColumnRenamed("form", "root"), "word-links"), None
    while left != 0:
        onward = links.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        joined = links.join(onward, "root", "left")
        stepped = joined.select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        stepped = materialize(stepped, "word-links")
        left = stepped.where("moved").count()
        links = stepped.drop("moved")
    return links


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, part: int | None = None) -> DataFrame:
    """Words with their form: word, form, root, n, n_near, form_n.

    The form is the near word of largest count (of equals the first) if it has at least ``ratio`` times the
    count of the word. With ``part``, runs are altered before they are counted, which makes a corpus with known
    variants.
    """
    counts = materialize(word_counts(docs, shortest, least, part), "word-counts")
    # Numbers given in sorted order compare as the words do.
    words = materialize(counts.orderBy("word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "words")
    near = materialize(near_words(words), "near-words")
    named = words.select(F.col("rank").alias("form"), F.col("word").alias("form_word"))
    top = words.select("rank", "n").join(near, "rank").where(F.col("near_n") >= ratio * F.col("n"))
    formed = top.select("rank", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    last = roots(formed.select("rank", "form")).withColumnRenamed("root", "form").join(named, "form")
    last = last.select("rank", F.col("form_word").alias("root"))
    formed = formed.join(named, "form").join(last, "rank").select("rank", F.col("form_word").alias("form"), "root", "form_n")
    return words.join(near.select("rank", "n_near"), "rank", "left").join(formed, "rank", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
