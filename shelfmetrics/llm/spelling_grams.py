"""Spelling variants: words one edit apart, found by an index of grams of variable length."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
FIRST, LAST = "^", "$"  # the ends of a word, no letters
SHORT, LONG = 2, 3  # code points of a gram
OFTEN, SELDOM, MOST = 500, 100, 1 << 15  # of the dictionary, see `dictionary`
MERGED = 2  # lists of grams that a neighbour must stand on together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Grams:
    """A dictionary of grams of SHORT to LONG code points with their numbers of words; grams of SHORT code points need not be listed."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        # What goes on to the right, and to the left, in some gram.
        self.begins = {g[:n] for g in grams for n in range(1, len(g))}
        self.stops = {g[n:] for g in grams for n in range(1, len(g))}
        self.longest = max(map(len, grams), default=SHORT)

    def cut(self, word: str) -> list[tuple[int, int]]:
        """(start, stop) of the grams of a word with its ends: the longest gram at each place, but for those inside an earlier one."""
        out, reach, grams = [], 0, self.grams
        for start in range(len(word) - SHORT + 1):
            for size in range(min(self.longest, len(word) - start), SHORT - 1, -1):
                if size == SHORT or word[start:start + size] in grams:
                    break
            if start + size > reach:
                reach = start + size
                out.append((start, reach))
        return out

    def affected(self, word: str, cut: list[tuple[int, int]]) -> int:
        """The most grams of the word that one edit can take from its neighbour's grams.

        An edit at [low, high) keeps a gram before it unless some gram of the dictionary goes on from a start at or before the gram's up to the edit,
        and a gram after it unless one ends behind the gram's end and goes back to the edit; either could swallow it.
        """
        most, n = 0, len(word)
        for low in range(1, n):  # the ends stay; high = low is an insertion
            right = next((p for p in range(max(0, low - self.longest + 1), low) if word[p:low] in self.begins), n)
            for high in (low, low + 1):
                if high > n - (high > low):
                    continue
                left = next((e for e in range(min(n, high + self.longest - 1), high, -1) if word[high:e] in self.stops), 0)
                kept = sum(stop <= low and start < right or start >= high and stop > left for start, stop in cut)
                most = max(most, len(cut) - kept)
        return most

    def rarest(self, word: str, cut: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The n rarest of the word's grams, by place."""
        return sorted(sorted(cut, key=lambda g: (self.grams.get(word[g[0]:g[1]], 0), word[g[0]:g[1]], g[0]))[:n])


def _sets(index: int, word: str, chosen: list[tuple[int, int]]) -> list[list[int]]:
    """A hash for each MERGED of the chosen grams at their places, and for each way they can lie in a word that is longer by one."""
    out = [[] for _ in range(MERGED + 2)]
    for grams in itertools.combinations(chosen, MERGED):
        for k in range(MERGED + 2):  # 0: as they lie; 1 to MERGED + 1: the last k - 1 of them stand behind the inserted letter
            later = MERGED - max(k - 1, 0)
            name = f"{index} {len(word) + (k > 0)}" + "".join(f" {start + (i >= later)}{word[start:stop]}" for i, (start, stop) in enumerate(grams))
            out[k].append(xxhash.xxh3_64_intdigest(name))
    return out


def entries(word: str, grams: Grams, short: Grams) -> list[list[int]]:
    """The index entries of a word: its own, and those of words longer by one that it looks up.

    Of its grams a word shares all but those that an edit affects with each neighbour, so any two neighbours, of which one can lose so few that MERGED
    are left, share MERGED of the rarest ones on both sides. A word that could lose more also stands in an index of short grams, of which at
    least four are left: there it meets neighbours of its kind.
    """
    word = FIRST + word + LAST
    cut = grams.cut(word)
    lost = grams.affected(word, cut)
    out = _sets(0, word, grams.rarest(word, cut, lost + MERGED))
    if len(cut) - lost < MERGED:
        cut = short.cut(word)
        for own, more in zip(out, _sets(1, word, short.rarest(word, cut, short.affected(word, cut) + MERGED))):
            own += more
    return out


def _entries(grams: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, short = Grams(grams), Grams({g: n for g, n in grams.items() if len(g) == SHORT})
        for b in batches:
            found = [entries(w, all_, short) for w in b.column("word").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            hashes = [pa.array(np.array(list(itertools.chain.from_iterable(f[k] for f in found)), np.uint64).view(np.int64)) for k in range(MERGED + 2)]
            yield pa.RecordBatch.from_arrays([b.column("word").take(at), b.column("n").take(at), *hashes], names=["word", "n", *[f"k{k}" for k in range(MERGED + 2)]])
    return run


def words(docs: DataFrame, every: int, least_letters: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters of all texts in lower case, those whose hash `every` divides without one letter, counted; short and rare ones left out."""
    ident, text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"))).alias("run")).filter(F.length("run") >= least_letters)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    without = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))")
    spelt = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word"))
    return spelt.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def dictionary(found: DataFrame, longest: int = LONG, often: int = OFTEN, seldom: int = SELDOM, most: int = MOST) -> dict[str, int]:
    """Grams with the number of places where words have them: all of SHORT letters, and longer ones whose beginning is found over `often` times.

    A gram found fewer than `seldom` times, or beyond the `most` most frequent ones, is left out, which bounds the dictionary whatever the input:
    SHORT letters give some 8,500 grams. Any dictionary gives the same neighbours; it decides how long the lists are.
    """
    whole = F.concat(F.lit(FIRST), "word", F.lit(LAST))
    places = found.select(whole.alias("word")).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("start"))
    grams = places.select("word", "start", F.explode(F.sequence(F.lit(SHORT), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("size"))
    counted = grams.groupBy(F.expr("substring(word, start, size)").alias("gram")).agg(F.count("*").alias("n"))
    counted = stored(counted.filter(F.col("n") >= seldom).unionByName(counted.filter((F.col("n") < seldom) & (F.length("gram") == SHORT))))
    begin = counted.filter(F.col("n") > often).select(F.col("gram").alias("begin"))
    longer = counted.filter(F.length("gram") > SHORT).withColumn("begin", F.expr("substring(gram, 1, length(gram) - 1)")).join(begin, "begin", "left_semi")
    kept = counted.filter(F.length("gram") == SHORT).unionByName(longer.select("gram", "n").orderBy(F.desc("n"), "gram").limit(most))
    return {r.gram: r.n for r in kept.collect()}


def near_words(found: DataFrame, grams: dict[str, int]) -> DataFrame:
    """a, a_n, b, b_n: the pairs of words (stored: word, n) one edit apart, each once."""
    index = stored(found.mapInArrow(_entries(grams), "word string, n bigint, " + ", ".join(f"k{k} bigint" for k in range(MERGED + 2))))
    own = index.select(F.col("k0").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    looked = F.explode(F.array(*[F.struct(F.col(f"k{k}").alias("key"), F.lit(k > 0).alias("shorter")) for k in range(MERGED + 2)])).alias("k")
    other = index.select(looked, F.col("word").alias("b"), F.col("n").alias("b_n")).select("k.key", "k.shorter", "b", "b_n")
    return own.join(other, "key").filter((F.col("shorter") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def spelling_forms(docs: DataFrame, every: int = 97, least_letters: int = 5, least: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   **of_dictionary: int) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of docs, each with the more frequent word one edit apart that it may be a variant of.

    Words are maximal runs of letters (ASCII and U+00C0 to U+00FF), A-Z in lower case; one in `every` (a function of id and run) is misspelt by leaving
    out a letter. They have `least_letters` letters and `least` occurrences at least. The form is the most frequent word that differs by one
    inserted, deleted or replaced code point, if it is found `times` times as often at least, of equally frequent ones the smallest; root is where
    forms end. n_near counts the words one edit apart.

    1. Words are counted on Spark, whole texts, and their grams; a pruned dictionary of bounded size goes to all tasks.
    2. Each word is cut into grams of the dictionary. How many an edit can affect tells how many of its rarest grams must be looked at.
    3. Lists of pairs of these grams, with their places and the word's length, are merged by a join that verifies each pair by its edits.

    Null texts have no words; a null id counts as empty in the hash; repeated rows count each; texts of any length are read whole. An empty table gives no
    rows. Other columns play no part. `least_letters` below 3 is refused, as short words have no grams that stay.
    """
    if least_letters < 3 or times < 2:
        raise ValueError("words need three letters, and forms twice the occurrences")
    ship(docs.sparkSession)
    found = stored(words(docs, every, least_letters, least, id_col, text_col))
    pairs = near_words(found, dictionary(found, **of_dictionary))
    sides = [F.struct(F.col(x).alias("word"), F.col(f"{y}_n").alias("m"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
    best = pairs.select(F.explode(F.array(*sides)).alias("s")).select("s.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    is_form = -F.col("best.m") >= times * F.col("n")
    out = stored(found.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    # Occurrences grow by `times` with each step, so lines are short, and each round doubles the steps.
    up = stored(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        twice = stored(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("top")), "root", "left").select(
            "word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("went")))
        up = twice.select("word", "root")
        if twice.filter("went").isEmpty():
            break
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
