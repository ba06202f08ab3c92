"""Spelling variants grouped by permuterm rotations.

Words are ends-marked by a terminator, and a word of m code points has m + 1
rotations.  The rotation that ends in code point i reads ``w[i+1:] $ w[:i] w[i]``:
all of it but its last code point is the word with a hole at i.  With the
rotations sorted,

* words that share such a prefix and differ in the last code point only are one
  replacement apart;
* a whole rotation ``v[i:] $ v[:i]`` that equals such a prefix belongs to a word v
  that the other becomes when the code point i is deleted.

So every group of rows with one prefix holds just the neighbours at one place: at
most one whole rotation, and one word for each letter of the alphabet (90).  A
sorted scan of each group (a window over the prefix) counts every row's
neighbours and finds the most frequent one; pairs are never written.  A pair one
replacement apart has one place, so one group.  A pair one indel apart meets in
a group for each letter of the run that the letter was taken from; the first
place of the run counts, so each pair counts once.

Everything is built-in column functions: counting words is a partial aggregation
(a hot word is one row of each task), and what follows works on the vocabulary.
The sorted vocabulary numbers its words in code-point order, and rotations carry
that number; long prefixes are named by their SHA-256.  A rotation's row then has
a fixed size, however long its word (work still grows with the square of a word's
length, for the few words that long which occur often enough).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.runtime import keep, prepare

RUN = r"[A-Za-zÀ-ÿ]+"
END = "$"                # outside the alphabet
MIN_LENGTH = 6           # code points of a word
MIN_COUNT = 5            # occurrences of a word
RATIO = 5                # a form is at least so many times as frequent
LONG_PREFIX = 96         # code points; longer prefixes are named by their hash
CORRUPT_EVERY = 199      # the contract's planted misspellings: one run in so many loses a code point
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt(doc_id: Column, run: Column, every: int = CORRUPT_EVERY) -> Column:
    """The run, one code point left out where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id reads as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt_every: int | None = None,
          min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, that are long and frequent enough.

    ``corrupt_every`` plants misspellings first (``misspelt``).  Null and empty
    texts have no words; repeated rows count as often as they stand there.
    """
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    # Only runs that can be long enough after a deletion go on.
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_length).select("id", run.alias("run"))
    word = F.col("run") if corrupt_every is None else misspelt(F.col("id"), F.col("run"), corrupt_every)
    return (runs.select(word.alias("word")).where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def numbered(vocabulary: DataFrame) -> DataFrame:
    """(word, n, id): ids ascend with the words in code-point order; written, so that they stay."""
    return keep(vocabulary.orderBy("word").select("word", "n", F.monotonically_increasing_id().alias("id")), "vocabulary")


def rotations(vocabulary: DataFrame) -> DataFrame:
    """(prefix, id, n, hole, first) of every rotation, in both its roles.

    ``hole``: the prefix is the rotation without its last code point; then
    ``first`` tells that the code point begins a run of equal ones.
    """
    m, i = F.char_length("word"), F.col("i")
    head, tail = F.substring("word", F.lit(1), i), F.substring("word", i + 1, m)
    at = lambda p: F.substring("word", p, F.lit(1))
    named = lambda prefix, size: F.when(size <= LONG_PREFIX, prefix).otherwise(F.sha2(prefix.cast("binary"), 256)).alias("prefix")
    every = vocabulary.select("word", "id", "n", F.explode(F.sequence(F.lit(0), m)).alias("i"))
    whole = every.select(named(F.concat(tail, F.lit(END), head), m + 1), "id", "n", F.lit(False).alias("hole"), F.lit(True).alias("first"))
    holes = every.where(i < m).select(named(F.concat(F.substring("word", i + 2, m), F.lit(END), head), m), "id", "n", F.lit(True).alias("hole"),
                                      ((i == 0) | (at(i) != at(i + 1))).alias("first"))
    return whole.unionByName(holes)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, form, form_n): how many words are one edit away, and the id and count of the most frequent.

    Of equally frequent ones the smallest in code-point order.  Words without a
    neighbour do not come out.
    """
    group = Window.partitionBy("prefix")
    # Structs of (-n, id): the smallest is the most frequent word, then the smallest.
    rows = rotations(vocabulary).select("prefix", "hole", "first", F.struct((-F.col("n")).alias("n"), "id").alias("me"))
    # Holes by frequency, then the whole rotation; a hole's best other one is the first, or for the first the second.
    ranked = rows.select("*", F.row_number().over(group.orderBy(F.col("hole").desc(), "me")).alias("nth"))
    pick = lambda cond: F.min(F.when(cond, F.col("me"))).over(group)
    scanned = ranked.select(
        "me", "hole", "first", "nth",
        pick(F.col("hole") & (F.col("nth") == 1)).alias("best_hole"),
        pick(F.col("hole") & (F.col("nth") == 2)).alias("next_hole"),
        pick(~F.col("hole")).alias("whole"),
        F.sum(F.col("hole").cast("long")).over(group).alias("holes"),
        # For the whole rotation: holes at the first place of their run.
        F.sum((F.col("hole") & F.col("first")).cast("long")).over(group).alias("longer"),
        pick(F.col("hole") & F.col("first")).alias("best_longer"),
    )
    replaced = F.when(F.col("hole"), F.when(F.col("nth") == 1, F.col("next_hole")).otherwise(F.col("best_hole")))
    shorter = F.when(F.col("hole") & F.col("first"), F.col("whole"))
    longer = F.when(~F.col("hole"), F.col("best_longer"))
    near = F.when(F.col("hole"), F.col("holes") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("longer"))
    found = scanned.select("me.id", near.alias("near"), F.least(replaced, shorter, longer).alias("best")).where("near > 0")
    return (found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
            .select("id", "n_near", F.col("best.id").alias("form"), (-F.col("best.n")).alias("form_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of the words that have a form, by following forms to the last.

    Each round replaces a word's target by its target's target; n grows along a
    chain by the ratio at least, so a chain has few links and no circle.
    """
    step = keep(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = keep(step.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = joined.select("id", "root")
        if joined.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt_every: int | None = None, min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words``.

    ``form`` is the word's most frequent neighbour, if that is at least ``ratio``
    times as frequent, else null like ``form_n``; ``root`` the last word on the way
    from form to form, the word itself without one.  An empty table gives none.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    vocabulary = numbered(words(slim, "id", "text", corrupt_every, min_length, min_count))
    near = vocabulary.join(neighbours(vocabulary), "id", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    near = keep(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form")).alias("form"),
                            F.when(has, F.col("form_n")).alias("form_n")), "neighbours")
    formed = near.where(F.col("form").isNotNull())
    named = lambda c: vocabulary.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    links = formed.select("id", "form").join(_roots(formed), "id").join(named("form"), "form").join(named("root"), "root").select("id", "form_word", "root_word")
    return (near.join(links, "id", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))
