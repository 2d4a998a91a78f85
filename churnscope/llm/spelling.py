"""Spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. The shorter word of a pair (either, at equal lengths)
contributes chunks, the other one positional grams:

* A word falls into two disjoint chunks, its halves. One edit can touch only one
  of them, so the other half is a gram of the other word, moved by one place at
  most: a chunk before the edit keeps its place, one behind it moves by the
  difference in length. The other word therefore sends, for both lengths its
  partner may have, exactly those of its positional grams that lie in such a
  place; its other grams could meet no chunk.
* Half a word is a weak key: at a million words the common beginnings alone
  bring together a thousand million pairs. So the half that the edit does touch
  is cut into two disjoint chunks by the same argument, one of which stays whole.
  A key is a whole half with a whole chunk of the other half, four keys a word.
* Words that meet in a key are verified by their edit distance. A pair is
  accepted in the first of its common keys only, so it comes out once.

Everything is DataFrame code: one aggregation for the counts, one shuffled join
on 64-bit keys, whose inputs are plain shuffles that AQE can split, and one
aggregation per word. No key holds more words than there are strings of a
quarter of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import Scratch

#: Letters of a run; Latin-1 letters as the contract's range has them.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7) -> DataFrame:
    """(id, run): each maximal run of at least ``shortest`` letters, A-Z lower-cased, once per occurrence."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))


def misspell(run: Column, doc_id: Column, every: int) -> Column:
    """``run``, without its code point h % length where ``every`` divides h = crc32(``<doc_id>:<run>``).

    A null id reads as empty.
    """
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points with ``least`` occurrences or more in all texts.

    ``every``: see ``misspell``; None leaves the runs as they are. Runs that are
    too short at once are never cut out: dropping a code point makes none longer.
    """
    runs = word_runs(docs, id_col, text_col, shortest)
    word = F.col("run") if every is None else misspell(F.col("run"), F.col("id"), every)
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _half(n: Column) -> Column:
    return F.ceil(n / 2).cast("int")


def _cuts(size: Column) -> list[Column]:
    """Ends of the four chunks of a word of ``size``: the middle, and the middles of both halves."""
    mid = _half(size)
    return [F.lit(0), _half(mid), mid, mid + _half(size - mid), size]


def _keys(word: Column, size: Column) -> list[Column]:
    """Per chunk of a partner of ``size``, a key of what stays whole before and behind it."""
    cut = _cuts(size)
    return [F.xxhash64(F.lit(k), size, F.left(word, cut[k]), F.right(word, size - cut[k + 1])) for k in range(4)]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, n): each ordered pair of near words, once, with the near word's count.

    ``words``: staged (word, n), distinct words of two code points or more.
    """
    size = F.length("word")
    chunks = words.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), F.posexplode(F.array(*_keys(F.col("word"), size))).alias("k", "key")
    )
    # The partner is as long, or one code point shorter.
    grams = words.select(
        F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(*_keys(F.col("word"), size), *_keys(F.col("word"), size - 1))).alias("key")
    )
    a, b, length = F.col("a"), F.col("b"), F.length("a")
    # Met in an earlier key too: that one reports the pair.
    cut = _cuts(length)
    whole = F.array(*[F.struct(cut[k].alias("before"), (length - cut[k + 1]).alias("behind")) for k in range(3)])
    same = lambda w: (F.left(a, w["before"]) == F.left(b, w["before"])) & (F.right(a, w["behind"]) == F.right(b, w["behind"]))
    earlier = F.exists(F.slice(whole, 1, F.col("k")), same)
    once = (length < F.length("b")) | ((length == F.length("b")) & (a < b))
    # The distance first: few candidates pass it, and only these ask for their earlier keys.
    pairs = chunks.join(grams, (chunks["key"] == grams["key"]) & once & (F.levenshtein(a, b, 1) == 1) & ~earlier)
    both = F.array(
        F.struct(a.alias("word"), b.alias("near"), F.col("b_n").alias("n")), F.struct(b.alias("word"), a.alias("near"), F.col("a_n").alias("n"))
    )
    return pairs.select(F.inline(both))


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps along the forms.

    A form is more frequent than its word, so the forms hold no ring, and each
    round doubles the steps taken until no root has a form itself.
    """
    step = scratch.stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if step.join(on, "root", "left_semi").isEmpty():
            return step
        last = step
        step = scratch.stage(last.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        scratch.drop([last])


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, factor: int = 10, every: int | None = None
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``n`` counts the word in all texts (see ``count_words``), ``n_near`` its near
    words. ``form`` is the near word of largest n (ties: the smallest by code
    point) if that is at least ``factor`` times the word's own n, else null;
    ``form_n`` is its count. ``root`` follows the forms to the last one; a word
    without a form is its own root.

    Null and empty texts have no words, repeated rows count again, a null id
    matters to ``every`` only (it reads as empty there), an empty table gives no
    rows. Other columns of ``docs`` are not read, whatever their names.
    ``shortest`` is 4 or more, so that every chunk holds a code point.
    """
    if shortest < 4 or factor < 2:
        raise ValueError("shortest must be 4 or more, factor 2 or more")
    scratch = Scratch(docs.sparkSession)
    words = scratch.stage(count_words(docs, id_col, text_col, shortest, least, every), "spelling-words")
    best = F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    fits = F.col("best.less") * -1 >= F.col("n") * factor
    found = scratch.stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-found",
    )
    roots = _roots(scratch, found.where("form is not null"))
    scratch.drop([words])
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
