"""Spelling variants of words, found by pivotal grams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions.binding import bind
from guestlens.session import stage

# Characters of a gram, and edits between two words that are near.
_GRAM = 2
_EDITS = 1
# The gram prefix of a word holds its rarest grams, so many that one more of them than
# there are edits are disjoint, whichever they are.
_PREFIX = _GRAM * _EDITS + 1
# Words below this length have no whole gram prefix.
SHORTEST = _PREFIX + _GRAM - 1
# Grams whose counts may be broadcast, about 40 bytes each. Letters of one script have some
# thousands of bigrams; the number is counted before.
_BROADCAST_GRAMS = 200_000
# Changes of (length, place of a gram) that one edit can cause: none when a character is
# replaced, else the gram stands before or after the edit.
_SHIFTS = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]


def _choice(cost: Column, last: Column, grams: Column) -> Column:
    return F.struct(cost.alias("cost"), last.alias("last"), grams.alias("grams"))


def _one_more(prefix: Column, before: Column) -> Column:
    """The best choices of one gram more, for every gram as the last one: `before` has those
    of one gram less, and the last gram must begin behind the one before it."""

    def longer(g: Column) -> Column:
        fits = F.array_min(F.filter(before, lambda b: b["last"] <= g["pos"] - _GRAM))
        return F.when(fits.isNotNull(), _choice(fits["cost"] + g["weight"], g["pos"], F.concat(fits["grams"], F.array(g))))

    return F.filter(F.transform(prefix, longer), lambda b: b.isNotNull())


def _pivots(prefix: Column) -> Column:
    """Disjoint grams of a prefix, one more than there are edits, with the least weight
    together, by dynamic programming over their places."""
    best = F.transform(prefix, lambda g: _choice(g["weight"], g["pos"], F.array(g)))
    for _ in range(_EDITS):
        best = bind(best, lambda before: _one_more(prefix, before))
    return F.array_min(best)["grams"]


def _letters(word: Column) -> Column:
    """A bit for each letter (code point modulo 64) of a word. One edit changes at most two."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words, in both directions, that differ by one
    inserted, deleted or replaced code point. `words` (word, n) has each word once, of at
    least `SHORTEST` code points.

    Bigrams are ordered by how many words hold them, the rarest first. The prefix of a word
    are its first three grams in that order, and all as rare as the third; its pivots two
    disjoint ones of them. One edit cannot touch both pivots, so of two near words the one
    whose prefix ends earlier in the order has a pivot among the prefix of the other one,
    at the same place or shifted by the edit. Pivots are matched with prefixes by gram,
    place and length; words that match are compared letter by letter.
    """
    starts = F.sequence(F.lit(0), F.char_length("word") - _GRAM)
    grams = words.select("word", "n", F.posexplode(F.transform(starts, lambda i: F.col("word").substr(i + 1, F.lit(_GRAM)))).alias("pos", "gram"))
    weights = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("weight")), "grams")
    hint = F.broadcast if weights.count() <= _BROADCAST_GRAMS else (lambda df: df)
    placed = grams.join(hint(weights), "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("weight", "gram", "pos"))).alias("grams"))
    last = F.get("grams", F.lit(_PREFIX - 1))
    placed = placed.select("word", "n", "grams", F.struct(last["weight"].alias("weight"), last["gram"].alias("gram")).alias("last"))
    prefix = F.filter("grams", lambda g: F.struct(g["weight"].alias("weight"), g["gram"].alias("gram")) <= F.col("last"))
    by_place = F.array_sort(F.transform(prefix, lambda g: F.struct(g["pos"].alias("pos"), g["weight"].alias("weight"), g["gram"].alias("gram"))))
    placed = placed.select("word", "n", "last", F.char_length("word").alias("length"), _letters(F.col("word")).alias("letters"), by_place.alias("prefix"))
    placed = stage(placed.withColumn("pivots", _pivots(F.col("prefix"))), "prefixes")

    shifts = F.array(*(F.struct(F.lit(a).alias("length"), F.lit(b).alias("pos")) for a, b in _SHIFTS))
    pivots = placed.select("word", "n", "last", "letters", "length", F.explode("pivots").alias("g"))
    pivots = pivots.select("*", F.explode(shifts).alias("s")).select(
        *(F.col(c).alias(f"_{c}") for c in ("word", "n", "last", "letters")),
        F.col("g.gram").alias("gram"),
        (F.col("g.pos") + F.col("s.pos")).alias("pos"),
        (F.col("length") + F.col("s.length")).alias("length"),
    )
    index = placed.select("word", "n", "last", "letters", "length", F.explode("prefix").alias("g"))
    index = index.select("word", "n", "last", "letters", "length", "g.gram", "g.pos")
    met = pivots.join(index, ["gram", "pos", "length"]).where(
        (F.bit_count(F.col("letters").bitwiseXOR(F.col("_letters"))) <= 2 * _EDITS)
        & (F.col("_last") <= F.col("last"))
        & (F.levenshtein("_word", "word", _EDITS) == _EDITS)
    )
    both = F.explode(
        F.array(
            F.struct(F.col("word"), F.col("n"), F.col("_word").alias("near"), F.col("_n").alias("near_n")),
            F.struct(F.col("_word").alias("word"), F.col("_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
    ).alias("pair")
    return met.select(both).select("pair.*").distinct()


def follow(steps: DataFrame) -> DataFrame:
    """(word, root) for `steps` (word, form): where the forms of forms end. Each round the
    roots of the roots are looked up, so chains of length n take about log2(n) rounds. The
    steps must not form circles."""
    roots = stage(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = roots.join(onward, "root", "left")
        after = stage(after.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        roots = after.select("word", "root")
        if not moved:
            return roots


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    `words` (word, n) has each word once, with the number of its occurrences. Two words are
    near if they differ by exactly one inserted, deleted or replaced code point. The form of
    a word is its near word of largest n, of equal ones the smallest in code-point order, if
    that n is at least `ratio` times its own; else null, as is form_n. root follows the forms
    to the last one, the word itself if there is none; n_near counts the near words.

    Null words are left out. Words below `SHORTEST` code points raise an error, as they have
    no pivots. An empty table gives no rows. Other columns are not looked at.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms may run in circles")
    words = stage(words.select("word", "n").where(F.col("word").isNotNull()), "words")
    if not words.where(F.char_length("word") < SHORTEST).isEmpty():
        raise ValueError(f"words must have at least {SHORTEST} code points")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("_best")
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("_best.n") >= ratio * F.col("n")
    near = stage(near.select("word", "n_near", F.when(strong, F.col("_best.near")).alias("form"), F.when(strong, -F.col("_best.n")).alias("form_n")), "near-words")
    roots = follow(near.where(F.col("form").isNotNull()))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        F.col("n").cast("long").alias("n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("form_n").cast("long").alias("form_n"),
    )


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: str = r"[A-Za-zÀ-ÿ]+") -> DataFrame:
    """(doc_id, run): the maximal runs of letters of whole texts, with A-Z lowered, one row
    per place. Null and empty texts have none."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lowered, F.lit(letters), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("run"))


def frequent_words(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of a frame of places, with the number of their places,
    of those with at least so many code points and places. Null words are left out."""
    long_enough = F.char_length("word") >= min_length
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(long_enough & (F.col("n") >= min_count))
