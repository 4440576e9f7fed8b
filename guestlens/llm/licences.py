"""License notices: word places of fixed phrases, and an exact set-similarity join."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.session import stage

# Phrases of which every place counts, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notices whose words are looked for as a set, with their labels; words as the operator
# splits them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
)
# Share of the template's words that a block must hold.
CONTAINMENT = 0.8
# Words of a block at least; blocks start every half block and are twice as long as the
# longest template, so that a notice of its length lies whole in one of them.
BLOCK_WORDS = 64


def _plain(text: Column) -> Column:
    """Words separated and enclosed by single spaces. A-Z are lowered with all other
    letters, which changes no word into or out of those looked for."""
    gaps = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(gaps), F.lit(" "))


def _places(words: Column, plain: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words; looked for only where the text has it."""
    parts = phrase.split()

    def starts(i: Column) -> Column:
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    nowhere = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.size(words) - 1)
    return F.when(plain.contains(f" {phrase} "), F.filter(every, starts)).otherwise(nowhere)


def scan_licences(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates=TEMPLATES,
    containment: float = CONTAINMENT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    Base: all places where the words of a phrase stand one after the other. Method: an
    exact join of text blocks with notice templates by the share of the template's words
    that the block holds. One pass counts in how many documents each template word
    occurs and orders the words by that, rarest first. A template that needs o of its k
    words must share one of its k - o + 1 rarest words with the block (prefix filter), so
    only blocks with such a word are joined, by word. A pair is dropped when the block
    has fewer than o template words (length filter) or when the shared word stands too
    late in either order for o common words (positional filter). What remains is
    verified by the whole intersection. The templates are a bounded list, so their side
    is broadcast; documents travel only as the word numbers of their candidate blocks.

    score is the largest share found, 1 with a base phrase, 0 without any label. A null
    text is empty: no words, no labels, null places. Repeated rows are rows of their own.
    An empty table gives no rows. Other columns are not looked at.
    """
    kept = [(n, label, sorted(set(words.split()))) for n, (label, words) in enumerate(templates)]
    vocabulary = sorted({w for _, _, words in kept for w in words})

    plain = docs.select(F.col(doc_id).alias("doc_id"), _plain(F.col(text)).alias("plain"))
    words = plain.select("doc_id", "plain", F.filter(F.split("plain", " "), lambda w: w != "").alias("words"))

    seen = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    spark = docs.sparkSession
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    counts = known.join(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left")
    # as many rows as the templates have words
    order = counts.orderBy(F.coalesce("n", F.lit(0)), "word").select("word").collect()
    rank = {row["word"]: n for n, row in enumerate(order)}

    index = []
    for n, label, parts in kept:
        ranks = sorted(rank[w] for w in parts)
        need = math.ceil(containment * len(ranks) - 1e-9)
        index += [(r, n, label, at, len(ranks), need, ranks) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    rare = sorted({order[row[0]]["word"] for row in index})
    index = spark.createDataFrame(
        index, "word int, template int, label string, at_template int, k int, need int, ranks array<int>"
    )

    block_words = max([block_words, *(2 * len(words.split()) for _, words in templates)])
    step = block_words // 2
    numbers = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, rank[w])))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - step) / step).cast("int") - 1))
    blocks = F.transform(starts, lambda i: F.slice(F.col("words"), i * step + 1, block_words))
    blocks = F.filter(blocks, lambda b: F.exists(b, lambda w: w.isin(rare)))
    blocks = F.transform(
        blocks,
        lambda b: F.array_sort(F.array_distinct(F.transform(F.filter(b, lambda w: w.isin(vocabulary)), lambda w: numbers[w]))),
    )
    blocks = F.when(F.exists("words", lambda w: w.isin(rare)), F.array_distinct(blocks))
    by_phrase = {label: _places(F.col("words"), F.col("plain"), phrase) for phrase, label in phrases.items()}
    found = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *(places.alias(f"at_{n}") for n, places in enumerate(by_phrase.values())),
        blocks.alias("blocks"),
        F.monotonically_increasing_id().alias("_row"),
    )
    found = stage(found, "license-blocks")

    pairs = found.select("_row", F.posexplode("blocks").alias("block", "words"))
    pairs = pairs.select("_row", "block", "words", F.posexplode("words").alias("at_block", "word"))
    pairs = pairs.join(F.broadcast(index), "word")
    size = F.size("words")
    common = 1 + F.least(F.col("k") - 1 - F.col("at_template"), size - 1 - F.col("at_block"))
    pairs = pairs.where((size >= F.col("need")) & (common >= F.col("need")))
    shared = F.size(F.array_intersect("words", "ranks"))
    matches = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    matches = matches.groupBy("_row").agg(
        F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("k")).alias("share")
    )

    places = [F.col(f"at_{n}") for n in range(len(by_phrase))]
    base = F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, by_phrase))))
    every = F.concat(*places)
    none = F.array().cast("array<string>")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.join(matches, "_row", "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("found", none))).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
