"""Mixing sources to target weights by entropy balancing."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.binding import bind
from guestlens.llm.common import free_name, words_count
from guestlens.operators.workplan import number_rows
from guestlens.session import stage

# Weights of the sources in code-point order, repeating; share of all words that the
# mix takes; most often that a document may be taken.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2

# Parts in which documents of one source and size are ranked.
_PARTS = 1024
_STEPS = 100


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds the target words to (_key, source_size), one row per source, `_key` ordered.

    Targets are min(cap * size, level * weight), with the level at which they add up to
    the share: what sources cannot take is shared out again by weight. Each round is one
    aggregate; the set of full sources only grows, so the rounds end.
    """
    numbered = number_rows(sources, "_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    numbered = stage(numbered.select("_key", "source_size", weight.alias("_weight")), "sources")
    full, level = -1, 0.0
    limit = F.col("source_size") * cap
    while True:
        is_full = limit <= level * F.col("_weight")
        row = numbered.agg(
            F.count_if(is_full).alias("full"),
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(is_full, limit)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~is_full, F.col("_weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full, level = row["full"], (share * row["words"] - row["taken"]) / row["weight"]
    target = F.least(limit.cast("double"), F.lit(level) * F.col("_weight"))
    return numbered.select("_key", "source_size", target.alias("target"))


def entropy_rates(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-7, cap: int = CAP) -> DataFrame:
    """Rates of documents, by source and size: `cells` (_key, _size, _n) with source_size,
    target and _rate.

    Of all rates up to the cap with which every source's documents have its target of words,
    those with the least relative entropy against taking each document once are exponentially
    tilted by the words of the document, min(cap, exp(tilt * words)). The tilts of the sources
    solve the convex dual: the derivative by a tilt is the words taken less the target. Each
    Newton step sums, over the stored counts, the words that the present rates take (the
    gradient) and how these change with the tilt, to which documents at the cap add nothing
    (the Hessian), in one combining aggregate. A step that leaves the interval in which the
    solution is known to lie halves it instead. Steps go on until every source is within
    `tolerance` of its target. A source without words keeps rate 1.
    """
    words = F.col("_n") * F.col("_size")
    spread = cells.where("_size > 0").groupBy("_key").agg(F.sum(words).alias("_words"), F.sum("_n").alias("_docs"), F.min("_size").alias("_least"))
    # tilts are by multiples of the mean size; between these two the solution lies
    scale = F.col("_words") / F.col("_docs")
    unit = scale / F.col("_least")
    all_capped = F.col("target") >= cap * F.col("source_size") * (1 - tolerance)
    high = math.log(cap) * unit
    low = F.least(F.lit(0.0), F.log(F.try_divide("target", "source_size"))) * unit
    tilts = targets.join(spread, "_key", "left").select(
        "_key", "source_size", "target", scale.alias("_scale"), low.alias("_low"), high.alias("_high"),
        F.when(all_capped, high).otherwise(0.0).alias("_tilt"), (F.coalesce("_words", F.lit(0)) == 0).alias("_done"),
    )
    tilts = stage(tilts, "tilts")
    exponent = F.col("_tilt") * F.col("_size") / F.col("_scale")
    rate = F.least(F.lit(float(cap)), F.exp(exponent))
    below_cap = exponent < math.log(cap)
    for _ in range(_STEPS):
        if tilts.where(~F.col("_done")).isEmpty():
            break
        took = cells.where("_size > 0").join(tilts.where(~F.col("_done")).select("_key", "_tilt", "_scale"), "_key")
        took = took.groupBy("_key").agg(
            F.sum(words * rate).alias("_took"), F.coalesce(F.sum(F.when(below_cap, words * rate * F.col("_size") / F.col("_scale"))), F.lit(0.0)).alias("_slope")
        )
        off = F.col("_took") - F.col("target")
        now_low = F.when(off <= 0, F.greatest("_low", "_tilt")).otherwise(F.col("_low"))
        now_high = F.when(off >= 0, F.least("_high", "_tilt")).otherwise(F.col("_high"))
        newton = F.when(F.col("_slope") > 0, F.col("_tilt") - off / F.col("_slope"))
        inside = F.coalesce((newton > now_low) & (newton < now_high), F.lit(False))
        done = F.col("_done") | (F.abs(off) <= tolerance * F.col("target"))
        after = F.when(done, F.col("_tilt")).when(inside, newton).otherwise((now_low + now_high) / 2)
        tilts = tilts.join(took, "_key", "left").select(
            "_key", "source_size", "target", "_scale",
            *(F.when(F.col("_done"), F.col(c)).otherwise(x).alias(c) for c, x in (("_low", now_low), ("_high", now_high), ("_tilt", after))),
            done.alias("_done"),
        )
        tilts = stage(tilts, "tilts")
    else:
        raise RuntimeError(f"the tilts have not converged in {_STEPS} steps")
    rated = cells.join(tilts.select("_key", "source_size", "target", "_tilt", "_scale"), "_key")
    return rated.select("_key", "_size", "_n", "source_size", "target", F.when(F.col("_size") > 0, rate).otherwise(1.0).alias("_rate"))


def whole_copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies of each (source, size): adds _copies to the result of `entropy_rates`.

    Per source, from the largest size down, the fractional copies are rounded and the
    words rounded away are carried on to the next size, so that the smallest documents
    even out the rest. The array holds one element per distinct size of a source, so it
    is bounded by the longest document, not by the number of documents; it is worked off in
    pieces of the root of its length, since each step copies the piece made so far.
    """
    kept = ["_size", "_n", "_rate"]
    sizes = rated.groupBy("_key", "source_size", "target").agg(F.sort_array(F.collect_list(F.struct(*kept)), asc=False).alias("_sizes"))
    length = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_sizes"))).cast("int"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("_sizes") / length).cast("int") - 1)
    pieces = F.transform(starts, lambda i: F.slice("_sizes", i * length + 1, length))
    kind = "array<struct<_size:bigint,_n:bigint,_copies:bigint>>"

    def state(carry: Column, cells: Column) -> Column:
        return F.struct(carry.alias("carry"), cells.alias("cells"))

    def take(before: Column, cell: Column) -> Column:
        wanted = cell["_rate"] * cell["_n"] * cell["_size"] + before["carry"]
        copies = F.when(
            cell["_size"] > 0,
            F.greatest(F.lit(0), F.least(F.round(wanted / cell["_size"]).cast("long"), cell["_n"] * cap)),
        ).otherwise(cell["_n"])
        taken = F.struct(cell["_size"].alias("_size"), cell["_n"].alias("_n"), copies.alias("_copies"))
        return state(wanted - copies * cell["_size"], F.array_append(before["cells"], taken))

    def take_piece(before: Column, piece: Column) -> Column:
        made = F.aggregate(piece, state(before["carry"], F.array().cast(kind)), take)
        return bind(made, lambda m: state(m["carry"], F.array_append(before["cells"], m["cells"])))

    folded = F.aggregate(pieces, state(F.lit(0.0), F.array().cast(f"array<{kind}>")), take_piece, lambda last: F.flatten(last["cells"]))
    return sizes.select("_key", "source_size", "target", F.inline(folded))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, dict[str, str]]:
    """The documents with size, source size, target and copies; also the names given to
    these four columns, which differ from those of the documents.

    Entropy balancing (`entropy_rates`), rounded to whole copies per source and size
    (`whole_copies`). Which documents of equal source and size get one copy more is
    decided by a hash of the id: first a share for each of many parts, then a rank
    within the part, so neither a giant source nor many equal documents meet in a task.
    Rows with equal id and size get the same total of copies in every run.

    A null text has no words. Null is a source of its own, the last one. Documents
    without words are taken once and add nothing. An empty table gives no rows.
    """
    names = {n: free_name(docs, n) for n in ("size", "source_size", "target", "copies")}
    inner = {n: free_name(docs, n) for n in ("_row_key", "_row_size", "_row_part", "_rank")}
    key = F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    part = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(_PARTS))
    sized = docs.withColumns(
        {inner["_row_key"]: key, inner["_row_size"]: words_count(F.col(text)), inner["_row_part"]: part}
    )
    where = [inner["_row_key"], inner["_row_size"], inner["_row_part"]]
    parts = sized.groupBy(*(F.col(c).alias(n) for c, n in zip(where, ("_key", "_size", "_part")))).agg(
        F.count(F.lit(1)).alias("_n_part")
    )
    parts = stage(parts, "mix-parts")
    cells = stage(parts.groupBy("_key", "_size").agg(F.sum("_n_part").alias("_n")), "mix-sizes")
    sources = cells.groupBy("_key").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size"))
    rates = entropy_rates(cells, source_targets(sources, weights, share, cap), cap=cap)
    copies = whole_copies(rates, cap)

    # the extra copies of a cell spread over its parts in proportion, at most _PARTS rows a cell
    every = F.floor(F.col("_copies") / F.col("_n")).cast("long")
    extra = F.col("_copies") - every * F.col("_n")
    before = F.sum("_n_part").over(Window.partitionBy("_key", "_size").orderBy("_part")) - F.col("_n_part")
    quota = F.floor(extra * (before + F.col("_n_part")) / F.col("_n")) - F.floor(extra * before / F.col("_n"))
    quotas = parts.join(copies, ["_key", "_size"]).select(
        "_key", "_size", "_part", "source_size", "target", every.alias("_every"), quota.cast("long").alias("_quota")
    )
    quotas = stage(quotas, "mix-quotas")
    rank = F.row_number().over(Window.partitionBy(*where).orderBy(F.xxhash64(F.col(doc_id), F.lit(1)), F.col(doc_id)))
    ranked = sized.withColumn(inner["_rank"], rank)
    same = [ranked[c] == quotas[n] for c, n in zip(where, ("_key", "_size", "_part"))]
    taken = quotas["_every"] + F.when(ranked[inner["_rank"]] <= quotas["_quota"], 1).otherwise(0)
    mixed = ranked.join(quotas, same).select(
        *(ranked[c] for c in docs.columns),
        ranked[inner["_row_size"]].alias(names["size"]),
        quotas["source_size"].alias(names["source_size"]),
        quotas["target"].alias(names["target"]),
        taken.cast("long").alias(names["copies"]),
    )
    return mixed, names


def repeat_by_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns."""
    mixed, names = mix_sources(docs)
    times = F.array_repeat(F.lit(0), F.col(names["copies"]).cast("int"))
    return mixed.withColumn(names["copies"], F.explode(times)).select(*(F.col(f"`{c}`") for c in docs.columns))
