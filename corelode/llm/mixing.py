"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.ordered import join_on, row_numbers, running_totals
from corelode.session import keep

# Weights of the sources in turn, and the most copies of a document or a source.
WEIGHTS = (1, 2, 3)
MOST = 3
WORDS, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r"
# Rates are whole multiples of 1/ONE, so that sums do not depend on the order of their terms.
ONE = 1 << 30
# A multiplier is at rest when its source's words are this close to the target.
CLOSE, CLOSE_SHARE = 0.5, 1e-7
# Every round either takes a Newton step inside the bracket or halves it: doubles end long before.
MOST_ROUNDS = 200
# Documents of one source and size that one task ranks.
RANKED = 2_000


def word_count(text: Column) -> Column:
    """Runs without white space, counted without a list of them."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORDS, "w"), SPACES, "")), F.lit(0)).cast("long")


def source_targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``by_source`` (source, source_size) with ``target``, in words.

    Sources in the order of their code points, null last, take the weights in
    turn and share the sum of all sizes. A target stops at MOST times the size
    of its source; what is over is shared by weight again, one aggregation of
    the sources a round, until no target is above.
    """
    ranked = row_numbers(by_source, [], [F.col("source").asc_nulls_last()], "nth")
    turn = F.array(*[F.lit(w) for w in weights])
    shares = keep(ranked.withColumn("weight", F.element_at(turn, ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long")).drop("nth"))
    most = F.col("source_size") * MOST
    total, open_weight = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, stopped = total, 0
    while open_weight:
        above = F.lit(rest).cast("double") * F.col("weight") / F.lit(open_weight) >= most
        held, weight, n = shares.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        if n == stopped:
            break
        rest, open_weight, stopped = total - held, weight, n
    share = F.lit(rest).cast("double") * F.col("weight") / F.lit(open_weight) if open_weight else most.cast("double")
    return shares.withColumn("target", F.least(most.cast("double"), share)).drop("weight")


def rate(multiplier: Column, part: Column) -> Column:
    """The exponentially tilted copies per document, in multiples of 1/ONE, at most MOST."""
    return F.round(F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * part, F.lit(2.0)))) * ONE).cast("long")


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, multiplier): rates ``min(MOST, exp(multiplier * size / largest size))`` meet the targets.

    ``sizes`` (source, size, n) counts the documents of each positive size,
    ``targets`` is (source, source_size, target). Of all rates between 0 and MOST
    whose words meet the target, these have the greatest entropy; the multipliers
    minimise the convex dual. A round sums the words and their slope over
    ``sizes`` (one aggregation for all sources) and takes a Newton step, or halves the
    bracket where the step would leave it. The bracket starts at the multipliers
    that suit the smallest document alone. States of the sources are a table in
    the shared folder; sums are whole numbers, so every run gives the same bits.
    """
    extent = sizes.groupBy("source").agg(F.max("size").alias("largest"), F.min("size").alias("smallest"))
    least = F.col("smallest") / F.col("largest")
    want = F.col("target") / F.col("source_size")
    state = keep(join_on(extent, targets, ["source"]).select(
        "source", "largest", "target",
        F.when(want < 1, F.log(want) / least).otherwise(F.lit(0.0)).alias("low"),
        F.when(want > 1, math.log(MOST) / least).otherwise(F.lit(0.0)).alias("high"),
        F.when(want == 1, F.lit(0.0)).when(want >= MOST, math.log(MOST) / least).otherwise(F.lit(0.0)).alias("multiplier"),
        ((want == 1) | (want >= MOST)).alias("rest")))
    for _ in range(MOST_ROUNDS):
        moving = state.filter("NOT rest")
        if moving.isEmpty():
            break
        part = F.col("size") / F.col("largest")
        taken = join_on(sizes, moving, ["source"]).withColumn("rate", rate(F.col("multiplier"), part))
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)") * F.col("rate").cast("decimal(11,0)")
        slope = F.when(F.col("rate") < MOST * ONE, F.round((F.col("n") * F.col("size")).cast("double") * part * (F.col("rate") / ONE)).cast("decimal(25,0)"))
        sums = taken.groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).cast("double").alias("slope"))
        over = F.col("words").cast("double") / ONE - F.col("target")
        low, high = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(over > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - F.col("over") / F.nullif(F.col("slope"), F.lit(0.0))
        stepped = join_on(moving, sums, ["source"]).withColumn("over", over).withColumns({"low": low, "high": high}).withColumn("step", step)
        middle = (F.col("low") + F.col("high")) / 2
        at_rest = (F.abs("over") <= F.greatest(F.lit(CLOSE), F.col("target") * CLOSE_SHARE)) | (middle <= F.col("low")) | (middle >= F.col("high"))
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        moved = stepped.select(
            "source", "largest", "target", "low", "high",
            F.when(at_rest, F.col("multiplier")).when(inside, F.col("step")).otherwise(middle).alias("multiplier"), at_rest.alias("rest"))
        state = keep(state.filter("rest").unionByName(moved))
    return state.select("source", "largest", "multiplier")


def _amended(whole: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, more, at_size, at_cell, at_place): the one document whose copy more or less brings a source's words nearest to its target.

    Null where none does. ``whole`` is (source, size, cell, place, copies); a
    source sends one candidate per task.
    """
    left = join_on(whole.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words")), targets, ["source"]).select(
        "source", (F.col("target") - F.col("words")).alias("left"))
    more = F.when(F.col("left") > 0, 1).otherwise(-1)
    able = join_on(whole, left, ["source"]).withColumn("more", more).filter((F.col("copies") + F.col("more")).between(0, MOST)).withColumn(
        "after", F.abs(F.col("left") - F.col("more") * F.col("size"))).filter(F.col("after") < F.abs("left"))
    best = able.groupBy("source").agg(F.min(F.struct("after", "size", "cell", "place", "more")).alias("b"))
    named = best.select("source", F.col("b.more").alias("more"), F.col("b.size").alias("at_size"), F.col("b.cell").alias("at_cell"), F.col("b.place").alias("at_place"))
    return keep(join_on(targets.select("source"), named, ["source"], "left"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How many copies of each document a mix takes whose sources have the target sizes.

    1. One pass counts words; the rest works on (doc_id, source, size), and the
       rates on the number of documents of each source and size.
    2. :func:`source_targets`, then :func:`balance`: one rate per source and size.
    3. Copies are whole. Documents of one source and size are dealt into cells of
       about RANKED by a hash of the id. Over the cells of a source, from large
       documents to small, the running sum of rates is rounded; a cell gets the
       difference, its documents equal shares, and what is over goes to the first
       by the hash. So the words taken differ from the target by about half the
       source's largest document at most; one copy more or less of the document
       whose size is nearest to what is left closes most of that. No document is
       taken more than MOST times.

    A null text has size 0 and is taken 0 times, as is an empty one. Null
    sources are one source. Null ids and repeated rows are rows like others;
    rows of the same id, source and size may share copies unevenly. Empty tables
    give no rows; other columns are not carried.

    Returns doc_id, size, source_size, target, taken.
    """
    rows = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    counted = keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = keep(source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights))
    sizes = counted.filter("size > 0")
    multipliers = balance(sizes, targets)
    rates = keep(join_on(sizes, multipliers, ["source"]).select(
        "source", "size", F.ceil(F.col("n") / RANKED).alias("cells"), rate(F.col("multiplier"), F.col("size") / F.col("largest")).alias("rate")))
    dealt = join_on(rows.filter("size > 0"), rates, ["source", "size"]).withColumn("hash", F.xxhash64("doc_id")).withColumn(
        "cell", F.pmod(F.xxhash64("hash"), "cells"))
    cells = dealt.groupBy("source", "size", "cell").agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    worth = F.col("n").cast("decimal(18,0)") * F.col("rate").cast("decimal(11,0)")
    summed = running_totals(cells, ["source"], [F.col("size").desc(), F.col("cell")], {"upto": worth})
    rounded = lambda c: F.expr(f"cast(({c} + {ONE // 2}) div {ONE} as bigint)")
    copies = summed.withColumn("before", F.col("upto") - worth).select("source", "size", "cell", "n", (rounded("upto") - rounded("before")).alias("copies"))
    placed = join_on(row_numbers(dealt, ["source", "size", "cell"], ["hash", "doc_id"], "place"), copies, ["source", "size", "cell"])
    each = F.expr("copies div n + CASE WHEN place <= copies % n THEN 1 ELSE 0 END")
    whole = keep(placed.select("doc_id", "source", "size", "cell", "place", each.alias("copies")))
    taken = join_on(whole, _amended(whole, targets), ["source"]).withColumn(
        "taken", (F.col("copies") + F.when((F.col("size") == F.col("at_size")) & (F.col("cell") == F.col("at_cell")) & (F.col("place") == F.col("at_place")), F.col("more")).otherwise(0)) * F.col("size")
    ).select("doc_id", "source", "size", "taken")
    nothing = rows.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    return join_on(taken.unionByName(nothing), targets, ["source"]).select("doc_id", "size", "source_size", "target", "taken")
