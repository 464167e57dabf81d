"""MinHash near-duplicates: bottom-k sketches, inverted lists, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corelode.llm.common import id_and_text, shingle_sets, texts_of
from corelode.llm.components import components
from corelode.operators.ordered import row_numbers
from corelode.session import keep

# Least similarity of two linked documents, in percent of the union.
SIMILARITY = 75
# Values a sketch retains (the least fingerprints of a set), and how many of them two
# sketches of linked documents share at least. With similarity 0.75 each of the least
# values of the union is shared with probability 0.75: 36 of 48 and 384 of 512 on
# average. Six standard deviations less has a probability of about 1e-9.
RETAINED, SHARED = 48, 18
FINE_RETAINED, FINE_SHARED = 512, 325
# Parts of a whole set that are compared by one hash each before two documents become a pair.
PARTS = 256


def _sets_in(batches: Iterator[pa.RecordBatch], retained: int | None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (doc_id, text) to sketches (or to whole sets without ``retained``)."""
    for batch in batches:
        for start, texts in texts_of(batch.column("text")):
            sets = list(shingle_sets(texts))
            ids = batch.column("doc_id").slice(start, len(texts))
            kept = sets if retained is None else [s[:retained] for s in sets]
            values = pa.array(kept, type=pa.list_(pa.int64()))
            if retained is None:
                yield pa.RecordBatch.from_arrays([ids, values], names=["doc_id", "shingles"])
            else:
                key = pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], type=pa.binary())
                sizes = pa.array([len(s) for s in sets], type=pa.int64())
                yield pa.RecordBatch.from_arrays([ids, key, sizes, values], names=["doc_id", "set_key", "n_shingles", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, set_key, n_shingles, sketch): a hash of the shingle set, its size, its least values."""
    return docs.mapInArrow(lambda b: _sets_in(b, RETAINED), "doc_id long, set_key binary, n_shingles long, sketch array<long>")


def inverted_lists(sketched: DataFrame, retained: int, shared: int) -> DataFrame:
    """(value, doc, n_shingles, alone, position): documents by retained value, where two have it.

    ``sketched`` is (doc, n_shingles, sketch). Two linked documents share at
    least ``need`` of their retained values: ``shared``, or 75 percent of a set
    that is its own sketch if that is less. Ordered from rare to frequent, each
    therefore has one of the shared values among its first ``size - need + 1``;
    only these enter a list. ``alone`` counts the values of a document that no
    other has: they are its rarest. So a document of its own makes no list, and
    neither does a passage that many quote, unless it fills much of a sketch.

    ``position`` is the number of values before this one. A first shared value
    at a position leaves no more values to share than follow it, so a row whose
    position is too late for the sizes in its list is left out.
    """
    values = sketched.select("doc", "n_shingles", F.explode("sketch").alias("value"))
    frequent = values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    size = F.least(F.col("n_shingles"), F.lit(retained))
    # Whole sets share the intersection. A set of up to 75 percent of a sketch only meets whole sets; up to a sketch it may meet either.
    whole = F.expr(f"(n_shingles * {SIMILARITY} + 99) div 100")
    need = F.when(F.col("n_shingles") * 100 <= retained * SIMILARITY, whole).otherwise(F.least(whole, F.lit(shared)))
    own = values.join(frequent, "value").groupBy("doc", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("shared"))  # a sketch at most
    alone = size - F.size("shared")
    first = F.greatest(F.lit(0), size - need + 1 - alone).cast("int")
    listed = keep(own.select("doc", "n_shingles", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), first)).alias("k", "s")).select(
        F.col("s.value").alias("value"), "doc", "n_shingles", "alone", (F.col("k") + F.col("alone")).alias("position")))
    for _ in range(2):  # rows left out may leave others alone in their list
        sizes = listed.groupBy("value").agg(F.count("*").alias("rows"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")).filter("rows > 1")
        possible = F.least(_least_shared("n_shingles", "low", retained), _least_shared("n_shingles", "high", retained))
        listed = keep(listed.join(sizes, "value").filter(F.col("position") + possible <= F.least("n_shingles", F.lit(retained))).drop("rows", "low", "high"))
    return listed


def _least_shared(n: str, m: str, retained: int) -> Column:
    """Values that the sketches of linked sets of ``n`` and ``m`` values share at least.

    The sets share 3/7 of n + m at least, and whole sets are their own
    sketches. Of a set beyond its sketch the retained values are a sample in
    proportion to the larger set: six standard deviations less are granted.
    """
    shared = (F.col(n) + F.col(m)) * (SIMILARITY / (100.0 + SIMILARITY))
    larger = F.greatest(n, m)
    return F.when(larger <= retained, shared - 1e-6).otherwise(shared * retained / larger - 3.0 * retained**0.5)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the similarity: first by their sketches, then by the whole sets."""
    a, b = (sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"{side}_set")) for side in "ab")
    both = pairs.join(a, "a").join(b, "b")
    sketch = {s: F.slice(f"{s}_set", 1, RETAINED) for s in "ab"}
    union = F.slice(F.array_sort(F.array_union(sketch["a"], sketch["b"])), 1, RETAINED)
    agreeing = F.size(F.array_intersect(F.array_intersect(union, sketch["a"]), sketch["b"]))
    hopeful = both.filter(agreeing * RETAINED >= SHARED * F.size(union))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return hopeful.filter(common * 100 >= (F.size("a_set") + F.size("b_set") - common) * SIMILARITY).select("a", "b")


def _position_fits() -> Column:
    """Whether the first shared value of a member and a hub leaves both enough to share."""
    least = _least_shared("n_shingles", "hub_n", FINE_RETAINED)
    member, hub = (F.col(place) + least <= F.least(n, F.lit(FINE_RETAINED)) for n, place in (("n_shingles", "position"), ("hub_n", "hub_position")))
    return member & hub


def _paired(joined: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of hubs and members whose sizes and positions allow the similarity."""
    return joined.filter(_position_fits() & (F.col("doc") != F.col("hub"))).select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).distinct()


def _with_roots(lists: DataFrame, labels: DataFrame) -> DataFrame:
    roots = labels.withColumnRenamed("node", "doc").withColumnRenamed("root", "known")
    return lists.join(roots, "doc", "left").withColumn("root", F.coalesce("known", "doc")).drop("known")


def _room(n: Column, shared: Column) -> Column:
    """The largest set that a set of ``n`` values can be linked to when others have only ``shared`` of them."""
    return F.floor(shared * (100 + SIMILARITY) / SIMILARITY + 1e-9) - n


def _apart(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(value, doc, n_shingles, alone, position, n_common, parts, room, before): the rows of lists in several components that may still be linked.

    A document left here is compared with others left here only, so the values
    of its whole set that none of them has cannot be shared: what remains gives
    the largest set it can be linked to (:func:`_room`). Rows that no other size
    in their list suits go. Copies that many edits have moved just out of reach
    of each other have values of their own, and drop out here before they meet
    in pairs. A second pass counts again without those that went. ``before``
    holds the values of a document whose lists come before this one; it is
    empty, and ``parts`` null, where rows of one id have several sets.
    """
    rooted = _with_roots(lists, labels)
    for _ in range(2):
        split = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n_shingles").alias("least")).filter("low < high")
        live = keep(rooted.join(split.select("value", "least"), "value"))
        values = keep(sets.join(live.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("x")).distinct())
        common = values.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
        shared = _parts_of(values.join(common, "x"))
        room = _room(F.col("n_shingles"), F.least("n_shingles", F.coalesce("n_common", F.lit(0))))
        suited = live.drop("room", "n_common", "parts").join(shared, live["doc"] == shared["doc_id"], "left").withColumn("room", room)
        rooted = keep(suited.filter("room >= least").drop("least", "doc_id"))
    split = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("value")
    left = rooted.drop("root").join(split, "value", "left_semi")
    before = F.collect_list("value").over(Window.partitionBy("doc").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    several = sets.groupBy("doc_id").agg(F.count("*").alias("n_sets")).filter("n_sets > 1")  # one id, several texts
    told = left.withColumn("before", before).join(several, left["doc"] == several["doc_id"], "left")
    one = F.col("n_sets").isNull()
    return told.withColumns({"before": F.when(one, F.col("before")).otherwise(F.array().cast("array<long>")), "parts": F.when(one, F.col("parts"))}).drop("doc_id", "n_sets")


def _parts_of(values: DataFrame) -> DataFrame:
    """(doc_id, n_common, parts): how many values ``x`` a document has, and by parts of the values 15 bits of their exclusive or."""
    by_part = values.groupBy("doc_id", F.pmod("x", F.lit(PARTS)).cast("int").alias("p")).agg(F.count("*").alias("k"), F.bit_xor("x").alias("h")).withColumn("h", F.shiftrightunsigned("h", 49).cast("short"))
    of_doc = by_part.groupBy("doc_id").agg(F.sum("k").alias("n_common"), F.map_from_entries(F.collect_list(F.struct("p", "h"))).alias("m"))
    return of_doc.select("doc_id", "n_common", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(0).cast("short"))).alias("parts"))


def _parts_fit() -> Column:
    """Whether a member and a hub differ in no more parts than linked sets can.

    Both sets share common values only, 3/7 of their sizes at least; the other
    common values of either are different values, and each lies in one part.
    A document of several sets has no parts and fits.
    """
    apart = F.col("n_common") + F.col("hub_common") - (F.col("n_shingles") + F.col("hub_n")) * (2.0 * SIMILARITY / (100 + SIMILARITY))
    differ = F.aggregate(F.zip_with("parts", "hub_parts", lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, d: t + d)
    return F.coalesce(differ <= apart + 1e-6, F.lit(True))


def _links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Components of the linked documents: (node, root).

    First every list is tied to the document with the fewest values of its own,
    the likeliest centre: a star, in which a copy makes one pair. What this
    leaves in several components (:func:`_apart`) goes through rounds: documents
    at places 1-4, 5-20, 21-84, ... are paired with later ones of other
    components, until no place is left. Two documents meet once, in the list of
    their first shared value, and only if their sets may be alike
    (:func:`_parts_fit`). Of two linked documents one at least
    could be linked to a set of its own size (if each had less room than that,
    neither would fit into the other's), so only such documents start pairs;
    they come first in a list.
    """
    hubs = lists.groupBy("value").agg(F.min(F.struct("alone", "doc", "n_shingles", "position")).alias("h")).select(
        "value", F.col("h.doc").alias("hub"), F.col("h.n_shingles").alias("hub_n"), F.col("h.position").alias("hub_position"))
    labels = components(verified(_paired(lists.join(hubs, "value")), sets).select(F.col("b").alias("u"), F.col("a").alias("v")))
    apart = _apart(lists, labels, sets).withColumn("starts", F.col("room") >= F.col("n_shingles"))
    live = keep(row_numbers(apart, ["value"], [F.col("starts").desc(), F.col("alone"), F.col("doc"), F.col("n_shingles")], "place"))
    longest = live.filter("starts").agg(F.max("place")).first()[0] or 0
    first, size = 1, 4
    while first <= longest:
        members = _with_roots(live.filter(F.col("place") > first), labels)
        hubs = _with_roots(live.filter(F.col("starts") & (F.col("place") >= first) & (F.col("place") < first + size)), labels).select(
            F.col("value").alias("hub_value"), F.col("doc").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("position").alias("hub_position"),
            F.col("place").alias("hub_place"), F.col("root").alias("hub_root"), F.col("room").alias("hub_room"),
            F.col("n_common").alias("hub_common"), F.col("parts").alias("hub_parts"), F.col("before").alias("hub_before"))
        fits = F.expr("value = hub_value AND place > hub_place AND root <> hub_root AND n_shingles <= hub_room AND hub_n <= room")
        once = ~F.arrays_overlap("before", "hub_before")
        found = keep(verified(_paired(members.join(hubs, fits & _position_fits() & once & _parts_fit())), sets).select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not found.isEmpty():
            labels = components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        first, size = first + size, size * 4
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of ``docs``: one row per row, with the least id of its component.

    A document's set: its distinct five-word shingles (words are runs without
    white space, A-Z as a-z); fewer words are one shingle; no words, no set.
    Documents are linked at 75 percent of the union of their sets or more, and
    components are the transitive closure.

    1. One pass makes each set's 48 least fingerprints of one hash function.
       Documents of the same set are one class from here on.
    2. Inverted lists of the rarest retained values (:func:`inverted_lists`)
       leave the documents that may have a partner. Their whole sets are made,
       and lists of 512 values each, which let far fewer false pairs through.
    3. Pairs from the lists (:func:`_links`) pass an estimate from the union of
       the sketches, then the whole sets decide. Lists whose documents are in
       one component make no more pairs, so a group of near copies costs a few
       pairs per document; of other pairs only those are left out whose sizes and
       values of their own rule a link out.

    Documents without words are their own component. Rows of one id and several
    texts are one node of the graph, linked if any of its texts is. Null ids never name a
    component: such rows get their class's component, or null, and then stay.
    Repeated rows all get the same answer. Empty tables give no rows; other
    columns are not carried.

    Returns doc_id, n_shingles, component_id, kept.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = keep(sketches(texts))
    classes = keep(
        rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    wanted = inverted_lists(classes, RETAINED, SHARED).select(F.col("doc").alias("doc_id")).distinct()
    sets = keep(texts.join(wanted, "doc_id", "left_semi").distinct().mapInArrow(lambda b: _sets_in(b, None), "doc_id long, shingles array<long>"))
    fine = sets.select(F.col("doc_id").alias("doc"), F.size("shingles").cast("long").alias("n_shingles"), F.slice("shingles", 1, FINE_RETAINED).alias("sketch"))
    lists = keep(inverted_lists(fine, FINE_RETAINED, FINE_SHARED))
    labels = _links(lists, sets)
    named = classes.join(labels, classes["doc"] == labels["node"], "left").select("set_key", F.coalesce("root", "doc").alias("root"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return rows.drop("sketch").join(named, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
