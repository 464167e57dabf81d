"""Line deduplication within an edit bound, by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corelode.session import keep

# Lines of fewer words are never dropped.
LEAST_WORDS = 4
# From this many words on, one word may be changed, added or left out; shorter lines must be equal.
EDIT_WORDS = 8
# Variants are made within rows of up to this many words, at a cost of their square; a longer line is cut into such rows.
ROW_WORDS = 256
KEY = ["v", "m"]


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line, n) of the lines that have enough words."""
    lines = rows.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return lines.withColumn("n", spaces + 1).filter(F.col("n") >= LEAST_WORDS)


def _line_key() -> Column:
    return F.unhex(F.md5("line")).alias("key")


def _halves() -> Column:
    """Hashes of half lines, at least one of which two lines within one edit share.

    An edit leaves the first or the last half of the shorter line as it is, and
    the shorter line has this many words or one less.
    """
    made = []
    for m in (F.col("n"), F.col("n") - 1):
        half = F.floor(m / 2).cast("int")
        made += [F.xxhash64(F.lit(0), m, F.slice("words", F.lit(1), half)), F.xxhash64(F.lit(1), m, F.slice("words", F.col("n") - half + 1, half))]
    return F.when(F.col("n") >= EDIT_WORDS, F.array(*made))


def _distinct_lines(rows: DataFrame) -> DataFrame:
    """(key, pos, n, halves, copies): each different line, with its first position."""
    words = F.when(F.col("n") >= EDIT_WORDS, F.split("line", " "))
    lines = _lines(rows).withColumn("words", words).select(_line_key(), F.struct("doc_id", "th", "line_no").alias("pos"), "n", _halves().alias("halves"))
    return lines.groupBy("key").agg(F.min("pos").alias("pos"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.count("*").alias("copies"))


def _with_partner(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(pos, n, words) of the lines that share a half with another: no other line can be within one edit."""
    halves = lines.filter("halves IS NOT NULL").select("key", "pos", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("k")).filter("k > 1").select("half")
    hopeful = halves.join(shared, "half", "left_semi").select("pos").distinct()
    doc = F.struct("doc_id", "th").alias("doc")  # as a struct, null ids are equal
    by_row = hopeful.groupBy(F.struct("pos.doc_id", "pos.th").alias("doc")).agg(F.collect_list("pos.line_no").alias("nos"))  # of one document
    # Rows equal in id and text are one document. The join has brought them together by the key of its right side, so nothing is dealt out again.
    texts = rows.select(doc.alias("own"), "text")
    own = texts.join(by_row, texts["own"] == by_row["doc"]).drop("own").dropDuplicates(["doc"]).select("doc.*", "text", "nos")
    picked = own.select("doc_id", "th", F.split("text", "\n").alias("lines"), F.explode("nos").alias("line_no"))
    words = F.split(F.element_at("lines", F.col("line_no") + 1), " ")
    return picked.select(F.struct("doc_id", "th", "line_no").alias("pos"), F.size(words).alias("n"), words.alias("words"))


def _place_hashes(word: Column, i: Column) -> list[Column]:
    """Hashes of a word at its place (a) and one place before (b)."""
    return [F.xxhash64(word, i).alias("a"), F.xxhash64(word, i - 1).alias("b")]


def _xor_of(hashes: str, field: str) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x[field]))


def _stretches(lines: DataFrame) -> DataFrame:
    """(pos, n, at, h, rest): stretches of up to ROW_WORDS words of each line, from word ``at`` on.

    ``h`` has the hashes of its words, ``rest`` the exclusive or of ``a`` over all words before the stretch and of ``b`` over all others.
    """
    few = F.col("n") <= ROW_WORDS
    short = lines.filter(few).select("pos", "n", F.lit(0).alias("at"), F.transform("words", lambda w, i: F.struct(*_place_hashes(w, i))).alias("h"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(ROW_WORDS)), lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, ROW_WORDS).alias("words")))
    long = lines.filter(~few).select("pos", "n", F.explode(cut).alias("c")).select("pos", "n", "c.at", "c.words").select(
        "pos", "n", "at", F.transform("words", lambda w, i: F.struct(*_place_hashes(w, i + F.col("at")))).alias("h"))
    line = Window.partitionBy("pos").orderBy("at")
    before = F.bit_xor("xor_a").over(line.rowsBetween(Window.unboundedPreceding, -1))
    others = F.bit_xor("xor_b").over(line.rowsBetween(0, Window.unboundedFollowing))
    long = long.withColumns({"xor_a": _xor_of("h", "a"), "xor_b": _xor_of("h", "b")}).withColumn("rest", F.coalesce(before, F.lit(0)).bitwiseXOR(others))
    return short.withColumn("rest", _xor_of("h", "b")).unionByName(long.drop("xor_a", "xor_b"))


def _variants(lines: DataFrame) -> DataFrame:
    """(v, m, i, pos): a line (i = 0) and all its variants without the i-th word, as hashed keys of m words.

    The key of a word sequence is the exclusive or of hashes of (word, place).
    Leaving a word out moves the later ones up a place, so all variants of a
    line come from one running hash over its words; words are no rows.
    """
    # rest: all words but the next, the later ones a place before; in the end, all words at their places.
    start = F.struct("rest", F.array().cast("array<long>").alias("made"))

    def with_next(s: Column, x: Column) -> Column:
        v = s["rest"].bitwiseXOR(x["b"])
        return F.struct(v.bitwiseXOR(x["a"]).alias("rest"), F.array_append(s["made"], v).alias("made"))

    last = F.col("at") + F.size("h") == F.col("n")
    keys = F.aggregate("h", start, with_next, lambda s: F.when(last, F.array_append(s["made"], s["rest"])).otherwise(s["made"]))
    each = _stretches(lines).select("pos", "n", "at", F.posexplode(keys).alias("k", "v")).withColumn("k", F.col("at") + F.col("k"))
    whole = F.col("k") == F.col("n")
    return each.select("v", F.when(whole, F.col("n")).otherwise(F.col("n") - 1).alias("m"), F.when(whole, 0).otherwise(F.col("k") + 1).alias("i"), "pos")


def _earlier(variants: DataFrame) -> DataFrame:
    """(pos, pos_of, i, kind): for lines with an earlier line under an equal variant, the earliest such.

    Three kinds of equal keys: both lines without their i-th word (``both``), a
    line and another without its i-th word (``self`` shorter or ``other``
    shorter). A group is only asked for its earliest line, so lines that all
    differ in one word cost one row each, not one per pair.
    """
    repeated = variants.groupBy(*KEY).agg(F.count("*").alias("k")).filter("k > 1").select(*KEY)
    met = keep(variants.join(repeated, KEY, "left_semi"))
    by_place = met.groupBy(*KEY, "i").agg(F.min("pos").alias("least"))
    by_key = by_place.groupBy(*KEY).agg(
        F.min(F.when(F.col("i") == 0, F.struct("least", "i"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.struct("least", "i"))).alias("part"))
    found = [
        met.filter("i > 0").join(by_place, [*KEY, "i"]).select("pos", F.struct(F.col("least").alias("pos_of"), "i", F.lit("both").alias("kind")).alias("w")),
        met.filter("i > 0").join(by_key.filter("whole IS NOT NULL"), KEY).select(
            "pos", F.struct(F.col("whole.least").alias("pos_of"), F.col("i"), F.lit("other").alias("kind")).alias("w")),
        met.filter("i = 0").join(by_key.filter("part IS NOT NULL"), KEY).select(
            "pos", F.struct(F.col("part.least").alias("pos_of"), F.col("part.i").alias("i"), F.lit("self").alias("kind")).alias("w")),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).filter("w.pos_of < pos")
    return every.groupBy("pos").agg(F.min("w").alias("w")).select("pos", "w.*")


def near_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(pos): first positions of lines with an earlier line within the bound, verified on their words."""
    hopeful = keep(_with_partner(lines, rows))
    found = _earlier(_variants(hopeful))
    texts = hopeful.select("pos", "words")
    both = found.join(texts, "pos").join(texts.select(F.col("pos").alias("pos_of"), F.col("words").alias("words_of")), "pos_of")

    def without(words: str) -> Column:
        return F.concat(F.slice(words, F.lit(1), F.col("i") - 1), F.slice(words, F.col("i") + 1, F.size(words)))

    equal = (
        F.when(F.col("kind") == "both", without("words") == without("words_of"))
        .when(F.col("kind") == "other", without("words") == F.col("words_of"))
        .otherwise(F.col("words") == without("words_of")))
    return both.filter(equal).select("pos").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without repeated lines in the text, plus ``n_lines`` and ``n_dropped``.

    Lines are parted by line feeds, words by single spaces. A line of four words
    or more is dropped if an equal line stands earlier in the table, and one of
    eight words or more also if an earlier line, of eight words or more as well,
    differs by one word changed, added or left out (eight against seven do not). Earlier means a smaller document id (null before all), a
    smaller hash of the text where ids are equal, then a smaller line number; an
    earlier line counts even if it is dropped itself. Documents all stay; one
    that loses all its lines has an empty text.

    1. Equal lines become one row with their first position.
    2. Lines within one edit share the first or the last half: lines whose
       halves nobody shares leave here, exactly and cheaply.
    3. The others emit every variant within the bound as a hashed key; groups
       of equal keys give each line the earliest other one, and the words
       themselves verify the edit.

    Null texts stay null and have no lines. Rows equal in id and text are one
    document given twice and lose the same lines. Empty tables give no rows.
    Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"))
    full = F.coalesce(F.col("row")[text_col], F.lit(""))  # made after the last join: a text moves once
    rows = held.select("doc_id", "th", full.alias("text"))
    lines = keep(_distinct_lines(rows))
    near = near_lines(lines, rows).select("pos", F.lit(True).alias("near"))
    guilty = lines.select("key", "pos", "copies").join(near, "pos", "left").filter("copies > 1 OR near").select("key", F.col("pos").alias("first"), "near")
    spots = _lines(rows).select("doc_id", "th", "line_no", _line_key())
    dropped = spots.join(guilty, "key").filter(F.col("near").isNotNull() | (F.struct("doc_id", "th", "line_no") > F.col("first")))
    by_row = dropped.groupBy(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th")).agg(F.sort_array(F.collect_set("line_no")).alias("nos"))  # of one document
    joined = held.join(by_row, held["doc_id"].eqNullSafe(by_row["d_id"]) & (held["th"] == by_row["d_th"]), "left").select(
        "row", F.split(full, "\n").alias("lines"), "nos")
    # The stretches between dropped lines.
    stay = F.expr("""flatten(transform(sequence(0, size(nos)), k -> slice(lines,
     if(k = 0, 1, nos[k - 1] + 2), if(k = size(nos), size(lines), nos[k]) - if(k = 0, 0, nos[k - 1] + 1))))""")
    text = F.when(F.col("nos").isNull(), F.col("row")[text_col]).otherwise(F.array_join(stay, "\n"))
    others = [F.col("row")[c].alias(c) if c != text_col else text.alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *others, F.when(F.col("row")[text_col].isNull(), F.lit(0)).otherwise(F.size("lines")).alias("n_lines"), F.coalesce(F.size("nos"), F.lit(0)).alias("n_dropped"))
