"""Exact, near and line deduplication against brute force, with odd rows."""

import itertools
import random
import re
from collections import defaultdict

from helpers import edited, prose
from pyspark.sql import functions as F

from corelode.llm import line_dedup, near_dedup
from corelode.llm.components import components
from corelode.llm.exact_dedup import exact_dedup, exact_groups
from corelode.llm.line_dedup import dedup_lines
from corelode.llm.near_dedup import near_duplicates

LONG = " ".join(["long"] * 30_000 + ["end"])


def test_exact_groups_compare_bytes(make_docs):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, LONG), (7, LONG), (7, LONG), (None, "a"), (None, "only"), (None, "only")]
    for keep, best in (("largest", max), ("smallest", min)):
        weak = exact_groups(make_docs(rows), keep=keep, content_hash=lambda t: F.substring(F.md5(t), 1, 0))  # all collide
        strong = exact_groups(make_docs(rows), keep=keep)
        want = defaultdict(list)
        for i, t in rows:
            want[t or ""].append(i)
        expected = []
        for i, t in rows:
            ids = [x for x in want[t or ""] if x is not None]
            winner = best(ids) if ids else None
            expected.append((i, winner, len(want[t or ""]), winner is None or i == winner))
        for got in (weak, strong):
            assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_exact_dedup_keeps_columns_and_empty_tables(make_docs):
    docs = make_docs([(1, "a"), (2, "a"), (3, None), (4, "")])
    left = exact_dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert exact_groups(docs.limit(0)).count() == 0


def _sets(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _components(rows):
    sets = [(i, _sets(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_match_brute_force(make_docs):
    base, other = prose(1, 300), prose(2, 40)
    rows = [(100 + k, edited(base, k, k / 400)) for k in range(45)] + [(300 + k, edited(other, k, k / 300)) for k in range(25)]
    rows += [(500 + k, prose(50 + k, 200) + " " + base[:400]) for k in range(12)]  # a quoted passage
    rows += [(k, prose(90 + k, k % 9)) for k in range(600, 660)]  # tiny and empty texts
    rows += [(1, "Same Words here"), (2, "same\twords HERE"), (3, ""), (4, None), (5, LONG), (6, LONG + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == _components(rows)


def test_near_duplicates_go_on_past_the_star(make_docs):
    """A chain, in which the two ends are not linked, is one component."""
    words = prose(7, 400).split(" ")
    rows = [(k, " ".join([f"x{i}" for i in range(25 * k)] + words[25 * k :])) for k in range(14)]
    want = _components(rows)
    assert len({c for _, c in want.values()}) == 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == want


def test_texts_that_quote_one_long_passage_meet_in_few_pairs(spark, make_docs, monkeypatch):
    """Documents whose own words keep them just apart drop out before they are paired; linked ones stay."""
    passage = prose(11, 120, 10**6)
    rows = [(k, passage + " " + prose(700 + k, 26 + k % 9, 10**6)) for k in range(60)]  # alike at 0.6 to 0.7
    rows += [(100 + k, passage + " " + prose(900 + k, k, 10**6)) for k in range(12)]  # the nearest of these are linked
    rows += [(200 + k, edited(passage, k, 0.012)) for k in range(20)]
    met = []
    real = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, sets: (met.append(pairs.count()), real(pairs, sets))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == _components(rows)
    assert sum(met[1:]) < 100 < 60 * 59 / 2


def test_copies_just_out_of_reach_meet_once_if_at_all(make_docs, monkeypatch):
    """Copies of a text that is not there itself: unlinked ones that have many edits make no pairs, and no pair is made twice."""
    words = prose(21, 400, 10**6).split(" ")

    def copy(seed, edits):
        draw, own = random.Random(seed), list(words)
        for i in draw.sample(range(0, 400, 8), edits):
            own[i] = f"e{seed}x{i}"
        return " ".join(own)

    rows = [(k, copy(k, 8 + k % 3)) for k in range(48)]
    rows += [(100 + k, rows[5 * k][1] + f" end {k}") for k in range(4)]  # linked to one each
    rows += [(200 + k, copy(300 + k, 7)) for k in range(3)]
    met, real = [], near_dedup._paired

    def counted(joined):
        pairs = real(joined)
        fits = joined.filter(near_dedup._position_fits() & (F.col("doc") != F.col("hub")))
        met.append((fits.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(near_dedup, "_paired", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    want = _components(rows)
    assert got == want and len({c for _, c in want.values()}) > 30
    assert all(joined == pairs for joined, pairs in met[1:])
    assert sum(pairs for _, pairs in met[1:]) < 200 < 48 * 47 / 2


def test_links_of_ids_with_several_texts_are_not_lost(make_docs):
    """Each of these ids has two texts of one family; only one of both is linked to another id."""
    words, draw = prose(23, 400, 10**6).split(" "), random.Random(4)

    def copy(seed, spots):
        return " ".join(f"e{seed}x{i}" if i in spots else w for i, w in enumerate(words))

    rows = []
    for k in range(12):
        spots = [set(draw.sample(range(0, 400, 8), 9)) for _ in range(2)]
        rows += [(k, copy(k, spots[0])), (k, copy(50 + k, spots[1])), (100 + k, copy(k, {*list(spots[0])[:8], *list(spots[1])[:2]}))]
    root = {i: i for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations([(i, _sets(t)) for i, t in rows], 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = {x: low if r == high else r for x, r in root.items()}
    assert len(set(root.values())) >= 6
    assert {r.doc_id: r.component_id for r in near_duplicates(make_docs(rows)).collect()} == root


def test_near_duplicates_without_ids(make_docs):
    text = prose(3, 50)
    rows = [(None, text), (9, text), (9, text), (8, text + " end"), (None, prose(4, 50)), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(None, 8, False), (9, 8, False), (9, 8, False), (8, 8, True), (None, None, True), (None, None, True)], key=str)
    assert near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_near_duplicates_cut_short_around_a_sketch(make_docs):
    """Texts about the size of a fine sketch, each against its own copy cut to 75 to 100 percent."""
    rows = []
    for n in [*range(380, 441, 6), *range(500, 561, 10)]:
        for m in sorted({-(-3 * n // 4), -(-4 * n // 5), 9 * n // 10, n - 1, n}):
            words = prose(len(rows) + 1000, n + 4, 10**6).split(" ")
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: m + 4]))]
    want = _components(rows)
    assert all(want[k + 1][1] == k for k in range(0, len(rows), 2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert {k: got[k] for k in want if got[k] != want[k]} == {}


def test_bounds_of_the_sketches():
    """A shared count below the bound is six standard deviations off at the least similarity."""
    for retained, shared in ((near_dedup.RETAINED, near_dedup.SHARED), (near_dedup.FINE_RETAINED, near_dedup.FINE_SHARED)):
        mean, spread = 0.75 * retained, (0.75 * 0.25 * retained) ** 0.5
        assert shared <= mean - 6 * spread


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(900, 901)], "u long, v long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return len(longer) == len(shorter) + 1 and any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def _lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for i, t in order:
        stay = []
        for line in (t or "").split("\n"):
            words = line.split(" ")
            gone = len(words) >= 4 and any(s == words or (len(words) >= 8 and len(s) >= 8 and _one_edit(s, words)) for s in seen)
            if len(words) >= 4:
                seen.append(words)
            if not gone:
                stay.append(line)
        out[i] = "\n".join(stay)
    return out


def test_lines_match_brute_force(make_docs):
    line, short = "the quick brown fox jumps over the lazy dog", "one two three four five"
    rows = [
        (1, f"{line}\nunique words stand here once only\nshort"), (2, line.replace("brown", "red") + "\nshort\n" + short),
        (3, line + " today"), (4, line.replace("quick ", "")), (5, short.replace("two", "2") + "\n" + short), (6, ""), (8, f"{line}\n{line}\n\n\n"),
        (9, line.replace("quick", "slow").replace("lazy", "old")), (10, "the the the the the the the the the"), (11, "the the the the the the the the"),
        (12, LONG), (13, LONG + " more"), (14, f"{line} page 1"), (15, f"{line} page 2"), (16, f"{line}  page"), (None, f"{line} without id and quite early"),
        (17, f"{line} without id and rather early")] + [(20 + k, f"template line number {k} of a very long series") for k in range(30)]
    docs = make_docs(rows)
    got = dedup_lines(docs)
    assert set(got.columns) == set(docs.columns) | {"n_dropped"}
    assert {r.doc_id: r.text for r in got.collect()} == _lines(rows)
    counted = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.collect()}
    assert counted[8] == (5, 2) and counted[6] == (1, 0)


def test_lines_of_repeated_rows_and_nulls(make_docs):
    text = "a line that is long enough to be compared\nanother line that is long enough too"
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(make_docs([(1, text), (1, text), (2, text), (3, None)])).collect()), key=str)
    assert got == [(1, text), (1, text), (2, ""), (3, None)]
    assert dedup_lines(make_docs([(1, text)]).limit(0)).count() == 0


def test_lines_near_those_of_repeated_rows(make_docs):
    """A document given twice has each of its lines once when near lines are sought, whichever of both comes first."""
    line, other = "the quick brown fox jumps over the lazy dog", "nine more words that stand on their own here"
    near = {"changed": line.replace("brown", "red"), "added": f"{line} today", "left out": line.replace("quick ", "")}
    for kind, text in near.items():
        for once, twice in ((1, 2), (2, 1)):
            rows = [(once, line), (twice, f"{text}\n{other}"), (twice, f"{text}\n{other}"), (None, f"{other} too"), (None, f"{other} too")]
            got = sorted(((r.doc_id, r.text) for r in dedup_lines(make_docs(rows)).collect()), key=str)
            stays = {once: line, twice: ""} if once < twice else {once: "", twice: text}
            assert got == sorted([(once, stays[once]), (twice, stays[twice]), (twice, stays[twice]), *rows[3:]], key=str), (kind, once)


def test_line_variants_are_keys_of_what_is_left(spark, monkeypatch):
    """However long its stretches are, each variant of a line has the key of the line that is left; short lines are not dealt out by words."""
    lines = [prose(k, n, 9) for k, n in enumerate([8, 9, 9, 40])] + ["", "same same same same same same same same"]
    parts = [t.split(" ") for t in lines]
    left = {(k, i + 1): [*w[:i], *w[i + 1 :]] for k, w in enumerate(parts) for i in range(len(w))} | {(k, 0): w for k, w in enumerate(parts)}
    rows = spark.createDataFrame([(k, len(w), w) for k, w in enumerate(parts)], "id long, n int, words array<string>").select(F.struct("id").alias("pos"), "n", "words")
    short = line_dedup._variants(rows)
    assert short.columns == ["v", "m", "i", "pos"]
    assert short._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2  # of keys, and of stretches of long lines
    by_size = []
    for size in (256, 7, 1):
        monkeypatch.setattr(line_dedup, "ROW_WORDS", size)
        made = {(r.pos.id, r.i): (r.v, r.m) for r in line_dedup._variants(rows).collect()}
        assert made.keys() == left.keys() and all(m == len(left[x]) for x, (_, m) in made.items())
        by_size.append(made)
    assert by_size[0] == by_size[1] == by_size[2]
    same = defaultdict(set)
    for x, key in by_size[0].items():
        same[key].add(tuple(left[x]))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({tuple(w) for w in left.values()})


def test_lines_on_both_sides_of_the_row_limit(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROW_WORDS", 10)
    words = prose(5, 12).split(" ")
    texts = [" ".join(words[:n]) for n in (10, 11, 12)] + [" ".join([*words[:3], "x", *words[4:n]]) for n in (9, 10, 11)]
    rows = [(k, t) for k, t in enumerate([*texts, *(edited(prose(60 + k // 3, 8 + k % 6), k, 0.1) for k in range(60))])]
    assert {r.doc_id: r.text for r in dedup_lines(make_docs(rows)).collect()} == _lines(rows)


def test_a_text_moves_once_in_each_join_of_lines(spark, make_docs):
    """Before, the last join carried the text beside the row, and the texts of hopeful lines were dealt out twice."""
    docs = make_docs([(1, "a line that is long enough to be compared"), (2, None)], clashing=False)
    plan = dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS row#" in plan and not re.search(r"AS row#.*coalesce\(", plan)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    lines, limit = line_dedup.keep(line_dedup._distinct_lines(rows)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        above, join, _ = line_dedup._with_partner(lines, rows)._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert join and "Exchange" not in above
