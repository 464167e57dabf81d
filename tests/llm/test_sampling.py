"""Vector codes, source mixing and importance resampling against plain loops."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from corelode.llm import importance as R
from corelode.llm import mixing as M
from corelode.llm import vector_codes as V
from corelode.llm.common import stretches

ODD_ROWS = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, " word  ÉTÉ zürich x_y 3.14"), (5, "a b c d"), (5, "a b c d"), (None, "no id here at all"), (7, "w " * 30_000 + "x" * 200_000)]


# vector codes

VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, code string, r int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "own v", "own id", "own code", 1) for i, v, label in rows], VECTORS)


def plain_codes(rows, rounds=2):
    """The contract as a plain loop: (id, code, error) per kept row, and the entries."""
    kept = [(i, [math.floor(256 * x) for x in np.array(v, dtype=np.float32).astype(float).tolist()], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted({i: v for i, v, _ in kept if i is not None}.items())[:64]
    books = [[part(v, p) for _, v in seeds] for p in range(16)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), at) for at, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(books[p], part(v, p))[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(books[p], part(v, p)) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("spread", [3, 40, 1 << 20])
@pytest.mark.parametrize("entries", [1, 2, 63, 64])
def test_bitmask_search_finds_the_nearest_entry(spread, entries):
    draw = np.random.default_rng(spread + entries)
    book = draw.integers(-spread, spread, (entries, 4))
    points = np.vstack([draw.integers(-2 * spread, 2 * spread, (500, 4)), book, book])
    search = V.NearestEntry(book)
    entry, distance = search.find(points)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist()  # ties: the first
    assert distance.tolist() == every.min(axis=1).tolist()
    if entries == 64 and spread > 3:
        counts = [bin(m).count("1") for m in search.candidates(points).tolist()]
        assert sum(counts) < 0.6 * 64 * len(points)  # the masks leave most entries out


def test_codes_are_those_of_a_plain_loop(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), draw.normal(0, 0.2, 32).round(2).tolist(), int(i) % 3) for i in draw.permutation(150)]
    rows += rows[:4] + [(900, rows[3][1], None), (901, rows[9][1], None), (None, rows[5][1], 1)]
    bad = [(1000, None, 1), (1001, [None] + [0.0] * 31, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 2), (-5, [float("-inf")] * 32, 2)]
    want, digest = plain_codes(rows)
    got = V.compress(vectors_of(spark, rows + bad)).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}
    label = {}
    for _, _, error, kind in want:
        label[kind] = label.get(kind, 0) + error
    assert sorted((r.error, r.label_error) for r in got) == sorted((e, label[k]) for _, _, e, k in want)
    again = V.compress(vectors_of(spark, rows + bad).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_vectors_of_other_lengths_empty_ones_and_few(spark):
    assert V.compress(vectors_of(spark, [])).collect() == []
    assert V.compress(vectors_of(spark, [(1, None, 1)])).collect() == []
    [alone] = V.compress(vectors_of(spark, [(1, [0.5] * 16, 1)])).collect()
    assert (alone.code, alone.error, alone.label_error) == ("00" * 16, 0, 0)
    lengths = V.compress(vectors_of(spark, [(1, [], 1), (2, [0.25] * 20, 1), (3, [1e30] * 32, None)])).collect()
    assert sorted(r.vec_id for r in lengths) == [1, 2, 3]
    unnamed = V.compress(vectors_of(spark, [(None, [0.5] * 16, 1)])).collect()
    assert (unnamed[0].code, unnamed[0].error, unnamed[0].label_error) == (None, None, None)


def test_decoding_gives_the_entries_back(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(0, 0.3, 32).tolist(), 0) for i in range(120)]
    table = vectors_of(spark, rows)
    books = V.train(table)
    back = {r.vec_id: r for r in V.decode(V.encode(table, books), books).collect()}
    for i, v, _ in rows:
        whole = np.floor(np.array(v, dtype=np.float32).astype(float) * 256)
        assert ((whole - np.floor(np.array(back[i].restored) * 256)) ** 2).sum() == back[i].error


# mixing

def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(sizes.values())
    while free:
        share = rest / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in full}
        rest, free = rest - sum(3 * sizes[s] for s in full), free - full
    return target


def mix_rows(spark, rows):
    return spark.createDataFrame([(i, s, t, "own", 1, 2.0) for i, s, t in rows], "doc_id long, source string, text string, cell string, n int, rate double")


def mixed_sources(seed):
    draw = np.random.default_rng(seed)
    rows = [(len(names), "big" if k % 3 else f"s{k % 7}", prose(k, int(n))) for names in [[]] for k, n in enumerate(draw.pareto(1.2, 900) * 40 + 1)]
    rows = [(k, s, t) for k, (_, s, t) in enumerate(rows)]
    return rows + [(None, None, "no id or source " * 9), (5, None, "x y"), (6, "", "one two"), (6, "", "one two"), (7, "é", None), (8, "\U0001f600", ""), (9, "tiny", "a")]


def test_words_are_counted_like_the_pattern(spark):
    texts = [t for _, t in ODD_ROWS]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_meets_its_targets_with_whole_copies(spark):
    rows = mixed_sources(3)
    got = M.mix(mix_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken, largest = plain_targets(sizes), {}, {}
    by_size = {v: k for k, v in sizes.items() if v}
    for r in got:
        source = by_size.get(r.source_size)
        if r.source_size:
            assert r.target == pytest.approx(want[source], rel=1e-12)
            taken[source] = taken.get(source, 0) + r.taken
            largest[source] = max(largest.get(source, 0), r.size)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s, words in taken.items():
        assert abs(words - want[s]) <= largest[s] / 2 + 1, s
    assert abs(taken["big"] - want["big"]) < 1e-3 * want["big"]
    again = M.mix(mix_rows(spark, rows[::-1]).repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("want", [0.2, 0.9, 1.0, 1.7, 2.9, 3.0])
def test_rates_are_the_dual_solution(spark, want):
    draw = np.random.default_rng(11)
    sizes = {int(n): int(c) for n, c in zip(draw.integers(1, 5000, 300), draw.integers(1, 9, 300))}
    total = sum(n * c for n, c in sizes.items())
    table = spark.createDataFrame([("s", n, c) for n, c in sizes.items()], "source string, size long, n long")
    targets = spark.createDataFrame([("s", total, want * total)], "source string, source_size long, target double")
    found = M.balance(table, targets).first()
    size, count = np.array(list(sizes)), np.array(list(sizes.values()))
    rate = lambda m: np.minimum(3.0, np.exp(np.minimum(m * size / size.max(), 2.0)))
    low, high = -1e5, 1e5
    for _ in range(200):
        low, high = ((low + high) / 2, high) if (size * count * rate((low + high) / 2)).sum() < want * total else (low, (low + high) / 2)
    assert (size * count * rate(found.multiplier)).sum() == pytest.approx(want * total, rel=1e-6)
    assert np.allclose(rate(found.multiplier), rate(high), atol=1e-4)


def test_mixing_of_nothing_and_of_hot_copies(spark):
    assert M.mix(mix_rows(spark, [])).collect() == []
    assert [(r.size, r.source_size, r.target, r.taken) for r in M.mix(mix_rows(spark, [(1, "a", None)])).collect()] == [(0, 0, 0.0, 0)]
    copies = [(1, "a", "one two three four")] * 3000 + [(i, "b", prose(i, 12)) for i in range(300)]
    got = M.mix(mix_rows(spark, copies)).collect()
    sums = {}
    for r in got:
        sums[r.source_size] = sums.get(r.source_size, 0) + r.taken
    assert abs(sums[12_000] - 15_600 / 3) <= 4 and abs(sums[3_600] - 10_400) <= 12


# importance resampling

def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_resample(rows, target, percent=10, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in rows:
        for w in plain_words(text):
            s[bucket(w)] += 1
    for text in target:
        for w in plain_words(text):
            t[bucket(w)] += 1
    out = []
    for i, text in rows:
        words = plain_words(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in map(bucket, words))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    rest = list(out)
    for r in drawn:
        rest.remove(r)
    return sorted([(*r, at + 1) for at, r in enumerate(drawn)] + [(*r, None) for r in rest], key=str)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1, 2) for i, t in rows], "doc_id long, text string, row string, part int, score int")


@pytest.mark.parametrize("texts", [[b"ab, \xc3\xa9t\xc3\xa9 9"], [b"", b"x" * 31, b"y" * 32 + b" " + b"z" * 33, b"w" * 5000 + b"-a"], [b"--"], [b"a b", b"", b"c"]])
def test_bytewise_crcs_are_those_of_each_word(texts):
    got = [(o, b) for owners, buckets in R.buckets_of(texts) for o, b in zip(owners.tolist(), buckets.tolist())]
    assert got == [(i, zlib.crc32(w.encode()) % 10_000) for i, t in enumerate(texts) for w in plain_words(t.decode())]


def test_long_texts_are_cut_between_words():
    text = (prose(1, 300_000) + "," + "v" * 1_500_000 + " end").encode()
    parts = list(stretches(text, R._GAP))
    assert b"".join(parts) == text and len(parts) > 2
    assert sum(len(b) for _, b in R.buckets_of([text])) == len(plain_words(text.decode()))


def test_greatest_cut_is_the_nth_value(spark):
    draw = np.random.default_rng(2)
    for values in (draw.integers(-(10**12), 10**12, 400).tolist(), draw.integers(0, 5, 400).tolist(), [7] * 30):
        table = spark.createDataFrame([(v,) for v in values], "v long").repartition(3).persist()
        for wanted in (1, 2, len(values) // 3, len(values)):
            assert R.greatest_cut(table, F.col("v"), wanted) == sorted(values)[-wanted]
        assert R.greatest_cut(table, F.col("v"), len(values) + 1) is None and R.greatest_cut(table, F.col("v"), 0) is None


def test_resampling_is_that_of_a_plain_loop(spark):
    rows = [(i, prose(i, 5 + i % 60, 400)) for i in range(300)] + ODD_ROWS
    rows += [(77, prose(1000, 40, 400))] * 12 + [(None, prose(2000, 30, 400))] * 9 + [(299, prose(k, 25, 400)) for k in range(5)]
    target = [prose(k, 50, 60) for k in range(6)] + [None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, least in ((10, 20), (50, 1), (100, 0), (1, 200)):
        got = R.resample(docs_of(spark, rows), items, percent=percent, least_words=least).collect()
        assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, percent, least)


def test_ties_of_one_score_go_to_the_smaller_ids(spark):
    rows = [(i, prose(4, 30)) for i in range(40)]
    items = spark.createDataFrame([(1, "nothing alike")], "item_id long, text string")
    text = prose(4, 30)
    level = R.gumbel
    R.gumbel = lambda doc_id, seed=0: F.lit(5).cast("long")
    try:
        got = R.resample(docs_of(spark, [(i, text) for i, _ in rows][::-1] + [(None, text)] * 5), items, percent=50).collect()
    finally:
        R.gumbel = level
    assert sorted((r.rank, r.doc_id) for r in got if r.rank) == [(i + 1, i) for i in range(22)]


def test_resampling_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(docs_of(spark, []), items).collect() == []
    rows = [(i, prose(i, 30)) for i in range(20)]
    assert sorted(map(tuple, R.resample(docs_of(spark, rows), items).collect()), key=str) == plain_resample(rows, [])
