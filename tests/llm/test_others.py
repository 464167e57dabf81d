"""Packing, sharding, decontamination, url rules, preferences and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corelode.llm import decontaminate as D
from corelode.llm import packing as P
from corelode.llm.preferences import format_preferences, stale_answers
from corelode.llm.queries import URL_RULES
from corelode.llm.sharding import lookup_table, with_shard, write_shards
from corelode.llm.url_filter import judge_urls

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = P.WordTokens(PATH)
ODD = ["", " ", "Élan vital, isn't it's 12 345", "<|endoftext|> and <|ENDOFTEXT|>x", "e\u0301 E\u0301 \u0130I\u0307", "a\u00a0b\u2028c\x0bd\x1ce\x85f", "ΣΑΣ σας", "日本語 text", "!!..,, a.b,c", "\u0301start", "\U0001f600 ok"]


@given(st.one_of(st.sampled_from(ODD), st.text(max_size=60), st.text(alphabet="abÀé'σΣ.,<|> \n\t1\u0301", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_word_ids_are_the_tokenizers_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert next(WORDS.ids([text.encode()])).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_words_are_learned_again_after_forgetting():
    tokens = P.WordTokens(PATH)
    first = [x.tolist() for x in tokens.ids([b"one two three", b"two one"])]
    tokens.forget()
    assert [x.tolist() for x in tokens.ids([b"one two three", b"two one"])] == first


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_fullest_is_the_best_subset_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    used = P.fullest(counts, room)
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in used.items())


def test_windows_use_every_piece_once():
    draw = np.random.default_rng(3)
    counts = Counter(draw.integers(1, 4097, 5000).tolist())
    made = P.windows(dict(counts))
    total = Counter()
    for copies, used in made:
        assert sum(k * n for k, n in used.items()) <= P.CAPACITY
        for k, n in used.items():
            total[k] += copies * n
    assert total == counts
    sequences = sum(c for c, _ in made)
    assert sequences <= 1.01 * sum(k * n for k, n in counts.items()) / P.CAPACITY + 1


def test_packing_round_trip(make_docs):
    rows = [(i, prose(i, 5 * i)) for i in range(60)] + [(70, None), (71, ""), (72, prose(9, 9000)), (73, "same"), (74, "same"), (74, "same"), (None, "no id"), (75, ODD[3])]
    got = P.pack(make_docs(rows), PATH, with_ids=True).collect()
    texts = Counter((i, tuple(WHOLE.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    back = Counter()
    for i, rs in pieces.items():
        if len(rs) > 1 and rs[0].doc_tokens > P.CAPACITY:
            rs = sorted(rs, key=lambda r: r.start)
            back[i, tuple(x for r in rs for x in r.ids)] += 1
        else:
            for r in rs:
                back[i, tuple(r.ids)] += 1
    assert back == texts
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY and {r.sequence_tokens for r in rs} == {at} and {r.padded_to for r in rs} == {at if at & (at - 1) == 0 else P.CAPACITY}
    assert P.pack(make_docs(rows).limit(0), PATH).count() == 0


def test_lookup_table_is_even_and_stable():
    table = lookup_table(10, 1009)
    assert set(Counter(table).values()) <= {100, 101}
    more = lookup_table(11, 1009)
    assert sum(a != b and b != 10 for a, b in zip(table, more)) < 0.2 * 1009
    for bad in ((0, 7), (8, 7), (2, 8)):
        with pytest.raises(ValueError):
            lookup_table(*bad)


def test_placement(spark, make_docs, tmp_path):
    docs = make_docs([(i, "x") for i in range(500)] + [(1, "x"), (None, "a"), (None, "b"), (None, None)])
    placed = with_shard(docs, 4, 101)
    assert sorted(placed.columns) == sorted(docs.columns) and placed.count() == 504
    table = lookup_table(4, 101)
    assert all(table[r["slot"]] == r["shard"] for r in placed.select("slot", "shard").collect())
    assert with_shard(docs.limit(0)).count() == 0
    write_shards(docs, str(tmp_path / "out"), 2, shards=4, slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_contained_items_match_brute_force(spark, make_docs):
    items = [(i, prose(1000 + i, n)) for i, n in enumerate([3, 5, 8, 20, 40, 90, 300])] + [(50, ""), (51, None), (None, prose(77, 30)), (3, prose(1003, 20))]
    docs = [(i, prose(i, 50)) for i in range(20)]
    for k, (_, t) in enumerate(items):
        docs += [(100 + k, prose(k, 2000) + " " + (t or "").upper() + " " + prose(k + 50, 500)), (200 + k, prose(k, 30) + "\n" + edited(t or "", k, 0.03)), (300 + k, t)]
    docs += [(None, items[4][1]), (400, items[4][1]), (400, items[4][1])]
    item_df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    frame = make_docs(docs)
    got = sorted(((r.doc_id, r.item_id, r.shared_shingles) for r in D.contained_items(frame, item_df).collect()), key=str)
    want = []
    for i, t in docs:
        own = D.word_shingles((t or "").encode())
        for j, u in set(items):
            other = D.word_shingles((u or "").encode())
            if other and 100 * len(own & other) >= 75 * len(other):
                want.append((i, j, len(own & other)))
    assert got == sorted(want, key=str)
    left = D.decontaminate(frame, item_df)
    bad = {i for i, *_ in want}
    assert left.columns == frame.columns and Counter(r.doc_id for r in left.collect()) == Counter(i for i, _ in docs if i not in bad)
    assert D.contained_items(frame, item_df.limit(0)).count() == 0 and D.contained_items(frame.limit(0), item_df).count() == 0


def test_blocks_of_items_give_the_same_pairs(spark, make_docs, monkeypatch):
    items = spark.createDataFrame([(i, prose(i, 30)) for i in range(12)], "item_id long, text string")
    docs = make_docs([(i, prose(i, 30) + " " + prose(i + 1, 30)) for i in range(10)])
    one = sorted(map(tuple, D.contained_items(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, D.contained_items(docs, items).collect())) == one and len(one) == 20


def test_url_rules_and_propagation(spark):
    def page(i, url, *links):
        return (i, url, "".join(f'<A HREF="{u}">x</a>' for u in links) or None)

    pages = [
        page(1, "https://WWW.Example.com/en/a?x#y"), page(2, "http://m.example.com/en/"), page(3, "http://a.com"), page(4, "http://a.com?/x"), page(5, None),
        page(6, "no scheme"), page(7, "x://h.net/fr/?q"), page(8, "http://good.com/x", "https://friend.org/a", "//cdn.org"), page(9, "http://friend.org/p"),
        page(10, "http://linker.org/", "http://h.net/es/1"), page(10, "http://linker.org/", "http://h.net/es/1"), page(None, "http://cdn.org/z"), page(11, "http://notexample.com/en/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")})
    rows = judge_urls(df, URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("m.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("a.com", "", None, "allow") and got[4] == ("a.com", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("h.net", "/fr/", "net/fr/", "block")
    assert got[9][2:] == (None, "allow") and got[10][2:] == (None, "block") and got[None][2:] == (None, "allow")
    assert got[11] == ("notexample.com", "/en/", "com/", "allow")
    scores = {r.page_id: (r.trust, r.distrust) for r in rows}
    assert scores[9][0] > scores[9][1] == 0 and scores[10][1] > scores[10][0] == 0
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


def test_distrust_travels_along_a_long_chain(spark):
    pages = [(i, f"http://host{i}.org/", f"<a href='http://host{i - 1}.org/'>x</a>" if i else "<a href='http://bad.net/es/'>x</a>") for i in range(25)]
    df = spark.createDataFrame([*pages, (99, "http://bad.net/es/", None), (100, "http://apart.org/", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.distrust) for r in judge_urls(df, URL_RULES).collect()}
    assert all(got[i][0] == "block" and got[i][1] > 0 for i in range(25)) and got[100] == ("allow", 0)
    strict = {r.page_id: r.verdict for r in judge_urls(df, URL_RULES, margin=-1.0).collect()}
    assert strict[100] == "allow" and strict[3] == "block"


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string"
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "fin"), (2, 0, "user", "q"), (3, 0, "user", "x"), (None, 0, "user", "lost"), (1, 0, "user", "hi")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", ""), (1, 3, "assistant", "no!"), (2, 0, "user", "q"), (2, 1, None, "r"), (4, 0, "user", "x")]
    chosen, rejected = (spark.createDataFrame(x, schema).withColumn("prompt", F.lit("clash")) for x in (a, b))
    got = {r.pair_id: r for r in format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2}
    assert got[1].prompt_turns == 3 and got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nfin<|end|>\n" and got[1].rejected == "<|assistant|>\nno!<|end|>\n"
    assert [got[1].chosen[s.begin : s.end] for s in got[1].chosen_spans] == ["fin<|end|>\n"]
    assert got[2].chosen == "" and got[2].chosen_spans == [] and got[2].rejected == "<|unknown|>\nr<|end|>\n" and got[2].rejected_spans == []
    assert format_preferences(chosen.limit(0), rejected).count() == 0
    turns = chosen.withColumnRenamed("pair_id", "conv_id")
    stale = {(r.conv_id, r.turn): r.text for r in stale_answers(turns).collect()}
    assert stale == {(1, 0): "hi", (1, 1): "yes", (1, 2): None, (1, 3): "yes"}


def test_pipeline_stages(spark, folder):
    """Each stage keeps what it must, on the output of the one before."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], folder).persist()
        if name != "packing":
            assert out.columns == columns and out.schema == docs.schema
        seen.append(out)
    count = [x.count() for x in seen[:5]]
    assert count[1] < count[0] and count[2] == count[1] and count[3] <= count[2] and count[4] < count[3]
    assert seen[2].filter(F.col("n_chars") != F.length("text")).count() == 0
    kept = {r.doc_id for r in seen[4].collect()}
    assert {r.doc_id for r in seen[5].collect()} == kept
    assert D.contained_items(seen[4], spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
    again = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {(r.doc_id, r.start, r.ids_crc32) for r in seen[5].collect()}
    for x in seen:
        x.unpersist()
