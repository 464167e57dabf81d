"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corelode.llm.common import _SPACE, LOWER, id_and_text, texts_of
from corelode.session import keep

CAPACITY = 4096
END_OF_DOCUMENT = 2
# Words whose ids a Python worker remembers.
REMEMBERED = 600_000
# Pieces of one length that one task ranks.
RANKED = 2_000
SPECIAL = b"<|"
# Words of two pieces at most: small letters of Latin-1 (composed as they are), then ASCII punctuation. A lone apostrophe starts no contraction here.
_PLAIN = re.compile(r"([a-z\u00DF-\u00F6\u00F8-\u00FF]+)?([!-/:-@\[-`{-~]*)").fullmatch
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(string.punctuation.encode())] = True


class WordTokens:
    """Ids of whole texts from remembered ids of their words.

    The tokenizer drops white space, lower-cases, and splits words without
    looking across white space, so a text's ids are those of its words in turn.
    It also parts a letter from the punctuation behind it, so a word that ends
    in punctuation counts as two (:func:`_parted`) and its letters are learned once.
    Texts that may hold a special token's string are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {chr(code): level.pre_tokenize_str(chr(code))[0][0] for code in range(0x21, 0x100) if not chr(code).isspace()}
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.stops = np.zeros(1, dtype=np.int64)  # word i has flat[stops[i] : stops[i + 1]]
        self.flat = np.empty(0, dtype=np.uint32)

    def _learn(self, words: set[bytes]) -> None:
        """Words whose pieces are plain to see go straight to the merges, the others through the tokenizer."""
        merge, shown = self.tokenizer.model.tokenize, self.shown
        plain, learned, other, flat, lengths = [w for w in words if w.isalpha()], [], [], [], []  # ASCII letters: one piece
        for text in b" ".join(plain).decode().split():
            ids = [t.id for t in merge(text)]
            lengths.append(len(ids))
            flat += ids
        for w in words - set(plain):
            pieces = _PLAIN(w.decode())
            if pieces is None:
                other.append(w)
                continue
            ids = [t.id for piece in pieces.groups() if piece for t in merge("".join([shown[c] for c in piece]))]
            learned.append(w)
            lengths.append(len(ids))
            flat += ids
        for e in self.tokenizer.encode_batch([w.decode() for w in other], add_special_tokens=False):
            lengths.append(len(e.ids))
            flat += e.ids
        first = len(self.index)
        self.index.update(zip([*plain, *learned, *other], range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.uint32)])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(np.array(lengths, dtype=np.int64))])

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text. All texts' words are looked up together, each different one once."""
        if len(self.index) > REMEMBERED:
            self.forget()
        joined, bounds = _parted(b" ".join([*(b"" if SPECIAL in t else t.translate(LOWER) for t in texts), b""]), [0 if SPECIAL in t else len(t) for t in texts])
        inside = ~_SPACE[joined]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        wide = offsets[-1] >= 1 << 31
        kind, offset = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
        words = pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(offsets.astype(offset)), pa.py_buffer(joined[inside])]).dictionary_encode()
        different = pc.binary_join(pa.scalar(words.dictionary, type=pa.list_(kind)), pa.scalar(b" ", type=kind)).as_py().split()  # no word holds white space
        new = {w for w in different if w not in self.index}
        if new:
            self._learn(new)
        known = np.fromiter(map(self.index.__getitem__, different), dtype=np.int64, count=len(different))
        at = known[np.asarray(words.indices)] if len(known) else known
        start, lengths = self.stops[at], self.stops[at + 1] - self.stops[at]
        ends = np.cumsum(lengths)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + lengths, lengths)]
        cuts = np.concatenate([[0], ends])[np.searchsorted(begin, bounds)]
        for i, text in enumerate(texts):
            if SPECIAL in text:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield flat[cuts[i] : cuts[i + 1]]


def _parted(joined: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): lower-cased texts, each followed by a space, with another space
    where ASCII punctuation lies between an ASCII letter and white space; the bounds of the texts."""
    data = np.frombuffer(joined, dtype=np.uint8)
    edge = np.diff(_PUNCTUATION[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is a space, if there is one
    before = data[np.maximum(begin, 1) - 1]
    at = begin[(begin > 0) & (before >= 97) & (before <= 122) & _SPACE[data[end]]] if len(begin) else begin
    bounds = np.cumsum([0, *(n + 1 for n in sizes)])
    return np.insert(data, at, 32), bounds + np.searchsorted(at, bounds)


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _pieces_in(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            for first, texts in texts_of(batch.column("text")):
                row, start, crc, total, kept = [], [], [], [], []
                for i, ids in enumerate(tokens.ids(texts)):
                    whole = np.append(ids, np.uint32(END_OF_DOCUMENT)).astype("<u4")
                    for s in range(0, len(whole), CAPACITY):
                        piece = whole[s : s + CAPACITY]
                        row.append(first + i)
                        start.append(s)
                        total.append(len(whole))
                        crc.append(zlib.crc32(piece.tobytes()))
                        kept.append(piece.astype(np.int64) if with_ids else None)
                lengths = np.minimum(np.array(total, dtype=np.int64) - np.array(start, dtype=np.int64), CAPACITY)
                columns = [batch.column("doc_id").take(pa.array(row, type=pa.int64())), *(pa.array(x, type=pa.int64()) for x in (start, lengths, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(kept, type=pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` closest: subset sums as bits of one number, then backtracking."""
    reach, steps = 1, []
    goal, mask = 1 << room, (2 << room) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left and not reach & goal:  # 1, 2, 4, ... copies make any number of them
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & mask
            left, many = left - many, many * 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + many
            total -= length * many
    return used


def windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(copies, lengths in one window) for all pieces: the longest piece left, and what fills its slack best.

    Works on how many pieces have each length, so its size depends on the
    capacity alone. A window is repeated as often as the pieces allow.
    """
    left, made = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        copies = min(left[k] // n for k, n in used.items())
        made.append((copies, used))
        for k, n in used.items():
            left[k] -= copies * n
            if not left[k]:
                del left[k]
    return made


def placements(made: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each length, which ranks go to which windows and where in them."""
    rows, ranked, sequence = [], {}, 0
    for copies, used in made:
        offset, filled = 0, sum(k * n for k, n in used.items())
        for length, n in sorted(used.items(), reverse=True):
            low = ranked.get(length, 0)
            ranked[length] = low + copies * n
            rows.append((length, low, low + copies * n, n, offset, sequence, filled))
            offset += length * n
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "low", "high", "n", "at", "sequence", "sequence_tokens"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All tokens of ``docs`` in sequences of at most 4096: one row per piece.

    1. Documents become ids and the end id; pieces of 4096 fill a sequence of
       their own, so only the last piece of a document is left to fit.
    2. The number of pieces of each length, at most 4096 numbers, is all the
       plan needs: :func:`windows` chooses the multiset for each window by a
       subset-sum over bits, and repeats it while pieces last.
    3. Pieces are ranked within their length, in salted groups of bounded size,
       and a rank tells window and place. The plan has a bounded number of rows.

    A sequence is padded to 4096 (``padded_to``) unless its tokens are a power
    of two. Null and empty texts have the end id alone. Each row is packed once,
    equal or without id too; empty tables give no rows; other columns are not
    carried. ``with_ids`` adds the ids of each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, padded_to.
    """
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = keep(rows.mapInArrow(_pieces_in(tokenizer_path, with_ids), schema))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # 4096 rows at most
    salts = -(-max(counts.values(), default=1) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    before = sizes.select("length", "salt", (F.sum("size").over(Window.partitionBy("length").orderBy("salt")) - F.col("size")).alias("before"))
    ranked = salted.withColumn("place", F.row_number().over(group) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("before"))
    plan = placements(windows(counts))
    if plan.empty:
        plan = pd.DataFrame([(0,) * len(plan.columns)], columns=plan.columns)
    rules = F.broadcast(spark.createDataFrame(plan.astype("int64")))  # bounded by the capacity
    placed = ranked.join(rules, (ranked["length"] == rules["length"]) & (ranked["rank"] >= rules["low"]) & (ranked["rank"] < rules["high"])).drop(rules["length"])
    within = F.col("rank") - F.col("low")
    power = F.expr("sequence_tokens & (sequence_tokens - 1)") == 0
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(within / F.col("n"))).cast("long").alias("sequence_id"),
        (F.col("at") + within % F.col("n") * F.col("length")).cast("long").alias("offset"),
        "sequence_tokens", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(CAPACITY)).cast("long").alias("padded_to"),
        *(["ids"] if with_ids else []))
