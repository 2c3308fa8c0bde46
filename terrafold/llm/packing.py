"""Best-fit packing of tokenised documents, planned over the histogram of piece lengths.

The plan is made from at most ``capacity`` counts, whatever the corpus size; documents then take their
planned slots by a join on their rank within their length."""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Texts of these bytes only (in Latin-1) are split at white space here; they need no normalisation. Others go to the tokenizer whole.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")


class WordTokenizer:
    """Ids of a text by the word-level BPE file, as little-endian 32-bit bytes.

    The file's model sees one word at a time and no word spans white space, so the ids of words and of
    white-space separated runs are kept and looked up again; at most ``keep`` of them are kept."""

    def __init__(self, path: str, keep: int = 500_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.model = self.whole.model
        # the model's spelling of bytes beyond ASCII
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spell = {b: byte_level.pre_tokenize_str(chr(b))[0][0] for b in range(0xA1, 0x100)}
        self.spelled = {}
        for c, two in spell.items():
            for byte, char in zip(chr(c).encode(), two, strict=True):
                self.spelled[byte] = char

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.spelled)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        known, split, odd = self.known, [], []
        for k, text in enumerate(texts):
            try:
                plain = not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
            except UnicodeEncodeError:
                plain = False
            split.append(text.lower().split() if plain else [])
            if not plain:
                odd.append(k)
        new = set(chain.from_iterable(split)).difference(known)
        full = len(known) >= self.keep
        added = []
        for run in new:
            parts = (run,) if run.isalpha() else _WORDS.findall(run)
            for w in parts:
                if w not in known:
                    known[w] = self._word(w)
                    added.append(w)
            if len(parts) > 1:
                known[run] = b"".join([known[w] for w in parts])
                added.append(run)
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for k, e in zip(odd, self.whole.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False) if odd else [], strict=True):
            out[k] = np.asarray(e.ids, dtype="<u4").tobytes()
        if full:
            for w in added:
                del known[w]
        return out


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept from task to task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: (doc_id, piece, start, length, ids_crc32[, ids binary])."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            texts = [t or "" for t in batch["text"]]
            groups = (tok(texts[k : k + 256]) for k in range(0, len(texts), 256))  # a group's words are in memory one by one
            for doc, ids in zip(batch["doc_id"], chain.from_iterable(groups), strict=True):
                ids += end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: rows (length, first rank, how many, first sequence, offset).

    Pieces of ``length`` with ranks from ``first rank`` on take consecutive sequences from ``first
    sequence`` on, at ``offset``. Bins with the same room are held as runs of consecutive sequences."""
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, how many)]
    rooms: list[int] = []  # sorted
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            fit = room // length  # a bin just used has the least room that still fits, so it is used again
            full, rest = min(n, left // fit), 0
            if full < n:
                rest = left - full * fit
            for j in range(fit):
                used = full + (1 if j < rest else 0)
                if used:
                    rows.append((length, rank, used, first, capacity - room + j * length))
                    rank += used
            left -= full * fit + rest
            put(room - fit * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + (1 if rest else 0), n - full - (1 if rest else 0))
    return rows


def pack(parts: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset.

    ``parts`` must be cheap to read twice (a written table). Ranks within a length are counted in
    ``buckets`` hash buckets, so a length that holds a third of all pieces isn't ranked in one task;
    the table of bucket counts has at most capacity x buckets rows. Repeated rows each take a slot; an
    empty input gives an empty result."""
    spark = parts.sparkSession
    n = buckets or max(16, min(128, partitions(spark)))
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    counted = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counted.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = spark.createDataFrame(
        plan(lengths, capacity), "length long, first_rank long, n_ranks long, first_sequence long, offset long"
    )
    mine = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(mine) - 1).join(F.broadcast(before), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")
    # the plan's rows of a length, as one sorted array: at most a few thousand rows in all
    arrays = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "n_ranks", "first_sequence", "offset"))).alias("slots"))
    slot = F.expr("filter(slots, s -> rank >= s.first_rank and rank < s.first_rank + s.n_ranks)[0]")
    out = ranked.join(F.broadcast(arrays), "length").withColumn("slot", slot)
    out = out.withColumn("sequence_id", F.expr("slot.first_sequence + rank - slot.first_rank")).withColumn("offset", F.col("slot.offset"))
    return out.drop("slot", "slots", "rank")


def best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) packed into sequences of at most ``capacity`` tokens; one row a piece.

    A null text is empty (one piece: the end token). A null doc_id is a document like any other. Repeated
    rows are packed each. Columns besides doc_id and text are ignored."""
    parts = written(pieces(docs, tokenizer_path, capacity, with_ids=with_ids), "pieces")
    columns = [c for c in parts.columns]
    return pack(parts, capacity).select(*columns, "sequence_id", "offset")
