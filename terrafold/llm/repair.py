"""Conversation repair: the cheapest edits that make the roles alternate, by dynamic programming on a prefix trie.

A conversation is reduced to its signature, a letter a row for role and fault. Distinct signatures are dealt by
ranges and sorted, so those that begin alike follow one another; each is inserted below the prefix it shares with
the one before, and only the rows after that prefix get a layer of the programme. A terminal node tells the cost and
the edits, which go back to all conversations of that signature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, written

#: White space, and what ends a sentence.
BLANK, ENDS = " \t\n\x0b\f\r", ".!?"
#: States: nothing yet, after system, after user, after assistant; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The state that a row in the right role leads to, and the role; system may only stand first.
NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
ROLE = {"u": b"user", "a": b"assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (name, turn, role, text, copy, digest) after the damage that the checksum of ``conv_id:turn`` deals out; nulls are one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(named("conv_id").alias("name"), F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"), F.concat(own("conv_id"), F.lit(":"), own("turn")).alias("key"))
    rows = rows.withColumn("kind", F.crc32(F.encode("key", "UTF-8")) % 20).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("name", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.withColumn("digest", F.sha2(F.col("text"), 256))


#: The order of a conversation's rows (nulls first); rows of one turn go by role, then by the digest of their text.
ORDER = ("turn", "role", "digest", "copy")


def named(column: str) -> Column:
    """A conversation's name: its id as text, apart from that of rows without an id."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def with_symbols(rows: DataFrame) -> DataFrame:
    """Rows without texts, with their first ``fault`` (blank, duplicate, truncated or null), ``initial`` of the role
    (x if none of s, u, a) and ``symbol``: d must go, an upper-case initial has a cut text."""
    meaning = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    rows = rows.select("name", *ORDER, letter.alias("initial"), (meaning == "").alias("blank"), (~F.substring(meaning, -1, 1).isin(*ENDS)).alias("cut"))
    again = F.row_number().over(Window.partitionBy("name", "role", "digest").orderBy("turn", "copy")) > 1
    rows = rows.withColumn("fault", F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated"))
    symbol = F.when(F.col("fault") == "truncated", F.upper("initial")).when(F.col("fault").isNotNull(), "d").otherwise(F.col("initial"))
    return rows.withColumn("symbol", symbol).drop("blank", "cut")


# A layer holds, for each state that the rows so far can lead to, (cost, rank, end, edits): the edits are those of the
# row's own letter and end, after those of a state of the layer before. ``rank`` orders what comes before ``end``, the
# inserted rows at the end; two edits of equal rank are the same but for the end. So no text of edits is ever compared.


def _with_inserts(layer: dict) -> dict:
    """The layer after all useful insertions: at most two rows in a row."""
    for _ in range(2):
        for state, (cost, rank, end, at) in list(layer.items()):
            new = (cost + INSERT, rank, end + "I", at)
            if NEXT[state][0] not in layer or new[:3] < layer[NEXT[state][0]][:3]:
                layer[NEXT[state][0]] = new
    return layer


FIRST = _with_inserts({START: (0, 0, "", None)})


def next_layer(layer: dict, symbol: str) -> dict:
    """The layer after one more row."""
    best: dict = {}
    role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for state, (cost, rank, end, at) in layer.items():
        moves = [(state, DELETE, "D")]
        if symbol != "d":
            right = NEXT[state]
            if role == right[1]:
                moves.append((right[0], KEEP + more, "K"))
            if role == "s" and state == START:
                moves.append((SYSTEM, KEEP + more, "K"))
            moves.append((right[0], REROLE + more, "R"))
        for target, price, letter in moves:
            new = (cost + price, rank, end + letter, at)
            if target not in best or new[:3] < best[target][:3]:
                best[target] = new
    places = sorted({v[1:3] for v in best.values()})
    return _with_inserts({s: (cost, places.index((rank, end)), "", (at, end)) for s, (cost, rank, end, at) in best.items()})


def answer(layer: dict) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ties to the least in ASCII."""
    cost, _, end, at = min((layer[s] for s in FINAL if s in layer), key=lambda v: v[:3])
    parts = [end]
    while at is not None:
        at, letters = at
        parts.append(letters)
    return cost, "".join(reversed(parts))


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) for sorted signatures. The path of the trie to the last one is at hand, a layer a node."""
    path, layers = "", [FIRST]
    for s in signatures:
        shared = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(path, s, strict=False)))
        del layers[shared + 1 :]
        for symbol in s[shared:]:
            layers.append(next_layer(layers[-1], symbol))
        path = s
        yield s, *answer(layers[-1])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signatures = (s.as_py() for b in batches for s in b.column(0))
    yield from _batched(solved(signatures), pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, signature, illegal) of each conversation, from its rows in order: a letter a row is held."""

    def rows() -> Iterator[tuple]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, group in groupby(stream, key=lambda row: row[0]):
            symbols, illegal, before = [], 0, None
            for _, symbol, initial in group:
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                symbols.append(symbol)
            yield name, "".join(symbols), illegal

    yield from _batched(rows(), pa.schema([("name", pa.string()), ("signature", pa.string()), ("illegal", pa.int64())]))


def applied(audit: str, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of each repaired row, from the edits and the (role, text) of the conversation's rows."""
    state = START
    for edit in audit:
        role, text = next(rows) if edit != "I" else (b"", b"")
        if edit == "D":
            continue
        if edit == "K" and role[:1] == b"s":
            state = SYSTEM
        else:
            state, right = NEXT[state]
            role = role if edit == "K" else ROLE[right]
        yield edit, role, text


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, bytes, bytes]]]]:
    """(name, repaired rows) of each conversation: its edits come first, then its rows in order; a batch is held at a time."""
    stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for name, audit, _, _ in stream:
        yield name, applied(audit, ((role, text) for _, _, role, text in stream))


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of 1,000 rows, or of fewer if these hold over 16 MB of texts."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes | str))
        if len(out) == 1000 or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for name, repaired in _applied(batches):
            digest, before = hashlib.sha256(), b""
            for _, role, text in repaired:
                digest.update(before + role + b":")
                digest.update(text)
                before = b"\n"
            yield name, digest.hexdigest()

    yield from _batched(rows(), pa.schema([("name", pa.string()), ("repaired_sha256", pa.string())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((name, place, edit, role, text) for name, repaired in _applied(batches) for place, (edit, role, text) in enumerate(repaired))
    types = [("name", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.binary()), ("text", pa.binary())]
    yield from _batched(rows, pa.schema(types))


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Each conversation's rows in one task, sorted there (with spills): a task reads them in a stream."""
    return rows.repartition("name").sortWithinPartitions("name", *columns)


def edits(rows: DataFrame) -> DataFrame:
    """(name, illegal, cost, audit) of each conversation from its rows ``with_symbols``; written once."""
    ordered = _in_order(rows, *ORDER).select("name", "symbol", "initial")
    own = written(ordered.mapInArrow(_signatures, "name string, signature string, illegal long"), "signatures")
    each = own.select("signature").distinct().repartitionByRange(partitions(rows.sparkSession), "signature").sortWithinPartitions("signature")
    answers = written(each.mapInArrow(_solve, "signature string, cost long, audit string"), "answers")
    return written(own.join(answers, "signature").select("name", "illegal", "cost", "audit"), "edits")


def _with_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    first = found.select("name", F.lit(0).alias("part"), "audit", none("turn", "long"), none("role", "string"), none("digest", "string"), none("copy", "int"), none("text", "string"))
    both = first.unionByName(rows.select("name", F.lit(1).alias("part"), none("audit", "string"), *ORDER, "text"))
    return _in_order(both, "part", *ORDER).select("name", "audit", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of the damaged conversations after repair: (conv_id, place, edit, role, text), place from 0 without gaps.

    The same awkward rows as in ``repair`` have the same results."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    out = _with_edits(rows, edits(with_symbols(rows))).mapInArrow(_rows, "name string, place long, edit string, role binary, text binary")
    ids = conversations.select("conv_id", named("conv_id").alias("name")).distinct()
    return out.join(ids, "name").select("conv_id", "place", "edit", F.decode("role", "UTF-8").alias("role"), F.decode("text", "UTF-8").alias("text"))


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations`` (conv_id, turn, role, text) with its faults after damage and its cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Null ids, turns, roles
    and texts are read as one space; rows without a conv_id are one conversation, and null turns come first. Rows of
    one turn are ordered by role, then by the digest of their text; repeated rows are duplicates. Roles other than
    those that begin with s, u or a fit nowhere and are changed or deleted. A conversation without rows after damage
    has zeros, no edits and the hash of the empty string. Other columns are ignored; an empty table gives one."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    symbols = written(with_symbols(rows), "symbols")
    found = edits(symbols)
    faults = ("blank", "duplicate", "truncated")
    turns = symbols.groupBy("name", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in faults))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    facts = turns.groupBy("name").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in faults))
    hashes = _with_edits(rows, found).mapInArrow(_hashes, "name string, repaired_sha256 string")
    out = conversations.select("conv_id", named("conv_id").alias("name")).distinct()
    for part in (facts, found, hashes):
        out = out.join(part, "name", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *faults, "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
