"""SimHash near-duplicates, embedding whitening and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from fixtures import awkward, corpus, frame

from terrafold.llm import repair as R
from terrafold.llm import simhash as S
from terrafold.llm import whitening as W


def print_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def grouped(prints, bits=3):
    """The smallest index reachable from each print."""
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(prints):
            for j in range(i):
                if (p ^ prints[j]).bit_count() <= bits and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


@pytest.mark.parametrize("most", [S.MOST, 2])
def test_simhash(spark, most):
    rows = corpus(40)
    long = "aa bb cc dd ee " * 3000
    rows += [(900, long), (901, long + "tail"), (902, "Head " + long), (903, rows[0][1])]
    got = {r.doc_id: r for r in S.simhash(frame(spark, rows).repartition(3), most=most).collect()}
    prints = [print_of(t) for _, t in rows]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for (i, _), p in zip(rows, prints, strict=True)}
    assert {i: r.component_id for i, r in got.items()} == {i: rows[g][0] for (i, _), g in zip(rows, grouped(prints), strict=True)}


@pytest.mark.parametrize("most", [S.MOST, 3])
def test_links_of_dense_prints(spark, most):
    """Balls of near fingerprints, chains of links, and lone ones."""
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(30)}
    for _ in range(4):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(40)}
    step = r.getrandbits(64)
    for k in range(20):
        step ^= sum(1 << b for b in r.sample(range(64), 3))
        prints.add(step)
    prints = sorted(prints)
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    group = list(range(len(prints)))
    at = {S._signed(p): k for k, p in enumerate(prints)}
    for e in S.links(df, most=most).collect():
        a, b = sorted((group[at[e.src]], group[at[e.dst]]))
        group = [a if g == b else g for g in group]
    assert group == grouped(prints)


def test_simhash_splits():
    masks = [0]
    for _ in range(S.SPLITS):
        for m in masks[:20]:
            parts = [x ^ m for x in S.split(m)]
            assert sum(parts) | m == (1 << 64) - 1 and all(p and not p & m for p in parts)
        masks = [x for m in masks for x in S.split(m)]
    assert max(64 - m.bit_count() for m in masks) <= 12


def test_simhash_awkward(spark):
    rows = corpus(10)
    got = S.simhash(awkward(spark, rows)).collect()
    assert len(got) == len(rows) + 5
    lone = [r for r in got if r.doc_id is None]
    assert {r.fingerprint for r in lone} >= {"0" * 16} and {r.component_id for r in lone if r.fingerprint == "0" * 16} == {min(i for i, t in rows if not (t or "").split())}
    assert S.simhash(frame(spark, [])).collect() == []
    assert [r.component_id for r in S.simhash(frame(spark, [(None, "a"), (None, "a b c d")])).collect()] == [None, None]
    with pytest.raises(ValueError):
        S.links(spark.range(1).withColumnRenamed("id", "fp"), bits=4)


def whitened(vectors, k=4):
    """(n, sums, eigenvalues, axes, trace) by a dense decomposition."""
    x = np.unique(np.floor(256 * np.array(vectors, np.float64)).astype(np.int64), axis=0)
    c = x - x.sum(axis=0) / len(x)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    return len(x), x.sum(axis=0), e[::-1][:k], u[:, ::-1][:, :k], np.trace(v)


@pytest.mark.parametrize(("dim", "rows"), [(40, 300), (8, 50), (3, 20), (1, 5), (6, 3)])
def test_whitening(spark, dim, rows):
    r = np.random.default_rng(dim)
    v = (r.standard_normal((rows, dim)) * np.linspace(1, 3, dim)).astype(np.float32).tolist()
    v += v[:4]
    got = W.whiten(spark.createDataFrame([(k, x) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)).collect()
    n, s, e, u, trace = whitened(v)
    k = min(4, dim)
    assert len(got) == len(v) * k
    x = np.floor(256 * np.array(v, np.float64)).astype(np.int64)
    want = (x - s / n) @ u / np.sqrt(np.where(e > 1e-9 * trace, e, np.inf))
    flip: dict = {}
    for g in got:
        c = g.component - 1
        assert (g.n, g.deviation) == (n, int(((n * x[g.vec_id] - s) ** 2).sum()))
        assert abs(g.explained - e[c] / trace) < 1e-12
        if e[c] < 1e-9 * trace:
            assert g.whitened is None
            continue
        w = want[g.vec_id, c]
        sign = flip.setdefault(c, np.sign(g.whitened * w))
        assert abs(g.whitened * sign - w) < 1e-8 and g.identity_error < 1e-10 and g.residual < 1e-12


def test_whitening_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [2.0, 0.5]), (7, [-0.001, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, embedding array<double>, n string, x int")
    got = W.whiten(df).collect()
    seen = sorted(((-1 if g.vec_id is None else g.vec_id), g.component) for g in got)
    assert seen == sorted([(6, 1), (6, 2), (6, 1), (6, 2), (-1, 1), (-1, 2), (7, 1), (7, 2), (8, 1), (8, 2), (8, 3), *((i, c) for i in (9, 10) for c in (1, 2, 3, 4))])
    by = {(g.vec_id, g.component): g for g in got}
    assert by[6, 1].n == 3 and by[8, 1].n == 1 and by[8, 1].whitened is None and by[8, 1].explained is None and by[8, 1].deviation == 0
    assert by[9, 1].deviation is None and by[9, 2].whitened is None and abs(abs(by[9, 1].whitened) - 1) < 1e-9
    x = np.array([[256, 512], [512, 128], [-1, 768]])
    assert by[7, 1].deviation == int(((3 * x[2] - x.sum(axis=0)) ** 2).sum())
    assert W.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


STEP = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}


def cheapest(rows, must):
    """(cost, audit) by a search over all edits; rows: (initial, fault)."""
    heap, best = [(0, "", 0, 0)], {}
    while True:
        c, a, i, s = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return c, a
        if best.setdefault((i, s), (c, a)) < (c, a):
            continue
        to, right = STEP[s]
        if not a.endswith("II"):
            heapq.heappush(heap, (c + 5, a + "I", i, to))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (c + 2, a + "D", i + 1, s))
            if fault not in must:
                more = 5 if fault == "truncated" else 0
                if initial == right:
                    heapq.heappush(heap, (c + more, a + "K", i + 1, to))
                if initial == "s" and s == 0:
                    heapq.heappush(heap, (c + more, a + "K", i + 1, 1))
                heapq.heappush(heap, (c + 1 + more, a + "R", i + 1, to))


def brute_repair(table):
    """The contract, word for word, one conversation after another; rows: (conv_id, turn, role, text)."""
    own = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = own(role), own(text)
            kind = zlib.crc32(f"{own(conv)}:{own(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)), ("blank", "duplicate"))
        state, kept, it = 0, [], iter(rows)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(it)[1:]
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                state = 1
            else:
                state, right = STEP[state]
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[right]
            kept.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def talk(n=70, seed=3):
    r = random.Random(seed)
    says = ["Yes.", "No", "", " \n", "Why?", "Right!  \t", "Ends in space. \n", "é…", "x" * 3000, None, "So. And"]
    out = []
    for c in range(n):
        for t in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            role = "system" if t == 0 and r.random() < 0.3 else r.choice(["system", "tool", "", None, "User"]) if r.random() < 0.08 else role
            out.append((c, None if r.random() < 0.05 else t + (t > 5), role, r.choice(says) if r.random() < 0.5 else f"It is {r.randint(0, 9)}."))
    return out + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho."), (7, 3, "user", "Tie."), (7, 3, "user", "Tie."), (7, 3, "assistant", "Tie")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = talk()
    got = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute_repair(rows)
    assert len(got) == len(want) and {g.conv_id: tuple(g)[1:] for g in got} == want
    assert {e for w in want.values() for e in w[6]} == set("DKR")  # to insert is dearer than to delete, so never the cheapest


def test_repaired_rows(spark):
    rows = talk(30, 5)
    kept: dict = {}
    for g in sorted(R.repaired(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda g: g.place):
        kept.setdefault(g.conv_id, []).append(g)
    want = brute_repair(rows)
    for c, w in want.items():
        mine = kept.get(c, [])
        assert [g.place for g in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{g.role}:{g.text}" for g in mine).encode()).hexdigest() == w[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(g.role[:1] for g in mine))


def test_repair_awkward(spark):
    rows = [(*x, "a", "b", 1) for x in talk(5)]
    got = R.repair(spark.createDataFrame(rows, SCHEMA + ", name string, audit string, digest int")).collect()
    assert {g.conv_id: tuple(g)[1:] for g in got} == brute_repair([x[:4] for x in rows])
    assert R.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert tuple(R.repair(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)).first()) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_trie_layers_are_shared(monkeypatch):
    """Each distinct prefix gets one layer, whatever the number of signatures below it."""
    calls = []
    plain = R.next_layer
    monkeypatch.setattr(R, "next_layer", lambda layer, s: calls.append(s) or plain(layer, s))
    r = random.Random(4)
    signatures = sorted({"".join(r.choice("suaxSUAXd" if k % 2 else "uaUd") for _ in range(r.randint(0, 8))) for k in range(400)})
    faults = {"d": "blank", **dict.fromkeys("SUAX", "truncated")}
    for s, cost, audit in R.solved(iter(signatures)):
        assert (cost, audit) == cheapest([(c.lower(), faults.get(c)) for c in s], ("blank",)), s
    assert len(calls) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
    assert next(R.solved(iter(["ua" * 20_000])))[1:] == (0, "K" * 40_000)
