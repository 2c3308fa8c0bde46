"""The operators against brute force on small documents, and on awkward rows."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import awkward, corpus, frame

from terrafold.llm.common import components
from terrafold.llm.suffixes import suffix_array

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def shingles(text):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_suffix_array():
    r = random.Random(3)
    for _ in range(800):
        s = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 30))] * r.randint(1, 3) + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(docs, rows, hot, monkeypatch):
    from terrafold.llm import repeats as R

    monkeypatch.setattr(R, "HOT", hot)
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(x[k : k + 200] for x in raw.values() for k in range(len(x) - 199))
    got = {r.doc_id: r for r in R.repeats(docs, with_text=True).collect()}
    assert got.keys() == raw.keys()
    for i, x in raw.items():
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(x), int(gone.sum()), runs, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_passages(docs, rows):
    from terrafold.llm.passages import passages

    seen = collections.defaultdict(set)
    for i, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    repeated = {i for s in seen.values() if len(s) > 1 for i in s}
    found = passages(docs).collect()
    assert repeated <= {r.doc_id for r in found}
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in found)


def test_passages_each_with_each(spark):
    """A document with a smaller id that shares half of a passage does not hide that two others share all of it."""
    from terrafold.llm.passages import passages

    r = random.Random(8)
    say = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    docs, alike = [], []
    for k in range(0, 90, 3):
        p = say(60)
        q = [*p[:30], *say(1), *p[31:]]
        docs += [(k, say(40) + p[:35] + say(40)), (k + 1, say(30) + p + say(30)), (k + 2, say(20) + q + say(50))]
        alike.append((k + 2, k + 1))
    docs += [(200, docs[1][1]), (201, docs[1][1])]
    found = passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()
    links = {(x.doc_id, x.class_doc) for x in found if x.doc_id != x.class_doc}
    assert set(alike) <= links and {(200, 1), (201, 1)} <= links
    words = dict(docs[:90])
    for x in found:
        if x.doc_id < 200:
            a, b = ({tuple(words[i][j : j + 5]) for j in range(s, e - 4)} for i, s, e in ((x.doc_id, x.start_word, x.end_word), (x.class_doc, x.class_start, x.class_end)))
            assert x.end_word - x.start_word >= 50 and abs(len(a & b) / len(a | b) - x.similarity) < 1e-9 and x.similarity >= 0.8


def test_passages_brute(spark):
    """Every two texts of which any passages of 50 words or more match are linked, beside decoys and in seeds of many texts too."""
    from terrafold.llm.passages import GRAM, passages

    r = random.Random(31)
    say = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    docs, common = [], say(44)
    for _ in range(20):
        p, k = say(r.choice([46, 50, 54, 60])), r.randrange(3, 43)
        q = r.choice([p, [*p[:k], *say(1), *p[k + 1 :]], [*p[:k], *p[k + 1 :]], [*p[:k], *say(1), *p[k:]]])
        docs += [say(r.randrange(20)) + w + say(r.randrange(20)) for w in (p, q, p[:44])]
    for _ in range(45):  # nothing but two pairs of these match: a seed of many texts
        docs.append(common + say(20))
    for k in (-1, -2):
        docs.append(docs[k][:50] + say(15))
    r.shuffle(docs)

    def masks(w, number):
        ids = [number.setdefault(tuple(w[i : i + GRAM]), len(number)) for i in range(len(w) - GRAM + 1)]
        return [sum({1 << x for x in ids[a:e]}) for a in range(len(ids)) for e in range(a + 46, len(ids) + 1)]

    number, meant = {}, set()
    held = [masks(w, number) for w in docs]
    full = [sum({1 << number[tuple(w[i : i + GRAM])] for i in range(len(w) - GRAM + 1)}) for w in docs]
    for i in range(len(docs)):
        for j in range(i):
            if (full[i] & full[j]).bit_count() >= 36 and any(5 * (a & b).bit_count() >= 4 * (a | b).bit_count() for a in held[i] for b in held[j]):
                meant.add((i, j))
    found = passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()
    assert len(meant) > 15 and {(x.doc_id, x.class_doc) for x in found if x.doc_id != x.class_doc} == meant


def test_passages_repetitive():
    """Texts that repeat few shingles are compared once for each set of them (3 s for such a pair before)."""
    import time

    from terrafold.llm.passages import alike

    r = np.random.default_rng(4)
    shared = r.integers(1, 2**63, 25, dtype=np.uint64)
    x, y = (np.tile(np.concatenate([shared, r.integers(1, 2**63, 5, dtype=np.uint64)]), 36) for _ in range(2))
    began = time.process_time()
    assert alike(x, y, 46, 80) == []
    assert alike(x, np.tile(shared, 40), 46, 80)[0][4] == 25 / 30
    assert time.process_time() - began < 1


def test_passages_ordered():
    """Shingles that stand in one order and once each: parts match if any do by brute force."""
    from terrafold.llm.passages import alike

    r, hits = np.random.default_rng(6), 0
    for k in range(80):
        x = y = np.arange(1, 75, dtype=np.uint64)
        for gone in range(r.integers(3, 7)):
            at, wide = r.integers(0, 70), r.integers(1, 6)
            other = np.arange(1000 * k + 100 * gone + 1000, 1000 * k + 100 * gone + 1000 + r.integers(0, 6), dtype=np.uint64)
            x, y = (np.concatenate([v[:at], other, v[at + wide :]]) if (gone % 2) == side else v for side, v in enumerate((x, y)))
        stands = {int(v): j for j, v in enumerate(y)}
        to = np.array([stands.get(int(v), -1) for v in x])
        held = np.zeros((len(x) + 1, len(y) + 1), int)
        held[1:, 1:][np.flatnonzero(to >= 0), to[to >= 0]] = 1
        held = held.cumsum(0).cumsum(1)
        meant = False
        for m in range(46, len(x) + 1):
            for n in range(46, len(y) + 1):
                both = held[m:, n:] - held[:-m, n:] - held[m:, :-n] + held[:-m, :-n]
                meant |= bool((180 * both >= 80 * (m + n)).any())
        found = alike(x, y, 46, 80)
        assert bool(found) == meant
        hits += meant
        for a, m, c, n, like in found:
            p, q = set(x[a : a + m].tolist()), set(y[c : c + n].tolist())
            assert min(m, n) >= 46 and a + m <= len(x) and c + n <= len(y) and abs(len(p & q) / len(p | q) - like) < 1e-9 and like >= 0.8
    assert 10 < hits < 70


def test_passages_one_group(spark):
    """Near copies of one text that match are in one class."""
    from terrafold.llm import passages as module

    r = random.Random(12)
    base, docs = [f"w{r.randrange(10**9)}" for _ in range(90)], []
    for _ in range(240):
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(90)] = f"w{r.randrange(10**9)}"
        docs.append(w)
    found = module.passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()
    root = list(range(240))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in found:
        root[max(top(x.doc_id), top(x.class_doc))] = min(top(x.doc_id), top(x.class_doc))
    with np.errstate(over="ignore"):
        hashes = [module.rolled(np.array([hash(v) & (2**63 - 1) for v in w], np.uint64)) for w in docs]
    for i in range(240):
        for j in range(i):
            assert top(i) == top(j) or not module.alike(hashes[i], hashes[j], 46, 80)


def test_fingerprints(docs, rows):
    from terrafold.llm.fingerprints import fingerprints

    text = {i: t or "" for i, t in rows}
    ids = sorted(text, reverse=True)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    same = {}
    errors = []
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, m = text[i], len(text[i]) // 3
        edited = t[: len(t) - m] + text[nxt][:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        a, b = ({x for x in shingles(v.lower())} for v in (t, edited))
        if a | b:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).mean() < 0.08


def test_mixing(spark, docs, rows):
    from terrafold.llm.mixing import fit, mixed, mixture

    labels = spark.createDataFrame([(i, int(len(t or "") > 300), 0) for i, t in rows if i % 2], "doc_id long, quality int, toxic int")
    got = mixture(docs, labels).collect()
    share = sum(r.tokens * r.p_high * r.rate for r in got) / sum(r.tokens * r.rate for r in got)
    assert abs(share - 0.9) < 1e-4 and min(r.rate for r in got) >= 1 - 1e-6
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert mixed(docs, labels).count() == sum(r.copies for r in got)
    fixed = mixture(docs, labels, targets={"high": 0.5, "low": 0.5}, total=1000.0).collect()
    assert abs(sum(r.tokens * r.p_high * r.rate for r in fixed) - 500) < 1 and min(r.rate for r in fixed) >= 0
    assert fit(docs, labels.limit(0)).steps is not None


@pytest.mark.parametrize("high", [(0.85, 0.15), (0.7, 0.5), (0.5, 0.5), (0.99, 0.01)])
def test_mixing_loses_nothing(spark, high, monkeypatch):
    """Sharp, weak and even posteriors: 80 documents that are high and 20 that are low."""
    from terrafold.llm import mixing

    class Told(mixing.Mix):
        def posterior(self, x):
            p = np.where(x[:, 10] > np.log1p(45) / 10, *high)  # the text's number of words
            return np.stack([p, 1 - p], axis=1)

    monkeypatch.setattr(mixing, "classifier", lambda *a: Told(["high", "low"], *[np.zeros(1)] * 3))
    docs = frame(spark, [(k, "w " * (50 if k % 5 else 40)) for k in range(100)])
    got = mixing.mixture(docs, docs).collect()
    assert len(got) == 100 and min(r.rate for r in got) >= 1 and min(r.copies for r in got) >= 1
    assert {r.doc_id for r in mixing.mixed(docs, docs).collect()} == set(range(100))
    share = sum(r.tokens * r.p_high * r.rate for r in got) / sum(r.tokens * r.rate for r in got)
    before = sum(r.tokens * r.p_high for r in got) / sum(r.tokens for r in got)
    if high == (0.5, 0.5):
        assert {r.rate for r in got} == {1.0}
    elif high == (0.99, 0.01):
        assert abs(share - 0.9) < 1e-6
    else:
        assert before < share < high[0]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.undo()
    assert {r.copies for r in mixing.mixture(docs, labels).collect()} == {1}


def test_neighbours(spark):
    from terrafold.llm.neighbours import nearest

    r = np.random.default_rng(7)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[40]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] + [1.0] * 7), (960, [None] + [1.0] * 7), (None, [1.0] * 8), (980, [float("inf")] * 8)]
    got = collections.defaultdict(list)
    for row in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=70, query_rows=6).collect():
        got[row.query_id].append((row["rank"], row.vec_id, row.score))
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        score = np.zeros(len(x))
        for d in range(8):  # component by component, as Python's own sum is a compensated one
            score += float(x[q, d]) * x[:, d].astype(float)
        best = sorted((k for k in range(300) if k != q), key=lambda k: (-score[k], k))[:20]
        assert sorted(found) == [(n, k, score[k]) for n, k in enumerate(best, 1)]


PII = ["a@b.c_d@e.f a@b.c.@x.y ..@a.b a@b a@b.c-d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12 34", "+1 (555) 123-4567 +49.30.1234567. + 1 ++12 345 678 901)", "é😀 a@b.co 😀 10.0.0.1", "", None, "1 " * 9000, "a@b" + ".c" * 9000, "@" * 100, "zorkel jane@x.org zorkel", "zorkel jane@x.org said", "said the man", "said it", "said so", "said no"]
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_private(spark):
    from terrafold.llm.private import personal_data, sanitised, spans

    docs = frame(spark, list(enumerate(PII)))
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    for i, t in enumerate(PII):
        found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m.group())]
        joined = ",".join(f"{k}:{a}:{e}" for k, a, e in found)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[i].spans.startswith(joined)
    assert "term:0:6" in got[10].spans and "said" not in [PII[11][s.start : s.end] for s in spans(docs).where("doc_id = 11").first().added]
    clean = {r.doc_id: r.text for r in sanitised(docs).collect()}
    assert clean[11] == " <email> said" and clean[5] == "" and clean[6] is None and clean[12] == PII[12]


def test_private_everywhere(spark):
    """A name far from the entity is found, and is taken out in rows without the entity too."""
    from terrafold.llm.private import sanitised

    far = " ".join(["plain words again"] * 20)
    texts = [f"Dear Zelinda, {far} a@b.example {k} Zelinda's" for k in range(3)] + [f"{far} and ZELINDA."] + [f"{far} quite other"] * 60
    clean = {r.doc_id: r.text for r in sanitised(frame(spark, list(enumerate(texts)))).collect()}
    assert clean[0] == f" , {far} <email> 0 's" and clean[3] == f"{far} and ." and clean[9] == texts[9]


def test_toxicity(spark):
    from terrafold.llm.toxicity import Lexicon, accepted, grammar, toxicity

    r = random.Random(2)
    calm = ["river", "stone", "cloud", "green", "house", "paper", "train", "sugar"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        w = [r.choice(calm) for _ in range(30)]
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), "blarg" + r.choice(["ed", "ing", "on", "s"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(bad)))
    got = toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert all(x.predicted == int(x.doc_id % 4 == 0) for x in got) and all(0 <= x.score <= 1 for x in got)
    lex = Lexicon([])
    assert lex.matches("you idiot") == [("idiot$", "targeted-insult")] and lex.matches("not an idiot.") == [("idiot$", "negated-insult")]
    assert lex.matches("he said: idiot") == [("idiot$", "insult")] and lex.matches("she said that idiot") == [("idiot$", "reported-insult")]
    assert lex.matches("idiotic; Kill?") == [("kill$", "threat")] and len(grammar().arcs) > 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = frame(spark, [(1, None), (None, "You idiot!"), (2, "")])
    assert sorted(x.doc_id for x in accepted(odd, none).collect()) == [1, 2]


def test_mixing_descends(spark, monkeypatch):
    """The rates come from projected gradient steps, and where the bound acts they are those of least squared miss."""
    from terrafold.llm import mixing

    class Told(mixing.Mix):
        def posterior(self, x):
            p = np.where(x[:, 10] > np.log1p(45) / 10, 0.7, 0.5)
            return np.stack([p, 1 - p], axis=1)

    monkeypatch.setattr(mixing, "classifier", lambda *a: Told(["high", "low"], *[np.zeros(1)] * 3))
    docs = frame(spark, [(k, "w " * (50 if k % 5 else 40)) for k in range(100)])
    got = mixing.mixture(docs, docs).collect()
    have = np.array([sum(r.tokens * r[f"p_{n}"] for r in got) for n in ("high", "low")])
    want = np.array([0.9, 0.1]) * (have / [0.9, 0.1]).max()
    along = np.array([0.7, 0.3])  # only the sharper documents are repeated
    best = have + along * max(0, (want - have) @ along) / (along @ along)
    mixed = np.array([sum(r.tokens * r.rate * r[f"p_{n}"] for r in got) for n in ("high", "low")])
    assert np.abs(mixed - best).max() < 1e-3 * best.sum()
    assert mixing.fit(docs, docs).steps and {r.rate for r in got if r.tokens == 40} == {1.0}


def test_licenses(spark):
    from terrafold.llm.licenses import BASE, scan

    texts = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. MIT license MIT license", "ÄMIT license", None, "", "gnu general public", "mit", "Apache\nLicense apache-license", "x " * 30000 + "cc by"]
    got = {r.doc_id: r for r in scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in at})) and 0 <= got[i].score <= 1
    assert got[0].labels == "gpl,gpl-3.0" and got[1].labels == "apache,apache-2.0" and "cc-by-nc-4.0" in got[2].labels


def test_licenses_whole(spark):
    """Every template that stands in a file as a whole has its label: alone, all in one file, and in every row."""
    from terrafold.llm.licenses import TEMPLATES, scan

    alone = [t for _, t, _ in TEMPLATES]
    every = sorted({label for label, _, _ in TEMPLATES})
    rows = list(enumerate([*alone, " x ".join(alone), " x ".join(reversed(alone))]))
    rows += [(100 + k, "mit license cc by apache") for k in range(30)]
    got = {r.doc_id: set(r.labels.split(",")) for r in scan(frame(spark, rows)).collect()}
    assert all(label in got[k] for k, (label, _, _) in enumerate(TEMPLATES))
    assert set(every) <= got[len(alone)] and set(every) <= got[len(alone) + 1]
    same = scan(frame(spark, [(k, TEMPLATES[-1][1]) for k in range(3)])).collect()
    assert {(r.labels, r.score) for r in same} == {("isc", 1.0)}


def test_licenses_counts(spark):
    """How rare a word is follows from every row, those that can hold no licence too."""
    from terrafold.llm.licenses import scan

    must, more = "redistribution and use in source and binary forms", "with or without modification are permitted"
    got = {r.doc_id: r for r in scan(frame(spark, [(0, must), *((k, more) for k in range(1, 51))])).collect()}
    rare, common = 8 * np.log(53 / 2), 6 * np.log(53 / 51)
    assert got[0].labels == "bsd" and abs(got[0].score - rare / (rare + common)) < 1e-5
    assert {(got[k].labels, got[k].score) for k in range(1, 51)} == {("", 0.0)}


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    from terrafold.llm.packing import best_fit, plan
    from terrafold.llm.queries import tokenizer_file

    tok = Tokenizer.from_file(tokenizer_file())
    got = best_fit(docs, tokenizer_file(), with_ids=True).collect()
    ids = collections.defaultdict(list)
    room = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == len(ids[r.doc_id]) == 2048 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(r.ids)
        ids[r.doc_id] += part
        room[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        assert ids[i] == tok.encode(t or "", add_special_tokens=False).ids + [0]
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(room) <= total / 2048 * 1.1 + 1
    counts = {7: 3, 5: 4, 3: 9, 2: 1, 10: 2}
    placed = collections.Counter()
    for length, first, n, seq, offset in plan(counts, 10):
        for k in range(n):
            placed[length] += 1
            assert offset + length <= 10 and first + k < counts[length] and seq >= 0
    assert placed == counts


@pytest.mark.parametrize("tile", [4096, 3])
def test_jaccard(docs, rows, tile, monkeypatch):
    from terrafold.llm import jaccard as J

    monkeypatch.setattr(J, "TILE", tile)
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_proposals(spark, monkeypatch):
    """A class is proposed once by a task, however many it is held against at a time: rows don't grow with the square of a tile."""
    from terrafold.llm import jaccard as J

    monkeypatch.setattr(J, "PAIRS", 16)
    n, bits = 60, J.bitmap(np.arange(100, dtype=np.uint64), J.BITS)
    ids = list(range(1, n + 1))
    tiled = spark.createDataFrame([(7, 0, False, ids, [100] * n, [0] * n)], "tok long, part int, more boolean, cls array<long>, n array<int>, pos array<int>")
    parts = spark.createDataFrame([(i, bits, i) for i in ids], "cls long, bits binary, comp long")
    found = J.proposals(tiled, parts, 80, True).collect()
    assert sorted(r.a for r in found) == ids
    assert J.proposals(tiled, parts, 80, False).count() == J.rest_pairs(tiled, parts, 80, False).count() == n * (n - 1) // 2


def test_jaccard_few_of_two_parts(spark, monkeypatch):
    """A large part and a small one are held against each other by the few likest pairs first, each once, however many tiles they share."""
    from terrafold.llm import jaccard as J

    monkeypatch.setattr(J, "PAIRS", 16)
    n = 60
    sets = {i: np.append(np.arange(100 - i % 7, dtype=np.uint64), np.arange(200, 200 + i % 7, dtype=np.uint64)) for i in range(1, n + 1)}
    ids = list(sets)
    tiled = spark.createDataFrame([(k, 0, False, ids, [100] * n, [0] * n) for k in (7, 8)], "tok long, part int, more boolean, cls array<long>, n array<int>, pos array<int>")
    parts = spark.createDataFrame([(i, J.bitmap(s, J.BITS), max(1, i - n + 3)) for i, s in sets.items()], "cls long, bits binary, comp long")
    found = [(r.a, r.b) for r in J.rest_pairs(tiled, parts, 80, False, 2).collect()]
    part = {i: max(1, i - n + 3) for i in ids}
    assert len(found) == len(set(found)) == 2 + 2 + 1  # parts 2 and 3 are one class each
    assert all(part[a] != part[b] for a, b in found)
    likest = {(a, b) for a, b in found if part[a] == 1 and part[b] == 3}
    assert len(likest) == 2 and all(a % 7 == b % 7 for a, b in likest)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(40)] + [(200, k) for k in range(201, 240)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    alone = {a for a, b in edges if a == b} - {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: root(i) for i in parent if i not in alone}


def run_all(docs, labels):
    from terrafold.llm import fingerprints, jaccard, licenses, mixing, packing, passages, private, repeats, toxicity
    from terrafold.llm.queries import tokenizer_file

    return {
        "repeats": repeats.repeats(docs),
        "passages": passages.passages(docs),
        "fingerprints": fingerprints.fingerprints(docs),
        "mixture": mixing.mixture(docs, labels),
        "mixed": mixing.mixed(docs, labels),
        "private": private.personal_data(docs),
        "sanitised": private.sanitised(docs),
        "toxicity": toxicity.toxicity(docs, labels),
        "accepted": toxicity.accepted(docs, labels),
        "licenses": licenses.scan(docs),
        "packing": packing.best_fit(docs, tokenizer_file()),
        "jaccard": jaccard.jaccard_join(docs),
    }


def test_awkward_rows(spark, rows):
    docs = awkward(spark, rows).cache()
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    n = docs.count()
    out = {k: df.collect() for k, df in run_all(docs, labels).items()}
    for k in ("repeats", "fingerprints", "mixture", "private", "sanitised", "toxicity", "licenses", "jaccard"):
        assert len(out[k]) == n, k
    assert len({(r.doc_id, r.piece) for r in out["packing"]}) <= len(out["packing"])
    assert all(r.n_removed == r.n_bytes for r in out["repeats"] if r.doc_id in (0, 1, 2) and r.n_bytes >= 200)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for k, df in run_all(empty, labels).items():
        assert df.collect() == [], k


def test_nearest_awkward(spark):
    """Nulls, repeats, ties, other dimensions and clashing columns; an empty table gives one."""
    from terrafold.llm.neighbours import nearest

    schema = "vec_id long, embedding array<float>, score string, rank int, v string, dim int"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [9.0, 9.0]), (7, [1.0, 0.0, 5.0]), (20, []), (40, [0.5, 0.5])]
    got = nearest(spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], schema)).collect()
    assert sorted((g.query_id, g.rank, g.vec_id, g.score) for g in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 40, 0.5), (40, 1, 0, 0.5), (40, 2, 1, 0.5), (40, 3, 2, 0.5)]
    assert nearest(spark.createDataFrame([], schema)).collect() == []


def test_registered():
    import __spark_entry__ as e
    import corpus_pipeline

    names = e.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    json.dumps(sorted(e.oracle_sql()))
