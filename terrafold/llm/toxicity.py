"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words get a symbol (insult, threat, target, negation, reported speech). Small transducers rewrite a
clause's symbols one after another; they are composed into one machine, which reads each clause once.
What is scored are the rewritten matches of clauses (a plain, targeted, negated or reported insult or
threat), with lexeme and match weights learned from labelled rows. As corpora insult in words of their
own, the insult lexicon is a fixed list and the words and word beginnings that labelled rows add to it."""

from __future__ import annotations

import functools
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

# The lexicon, by symbol.
LEXICON = {
    "insult": "idiot idiots moron morons worthless loser losers trash scum stupid pathetic clown clowns disgusting dumb imbecile fool bastard "
    "idiota imbécil estúpido estúpida inútil basura payaso asqueroso patético "
    "dummkopf trottel abschaum wertlos erbärmlich versager widerlich "
    "imbécile débile ordure minable pathétique dégoûtant",
    "threat": "kill murder hurt destroy matar matarte töten umbringen tuer détruire",
    "target": "you your yourself he she they them him her tú usted ustedes él ella ellos sie ihr euch du dich tu toi vous il elle ils",
    "negation": "not no never nobody isn't aren't don't doesn't nie nicht kein keine nunca jamás ne pas jamais",
    "report": "said says say told called wrote quoted claims dijo dice llamó escribió sagte sagt nannte schrieb dit disait appelé écrit",
}
CORE = ("insult", "threat")
MATCHES = tuple(f"{how}{kind}" for kind in CORE for how in ("", "targeted-", "negated-", "reported-"))
CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


@dataclass
class Transducer:
    """Arcs {(state, symbol): (state, symbol written)}; a symbol without an arc is copied and leaves the state."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(a: Transducer, b: Transducer, symbols: list[str]) -> Transducer:
    """The machine that gives what ``b`` writes on what ``a`` writes, over the states that can be reached."""
    out, todo = Transducer((a.start, b.start)), [(a.start, b.start)]
    seen = set(todo)
    while todo:
        p, q = todo.pop()
        for s in symbols:
            p2, mid = a.step(p, s)
            q2, written = b.step(q, mid)
            if (p2, q2, written) != (p, q, s):
                out.arcs[((p, q), s)] = ((p2, q2), written)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return out


def marker(trigger: str, prefix: str, span: int) -> Transducer:
    """After ``trigger``, a core symbol within ``span`` words is rewritten with ``prefix``."""
    t = Transducer(0)
    for left in range(span + 1):
        t.arcs[(left, trigger)] = (span, trigger)
        for kind in CORE:
            t.arcs[(left, kind)] = (max(0, left - 1), f"{prefix}{kind}" if left else kind)
        for other in ("word", *LEXICON):
            if other != trigger and other not in CORE:
                t.arcs[(left, other)] = (max(0, left - 1), other)
    return t


@functools.cache
def grammar() -> Transducer:
    """Negation is read first, then reported speech, then the target: the first rewriting holds."""
    symbols = ["word", *LEXICON]
    machine = compose(marker("negation", "negated-", 3), marker("report", "reported-", 8), symbols)
    return compose(machine, marker("target", "targeted-", 4), symbols)


@functools.cache
def lexemes() -> dict[str, str]:
    return {w: kind for kind, words in LEXICON.items() for w in words.split()}


class Lexicon:
    """Core units: whole words (ending in ``$``) and word beginnings, with their symbol."""

    def __init__(self, learned: list[str]) -> None:
        import ahocorasick

        self.kind = {f"{w}$": k for w, k in lexemes().items() if k in CORE} | dict.fromkeys(learned, "insult")
        self.find = ahocorasick.Automaton()
        for unit in sorted(self.kind, key=lambda u: (u.endswith("$"), u)):  # a whole word is told from the same beginning
            self.find.add_word(unit.rstrip("$"), unit)
        self.find.make_automaton()

    def matches(self, text: str | None) -> list[tuple[str, str]]:
        """(unit, match kind) of every core word, clause by clause."""
        text = (text or "").lower()
        at: dict[int, str] = {}
        for end, unit in self.find.iter(text):
            first = end - len(unit.rstrip("$")) + 1
            if (first and text[first - 1].isalnum()) or (unit[-1] == "$" and end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            at[first] = max(at.get(first, ""), unit, key=len)
        if not at:
            return []
        out, words, machine, begin = [], lexemes(), grammar(), 0
        for end in [*(m.end() for m in CLAUSE_END.finditer(text)), len(text)]:
            if any(begin <= k < end for k in at) if len(at) < 8 else not at.keys().isdisjoint(range(begin, end)):
                state = machine.start
                for m in WORD.finditer(text, begin, end):
                    unit = at.get(m.start())
                    state, written = machine.step(state, self.kind[unit] if unit else "word" if (k := words.get(m.group(), "word")) in CORE else k)
                    if unit:
                        out.append((unit, written))
            begin = end
        return out


def beginnings(text: str | None, least: int = 3, most: int = 10) -> set[str]:
    """Every beginning of every word, and every whole word with ``$``; with ``2`` before it if two words of the text have it."""
    seen: Counter[str] = Counter()
    for w in WORD.findall((text or "").lower()):
        if len(w) >= least and w.isalpha():
            seen[w[:24] + "$"] += 1
            for k in range(least, min(most, len(w)) + 1):
                seen[w[:k]] += 1
    return {*seen, *(f"2{u}" for u, n in seen.items() if n > 1)}


def least_hashes(text: str | None, default: str) -> list[int]:
    """Two min-hashes of a text's runs of three words; near copies mostly share one."""
    w = WORD.findall((text or "").lower())
    runs = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else {default}
    return [min(zlib.crc32(f"{k}{r}".encode()) for r in runs) for k in "ab"]


def twins(keys: list[tuple[int, int]]) -> list[int]:
    """Group numbers of rows that share either key: near copies count as one witness."""
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, pair in enumerate(keys):
        for k in enumerate(pair):
            j = seen.setdefault(k, i)
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(keys))]


def cover(witnesses: dict[str, set[int]], clean: dict[str, int], least: int, precision: float = 0.5, times: int = 3) -> list[str]:
    """Few units (a ``2`` in front is dropped) that explain the toxic rows: greedily the unit with most rows not yet matched ``times`` times.

    Chance matches of a unit in clean rows may be as many as its true ones: a toxic row has several."""
    good = {u: w for u, w in witnesses.items() if len(w) >= least and len(w) >= precision * (len(w) + clean.get(u, 0))}
    need: dict[int, int] = {}
    for w in good.values():
        for i in w:
            need[i] = times
    out: dict[str, set[int]] = {}
    queue = [(-len(w), -len(u), u) for u, w in good.items()]
    heapq.heapify(queue)
    while queue:
        gain, size, u = heapq.heappop(queue)
        bare = u.strip("2$")
        same = [out[v] for v in out if v.strip("2$").startswith(bare) or bare.startswith(v.strip("2$"))]  # these match the same words
        new = good[u].difference(*same)
        now = sum(need[i] > 0 for i in new)
        if now < least:
            continue
        if -gain != now:
            heapq.heappush(queue, (-now, size, u))
            continue
        out[u] = good[u]
        for i in new:
            need[i] -= 1
    return sorted({u.lstrip("2") for u in out})


def features(found: list[tuple[str, str]], weight: dict[str, float]) -> list[float]:
    """log(1 + weighted number) of each match kind and of all together; whether there are two and three matches."""
    total = dict.fromkeys(MATCHES, 0.0)
    for w, kind in found:
        total[kind] += weight.get(w, 0.0)
    return [*map(math.log1p, total.values()), math.log1p(sum(total.values())), float(len(found) > 1), float(len(found) > 2)]


@dataclass
class Model:
    learned: list[str]
    weight: dict[str, float]
    coef: list[float]

    def score(self, found: list[tuple[str, str]]) -> float:
        z = self.coef[-1] + float(np.dot(self.coef[:-1], features(found, self.weight)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(learned: list[str], rows: list[tuple[list[tuple[str, str]], int]]) -> Model:
    """Unit weights are smoothed precisions in the rows; match weights come from a penalised logistic fit.

    Without rows of both labels, every unit weighs 1 and one match is enough for a high score."""
    units = list(Lexicon(learned).kind)
    n = len(rows)
    positive = sum(y for _, y in rows)
    if not 0 < positive < n:
        return Model(learned, dict.fromkeys(units, 1.0), [*[0.0] * len(MATCHES), 4.0, 0.0, 0.0, -1.5])
    in_all, in_bad = dict.fromkeys(units, 0), dict.fromkeys(units, 0)
    for found, y in rows:
        for w in {w for w, _ in found}:
            in_all[w] += 1
            in_bad[w] += y
    base = positive / n
    weight = {w: max(0.0, ((in_bad[w] + 0.5) / (in_all[w] + 1) - base) / (1 - base)) for w in units}
    x = np.array([[*features(found, weight), 1.0] for found, _ in rows])
    y = np.array([y for _, y in rows], dtype=float)
    coef, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    penalty[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(coef)), x.T @ (y - p) - penalty * coef)
        coef = coef + step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(learned, weight, coef.tolist())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """The model from labelled rows that aren't held out; at most ``max_rows`` of them, those of least hashed id.

    The sample is bounded so that fitting costs the same at every size; its texts stay on the executors."""
    small_batches(docs.sparkSession)
    chosen = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out()).where("doc_id is not null")
    chosen = chosen.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")

    def of_toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = [beginnings(t) for t in b["text"]]
            keys = [least_hashes(t, str(d)) for d, t in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "keys": keys, "units": [sorted(u) for u in units]})

    toxic = written(sample.where("toxic = 1").mapInPandas(of_toxic, "doc_id long, keys array<long>, units array<string>"), "toxic")
    keys = toxic.select("doc_id", "keys").orderBy("doc_id").collect()
    number = dict(zip((r["doc_id"] for r in keys), twins([tuple(r["keys"]) for r in keys]), strict=True))
    least = max(3, len(set(number.values())) // 150)
    units = toxic.select("doc_id", F.explode("units").alias("unit"))
    often = units.groupBy("unit").count().where(F.col("count") >= least).orderBy(F.desc("count"), "unit").limit(20_000)
    wanted = {r["unit"] for r in often.collect()}
    witnesses: dict[str, set[int]] = {}
    for r in units.join(F.broadcast(often.select("unit")), "unit").groupBy("unit").agg(F.collect_list("doc_id").alias("ids")).collect():
        witnesses[r["unit"]] = {number[i] for i in r["ids"]}

    def of_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(beginnings(t) & wanted)
        yield pd.DataFrame({"unit": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    counted = sample.where("toxic = 0").mapInPandas(of_clean, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    learned = cover(witnesses, {r["unit"]: r["n"] for r in counted.collect()}, least)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(learned)
        for b in batches:
            each = [lexicon.matches(t) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "words": [[w for w, _ in f] for f in each], "kinds": [[k for _, k in f] for f in each]})

    rows = sample.select("text", "toxic").mapInPandas(found, "toxic int, words array<string>, kinds array<string>").collect()
    return fit(learned, sorted([(list(zip(r["words"], r["kinds"], strict=True)), r["toxic"]) for r in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, held_out, score, predicted, n_matches, kinds).

    A null or empty text has no match and gets the score of one. Rows are independent: repeated rows are
    scored each, and a null doc_id is not held out. Other columns are ignored."""
    model = train(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model.learned)
        for b in batches:
            found = [lexicon.matches(t) for t in b["text"]]
            score = [model.score(f) for f in found]
            predicted = [int(s >= threshold) for s in score]
            kinds = [sorted({k for _, k in f}) for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held"], "score": score, "predicted": predicted, "n_matches": [len(f) for f in found], "kinds": kinds})

    source = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held"))
    return source.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, n_matches int, kinds array<string>")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``; all columns stay as they are."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.learned)
        for b in batches:
            yield b.filter(pa.array([model.score(lexicon.matches(t)) < threshold for t in (x.as_py() for x in b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
