"""The stages of the pipeline over small tables: near copies by brute force, and all stages one after another."""

import collections
import re

import corpus_pipeline as C
from fixtures import awkward, corpus


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """The number of each row's group of linked texts; rows without words are groups of their own."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_near_copies(spark):
    rows = corpus(50)
    rows += [(3, "Another text than that of three, with words enough to be a document."), (None, rows[7][1]), (None, "no id at all, but some words here"), (None, "no id at all, but some words here"), (None, ""), (None, ""), rows[4], rows[4]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = collections.Counter((r.doc_id, r.text) for r in C.drop_near_copies(spark, docs, "").collect())
    group = groups(rows)
    want: collections.Counter = collections.Counter()
    for g in set(group):
        mine = [r for r, h in zip(rows, group, strict=True) if h == g]
        if not shingles(mine[0][1]):
            want.update(mine)
            continue
        least = min((r[0] is None, r[0] or 0) for r in mine)
        kept = [r for r in got if r in mine]
        assert len(kept) == 1 and got[kept[0]] == 1 and (kept[0][0] is None, kept[0][0] or 0) == least
        want[kept[0]] += 1
    assert got == want


def test_run(spark, tmp_path):
    """Each stage keeps the columns, takes what it got from the one before, and the last one's pieces are gapless."""
    docs = awkward(spark, corpus(40)).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(30)] + [(None, 1, 0), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        counts.append(held.count())
        after = stage(spark, held, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        held = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] == counts[2] <= held.count()
    pieces = C.run(spark, str(tmp_path)).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    assert by and all(sum(n for _, n in s) <= 2048 for s in by.values())
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
