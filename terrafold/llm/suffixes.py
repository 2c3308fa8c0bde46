"""Exact repeats of 200 bytes by suffix arrays, built by linear grouping over anchored pieces.

Equal strings of WIDTH bytes have the same least k-gram hash at the same place: the string's anchor. Pieces
of text around equal anchors meet in one bucket; a bucket's pieces, cut into 8-byte symbols counted from the
anchor, are one string whose suffix array brings equal strings together. Comparing whole symbols there and
the bytes at both ends makes the result exact."""

from __future__ import annotations

import numpy as np

from .shingles import mix

WIDTH = 200
GRAM = 32
STEP = 8
SIDE = (WIDTH - GRAM) // 2  # bytes on either side of an anchor: every window has them on one side at least
SYMBOLS = WIDTH // STEP - 1  # whole symbols that every WIDTH bytes hold, wherever they begin


def suffix_array(s: list[int]) -> list[int]:
    """Suffixes of ``s`` in order; ``s`` ends with a symbol smaller than all others.

    First the suffixes are grouped by their Lyndon prefix. Groups are taken from the highest to the lowest. The
    suffixes of a group point to their previous smaller one, whose Lyndon prefix thereby grows by the group's,
    as often as suffixes point to it; those move to groups of their own, right above what is left of theirs.
    Then the groups, whose order is final, are filled: each suffix in order puts the suffixes whose Lyndon prefix
    ends where it begins at the next place of their groups. No ranks are renamed and nothing is sorted again."""
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    group = [0] * n  # the first place of the suffix's group
    members: dict[int, list[int]] = {}
    first = [False] * n
    size = [0] * n
    at = 0
    for place, i in enumerate(order):
        if place and s[i] != s[order[place - 1]]:
            at = place
        if not first[at]:
            first[at], members[at] = True, []
        members[at].append(i)
        group[i] = at
        size[at] += 1
    before = [-1] * n
    for g in range(n - 1, 0, -1):
        if not first[g]:
            continue
        mine = members.pop(g)
        if size[g] == 1:
            for i in mine:
                if group[i] == g:
                    p = i - 1
                    while p >= 0 and group[p] >= g:
                        p = before[p]
                    before[i] = p
                    break
            if p >= 0:
                h = group[p]
                if size[h] > 1:  # the only one of its group to grow goes to its top
                    size[h] -= 1
                    top = h + size[h]
                    first[top], size[top], members[top], group[p] = True, 1, [p], top
            continue
        times: dict[int, int] = {}
        for i in sorted(i for i in mine if group[i] == g):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        grown: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            grown.setdefault((-k, group[p]), []).append(p)
        for (_, h), ps in sorted(grown.items()):  # those that grew most stand highest
            if len(ps) < size[h]:
                size[h] -= len(ps)
                top = h + size[h]
                first[top], size[top], members[top] = True, len(ps), ps
                for p in ps:
                    group[p] = top
    out = [-1] * n
    free = list(range(n))
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for place in range(n):
        j = out[place] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


_rng = np.random.default_rng(1709)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, t, 2**64)) for t in (1, 2, 4, 8, 16)]
PLACE = 24  # bits of a place in the text that is read at once


def anchored(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, left key, right key, anchor, first window, last window) of each run of windows with the same anchor.

    ``data`` holds texts one after another, each up to its ``ends``; windows are WIDTH bytes of one text, and
    a window's anchor is the leftmost of its GRAM-byte strings with the least 40 high hash bits. Every window
    also holds the SIDE bytes before its anchor or those after the anchor's string: the keys, whose high bits are
    those of the hash, tell these, so that a window whose key is nowhere else is not repeated."""
    none = np.zeros(0, np.int64)
    empty = (*[none.astype(np.uint64)] * 3, none, none, none)
    if len(data) < WIDTH:
        return empty
    h = _BYTE[data]
    for k, t in enumerate((1, 2, 4, 8, 16)):
        h = h[:-t] * _MULT[k] + h[t:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << PLACE) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    wide, grams = 1, WIDTH - GRAM + 1
    while 2 * wide <= grams:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if grams > wide:
        least = np.minimum(least[: -(grams - wide)], least[grams - wide :])
    at = (least & low).astype(np.int64)
    inside = np.zeros(len(at), bool)
    begin = 0
    for end in ends.tolist():
        if end - begin >= WIDTH:
            inside[begin : end - WIDTH + 1] = True
        begin = end
    windows = np.flatnonzero(inside)
    if not len(windows):
        return empty
    at = at[windows]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    last = np.append(new[1:], len(at)) - 1
    p = at[new]

    def key(*offsets: int) -> np.ndarray:
        """Of the GRAM-byte strings at these offsets from the anchor; where they leave the data, no window has them."""
        x = h[p]
        for o in offsets:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[np.clip(p + o, 0, len(h) - 1)])
        return (h[p] & ~low) | (x & low)

    return h[p], key(-SIDE, -SIDE + GRAM, -GRAM), key(GRAM, 2 * GRAM, SIDE) ^ np.uint64(1), p, windows[new], windows[last]


def repeated_windows(pieces: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For each of the distinct ``pieces`` (bytes, place of the anchor): where the windows start that also start elsewhere in them."""
    shift = [a % STEP for _, a in pieces]
    count = [(len(t) - x) // STEP for (t, _), x in zip(pieces, shift, strict=True)]
    blocks = [np.frombuffer(t, "<u8", n, x) for (t, _), x, n in zip(pieces, shift, count, strict=True)]
    known, ranks = np.unique(np.concatenate(blocks), return_inverse=True)
    begins = np.cumsum([0, *(n + 1 for n in count)])
    text = np.ones(begins[-1] + 1, np.int64)  # 1 stands between pieces, 0 at the end
    text[-1] = 0
    inside = np.ones(begins[-1] + 1, bool)
    inside[begins[1:] - 1] = False
    inside[-1] = False
    text[inside] = ranks + 2
    piece = np.repeat(np.arange(len(pieces)), np.asarray(count) + 1)
    order = np.asarray(suffix_array(text.tolist()), np.int64)
    order = order[order < begins[-1]]
    j = order - begins[piece[order]]
    order = order[np.asarray(count)[piece[order]] - j >= SYMBOLS]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(SYMBOLS):
        same &= text[order[1:] + k] == text[order[:-1] + k]
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    size = np.bincount(run) if len(run) else run
    many = size[run] > 1 if len(run) else np.zeros(0, bool)
    order, run = order[many], run[many]
    # bytes of the pieces, with room on both sides
    length = np.array([len(t) for t, _ in pieces])
    at = np.cumsum(np.concatenate([[STEP], length + 2 * STEP]))[:-1]
    data = np.frombuffer(bytes(STEP) + b"".join(t + bytes(2 * STEP) for t, _ in pieces) + bytes(STEP), np.uint8)
    own = piece[order]
    place = np.asarray(shift)[own] + STEP * (order - begins[own])  # in its piece
    eight = np.arange(STEP)

    def word(where: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(data[where[:, None] + eight]).view("<u8")[:, 0]

    left, right = word(at[own] + place - STEP), word(at[own] + place + STEP * SYMBOLS)
    out = [np.zeros(max(0, n - WIDTH + 1), bool) for n in length]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for e in range(STEP):  # windows with e bytes before their whole symbols
        bits = np.uint64(8 * e)
        value = right if not e else (right << bits) | (left >> np.uint64(64 - 8 * e))
        fits = (place >= e) & (place - e + WIDTH <= length[own])
        r, v, o, p = run[fits], value[fits], own[fits], place[fits] - e
        by = np.lexsort((v, r))
        r, v, o, p = r[by], v[by], o[by], p[by]
        equal = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
        twice = np.concatenate([equal, [False]]) | np.concatenate([[False], equal]) if len(r) else np.zeros(0, bool)
        found.append((o[twice], p[twice]))
    o, p = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    by = np.argsort(o, kind="stable")
    o, p = o[by], p[by]
    cuts = np.searchsorted(o, np.arange(len(pieces) + 1))
    for k in np.unique(o).tolist():
        out[k][p[cuts[k] : cuts[k + 1]]] = True
    return out


def stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """The bytes that windows at these (sorted) places cover, as maximal runs."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > WIDTH)
    first = starts[np.concatenate([[0], new + 1])]
    last = starts[np.concatenate([new, [len(starts) - 1]])] + WIDTH
    return list(zip(first.tolist(), last.tolist(), strict=True))
