"""Edit distances of many pairs of texts at once: bigrams rule most pairs out, bit vectors of a band give the distance of the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The largest distance that a band of 32 diagonals holds; texts of one block that are compared as one matrix; pairs of one step, and of one whose texts share beginnings; columns between two looks at which pairs are out; words of the windows of one matrix; lengths of texts that may share beginnings.
BAND, SLAB, STEP, MEET, LOOK, WINDOWS, WIDE = 31, 1024, 8192, 65536, 8, 1 << 23, 8


class Texts:
    """Texts as rows of codes, sorted by length; codes number the characters of all texts that are compared, 0 stands behind their ends."""

    def __init__(self, texts: list[str], codes: dict[str, int]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(lengths, kind="stable")
        self.length = lengths[self.order]
        self.codes = np.zeros((len(texts), int(lengths.max(initial=0)) + 1), np.int32)
        for row, i in enumerate(self.order):
            self.codes[row, : lengths[i]] = [codes[c] for c in texts[i]]

    def grams(self, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, gram) of all bigrams; a gram's second, third... in a text count as others, so that shared ones are those that both have."""
        gram = self.codes[:, :-1].astype(np.int64) * alphabet + self.codes[:, 1:]
        row, at = np.nonzero(self.codes[:, 1:])
        gram = gram[row, at]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        return row, (gram << 20) + (np.arange(len(row)) - first)

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each text, ids at each look): texts of WIDE lengths that are alike up to a look have one id there, and stand side by side."""
        kind = self.length // WIDE
        order = np.lexsort((*self.codes.T[::-1], kind))
        codes, kind = self.codes[order], kind[order]
        alike = np.argmax(np.concatenate([codes[1:] != codes[:-1], np.ones((max(len(codes) - 1, 0), 1), bool)], 1), 1)
        alike[kind[1:] != kind[:-1]] = -1
        looks = -(-self.codes.shape[1] // LOOK)
        ids = np.zeros((looks, len(order)), np.int32)
        for k in range(looks):
            ids[k, order[1:]] = np.cumsum(alike < (k + 1) * LOOK)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place, ids


def most(longest: np.ndarray, least: float) -> np.ndarray:
    """The distance that a likeness of least allows."""
    return np.floor((1 - least) * longest + 1e-9).astype(np.int64)


def windows(codes: np.ndarray, alphabet: int, columns: int) -> np.ndarray:
    """(start, text, character): bit b stands where the text has the character at start + b, starts from -BAND on; character 0, which stands behind an end, is everywhere."""
    out = np.zeros((columns + BAND + 1, len(codes), alphabet), np.uint32)
    rows = np.arange(len(codes))
    for start in range(codes.shape[1] - 1, -BAND - 1, -1):
        np.left_shift(out[start + BAND + 1], np.uint32(1), out=out[start + BAND])
        if start >= 0:
            out[start + BAND][rows, codes[:, start]] |= np.uint32(1)
    out[:, :, 0] = 0xFFFFFFFF
    return out


def banded(match: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) of texts of m characters, given by their windows, and texts y of n, its columns first; limit + 1 for one above its limit, which is BAND at most. Lengths differ by the limit at most.

    Hyyrö's bit vectors of a diagonal band: bit b at column t stands for row t - below + b, where below is what the limit leaves to
    diagonals under the first one. The distance is the number of steps that cost along the diagonal of the last cell; rows above
    the first cost, columns behind an end do not. It only grows, so that a pair over its limit is out.
    """
    u = np.uint32
    shift = m[i] - n[j]
    below = (limit - shift) // 2
    rows, alphabet = match.shape[1:]
    flat, turn = match.ravel(), rows * alphabet
    at = ((BAND - below) * rows + i) * alphabet
    here, out, end = np.arange(len(i)), limit + 1, int(n[j].max(initial=0))
    last, spare = (shift + below).astype(u), (limit - np.maximum(shift, 0)).astype(np.int32)
    positive, negative, free = u(0xFFFFFFFF) << below.astype(u), np.zeros(len(i), u), np.zeros(len(i), u)
    a, b, c = (np.empty(len(i), u) for _ in range(3))
    for t in range(end):
        same = flat.take(y[t].take(j) + at)
        at += turn
        np.bitwise_and(same, positive, out=a)
        a += positive
        a ^= positive
        a |= same
        a |= negative  # steps along a diagonal that cost nothing
        np.right_shift(a, last, out=b)
        b &= u(1)
        free += b
        np.bitwise_or(a, positive, out=b)
        np.invert(b, out=b)
        b |= negative
        np.bitwise_and(a, positive, out=c)
        a >>= u(1)
        np.bitwise_and(a, b, out=negative)
        np.bitwise_or(a, b, out=positive)
        np.invert(positive, out=positive)
        positive |= c
        if t % LOOK == LOOK - 1:
            left = np.flatnonzero(t + 1 - free.astype(np.int32) <= spare)
            if len(left) < 0.8 * len(free):
                here, at, j, last, spare, positive, negative, free = (v.take(left) for v in (here, at, j, last, spare, positive, negative, free))
                a, b, c = (v[: len(left)] for v in (a, b, c))
                if not len(left):
                    break
    out[here] = np.minimum(out[here], out[here] - 1 - spare + end - free.astype(np.int64))
    return out


def banded_once(match: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, below: np.ndarray) -> np.ndarray:
    """As banded, for pairs in the order of i and of the places of j: from look to look, what texts y with one id at the next are to one x is computed once.

    The band is that of all lengths of one kind, with below diagonals under the first one. The cost is counted along the first
    diagonal; that along the diagonal of a pair's last cell differs by the steps between the two, which the bits of the column tell.
    """
    u = np.uint32
    shift = m[i] - n[j]
    size = np.abs(shift)
    between = (((np.int64(1) << size) - 1) << (below - np.where(shift < 0, size, 0))).astype(u)
    sign, limit, out, here = np.sign(shift).astype(np.int32), limit.astype(np.int32), limit + 1, np.arange(len(i))
    rows, alphabet = match.shape[1:]
    flat, turn = match.ravel(), rows * alphabet
    at, first, of = ((BAND - below) * rows + i) * alphabet, below.astype(u), np.arange(len(i))
    positive, negative, free = u(0xFFFFFFFF) << first, np.zeros(len(i), u), np.zeros(len(i), u)
    looks, d = -(-int(n[j].max(initial=0)) // LOOK), size
    for look in range(looks):
        begins = ids[look].take(j)
        new = np.ones(len(j), bool)
        new[1:] = (begins[1:] != begins[:-1]) | (i[1:] != i[:-1])
        heads = np.flatnonzero(new)
        at, first, positive, negative, free = (v.take(of.take(heads)) for v in (at, first, positive, negative, free))
        of, text = np.cumsum(new) - 1, j.take(heads)
        a, b, c = (np.empty(len(heads), u) for _ in range(3))
        for t in range(look * LOOK, (look + 1) * LOOK):
            same = flat.take(y[t].take(text) + at)
            at += turn
            np.bitwise_and(same, positive, out=a)
            a += positive
            a ^= positive
            a |= same
            a |= negative  # steps along a diagonal that cost nothing
            np.right_shift(a, first, out=b)
            b &= u(1)
            free += b
            np.bitwise_or(a, positive, out=b)
            np.invert(b, out=b)
            b |= negative
            np.bitwise_and(a, positive, out=c)
            a >>= u(1)
            np.bitwise_and(a, b, out=negative)
            np.bitwise_or(a, b, out=positive)
            np.invert(positive, out=positive)
            positive |= c
        if look < looks - 1 and (look + 1) * LOOK < limit.min():
            continue  # hardly any pair is out so early
        up, down = (np.bitwise_count(v.take(of) & between).astype(np.int32) for v in (positive, negative))
        d = ((look + 1) * LOOK - free.astype(np.int32)).take(of) + sign * (up - down)
        left = np.flatnonzero(d <= limit)
        if len(left) < len(d):
            here, i, j, of, between, sign, limit, d = (v.take(left) for v in (here, i, j, of, between, sign, limit, d))
            if not len(left):
                return out
    out[here] = d
    return out


def by_windows(x: Texts, i: np.ndarray, width: int, alphabet: int, step: int) -> Iterator[tuple[slice, int, int, np.ndarray]]:
    """(pairs, first text, end, windows of these texts) of the pairs of texts i, which come in order, step at a time."""
    rows = max(1, WINDOWS // (alphabet * (width + BAND + 1)))
    for lo in range(int(i[0]), int(i[-1]) + 1, rows):
        start, stop = np.searchsorted(i, (lo, lo + rows))
        if start < stop:
            hi = int(i[stop - 1]) + 1
            match = windows(x.codes[lo:hi, :width], alphabet, width)
            for k in range(start, stop, step):
                yield slice(k, min(k + step, stop)), lo, hi, match


def distances(x: Texts, y: Texts, columns: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, alphabet: int) -> np.ndarray:
    """Distances of the pairs (i, j), which come in the order of i, as banded gives them; -1 where the limit is over BAND. columns: the codes of y, columns first, as far as texts within BAND go."""
    d = np.full(len(i), -1, np.int64)
    narrow = np.flatnonzero(limit <= BAND)
    if len(narrow):
        width = int(max(x.length[i[narrow]].max(), y.length[j[narrow]].max()))
        for some, lo, hi, match in by_windows(x, i[narrow], width, alphabet, STEP):
            p = narrow[some]
            d[p] = banded(match, x.length[lo:hi], columns, y.length, i[p] - lo, j[p], limit[p])
    return d


def bands(lengths: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """(length of x, kind of y): diagonals under the first one in a band for all y of the kind; -1 where 32 diagonals do not hold it."""
    m, low = lengths[:, None], np.arange(0, len(lengths), WIDE)[None]
    high = low + WIDE - 1
    to = np.minimum(np.maximum(m, high), len(lengths) - 1)
    below, above = (changes[to] - m + high) // 2, (changes[np.maximum(m, low)] + m - low + 1) // 2
    below, above = (np.clip(v, 0, changes[to]) for v in (below, above))
    return np.where(below + above <= BAND, below, -1)


def distances_by_beginnings(x: Texts, y: Texts, columns: np.ndarray, ids: np.ndarray, below: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, alphabet: int) -> np.ndarray:
    """As distances, for pairs that come in the order of i and of the places of j."""
    under = below[x.length[i], y.length[j] // WIDE]
    d = np.empty(len(i), np.int64)
    rest, own = np.flatnonzero(under < 0), np.flatnonzero(under >= 0)
    d[rest] = distances(x, y, columns, i[rest], j[rest], limit[rest], alphabet)
    if len(own):
        width = -(-int(max(x.length[i[own]].max(), y.length[j[own]].max())) // LOOK) * LOOK
        for some, lo, hi, match in by_windows(x, i[own], width, alphabet, MEET):
            p = own[some]
            d[p] = banded_once(match, x.length[lo:hi], columns, y.length, ids, i[p] - lo, j[p], limit[p], under[p])
    return d


def by_columns(y: Texts, changes: np.ndarray) -> np.ndarray:
    """The codes of texts, columns first, as far as texts go that may differ by BAND at most."""
    codes = y.codes[:, : int(np.searchsorted(changes, BAND, "right"))]
    out = np.zeros((-(-codes.shape[1] // LOOK) * LOOK, len(codes)), np.intp)
    out[: codes.shape[1]] = codes.T
    return out


def listed_pairs(xs: list[str], ys: list[str], i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of those of the listed pairs of xs and ys that close_pairs would give: for many small groups."""
    codes = {c: k for k, c in enumerate(sorted(set().union(*xs, *ys)), 1)}
    x, y = (Texts(texts, codes) for texts in (xs, ys))
    i, j = (np.argsort(t.order)[k] for t, k in ((x, i), (y, j)))
    changes = most(np.arange(max(x.length.max(initial=0), y.length.max(initial=0)) + 1), least)
    limit = changes[np.maximum(x.length[i], y.length[j])]
    near = np.flatnonzero(np.abs(x.length[i] - y.length[j]) <= limit)
    near = near[np.argsort(i[near], kind="stable")]
    i, j, limit = i[near], j[near], limit[near]
    d = distances(x, y, by_columns(y, changes), i, j, limit, len(codes) + 1)
    kept = d <= limit
    return x.order[i[kept]], y.order[j[kept]], d[kept]


def close_pairs(xs: list[str], ys: list[str], least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of xs and ys whose distance leaves a likeness of least; -1 for a distance that is still to be taken, as it may be over BAND. With same, xs are ys, and i < j."""
    codes = {c: k for k, c in enumerate(sorted(set().union(*xs, *ys)), 1)}
    alphabet = len(codes) + 1
    x = Texts(xs, codes)
    y = x if same else Texts(ys, codes)
    gx = x.grams(alphabet)
    gy = gx if same else y.grams(alphabet)
    names, code = np.unique(np.concatenate([gx[1], gy[1]]), return_inverse=True)
    gx, gy = (gx[0], code[: len(gx[0])]), (gy[0], code[len(code) - len(gy[0]) :])
    lengths = np.arange(max(x.length.max(initial=0), y.length.max(initial=0)) + 1)
    changes = most(lengths, least)
    # a change undoes two bigrams at most
    needed = (lengths - 1 - 2 * changes).astype(np.float32)
    columns = by_columns(y, changes)
    seat, ids = y.beginnings()
    below = bands(lengths, changes)
    for lo in range(0, len(xs), SLAB):
        lx = x.length[lo : lo + SLAB]
        for at in range(lo if same else 0, len(ys), SLAB):
            ly = y.length[at : at + SLAB]
            if min(lx[-1], ly[-1]) < least * max(lx[0], ly[0]) - 1e-9:
                continue
            (ra, a), (rb, b) = ((r[(k := slice(*np.searchsorted(r, (s, s + SLAB))))] - s, g[k]) for (r, g), s in ((gx, lo), (gy, at)))
            both = np.zeros((2, len(names)), bool)
            both[0, a], both[1, b] = True, True
            both = both.all(0)
            place = np.cumsum(both) - 1
            shared = np.zeros((len(lx), len(ly)), np.float32)
            for s in range(0, int(both.sum()), 4 * SLAB):
                width = min(4 * SLAB, int(both.sum()) - s)
                fx, fy = np.zeros((len(lx), width), np.float32), np.zeros((len(ly), width), np.float32)
                for f, r, g in ((fx, ra, a), (fy, rb, b)):
                    hit = both[g] & (place[g] >= s) & (place[g] < s + width)
                    f[r[hit], place[g[hit]] - s] = 1
                shared += fx @ fy.T
            ux, nx = np.unique(lx, return_counts=True)
            uy, ny = np.unique(ly, return_counts=True)
            longest = np.maximum(ux[:, None], uy[None])
            least_shared = np.where(np.abs(ux[:, None] - uy[None]) <= changes[longest], needed[longest], np.float32(np.inf))
            maybe = shared >= np.repeat(np.repeat(least_shared, nx, 0), ny, 1)
            if same and lo == at:
                maybe &= np.arange(len(lx))[:, None] < np.arange(len(ly))[None]
            order = np.argsort(seat[at : at + SLAB])
            i, j = np.nonzero(maybe[:, order])
            j = order[j]
            limit = changes[np.maximum(lx[i], ly[j])]
            d = distances_by_beginnings(x, y, columns, ids, below, i + lo, j + at, limit, alphabet)
            kept = d <= limit
            i, j, d = x.order[lo + i[kept]], y.order[at + j[kept]], d[kept]
            yield (np.minimum(i, j), np.maximum(i, j), d) if same else (i, j, d)
