"""Best matches of rows among a stated set of other rows, by bounds instead of by scoring every pair.

The stated rows reach the tasks in parts of bounded size as two indexes. Sets: an inverted index from tokens to the stated rows
that hold them, which counts shared tokens from the rarest on and stops once few rows can still be the best. Texts: the places of
three-character windows, and of the characters that count in a long text. From those the long matching blocks of a row's text with all
stated texts are placed at once, in arrays; what they leave between them bounds the ratio, and a ratio is completed only while its bound
reaches the best so far or a limit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np

#: Tokens are counted so many at a time, rare ones first; this many rows or fewer are then finished one by one.
BLOCK, FEW = 8, 4
#: Stated characters whose places are one index, and equal places of a row's text with those that are held at once; pairs of more are taken one by one.
GROUP, SEEDS = 1 << 16, 1 << 20
#: Places in a text that can be held there have so many bits.
BITS = 20
MASK = (1 << BITS) - 1
#: No characters: what is after each stated text, and before and after a row's text.
GAP, EDGE = (1 << 21) - 1, (1 << 21) - 2
#: Characters of a window, and so of the shortest run that is found from the index; classes of characters that are counted apart between runs.
RUN, CLASSES = 3, 96
#: A row's text of so many characters at most has its characters counted up to each place.
COUNTED = 1 << 16


def segment_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ptr[1:]] - total[ptr[:-1]]


class Sets:
    """An inverted index over sets; None has no similarity to anything."""

    def __init__(self, sets: list[list[str] | None]):
        self.sets = [None if s is None else frozenset(s) for s in sets]
        self.size = np.array([len(s or ()) for s in self.sets], float)
        self.known = np.array([s is not None for s in self.sets], bool)
        places = defaultdict(list)
        for i, s in enumerate(self.sets):
            for t in s or ():
                places[t].append(i)
        self.places = {t: np.array(p) for t, p in places.items()}

    def _jaccard(self, shared: np.ndarray, n: int, rows=slice(None)) -> np.ndarray:
        size = self.size[rows]
        return np.where(shared > 0, shared / np.maximum(n + size - shared, 1), 0.0)

    def all(self, tokens: list[str]) -> np.ndarray:
        """Jaccard similarity to every stated row; not a number where that has no set."""
        met = [self.places[t] for t in set(tokens) if t in self.places]
        shared = np.bincount(np.concatenate(met), minlength=len(self.sets)).astype(float) if met else np.zeros(len(self.sets))
        return np.where(self.known, self._jaccard(shared, len(set(tokens))), np.nan)

    def best(self, tokens: list[str], without: frozenset[int] = frozenset()) -> tuple[int, float] | None:
        """(place, similarity) of the most similar stated row, the first among equals, leaving out some; None if there is none."""
        own = set(tokens)
        open_ = self.known.copy()
        open_[list(without)] = False
        if not open_.any():
            return None
        todo = sorted((t for t in own if t in self.places), key=lambda t: (len(self.places[t]), t))
        shared = np.zeros(len(self.sets))
        while todo:
            now, todo = todo[:BLOCK], todo[BLOCK:]
            shared += np.bincount(np.concatenate([self.places[t] for t in now]), minlength=len(shared))
            least = self._jaccard(shared, len(own))[open_].max()
            open_ &= self._jaccard(np.minimum(shared + len(todo), self.size), len(own)) >= least
            if todo and open_.sum() <= FEW:
                for i in np.flatnonzero(open_).tolist():
                    shared[i] = len(own & self.sets[i])
                break
        value = np.where(open_, self._jaccard(shared, len(own)), -1.0)
        i = int(value.argmax())
        return i, float(value[i])


class Texts:
    """Stated texts for matching-block ratios with a row's text; None has no ratio with anything.

    The ratio ignores characters that a stated text of 200 or more has in over one hundredth of its places, but extends what it
    finds over them. So a block holds a place of another character, or begins where both texts begin. Then there are
    no more blocks than such characters in common and one, a block of k places has k - 2 windows of three characters
    of the stated text that the row's text has too, and no bound but the last needs the texts' order.
    """

    LONG = 200

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        self.known = np.array([t is not None for t in texts], bool)
        self.length = np.array([len(t or "") for t in texts])
        self.index: list[dict[str, list[int]] | None] = [None] * len(texts)
        counts = [Counter(t or "") for t in texts]
        self.chars = np.array([ord(c) for n in counts for c in n], np.int64)
        self.often = np.array([k for n in counts for k in n.values()], np.int64)
        self.char_ptr = np.concatenate([[0], np.cumsum([len(n) for n in counts])]).astype(np.int64)
        common = np.repeat(np.where(self.length >= self.LONG, self.length // 100 + 1, np.iinfo(np.int64).max), np.diff(self.char_ptr))
        self.rare = self.often <= common
        windows = [self._windows(t or "") for t in texts]
        self.windows = np.concatenate(windows) if windows else np.empty(0, np.int64)
        self.window_ptr = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int64)
        self.groups = [Group(self, some) for some in self._grouped()]

    @staticmethod
    def _windows(text: str) -> np.ndarray:
        c = codes(text).astype(np.int64)
        return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else np.empty(0, np.int64)

    def bounds(self, text: str) -> np.ndarray:
        """Above or at the ratio of text and every stated text; not a number where that is None."""
        own = Counter(text)
        places = np.sort(np.array([ord(c) for c in own], np.int64))
        often = np.array([own[chr(c)] for c in places.tolist()], np.int64)
        at = np.minimum(np.searchsorted(places, self.chars), max(0, len(places) - 1))
        both = np.where(places[at] == self.chars, np.minimum(often[at], self.often), 0) if len(places) else np.zeros(len(self.chars), np.int64)
        most = segment_sums(both, self.char_ptr)
        windows = np.unique(self._windows(text))
        at = np.minimum(np.searchsorted(windows, self.windows), max(0, len(windows) - 1))
        met = (windows[at] == self.windows).astype(np.int64) if len(windows) else np.zeros(len(self.windows), np.int64)
        blocks = segment_sums(np.where(self.rare, both, 0), self.char_ptr) + 1
        most = np.minimum(most, segment_sums(met, self.window_ptr) + 2 * blocks)
        total = self.length + len(text)
        return np.where(self.known, np.where(total > 0, 2.0 * most / np.maximum(total, 1), 1.0), np.nan)

    def _grouped(self) -> list[np.ndarray]:
        """Places of stated texts, short ones and long ones apart, in groups of bounded size."""
        out = []
        for some in (np.flatnonzero(self.known & (self.length < self.LONG)), np.flatnonzero(self.known & (self.length >= self.LONG) & (self.length <= MASK))):
            if len(some):
                cut = np.flatnonzero(np.diff(np.cumsum(self.length[some]) // GROUP)) + 1
                out += np.split(some, cut)
        return out

    def matched(self, text: str) -> Matched:
        return Matched(self, text)

    def ratio(self, text: str, i: int) -> float:
        """Twice the places in matching blocks over both lengths, by the rules of difflib's SequenceMatcher(None, text, texts[i])."""
        b = self.texts[i]
        if not text and not b:
            return 1.0
        if self.index[i] is None:
            index = defaultdict(list)
            for j, c in enumerate(b):
                index[c].append(j)
            common = len(b) // 100 + 1 if len(b) >= self.LONG else len(b)
            self.index[i] = {c: p for c, p in index.items() if len(p) <= common}
        count = matching_short if len(b) < self.LONG else matching
        return 2.0 * count(text, b, self.index[i]) / (len(text) + len(b))


def spans(ptr: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each of ptr on, as many as size says."""
    return np.repeat(ptr - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)


class Group:
    """Some stated texts, short or long ones, as one array of characters with a gap after each, and the places of what can begin a block there."""

    def __init__(self, texts: Texts, members: np.ndarray):
        self.members, self.length = members, texts.length[members]
        self.long = bool(self.length[0] >= Texts.LONG)
        self.width = 1 if self.long else RUN
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)[:-1]]).astype(np.int64)
        self.chars = np.full(int(self.length.sum()) + len(members), GAP, np.int64)
        owner = np.repeat(np.arange(len(members)), self.length)
        place = spans(self.start, self.length)
        self.chars[place] = codes("".join(texts.texts[m] for m in members.tolist()))
        if self.long:
            _, at, often = np.unique(owner << 32 | self.chars[place], return_inverse=True, return_counts=True)
            some = often[at] <= self.length[owner] // 100 + 1
        else:
            some = place - self.start[owner] <= self.length[owner] - RUN
        owner, place = owner[some], place[some]
        key = self.chars[place] if self.long else self.chars[place] << 42 | self.chars[place + 1] << 21 | self.chars[place + 2]
        order = np.argsort(key, kind="stable")
        self.key, begin = np.unique(key[order], return_index=True)
        self.ptr = np.append(begin, len(order))
        self.chars = self.chars.astype(np.int32)
        self.owner, self.place = owner[order].astype(np.int32), (place - self.start[owner])[order].astype(np.int32)

    def runs(self, key: np.ndarray) -> np.ndarray | None:
        """Member, place in the row's text, place in the member and length of the runs of equal keys, by member; None if they have more than SEEDS keys."""
        if not len(self.key) or not len(key):
            return np.empty((4, 0), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        i = np.flatnonzero(self.key[at] == key)
        at = at[i]
        size = self.ptr[at + 1] - self.ptr[at]
        if size.sum() > SEEDS:
            return None
        found, n = spans(self.ptr[at], size), len(key)
        i = np.repeat(i, size)
        seeds = np.sort(self.owner[found].astype(np.int64) << 2 * BITS + 1 | (self.place[found] - i + n) << BITS | i)  # by diagonal
        begin = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1] + 1])[: len(seeds)])
        size = np.diff(begin, append=len(seeds)) + self.width - 1
        seeds = seeds[begin]
        i = seeds & MASK
        return np.stack([seeds >> 2 * BITS + 1, i, (seeds >> BITS & 2 * MASK + 1) + i - n, size])

    def extension(self, text: np.ndarray, i: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
        """How far the row's text, with an edge before and after it, and the stated ones stay equal from i and place on."""
        out, at = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(at):
            same = np.flatnonzero(text[i + 1] == self.chars[place])  # gaps end it; place -1 is the last gap
            at, i, place = at[same], i[same] + step, place[same] + step
            out[at] += 1
        return out

    def covered(self, text: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Places by member that can be in a block: those that stay equal from a run on, or from where both texts begin."""
        s, i, j, size = runs
        at = self.start[s] + j
        begin, end = at - self.extension(text, i - 1, at - 1, -1), at + size + self.extension(text, i + size, at + size, 1)
        first = self.extension(text, np.zeros(len(self.start), np.int64), self.start, 1)
        change = np.bincount(np.append(begin, self.start), minlength=len(self.chars) + 1) - np.bincount(np.append(end, self.start + first), minlength=len(self.chars) + 1)
        return np.add.reduceat((np.cumsum(change)[:-1] > 0).astype(np.int64), self.start)

    def placed(self, n: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by member in blocks of RUN characters or more with a row's text of n, and the ranges between them: member, begin and end in either text."""
        count = len(self.members)
        total, rest, zeros = np.zeros(count, np.int64), [], np.zeros(count, np.int64)
        ranges = np.stack([np.arange(count), zeros, zeros + n, zeros, self.length])
        while True:  # runs are within the ranges that they name, and in the order of those
            g, i, j, size = runs
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
            own = g[first]
            free = (ranges[1] < ranges[2]) & (ranges[3] < ranges[4])
            free[own] = False
            rest.append(ranges[:, free])
            if not len(own):
                return total, np.concatenate(rest, axis=1)
            best = np.minimum.reduceat((MASK - size) << 2 * BITS | i << BITS | j, first)  # the longest, the earliest in either text
            p, q, k = best >> BITS & MASK, best & MASK, MASK - (best >> 2 * BITS)
            o, a0, a1, b0, b1 = ranges[:, own]
            total += np.bincount(o, k, count).astype(np.int64)
            h = np.repeat(np.arange(len(own)), np.diff(first, append=len(g)))
            x, y = p[h] - i, q[h] - j
            before = np.minimum(np.minimum(x, y), size)
            skip = np.maximum(np.maximum(x, y) + k[h], 0)
            left, right = np.flatnonzero(before >= RUN), np.flatnonzero(size - skip >= RUN)
            skip = skip[right]
            runs = np.concatenate([[h[left], i[left], j[left], before[left]], [h[right] + len(own), i[right] + skip, j[right] + skip, size[right] - skip]], axis=1)
            ranges = np.concatenate([[o, a0, p, b0, q], [o, p + k, a1, q + k, b1]], axis=1)


class Matched:
    """The matching blocks of a row's text with every stated one: upper bounds, and ratios that are completed on demand.

    A block is the longest run of equal characters in a range of both texts; what is left and right of it are two ranges more. With short stated texts,
    blocks of RUN characters or more are placed in all of them at once, a round for each depth of ranges. What is between them has shorter runs
    only: characters in common bound those, and one range after the other is finished where the bound leaves a ratio open. With long stated texts
    a block holds a character that counts there, so it lies where both texts stay equal around one.
    """

    def __init__(self, texts: Texts, text: str):
        self.texts, self.text, self.known = texts, text, {}
        count, own, windows = len(texts.texts), codes(text).astype(np.int64), Texts._windows(text)
        most, self.least, self.rest = np.zeros(count, np.int64), np.zeros(count, np.int64), {}
        apart = texts.length > MASK  # pairs with too many runs
        edged, counted = np.concatenate([[EDGE], own, [EDGE]]).astype(np.int32), None
        for group in texts.groups:
            runs = group.runs(own if group.long else windows) if len(own) <= MASK else None
            if runs is None:
                apart[group.members] = True
                continue
            if group.long:
                most[group.members] = group.covered(edged, runs)
                continue
            total, ranges = group.placed(len(own), runs)
            s, a0, a1, b0, b1 = ranges = ranges[:, np.argsort(ranges[0], kind="stable")]
            if counted is None and len(own) <= COUNTED:
                counted = np.zeros((len(own) + 1, CLASSES), np.int32)
                counted[np.arange(1, len(own) + 1), own % CLASSES] = 1
                counted = counted.cumsum(axis=0, dtype=np.int32)
            common = np.minimum(a1 - a0, b1 - b0)
            if counted is not None:
                size = b1 - b0
                each = np.repeat(np.arange(len(s)) * CLASSES, size) + group.chars[spans(group.start[s] + b0, size)] % CLASSES
                theirs = np.bincount(each, minlength=len(s) * CLASSES).reshape(len(s), CLASSES)
                common = np.minimum(theirs, counted[a1] - counted[a0]).sum(axis=1)
            self.least[group.members] = total
            most[group.members] = total + np.bincount(s, common, len(total)).astype(np.int64)
            cut = np.searchsorted(s, np.arange(len(total) + 1)).tolist()
            self.rest |= {m: ranges[1:, x:y] for m, x, y in zip(group.members.tolist(), cut, cut[1:])}
        total = texts.length + len(text)
        self.upper = np.where(texts.known, np.where(total > 0, 2.0 * most / np.maximum(total, 1), 1.0), np.nan)
        if apart.any():
            self.upper = np.where(apart, texts.bounds(text), self.upper)

    def ratio(self, i: int) -> float:
        """texts.ratio(text, i)."""
        if i not in self.known:
            self.known[i] = self._finished(i) if i in self.rest else self.texts.ratio(self.text, i)
        return self.known[i]

    def _finished(self, i: int) -> float:
        a, b, total = self.text, self.texts.texts[i], int(self.least[i])
        for a0, a1, b0, b1 in self.rest[i].T.tolist():
            total += shortest_runs(a[a0:a1], b[b0:b1])
        return 2.0 * total / (len(a) + len(b)) if a or b else 1.0


def shortest_runs(a: str, b: str) -> int:
    """Places in matching blocks of texts that share no three characters in a row: pairs are taken from the left, and single ones between them."""
    total = 0
    while True:
        i, j, own = len(a), len(b), set(b)
        if own.isdisjoint(a):
            return total
        if i > 1 and j > 1:
            if j <= i:
                i, j = min(((k, n) for n in range(j - 1) if (k := a.find(b[n : n + 2])) >= 0), default=(i, j))
            else:
                i, j = next(((n, k) for n in range(i - 1) if (k := b.find(a[n : n + 2])) >= 0), (i, j))
        at = 0
        if j:
            for c in a[:i]:
                if c in own and (k := b.find(c, at, j)) >= 0:
                    total, at = total + 1, k + 1
                    if at == j:
                        break
        if i == len(a):
            return total
        total, a, b = total + 2, a[i + 2 :], b[j + 2 :]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def matching_short(a: str, b: str, index: dict[str, list[int]]) -> int:
    """matching() where index has every character of b, as for a short b.

    All runs of two characters or more are listed once, as whole diagonals; a range's longest is the longest of them cut to the
    range. A range without one has single characters only, which are then taken from the left.
    """
    x, y = codes(a), codes(b)
    i, j = np.nonzero((x[:-1, None] == y[None, :-1]) & (x[1:, None] == y[None, 1:])) if len(x) > 1 and len(y) > 1 else (np.empty(0, np.int64),) * 2
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)])) if len(i) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(i))) + 1
    total, todo = 0, [(0, len(a), 0, len(b), i[begin], j[begin], size)]
    while todo:
        a0, a1, b0, b1, i, j, size = todo.pop()
        skip = np.maximum(np.maximum(a0 - i, b0 - j), 0)
        i, j = i + skip, j + skip
        size = np.minimum(np.minimum(size - skip, a1 - i), b1 - j)
        some = size > 1
        i, j, size = i[some], j[some], size[some]
        if not len(size):
            for at in range(a0, a1):
                where = index.get(a[at], ())
                k = bisect_left(where, b0)
                if k < len(where) and where[k] < b1:
                    total, b0 = total + 1, where[k] + 1
            continue
        longest = np.flatnonzero(size == size.max())
        one = longest[np.lexsort((j[longest], i[longest]))[0]]
        p, q, n = int(i[one]), int(j[one]), int(size[one])
        total += n
        if a0 < p and b0 < q:
            todo.append((a0, p, b0, q, i, j, size))
        if p + n < a1 and q + n < b1:
            todo.append((p + n, a1, q + n, b1, i, j, size))
    return total


def matching(a: str, b: str, index: dict[str, list[int]]) -> int:
    """Places in matching blocks: the longest run of characters of index that both texts have (the earliest in a, then in b), extended on both sides, then the same left and right of it."""
    hits = [(i, index[c]) for i, c in enumerate(a) if c in index]
    places = [i for i, _ in hits]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, size = a0, b0, 0
        runs: dict[int, int] = {}
        last = -2
        for at, where in hits[bisect_left(places, a0) : bisect_left(places, a1)]:
            before = runs if at == last + 1 else {}
            runs, last = {}, at
            for x in where if b0 == 0 and b1 == len(b) else where[bisect_left(where, b0) : bisect_left(where, b1)]:
                k = runs[x] = before.get(x - 1, 0) + 1
                if k > size:
                    i, j, size = at - k + 1, x - k + 1, k
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if a0 < i and b0 < j:
                todo.append((a0, i, b0, j))
            if i + size < a1 and j + size < b1:
                todo.append((i + size, a1, j + size, b1))
    return total
