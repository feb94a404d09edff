"""The pass over one block of the leader election (JN-6), on arrays.

Rows come in batch order.  A row is settled as soon as earlier rows settle it, whatever stands beyond the block:

* it matches an earlier settled leader: it follows (``OUT``);
* else it matches an earlier row that is not settled, or is itself a guest from a neighbouring block: ``UNSURE``;
* else it leads.

What a row follows is the first leader it matches; while an unsure row before that leader matches too, the row is pending.
Settled leaders and unsure rows are looked up in sorted runs by (amount cell, time).  Leaders do not match each other,
so few of them lie around a row; of the unsure rows a few next in time are tried, and a row that cannot tell counts as
unsure or pending, which later rounds settle.  Memory is that of the leaders and unsure rows, not of the block.
"""

from __future__ import annotations

import numpy as np

from spendlake.config import STATUS_AUTO, STATUS_PROBABLE, DedupSettings

MICROS_PER_MIN = 60_000_000
# kinds of rows that come in
HOME, GUEST, LEADER, PENDING = 0, 1, 2, 3
# states that go out; SHOWN: a settled leader that was a guest elsewhere, needed there in the next round
UNSURE, WAITING, SHOWN, SETTLED = 0, 1, 2, 3
TIME_BITS, TIME_SHIFT, CELLS = 42, 17, (1 << 20) - 1  # time in units of 0.13 s, years 1 to 9999; amount cells may share a number
PAIRS = 2_000_000  # pairs looked at together
CLOSE = (2, 16)  # unsure rows tried before and after a row in time
LAST = np.iinfo(np.int64).max


def apart(us: np.ndarray, reach: int) -> np.ndarray:
    return np.clip(((us + reach) >> TIME_SHIFT) + (1 << (TIME_BITS - 1)), 0, (1 << TIME_BITS) - 1)


class Rows:
    """Columns of rows: time, amount, merchant and direction numbers, key, place in the order, amount cell, code."""

    names = ("us", "amount", "merchant", "direction", "key", "place", "cell", "code")

    def __init__(self, *columns):
        for name, column in zip(self.names, columns):
            setattr(self, name, column)

    def __len__(self):
        return len(self.us)

    def take(self, at) -> Rows:
        return Rows(*(getattr(self, n)[at] for n in self.names))


class Seen:
    """Rows met before, in runs sorted by code; a run is merged with the one before it when that is not much longer."""

    def __init__(self):
        self.runs: list[Rows] = []

    def __len__(self):
        return sum(map(len, self.runs))

    def add(self, rows: Rows) -> None:
        if not len(rows):
            return
        parts = [rows]
        while self.runs and len(self.runs[-1]) <= 8 * sum(map(len, parts)):
            parts.insert(0, self.runs.pop())
        whole = parts[0] if len(parts) == 1 else Rows(*(np.concatenate([getattr(p, n) for p in parts]) for n in Rows.names))
        self.runs.append(whole.take(np.argsort(whole.code, kind="stable")))


class Block:
    """One block of the election; ``pass_`` takes its rows piece by piece, in order."""

    def __init__(self, s: DedupSettings, t_width: int, a_width: float | None):
        self.window, self.gap_limit, self.tolerance = s.time_window_minutes, s.max_date_gap_hours * 60, s.amount_tolerance
        self.t_width, self.a_width = t_width, a_width
        self.around = (0,) if a_width is None else (-1, 0, 1)
        self.leaders, self.unsure, self.place = Seen(), Seen(), 0
        self.names: dict[str, int] = {"": 0}
        self.texts, self.table = [""], None

    # -- values ---------------------------------------------------------------

    def numbers(self, column) -> np.ndarray:
        """The texts as numbers; 0 is the empty text."""
        coded = column.dictionary_encode()
        told = np.empty(len(coded.dictionary), np.int64)
        for i, text in enumerate(coded.dictionary.to_pylist()):
            told[i] = self.names.setdefault(text, len(self.texts))
            if told[i] == len(self.texts):
                self.texts.append(text)
        return told[coded.indices.to_numpy(zero_copy_only=False)]

    def forget(self) -> None:
        """Drops the texts that no leader or unsure row has."""
        held = [*self.leaders.runs, *self.unsure.runs]
        if len(self.texts) < 2 * sum(map(len, held)) + 100_000:
            return
        kept = np.unique(np.concatenate([[0], *[r.merchant for r in held], *[r.direction for r in held]]))
        for r in held:
            r.merchant, r.direction = np.searchsorted(kept, r.merchant), np.searchsorted(kept, r.direction)
        self.texts = [self.texts[i] for i in kept]
        self.names, self.table = {t: i for i, t in enumerate(self.texts)}, None

    def rows(self, us, amount, merchant, direction, key) -> Rows:
        if self.a_width is None:
            bits = (amount + 0.0).view(np.int64)
            cell = (bits ^ (bits >> 21) ^ (bits >> 42)) & CELLS
        else:
            cell = np.clip(amount // self.a_width, -(2.0**62), 2.0**62).astype(np.int64)
        place = np.arange(self.place, self.place + len(us))
        self.place += len(us)
        return Rows(us, amount, merchant, direction, key, place, cell, ((cell & CELLS) << TIME_BITS) + apart(us, 0))

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merchants contain one another."""
        contain = lambda x, y: bool(x and y and (x in y or y in x))
        if len(self.texts) <= 200:
            if self.table is None or len(self.table) < len(self.texts):
                self.table = np.array([[contain(x, y) for y in self.texts] for x in self.texts])
            return self.table[a, b]
        told = (a == b) & (a > 0)
        other = np.flatnonzero(a != b)
        if len(other):
            x, y = np.minimum(a[other], b[other]), np.maximum(a[other], b[other])
            pairs, which = np.unique((x << 32) + y, return_inverse=True)
            told[other] = np.array([contain(self.texts[p >> 32], self.texts[p & 0xFFFFFFFF]) for p in pairs.tolist()], bool)[which]
        return told

    def matching(self, a: Rows, i: np.ndarray, b: Rows, j: np.ndarray) -> np.ndarray:
        """Numbers of the pairs (a[i], b[j]) that match, ascending."""
        at = np.flatnonzero(~(np.abs(a.amount[i] - b.amount[j]) > self.tolerance))
        i, j = i[at], j[at]
        minutes = np.abs(a.us[i] - b.us[j]) / MICROS_PER_MIN
        found = (minutes <= self.window) & ~(minutes > self.gap_limit)
        far = np.flatnonzero(~found & (minutes <= 120) & ~(minutes > self.gap_limit) & (a.direction[i] == b.direction[j]))
        found[far] = self.alike(a.merchant[i[far]], b.merchant[j[far]])
        return at[found]

    def surely(self, a: Rows, i: np.ndarray, b: Rows, j: np.ndarray) -> np.ndarray:
        """Whether the status of matching pairs is STATUS_AUTO."""
        return (np.abs(a.us[i] - b.us[j]) / MICROS_PER_MIN <= self.window) & self.alike(a.merchant[i], b.merchant[j])

    # -- lookups --------------------------------------------------------------

    def spans(self, q: Rows, run: Rows, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the part of the run in reach, in the amount cell ``shift`` away."""
        base = ((q.cell + shift) & CELLS) << TIME_BITS
        return (np.searchsorted(run.code, base + apart(q.us, -self.t_width), "left"),
                np.searchsorted(run.code, base + apart(q.us, self.t_width), "right"))

    @staticmethod
    def pairs(low: np.ndarray, high: np.ndarray):
        """(row, place in the run) of all places from low to high, some at a time."""
        rows = np.flatnonzero(high > low)
        count = (high - low)[rows]
        ends = np.cumsum(count)
        start = 0
        while start < len(rows):
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + PAIRS, "right")), start + 1)
            some = count[start:stop]
            first = np.repeat(low[rows[start:stop]] - (ends[start:stop] - some - done), some)
            yield np.repeat(rows[start:stop], some), first + np.arange(len(first))
            start = stop

    def first_leader(self, q: Rows, seen: Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (LAST: none), key and sureness of the first leader before each row that it matches."""
        place, key, sure = np.full(len(q), LAST), np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        for run in seen.runs:
            for shift in self.around:
                for i, j in self.pairs(*self.spans(q, run, shift)):
                    at = self.matching(q, i, run, j)
                    at = at[run.place[j[at]] < q.place[i[at]]]
                    if not len(at):
                        continue
                    i, j = i[at], j[at]
                    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    least = np.minimum.reduceat(run.place[j], starts)
                    pick = np.flatnonzero(run.place[j] == np.repeat(least, np.diff(np.r_[starts, len(i)])))
                    i, j = i[pick], j[pick]
                    better = run.place[j] < place[i]
                    i, j = i[better], j[better]
                    place[i], key[i], sure[i] = run.place[j], run.key[j], self.surely(q, i, run, j)
        return place, key, sure

    def may_match(self, q: Rows, seen: Seen, before: np.ndarray | None = None) -> np.ndarray:
        """Whether an earlier row of ``seen`` matches (with a key under ``before``), or too many are near to tell."""
        told = np.zeros(len(q), bool)
        for run in seen.runs:
            for shift in self.around:
                left = np.flatnonzero(~told)
                if not len(left):
                    return told
                some = q.take(left)
                low, high = self.spans(some, run, shift)
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                left, some, low, high = left[hit], some.take(hit), low[hit], high[hit]
                middle = np.searchsorted(run.code, (((some.cell + shift) & CELLS) << TIME_BITS) + apart(some.us, 0))
                for close in CLOSE:
                    open_ = np.flatnonzero(~told[left])
                    for i, j in self.pairs(np.maximum(low, middle - close)[open_], np.minimum(high, middle + close)[open_]):
                        at = self.matching(some, open_[i], run, j)
                        i, j = open_[i[at]], j[at]
                        good = run.place[j] < some.place[i] if before is None else run.key[j] < before[left[i]]
                        told[left[i[good]]] = True
                told[left] |= (low < middle - close) | (high > middle + close)
        return told

    # -- the pass -------------------------------------------------------------

    def settle(self, q: Rows, rest: np.ndarray, forced: np.ndarray, open_: np.ndarray, place, key, sure):
        """Which of the rows at ``rest``, that no leader of the pieces before matches, lead and which are unsure (``open_``: unsure
        unless they follow); the others get place, key and sureness of the leader they follow."""
        fresh, doubt = Seen(), Seen()
        leads, unsure = np.zeros(len(q), bool), np.zeros(len(q), bool)
        parts = [rest]
        while parts:
            part = parts.pop()
            free = part[~forced[part]]
            if fresh.runs:
                found = self.first_leader(q.take(free), fresh)
                hit = found[0] < LAST
                place[free[hit]], key[free[hit]], sure[free[hit]] = (f[hit] for f in found)
                free = free[~hit]
                part = np.sort(np.concatenate([part[forced[part]], free]))
            if doubt.runs:
                free = free[~open_[free]]
                open_[free] = self.may_match(q.take(free), doubt)
            if not len(part):
                continue
            some = q.take(part)
            order = np.argsort(some.code, kind="stable")
            run = some.take(order)
            spans = [self.spans(run, run, shift) for shift in self.around if shift >= 0]
            spans[0] = (np.arange(len(run)) + 1, spans[0][1])
            if len(part) > 512 and sum(int((high - low).clip(0).sum()) for low, high in spans) > 16 * len(part):
                half = len(part) // 2
                parts += [part[half:], part[:half]]
                continue
            met = []
            for low, high in spans:
                for i, j in self.pairs(low, high):
                    at = self.matching(run, i, run, j)
                    met.append(np.sort(np.stack([order[i[at]], order[j[at]]]), axis=0))
            earlier, later = np.concatenate(met, axis=1) if met else np.zeros((2, 0), np.int64)
            by = np.lexsort((earlier, later))
            state = np.where(forced[part], 1, np.where(open_[part], 2, 1)).tolist()  # 1: leads, 2: unsure, 0: follows
            fixed = forced[part].tolist()
            row, skip, first = -1, False, []
            for r, e in zip(later[by].tolist(), earlier[by].tolist()):
                if r != row:
                    row, skip = r, fixed[r]
                if skip:
                    continue
                after = state[e]
                if after == 1:
                    state[r], skip = 0, True
                    first.append((r, e))
                elif after == 2:
                    state[r] = 2
            if first:
                r, e = np.array(first).T
                place[part[r]], key[part[r]], sure[part[r]] = some.place[e], some.key[e], self.surely(some, r, some, e)
            state = np.array(state)
            leads[part[state == 1]], unsure[part[state == 2]] = True, True
            fresh.add(some.take(state == 1))
            doubt.add(some.take(state == 2))
        return leads, unsure

    def pass_(self, kind, shown, us, amount, merchant, direction, key, told_key, told_sure):
        """State, key of the leader (0 if none), whether there is one, and sureness for the next rows of the block."""
        q = self.rows(us, amount, merchant, direction, key)
        place, best, sure = np.full(len(q), LAST), np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        asks = np.flatnonzero((kind == HOME) | (kind == GUEST))
        place[asks], best[asks], sure[asks] = self.first_leader(q.take(asks), self.leaders)
        rest = np.flatnonzero((kind == LEADER) | ((place == LAST) & (kind != PENDING)))
        open_ = kind == GUEST
        mine = rest[kind[rest] == HOME]
        open_[mine] = self.may_match(q.take(mine), self.unsure)
        leads, unsure = self.settle(q, rest, kind == LEADER, open_, place, best, sure)
        self.leaders.add(q.take(leads))
        self.unsure.add(q.take(unsure))
        waits = np.flatnonzero(kind == PENDING)
        if len(waits):
            found, k, how = self.first_leader(q.take(waits), self.leaders)
            newer = (found < LAST) & (k < told_key[waits])
            best[waits], sure[waits] = np.where(newer, k, told_key[waits]), np.where(newer, how, told_sure[waits])
            place[waits] = 0
        follows = np.flatnonzero((place < LAST) & ((kind == HOME) | (kind == PENDING)))
        state = np.where(unsure, UNSURE, np.where(leads & shown, SHOWN, SETTLED)).astype(np.int32)
        state[follows[self.may_match(q.take(follows), self.unsure, best[follows])]] = WAITING
        self.forget()
        return state, best, place < LAST, sure


# -- blocks -------------------------------------------------------------------

def cut_tree(us: np.ndarray, amount: np.ndarray, most: float, t_reach: int, a_reach: float):
    """Blocks of about ``most`` of the given points: a tree of (axis, cut, below, from) with numbered leaves, and the
    (least, end) of time and amount of each leaf.

    A cut goes where the fewest points are within reach of it, along either axis; no block is narrower than
    three times the reach."""
    leaves: list[tuple] = []

    def grow(us, amount, box):
        best = None
        if len(us) > most:
            for axis, (values, reach) in enumerate(((us, t_reach), (amount, a_reach))):
                values = np.sort(values)
                for share in range(5, 16):
                    cut = values[len(values) * share // 20]
                    if cut == values[0] or min(cut - max(box[axis][0], values[0]), min(box[axis][1], values[-1]) - cut) < 3 * reach:
                        continue
                    near = np.searchsorted(values, cut + reach, "right") - np.searchsorted(values, cut - reach)
                    if best is None or (near, abs(share - 10)) < best[:2]:
                        best = (near, abs(share - 10), axis, cut.item())
        if best is None:
            leaves.append(box)
            return len(leaves) - 1
        axis, cut = best[2:]
        below = (us if axis == 0 else amount) < cut
        low, high = [*box], [*box]
        low[axis], high[axis] = (box[axis][0], cut), (cut, box[axis][1])
        return axis, cut, grow(us[below], amount[below], low), grow(us[~below], amount[~below], high)

    wide = (-np.inf, np.inf)
    return grow(us, amount, [wide, wide]), leaves


def block_of(tree, us: np.ndarray, amount: np.ndarray) -> np.ndarray:
    out = np.zeros(len(us), np.int32)
    todo = [(tree, np.arange(len(us)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, tuple):
            out[at] = node
        elif len(at):
            axis, cut, below, above = node
            low = (us if axis == 0 else amount)[at] < cut
            todo += [(below, at[low]), (above, at[~low])]
    return out

