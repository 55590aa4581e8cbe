"""Linearizability of one key's history, decided event by event (just-in-time linearization).

Calls and returns are taken in order. What is carried on is the set of possible register states,
each with the operations still in flight that have taken effect in it, so the work and memory for
an event depend on what overlaps it, not on the length of the history; where nothing is in flight,
only states are left.

- A read takes effect as soon as a state shows its value; that restricts nothing else.
- A write takes effect only if a read in flight asks for its value, or at its own return. It may
  instead stay unseen, just before a later write, if one took effect since its call.
- At a return only what returns takes effect, after any set of writes that reads in flight ask for;
  all of those that no later read can see, and none at all if what returns can't be seen later:
  what need not come before it can come later.
- Of writes of one value the one that returns first is taken: the others can do all it could.
- A state that no later read can see is like any other such state, and having used up a write
  whose value no later read can see is no loss; of configurations that differ in nothing else, the
  one with more reads done stays. A write is seen until the first return of a write called after
  its own return, at most. A configuration whose state no read can see is no better than one with
  any state: that one may let a write take effect where the other leaves it unseen.
- A read whose value no write in flight has, and none called before its return will have, ends all
  configurations that don't show it.
- Operations that took effect in all configurations are no part of them any more, so that the work
  for an event depends on what is still open between them.
- A write without an outcome may take effect at any later point, or never."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math

import pandas as pd

DEAD = (True, object())  # any state that no read will ask for
#: Up to so many configurations are carried on without comparing them.
PRUNE_ABOVE = 16


def _null(x) -> bool:
    return x is None or x != x


class _Bits:
    """Operations in flight as bits of a number; bits are used again."""

    def __init__(self):
        self.bit: dict = {}  # id -> bit
        self.ids: list = []  # place of the bit -> id
        self.free: list = []

    def add(self, i) -> int:
        if self.free:
            place = heapq.heappop(self.free)
            self.ids[place] = i
        else:
            place = len(self.ids)
            self.ids.append(i)
        self.bit[i] = 1 << place
        return self.bit[i]

    def drop(self, i) -> int:
        bit = self.bit.pop(i)
        heapq.heappush(self.free, bit.bit_length() - 1)
        return bit

    def of(self, mask: int) -> list:
        out = []
        while mask:
            low = mask & -mask
            out.append(self.ids[low.bit_length() - 1])
            mask ^= low
        return out


class Search:
    """The verdict on one key's history. max_steps: states examined, at most; None for no limit."""

    def __init__(self, max_steps: int | None = None):
        self.max_steps = max_steps
        self._reset({((False, None), 0, 0): -1})
        self.verdict = "ok"
        self.steps = self.now = 0

    def _reset(self, configs: dict) -> None:
        # Operations in flight or without outcome. A settled one has taken effect in all configurations.
        self.reads: dict = {}  # id -> (the state it asks for, whether a later write can still serve it)
        self.writes: dict = {}  # id -> (state, place of its call, its return, the last read of it)
        self.settled: set = set()
        self.r, self.w = _Bits(), _Bits()  # the bits of reads and writes that are not settled
        self.asks: dict = {}  # state -> bits of such reads
        self.firm: dict = {}  # state -> bits of those that no later write can serve
        self.by_state: dict = {}  # state -> (return, place of its call, bit) of such writes, the first to return first
        self.until: dict = {}  # state -> the last call of a read that can see it, where known
        # (state, writes in flight that took effect, reads in flight that did) -> place of the last write
        self.configs: dict = configs

    def call(self, at, i, op, value, out, found, ok, unknown, ret, until, again=True) -> None:
        """ret: null for none; until, of a write: the last call of a read that asks for its state and
        can see it, null for none; again, of a read: a later write of its state is called before its return."""
        self.now += 1
        if self.verdict != "ok":
            return
        if not unknown and (not ok or i in self.settled or i in self.reads or i in self.writes):
            self._end("illegal")  # failed, or called again before its return
        elif op in ("PUT", "DELETE"):
            state = (True, None if _null(value) else value) if op == "PUT" else (False, None)
            until = -math.inf if _null(until) else until
            if unknown:
                i, ret = (i, self.now), math.inf  # never returns
            self.writes[i] = (state, self.now, ret, until)
            self.until[state] = max(until, self.until.get(state, until))
            bisect.insort(self.by_state.setdefault(state, []), (ret, self.now, self.w.add(i)))
        elif not unknown:
            want = (bool(found), None if not found or _null(out) else out)
            if all(s == want for s, _, _ in self.configs):
                self.settled.add(i)
                return
            self.reads[i] = (want, again)
            bit = self.r.add(i)
            self.asks[want] = self.asks.get(want, 0) | bit
            if not again:
                self.firm[want] = self.firm.get(want, 0) | bit
            writes = self.by_state.get(want, ())
            self.configs = {
                (s, w, r | bit if s == want else r): last for (s, w, r), last in self.configs.items()
                if s == want or again or any(not w & b for _, _, b in writes)
            }
            if not self.configs:
                self._end("illegal")

    def _live(self, state, at) -> bool:
        return state != DEAD and self.until.get(state, math.inf) >= at

    def _prune(self, configs: dict, at) -> dict:
        merged: dict = {}
        for (s, w, r), last in configs.items():
            key = (s if self._live(s, at) else DEAD, w, r)
            merged[key] = max(last, merged.get(key, -1))
        kept: dict = {}
        best: list = []
        taken = 0
        for _, w, _ in merged:
            taken |= w
        live = {b: (self.writes[x][0], self.writes[x][3] >= at) for x in self.w.of(taken) for b in (self.w.bit[x],)}
        for (s, w, r), last in sorted(merged.items(), key=lambda c: (c[0][0] != DEAD, c[0][2].bit_count(), c[1], -c[0][1].bit_count()), reverse=True):
            if not any(not r & ~r2 and not used & ~w and (s == DEAD or s == s2 and last <= last2) for s2, r2, last2, used in best):
                used = 0
                for b, (state, lives) in live.items():
                    if w & b and (lives or self.asks.get(state, 0) & ~r):
                        used |= b
                best.append((s, r, last, used))
                kept[s, w, r] = last
        return kept

    def _settle(self) -> None:
        """Operations that took effect in all configurations need not be told apart any more."""
        w_all = r_all = -1
        for _, w, r in self.configs:
            w_all &= w
            r_all &= r
            if not w_all and not r_all:
                return
        self.configs = {(s, w & ~w_all, r & ~r_all): last for (s, w, r), last in self.configs.items()}
        for i in self.r.of(r_all):
            self._drop_read(i)
            self.settled.add(i)
        for i in self.w.of(w_all):
            if self.writes[i][2] != math.inf:
                self.settled.add(i)
            self._drop_write(i)

    def _drop_read(self, i) -> None:
        want, again = self.reads.pop(i)
        bit = self.r.drop(i)
        for bits in (self.asks,) if again else (self.asks, self.firm):
            bits[want] &= ~bit
            if not bits[want]:
                del bits[want]

    def _drop_write(self, i) -> None:
        state, place, ret, _ = self.writes.pop(i)
        of = self.by_state[state]
        del of[bisect.bisect_left(of, (ret, place, self.w.drop(i)))]
        if not of:
            del self.by_state[state]

    def ret(self, at, i) -> None:
        self.now += 1
        if self.verdict != "ok":
            return
        if i in self.settled:
            self.settled.remove(i)
            return
        if i not in self.reads and i not in self.writes:
            return self._end("illegal")  # returned before its call
        is_read = i in self.reads
        one = self.r.bit[i] if is_read else self.w.bit[i]
        target, since = (self.reads[i][0], 0) if is_read else self.writes[i][:2]
        bits, writes, firm = self.asks.get(target, 0), self.by_state.get(target, ()), self.firm.get(target, 0)
        lives, asked = self._live(target, at), []
        if lives:
            asked = [(b, self.by_state[want], self._live(want, at)) for want, b in self.asks.items() if want != target and want in self.by_state]
        after: dict = {}
        for (state, done, read), last in self.configs.items():
            self.steps += 1
            if (read if is_read else done) & one:
                key = (state, done, read & ~one) if is_read else (state, done & ~one, read)
                after[key] = max(last, after.get(key, -1))
                continue
            used = one
            if is_read:
                used = next((b for _, _, b in writes if not done & b), None)
                if used is None:
                    continue
            elif last > since:
                # Unseen; not where a read in flight can be served by no other write.
                if not firm & ~read or any(b != one and not done & b for _, _, b in writes):
                    key = (state, done, read)
                    after[key] = max(last, after.get(key, -1))
                if not lives and not bits & ~read:
                    continue
            ways = [(done | used, read | bits)]
            for b, others, stays in asked:  # what takes effect before it
                first = next((x for _, _, x in others if not done & x), None) if b & ~read else None
                if first is not None:
                    more = [(d | first, r | b) for d, r in ways]
                    ways = ways + more if stays else more
            self.steps += len(ways)
            if self.max_steps is not None and self.steps > self.max_steps:
                return self._end("unchecked")
            for d, r in ways:
                after[target, d if is_read else d & ~one, r & ~one if is_read else r] = self.now
        if is_read:
            self._drop_read(i)
        else:
            self._drop_write(i)
        self.configs = self._prune(after, at) if len(after) > PRUNE_ABOVE else after
        if not after:
            return self._end("illegal")
        self._settle()
        if len(self.until) > 1000 + 2 * (len(self.configs) + len(self.writes)):
            used = {c[0] for c in self.configs} | {w[0] for w in self.writes.values()}
            self.until = {state: until for state, until in self.until.items() if state in used}

    def _end(self, verdict: str) -> None:
        self.verdict = verdict
        self._reset({})


class BoundedSearch:
    """The plain search, which examines ``max_steps`` states at most: all orders of the writes that
    reads in flight ask for, at every return."""

    def __init__(self, max_steps: int | None = None):
        self.max_steps = max_steps
        self.verdict = "ok"
        self.steps = self.now = 0
        self.reads: dict = {}  # in flight: id -> the state it asks for
        self.writes: dict = {}  # in flight or without outcome: id -> (state, place of its call, its return)
        self.until: dict = {}  # state -> the last call of a read that asks for it, where known
        self.by_state: dict = {}  # state -> ids of such writes
        # (state, writes in flight that took effect, reads in flight that did) -> place of the last write
        self.configs: dict = {((False, None), frozenset(), frozenset()): -1}

    def call(self, at, i, op, value, out, found, ok, unknown, ret, until, again=True) -> None:
        """ret: null for none; until: the last call of a read that asks for the state which this
        operation writes or reads, null for none."""
        self.now += 1
        if self.verdict != "ok":
            return
        if not unknown and not ok:
            self._end("illegal")
        elif op in ("PUT", "DELETE"):
            state = (True, None if _null(value) else value) if op == "PUT" else (False, None)
            self.writes[i] = (state, self.now, math.inf if unknown else ret)
            until = -math.inf if _null(until) else until
            self.until[state] = max(until, self.until.get(state, until))
            self.by_state.setdefault(state, {})[i] = None
        elif not unknown:
            want = (bool(found), None if not found or _null(out) else out)
            self.reads[i] = want
            self.configs = {(s, w, r | {i} if s == want else r): last for (s, w, r), last in self.configs.items()}

    def _live(self, state, at) -> bool:
        return state != DEAD and self.until.get(state, math.inf) >= at

    def _prune(self, configs: dict, at) -> dict:
        merged: dict = {}
        for (s, w, r), last in configs.items():
            key = (s if self._live(s, at) else DEAD, w, r)
            merged[key] = max(last, merged.get(key, -1))
        groups: dict = {}
        for (s, w, r), last in merged.items():
            groups.setdefault(s, []).append((len(r), last, -len(w), w, r))
        kept = {}
        for s, rows in groups.items():
            best: list = []
            for _, last, _, w, r in sorted(rows, key=lambda c: c[:3], reverse=True):
                if not any(r <= r2 and last <= last2 and used <= w for r2, last2, used in best):
                    asked = {want for i, want in self.reads.items() if i not in r}
                    best.append((r, last, {x for x in w if self.writes[x][0] in asked or self._live(self.writes[x][0], at)}))
                    kept[s, w, r] = last
        return kept

    def ret(self, at, i) -> None:
        self.now += 1
        if self.verdict != "ok":
            return
        if i not in self.reads and i not in self.writes:
            return self._end("illegal")  # returned before its call
        is_read, one = i in self.reads, frozenset((i,))
        after: dict = {}
        stack, seen = list(self.configs.items()), set(self.configs)
        while stack:
            (state, done, read), last = stack.pop()
            self.steps += 1
            if self.max_steps is not None and self.steps > self.max_steps:
                return self._end("unchecked")
            moves = []
            if i in (read if is_read else done):
                key = (state, done - one, read - one)
                after[key] = max(last, after.get(key, -1))
                continue
            if not is_read:
                if last > self.writes[i][1]:
                    key = (state, done, read)
                    after[key] = max(last, after.get(key, -1))
                moves.append(i)
            for want in {w for r, w in self.reads.items() if r not in read}:
                free = [w for w in self.by_state.get(want, ()) if w not in done]
                if free:
                    moves.append(min(free, key=lambda w: self.writes[w][2]))
            for w in moves:
                new = self.writes[w][0]
                key = (new, done | {w}, read | {r for r, want in self.reads.items() if want == new})
                # Configurations of before may recur with an older last write.
                if key not in seen or self.configs.get(key, self.now) < self.now:
                    seen.add(key)
                    if key in self.configs:
                        self.configs[key] = self.now
                    stack.append((key, self.now))
        if is_read:
            del self.reads[i]
        else:
            state = self.writes.pop(i)[0]
            del self.by_state[state][i]
            if not self.by_state[state]:
                del self.by_state[state]
        self.configs = self._prune(after, at) if len(after) > PRUNE_ABOVE else after
        if len(self.until) > 1000 + 2 * (len(self.configs) + len(self.writes)):
            used = {c[0] for c in self.configs} | {w[0] for w in self.writes.values()}
            self.until = {state: until for state, until in self.until.items() if state in used}
        if not after:
            self._end("illegal")

    def _end(self, verdict: str) -> None:
        self.verdict = verdict
        self.reads, self.writes, self.by_state, self.configs, self.until = {}, {}, {}, {}, {}


def reach(calls: list) -> list:
    """until and again (see Search.call) of each call (invoke, id, state, is_read, known, ret).

    A write that returned is replaced, at the latest, by the first return of a write called after that."""
    writes = sorted((invoke, ret if known else math.inf) for invoke, _, _, is_read, known, ret in calls if not is_read)
    starts = [w[0] for w in writes]
    ends = list(itertools.accumulate((w[1] for w in reversed(writes)), min, initial=math.inf))[::-1]
    of: dict = {}
    for invoke, _, state, is_read, known, _ in sorted(calls, key=lambda c: c[:2]):
        if known or not is_read:
            of.setdefault((state, is_read), []).append(invoke)
    out = []
    for invoke, _, state, is_read, known, ret in calls:
        same = of.get((state, not is_read), [])
        if is_read:
            n = bisect.bisect_left(same, invoke)
            out.append((None, not known or (n < len(same) and same[n] <= ret)))
        else:
            end = ends[bisect.bisect_right(starts, ret)] if known else math.inf
            n = bisect.bisect_right(same, end)
            out.append((same[n - 1] if n else None, None))
    return out


def linearizable(pdf: pd.DataFrame, max_steps: int | None = None) -> str:
    """ok, illegal, or unchecked once the search exceeds max_steps.

    A write is legal if it succeeded or its outcome is unknown; a read must see the register unless
    its outcome is unknown; a known failure is illegal. An operation without a return may take
    effect at any later point, or never."""
    calls, rest = [], []
    for row in pdf.itertuples():
        unknown = bool(row.unknown) or _null(row.ret)
        value = row.in_value if row.op == "PUT" else row.out_value if row.op == "GET" and row.found else None
        present = row.op == "PUT" or (row.op == "GET" and bool(row.found))
        calls.append((row.invoke, row.id, (present, None if _null(value) else value), row.op == "GET", not unknown, row.ret))
        rest.append((row.op, row.in_value, row.out_value, bool(row.found), bool(row.ok), unknown, row.ret))
    events = [(c[0], False, c[1], (*call, *more)) for c, call, more in zip(calls, rest, reach(calls))]
    events += [(c[5], True, c[1], None) for c in calls if c[4]]
    search = Search(None) if max_steps is None else BoundedSearch(max_steps)
    for at, is_return, i, call in sorted(events, key=lambda e: e[:3]):
        if is_return:
            search.ret(at, i)
        else:
            search.call(at, i, *call)
    return search.verdict
