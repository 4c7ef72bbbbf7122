"""Byte-pair tokenizers as deterministic transducers.

A byte-pair encoding can be grown symbol by symbol. The last token of the encoding of x b is the one token t that ends
x b and may follow the last token of the encoding of the rest: two tokens may follow each other if encoding their
joined symbols gives back just these two. So the last token of each prefix is all that later tokens depend on, and of
the prefixes only those count from which a vocabulary entry may still grow. That is a finite state."""

from __future__ import annotations

import heapq
import json

import numpy as np

START = -1
NEVER = float("inf")


class Table:
    """Keys and values, none below 0, in open-addressed arrays, so that many keys are looked up together.

    A table that is three quarters full grows. Between batches a user drops a large one (see full): what was in it is
    made anew, so memory stays bounded, results the same."""

    def __init__(self, log_size: int):
        self.log_size = log_size
        self.clear()

    def clear(self) -> None:
        self._size(self.log_size)
        self.filled = 0

    def _size(self, log: int) -> None:
        self.log = log
        self.keys, self.vals = np.full(1 << log, -1, np.int64), np.zeros(1 << log, np.int64)

    def put(self, k: int, v: int) -> None:
        at = (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.log
        while self.keys[at] != -1:
            at = (at + 1) & (len(self.keys) - 1)
        self.keys[at], self.vals[at] = k, v
        self.filled += 1
        if 4 * self.filled > 3 * len(self.keys):
            self._enlarge()

    def _enlarge(self) -> None:
        have = self.keys >= 0
        keys, vals = self.keys[have], self.vals[have]
        self._size(self.log + 1)
        while len(keys):  # all that are left try their next place; the first of each place gets it
            at = self._place(keys)
            while len(at) and (self.keys[at] != -1).any():
                at = np.where(self.keys[at] != -1, (at + 1) & (len(self.keys) - 1), at)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.vals[at[first]] = keys[first], vals[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, vals = keys[rest], vals[rest]

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none yet."""
        at = self._place(key)
        have = self.keys[at]
        out = self.vals[at]
        bad = np.flatnonzero(have != key)
        while len(bad):
            gone = have[bad] == -1
            out[bad[gone]] = -1
            bad = bad[~gone]
            at[bad] = (at[bad] + 1) & (len(self.keys) - 1)
            have[bad] = self.keys[at[bad]]
            out[bad] = self.vals[at[bad]]
            bad = bad[have[bad] != key[bad]]
        return out

    def found(self, key: np.ndarray, make) -> np.ndarray:
        """Values of keys, those that are missing made one by one."""
        got = self.find(key)
        new = np.flatnonzero(got < 0)
        if len(new):
            for k in np.unique(key[new]).tolist():
                self.put(k, make(k))
            got[new] = self.find(key[new])
        return got

    def full(self) -> bool:
        return 2 * self.filled > 1 << self.log_size


class Merges:
    """Vocabulary entries as tuples of symbols, and which of them may follow each other."""

    def __init__(self, entries: dict, rank: dict[tuple[int, int], tuple]):
        """entries: symbols -> id. rank: pair of ids -> (priority, id of the merged entry), lowest first."""
        self.entries, self.rank = entries, rank
        self.symbols = {i: s for s, i in entries.items()}
        self.known: dict[int, bool] = {}
        self.size = max(self.symbols, default=0) + 1
        self.pairs: Table | None = None
        self.steps: dict[tuple[int, int], tuple] = {}

    def encode(self, ids: list[int]) -> list[int]:
        """Merges a list of single-symbol ids by priority, leftmost first."""
        return self._encode_short(list(ids)) if len(ids) <= 32 else self._encode_long(ids)

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := self.rank.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[k]))
            if (h := before[i]) >= 0 and (r := self.rank.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], new))
        return [x for x in ids if x is not None]

    def _encode_short(self, ids: list[int]) -> list[int]:
        rank, none = self.rank, (NEVER, 0)
        due = [rank.get(pair, none) for pair in zip(ids, ids[1:])]
        first = [r[0] for r in due]
        while first and (least := min(first)) != NEVER:
            i = first.index(least)
            ids[i : i + 2] = [due[i][1]]
            del due[i], first[i]
            for k in (i - 1, i):
                if 0 <= k < len(due):
                    due[k] = rank.get((ids[k], ids[k + 1]), none)
                    first[k] = due[k][0]
        return ids

    def single(self, symbols) -> list[int]:
        return [self.entries[symbols[k : k + 1]] for k in range(len(symbols))]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may come after token a (or first, for START)."""
        key = (a + 1) * self.size + b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._stay(key)
        return found

    def all_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """follows for arrays of tokens."""
        if self.pairs is None:
            self.pairs = Table(18)
        elif self.pairs.filled > 2_000_000:
            self.pairs.clear()
        return self.pairs.found((a + 1) * self.size + b, self._stay) > 0

    def _stay(self, key: int) -> bool:
        """Merges inside a and inside b come in the order that each has alone, until one across their bound is due."""
        a, b = key // self.size - 1, key % self.size
        last, left = self._steps(a, -1) if a != START else (None, [])
        first, right = self._steps(b, 0)
        if left is None or right is None or (a, b) in self.rank:
            return False
        i = k = 0
        while i < len(left) or k < len(right):
            x, y = left[i][0] if i < len(left) else NEVER, right[k][0] if k < len(right) else NEVER
            across = self.rank.get((last, first))
            if across and across[0] < x and across[0] <= y:  # of equal ones the leftmost is first
                return False
            if x <= y:
                last = left[i][1]
                i += 1
            else:
                first = right[k][1]
                k += 1
        return True

    def _steps(self, token: int, edge: int) -> tuple[int, list[tuple] | None]:
        """Of a token: the symbol at its edge (0 or -1), and of each merge that makes it the priority and what is at
        the edge then. None if its symbols make something else."""
        got = self.steps.get((token, edge))
        if got is None:
            ids = self.single(self.symbols[token])
            at, steps = ids[edge], []
            while due := [(r[0], i, r[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(pair))]:
                priority, i, new = min(due)
                ids[i : i + 2] = [new]
                steps.append((priority, ids[edge]))
            got = self.steps[token, edge] = at, steps if ids == [token] else None
        return got


def byte_level(path: str) -> tuple[Merges, dict[str, int]]:
    """Of a tokenizers file with a byte-level BPE model: its merges over bytes, and its added tokens."""
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True) or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE files can be compiled")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    plain = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    entries = {bytes(plain[c] for c in s): i for s, i in vocab.items() if all(c in plain for c in s)}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    rank = {}
    for k, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        rank[vocab[a], vocab[b]] = (k, vocab[a + b])
    return Merges(entries, rank), added


class Automaton(Table):
    """The transducer of one pre-token: states are made as they are met, each transition carries the change of the
    token count. Transitions live in the table, so that many texts advance together; states are dropped with it."""

    def __init__(self, merges: Merges, log_size: int = 21):
        self.merges = merges
        # the trie of vocabulary entries, with links to the longest proper suffix
        self.child: list[dict] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        for s, i in merges.entries.items():
            node = 0
            for b in s:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[node][b]
            self.token[node] = i
        self.fail = [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            deeper = []
            for node in level:
                for b, c in self.child[node].items():
                    self.fail[c] = self._step(self.fail[node], b)
                    deeper.append(c)
            level = deeper
        super().__init__(log_size)

    def _step(self, node: int, b) -> int:
        while b not in self.child[node]:
            if not node:
                return 0
            node = self.fail[node]
        return self.child[node][b]

    def clear(self) -> None:
        super().clear()
        self.states = [(0, ((START, 0),))]
        self.number = {self.states[0]: 0}

    def _chain(self, node: int) -> list[int]:
        out = [node]
        while node:
            node = self.fail[node]
            out.append(node)
        return out

    def grow(self, state: int, b: int) -> tuple[int, int]:
        """(next state, change of the count). A state holds its trie node and, for each suffix of the text that may
        still become an entry, the last token before that suffix and the count there against the count now."""
        node, past = self.states[state]
        chain = self._chain(node)
        hist = {self.depth[x]: h for x, h in zip(chain, past)}
        for x in chain:
            c = self.child[x].get(b)
            if c is not None and (t := self.token[c]) >= 0 and self.merges.follows(hist[self.depth[x]][0], t):
                break
        else:
            raise ValueError(f"byte {b} has no token")
        change = hist[self.depth[x]][1] + 1
        new = self._step(node, b)
        kept = tuple((t, 0) if not (d := self.depth[y]) else (hist[d - 1][0], hist[d - 1][1] - change) for y in self._chain(new))
        made = (new, kept)
        got = self.number.get(made)
        if got is None:
            got = self.number[made] = len(self.states)
            self.states.append(made)
        return got, change

    def _transition(self, key: int) -> int:
        to, change = self.grow(key >> 8, key & 255)
        return to << 8 | change + 128

    def advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes read a byte each: next states and changes of the counts. Lanes keep their states' numbers."""
        got = self.found(state << 8 | byte, self._transition)
        return got >> 8, (got & 255) - 128
