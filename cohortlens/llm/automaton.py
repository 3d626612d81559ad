"""Levenshtein automata intersected with a lexicon trie.

Each lexicon entry allows a number of edits (insertion, deletion, substitution
of a character).  The automata of all entries run together over the trie: a
state is a set of (trie node, edits so far) and the best hit of a stem so far,
which ends the search when no item can do with fewer edits.  States are made when
a word first needs them, and kept in a transition table, so arrays of words run
through it position by position.  Beyond ``MOST_STATES`` the table starts anew
with the next array: it is a memory of the automaton, not a part of it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Entry(NamedTuple):
    """``whole``: the entry is a word; else any word that begins with it."""
    text: str
    whole: bool
    edits: int
    weight: float


_UNKNOWN = -1
_DEAD = 0
#: States kept from one array of words to the next; a row of the table and some hundred bytes each.
MOST_STATES = 20_000


class LexiconAutomaton:
    def __init__(self, entries: list[Entry]) -> None:
        self.entries = entries
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # edits that any entry below a node allows
        for i, e in enumerate(entries):
            at = 0
            self.most[0] = max(self.most[0], e.edits)
            for c in e.text:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], e.edits)
            self.ends[at].append(i)
        letters = sorted({c for e in entries for c in e.text})
        #: Class 0 ends a word, 1 is any character outside the lexicon.
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.symbols = ["", ""] + letters
        self.length = max((len(e.text) for e in entries), default=0) + max((e.edits for e in entries), default=0) + 1
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[object, int] = {}
        self.states: list[object] = []
        self.table = np.full((1024, len(self.symbols)), _UNKNOWN, np.int32)
        self._state((frozenset(), None))
        self.start = self._state(self._with_deletions({(0, 0)}))

    def _with_deletions(self, items: set[tuple[int, int]], best: tuple[int, int] | None = None) -> object:
        """The items with entry characters left out and the best hit so far, or the hit that ends the search."""
        least: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e >= least.get(node, e + 1):
                continue
            least[node] = e
            todo.extend((nxt, e + 1) for nxt in self.child[node].values() if e + 1 <= self.most[nxt])
        hits = [(e, i) for node, e in least.items() for i in self.ends[node] if not self.entries[i].whole and e <= self.entries[i].edits]
        best = min([*hits, *([best] if best else [])], default=None)
        left = frozenset((node, e) for node, e in least.items() if not best or e < best[0])
        return (left, best) if left else ("hit", *best) if best else (frozenset(), None)

    def _state(self, key: object) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, _UNKNOWN)])
        return self.ids[key]

    def _step(self, state: int, symbol: int) -> int:
        items, best = self.states[state][:2]
        if items == "hit":
            return state  # a hit stays
        if symbol == 0:
            hits = [(e, i) for node, e in items for i in self.ends[node] if e <= self.entries[i].edits] + ([best] if best else [])
            return self._state(("hit", *min(hits))) if hits else _DEAD
        c, out = self.symbols[symbol], set()
        for node, e in items:
            for letter, nxt in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[nxt]:
                    out.add((nxt, cost))
            if e + 1 <= self.most[node]:
                out.add((node, e + 1))  # an extra character
        return self._state(self._with_deletions(out, best)) if out else self._state(("hit", *best)) if best else _DEAD

    def match(self, words: list[str]) -> list[tuple[int, int] | None]:
        """(edits, entry) of the best entry of each word, or None."""
        if not words or not self.entries:
            return [None] * len(words)
        if len(self.states) > MOST_STATES:
            self._forget()
        codes = np.array(words, dtype=f"U{self.length + 1}").view(np.uint32).reshape(len(words), -1)
        at = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == codes
        symbols = np.where(codes == 0, 0, np.where(known, at + 2, 1))
        state = np.full(len(words), self.start, np.int32)
        live = np.arange(len(words))
        for p in range(symbols.shape[1]):
            column = symbols[live, p]
            new = self.table[state[live], column]
            while (unknown := np.flatnonzero(new == _UNKNOWN)).size:
                pairs = np.unique(state[live[unknown]].astype(np.int64) * len(self.symbols) + column[unknown])
                for pair in pairs.tolist():
                    s, c = divmod(pair, len(self.symbols))
                    target = self._step(s, c)  # may enlarge the table
                    self.table[s, c] = target
                new = self.table[state[live], column]
            state[live] = new
            live = live[(new != _DEAD) & (column != 0)]
            if not live.size:
                break
        hits = {s: self.states[s] for s in np.unique(state).tolist()}
        return [h[1:] if (h := hits[s])[0] == "hit" else None for s in state.tolist()]
