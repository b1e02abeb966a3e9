"""Levenshtein automata of a whole lexicon at once: an edit automaton walks the lexicon's trie.

A state is a set of (trie node, errors so far).  States are made when first
reached and kept, so a word costs one dictionary step for each of its characters,
and most words reach the dead state after a few.
"""

from __future__ import annotations

DEAD = 0


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """terms: (term, is_stem).  A stem matches at a word's beginning, whatever follows."""

    def __init__(self, terms: list[tuple[str, bool]], errors=allowed_errors):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool, int] | None] = [None]
        self.most: list[int] = [0]
        for term, stem in terms:
            node, limit = 0, errors(term)
            self.most[0] = max(self.most[0], limit)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], limit)
            self.ends[node] = (term, stem, limit)
        self.sets: list[frozenset] = [frozenset()]
        self.numbers: dict[frozenset, int] = {frozenset(): DEAD}
        self.steps: list[dict[str, int]] = [{}]
        self.whole: list[tuple[int, str] | None] = [None]
        self.stem: list[tuple[int, str] | None] = [None]
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set) -> int:
        """The number of the state with these pairs and all that missing characters lead to."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, errors = todo.pop()
            if errors > self.most[node] or best.get(node, 9) <= errors:
                continue
            best[node] = errors
            todo += [(child, errors + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(errors, *self.ends[node]) for node, errors in best.items() if self.ends[node] and errors <= self.ends[node][2]]
            self.whole.append(min(((e, t) for e, t, _, _ in ends), default=None))
            # Of a stem, an error at its very end says nothing, as anything may follow.
            self.stem.append(min(((e, t) for e, t, stem, _ in ends if stem), default=None))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        pairs = set()
        for node, errors in self.sets[state]:
            pairs.add((node, errors + 1))
            for x, child in self.children[node].items():
                pairs.add((child, errors + (x != c)))
        to = self._state(pairs)
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """The least distance to an entry, and that entry."""
        state, best = self.start, None
        steps, stems = self.steps, self.stem
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == DEAD:
                return best
            if stems[state] is not None and (best is None or stems[state] < best):
                best = stems[state]
        end = self.whole[state]
        return end if end is not None and (best is None or end < best) else best
