"""Minimal acyclic automata that number the words they hold, and completions of a word with exactly one error."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Automaton:
    """The smallest deterministic automaton of some words, given sorted and each once.

    A step carries how many words precede those below it, so the sum along a path is the word's place in the order: a perfect
    hash, by which facts about words lie in plain arrays.
    """

    def __init__(self, words: Iterable[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        states: dict[tuple, int] = {}
        path, last = [(False, {})], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same, states)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0, states)
        self.start = self._state(path[0], states)

    def _close(self, path: list, last: str, upto: int, states: dict) -> None:
        """No later word passes what is below `upto` on the path: give these states their number."""
        while len(path) > upto + 1:
            done = self._state(path.pop(), states)
            path[-1][1][last[len(path) - 1]] = done

    def _state(self, node: tuple[bool, dict[str, int]], states: dict) -> int:
        key = (node[0], *node[1].items())
        if key not in states:
            before, steps = int(node[0]), {}
            for letter, to in node[1].items():
                steps[letter] = (to, before)
                before += self.words[to]
            states[key] = len(self.steps)
            self.steps.append(steps)
            self.final.append(node[0])
            self.words.append(before)
        return states[key]

    def walk(self, text: str, state: int, number: int = 0) -> tuple[int, int] | None:
        """(state, number) after reading text, or None where no word goes on so."""
        steps = self.steps
        for letter in text:
            to = steps[state].get(letter)
            if to is None:
                return None
            state, number = to[0], number + to[1]
        return state, number

    def number(self, word: str) -> int | None:
        at = self.walk(word, self.start)
        return at[1] if at and self.final[at[0]] else None

    def with_one_error(self, exact: str, rest: str) -> Iterator[int]:
        """Numbers of the words that begin with `exact` and go on as `rest` with one letter inserted, deleted or replaced; each once."""
        at = self.walk(exact, self.start)
        if at is None:
            return
        state, number = at
        for i in range(len(rest) + 1):
            letter, after = rest[i : i + 1], rest[i + 1 :]
            ends = [self.walk(after, state, number)] if letter and letter != after[:1] else []  # deleted; of a letter repeated, the last
            for other, (to, before) in self.steps[state].items():
                if other != letter:  # inserting a letter before its like is inserting it behind
                    ends.append(self.walk(rest[i:], to, number + before))
                    if letter:
                        ends.append(self.walk(after, to, number + before))
            yield from (end[1] for end in ends if end and self.final[end[0]])
            step = self.steps[state].get(letter) if letter else None
            if step is None:
                return
            state, number = step[0], number + step[1]
