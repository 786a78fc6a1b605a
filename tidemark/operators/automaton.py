"""Many phrases at once: an automaton over words with failure links (after Aho and Corasick, 1975), compiled to a file and walked once a text.

States are beginnings of phrases. A word leads from a state to the next, or by failure links to the longest other beginning that the text's last words
still are, so no word is read twice, whatever the number of phrases, and no sequence of words is ever built as a string. The compiled file lies in the shared
folder; a Python worker reads it once. It grows with the dictionary alone: some hundred bytes a phrase.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Collection, Iterable, Iterator, Sequence
from functools import lru_cache

from pyspark.sql import SparkSession

from tidemark.work import fresh, open_fs


class Automaton:
    """``go``: a state's next ones by word; ``fail``: the state to fall back to; ``ends``: the values of all phrases that end in a state."""

    def __init__(self, phrases: Iterable[tuple[Sequence[str], object]] = ()):
        self.go: list[dict[str, int]] = [{}]
        self.fail, own = [0], [[]]
        for words, value in phrases:
            state = 0
            for w in words:
                if w not in self.go[state]:
                    self.go[state][w] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    own.append([])
                state = self.go[state][w]
            if state:
                own[state].append(value)
        self.ends = [tuple(dict.fromkeys(v)) for v in own]
        waiting = deque(self.go[0].values())
        while waiting:  # by length: what a state falls back to is shorter, so its ends are complete
            state = waiting.popleft()
            self.ends[state] += tuple(v for v in self.ends[self.fail[state]] if v not in self.ends[state])
            for w, after in self.go[state].items():
                back = self.fail[state]
                while back and w not in self.go[back]:
                    back = self.fail[back]
                self.fail[after] = self.go[back].get(w, 0) if self.go[back].get(w, 0) != after else 0
                waiting.append(after)

    def matches(self, words: Iterable[str]) -> Iterator[tuple[int, tuple]]:
        """The place of a phrase's last word and the values that end there."""
        go, fail, ends, state, start = self.go, self.fail, self.ends, 0, self.go[0]
        for at, w in enumerate(words):
            if state:
                while state and w not in go[state]:
                    state = fail[state]
                state = go[state].get(w, 0)
            else:
                state = start.get(w, 0)
            if state and ends[state]:
                yield at, ends[state]


def write(spark: SparkSession, phrases: Collection[tuple[Sequence[str], object]], name: str = "phrases") -> str:
    """Compiles to a file in the shared folder and returns its name."""
    folder = fresh(spark, name)
    fs, path = open_fs(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/automaton") as out:
        out.write(pickle.dumps(Automaton(phrases), protocol=5))
    return f"{folder}/automaton"


@lru_cache(maxsize=2)
def load(uri: str) -> Automaton:
    """The compiled file, read once a worker."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as file:
        return pickle.loads(file.read())
