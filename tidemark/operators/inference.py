"""The boundary between plans and models: loaded once a task, called by batch, and one bad text never fails a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd

Model = Callable[[list[str]], list[Any]]


def answers(model: Model, texts: list[str], blank: Any, batch: int) -> list[Any]:
    """The model's answers, ``batch`` texts a call; where a call raises, its texts are asked one by one, and one that still raises gets ``blank``."""
    out = []
    for a in range(0, len(texts), batch):
        part = texts[a : a + batch]
        try:
            got = model(part)
            if len(got) != len(part):
                raise ValueError("a model must answer every text")
        except Exception:
            got = [blank] if len(part) == 1 else answers(model, part, blank, 1)
        out += got
    return out


def over_batches(load: Callable[[], Model], blank: Any, batch: int = 64) -> Callable[[Iterator[pd.Series]], Iterator[list[Any]]]:
    """A function over Arrow batches of texts. ``load`` runs once for each task's stream, where weights are read; null texts are empty ones."""

    def run(batches: Iterator[pd.Series]) -> Iterator[list[Any]]:
        model = load()
        for b in batches:
            yield answers(model, ["" if t is None or t != t else t for t in b], blank, batch)

    return run
