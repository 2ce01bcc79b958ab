"""Chains of named steps with taps between them: what each step gives can be looked at without being computed again.

The same chain is there twice, as for aggregation: over frames of all queries and steps at once, and over the NumPy block
of one step inside the generation loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled

START = "start"  # what goes into a chain has this name


def _check(names: list[str], taps: dict[str, tuple[str, Callable]]) -> None:
    if len(set(names)) != len(names) or START in names:
        raise ValueError(f"steps need different names, none of them {START}")
    unknown = [after for after, _ in taps.values() if after not in (START, *names)]
    if unknown:
        raise ValueError(f"taps after unknown steps: {unknown}")


@dataclass(frozen=True)
class FrameChain:
    """steps: name to a function from frame to frame, in order. taps: name to (step, function); a tap gets what the step gives,
    or what goes into the chain, and changes nothing."""

    steps: dict[str, Callable[[DataFrame], DataFrame]]
    taps: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]

    def __post_init__(self):
        _check(list(self.steps), self.taps)

    def run(self, source: DataFrame) -> dict[str, DataFrame]:
        """The frame of each tap, and that of the last step under its own name unless a tap has it.

        A frame that more than one reader needs is written once to the folder of spark.checkpoint.dir and read from there
        by all of them; others stay plans, and steps that nobody reads are never computed.
        """
        found: dict[str, DataFrame] = {}
        names = list(self.steps)
        last = names[-1] if names else START
        frame = source
        for place, name in enumerate([START, *names]):
            if name != START:
                frame = self.steps[name](frame)
            looks = {tap: look for tap, (after, look) in self.taps.items() if after == name}
            readers = len(looks) + (1 if place < len(names) or last not in self.taps else 0)
            if readers > 1:
                frame = settled(frame)
            found |= {tap: look(frame) for tap, look in looks.items()}
        found.setdefault(last, frame)
        return found


@dataclass(frozen=True)
class BlockChain:
    """The same over a block of scores, a row for each stream of one query, which may come down to a single row of scores. A
    tap gives a token for each step: the record of a chain is an array of tokens by tap."""

    steps: dict[str, Callable[[np.ndarray], np.ndarray]]
    taps: dict[str, tuple[str, Callable[[np.ndarray], int]]]

    def __post_init__(self):
        _check(list(self.steps), self.taps)

    def __call__(self, block: np.ndarray, record: dict[str, list[int]]) -> np.ndarray:
        """What the last step gives for a block; each tap's token is added to its list in record."""
        for name in (START, *self.steps):
            if name != START:
                block = self.steps[name](block)
            for tap, (after, look) in self.taps.items():
                if after == name:
                    record.setdefault(tap, []).append(int(look(block)))
        if block.ndim != 1:
            raise ValueError("the last step of a chain must give one row of scores")
        return block


def public_argmax(block: np.ndarray) -> int:
    """The public stream's best token; the lowest on ties."""
    return int(block[0].argmax())


def argmax(scores: np.ndarray) -> int:
    return int(scores.argmax())


def one_table(found: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The frames of a run under each other, with ``tap``; they have columns in common."""
    frames = [frame.select(F.lit(name).alias("tap"), *columns) for name, frame in found.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
