"""Long lists of forbidden terms, found in one pass over each prompt.

The terms become an automaton (Aho and Corasick) that every task builds once; the time for a prompt depends on its length
and on what it holds, not on the number of terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .gates import refused

#: Letters of all terms together.  The list goes to every task, where each letter takes a node of the automaton.
MOST_LETTERS = 20_000_000


class Terms:
    """The distinct terms with their places in the list; an empty term is in every prompt."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        places: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(self.terms):
            places[t].append(i)
        self.always = places.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for t, at in places.items():
            self.automaton.add_word(t, at)
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def found(self, text: str) -> list[str]:
        """Terms in the text in the order of the list."""
        hits = set(self.always)
        if self.any:
            for _, at in self.automaton.iter(text):
                hits.update(at)
        return [self.terms[i] for i in sorted(hits)]


def term_list(df: DataFrame, column: str, most: int = 1_000_000) -> list[str]:
    """The different terms of a column in order, for a list of at most ``most`` terms; a longer one is an error."""
    rows = df.select(F.col(column).cast("string").alias("t")).filter("t IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms in {column}")
    return sorted(r.t for r in rows)


def automaton_scan(requests: DataFrame, terms: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """The rows of ``gates.payload_scan`` for any number of terms.

    A null prompt is empty; repeated terms are listed as often as they are given; prompts of any length are read whole.
    Terms of more than MOST_LETTERS letters together are an error: they would not fit into a task.
    """
    low = [t.lower() for t in terms]
    if sum(map(len, low)) > MOST_LETTERS:
        raise ValueError(f"the terms have more than {MOST_LETTERS} letters")

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        listed = Terms(low)
        for texts in batches:
            yield pd.Series([listed.found(t) for t in texts], index=texts.index, dtype=object)

    return refused(requests, scan(F.lower(F.coalesce(F.col(prompt), F.lit("")))))
