"""Search for many short phrases at once, by one automaton for each block of them."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

BLOCK = 50_000


def holding(texts: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (tk, pk) of a text (tk, t) and a phrase (pk, p) it holds anywhere; each pair once.

    Phrases are sent to the tasks in blocks of about block, and each text is read
    once a block, whatever the number of phrases it holds.
    """
    n = -(-phrases.count() // block)
    parts = [_one(texts, [tuple(r) for r in phrases.filter(F.pmod("pk", F.lit(n)) == b).select("pk", "p").collect()]) for b in range(n)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], "tk long, pk long")


def _one(texts: DataFrame, phrases: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        keys: dict[str, list[int]] = {}
        for k, p in phrases:
            keys.setdefault(p, []).append(k)
        found = ahocorasick.Automaton()
        for p, ks in keys.items():
            found.add_word(p, (p, ks))
        found.make_automaton()
        for pdf in batches:
            rows = [(tk, k) for tk, t in zip(pdf["tk"], pdf["t"]) for ks in {p: ks for _, (p, ks) in found.iter(t)}.values() for k in ks]
            yield pd.DataFrame(rows, columns=["tk", "pk"], dtype="int64")

    return texts.select("tk", "t").mapInPandas(run, "tk long, pk long") if phrases else texts.sparkSession.createDataFrame([], "tk long, pk long")
