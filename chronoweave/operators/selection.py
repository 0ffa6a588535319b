"""Quota-greedy selection of articles from ranked cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(rows: pd.DataFrame, budget: int, commodity_quota: int, disaster_cap: int) -> pd.DataFrame:
    """Rows in the order of (place, article). First cells with a commodity until its quota holds at the start of a cell, then any."""
    taken: dict[int, tuple[int, str]] = {}
    n_commodity = n_disaster = 0
    for phase in ("commodity", "any"):
        for _, cell in rows.groupby("place", sort=True):
            if len(taken) >= budget or (phase == "commodity" and n_commodity >= commodity_quota):
                break
            if phase == "commodity" and not cell["cell_commodity"].iloc[0]:
                continue
            for article, has, disaster in zip(cell["article"], cell["has_commodity"], cell["is_disaster"], strict=True):
                if article in taken:
                    continue
                if len(taken) >= budget:
                    break
                if disaster and n_disaster >= disaster_cap:
                    continue
                taken[article] = (len(taken), phase)
                n_commodity += bool(has)
                n_disaster += bool(disaster)
    return pd.DataFrame([(a, o, p) for a, (o, p) in taken.items()], columns=["article", "ord", "phase"])


def dense_selection(rows: DataFrame, budget: int, commodity_share: float = 0.45, disaster_share: float = 0.70) -> DataFrame:
    """Rows (article, ord, phase), at most `budget`.

    Each pick changes what later picks may take, so the fold is sequential; what it reads is bounded first: of each
    cell, and of both kinds of articles in it, only the first `budget` can matter, as only so many can be taken before.
    """
    near = rows.withColumn("cell_commodity", F.col("has_commodity"))
    # a cell can be left early only when the budget is full; refused disasters do not count, so both kinds keep their first `budget`
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("place", "is_disaster").orderBy("article"))).where(F.col("_n") <= budget).drop("_n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [f for f in frames if len(f)]
        if all_:
            table = pd.concat(all_).sort_values(["place", "article"])
            yield fold(table, budget, int(budget * commodity_share), int(budget * disaster_share))

    return near.repartition(1).mapInPandas(run, "article bigint, ord bigint, phase string")
