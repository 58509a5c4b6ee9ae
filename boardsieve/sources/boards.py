"""All board adapters by name, and their union in registry order."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.sources import html_boards, json_boards, rss_boards
from boardsieve.sources.landing import kept, selected_boards, union_boards

ADAPTERS = {
    name: getattr(next(m for m in (json_boards, rss_boards, html_boards) if hasattr(m, name)), name) for name in v.BOARDS
}


def landed_boards(landed: DataFrame) -> tuple[str, ...]:
    """The boards a batch has responses of; reads the column ``source`` only, or folder names of a landed table."""
    found = landed.select("source").filter(F.col("source").isin(*v.BOARDS)).distinct()
    return tuple(r[0] for r in found.collect())


def board_items(landed: DataFrame | Mapping[str, DataFrame], board: str | None = None, among: Collection[str] = v.BOARDS) -> DataFrame:
    """Items of one board, or of all ``among`` these, in posting form, refused ones with their reason and place.

    Responses come as one table or as a table per board.  ``among`` may give the largest number of a response for each board.
    """
    last = among if isinstance(among, Mapping) else {}
    names = [name for name in selected_boards(board) if name in among]
    if isinstance(landed, Mapping):
        return union_boards({name: ADAPTERS[name].items(landed[name], last.get(name)) for name in names})
    if not names:
        return union_boards({v.BOARDS[0]: ADAPTERS[v.BOARDS[0]].items(landed.limit(0))})
    return union_boards({name: ADAPTERS[name].items(landed, last.get(name)) for name in names})


def board_postings(landed: DataFrame | Mapping[str, DataFrame], board: str | None = None, among: Collection[str] = v.BOARDS) -> DataFrame:
    """Postings of one board or of all, each row with its sequence within the batch."""
    return kept(board_items(landed, board, among))
