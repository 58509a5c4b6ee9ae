"""Keyword dictionaries held in a table (E8, large company blocklists).

A term occurs in a text only if each of its trigrams does, so every term is anchored at the
one of its trigrams that the fewest terms have, every text is cut into its distinct trigrams,
and both meet on the anchor; what met is verified in full.  The join is an equi join of keys:
texts stay behind and are met again by key, with all candidates of a text in one row.
A dictionary that has few terms is one array, searched where the text lies, without any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions.text import found_terms
from boardsieve.operators.dedup import bounded_broadcast

ANCHOR = 3
MAX_BROADCAST_TERMS = 200_000
#: Up to so many terms, searching a text for each costs less than cutting it into trigrams.
FEW_TERMS = 200
# ASCII rules, the same in every engine that runs them.
_OUTSIDE_WORD = r"[^A-Za-z0-9_]"


def _pieces(text: Column, size: int) -> Column:
    """Overlapping pieces of a text, without repeats."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * size + "))"), 1))


def _anchored(terms: DataFrame, term: str) -> DataFrame:
    """Terms with their rarest trigram; shorter terms are their own anchor."""
    known = terms.filter(F.col(term) != "")
    pieces = F.when(F.length(term) <= ANCHOR, F.array(F.col(term))).otherwise(_pieces(F.col(term), ANCHOR))
    cut = known.select(F.col(term).alias("_term"), F.explode(F.array_distinct(pieces)).alias("_anchor")).distinct()
    counted = cut.join(cut.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_terms")), "_anchor")
    rarest = counted.groupBy("_term").agg(F.min(F.struct("_terms", "_anchor"))["_anchor"].alias("_anchor"))
    return known.join(rarest, F.col(term) == F.col("_term")).drop("_term")


def has_whole_word(text: Column, term: Column) -> Column:
    """Whether a term stands in a text with no letter, digit or underscore on either side."""
    return F.regexp_like(text, F.concat(F.lit(r"(?:^|" + _OUTSIDE_WORD + r")\Q"), term, F.lit(r"\E(?:\z|" + _OUTSIDE_WORD + ")")))


def occurrences(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "keyword", whole_word: str | None = None) -> DataFrame:
    """(key, term columns) for every term contained in the text of the key.

    ``whole_word`` names a column of the terms that asks for a match of whole words.
    """
    def is_word(row) -> Column:
        return ~row(whole_word) | has_whole_word(F.col(text), row(term))

    def is_hit(row) -> Column:
        hit = F.contains(F.col(text), row(term))
        return hit if whole_word is None else hit & is_word(row)

    few = terms.filter(F.col(term) != "").limit(FEW_TERMS + 1).collect()
    if few and len(few) <= FEW_TERMS:
        listed = F.array(*[F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in terms.schema.fields]) for row in few])
        held = F.transform(found_terms(F.col(text), [row[term] for row in few]), lambda place: F.get(listed, place))
        if whole_word is not None:
            held = F.filter(held, lambda t: is_word(lambda name: t[name]))
        return texts.select(key, F.inline(held))
    anchored = bounded_broadcast(_anchored(terms, term), MAX_BROADCAST_TERMS)
    shortest = terms.agg(F.min(F.length(term))).first()[0] or ANCHOR
    sizes = range(min(max(shortest, 1), ANCHOR), ANCHOR + 1)
    pieces = F.array_distinct(F.flatten(F.array(*[_pieces(F.col(text), size) for size in sizes])))
    cut = texts.select(key, F.explode(pieces).alias("_anchor"))
    found = cut.join(anchored, "_anchor").groupBy(key).agg(F.collect_list(F.struct(*terms.columns)).alias("_terms"))
    both = texts.select(key, text).join(found, key).select(key, text, F.inline("_terms"))
    return both.filter(is_hit(F.col)).drop(text)


def weighted_score(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Sum of weights per key, each group once through its first term in list order.

    ``dictionary`` has keyword, weight, grp, ord and whole_word.
    """
    hits = occurrences(texts, key, text, dictionary, whole_word="whole_word")
    first = hits.groupBy(key, "grp").agg(F.min_by("weight", "ord").alias("weight"))
    return first.groupBy(key).agg(F.sum("weight").alias("score"))


def without_terms(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str = "keyword") -> DataFrame:
    """Rows whose text contains none of the terms."""
    return rows.join(occurrences(rows.select(key, text), key, text, terms, term).select(key).distinct(), key, "left_anti")
