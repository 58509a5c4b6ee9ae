"""Language identification from character trigrams (U1) for the language filter.

The model is trained from labelled text with Spark: trigram counts per language,
Laplace-smoothed log probabilities kept as integers (micro-nats), so sums do not
depend on the order in which tasks add them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions.text import strip
from boardsieve.operators.dedup import bounded_broadcast
from boardsieve.session import ensure_checkpoint_dir

ENGLISH = "en"
MIN_CHARS = 20
MAX_BROADCAST_GRAMS = 2_000_000
#: Up to so many gains, grams times languages, are held as an array by every Python worker.
MAX_HELD_GAINS = 8_000_000
#: Characters whose grams are looked up at once: their arrays stay small whatever a batch holds.
_STRETCH = 1 << 18
_SCALE = 1_000_000
_EVERY_GRAM = ""  # stands for one occurrence of any gram: carries the absent-gram probability


def _letters(text: Column) -> Column:
    """Lower case, runs of anything but letters to one blank, one blank around.

    Characters beyond the basic plane count as no letters, so a text in such a script alone is
    undetectable and passes the language rule.  One class, no alternatives: a repeated group takes a stack
    frame per character, and a long run of digits or dashes would overflow it.
    """
    words = F.regexp_replace(F.lower(text), r"[[^\p{L}]\x{10000}-\x{10FFFF}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _trigrams(text: Column) -> Column:
    """Overlapping trigrams of blank-padded words, from one regex pass over ``_letters`` text.

    A look-ahead consumes nothing; a blank in the middle would join two words.
    """
    return F.regexp_extract_all(text, F.lit("(?=(.[^ ].))"), 1)


def train_profile(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (gram, lang, gain): log probability above that of an absent gram.

    Words are counted first and cut into trigrams once per distinct word.  Both
    counts are combined map-side; the trigram table is bounded by the distinct
    (language, trigram) pairs, not by the corpus.  It is checkpointed because
    totals, vocabulary and gains all read it.
    """
    ensure_checkpoint_dir(labelled.sparkSession)
    words = labelled.select(F.col(lang).alias("lang"), F.explode(F.split(F.trim(_letters(F.col(text))), " ")).alias("word"))
    words = words.filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = words.select("lang", "n", F.explode(_trigrams(padded)).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    vocabulary = counts.agg(F.count_distinct("gram")).scalar()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("size", vocabulary)
    absent = totals.withColumn("absent", _log_probability(F.lit(0), F.col("total"), F.col("size")))
    gains = counts.join(absent, "lang").withColumn(
        "gain", _log_probability(F.col("n"), F.col("total"), F.col("size")) - F.col("absent"))
    floor = absent.select(F.lit(_EVERY_GRAM).alias("gram"), "lang", F.col("absent").alias("gain"))
    return gains.select("gram", "lang", "gain").unionByName(floor)


def _log_probability(n: Column, total: Column, size: Column) -> Column:
    return F.round(F.ln((n + 1) / (total + size)) * _SCALE).cast("long")


def _gain_sums(wide: DataFrame, names: list[str], stretch: int):
    """A function from ``_letters`` texts to their number of grams and their gains per language.

    The grams of a batch are cut, looked up and added as arrays; no row per gram is made.  A letter is one
    16-bit unit, so a gram is a number of 48 bits.
    """
    table = wide.toArrow()
    gain = np.column_stack([table[name].to_numpy() for name in names])
    grams = table["gram"].to_pylist()
    cut = [i for i, g in enumerate(grams) if g is not None and len(g) == 3 and max(map(ord, g)) < 1 << 16]
    numbers = np.array([ord(grams[i][0]) << 32 | ord(grams[i][1]) << 16 | ord(grams[i][2]) for i in cut], np.int64)
    order = np.argsort(numbers)
    # The last row stands for all grams that the profile lacks; the first column counts.
    known = np.append(numbers[order], np.int64(1 << 62))
    found = np.column_stack([np.ones(len(known), np.int64), np.vstack([gain[cut][order], np.zeros((1, len(names)), np.int64)])])
    absent = gain[[i for i, g in enumerate(grams) if g == _EVERY_GRAM]].sum(axis=0)
    shared = wide.sparkSession.sparkContext.broadcast((known, found, absent))

    @F.pandas_udf(", ".join(f"{name} BIGINT" for name in ("length", *names)))
    def sums(texts: pd.Series) -> pd.DataFrame:
        known, found, absent = shared.value
        units = np.frombuffer("".join(texts).encode("utf-16-le"), "<u2")
        ends = np.cumsum([len(text) for text in texts])
        total = np.zeros((len(texts), found.shape[1]), np.int64)
        for start in range(0, max(len(units) - 2, 0), stretch):
            part = units[start:start + stretch + 2].astype(np.int64)
            # Texts begin and end with a blank, so a gram across two texts has one in its middle, too.
            at = np.flatnonzero(part[1:-1] != 32)
            if not len(at):
                continue
            number = part[at] << 32 | part[at + 1] << 16 | part[at + 2]
            place = np.searchsorted(known, number)
            place[known[place] != number] = len(known) - 1
            row = np.searchsorted(ends, at + start, side="right")
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            total[row[first]] += np.add.reduceat(found[place], first)
        total[:, 1:] += total[:, :1] * absent
        return pd.DataFrame(total, columns=["length", *names])

    return sums


def _wide(profile: DataFrame) -> tuple[DataFrame, list[str], list[str], bool]:
    """One row per gram with a gain for each language, the gains' names and languages, and whether it is proven small."""
    found = [r["lang"] for r in profile.filter(F.col("gram") == _EVERY_GRAM).select("lang").distinct().collect()]
    # Texts without a label are a language without a name that knows no gram, as their rows meet no total.
    langs = sorted(found, key=lambda x: (x is not None, x or ""))
    names = [f"gain_{i}" for i in range(len(langs))]
    if not langs:
        return profile, names, langs, False
    wide = profile.groupBy("gram").agg(*[F.sum(F.when(F.col("lang").eqNullSafe(F.lit(x)), F.col("gain")).otherwise(0)).alias(n) for n, x in zip(names, langs)])
    held = min(MAX_BROADCAST_GRAMS, MAX_HELD_GAINS // len(langs))
    return wide, names, langs, bool(held) and wide.limit(held + 1).count() <= held


def _best(sums, names: list[str], langs: list[str]) -> Column:
    """The language with the largest sum."""
    return F.array_max(F.array(*[F.struct(sums(n).alias("score"), F.lit(x).cast("string").alias("lang")) for n, x in zip(names, langs)]))["lang"]


def detect_language(df: DataFrame, key: str, text: str, profile: DataFrame) -> DataFrame:
    """(key, detected_lang); keys whose text has no trigram are absent.

    With a profile proven small a text is scored whole inside the task that read it, and only
    one row of sums per text is shuffled.  A larger profile is joined, by a shuffle if it cannot be
    broadcast, with the grams counted per key first and a frequent gram split by the skew join.
    """
    # A text's grams meet one row each and one sum per key is left.
    wide, names, langs, held = _wide(profile)
    if not langs:
        return df.select(key, F.lit(None).cast("string").alias("detected_lang")).limit(0)
    if held:
        letters = df.select(key, _letters(F.col(text)).alias("letters")).filter(F.col("letters").isNotNull())
        sums = letters.select(key, _gain_sums(wide, names, _STRETCH)("letters").alias("sums")).select(key, "sums.*").filter("length > 0")
        scores = sums.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    else:
        texts = df.select(key, _trigrams(_letters(F.col(text))).alias("grams"))
        texts = texts.select(key, "grams", F.size("grams").cast("long").alias("length")).filter("length > 0")
        grams = texts.select(key, "length", F.explode(F.concat("grams", F.array(F.lit(_EVERY_GRAM)))).alias("gram"))
        weight = F.when(F.col("gram") == _EVERY_GRAM, F.col("length")).otherwise(F.lit(1).cast("long"))
        grams = grams.select(key, "gram", weight.alias("n"))
        hinted = bounded_broadcast(wide, MAX_BROADCAST_GRAMS)
        if hinted is wide:
            grams = grams.groupBy(key, "gram").agg(F.sum("n").alias("n"))
        scores = grams.join(hinted, "gram").groupBy(key).agg(*[F.sum(F.col("n") * F.col(n)).alias(n) for n in names])
    return scores.select(key, _best(F.col, names, langs).alias("detected_lang"))


def long_enough(text: Column) -> Column:
    return F.length(strip(text)) >= MIN_CHARS


def with_language(df: DataFrame, key: str, text: str, profile: DataFrame, pin=None) -> DataFrame:
    """Add ``detected_lang``, null for short or undetectable texts and null keys.

    With a profile proven small a row is judged where it lies: nothing is joined and no text is written.  Else rows meet
    their language by key; ``pin`` then writes them first, as they are read twice.
    """
    judged = F.col(key).isNotNull() & long_enough(F.col(text))
    wide, names, langs, held = _wide(profile)
    if not held:
        rows = pin(df) if pin else df
        return rows.join(detect_language(rows.filter(judged).select(key, text), key, text, profile), key, "left")
    letters = F.when(judged, F.coalesce(_letters(F.col(text)), F.lit(""))).otherwise(F.lit(""))
    sums = df.withColumn("_sums", _gain_sums(wide, names, _STRETCH)(letters))
    found = F.when(F.col("_sums.length") > 0, _best(lambda n: F.col(f"_sums.{n}"), names, langs))
    return sums.withColumn("detected_lang", found).drop("_sums")


def only_english(df: DataFrame, key: str, text: Column, profile: DataFrame, pin=None) -> DataFrame:
    """Drop rows detected as another language; short or undetectable texts stay."""
    rows = with_language(df.withColumn("_text", text), key, "_text", profile, pin)
    return rows.filter(F.col("detected_lang").isNull() | (F.col("detected_lang") == ENGLISH)).select(*df.columns)
