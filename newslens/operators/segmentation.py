"""T1 with a dictionary: words of Han runs by the best path through a word lattice.

Text without blanks is a run of Han characters; every dictionary word that stands
somewhere in the run is an edge of its lattice, from its first character to the one
behind it.  A word weighs the logarithm of its share of all counted words, and the
segmentation is the path through the run with the largest sum: a dynamic programme
from the run's end, which per character keeps the best way to the end.  At equal sums the
longer word wins.  A character that no dictionary word covers alone is a word of its
own with the weight of a word counted once.  Weights are whole millionths, so sums
are exact and ties are ties on every engine.

The plan: distinct runs are cut into all substrings up to the longest word, joined to the
dictionary (broadcast after a count, else a shuffle join), put together per run and
folded.  All steps behind the distinct keep its partitioning by run, so the lattice is
built where the run is.  Runs of the text are joined back by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions import exprs as X

# Longest word looked up, in characters; longer dictionary entries are not used.
MAX_WORD = 8
# Most dictionary entries in a broadcast (words of MAX_WORD characters at most).
DICTIONARY_BROADCAST_MAX = 1_000_000
# Weights are counted in millionths.
WEIGHT_SCALE = 1_000_000
# A run of Han characters, or one of other letters and digits.
RUN_PATTERN = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def count_dictionary(words: DataFrame, term_col: str = "term", least: int = 1) -> DataFrame:
    """(term, n): a dictionary counted over words already segmented, one per row."""
    counted = words.select(F.lower(F.col(term_col)).alias("term")).where(F.length("term") > 0).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def han_ngrams(texts: DataFrame, text_col: str = "text", longest: int = 4) -> DataFrame:
    """(term): every run of 1 to `longest` Han characters inside the text's Han runs, one row each;
    what a dictionary is counted over where no segmented text is at hand."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{IsHan}+"), 0)).alias("run"))
    return _substrings(runs, longest).select("term")


def _substrings(runs: DataFrame, longest: int) -> DataFrame:
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    wide = at.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("wide"))
    return wide.select("run", "at", "wide", F.substring("run", F.col("at"), F.col("wide")).alias("term"))


def weights(dictionary: DataFrame, longest: int) -> tuple[DataFrame, Column]:
    """(term, weight), and the weight of a word counted once."""
    known = dictionary.where((F.length("term") > 0) & (F.length("term") <= longest) & (F.col("n") > 0)).groupBy("term").agg(F.sum("n").alias("n"))
    total = F.coalesce(known.select(F.sum("n")).scalar(), F.lit(1))
    weigh = lambda n: F.round(F.ln(n.cast("double") / total.cast("double")) * WEIGHT_SCALE).cast("bigint")
    return known.select("term", weigh(F.col("n")).alias("weight")), weigh(F.lit(1))


def best_path(lattice: Column, longest: int) -> Column:
    """Lengths of the best word at each position, first to last.

    `lattice`: per position from the last to the first, the words that begin there
    (array of struct<wide, weight>).
    """
    def step(acc: Column, edges: Column) -> Column:
        ways = F.transform(edges, lambda e: F.struct((e["weight"] + F.element_at(acc["sums"], e["wide"])).alias("s"), e["wide"].alias("wide")))
        return X.let(F.array_max(ways), lambda best: F.struct(
            # only the next `longest` positions can be reached by a word
            F.slice(F.concat(F.array(best["s"]), acc["sums"]), 1, longest).alias("sums"),
            F.concat(acc["picks"], F.array(best["wide"])).alias("picks")))

    start = F.struct(F.array(F.lit(0).cast("bigint")).alias("sums"), F.array().cast("array<int>").alias("picks"))
    return F.reverse(F.aggregate(lattice, start, step, lambda acc: acc["picks"]))


def follow(run: Column, picks: Column) -> Column:
    """The words met when each one leads to the position behind it."""
    def step(acc: Column, here: Column) -> Column:
        word = F.substring(run, here["at"], here["wide"])
        return F.when(here["at"] == acc["at"], F.struct((here["at"] + here["wide"]).alias("at"), F.concat(acc["words"], F.array(word)).alias("words"))).otherwise(acc)

    places = F.transform(picks, lambda wide, i: F.struct((i + 1).alias("at"), wide.alias("wide")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("words"))
    return F.aggregate(places, start, step, lambda acc: acc["words"])


def segment_runs(runs: DataFrame, dictionary: DataFrame, longest: int = MAX_WORD) -> DataFrame:
    """(run, words): each distinct run (column `run`) with its words in order."""
    known, once = weights(dictionary, longest)
    entries = known.limit(DICTIONARY_BROADCAST_MAX + 1).count()
    if entries <= DICTIONARY_BROADCAST_MAX:
        known = F.broadcast(known)
    pieces = _substrings(runs.select("run").where(F.length("run") > 0).distinct(), longest)
    edges = pieces.join(known, "term", "left").where(F.col("weight").isNotNull() | (F.col("wide") == 1))
    edge = F.struct("wide", F.coalesce("weight", once).alias("weight"))
    places = edges.groupBy("run", "at").agg(F.collect_list(edge).alias("edges"))
    lattice = places.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "edges")), asc=False).alias("lattice"))
    return lattice.select("run", follow(F.col("run"), best_path(F.transform("lattice", lambda x: x["edges"]), longest)).alias("words"))


def dictionary_tokens(articles: DataFrame, dictionary: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      longest: int = MAX_WORD) -> DataFrame:
    """(doc_id, pos, term) in order of `pos`: Han runs cut by the dictionary, other runs whole, lower-cased.

    `dictionary` holds (term, n); `pos` numbers are rising, with gaps.
    """
    runs = articles.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(RUN_PATTERN), 0)).alias("no", "run"))
    han = F.col("run").rlike(r"^\p{IsHan}") & (F.length("run") > 1)
    cut = segment_runs(runs.where(han), dictionary, longest)
    # a single character and a run of other letters are words as they stand: they never meet the join
    whole = runs.where(~han).select("doc_id", F.col("no").cast("bigint").alias("no"), F.array("run").alias("words"))
    words = runs.where(han).join(cut, "run").select("doc_id", F.col("no").cast("bigint").alias("no"), "words").unionByName(whole)
    rows = words.select("doc_id", "no", F.posexplode("words").alias("i", "term"))
    return rows.select("doc_id", (F.shiftleft("no", 32) + F.col("i")).alias("pos"), "term")
