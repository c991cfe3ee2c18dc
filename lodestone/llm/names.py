"""Free-entered names mapped to the entries of a canonical list.

Names are reduced to tokens: compatible characters unified, invisible ones and accents removed, case folded; a word's
trailing digits are a number of their own, without leading zeros. Token-level repair: every distinct token that the
reference vocabulary lacks is joined to its tokens by edit distance (insertions, deletions, substitutions and
swaps of neighbours: one edit in tokens of ``SHORTEST`` letters or more, one more for every further ``EACH``) through shared
deletion variants, an equi-join, and to the word of a several-word name that it abbreviates. Shorter tokens are
words of their own: one edit would be a third of them. The repaired tokens are then combined: a complete
entry name is ranked by soft TF-IDF, the cosine of token weights in which a repaired token counts by its similarity.
An entry name qualifies if it has the same last number, if the words of it that are met hold at least the share ``cover`` of
its squared weights, and if the score is at least ``least``. A name whose number is not listed with its words therefore
fits none. Names and entries meet by an entry's rarest words only, as few as must contain one that is met.

Defined results: null, blank and symbol-only names fit none. Equal scores go to the name that is a symbol, then to the
smallest key. Repeated rows count once. Very long names are tokenised whole.
"""

from __future__ import annotations

import re
import unicodedata
from math import log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut

#: Letters of a token for one edit, and for each further one.
SHORTEST, EACH = 4, 5


def tokenise(name: str) -> tuple[list[str], str]:
    """Words and the last number ('' if there is none)."""
    s = unicodedata.normalize("NFKC", name)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    words, number = [], ""
    for w in re.findall(r"[^\W_]+", s):
        stem = w.rstrip("0123456789")
        if len(stem) < len(w):
            number = w[len(stem) :].lstrip("0") or "0"
        if stem:
            words.append(stem)
    return words, number


def edits_for(length: int) -> int:
    return 0 if length < SHORTEST else 1 + (length - SHORTEST) // EACH


def deletions(token: str, edits: int | None = None) -> list[str]:
    """The token with up to as many letters deleted as it may have edits."""
    out = last = {token}
    for _ in range(edits_for(len(token)) if edits is None else edits):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return sorted(out)


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; more than ``most`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _tokens(df: DataFrame, name: str) -> DataFrame:
    """(name, word, number) of every distinct name; names without words drop out."""

    def run(batches):
        for pdf in batches:
            rows = [(n, w, number) for n in pdf["name"] for words, number in [tokenise(n)] for w in dict.fromkeys(words)]
            yield pd.DataFrame(rows, columns=["name", "word", "number"], dtype=object)

    return df.select(F.col(name).alias("name")).filter("name is not null").distinct().mapInPandas(run, "name string, word string, number string")


def repair_tokens(words: DataFrame, vocabulary: DataFrame, shortened: DataFrame) -> DataFrame:
    """(word, term, similarity): terms of the vocabulary for distinct words; a word of the vocabulary stands for itself.
    A word of four letters or more that is the beginning of just one of the terms in ``shortened`` stands for that one."""
    known = words.join(vocabulary, words.word == vocabulary.term, "left_semi").select("word", F.col("word").alias("term"), F.lit(1.0).alias("similarity"))
    odd = words.join(vocabulary, words.word == vocabulary.term, "left_anti").filter(F.length("word") >= SHORTEST)

    def variants(batches):
        for pdf in batches:
            column = pdf.columns[0]
            yield pd.DataFrame([(t, v) for t in pdf[column] for v in deletions(t)], columns=[column, "variant"], dtype=object)

    a = odd.mapInPandas(variants, "word string, variant string")
    b = vocabulary.filter(F.length("term") >= SHORTEST).mapInPandas(variants, "term string, variant string")
    near = a.join(b, "variant").select("word", "term").distinct()

    def verify(batches):
        for pdf in batches:
            rows = [(w, t, d / max(len(w), len(t))) for w, t in zip(pdf["word"], pdf["term"]) for most in [edits_for(min(len(w), len(t)))] for d in [edit_distance(w, t, most)] if d <= most]
            yield pd.DataFrame([(w, t, 1.0 - x) for w, t, x in rows], columns=["word", "term", "similarity"])

    begin = shortened.select("term", F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.length("term") - 1)), lambda n: F.substring("term", F.lit(1), n))).alias("word"))
    begin = begin.filter(F.length("word") < F.length("term")).groupBy("word").agg(F.min("term").alias("term"), F.count("*").alias("n")).filter("n = 1")
    cut_off = odd.join(begin, "word").select("word", "term", F.lit(0.8).alias("similarity"))
    edited = near.mapInPandas(verify, "word string, term string, similarity double")
    return known.unionByName(edited).unionByName(cut_off).groupBy("word", "term").agg(F.max("similarity").alias("similarity"))


def match(names: DataFrame, entries: DataFrame, least: float = 0.5, cover: float = 1.0) -> DataFrame:
    """(name, key, score) for the names (column ``name``) that fit an entry of (name, key, symbol)."""
    if not 0 < cover <= 1:
        raise ValueError("cover lies above 0 and at most at 1")
    entries = entries.filter("name is not null and key is not null").groupBy("name", "key").agg(F.max("symbol").alias("symbol"))
    listed = cut(_tokens(entries, "name"))
    asked = cut(_tokens(names, "name"))
    n = max(2, listed.select("name").distinct().count())
    weights = listed.groupBy("word").agg((F.lit(log(n) + 1) - F.log(F.count("*"))).alias("idf")).withColumnRenamed("word", "term")
    several = listed.groupBy("name").agg(F.collect_list("word").alias("w")).filter(F.size("w") > 1).select(F.explode("w").alias("term")).distinct()
    repaired = repair_tokens(asked.select("word").distinct(), weights.select("term"), several).join(weights, "term")
    # a word that the vocabulary lacks weighs as its rarity among the names asked for
    m = max(2, asked.select("name").distinct().count())
    own = asked.groupBy("word").agg((F.lit(log(m) + 1) - F.log(F.count("*"))).alias("own"))
    best = repaired.groupBy("word").agg(F.max("idf").alias("best"))
    norm = asked.join(own, "word").join(best, "word", "left").groupBy("name").agg(F.sqrt(F.sum(F.pow(F.coalesce("best", "own"), F.lit(2)))).alias("norm"))
    terms = listed.withColumnRenamed("word", "term").join(weights, "term")
    square = F.col("idf") * F.col("idf")
    size = terms.groupBy("name").agg(F.sum(square).alias("square"))
    entry = cut(terms.join(size, "name").select(F.col("name").alias("entry"), "term", "number", "idf", "square"))
    # the rarest words of an entry, as few as must contain one that is met
    rest = F.sum(square).over(Window.partitionBy("entry").orderBy(F.desc("idf"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rare = entry.withColumn("rest", rest).filter(F.col("rest") >= F.col("square") * cover - 1e-9).select("entry", "term", "number")
    told = cut(asked.join(repaired.select("word", "term", "similarity"), "word").groupBy("name", "term", "number").agg(F.max("similarity").alias("similarity")))
    pairs = told.join(rare, ["term", "number"]).select("name", "entry").distinct()
    met = pairs.join(entry, "entry").join(told.drop("number"), ["name", "term"]).groupBy("name", "entry").agg(F.sum(square * F.col("similarity")).alias("dot"), F.sum(square).alias("met"), F.first("square").alias("square"))
    scored = met.filter(F.col("met") >= F.col("square") * cover - 1e-9).join(norm, "name").withColumn("score", F.col("dot") / (F.col("norm") * F.sqrt("square"))).filter(F.col("score") >= least)
    ranked = scored.select("name", F.col("entry"), F.round("score", 9).alias("score")).join(entries.withColumnRenamed("name", "entry"), "entry")
    top = ranked.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), (~F.col("symbol")).alias("y"), "key")).alias("b"))
    return top.select("name", F.col("b.key").alias("key"), (-F.col("b.s")).alias("score"))


def map_records(records: DataFrame, reference: DataFrame, synonyms: DataFrame) -> DataFrame:
    """records(id, name, key), reference(key, name, symbol), synonyms(id, pos, name): (id, key, score) for records whose
    key is null or not in the reference: by the record's name, else by the synonym that fits best (the first among
    equals); key 0 if none fits."""
    keys = reference.select("key").filter("key is not null").distinct()
    open_ = cut(records.filter("id is not null").join(keys, "key", "left_anti").select("id", "name").distinct())
    also = cut(synonyms.join(open_.select("id").distinct(), "id", "left_semi"))
    found = cut(match(open_.select("name").union(also.select("name")), reference))
    salts = 8
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    first = open_.select("id", "name", salt).join(spread, ["name", "salt"]).select("id", "key", "score", F.lit(0).alias("pos"))
    second = also.select("id", "name", "pos", salt).join(spread, ["name", "salt"]).select("id", "key", "score", "pos")
    best = first.unionByName(second).groupBy("id").agg(F.min(F.struct((F.col("pos") > 0).alias("o"), (-F.col("score")).alias("s"), "pos", "key")).alias("b"))
    return open_.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("b.key", F.lit(0).cast("long")).alias("key"), (-F.col("b.s")).alias("score"))
