"""Several values packed in one field: one row per value, with its position.

Every field is parsed by its cheapest dialect (a set of delimiters, with or without quoting) in the sense of minimum
description length: bits to state the dialect, bits to say which delimiter ends each value, and the code lengths of
the values. A value that occurs more than once among all distinct fields costs the logarithm of its rarity, any other
one its characters under an order-2 model of character classes. Both are counted over all fields, and the values'
code lengths are joined, not broadcast; the model has at most (number of classes)**3 entries.

Defined results: a null or blank field has no values. An empty value takes a position and gives no row. Repeated rows
give the same rows once. A null identifier is kept. Other columns are ignored. Long fields are parsed whole.
"""

from __future__ import annotations

from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.dialects import DELIMITERS, dialects, model_from, novel_bits, parse, steps
from lodestone.runtime import cut, partitions

#: Parts over which rows that share a field or a value are spread.
SALTS = 8
FINEST = "".join(DELIMITERS)


def split_values(df: DataFrame, identifier: str, field: str, name: str = "value") -> DataFrame:
    """(identifier, pos, name): the values of ``field``, pos counted from 1."""
    rows = df.select(F.col(f"`{identifier}`").alias("i"), F.col(f"`{field}`").cast("string").alias("f")).filter(F.col("f").rlike(r"\S")).distinct()
    # a checkpoint of few bytes is few tasks, however much there is to parse
    fields = cut(rows.select("f").distinct()).repartition(partitions(df.sparkSession), "f")

    def finest(batches):
        for pdf in batches:
            yield pd.DataFrame({"v": [v for f in pdf["f"] for v in parse(f, FINEST, True)[0]]}, dtype=object)

    seen = cut(fields.mapInPandas(finest, "v string").groupBy("v").agg(F.count("*").alias("n")))

    def transitions(batches):
        for pdf in batches:
            yield pd.DataFrame({"t": [t for v in pdf["v"] for t in steps(v)]}, dtype=object)

    counts = seen.filter("v <> ''").select("v").mapInPandas(transitions, "t string").groupBy("t").count().collect()
    model = model_from({r[0]: r[1] for r in counts})
    total = max(1, seen.agg(F.sum("n")).first()[0] or 1)

    def candidates(batches):
        for pdf in batches:
            out = []
            for f in pdf["f"]:
                several = dialects(f)
                if len(several) == 1:
                    out.append((f, several[0][0], several[0][1], 0.0, None, 0.0))
                    continue
                for letters, quotes in several:
                    values, between = parse(f, letters, quotes)
                    # tabs and line breaks that are neither delimiters nor in a value
                    blank = sum(f.count(c) - sum(x.count(c) for x in (*values, *between)) for c in "\t\n")
                    # which delimiters, which of them each time or the end, the quoting, and blanks left over
                    bits = 10.0 * blank + 1.0 + log2(len(DELIMITERS) + 1) * len(letters) + len(values) * log2(len(letters) + 1)
                    for k, v in enumerate(values):
                        out.append((f, letters, quotes, bits if k == 0 else 0.0, v, novel_bits(v, model) if v else 1.0))
            yield pd.DataFrame(out, columns=["f", "letters", "quotes", "bits", "v", "novel"])

    parsed = fields.mapInPandas(candidates, "f string, letters string, quotes boolean, bits double, v string, novel double")
    known = seen.filter("n > 1 and v <> ''").select("v", (F.log2(F.lit(float(total)) / F.col("n"))).alias("listed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    priced = parsed.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALTS)).cast("int")).join(known, ["v", "salt"], "left")
    cost = priced.groupBy("f", "letters", "quotes").agg(F.sum(F.col("bits") + F.least("listed", "novel")).alias("cost"))
    # at equal cost the finer dialect, with quoting
    best = cost.groupBy("f").agg(F.min_by(F.struct("letters", "quotes"), F.struct(F.round("cost", 6), -F.length("letters"), ~F.col("quotes"), "letters")).alias("d"))
    chosen = best.select("f", "d.letters", "d.quotes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).join(chosen, ["f", "salt"]).select("i", "f", "letters", "quotes")

    def split(batches):
        for pdf in batches:
            parts = [parse(f, letters, quotes)[0] for f, letters, quotes in zip(pdf["f"], pdf["letters"], pdf["quotes"])]
            out = pd.DataFrame({"i": pdf["i"].repeat([len(p) for p in parts]).reset_index(drop=True), "pos": [k for p in parts for k in range(1, len(p) + 1)], "v": [v for p in parts for v in p]})
            yield out[out["v"] != ""]

    schema = f"i {rows.schema['i'].dataType.simpleString()}, pos int, v string"
    return joined.mapInPandas(split, schema).select(F.col("i").alias(identifier), "pos", F.col("v").alias(name))
