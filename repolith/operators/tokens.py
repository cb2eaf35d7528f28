"""Tokens of texts in a row, counted without building the whole text.

Counts don't add up, as a token may reach over a border. But a letter before a space ends a piece in every usual rule of splitting
(a tokenizer splits text into pieces and encodes each alone). So a part of a text is its ``head`` up to the first such place, a count for
what lies between the first and the last, and its ``tail`` from there; neighbours meet in a tail and a head. A part
without such a place is all head and goes on with its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators import graph

Tokens = Callable[[Column], Column]


def parts(rows: DataFrame, tokens: Tokens) -> DataFrame:
    """``rows`` with ``cut`` (whether ``text`` has a place to cut), ``head``, ``inside`` (tokens between the cuts) and ``tail`` instead
    of ``text``; a null text is empty."""
    whole = F.coalesce("text", F.lit(""))
    cut = whole.rlike(r"\p{L} ")
    head = F.when(cut, F.regexp_extract(whole, r"(?s)^(.*?\p{L}) ", 1)).otherwise(whole)
    tail = F.when(cut, F.regexp_extract(whole, r"(?s)^.*\p{L}( .*)$", 1)).otherwise("")
    marked = rows.withColumns({"cut": cut, "head": head, "tail": tail})
    middle = F.substring(whole, F.length("head") + 1, F.length(whole) - F.length("head") - F.length("tail"))
    return marked.withColumn("inside", F.when(F.col("cut"), tokens(middle)).otherwise(0).cast("long")).drop("text")


def totals(pieces: DataFrame, group: str, order: list[str], tokens: Tokens) -> DataFrame:
    """(group, total): the tokens of each group's texts, one after the other in ``order``, from their ``parts``.

    Cuts are counted along sorted ranges, so a large group is many tasks' work; what lies between two cuts is put together and
    counted, which is the only text that moves.
    """
    counted = graph.summed_before(pieces.select(group, *order, "cut", "head", "inside", "tail"), [group, *order], F.col("cut").cast("long"), "run")
    # The head belongs to the run before the cut, the tail to the next; a run is between two cuts of one group.
    fragments = F.array(F.struct("run", F.col("head").alias("fragment")), F.struct((F.col("run") + 1).alias("run"), F.col("tail").alias("fragment")))
    rows = counted.select(group, *order, F.posexplode(fragments).alias("side", "f")).select(group, *order, "side", "f.*").filter("fragment <> ''")
    texts = rows.groupBy(group, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "side", "fragment"))).alias("f"))
    between = texts.select(group, tokens(F.array_join(F.transform("f", lambda x: x["fragment"]), "")).cast("long").alias("n"))
    return counted.select(group, F.col("inside").alias("n")).unionByName(between).groupBy(group).agg(F.sum("n").alias("total"))
