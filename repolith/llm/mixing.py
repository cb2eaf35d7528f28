"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Token weights are summed into cells (source, language, topic), raked until the weights of each source, language and
topic meet their targets, and each document is drawn with its cell's calibrated probability by a digest of its id.
Sources beyond those that have a target share the cell ``other``, so cells are bounded by the targets given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MARGINS = ("source", "lang", "topic")
#: Default targets, in any unit: those of what is present are scaled to 1. A category without a target counts as ``other``.
SOURCES = {f"src{i}": 1.0 for i in range(1, 20)} | {"src0": 8.0, "other": 1.0}
LANGS = {"en": 57.0, "de": 15.0, "fr": 15.0, "es": 12.0, "other": 1.0}
TOPICS = {"long": 90.0, "lines": 8.0, "short": 2.0}


def topic(text: Column, n_tokens: Column) -> Column:
    """A coarse topic of form: ``short`` (under 100 words), ``lines`` (a line break for each 40 words or more), ``long``."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))
    return F.when(n_tokens < 100, "short").when(breaks * 40 >= n_tokens, "lines").otherwise("long")


def _category(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*[k for k in targets if k != "other"]), value).otherwise("other")


def with_cells(docs: DataFrame, sources: dict[str, float], langs: dict[str, float]) -> DataFrame:
    """``row`` (all of a row of ``docs``), tokens (words of the text, 1 at least), source, lang and topic. Nulls count as
    ``other``."""
    text = F.coalesce("row.text", F.lit(""))
    words = F.greatest(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(1).cast("long"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", words.alias("tokens"), _category(F.col("row.source"), sources).alias("source"), _category(F.col("row.lang"), langs).alias("lang"))
    return rows.withColumn("topic", topic(text, F.col("tokens")))


def capped(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, share: float) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``probability`` under a budget of ``share`` of all tokens or more.

    A category is thin when it holds under ``share`` of what its target takes of all tokens. The budget is what the
    other categories of each margin can carry at their targets. A category that can't supply its part of the budget
    is taken whole and the others of its margin share what is missing by their targets. Raking to these parts never
    takes more of a cell than it holds; other cells of the category make up for it. Cells are bounded by the product of
    the numbers of targets; they are one partition, in which all windows run without a shuffle.
    """
    whole = Window.partitionBy(F.lit(1))
    rows = cells.coalesce(1).withColumn("tokens", F.col("tokens").cast("double")).withColumn("total", F.sum("tokens").over(whole))
    for name in MARGINS:
        group = Window.partitionBy(name)
        target = F.element_at(F.create_map(*[F.lit(x) for kv in targets[name].items() for x in kv]), F.col(name))
        rows = rows.withColumn(f"target_{name}", target / F.count("*").over(group))
        rows = rows.withColumn(f"target_{name}", F.col(f"target_{name}") / F.sum(f"target_{name}").over(whole))
        rows = rows.withColumns({f"held_{name}": F.sum("tokens").over(group), f"goal_{name}": F.sum(f"target_{name}").over(group)})
        # Tokens and targets of this category and all that are no scarcer.
        up = whole.orderBy(f"ratio_{name}").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        rows = rows.withColumn(f"ratio_{name}", F.col(f"held_{name}") / F.col(f"goal_{name}"))
        rows = rows.withColumns({f"up_tokens_{name}": F.sum("tokens").over(up), f"up_targets_{name}": F.sum(f"target_{name}").over(up)})
        carried = F.col("total") - F.col(f"up_tokens_{name}") + F.col(f"ratio_{name}") * F.col(f"up_targets_{name}")
        rows = rows.withColumn(f"carried_{name}", F.min(F.when(F.col(f"ratio_{name}") >= share * F.col("total"), carried)).over(whole))
    budget = F.greatest(F.least(*[f"carried_{name}" for name in MARGINS]), F.lit(share) * F.col("total"))
    rows = rows.withColumn("budget", F.least(budget, "total")).withColumn("weight", F.col("tokens") * F.col("budget") / F.col("total"))
    for name in MARGINS:
        scale = (F.col("budget") - F.col("total") + F.col(f"up_tokens_{name}")) / F.col(f"up_targets_{name}")
        rows = rows.withColumn(f"part_{name}", F.least(f"held_{name}", F.max(scale).over(whole) * F.col(f"goal_{name}")))
    rows = rows.select(*MARGINS, "tokens", "weight", *[f"part_{name}" for name in MARGINS])
    for _ in range(rounds):
        for name in MARGINS:
            rows = rows.withColumn("weight", F.least("tokens", F.col("weight") * F.col(f"part_{name}") / F.sum("weight").over(Window.partitionBy(name))))
    return rows.withColumn("probability", F.col("weight") / F.col("tokens"))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the MD5 of the id, the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(
    docs: DataFrame, sources: dict[str, float] = SOURCES, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS,
    rounds: int = 12, share: float = 0.25,
) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever they are called), tokens, source, lang, topic, probability and selected.

    ``share`` of the tokens at least are expected in the sample, with thin cells whole (:func:`capped`). Equal rows and
    equal ids share one draw; a null id draws as the empty string. An empty table gives an empty table.
    """
    rows = with_cells(docs, sources, langs)
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = capped(cells, {"source": sources, "lang": langs, "topic": topics}, rounds, share)
    # At most (sources + 1) x (langs + 1) x topics rows.
    rows = rows.join(F.broadcast(raked.select(*MARGINS, "probability")), list(MARGINS))
    return rows.withColumn("selected", uniform(F.col("row.doc_id")) < F.col("probability"))


def selected(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns."""
    return mixed(docs, **options).filter("selected").select("row.*")
