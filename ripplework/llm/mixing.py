"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed once into cells of source, language and topic. The cells are then raked: each
step scales the cells of every value of one dimension to that value's target share, dimension after
dimension, round after round. What is scaled is the cell table alone; its sums are pre-aggregated and
joined back by value, so a value that holds most cells is never gathered. Targets are for ``keep`` of all tokens, and
after every round a cell is cut to the tokens it has, which the next round makes up for in other cells. A
document's sampling probability is its cell's weight over the cell's tokens, so expected token shares meet the
targets as far as the corpus can. A document is drawn if a hash of its id and text falls below its probability.
Everything is DataFrame functions.

Defined cases: a null dimension is the value ``(none)``; a null text has no tokens; cells without tokens get
the probability ``keep``, cells of values whose target is absent or 0 get 0; rows with
the same id and text share one draw, other rows draw for themselves, with or without an id; a null id counts as the
empty one and a null text as the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.session import checkpointed

ROUNDS = 8
KEEP = 0.6
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.7, "lang": 0.8, "topic": 0.9}
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A coarse topic from what a text holds."""
    low = F.lower(text)
    return (
        F.when(low.contains("licens") | low.contains("copyright"), "legal")
        .when(low.contains("@"), "contact")
        .when(low.contains("|"), "tables")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, text_md5`` of every row."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id"), F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"),
        topic(text).alias("topic"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        text_md5(text).alias("text_md5"),
    )


def cells_of(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    return rows.groupBy(*dimensions).agg(F.sum("tokens").cast("double").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, temperature: float) -> DataFrame:
    """``value, share``: the corpus' own shares raised to ``temperature``, to flatten large values."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n"))
    raised = sums.select("value", F.when(F.col("n") > 0, F.pow("n", F.lit(temperature))).otherwise(0.0).alias("share"))
    return raised


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """``cells`` with ``weight``, raked to ``targets[dimension](value, share)`` of ``keep`` times all tokens.

    Shares are scaled to sum 1; no cell gets more weight than it has tokens.
    """
    total = keep * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    scaled = {}
    for name, target in targets.items():
        present = checkpointed(target.join(cells.filter("tokens > 0").select(F.col(name).alias("value")).distinct(), "value", "left_semi"))
        whole = present.agg(F.sum("share")).first()[0] or 1.0
        scaled[name] = present.select(F.col("value").alias(name), (F.col("share") / F.lit(whole) * F.lit(total)).alias("aim"))
    weighted = cells.withColumn("weight", F.col("tokens"))
    for _ in range(rounds):
        for name, aim in scaled.items():
            sums = weighted.groupBy(name).agg(F.sum("weight").alias("now")).join(aim, name, "left")
            factor = sums.select(name, F.when(F.col("now") > 0, F.coalesce("aim", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("factor"))
            weighted = weighted.join(factor, name).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        weighted = checkpointed(weighted.select(*cells.columns, F.least("weight", "tokens").alias("weight")))
    return weighted


def probabilities(weighted: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, keep: float = KEEP) -> DataFrame:
    """``dimensions, probability`` of every raked cell."""
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(keep))
    return weighted.select(*dimensions, chance.alias("probability"))


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, text_md5: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the id and the text alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_md5, F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(rows: DataFrame, temperatures: Mapping[str, float] = TEMPERATURES, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """Sampling probabilities of the cells of ``described`` rows under tempered targets."""
    cells = checkpointed(cells_of(rows))
    targets = {name: tempered(cells, name, t) for name, t in temperatures.items()}
    return probabilities(rake(cells, targets, rounds, keep), keep=keep)


def sample(rows: DataFrame, mix: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` with ``probability`` and ``sampled``; rows that carry no ``text_md5`` are drawn by their id."""
    of_text = F.col("text_md5") if "text_md5" in rows.columns else F.lit("")
    return rows.join(mix, list(DIMENSIONS)).withColumn("sampled", draw(F.col("doc_id"), of_text, seed) < F.col("probability"))


def mixed(docs: DataFrame, temperatures: Mapping[str, float] = TEMPERATURES, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs(doc_id, text, lang, source, ...)``, with their columns alone."""
    mix = plan_mix(described(docs), temperatures)
    mix = mix.select(*[F.col(c).alias(f"cell_{c}_") for c in DIMENSIONS], F.col("probability").alias("cell_probability_"))
    same = (
        (F.coalesce(docs["source"], F.lit(NONE)) == F.col("cell_source_")) & (F.coalesce(docs["lang"], F.lit(NONE)) == F.col("cell_lang_"))
        & (topic(docs["text"]) == F.col("cell_topic_"))
    )
    return docs.join(mix, same).filter(draw(docs["doc_id"], text_md5(docs["text"]), seed) < F.col("cell_probability_")).select(*[docs[c] for c in docs.columns])
