"""Operators of browsing and review: search entries, names and labels, selections, notes, suggestions, map and previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chips(df: DataFrame, tags: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows where every tag has one of its values (a chip stands for yes or partly). A null tag is no match."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(c).isin(list(v)) for c, v in tags.items()), F.lit(True)))


def search_index(series: DataFrame, words: Column) -> DataFrame:
    """(kind, label, text) of classes, processes and series, in lower case text. series: id, cls, family, name.

    Series of one class and name are one entry, with their number; names that all series of
    a family share, and no others, are left to the process. `words`: further text of a series.
    """
    text = lambda *parts: F.lower(F.concat_ws(" ", *parts))
    classes = series.select("cls").distinct().select(F.lit("Class").alias("kind"), F.col("cls").alias("label"), F.lower("cls").alias("text"))
    processes = series.select("cls", "family").distinct().select(F.lit("Process").alias("kind"), F.col("family").alias("label"), text("family", "cls").alias("text"))
    sizes = series.groupBy("cls", "family").agg(F.count("*").alias("size"))
    named = series.withColumn("_words", words).groupBy("cls", "name").agg(F.count("*").alias("n"), F.min("family").alias("family"), F.max("family").alias("last"), F.min("_words").alias("words"))
    whole = (F.col("n") > 1) & (F.col("n") == F.col("size")) & (F.col("family") == F.col("last"))
    label = F.when(F.col("n") > 1, F.concat("name", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("name"))
    one = named.join(F.broadcast(sizes), ["cls", "family"]).filter(~whole)  # a row a family
    return classes.unionByName(processes).unionByName(one.select(F.lit("Series").alias("kind"), label.alias("label"), text("name", "family", "words").alias("text")))


def labels(domain: Column, tags: Mapping[str, Column], most: int = 3) -> Column:
    """At most `most` labels: the domain unless abstract, then the names of the tags that hold, in order."""
    return F.slice(F.array_compact(F.array(F.when(domain != "abstract", domain), *(F.when(c, F.lit(name)) for name, c in tags.items()))), 1, most)


def display_name(family: Column, variants: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first variant that fits, else the family in words."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in variants), F.regexp_replace(F.initcap(family), "[-_]", " "))


def select(df: DataFrame, issue: str | None = None, ids: Sequence | None = None, families: Sequence[str] | None = None, classes: Sequence[str] | None = None) -> DataFrame:
    """Rows that fit all given selections: an issue's flag is set, id, family and class among those named."""
    for column, values in (("id", ids), ("family", families), ("cls", classes)):
        if values is not None:
            df = df.filter(F.col(column).isin(list(values)))
    return df.filter(F.col(issue)) if issue else df


def note_counts(notes: DataFrame) -> DataFrame:
    """(category, n): distinct ids that have a note of the category. notes: id, category, note."""
    return notes.groupBy("category").agg(F.countDistinct("id").alias("n"))


def suggestions(notes: DataFrame, keep: Sequence, harmless: Sequence[str], pairs: Mapping[str, str], fatal: Sequence[str]) -> DataFrame:
    """(id, suggestion) of every id with notes: keep, drop or fix.

    Kept: ids of `keep`, ids whose categories are all harmless, and ids of a category of
    `pairs` with its text in a note. Dropped: ids with a text of `fatal` in a note.
    """
    each = notes.groupBy("id").agg(F.collect_set("category").alias("categories"), F.collect_list("note").alias("texts"))
    says = lambda text: F.exists("texts", lambda t: F.contains(t, F.lit(text)))
    fits = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))
    good = F.col("id").isin(list(keep)) | (F.size(F.array_except("categories", F.array(*map(F.lit, harmless)))) == 0) | fits([F.array_contains("categories", c) & says(t) for c, t in pairs.items()])
    return each.select("id", F.when(good, "keep").when(fits([says(t) for t in fatal]), "drop").otherwise("fix").alias("suggestion"))


def map_hits(points: DataFrame, clicks: Mapping[int, tuple[float, float]]) -> DataFrame:
    """(click, id): the nearest lit point of each click, ties to the smaller id. points: id, x, y, lit.

    clicks: number -> (x, y), a parameter of few entries. Each task keeps one point a click.
    """
    places = F.array(*(F.struct(F.lit(c).cast("long").alias("click"), F.lit(float(x)).alias("cx"), F.lit(float(y)).alias("cy")) for c, (x, y) in clicks.items()))
    met = points.filter("lit").select("id", "x", "y", F.explode(places).alias("at")).select("id", "x", "y", "at.*")
    far = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return met.groupBy("click").agg(F.min(F.struct(far.alias("d"), "id")).alias("best")).select("click", F.col("best.id").alias("id"))


def previews(families: DataFrame, most: int = 3) -> DataFrame:
    """(cls, family) of about `most` families a class, evenly spread in order. families: cls, family, ord."""
    order = Window.partitionBy("cls")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(order) / most))
    at = F.row_number().over(order.orderBy("ord")) - 1
    return families.select("cls", "family", at.alias("at"), step.alias("step")).filter((F.pmod("at", "step") == 0) & (F.col("at") / F.col("step") < most)).select("cls", "family")
