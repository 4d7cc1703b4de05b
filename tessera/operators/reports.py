"""Report records and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(store: DataFrame, incoming: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """K4: of each key the last record by ``seq``."""
    rest = [c for c in store.columns if c != key]
    last = store.unionByName(incoming).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}") for c in rest])


def listed(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Stored records of (pos, id) in the requested order; ids without a record are left out."""
    return ids.join(store, key).orderBy("pos")


def deleted(store: DataFrame, key_value: str, key: str = "id") -> DataFrame:
    return store.where(F.col(key) != key_value)


def posted(existing: DataFrame, incoming: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """K5: incoming records with the later of both timestamps; one that is no whole number counts as now."""
    stamp = F.coalesce(F.expr("try_cast(timestamp AS long)"), now)
    new = incoming.withColumn("timestamp", stamp)
    old = existing.select(key, F.col("timestamp").alias("_old"))
    return new.join(old, key, "left").withColumn("timestamp", F.greatest("timestamp", F.coalesce("_old", F.lit(0)))).drop("_old")


def merged(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """K6: fields of ``changes`` that aren't null replace the stored ones."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    both = existing.join(new, key, "full")
    return both.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in existing.columns if c != key])


def chatted(store: DataFrame, report_id: str, message: str, key: str = "id") -> DataFrame:
    """K7: appends a message to one report's chat."""
    return store.withColumn("chatMessages", F.when(F.col(key) == report_id, F.array_append(F.coalesce("chatMessages", F.array().cast("array<string>")), F.lit(message))).otherwise(F.col("chatMessages")))


def section_images(sections: DataFrame, images: DataFrame) -> DataFrame:
    """Sections with the image of their header; of several the last by ``seq``."""
    return sections.join(images.groupBy("header").agg(F.max_by("url", "seq").alias("image_url")), "header", "left")


def suggested(sections: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions (section_number from 1, prompt) with their section by place; numbers beyond the sections drop."""
    return suggestions.join(sections, suggestions["section_number"] - 1 == sections["pos"])


def detailed(introduction: Column, contents: Column, body: Column, conclusion: Column, references: Column) -> Column:
    """A report's parts with a blank line between."""
    return F.concat_ws("\n\n", introduction, contents, body, conclusion, references)


def layout(headers: dict[str, str], title: Column, date: Column, introduction: Column, contents: Column, sections: Column, conclusion: Column, sources: Column) -> Column:
    """C17: a published report from its parts."""
    h = {k: F.lit(v) for k, v in headers.items()}
    part = lambda name, text: F.concat(F.lit("## "), h[name], F.lit("\n"), text)
    head = F.concat(F.lit("# "), title, F.lit("\n#### "), h["date"], F.lit(": "), date)
    parts = (head, part("introduction", introduction), part("table_of_contents", contents), F.array_join(sections, "\n\n"), part("conclusion", conclusion), part("references", F.array_join(sources, "\n")))
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))


def report_file(name: Column) -> Column:
    """K9: a file's name, at most 60 characters."""
    return F.concat(F.left(name, F.lit(60)), F.lit(".md"))
