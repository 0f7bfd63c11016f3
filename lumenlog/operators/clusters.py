"""Clusters of template groups: exemplar texts, vector reuse, building, spans, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import severity_name, severity_rank
from . import vectors

#: Clusters that get a label, labels asked for at once, code points of a label.
LABELLED, AT_ONCE, LABEL_LENGTH = 48, 24, 80


def group_order() -> list[Column]:
    """The order of template groups: most events first."""
    return [F.desc("count"), F.col("template")]


def cluster_order() -> list[Column]:
    return [F.desc("count"), F.col("cluster_id")]


def exemplar_texts(groups: DataFrame, events: DataFrame) -> DataFrame:
    """groups with text: the message of the group's first exemplar that is known, else its template."""
    ids = groups.select("case_id", "template_id", F.posexplode("exemplar_event_ids").alias("n", "event_id"))
    found = ids.join(events.select("case_id", "event_id", "message"), ["case_id", "event_id"]).groupBy("case_id", "template_id").agg(F.min_by("message", "n").alias("message"))
    return groups.join(found, ["case_id", "template_id"], "left").withColumn("text", F.coalesce(F.nullif("message", F.lit("")), "template")).drop("message")


def vectors_by_text(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(text, embedding) of the chunks with a vector; of equal texts the highest chunk id counts."""
    return chunks.join(known, "chunk_id").groupBy("text").agg(F.max_by("embedding", "chunk_id").alias("embedding"))


def embed_with_reuse(texts: DataFrame, known: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts (with a column text) with embedding: known vectors are reused, the other distinct texts go through embed once each."""
    wanted = texts.select("text").distinct()
    fresh = embed(wanted.join(known, "text", "left_anti")).select("text", F.col("embedding").alias("_fresh"))
    both = texts.join(known.select("text", F.col("embedding").alias("_known")), "text", "left").join(fresh, "text", "left")
    return both.withColumn("embedding", F.coalesce("_known", "_fresh")).withColumn("reused", F.col("_known").isNotNull()).drop("_known", "_fresh")


def reuse_counts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """How many rows have a known vector, and how many have none."""
    marked = texts.join(known.select("text").distinct().withColumn("_known", F.lit(1)), "text", "left")
    return marked.agg(F.count("_known").alias("reused"), F.count_if(F.col("_known").isNull()).alias("fresh"))


def checked_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows, with an error where a vector is empty, has a non-finite part, or another length than the others."""
    sizes = rows.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors of {sizes.a} and of {sizes.b} dimensions")
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(column) > 0)
    return rows.withColumn(column, F.when(finite, F.col(column)).otherwise(F.raise_error(F.lit("a vector is empty or not finite"))))


def numbered_groups(groups: DataFrame) -> DataFrame:
    """groups with pos, their place in the case by group_order."""
    return groups.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy(*group_order())) - 1)


def build(groups: DataFrame, assignment: DataFrame) -> DataFrame:
    """Clusters from template groups and (case_id, template_id, cluster_id).

    count sums the groups', severity_max is the highest, signature the template of the group of highest severity, then count, then place, and
    template_ids has the groups in place order.
    """
    rows = numbered_groups(groups).join(assignment, ["case_id", "template_id"])
    rank = severity_rank("severity_max")
    best = F.struct(rank.alias("r"), F.col("count").alias("c"), (-F.col("pos")).alias("p"))
    out = rows.groupBy("case_id", "cluster_id").agg(
        F.sum("count").alias("count"), F.max(rank).alias("rank"), F.max_by("template", best).alias("signature"), F.max_by(F.get("exemplar_event_ids", F.lit(0)), best).alias("exemplar_event_id"), F.array_sort(F.collect_list(F.struct("pos", "template_id"))).alias("ids")
    )
    return out.select("case_id", "cluster_id", "signature", severity_name(F.col("rank")).alias("severity_max"), "count", F.transform("ids", lambda x: x["template_id"]).alias("template_ids"), "exemplar_event_id")


def with_spans(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """clusters with the first and the last time of their groups."""
    members = clusters.select("case_id", "cluster_id", F.explode("template_ids").alias("template_id"))
    spans = members.join(groups.select("case_id", "template_id", "first_ts", "last_ts"), ["case_id", "template_id"]).groupBy("case_id", "cluster_id").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return clusters.join(spans, ["case_id", "cluster_id"], "left")


def to_label(scored: DataFrame, most: int = LABELLED, at_once: int = AT_ONCE) -> DataFrame:
    """The most salient clusters of each case, in cluster order, with the number of the request they go in."""
    chosen = scored.where(F.col("rank") <= most)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("cluster_id")) - 1
    return chosen.withColumn("request", F.floor(place / at_once).cast("int"))


def with_labels(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """clusters with label: the new one where labels (case_id, cluster_id, label) has one, cut to length, else the old."""
    old = F.col("label") if "label" in clusters.columns else F.lit(None).cast("string")
    new = labels.select("case_id", "cluster_id", F.substring(F.trim("label"), 1, LABEL_LENGTH).alias("_new"))
    return clusters.join(new, ["case_id", "cluster_id"], "left").withColumn("label", F.coalesce(F.nullif("_new", F.lit("")), old)).drop("_new")


def parse_labels(content: Column) -> Column:
    """The labels of a reply, by cluster id: a JSON object of texts, on its own or within other text; blank ones are left out."""
    found = F.from_json(F.coalesce(F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit("")), F.lit("{}")), "map<string,string>")
    return F.map_filter(F.coalesce(found, F.create_map().cast("map<string,string>")), lambda k, v: k.rlike(r"^\d+$") & (F.trim(F.coalesce(v, F.lit(""))) != ""))


def cluster_groups(groups: DataFrame, events: DataFrame, known: DataFrame, embed: Callable[[DataFrame], DataFrame], method: str = "hdbscan", label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Template groups to clusters: exemplar texts, vectors (reused where known), clustering, building, spans and, if label is given, labels."""
    texts = numbered_groups(exemplar_texts(groups, events))
    vectored = checked_vectors(embed_with_reuse(texts, known, embed))
    found = vectors.cluster(vectored.select("case_id", F.col("pos").cast("long").alias("vec_id"), "embedding"), method)
    assignment = vectored.select("case_id", "template_id", F.col("pos").cast("long").alias("vec_id")).join(found, ["case_id", "vec_id"]).select("case_id", "template_id", "cluster_id")
    clusters = with_spans(build(groups, assignment), groups)
    return with_labels(clusters, label(clusters)) if label else clusters.withColumn("label", F.lit(None).cast("string"))
