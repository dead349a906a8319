"""Exact de-duplication and entity-combination identity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.operators.scans import earlier
from tidewire.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row per key. ``min_by`` combines on the map side, so a key that holds
    a third of all rows still sends one row per task through the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(picked).select(
        *[F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in df.columns]
    )


def first_per_url(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["url"], "pos")


def merge_feeds(gdelt: DataFrame, rss: DataFrame) -> DataFrame:
    """Feed entries of a flashpoint: queries in order, article lists before feeds, first url wins."""
    both = gdelt.withColumn("src_rank", F.lit(0)).unionByName(rss.withColumn("src_rank", F.lit(1)))
    return first_per_key(both, ["flashpoint_id", "url"], "query_pos", "src_rank", "pos")


def unique_queries(df: DataFrame, group: list[str], text: str = "query", at_least: int = 5) -> DataFrame:
    """First row per query text, with a flag for groups that have enough of them."""
    unique = first_per_key(df.where(F.col(text) != ""), [*group, text], "pos")
    counts = unique.groupBy(*group).agg(F.count("*").alias("unique_queries"))
    return unique.join(counts, group).withColumn("enough", F.col("unique_queries") >= at_least)


def combo_key(entities: Column) -> Column:
    """Identity of an entity combination: sorted, lower-case, trimmed."""
    return F.array_join(F.array_sort(F.transform(entities, lambda e: F.lower(F.trim(e)))), ",")


def new_combos(df: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """First row per entity combination that is not in ``history(combo)``."""
    keyed = df.withColumn("combo", combo_key(F.col("entities")))
    if history is not None:
        keyed = keyed.join(history.select("combo"), "combo", "left_anti")
    return first_per_key(keyed, ["combo"], "pos")


def duplicate_urls(hotspots: DataFrame) -> DataFrame:
    """Urls named more than once over all hotspots."""
    return (
        hotspots.select(F.explode("article_urls").alias("url"))
        .groupBy("url")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def once_per_ttl(df: DataFrame, source: str, ts: str, ttl_seconds: int) -> DataFrame:
    """One row per source and cache period, the earliest."""
    bucket = F.floor(F.unix_timestamp(ts) / ttl_seconds).cast("long")
    return first_per_key(df.withColumn("bucket", bucket), [source, "bucket"], ts, "pos")


def has_texts() -> Column:
    """Whether title and description are there and not empty."""
    return (F.coalesce(F.length("title"), F.lit(0)) > 0) & (F.coalesce(F.length("description"), F.lit(0)) > 0)


def cluster_flashpoints(df: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, pos, cluster) of the ordered merge of flashpoints that share an entity.

    A row joins the first cluster holding one of its entities; a row without
    such a cluster opens one if it has title, description, a country in
    ``geo_entities`` and a new entity combination, and is dropped otherwise.
    Clusters are never merged with each other.

    A cluster holds an entity at the time of a row exactly when an earlier row
    of the cluster names it. So the cluster of a row is the least cluster among
    all earlier rows it shares an entity with, or its own position. That minimum
    is spread until it is stable, with bucketed scans per entity, so neither a
    large run nor a common entity is collected anywhere.

    ``df`` is read once, without texts where it has a column ``has_texts`` (see
    :func:`has_texts`) besides or instead of title and description.
    """
    texts = F.col("has_texts") if "has_texts" in df.columns else has_texts()
    opens = texts & (F.size("entities") > 0) & (F.size("geo_entities") > 0)
    names = F.array_distinct("entities")
    rows = cut_lineage(
        df.select(run, "pos", names.alias("names"), combo_key(F.col("entities")).alias("combo"), opens.alias("opens"))
    )
    links = cut_lineage(rows.select(run, "pos", F.explode("names").alias("entity")))
    rows = rows.drop("names")
    settled = []
    while True:
        labels = _spread_down(rows, links, run)
        founders = labels.where(F.col("cluster") == F.col("pos")).join(
            rows.select(run, "pos", "combo"), [run, "pos"]
        )
        first = founders.groupBy(run, "combo").agg(F.min("pos").alias("first"))
        repeats = cut_lineage(
            founders.join(first, [run, "combo"]).where("pos > first").select(run, "pos")
        )
        if repeats.isEmpty():
            return reduce(DataFrame.unionByName, settled, labels)
        # Only runs with a repeated combination are labelled again.
        again = repeats.select(run).distinct()
        settled.append(labels.join(again, run, "left_anti"))
        rows = cut_lineage(
            rows.join(again, run, "left_semi")
            .join(repeats.withColumn("_repeat", F.lit(True)), [run, "pos"], "left")
            .withColumn("opens", F.col("opens") & F.col("_repeat").isNull())
            .drop("_repeat")
        )
        links = cut_lineage(links.join(again, run, "left_semi"))


def _lowered(known: DataFrame, offered: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label) of the keys whose least offered label is below all that are known of them, written."""
    new = offered.groupBy(*keys).agg(F.min(label).alias("_new"))
    # Both uses read the same columns, so Spark computes the offers once; few offers are broadcast to what is known.
    stay = known.join(new, keys).where(F.col(label) <= F.col("_new")).select(*keys)
    return cut_lineage(new.join(stay, keys, "left_anti").select(*keys, F.col("_new").alias(label)))


def _spread(
    start: DataFrame, offers: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], label: str
) -> DataFrame:
    """Least label of each key that ``offers`` leads to from the labels of ``start``.

    ``offers(changed, known)`` gives the labels that follow from changed ones. A round writes only labels
    that fell, and only these are joined again in the next one. ``known`` keeps the labels of all
    rounds; those that fell since are reachable still, so they do no harm.
    """
    known = changed = cut_lineage(start)
    while True:
        changed = _lowered(known, offers(changed, known), keys, label)
        if changed.isEmpty():
            return cut_lineage(known.groupBy(*keys).agg(F.min(label).alias(label)))
        known = known.unionByName(changed)


def _jumps(changed: DataFrame, known: DataFrame, run: str, label: str) -> DataFrame:
    """A label is the position of a row, and that row's own label is reachable too; taking it doubles the
    distance covered per round. Rows whose label changed take it, and so do rows that had a changed row as label."""
    at = lambda df: df.select(run, "pos", F.col(label).alias("_to"))
    to = lambda df: df.select(run, F.col("pos").alias("_to"), label)
    moved = at(changed).where("_to != pos").join(to(known), [run, "_to"])
    return moved.unionByName(at(known).where("_to != pos").join(to(changed), [run, "_to"])).drop("_to")


def _spread_down(rows: DataFrame, links: DataFrame, run: str) -> DataFrame:
    """(run, pos, cluster): least opening position that a row reaches through earlier rows, or its own."""

    def offers(changed: DataFrame, known: DataFrame) -> DataFrame:
        named = links.join(changed, [run, "pos"])
        # Of an entity that a changed row names, later rows see the least of the changed labels.
        touched = links.join(named.select(run, "entity").distinct(), [run, "entity"], "left_semi")
        seen = earlier(touched.join(changed, [run, "pos"], "left"), [run, "entity"], "pos", "cluster", "min", "low", 4096)
        low = seen.where("low is not null").select(run, "pos", F.col("low").alias("cluster"))
        return low.unionByName(_jumps(changed, known, run, "cluster"))

    start = rows.where("opens").select(run, "pos", F.col("pos").alias("cluster"))
    return _spread(start, offers, [run, "pos"], "cluster")


def merge_flashpoints(df: DataFrame, run: str = "run_id", clusters: DataFrame | None = None) -> DataFrame:
    """One row per cluster: titles joined by " / ", descriptions by a blank, entities united.

    ``clusters`` is the result of :func:`cluster_flashpoints` on the same rows, where it is at hand
    already; ``df`` then needs no ``geo_entities``.

    The joined texts are what the operator is asked for, so a result row is as
    long as its cluster; use :func:`cluster_flashpoints` where only the
    assignment is needed.
    """
    rows = df.join(cluster_flashpoints(df, run) if clusters is None else clusters, [run, "pos"])
    texts = F.array_sort(F.collect_list(F.struct("pos", "title", "description")))
    merged = rows.groupBy(run, "cluster").agg(texts.alias("texts"), F.count("*").alias("members"))
    names = (
        rows.select(run, "cluster", F.explode("entities").alias("entity"))
        .groupBy(run, "cluster")
        .agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    )
    return merged.join(names, [run, "cluster"]).select(
        run,
        F.col("cluster").alias("pos"),
        F.array_join("texts.title", " / ").alias("title"),
        F.array_join("texts.description", " ").alias("description"),
        "entities",
        "members",
    )


def entity_components(df: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, pos, component): rows linked through shared entities.

    Label spreading over the row-entity graph. Each round takes the smallest changed
    label per entity and then per row; both are map-side combined minima, so an
    entity named by a third of all rows costs no more than any other.
    """
    links = cut_lineage(
        df.select(run, "pos", F.explode(F.array_distinct("entities")).alias("entity"))
    )

    def offers(changed: DataFrame, known: DataFrame) -> DataFrame:
        per_entity = links.join(changed, [run, "pos"]).groupBy(run, "entity").agg(F.min("component").alias("component"))
        low = links.join(per_entity, [run, "entity"]).select(run, "pos", "component")
        return low.unionByName(_jumps(changed, known, run, "component"))

    start = df.select(run, "pos", F.col("pos").alias("component"))
    return _spread(start, offers, [run, "pos"], "component")


def merge_flashpoints_by_component(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Transitive merge of flashpoints; differs from the ordered fold by design.

    Entities are reduced to distinct (component, entity) rows before they are
    listed, and the result holds counts and first titles rather than all texts,
    so no row grows with the number of merged flashpoints.
    """
    comp = entity_components(df, run)
    rows = df.join(comp, [run, "pos"])
    return rows.groupBy(run, "component").agg(
        F.min_by("title", "pos").alias("first_title"),
        F.count("*").alias("members"),
    ).join(
        rows.select(run, "component", F.explode("entities").alias("entity"))
        .distinct()
        .groupBy(run, "component")
        .agg(F.count("*").alias("entity_count")),
        [run, "component"],
        "left",
    )
