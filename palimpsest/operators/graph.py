"""The graph of memories: typed relations, entities, neighbours and relation proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy, text

# Weights that relation types add to a score, by direction.
OUT_WEIGHTS = {"supersedes": 0.04, "supports": 0.04, "depends_on": 0.04, "affects": 0.04, "owned_by": 0.04, "same_topic": 0.01}
IN_WEIGHTS = {"supports": 0.04, "same_topic": 0.01, "supersedes": -0.04, "invalidates": -0.04}
BOUND = 0.08


def both_ends(relations: DataFrame) -> DataFrame:
    """(id, peer, relation_type, confidence, outgoing): every relation from each of its ends.

    A union of two equi-joinable sides instead of a join on either end.
    """
    out = relations.select(F.col("source_memory_id").alias("id"), F.col("target_memory_id").alias("peer"), "relation_type", "confidence", F.lit(True).alias("outgoing"))
    back = relations.select(F.col("target_memory_id").alias("id"), F.col("source_memory_id").alias("peer"), "relation_type", "confidence", F.lit(False).alias("outgoing"))
    return out.unionByName(back)


def relation_bonus(relations: DataFrame, bound: float = BOUND, contradiction_cost: float = 0.0) -> DataFrame:
    """(id, bonus): what a memory's relations add to its score; what a contradiction takes is zero unless it is given."""
    rows = both_ends(relations)
    weight = F.when(F.col("relation_type") == "contradicts", -contradiction_cost).when(F.col("outgoing"), policy.mapped(F.col("relation_type"), OUT_WEIGHTS, 0.0)).otherwise(policy.mapped(F.col("relation_type"), IN_WEIGHTS, 0.0))
    total = F.sum(weight * F.col("confidence"))
    return rows.groupBy("id").agg(F.greatest(F.lit(-bound), F.least(F.lit(bound), total)).alias("bonus"))


def block_threshold(memories: Column, share: float = 0.03, least: int = 12, small: int = 20) -> Column:
    """Documents from which an entity is too frequent to relate them; none in small scopes."""
    return F.when(memories >= small, F.greatest(F.lit(least), F.ceil(memories * share)))


def entity_frequency(entities: DataFrame) -> DataFrame:
    """(scope_id, entity, df, threshold, blocked)."""
    df = entities.groupBy("scope_id", "entity").agg(F.countDistinct("memory_id").alias("df"))
    sizes = entities.groupBy("scope_id").agg(F.countDistinct("memory_id").alias("memories"))
    rows = df.join(sizes, "scope_id").withColumn("threshold", block_threshold(F.col("memories")).cast("long"))
    return rows.withColumn("blocked", F.coalesce(F.col("df") >= F.col("threshold"), F.lit(False))).drop("memories")


def peers(entities: DataFrame, recent: DataFrame, limit: int = 5000) -> DataFrame:
    """(memory_id, peer, place): up to ``limit`` peers of each memory in its scope.

    ``entities`` (scope_id, memory_id, entity) are those that are not blocked for being too frequent. Each gives the first of its
    memories, as many as the limit leaves to one of a memory's entities; where some are missing, they are the newest of
    ``recent`` (scope_id, id, updated_at), of which no more than ``limit`` + 1 can be needed. Of a posting list only its head meets the others, so that a frequent entity costs no
    pairs of all its memories.
    """
    rows = entities.select("scope_id", "memory_id", "entity").distinct()
    share = rows.groupBy("scope_id", "memory_id").agg(F.greatest(F.lit(2), F.least(F.lit(limit + 1), F.floor(limit / F.count(F.lit(1))) + 2)).cast("long").alias("each"))
    order = W.partitionBy("scope_id", "entity").orderBy("memory_id")
    head = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit + 2).withColumnRenamed("memory_id", "peer")
    pairs = rows.join(share, ["scope_id", "memory_id"]).join(head, ["scope_id", "entity"]).where("memory_id <> peer")
    own = W.partitionBy("memory_id", "entity").orderBy("r")
    pairs = pairs.withColumn("k", F.row_number().over(own)).where("k <= each")
    first = pairs.groupBy("scope_id", "memory_id", "peer").agg(F.min("entity").alias("entity"))
    first = first.withColumn("place", F.row_number().over(W.partitionBy("memory_id").orderBy("entity", "peer"))).where(F.col("place") <= limit).drop("entity")
    found = first.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    short = recent.select("scope_id", F.col("id").alias("memory_id")).join(found, "memory_id", "left").where(F.coalesce("n", F.lit(0)) < limit)
    newest = recent.withColumn("age", F.row_number().over(W.partitionBy("scope_id").orderBy(F.desc("updated_at"), F.desc("id")))).where(F.col("age") <= limit + 1)
    fill = short.select("scope_id", "memory_id").join(newest.select("scope_id", F.col("id").alias("peer"), "age"), "scope_id").where("memory_id <> peer")
    fill = fill.join(first.select("memory_id", "peer"), ["memory_id", "peer"], "left_anti")
    both = first.select("memory_id", "peer", F.lit(0).alias("late"), "place").unionByName(fill.select("memory_id", "peer", F.lit(1).alias("late"), F.col("age").alias("place")))
    ranked = both.withColumn("n", F.row_number().over(W.partitionBy("memory_id").orderBy("late", "place", "peer"))).where(F.col("n") <= limit)
    return ranked.select("memory_id", "peer", F.col("n").cast("long").alias("place"))


def entity_sync(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """(memory_id, entity, action): what an index of (memory_id, entity) lacks (add) and holds in excess (remove)."""
    key = ["memory_id", "entity"]
    add = now.select(*key).distinct().join(indexed, key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(indexed.select(*key).distinct().join(now, key, "left_anti").withColumn("action", F.lit("remove")))


def frequency_drift(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(scope_id, entity, kept, now) where maintained counts differ from those of the postings (scope_id, memory_id, entity)."""
    true = now.groupBy("scope_id", "entity").agg(F.countDistinct("memory_id").alias("now"))
    rows = kept.withColumnRenamed("n", "kept").join(true, ["scope_id", "entity"], "full")
    rows = rows.select("scope_id", "entity", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("now", F.lit(0)).cast("long").alias("now"))
    return rows.where("kept <> now")


def related_entities(entities: DataFrame, entity: str, limit: int) -> DataFrame:
    """Entities that share memories with one."""
    holders = entities.where(F.col("entity") == entity).select("memory_id").distinct()
    near = entities.join(holders, "memory_id", "left_semi").where(F.col("entity") != entity)
    return near.groupBy("entity").agg(F.countDistinct("memory_id").alias("n")).orderBy(F.desc("n"), "entity").limit(limit)


def distances(seeds: DataFrame, relations: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, id, distance, score): memories within ``depth`` steps of each seed id, and 1 / (1 + distance)."""
    edges = both_ends(relations).select("id", "peer").distinct()
    front = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("distance", F.lit(0))
    reached = front
    for step in range(1, depth + 1):
        front = front.join(edges, "id").select("seed", F.col("peer").alias("id")).distinct().withColumn("distance", F.lit(step))
        reached = reached.unionByName(front)
    best = reached.groupBy("seed", "id").agg(F.min("distance").alias("distance"))
    return best.withColumn("score", 1.0 / (1 + F.col("distance")))


def same_topic(pairs: DataFrame) -> DataFrame:
    """Propose same_topic for pairs with (shared, similarity): a shared entity and some likeness, or much likeness."""
    shared = (F.col("shared") > 0) & (F.col("similarity") >= 0.40)
    confidence = F.when(shared, F.greatest(F.lit(0.55), F.least(F.lit(0.95), 0.45 + F.col("similarity")))).when(F.col("similarity") >= 0.68, F.least(F.lit(0.9), F.col("similarity")))
    return pairs.withColumn("confidence", confidence).where("confidence IS NOT NULL")


def similar_pairs(memories: DataFrame, least: float, shared_prefix: int = 8, contradictions: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of one scope and target whose token sets are alike, without comparing all pairs.

    A similarity L comes from containment of L / 0.82, or from Jaccard's index L, which between a set of n tokens and a larger one
    takes 2 L / (1 + L) of the n. Pairs of ``contradictions`` (a, b in either order) are left out. So t = ceil(the lesser share * n) tokens are shared, and at least c of the n - t + c rarest:
    prefix filtering with c = ``shared_prefix``, or t if that is less.
    """
    # words one a row, so that stems are compiled; the sets are grouped once, and later uses share that exchange
    tokens = memories.select("id", "scope_id", "target", F.explode(text.query_tokens("content")).alias("t"))
    tokens = tokens.select("id", "scope_id", "target", F.explode(F.array("t", text.stem(F.col("t")))).alias("t"))
    sets = tokens.groupBy("id", "scope_id", "target").agg(F.collect_set(text.aliased(F.col("t"))).alias("words"))
    exploded = sets.select("id", "scope_id", "target", F.size("words").alias("n"), F.explode("words").alias("word"))
    df = exploded.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    order = W.partitionBy("id").orderBy("df", "word")
    needed = F.ceil(F.col("n") * min(least / 0.82, 2 * least / (1 + least)) - 1e-9)
    shared = F.least(F.lit(shared_prefix), needed)
    prefix = exploded.join(df, "word").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - needed + shared)
    smaller = prefix.select(F.col("id").alias("x"), "scope_id", "target", F.col("n").alias("nx"), shared.alias("least_shared"), "word")
    whole = exploded.select(F.col("id").alias("y"), "scope_id", "target", F.col("n").alias("ny"), "word")
    near = smaller.join(whole, ["scope_id", "target", "word"]).where((F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")))
    near = near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("hits"), F.max("least_shared").alias("least_shared")).where("hits >= least_shared")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if contradictions is not None:
        near = near.join(contradictions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    words = sets.select("id", "words")
    near = near.join(words.withColumnsRenamed({"id": "a", "words": "wa"}), "a").join(words.withColumnsRenamed({"id": "b", "words": "wb"}), "b")
    return near.select("a", "b", text.similarity(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)


