"""References to records that do not exist, are gone, or come later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A publication number without blanks and punctuation: office, number, kind. Other citation texts are literature.
PUBLICATION = r"^[A-Z]{2}[0-9]{4,}[A-Z][0-9]?$"


def publication_key(text):
    """A typed publication number in capitals and digits only; null if the text spells none."""
    k = F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")
    return F.when(k.rlike(PUBLICATION), k)


def _earliest(df: DataFrame, keys: list[str], begins: str, ends: str) -> DataFrame:
    """One row per record: when its first delivery came and when it was withdrawn, if ever."""
    return df.groupBy(*keys).agg(F.min(begins).alias("born"), F.min(ends).alias("gone"))


def claim_references(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, references) of claims: a claim by doc_id and number, and each parent that a delivery of it names."""
    c = claims.select("doc_id", "number", "dependent_on", "loaded_at", "cancelled_at")
    name = F.concat_ws("#", "doc_id", "number")
    known = F.col("doc_id").isNotNull() & F.col("number").isNotNull()
    targets = _earliest(c.where(known).withColumn("ref_key", name), ["ref_key"], "loaded_at", "cancelled_at")
    born = c.where(known).groupBy("doc_id", "number").agg(F.min("loaded_at").alias("at"))
    named = c.where(known & F.col("dependent_on").isNotNull()).select("doc_id", "number", F.col("dependent_on").alias("parent")).distinct()
    refs = named.join(born, ["doc_id", "number"]).select(
        "doc_id", F.col("number").cast("string").alias("ref_from"), F.col("parent").cast("string").alias("ref_to"), F.concat_ws("#", "doc_id", "parent").alias("ref_key"), "at"
    )
    return targets, refs


def citation_references(patents: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, references) of patents: publications here or in the prior art, and each distinct citation of them."""
    p = patents.select("doc_id", "citations", "ingested_at", "removed_at").where("doc_id is not null")
    here = p.select(F.col("doc_id").alias("ref_key"), F.col("ingested_at").alias("b"), F.col("removed_at").alias("g"))
    there = prior.select(F.col("doc_id").alias("ref_key"), F.col("registered_at").alias("b"), F.col("removed_at").alias("g"))
    targets = _earliest(here.unionByName(there).where("ref_key is not null"), ["ref_key"], "b", "g")
    refs = (
        p.select("doc_id", "ingested_at", F.explode_outer(F.expr("array_distinct(citations)")).alias("c"))
        .select("doc_id", "ingested_at", publication_key(F.col("c")).alias("ref_key"))
        .groupBy("doc_id", "ref_key")
        .agg(F.min("ingested_at").alias("at"))
    )
    # a record's earliest time is over all its deliveries, also those without this citation
    born = p.groupBy("doc_id").agg(F.min("ingested_at").alias("born_at"))
    refs = refs.where("ref_key is not null").drop("at").join(born, "doc_id").withColumnRenamed("born_at", "at")
    return targets, refs.select("doc_id", F.lit("").alias("ref_from"), F.col("ref_key").alias("ref_to"), "ref_key", "at")


def _state():
    """What is wrong with a reference that was made `at` a time, from what is known of its key."""
    return F.expr("case when parent = 0 then 'missing' when gone <= at then 'deleted' when born > at then 'late' end")


def orphan_references(sources: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows (ref_table, doc_id, ref_from, ref_to, ref_state, ref_month) of all references that find no record in time.

    Parents and children are united in long form, tagged, and grouped by table and key: a group without a parent flag, or
    whose parent comes after its first or goes before its last child, is kept. Only the children of such groups are then
    looked at one by one. Aggregation combines before the shuffle, so a key that most references name is one row per task;
    in the join that follows such a key's children are split by the adaptive skew join.

    Null keys refer to nothing and are no records. Repeated rows count once. A record without a time of its own exists, but
    never late; a child without a time has a null month and can only be `missing`. Extra columns are ignored.
    """
    kids, kept = _children(sources), _orphaned(sources)
    return (
        kids.join(kept, ["ref_table", "ref_key"])
        .withColumn("ref_state", _state())
        .where("ref_state is not null")
        .select("ref_table", "doc_id", "ref_from", "ref_to", "ref_state", F.date_format("at", "yyyy-MM").alias("ref_month"))
    )


def reference_counts(sources: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Number of the rows of orphan_references() per table, month and state: rows (ref_table, ref_month, ref_state, refs).

    The children of a key that came at the same time are counted before they meet what is known of the key, and the counts are summed by period, so a
    key that most references name is as many rows as there are times.
    """
    times = _children(sources).groupBy("ref_table", "ref_key", "at").agg(F.count("*").alias("n"))
    found = times.join(_orphaned(sources), ["ref_table", "ref_key"]).withColumn("ref_state", _state()).where("ref_state is not null")
    return found.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "ref_state").agg(F.sum("n").alias("refs"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """The same from rows of orphan_references()."""
    return orphans.groupBy("ref_table", "ref_month", "ref_state").agg(F.count("*").alias("refs"))


def _children(sources: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows (ref_table, doc_id, ref_from, ref_to, ref_key, at) of all references."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("ref_table"), "doc_id", "ref_from", "ref_to", "ref_key", F.col("at").cast("timestamp_ntz").alias("at")) for n, (_, r) in sources.items()])


def _orphaned(sources: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows (ref_table, ref_key, parent, born, gone) of the keys that have children which may find no parent in time."""
    none = F.lit(None).cast("timestamp_ntz")
    long = []
    for name, (targets, refs) in sources.items():
        tag, at = F.lit(name).alias("ref_table"), F.col("at").cast("timestamp_ntz")
        born, gone = (F.col(x).cast("timestamp_ntz").alias(x) for x in ("born", "gone"))
        long.append(targets.select(tag, "ref_key", F.lit(1).alias("parent"), born, gone, none.alias("first_at"), none.alias("last_at")))
        long.append(refs.select(tag, "ref_key", F.lit(0).alias("parent"), none.alias("born"), none.alias("gone"), at.alias("first_at"), at.alias("last_at")))
    groups = reduce(DataFrame.unionByName, long).groupBy("ref_table", "ref_key").agg(
        F.max("parent").alias("parent"), F.min("born").alias("born"), F.min("gone").alias("gone"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum(1 - F.col("parent")).alias("children")
    )
    return groups.where("children > 0 and (parent = 0 or born > first_at or gone <= last_at)").select("ref_table", "ref_key", "parent", "born", "gone")
