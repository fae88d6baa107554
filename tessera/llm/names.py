"""Problem 4: names as typed linked to known entities by merging and matching again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from .name_text import NICKNAMES, Profile, Scorer, Spelling, block_keys, nickname_table

#: How much nearer the nearest entity must be than the next.
MARGIN = 0.35
#: Spellings merged at no more than this bring their words into the profile.
SURE = 1.5


def _hash(keys) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def _forms(batches):
    for pdf in batches:
        rows = [(raw, s.form()) for raw in pdf["raw"] if not (s := Spelling(raw)).empty]
        yield pd.DataFrame(rows, columns=["raw", "form"])


def _form_keys(batches):
    for pdf in batches:
        rows = []
        for form in pdf["form"]:
            s = Spelling.of_form(form)
            rows.append((form, _hash(block_keys({*s.words, s.joined}, s.joined, s.acronym))))
        yield pd.DataFrame(rows, columns=["form", "keys"])


def _profiles(batches):
    for pdf in batches:
        rows = []
        for i, kind, name in zip(pdf["entity_id"], pdf["kind"], pdf["name"]):
            k = Profile(i, kind, name)
            if k.joined:
                rows.append((i, kind, name, k.head_key, list(k.rest)))
        yield pd.DataFrame(rows, columns=["entity_id", "kind", "name", "head", "rest"])


def _profile_keys(batches):
    for pdf in batches:
        rows = []
        for i, kind, name, alone, gains in zip(pdf["entity_id"], pdf["kind"], pdf["name"], pdf["alone"], pdf["gains"]):
            rows += [(i, key) for key in _hash(Profile(i, kind, name, alone, gains).keys())]
        yield pd.DataFrame(rows, columns=["entity_id", "key"])


def _score(nicknames: dict[str, frozenset[str]]):
    def run(batches):
        scorer, profiles = Scorer(nicknames), {}
        for pdf in batches:
            rows = []
            for form, i, kind, name, alone, gains in zip(pdf["form"], pdf["entity_id"], pdf["kind"], pdf["name"], pdf["alone"], pdf["gains"]):
                if i not in profiles:
                    if len(profiles) >= 10_000:
                        profiles.clear()
                    profiles[i] = Profile(i, kind, name, alone, gains)
                if found := scorer.match(Spelling.of_form(form), profiles[i]):
                    rows.append((form, i, found[0], list(found[1])))
            yield pd.DataFrame(rows, columns=["form", "entity_id", "cost", "gains"])

    return run


def resolve_names(df: DataFrame, known: DataFrame, fields: list[str], id_col: str = "row_id", nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(id, field, entity_id): one row per value of `fields` that means an entity of known (entity_id, kind, name).

    Spellings that are the same once decoration (case, marks, legal forms, roles, order of addresses) is gone merge into
    one record; each known entity is a profile. In each round the records not yet merged that share a block key with a
    profile are scored against it; the nearest, if no other is about as near, merges with it, and the profile takes over
    what is new in the spelling: variants of its words (short forms, familiar names, typos), their initials, joined
    spellings. Richer profiles enter blocking and scoring again, so that a record may match a merged spelling that is too
    far from the name itself. The rounds end when nothing more merges or no profile grows. Costs of all rounds count, so
    a record between two entities stays open.

    Null, empty and blank values and signs give no row, nor do values about equally near to two entities; names of known
    entities without a letter or digit are left out. Repeated rows stay repeated; other columns are ignored, whatever
    their names; empty tables give no rows. nicknames maps given names to familiar forms that no rule gives. Nothing is
    sent to the driver or broadcast but by the planner's own check of sizes. A spelling that fills many rows is scored
    once. A profile holds distinct words within some edits of its own, not rows.
    """
    spark = df.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])).alias("_x")
    long = df.select(F.col(id_col).alias("_id"), each).select("_id", "_x.field", "_x.raw").where(F.trim("raw") != "")
    records = written(long.select("raw").distinct().mapInPandas(_forms, "raw string, form string"), "spellings")
    forms = written(records.select("form").distinct().mapInPandas(_form_keys, "form string, keys array<long>"), "forms")

    named = known.select(F.col("entity_id").cast("long").alias("entity_id"), F.col("kind").cast("string").alias("kind"), F.col("name").cast("string").alias("name"))
    named = named.where("name is not null and entity_id is not null").distinct().mapInPandas(_profiles, "entity_id long, kind string, name string, head string, rest array<string>").withColumn("bare", F.size("rest") == 0)
    heads = named.where("head is not null").groupBy("head").agg(F.count("*").alias("n"), F.sum(F.col("bare").cast("int")).alias("n_bare"))
    alone = F.coalesce((F.col("n") == 1) | ((F.col("n_bare") == 1) & F.col("bare")), F.lit(False)).alias("alone")
    entities = written(named.join(heads, "head", "left").select("entity_id", "kind", "name", "rest", alone), "entities")
    words = entities.select("entity_id", F.explode("rest").alias("word"))
    entities = entities.drop("rest")

    grown = entities.withColumn("gains", F.array().cast("array<string>"))
    merged: DataFrame | None = None
    costs: DataFrame | None = None
    gains: DataFrame | None = None
    while True:
        keys = grown.mapInPandas(_profile_keys, "entity_id long, key long")
        left = forms if merged is None else forms.join(merged.select("form"), "form", "left_anti")
        pairs = left.select("form", F.explode("keys").alias("key")).join(keys, "key").select("form", "entity_id").distinct()
        scored = pairs.join(grown, "entity_id").mapInPandas(_score(nickname_table(nicknames)), "form string, entity_id long, cost double, gains array<string>")
        scored = written(scored, "scored")
        all_costs = scored if costs is None else costs.unionByName(scored)
        least = all_costs.groupBy("form", "entity_id").agg(F.min_by(F.struct("cost", "gains"), "cost").alias("m")).select("form", "entity_id", "m.cost", "m.gains")
        ranked = least.groupBy("form").agg(F.min(F.struct("cost", "entity_id", "gains")).alias("first"), F.get(F.sort_array(F.collect_list("cost")), F.lit(1)).alias("second"))  # costs of the few entities near a form
        sure = ranked.where(F.col("second").isNull() | (F.col("second") - F.col("first.cost") >= MARGIN)).select("form", "first.*")
        if merged is not None:
            sure = sure.join(merged.select("form"), "form", "left_anti")
        found = written(sure, "merged")
        merged = found.select("form", "entity_id") if merged is None else merged.unionByName(found.select("form", "entity_id"))
        costs = all_costs
        new = found.where(F.col("cost") <= SURE).select("entity_id", F.explode("gains").alias("gain")).distinct()
        if gains is not None:
            new = new.join(gains, ["entity_id", "gain"], "left_anti")
        new = written(new, "gains")
        if new.isEmpty():
            break
        gains = new if gains is None else gains.unionByName(new)
        shared = gains.groupBy("gain").agg(F.countDistinct("entity_id").alias("n")).where("n > 1").select("gain", F.substring_index("gain", "=", 1).alias("word"))
        every = gains.unionByName(words.join(shared, "word").select("entity_id", "gain")).distinct()
        more = new.select("entity_id").unionByName(words.join(new.select(F.substring_index("gain", "=", 1).alias("word")), "word").select("entity_id")).distinct()
        touched = every.join(more, "entity_id").groupBy("entity_id").agg(F.sort_array(F.collect_set("gain")).alias("gains"))
        grown = written(entities.join(touched, "entity_id"), "profiles")
    resolved = merged.join(records, "form").select("raw", "entity_id")
    return long.join(resolved, "raw").select(F.col("_id").alias(id_col), "field", "entity_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_names(table(spark, sf_dir, "raw_jobs"), table(spark, sf_dir, "known_names"), ["company", "creator"])


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
