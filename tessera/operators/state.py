"""Stored state as new snapshots: upserts, deletions, audits, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_null: bool = True, revive: bool = False) -> DataFrame:
    """The snapshot after ``new`` (one row per key) is merged into ``old``, with a column ``outcome``.

    Null values of ``new`` leave the stored ones, unless ``keep_null`` is off. With ``revive``, rows whose deleted_at
    is set and that come again are undeleted. Outcomes: inserted, updated (a value changed or a row came back),
    skipped (nothing changed), kept (not in ``new``). Rows of ``new`` without a key are left out.
    """
    shared = [c for c in old.columns if c not in keys]
    new = new.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_there"))
    old = old.withColumn("o_there", F.lit(True))
    joined = old.join(new, [F.col(k) == F.col(f"n_{k}") for k in keys], "full")
    out, changed = [F.coalesce(F.col(k), F.col(f"n_{k}")).alias(k) for k in keys], F.lit(False)
    for c in shared:
        if f"n_{c}" not in new.columns:
            out.append(F.col(c))
            continue
        value = F.coalesce(f"n_{c}", c) if keep_null else F.when(F.col("n_there"), F.col(f"n_{c}")).otherwise(F.col(c))
        out.append(value.alias(c))
        changed = changed | ~value.eqNullSafe(F.col(c))
    if revive and "deleted_at" in shared:
        back = F.col("n_there") & F.col("deleted_at").isNotNull()
        out = [x for x, c in zip(out, [*keys, *shared], strict=True) if c not in ("deleted_at", "deleted_by", "deletion_reason")]
        out += [F.when(~F.coalesce(F.col("n_there"), F.lit(False)), F.col(c)).alias(c) for c in ("deleted_at", "deleted_by", "deletion_reason") if c in shared]
        changed = changed | F.coalesce(back, F.lit(False))
    outcome = F.when(F.col("n_there").isNull(), "kept").when(F.col("o_there").isNull(), "inserted").when(changed, "updated").otherwise("skipped")
    return joined.select(*out, outcome.alias("outcome"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def outcomes(df: DataFrame) -> DataFrame:
    return df.groupBy("outcome").agg(F.count("*").alias("n"))


def soft_delete(df: DataFrame, where: Column, at: str, by: str, reason: str) -> DataFrame:
    """Marks rows as deleted; those that are already stay as they are."""
    hit = F.coalesce(where, F.lit(False)) & F.col("deleted_at").isNull()
    return df.withColumns({"deleted_at": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at")), "deleted_by": F.when(hit, F.lit(by)).otherwise(F.col("deleted_by")), "deletion_reason": F.when(hit, F.lit(reason)).otherwise(F.col("deletion_reason"))})


def restore(df: DataFrame, where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in ("deleted_at", "deleted_by", "deletion_reason")})


def hard_delete(df: DataFrame, where: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go, with the reason). A reason is required."""
    if not reason.strip():
        raise ValueError("a deletion needs a reason")
    hit = F.coalesce(where, F.lit(False))
    return df.where(~hit), df.where(hit).withColumn("deletion_reason", F.lit(reason))


def without_expired(df: DataFrame, as_of: str) -> DataFrame:
    return df.where(F.col("deadline").isNull() | (F.col("deadline") >= F.lit(as_of).cast("date")))


def cascade(parents: DataFrame, children: DataFrame, key: str, parent_key: str, how: str = "delete") -> DataFrame:
    """Children after their parents changed: without those that lost their parent, or with the key set to null."""
    there = parents.select(F.col(parent_key).alias("_p")).distinct()
    if how == "delete":
        return children.join(there, F.col(key) == F.col("_p"), "left_semi")
    return children.join(there, F.col(key) == F.col("_p"), "left").withColumn(key, F.col("_p")).drop("_p")


def of_organisation(jobs: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """Records that name the organisation or come from one of its sources."""
    mine = sources.where(F.col("org_name").ilike(f"%{name}%")).select(F.col("id").alias("_s"))
    own = jobs.join(mine, F.col("source_id") == F.col("_s"), "left_semi")
    return jobs.where(F.col("org_name").ilike(f"%{name}%")).unionByName(own).dropDuplicates(["id"])


def toggle(members: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Members after each change adds what is absent and removes what is there: a symmetric difference."""
    return members.select(*keys).join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*keys).distinct().join(members.select(*keys), keys, "left_anti"))


def orphans(index: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Ids of the index that the store lacks."""
    return index.select(key).join(stored.select(key), key, "left_anti")


def verified(hits: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return hits.join(stored.where("deleted_at is null").select(key), key, "left_semi")


def review_update(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews after decisions (id, new_status, new_notes, at): status and notes change, a decided one gets its time."""
    joined = reviews.join(decisions.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return joined.select(*[c for c in reviews.columns if c not in ("status", "review_notes", "reviewed_at")], F.coalesce("new_status", "status").alias("status"), F.coalesce("new_notes", "review_notes").alias("review_notes"), F.when(F.col("new_status").isin("approved", "rejected", "corrected"), F.col("at")).otherwise(F.col("reviewed_at")).alias("reviewed_at"))


def submissions(new: DataFrame, sources: DataFrame, earlier: DataFrame) -> DataFrame:
    """Submitted urls that neither a source nor an earlier submission has, once each."""
    known = sources.select(F.col("careers_url").alias("url")).unionByName(earlier.select("url"))
    return new.dropDuplicates(["url"]).join(known, "url", "left_anti")


def failure_rows(logs: DataFrame, failures: DataFrame, as_of: str, days: int) -> DataFrame:
    """Failed extractions and failed inserts of the last days under common columns."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
    a = logs.where((F.col("status") != "OK") & (F.col("created_at") >= since)).select(F.lit("extraction").alias("kind"), "url", F.col("reason").alias("detail"), F.col("created_at").alias("at"), "source_id")
    b = failures.where(F.col("attempt_at") >= since).select(F.lit("insert").alias("kind"), F.col("source_url").alias("url"), F.col("error").alias("detail"), F.col("attempt_at").alias("at"), "source_id")
    return a.unionByName(b)


def newest(df: DataFrame, column: str, tie: str, most: int = 10_000) -> DataFrame:
    """An export's rows: the newest ones up to its limit."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(tie)).limit(most)
