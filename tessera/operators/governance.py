"""Conversations, access and administration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..sources.scratch import stored


def latest_shares(log: DataFrame) -> DataFrame:
    """Grant and revoke log (conv_id, user_id, permission, action, ts) -> shares in force: the last event wins and must be a grant of view, comment or edit."""
    w = Window.partitionBy("conv_id", "user_id").orderBy(F.col("ts").desc(), F.col("action").desc())
    ok = log.where((F.col("action") == "revoke") | F.col("permission").isin("view", "comment", "edit"))
    return ok.withColumn("rn", F.row_number().over(w)).where("rn = 1 and action = 'grant'").select("conv_id", "user_id", "permission", "ts")


def access(conversations: DataFrame, shares: DataFrame) -> DataFrame:
    """(conv_id, user_id, can_view, can_edit): owners, and users with a share while the conversation is not deleted; only owners change it."""
    own = conversations.select("conv_id", F.col("owner").alias("user_id"), F.lit(True).alias("can_view"), F.lit(True).alias("can_edit"))
    c = conversations.select("conv_id", "owner", "status")
    other = shares.join(c, "conv_id").where("user_id <> owner").select("conv_id", "user_id", (F.col("status") != "deleted").alias("can_view"), F.lit(False).alias("can_edit"))
    return own.union(other).groupBy("conv_id", "user_id").agg(F.max("can_view").alias("can_view"), F.max("can_edit").alias("can_edit"))


def visible(conversations: DataFrame, shares: DataFrame) -> DataFrame:
    """(user_id, conv_id, position): what each user sees in a list, newest first; deleted ones are left out."""
    live = conversations.where("status <> 'deleted'")
    rows = live.select(F.col("owner").alias("user_id"), "conv_id", "updated_at").union(shares.join(live, "conv_id").select("user_id", "conv_id", "updated_at")).distinct()
    w = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), "conv_id")
    return rows.select("user_id", "conv_id", F.row_number().over(w).alias("position"))


def history_window(messages: DataFrame, budget: int, tokens: Column | None = None) -> DataFrame:
    """The newest messages of each conversation that fit ``budget`` together, and the newest in any case.

    Sums run over positive counts, so the first message that does not fit ends the window.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    t = messages.withColumn("tokens", (tokens if tokens is not None else word_count(F.coalesce("text", F.lit("")))).cast("long"))
    t = t.withColumn("rn", F.row_number().over(w)).withColumn("total", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the newest is kept even if it is over the budget itself; then nothing else is
    return t.where((F.col("rn") == 1) | (F.col("total") <= budget)).drop("rn")


def conversation_status(events: DataFrame) -> DataFrame:
    """Event log (conv_id, kind, ts, event_id) -> status, messages and last change; a draft turns active with its first message."""
    status = F.when(F.col("kind").isin("archive", "delete", "restore"), F.struct("ts", "event_id", "kind"))
    g = events.groupBy("conv_id").agg(F.max(status).alias("s"), F.count_if(F.col("kind") == "message").alias("messages"), F.max("ts").alias("updated_at"))
    name = F.when(F.col("s.kind") == "archive", "archived").when(F.col("s.kind") == "delete", "deleted").when((F.col("messages") > 0) | (F.col("s.kind") == "restore"), "active").otherwise("draft")
    return g.select("conv_id", name.alias("status"), "messages", "updated_at")


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns that ``patch`` sets; nulls in the patch leave the old value."""
    p = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(p, key, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in rows.columns))


def seeded(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Rows of ``seed`` are added where their key is new."""
    return existing.unionByName(seed.join(existing, key, "left_anti"))


def replaced(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """All rows of the batch's keys give way to the batch's distinct rows."""
    return existing.join(batch.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(batch.distinct())


def numbered(rows: DataFrame, order: list[str], name: str, per: list[str] | None = None) -> DataFrame:
    """Adds ``name``, numbers from 0 in the order of ``order``, in each group of ``per`` where it is given.

    Rows are dealt to ranges of the order and numbered in each; a few running counts of ranges and groups go to
    all tasks, and no group passes through one task.
    """
    keys = per or []
    t = stored(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    n = t.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = n.select(*keys, "__part", before.alias("__before"))  # a row for each range, and one for each group that begins in it
    out = t.join(starts, [*keys, "__part"])
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    return out.withColumn(name, F.col("__before") + inside).select(*rows.columns, name)


def next_codes(codes: DataFrame, new: DataFrame, code: str, order: str) -> DataFrame:
    """Numbers for new rows, going on from the largest numeric code; codes that are no numbers do not count."""
    top = codes.agg(F.coalesce(F.max(F.expr(f"try_cast({code} as bigint)")), F.lit(0)).alias("top"))
    return numbered(new, [order], "code").crossJoin(F.broadcast(top)).withColumn("code", F.col("top") + F.col("code") + 1).drop("top")


def visible_types(users: DataFrame, types: DataFrame) -> DataFrame:
    """(user_id, doc_type): the active types for each user; all of them where ``allowed`` is null, else those in it.

    ``types`` (doc_type, active) is a dimension; a user of no visible type has no row.
    """
    active = types.where("active").agg(F.sort_array(F.collect_set("doc_type")).alias("__all"))
    own = F.when(F.col("allowed").isNull(), F.col("__all")).otherwise(F.array_intersect("__all", "allowed"))
    return users.crossJoin(F.broadcast(active)).select("user_id", F.explode(own).alias("doc_type"))


def roles_with_permissions(roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Every role with its permissions, roles without any with an empty list."""
    return roles.join(permissions(grants), "role", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def permissions(grants: DataFrame) -> DataFrame:
    """(role, permissions): sorted ``resource:action`` lists."""
    return grants.groupBy("role").agg(F.array_sort(F.collect_set(F.concat_ws(":", "resource", "action"))).alias("permissions"))


def departments_for(users: DataFrame, departments: DataFrame) -> DataFrame:
    """(user_id, departments): all of them for a superadmin, the active ones where ``allowed`` is null, else the active ones among them."""
    every = departments.agg(F.array_sort(F.collect_set("dept_id")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("active"), F.col("dept_id")))).alias("active"))
    u = users.crossJoin(F.broadcast(every))
    pick = F.when(F.col("role") == "superadmin", F.col("all")).when(F.col("allowed").isNull(), F.col("active")).otherwise(F.array_intersect("active", "allowed"))
    return u.select("user_id", pick.alias("departments"))


def audit_page(log: DataFrame, users: DataFrame, where: Column | None, limit: int, offset: int) -> DataFrame:
    """One page of the log, newest first, with user names where they are known."""
    rows = log if where is None else log.where(where)
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).offset(offset).limit(limit).join(users.select("user_id", "username"), "user_id", "left")


def client_ip(forwarded: Column, host: Column) -> Column:
    """First hop of the forwarded list, else the host, else ``unknown``."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), host, F.lit("unknown"))
