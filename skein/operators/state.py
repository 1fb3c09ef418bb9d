"""Changes of state as functions from old rows to new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with `_touch`: whether an end is among ids."""
    i = ids.select(F.col("id").alias("_i")).distinct().withColumn("_y", F.lit(True))
    e = edges.join(i.withColumnRenamed("_y", "_s"), F.col("source") == F.col("_i"), "left").drop("_i")
    e = e.join(i.withColumnRenamed("_y", "_g"), F.col("target") == F.col("_i"), "left").drop("_i")
    return e.withColumn("_touch", F.coalesce("_s", "_g", F.lit(False))).drop("_s", "_g")


def reprocess_edges(edges: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """The edges that stay before a document's engines run again: `all` drops what touches it, `smart` only rejected ones, `add_new` none."""
    if mode == "add_new":
        return edges
    e = _touching(edges, ids)
    drop = F.col("_touch") if mode == "all" else F.col("_touch") & F.col("user_validated").eqNullSafe(False)
    return e.where(~drop).drop("_touch")


def delete_document(chunks: DataFrame, edges: DataFrame, document_id: int) -> tuple[DataFrame, DataFrame]:
    gone = chunks.where(F.col("document_id") == document_id)
    return chunks.where(F.col("document_id") != document_id), _touching(edges, gone).where("not _touch").drop("_touch")


def version_swap(old: DataFrame, new: DataFrame, document_ids: DataFrame, batch: str, ok: bool = True) -> DataFrame:
    """The snapshot after new chunks replace the documents' current ones; if not ok, the old snapshot as it was."""
    if not ok:
        return old
    touched = document_ids.select("document_id").distinct()
    rest = old.join(touched, "document_id", "left_anti")
    return rest.unionByName(new.withColumn("is_current", F.lit(True)).withColumn("reprocessing_batch", F.lit(batch)), allowMissingColumns=True)


def import_chunks(old: DataFrame, new: DataFrame, strategy: str, key: list[str], columns: list[str]) -> DataFrame:
    """skip: only new keys are added. replace: documents in new are replaced. merge_smart: given columns are taken from new where there."""
    if strategy == "skip":
        return old.unionByName(new.join(old.select(*key), key, "left_anti"))
    if strategy == "replace":
        return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)
    n = new.select(*key, *[F.col(c).alias("_n_" + c) for c in columns])
    return old.join(n, key, "left").select(*[F.coalesce("_n_" + c, c).alias(c) if c in columns else F.col(c) for c in old.columns])


def correct_chunks(chunks: DataFrame, corrections: DataFrame) -> DataFrame:
    """chunks (id, document_id, chunk_index, start_offset, end_offset, history) with corrections (id, new_start, new_end) applied.

    A correction that is empty or runs into the chunk before or after (as they stand) is rejected; an accepted one appends the old interval to the history.
    """
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    c = chunks.withColumn("_p", F.lag("end_offset").over(w)).withColumn("_n", F.lead("start_offset").over(w)).join(corrections, "id", "left")
    ok = F.col("new_start").isNotNull() & (F.col("new_end") > F.col("new_start")) & F.coalesce(F.col("new_start") >= F.col("_p"), F.lit(True)) & F.coalesce(F.col("new_end") <= F.col("_n"), F.lit(True))
    c = c.withColumn("status", F.when(F.col("new_start").isNull(), "unchanged").when(ok, "corrected").otherwise("rejected"))
    old = F.struct("start_offset", "end_offset")
    return c.select("id", "document_id", "chunk_index", F.when(ok, F.concat("history", F.array(old))).otherwise(F.col("history")).alias("history"), F.when(ok, F.col("new_start")).otherwise(F.col("start_offset")).alias("start_offset"), F.when(ok, F.col("new_end")).otherwise(F.col("end_offset")).alias("end_offset"), "status")


def review(components: DataFrame, decisions: DataFrame) -> DataFrame:
    """components (id, needs_review, ...) after decisions (id, accept): accepted ones need no review, discarded ones go; the last decision of an id counts."""
    d = decisions.groupBy("id").agg(F.max_by("accept", "seq").alias("accept"))
    r = components.join(d, "id", "left").where("coalesce(accept, true)")
    return r.withColumn("needs_review", F.col("needs_review") & F.col("accept").isNull()).drop("accept")


def touched(old: DataFrame, new: DataFrame, key: str, now) -> DataFrame:
    """new (key, columns) with updated_at: `now` for rows that are new or differ from old in any column, else old's updated_at. Nulls equal nulls."""
    columns = [c for c in new.columns if c != key]
    was = old.select(key, F.struct(*columns).alias("_was"), "updated_at")
    same = F.struct(*columns).eqNullSafe(F.col("_was"))
    return new.join(was, key, "left").withColumn("updated_at", F.when(same, F.col("updated_at")).otherwise(now)).drop("_was")


def upsert_weights(users: DataFrame, kept: DataFrame, updates: DataFrame, engines: list[str]) -> DataFrame:
    """users (user_id) with preferences: updates (user_id, engines, method) over kept ones, equal weights and 'linear' for users without either.

    Weights whose sum is off 1 by more than 0.01 are divided by it and rounded to three places; a sum of 0 gives equal weights. A null method
    keeps the one that is there. At most one row a user on each side.
    """
    total = sum((F.col(e) for e in engines), F.lit(0.0))
    fit = [F.when(total == 0, F.round(F.lit(1 / len(engines)), 3)).when(F.abs(total - 1) > 0.01, F.round(F.col(e) / total, 3)).otherwise(F.col(e).cast("double")).alias(f"_u_{e}") for e in engines]
    u = updates.select("user_id", *fit, F.col("method").alias("_u_method"), F.lit(True).alias("_u"))
    k = kept.select("user_id", *[F.col(e).cast("double").alias(f"_k_{e}") for e in engines], F.col("method").alias("_k_method"), F.lit(True).alias("_k"))
    j = users.select("user_id").join(u, "user_id", "left").join(k, "user_id", "left")
    origin = F.when(F.col("_u") & F.col("_k"), "updated").when(F.col("_u"), "inserted").when(F.col("_k"), "kept").otherwise("default")
    return j.select("user_id", *[F.coalesce(F.when(F.col("_u"), F.col(f"_u_{e}")), f"_k_{e}", F.round(F.lit(1 / len(engines)), 3)).alias(e) for e in engines], F.coalesce("_u_method", "_k_method", F.lit("linear")).alias("method"), origin.alias("origin"))


def import_review(candidates: DataFrame, decisions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """candidates (id, document_id, start_offset, end_offset, color, note) after decisions (id, accept): their states, and the components of new annotations.

    Accepted ones become an entity of the candidate's id with Position, Visual, Content (if there is a note) and Temporal rows; without a
    decision a candidate is pending. At most one decision an id.
    """
    j = candidates.join(decisions.select("id", "accept"), "id", "left")
    state = F.when(F.col("accept"), "accepted").when(~F.col("accept"), "rejected").otherwise("pending")
    kinds = F.array_compact(F.array(F.lit("Position"), F.lit("Visual"), F.when(F.col("note").isNotNull(), F.lit("Content")), F.lit("Temporal")))
    c = j.where("accept").select("id", "document_id", "start_offset", "end_offset", "color", "note", F.explode(kinds).alias("component_type"))
    at = F.col("component_type") == "Position"
    value = F.when(F.col("component_type") == "Visual", F.col("color")).when(F.col("component_type") == "Content", F.col("note"))
    rows = c.select(F.col("id").alias("entity_id"), "component_type", "document_id", F.when(at, F.col("start_offset")).alias("start_offset"), F.when(at, F.col("end_offset")).alias("end_offset"), value.alias("value"), now.alias("created_at"))
    return j.select("id", state.alias("status")), rows


def resume_plan(jobs: DataFrame, files: DataFrame, stages: list[str]) -> DataFrame:
    """jobs (id, resume_count, last_stage, path, hash) against the files of checkpoints (path, content): where each job goes on.

    A job that was resumed, names a known stage and whose file's SHA-256 begins with its hash goes on after that stage; a job past the last
    stage is done. All others begin at the first stage, for a reason: fresh, no_stage, missing (no file or no hash), changed.
    """
    f = files.select("path", F.sha2("content", 256).alias("_sha"))
    j = jobs.join(f, "path", "left")
    at = F.array_position(F.array(*map(F.lit, stages)), F.col("last_stage"))
    reason = (F.when(F.coalesce("resume_count", F.lit(0)) == 0, "fresh").when(F.coalesce(at, F.lit(0)) == 0, "no_stage").when(F.col("_sha").isNull() | (F.coalesce(F.length("hash"), F.lit(0)) == 0), "missing")
              .when(~F.startswith(F.col("_sha"), F.col("hash")), "changed").when(at == len(stages), "done").otherwise("resumed"))
    after = F.get(F.array(*map(F.lit, stages)), at.cast("int"))
    return j.select("id", reason.alias("reason"), F.when(reason == "resumed", after).when(reason != "done", stages[0]).alias("next_stage"))
