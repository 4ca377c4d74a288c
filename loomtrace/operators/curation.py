"""Label coverage, workspaces, queues and decisions of a curated dataset, as joins of targets with saved results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statuses(targets: DataFrame, results: DataFrame, configurations: list[str], categories: list[int]) -> DataFrame:
    """Each target under each configuration: pending, changed_input, invalid or available, with the saved category.

    targets: target, input_hash; results: target, configuration, input_hash, category.
    Configurations are a short list, sent along with the targets.
    """
    each = targets.withColumn("configuration", F.explode(F.array(*map(F.lit, configurations))))
    saved = results.select("target", "configuration", F.col("input_hash").alias("saved_hash"), "category", F.lit(True).alias("saved"))
    j = each.join(saved, ["target", "configuration"], "left")
    status = (
        F.when(F.col("saved").isNull(), "pending").when(~F.col("saved_hash").eqNullSafe(F.col("input_hash")), "changed_input")
        .when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "invalid").otherwise("available")
    )
    return j.select("target", "configuration", status.alias("status"), "category")


def outside(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Saved results of what is no target."""
    return results.join(targets.select("target").distinct(), "target", "left_anti").select("target", "configuration")


def workspace(matrix: DataFrame, reference: str) -> DataFrame:
    """One row a target: the results by configuration, how the available ones compare, whether all are there, and the reference's label.

    matrix: ``statuses``; a target has as many rows as there are configurations.
    """
    available = F.col("status") == "available"
    rows = matrix.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("configuration", "status", "category"))).alias("results"), F.count_if(available).alias("n"),
        F.count_distinct(F.when(available, F.col("category"))).alias("distinct"), F.max(F.when(available & (F.col("configuration") == reference), F.col("category"))).alias("category"),
    )
    comparison = F.when(F.col("n") < 2, "insufficient").when(F.col("distinct") > 1, "disagreement").otherwise("agreement")
    return rows.select("target", "results", comparison.alias("comparison"), (F.col("n") == F.size("results")).alias("complete"), "category", F.when(F.col("category").isNull(), "unlabeled").otherwise("inferred").alias("label"))


def summary(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counters of a workspace: rows (comparison, complete, label, active) and pairs (decision, left_active, right_active)."""
    active = F.col("active")
    own = rows.agg(
        F.count("*").alias("turns"), *(F.count_if(F.col("label") == x).alias(x) for x in ("unlabeled", "inferred", "verified")), F.count_if(~active).alias("removed"),
        F.count_if((F.col("comparison") == "disagreement") & (F.col("label") != "verified") & active).alias("unresolved"), F.count_if(~F.col("complete")).alias("incomplete"),
    )
    of = pairs.agg(F.count("*").alias("suggestions"), F.count_if((F.col("decision") == "pending") & F.col("left_active") & F.col("right_active")).alias("pending_pairs"))
    return own.crossJoin(of)  # one row each


def queues() -> Column:
    """The queues that a row is in."""
    disagrees = (F.col("comparison") == "disagreement") & (F.col("label") != "verified")
    return F.array_compact(F.array(F.lit("all"), F.when(F.col("active") & disagrees, "disagreements"), F.when(F.col("active") & (F.col("label") == "unlabeled"), "unlabeled"), F.when(F.col("label") == "verified", "verified"), F.when(~F.col("active"), "removed")))


ACTIONS = ("verify", "reopen_label", "restore", "keep_both", "remove_left", "remove_right", "reopen_pair")


TURN_ACTIONS = ACTIONS[:3]


def decided(log: DataFrame, rows: DataFrame, pairs: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """A workspace's decisions in order, each accepted or why not (columns workspace, sequence, revision, action, target, category, reviewer, reason).

    rows: workspace, id of its turns; pairs: workspace, id, left, right. A decision must
    name the revision it saw: that of the decisions accepted before it. Verifying needs
    a known category. A turn may be restored at any time; pairs that had removed it or
    for it are pending again. A pair is decided, anew too, only while both its turns are
    active, and no turn goes that another was removed for. Each decision depends on the
    state the last one left, so a workspace's log, people's work, is folded in one group.
    """
    known = rows.select("workspace", F.col("id").alias("target"), F.lit(True).alias("turn"))
    of = pairs.select("workspace", F.col("id").alias("target"), "left", "right")
    turns = F.col("action").isin(*TURN_ACTIONS)
    met = log.where(turns).join(known, ["workspace", "target"], "left").withColumns({"left": F.lit(None).cast("string"), "right": F.lit(None).cast("string")})
    met = met.unionByName(log.where(~turns | F.col("action").isNull()).join(of, ["workspace", "target"], "left").withColumn("turn", F.lit(None).cast("boolean")))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        revision, labels, removed, decisions, sides, out = 0, {}, {}, {}, {}, []
        for r in part.sort_values("sequence").itertuples():
            why, paired = None, isinstance(r.left, str)
            if r.action not in ACTIONS:
                why = "unknown action"
            elif r.revision != revision:
                why = "stale revision"
            elif not isinstance(r.reviewer, str) or not 0 < len(r.reviewer.strip()) <= 200 or not isinstance(r.reason, str) or not 0 < len(r.reason.strip()) <= 2000:
                why = "no reviewer or reason"
            elif r.turn is not True if r.action in TURN_ACTIONS else not paired:
                why = "unknown target"
            elif r.action == "verify" and r.category not in categories:
                why = "unknown category"
            elif r.action in ("verify", "reopen_label"):
                labels[r.target] = r.action == "verify"
            elif r.action == "restore":
                removed.pop(r.target, None)
                decisions.update((p, "pending") for p, d in decisions.items() if d.startswith("remove_") and r.target in sides[p])
            elif r.left in removed or r.right in removed:
                why = "pair is not active"
            else:
                gone, kept = (r.left, r.right) if r.action == "remove_left" else (r.right, r.left)
                if r.action in ("remove_left", "remove_right"):
                    if gone in removed.values():
                        why = "others were removed for it"
                    else:
                        removed[gone] = kept
                if why is None:
                    decisions[r.target], sides[r.target] = "pending" if r.action == "reopen_pair" else r.action, (r.left, r.right)
            revision += why is None
            undecided = sum(d == "pending" for d in decisions.values())
            out.append((r.workspace, r.sequence, why is None, why, revision, len(removed), sum(labels.values()), undecided))
        return pd.DataFrame(out, columns=["workspace", "sequence", "accepted", "why", "after", "removed", "verified", "reopened"])

    kind = log.schema["workspace"].dataType.simpleString()
    return met.groupBy("workspace").applyInPandas(fold, f"workspace {kind}, sequence long, accepted boolean, why string, after long, removed long, verified long, reopened long")


def history_of(turns: DataFrame, pairs: DataFrame, history: DataFrame) -> DataFrame:
    """History entries of each turn: those of the turn itself and of any pair that has it (pairs: pair, left, right; history: target, sequence)."""
    own = turns.select("turn", F.col("turn").alias("target"))
    of = pairs.select(F.explode(F.array("left", "right")).alias("turn"), F.col("pair").alias("target")).join(turns, "turn", "left_semi").select("turn", "target")
    return own.unionByName(of).distinct().join(history, "target").select("turn", "target", "sequence")


def staleness(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Reference labels against rows (columns id, input_hash, text_hash; references with a label): missing, ambiguous, changed input, changed text or usable."""
    n = references.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("input_hash", "text_hash", "label")).alias("r"))
    j = rows.join(n, "id", "left")
    state = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(~F.col("r.input_hash").eqNullSafe(F.col("input_hash")), "changed input")
        .when(~F.col("r.text_hash").eqNullSafe(F.col("text_hash")), "changed text").otherwise("usable")
    )
    return j.select("id", state.alias("state"), F.when(state == "usable", F.col("r.label")).alias("label"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two datasets has, as often as it has them more, by a digest of all columns: none if they match."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(left.columns)]), {"ignoreNullFields": "false"}), 256).alias("digest")
    both = left.select(digest, F.lit(1).alias("k")).unionByName(right.select(digest, F.lit(-1).alias("k")))
    return both.groupBy("digest").agg(F.sum("k").alias("k")).where("k != 0").select(F.when(F.col("k") > 0, "left").otherwise("right").alias("side"), "digest", F.abs("k").alias("n"))


def in_listed_order(rows: DataFrame, key: str, listed: list, limit: int | None = None) -> DataFrame:
    """The rows whose key is listed, with their place in the list, the first ``limit`` of them; the list is a parameter, sent to all tasks."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(listed[:limit])], f"place int, `{key}` {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(wanted), key)
