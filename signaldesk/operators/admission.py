"""Budgeted admission: each queue's rows in order, until the budgets are used up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signaldesk.operators.ranking import top_n

CLASS = ["queue", "eligible", "tier"]
STATE = ("struct<primary: bigint, override: bigint, primary_micro: bigint, override_micro: bigint, full: bigint, short: bigint, "
         "taken: array<struct<item_id: bigint, budget_kind: string, tier: string>>>")


def class_bound(primary: int, override: int, limit: int) -> int:
    """Rows of one class that can be admitted at most.

    Rows of a class differ only in place and cost, and admission never looks at a row's own cost.  Budgets only fall, so
    once a row of a class is refused, all later ones are: the admitted rows of a class are its first ones.
    """
    return min(limit, primary + override)


def admit(candidates: DataFrame, order: list[Column], primary: int, override: int, full: int, short: int, limit: int,
          primary_micro: int = 1 << 60, override_micro: int = 1 << 60) -> DataFrame:
    """Admitted rows with their place in the order of admission (``rank``), budget kind and tier.

    ``candidates``: queue, item_id, eligible (override), tier (preferred), micro (estimated cost, not negative) and what
    ``order`` names.  A row takes the primary budget, else the override budget when eligible; a full tier spills to short
    when full is used up; a refused row uses nothing; admission ends at ``limit``.  Only ``class_bound`` rows of each
    class reach the fold, however long a queue is.
    """
    rows = candidates.withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    first = top_n(rows, CLASS, order, class_bound(primary, override, limit))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(*order)))
    queues = placed.groupBy("queue").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.col("item_id").cast("bigint").alias("item_id"), "eligible", "tier", F.col("micro").cast("bigint").alias("micro")))).alias("rows"))

    def step(state: Column, row: Column) -> Column:
        kind = F.when((state["primary"] > 0) & (state["primary_micro"] > 0), "primary").when(
            row["eligible"] & (state["override"] > 0) & (state["override_micro"] > 0), "override")
        tier = F.when((row["tier"] == "full_ai") & (state["full"] > 0), "full_ai").when(state["short"] > 0, "short_ai")
        ok = kind.isNotNull() & tier.isNotNull() & (F.size(state["taken"]) < limit)

        def used(name: str, when: Column, amount) -> Column:
            return (state[name] - F.when(ok & when, amount).otherwise(0)).alias(name)

        taken = F.struct(row["item_id"].alias("item_id"), kind.alias("budget_kind"), tier.alias("tier"))
        after = F.struct(
            used("primary", kind == "primary", 1), used("override", kind == "override", 1),
            used("primary_micro", kind == "primary", row["micro"]), used("override_micro", kind == "override", row["micro"]),
            used("full", tier == "full_ai", 1), used("short", tier == "short_ai", 1),
            F.when(ok, F.concat(state["taken"], F.array(taken))).otherwise(state["taken"]).alias("taken"))
        return after.cast(STATE)

    start = F.struct(*[F.lit(v).cast("bigint") for v in (primary, override, primary_micro, override_micro, full, short)], F.array()).cast(STATE)
    admitted = queues.select("queue", F.posexplode(F.aggregate("rows", start, step)["taken"]).alias("place", "row"))
    return admitted.select("queue", "row.item_id", (F.col("place") + 1).alias("rank"), "row.budget_kind", "row.tier")
