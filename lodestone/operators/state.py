"""What rows of the store may become: machines, jobs, facts, the focus of conversations, invariants, routing of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import written

# Which status may follow which.
MACHINES = {
    "document": {"PENDING": ["PROCESSING", "FAILED", "DELETING"], "PROCESSING": ["COMPLETED", "FAILED", "DELETING"], "COMPLETED": ["PROCESSING", "DELETING"], "FAILED": ["PENDING", "PROCESSING", "DELETING"]},
    "job": {"PENDING": ["RUNNING", "CANCELLED"], "RUNNING": ["COMPLETED", "FAILED", "DEAD_LETTER", "CANCELLED"], "FAILED": ["PENDING", "CANCELLED"], "DEAD_LETTER": ["CANCELLED"]},
    "message": {"RECEIVED": ["PROCESSING"], "PROCESSING": ["COMPLETED", "FAILED", "CANCELLED"]},
}
LEASE, HEARTBEAT, ATTEMPTS, BACKOFF, LONGEST = 300, 30, 3, 10, 900
VISUAL = ["FIGURE", "CHART", "DIAGRAM", "TABLE"]


def transitions(spark) -> DataFrame:
    """machine, before, now of every step that is allowed: a table of some twenty rows."""
    return spark.createDataFrame([(m, a, b) for m, steps in MACHINES.items() for a, after in steps.items() for b in after], "machine string, before string, now string")


def illegal_steps(rows: DataFrame) -> DataFrame:
    """Rows (machine, before, now, ...) whose step isn't allowed."""
    return rows.join(F.broadcast(transitions(rows.sparkSession)), ["machine", "before", "now"], "left_anti")


def backoff(attempts: Column, base: int = BACKOFF, most: int = LONGEST) -> Column:
    """Seconds until the next attempt: doubled each time, from ``base`` to ``most``."""
    doubled = F.call_function("shiftleft", F.lit(base).cast("long"), F.least(attempts - 1, F.lit(32)).cast("int"))
    return F.when(attempts <= 0, F.lit(base).cast("long")).otherwise(F.least(doubled, F.lit(most).cast("long")))


def claimable(jobs: DataFrame, now: Column, kinds: list[str]) -> DataFrame:
    """Jobs (job_type, status, attempts, max_attempts, scheduled_at) that a worker for these kinds may take."""
    again = (F.col("status") == "FAILED") & (F.col("attempts") < F.col("max_attempts"))
    due = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= now)
    return jobs.where(F.col("job_type").isin(kinds) & ((F.col("status") == "PENDING") | again) & due)


def commanded(jobs: DataFrame) -> DataFrame:
    """Jobs (status, attempts, max_attempts, scheduled_at, at, command) as they are after the command; null new_status where it isn't allowed."""
    status, left = F.col("status"), F.col("attempts") < F.col("max_attempts")
    can = lambda target: status.isin([a for a, after in MACHINES["job"].items() if target in after])
    is_ = lambda name: F.col("command") == name
    new = (
        F.when(is_("claim") & can("RUNNING"), "RUNNING")
        .when(is_("heartbeat") & (status == "RUNNING"), "RUNNING")
        .when(is_("complete") & can("COMPLETED"), "COMPLETED")
        .when(is_("fail") & can("FAILED") & left, "FAILED")
        .when(is_("fail") & can("DEAD_LETTER") & ~left, "DEAD_LETTER")
        .when(is_("requeue") & can("PENDING") & left, "PENDING")
        .when(is_("cancel") & can("CANCELLED"), "CANCELLED")
    )
    out = jobs.withColumn("new_status", new)
    leased = (F.col("new_status") == "RUNNING") & F.col("command").isin("claim", "heartbeat")
    later = F.timestamp_seconds(F.unix_seconds(F.col("at").cast("timestamp")) + backoff(F.col("attempts"))).cast("timestamp_ntz")
    return out.withColumns(
        {
            "new_attempts": F.when(F.col("new_status").isNotNull(), F.col("attempts") + F.when(is_("claim"), 1).otherwise(0)),
            "lease_until": F.when(leased, F.col("at") + F.expr(f"interval {LEASE} seconds")),
            "next_at": F.when(F.col("new_status") == "FAILED", later).when(F.col("new_status") != "DEAD_LETTER", F.col("scheduled_at")),
        }
    )


def fact_status(status: Column, command: Column) -> Column:
    """The status of a fact after a command, or null where it isn't allowed."""
    return (
        F.when((command == "supersede") & (status == "ACTIVE"), "SUPERSEDED")
        .when((command == "dispute") & status.isin("ACTIVE", "UNCONFIRMED"), "DISPUTED")
        .when((command == "expire") & (status == "ACTIVE"), "EXPIRED")
        .when((command == "delete") & ~status.isin("DELETED", "SUPERSEDED"), "DELETED")
    )


def focus(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The focus of a conversation after each change (command, target): document, page, figure, table.

    A document resets all that depends on it; a page the selection; a figure and a table replace each other; clearing
    keeps the document alone.
    """
    along = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    c = F.col("command")

    def latest(own: str, resets: list[str]) -> Column:
        """The target of the last change of its own kind, unless one of the resets came behind it."""
        return F.last(F.when(c == own, F.struct(F.col("target").alias("t"))).when(c.isin(resets), F.struct(F.lit(None).cast("long").alias("t"))), ignorenulls=True).over(along)["t"]

    return changes.withColumns(
        {
            "document": latest("document", []), "page": latest("page", ["document", "clear"]),
            "figure": latest("figure", ["document", "page", "table", "clear"]), "selected": latest("table", ["document", "page", "figure", "clear"]),
        }
    )


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold, joined by commas; empty for a sound row."""
    return F.concat_ws(",", *[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])


def narrowed(chunks: DataFrame, **wanted: object) -> DataFrame:
    """Chunks that meet every filter that is given: document_ids, chapter, section, page_number, element_types, table_id, figure_id, language."""
    single = {"chapter": "chapter", "section": "section", "table_id": "table_id", "figure_id": "figure_id", "language": "language"}
    for name, value in wanted.items():
        if value is None or value == []:
            continue
        if name in single:
            chunks = chunks.where(F.col(single[name]) == value)
        elif name == "page_number":
            chunks = chunks.where(F.lit(value).between(F.col("page_start"), F.col("page_end")))
        elif name in ("document_ids", "element_types"):
            chunks = chunks.where(F.col({"document_ids": "document_id", "element_types": "element_type"}[name]).isin(value))
        else:
            raise ValueError(f"no such filter: {name}")
    return chunks


def searchable(chunks: DataFrame) -> DataFrame:
    """Children with a vector: parents and rows without one aren't searched."""
    return chunks.where("parent_id is not null and embedding is not null")


def routed(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """request_id, outcome, provider, fallback. requests: request_id, task, private; providers (few rows): provider, place, task, local, and answers: request_id, provider, result.

    In the order of ``place``, of those that can do the task: a private request is refused at the first that isn't local;
    a fatal error ends it, a passing one leads on, and the first that answers is taken.
    """
    step = F.when(F.col("private") & ~F.col("local"), "REFUSED").when(F.col("result") == "fatal", "FAILED").when(F.col("result") == "ok", "ANSWERED")
    met = requests.join(providers, ["request_id", "task"]).withColumn("step", step)
    first = F.min_by(F.struct("step", "provider", "place"), F.when(F.col("step").isNotNull(), F.col("place")))
    folded = met.groupBy("request_id").agg(first.alias("f"), F.min("place").alias("least"))
    out = requests.select("request_id").join(folded, "request_id", "left")
    outcome = F.when(F.col("least").isNull(), "UNSUPPORTED").otherwise(F.coalesce("f.step", F.lit("EXHAUSTED")))
    answered = F.col("f.step") == "ANSWERED"
    return out.select("request_id", outcome.alias("outcome"), F.when(answered, F.col("f.provider")).alias("provider"), F.coalesce(answered & (F.col("f.place") > F.col("least")), F.lit(False)).alias("fallback"))


def shed(costs: DataFrame, key: str, fixed: str, slots: list[str], budget: int = 8000) -> DataFrame:
    """key, steps, total: how many of the slots, in this order, must go until what is left fits the budget.

    costs has a column for what always stays and one for each slot; all slots may go and still not be enough.
    """
    totals, rest = [], F.col(fixed)
    for slot in reversed(slots):
        totals.append(rest)
        rest = rest + F.col(slot)
    left = F.array(rest, *reversed(totals))  # after 0, 1, ... steps
    steps = F.array_position(F.transform(left, lambda x: x <= budget), True)
    steps = F.when(steps > 0, steps - 1).otherwise(F.lit(len(slots))).cast("int")
    return costs.select(key, steps.alias("steps"), F.get(left, steps).alias("total"))


def hops(edges: DataFrame, seeds: DataFrame, most_hops: int, most_nodes: int) -> DataFrame:
    """seed, node, hop of the nodes (at most ``most_nodes`` for each seed, nearest first, then by name) that edges (a, b) reach from seeds (seed, node).

    Of a node only the ``2 * most_nodes`` neighbours that come first are followed: a seed keeps at most ``most_nodes``,
    and has visited no more, so no later one can be among them. At every hop a seed's frontier is cut to what it may still
    keep, without nodes it has visited; so hubs and long walks stay bounded, and the rows are those of following all.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    near = both.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("_n") <= 2 * most_nodes).drop("_n")
    near = written(near, "neighbours")
    first = seeds.select("seed", "node").distinct().withColumn("n", F.row_number().over(W.partitionBy("seed").orderBy("node"))).where(F.col("n") <= most_nodes)
    found = written(first.select("seed", "node", F.lit(0).alias("hop")), "visited")
    for hop in range(1, most_hops + 1):
        frontier = found.where(F.col("hop") == hop - 1).select("seed", F.col("node").alias("a"))
        new = frontier.join(near, "a").select("seed", F.col("b").alias("node")).distinct().join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        held = found.groupBy("seed").agg(F.count("*").alias("held"))
        placed = new.withColumn("n", F.row_number().over(W.partitionBy("seed").orderBy("node"))).where(F.col("n") <= most_nodes)
        kept = placed.join(held, "seed").where(F.col("n") + F.col("held") <= most_nodes)
        found = written(found.unionByName(kept.select("seed", "node", F.lit(hop).alias("hop"))), "visited")
    return found
