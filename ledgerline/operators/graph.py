"""Graphs: reach of a change, lineage matches, blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.functions.lineage import cut

#: Levels after which those found are joined to one table.
LEVELS = 16
#: Names that are sent to all nodes; rows of a string of characters that one task gets.
FEW_NAMES = 100_000
SLICE_ROWS = 100_000


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): the fewest steps from any start, however many; a start that a cycle leads back to is included. Edges source, target.

    Level by level: each step is one join of the new nodes, so a cycle ends where nothing is new.
    """
    edges = cut(edges.select("source", "target").distinct())
    found = None
    front = start.select(F.col("node"))
    depth = 0
    while True:
        depth += 1
        step = front.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        if found is not None:
            step = step.join(found.select("node"), "node", "left_anti")
        step = cut(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        if depth % LEVELS == 0:
            found = cut(found)
        front = step.select("node")
    return found if found is not None else start.select("node", F.lit(0).alias("depth")).filter(F.lit(False))


def direct(subscriptions: DataFrame, source: str) -> DataFrame:
    """Subscriptions to a source, by its name or its contract."""
    return subscriptions.filter((F.col("source") == source) | (F.col("source_contract") == source))


def _grams(text: Column) -> Column:
    """The distinct strings of one to three characters in a text."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, (1, 2, 3))))


def lineage_matches(nodes: DataFrame, names: DataFrame, few: int = FEW_NAMES, most: int = SLICE_ROWS) -> DataFrame:
    """Nodes whose label or path holds a name, in either case, once each; nodes node_id, label, path; names name.

    A name is looked for where the rarest of its strings of three characters is (all of a shorter name), by an equi-join; so no name meets every node.
    Up to ``few`` names are sent to the nodes. More meet them by a shuffle in which a string's nodes are cut to slices of about ``most``, as one string may be
    in every node; a name goes to each of its string's slices.
    """
    n = names.select(F.lower("name").alias("name")).filter("name <> ''").distinct()
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("label", "path")]
    at = nodes.select("node_id", "label", "path", F.explode(F.array_distinct(F.concat(*map(_grams, low)))).alias("gram"))
    # hints, as Spark takes what is made from a small file for small, and would broadcast it
    often = cut(at.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    longest = F.filter(_grams(F.col("name")), lambda g: F.length(g) == F.least(F.length("name"), F.lit(3)))
    asked = n.withColumn("gram", F.explode(longest)).join(often.hint("merge"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = cut(asked.groupBy("name").agg(F.min(F.struct("n", "gram")).alias("k")).filter("k.n > 0").select("name", "k.gram", "k.n"))  # a gram that no node has: no match
    if key.limit(few + 1).count() <= few:
        met = at.join(F.broadcast(key.drop("n")), "gram")
    else:
        # no more strings are sent out than have several slices, which are 100,000 at most
        rows = max(most, (often.agg(F.sum("n")).first()[0] or 0) // 100_000)
        slices = F.ceil(F.col("n") / rows)
        cut_up = often.filter(F.col("n") > rows).select("gram", slices.alias("_slices"))
        placed = at.join(F.broadcast(cut_up), "gram", "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("node_id", "label", "path"), F.col("_slices")), F.lit(0).cast("bigint"))).drop("_slices")
        sent = key.select("name", "gram", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("_slice"))
        met = placed.hint("merge").join(sent, ["gram", "_slice"])
    hit = met.filter(F.contains(low[0], F.col("name")) | F.contains(low[1], F.col("name")))
    return hit.dropDuplicates(["node_id", "path"]).select("node_id", "label", "path")


def catalog_status(contracts: DataFrame, contract_id: str) -> tuple[str, str | None]:
    """(status, where its data are) of a contract in a catalog (id, status, data_path); unknown where it isn't in it."""
    row = contracts.filter(F.col("id") == contract_id).select("status", "data_path").first()
    return (row["status"] or "unknown", row["data_path"]) if row else ("unknown", None)


def blame(commits: DataFrame, now: str, hops: int = 0, most: int = 5, per_day: float = 0.1, per_hop: float = 0.2) -> DataFrame:
    """The commits of the highest scores (hash, author, ts): a tenth less a day of age, a fifth less a hop; no time is thirty days."""
    days = F.coalesce((F.lit(now).cast("timestamp").cast("double") - F.col("ts").try_cast("timestamp").cast("double")) / 86400, F.lit(30.0))
    scored = commits.withColumn("score", X.blame_score(days, F.lit(hops), per_day, per_hop))
    return scored.orderBy(F.col("score").desc(), "hash").limit(most)


def attribute(results: DataFrame, contract_id: str, snapshot_id: str, reach: DataFrame, culprits: DataFrame) -> DataFrame:
    """Every result that isn't PASS with its stable id, the depth and number of nodes it reaches, and the most likely commit."""
    spread = reach.agg(F.count(F.lit(1)).alias("reached"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    first = culprits.agg(F.max_by("hash", "score").alias("commit"))
    ids = X.uuid5(F.concat_ws(":", F.lit(contract_id), F.lit(snapshot_id), F.col("check_id")))
    return results.filter("status <> 'PASS'").crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(first)).select(ids.alias("violation_id"), "check_id", "status", "severity", "reached", "depth", "commit")  # one row each
