"""Mixing sources to target weights by min-cost flow (problem 3)."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.llm.budget import clean_domain
from tokenmill.llm.common import written


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) edge of a maximum flow of least cost.

    Successive shortest paths with a queue-driven Bellman-Ford; the graph has a
    node per membership pattern and source, not per record.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        out[a].append(len(to)), to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to)), to.append(a), cap.append(0), cost.append(-w)
    while True:
        dist, via, queued = [None] * n, [-1] * n, [False] * n
        dist[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                b = to[e]
                if cap[e] and (dist[b] is None or dist[a] + cost[e] < dist[b]):
                    dist[b], via[b] = dist[a] + cost[e], e
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(edges))]
        push, b = None, sink
        while b != source:
            push = cap[via[b]] if push is None else min(push, cap[via[b]])
            b = to[via[b] ^ 1]
        b = sink
        while b != source:
            cap[via[b]] -= push
            cap[via[b] ^ 1] += push
            b = to[via[b] ^ 1]


@dataclass
class Plan:
    total: int
    quota: dict[str, int]
    #: (pattern, domain) -> tokens
    flow: dict[tuple[str, str], int]


def route(patterns: dict[str, tuple[list[str], int]], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[str, str], int]:
    """Tokens of each membership pattern that go to each domain.

    The k-th use of a pattern's tokens costs 2k - 1 (a convex k²), so records are
    repeated only when fresh ones are used up; a pattern may be used as often as
    the strictest of its domains allows.
    """
    names, doms = list(patterns), list(targets)
    node = {("p", p): i + 2 for i, p in enumerate(names)} | {("d", d): i + 2 + len(names) for i, d in enumerate(doms)}
    edges, of = [], []
    for p, (members, tokens) in patterns.items():
        for k in range(1, min(targets[d][1] for d in members) + 1):
            edges.append((0, node["p", p], tokens, 2 * k - 1))
            of.append(None)
        for d in members:
            edges.append((node["p", p], node["d", d], 1 << 62, 0))
            of.append((p, d))
    for d in doms:
        edges.append((node["d", d], 1, round(targets[d][0] * total), 0))
        of.append(None)
    flow = min_cost_flow(2 + len(node), edges, 0, 1)
    return {key: f for key, f in zip(of, flow) if key and f}


def reachable_total(patterns: dict[str, tuple[list[str], int]], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every domain that has records meets its share.

    Found by bisection on the flow, since domains may compete for records.
    """
    some = {d for members, tokens in patterns.values() for d in members if tokens}
    wanted = {d: t for d, t in targets.items() if d in some and t[0] > 0}
    own = {p: ([d for d in m if d in wanted], n) for p, (m, n) in patterns.items()}
    own = {p: x for p, x in own.items() if x[0]}
    lo, hi = 0, sum(n * max(targets[d][1] for d in m) for m, n in own.values())
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if sum(route(own, wanted, mid).values()) >= sum(round(t[0] * mid) for t in wanted.values()):
            lo = mid
        else:
            hi = mid - 1
    return lo


def mix(
    records: DataFrame,
    targets: DataFrame,
    id_col: str = "record_id",
    domain_col: str = "domain",
    sequence_col: str = "sequence",
    total_tokens: int | str = "reachable",
    seed: int = 42,
    bucket_rows: int = 50_000,
    max_patterns: int = 4096,
) -> tuple[DataFrame, Plan]:
    """Records to take and how often: id, ``domain``, ``size``, ``uses``; and the plan.

    A record's domains are those of all its rows (case and blanks mean nothing,
    null is the default domain), its size the number of ids (the largest of its
    rows, null as none); rows delivered twice are one record. ``total_tokens`` is
    a number, ``"corpus"`` (the ids of all distinct records of target domains; a
    domain that can't reach its share then falls short and is reported so) or
    ``"reachable"`` (the largest total at which all shares are met). A domain
    without records is left at 0. Domains without a target, records without id
    and empty ones take no part. Repeated target rows count once (largest share).

    Records are only aggregated: sizes by membership pattern go to the driver
    (``max_patterns`` at most, else an error), the flow is routed there, and
    records are then taken in the order of a seeded hash by running sums. The sums
    run inside buckets of the hash, so that no task holds a pattern. Every interval
    ends within one record of its target.
    """
    t = targets.select(clean_domain(F.col("domain")).alias("domain"), "target_share", "max_repeats").filter("target_share >= 0")
    t = t.groupBy("domain").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    goal = {r["domain"]: (float(r["share"]), max(0, r["repeats"] or 0)) for r in t.limit(max_patterns).collect()}
    member = F.transform(F.array_sort(F.collect_set("d")), lambda x: x)
    rows = records.select(
        F.col(id_col).alias("id"), clean_domain(F.col(domain_col)).alias("d"), F.coalesce(F.size(sequence_col), F.lit(0)).alias("n")
    ).filter(F.col("id").isNotNull() & F.col("d").isin(list(goal)))
    one = rows.groupBy("id").agg(member.alias("member"), F.greatest(F.max("n"), F.lit(0)).cast("bigint").alias("size")).filter("size > 0")
    one = written(one.select("id", "size", F.to_json("member").alias("pattern"), F.xxhash64("id", F.lit(seed)).alias("h")), "mix-records")
    seen = one.groupBy("pattern").agg(F.first("size").alias("s"), F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    found = seen.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {r["pattern"]: (json.loads(r["pattern"]), r["tokens"]) for r in found}
    if total_tokens == "reachable":
        total = reachable_total(patterns, goal)
    else:
        total = sum(n for _, n in patterns.values()) if total_tokens == "corpus" else int(total_tokens)
    flow = route(patterns, goal, total)
    # intervals of each pattern's stream (all records once, then all again, ...) by domain
    cuts = []
    for p, (members, tokens) in patterns.items():
        at = 0
        for d in members:
            if f := flow.get((p, d)):
                cuts.append((p, d, at, at + f, tokens))
                at += f
    spark = records.sparkSession
    plan = Plan(total, {d: round(s * total) for d, (s, _) in goal.items()}, flow)
    cut = spark.createDataFrame(cuts, "pattern string, domain string, lo bigint, hi bigint, tokens bigint")
    buckets = max(1, -(-sum(r["n"] for r in found) // bucket_rows))
    keyed = one.join(F.broadcast(cut.select("pattern").distinct()), "pattern", "left_semi").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"))
    order = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("pattern", "bucket", F.coalesce(F.sum("in_bucket").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(base, ["pattern", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the record stands at at, at + tokens, at + 2 tokens, ...; an interval takes it where its middle lies inside
    middle = F.col("at") + (F.col("size") / 2).cast("bigint")
    before = lambda x: F.greatest(F.lit(0), F.ceil((x - middle) / F.col("tokens")))
    uses = (before(F.col("hi")) - before(F.col("lo"))).cast("int")
    taken = placed.join(F.broadcast(cut), "pattern").withColumn("uses", uses).filter("uses > 0")
    return taken.select(F.col("id").alias(id_col), "domain", "size", "uses"), plan


def mix_report(taken: DataFrame, plan: Plan, targets: DataFrame) -> DataFrame:
    """One row per target domain: target and actual share, sizes, records and repeats."""
    t = targets.select(clean_domain(F.col("domain")).alias("domain"), "target_share", "max_repeats").filter("target_share >= 0")
    t = t.groupBy("domain").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = taken.groupBy("domain").agg(
        F.sum(F.col("size") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("records"),
        F.sum("uses").alias("uses"), F.max("uses").alias("most_repeats"),
    )
    quota = taken.sparkSession.createDataFrame(list(plan.quota.items()) or [("", 0)], "domain string, quota bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = t.join(F.broadcast(quota), "domain", "left").join(got, "domain", "left")
    rows = rows.select("domain", "target_share", "max_repeats", zero("quota"), zero("tokens"), zero("records"), zero("uses"), zero("most_repeats"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per domain
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
