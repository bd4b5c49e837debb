"""Aggregations over explanation, noise and score records.

Every operator takes DataFrames and returns one; ratios without a denominator are null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipgraph.functions import ids, text
from flipgraph.operators import quantiles as Q


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def avg_if(c: Column, value: Column) -> Column:
    return F.avg(F.when(c, value))


def accuracy(runs: DataFrame, score: str = "score") -> DataFrame:
    return runs.agg(F.count("*").alias("n"), rnd(F.avg(score)).alias("accuracy"))


def case_counts(cases: DataFrame) -> DataFrame:
    """cases: (id, llm_score, rag_score, case). Counts of the four cases and both accuracies."""
    counts = [count_if(F.col("case") == c).alias(f"n_{c}") for c in ("tt", "tf", "ft", "ff")]
    return cases.agg(F.count("*").alias("n"), *counts, rnd(F.avg("llm_score")).alias("llm_accuracy"), rnd(F.avg("rag_score")).alias("rag_accuracy"))


def success(records: DataFrame, *by: str) -> DataFrame:
    """A record counts as found if it says so and has operations."""
    found = F.col("found") & (F.col("num_operations") > 0)
    n, k = F.count("*"), count_if(found)
    return records.groupBy(*by).agg(n.alias("total"), k.alias("found"), (n - k).alias("not_found"), rnd(100.0 * k / n).alias("pct_found"))


def failure_reasons(records: DataFrame, max_calls: int = 200, max_cost: float = 10.0) -> DataFrame:
    """Records without a find by reason; the call budget is looked at first."""
    reason = F.when(F.col("llm_calls") >= max_calls, "llm_budget").when(F.col("cost") >= max_cost, "cost").otherwise("unknown")
    lost = records.where(~F.coalesce(F.col("found") & (F.col("num_operations") > 0), F.lit(False)))
    return lost.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def op_stats(records: DataFrame) -> DataFrame:
    some = records.where("found")
    parts = [x for c, name in (("num_operations", "ops"), ("cost", "cost")) for x in (rnd(F.avg(c)).alias(f"avg_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"))]
    return some.agg(F.count("*").alias("n"), *parts)


def op_operands(ops: DataFrame, setting: str = "both") -> DataFrame:
    """One row per edit and operand node; setting: both, all, deletions or additions."""
    kinds = {"both": F.lit(True), "all": F.lit(True), "deletions": F.col("op").startswith("delete"), "additions": F.col("op").startswith("add")}
    rows = ops.where(kinds[setting])
    return rows.withColumn("operand", F.explode(F.array_compact(F.array("node", "src", "dst")))).where("operand <> ''")


def top_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys; ties by key."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(n)


def similarity_stats(records: DataFrame, value: str = "similarity") -> DataFrame:
    """Mean, upper median, extremes and five buckets of width 0.2; values below 0 fall in the first, 1 in the last."""
    v = records.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    bucket = F.least(F.greatest(F.floor(F.col("v") / 0.2), F.lit(0)), F.lit(4))
    counts = [count_if(bucket == i).alias(f"bucket_{i}") for i in range(5)]
    whole = v.agg(F.count("*").alias("n"), rnd(F.avg("v")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), *counts)
    return Q.joined(whole, Q.quantiles(v, "v", [], {"upper_median": 0.5}, upper=True), [])


def call_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("found").agg(F.count("*").alias("n"), rnd(F.avg("llm_calls")).alias("avg_calls"), F.min("llm_calls").alias("min_calls"), F.max("llm_calls").alias("max_calls"), F.sum("llm_calls").alias("total_calls"))


def graph_sizes(records: DataFrame) -> DataFrame:
    """records: (nodes, edges) counts. Averages and extremes, and of the context size, their sum."""
    c = records.withColumn("context", F.col("nodes") + F.col("edges"))
    parts = [x for k in ("nodes", "edges", "context") for x in (rnd(F.avg(k)).alias(f"avg_{k}"), F.min(k).alias(f"min_{k}"), F.max(k).alias(f"max_{k}"))]
    return c.agg(F.count("*").alias("n"), *parts)


def op_types(ops: DataFrame) -> DataFrame:
    return ops.where("found").groupBy("op").agg(F.count("*").alias("n"))


def addition_share(ops: DataFrame, *by: str) -> DataFrame:
    """Percentage of additions among edits; 0 without edits."""
    share = F.coalesce(100.0 * count_if(F.col("op").startswith("add")) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return ops.groupBy(*by).agg(F.count("*").alias("n"), rnd(share).alias("pct_additions"))


def cells(records: DataFrame, *by: str) -> DataFrame:
    """Per cell: finds, mean and median cost and mean edits of finds, mean and median calls of all."""
    f, keys = F.col("found"), list(by)
    whole = records.groupBy(*by).agg(
        F.count("*").alias("n"), count_if(f).alias("n_found"), rnd(count_if(f) / F.count("*")).alias("success_rate"),
        rnd(avg_if(f, F.col("cost"))).alias("mean_cost"), rnd(avg_if(f, F.col("num_operations"))).alias("mean_ops"), rnd(F.avg("llm_calls")).alias("mean_calls"))
    j = Q.joined(whole, Q.quantiles(records.where("found"), "cost", keys, {"median_cost": 0.5}), keys)
    j = Q.joined(j, Q.quantiles(records, "llm_calls", keys, {"median_calls": 0.5}), keys)
    return j.withColumn("median_cost", rnd(F.col("median_cost"))).withColumn("median_calls", rnd(F.col("median_calls")))


def benchmark_averages(records: DataFrame, by: str) -> DataFrame:
    return records.groupBy(by).agg(rnd(F.avg("total_seconds")).alias("avg_seconds"), rnd(avg_if(F.col("found"), F.col("num_operations"))).alias("avg_ops"))


def time_totals(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n"), rnd(F.sum("total_seconds"), 3).alias("sum_seconds"), rnd(F.avg("total_seconds")).alias("avg_seconds"), F.sum("llm_calls").alias("sum_calls"), rnd(F.avg("llm_calls")).alias("avg_calls"))


def time_buckets(records: DataFrame) -> DataFrame:
    """records: (bucket, seconds, calls). Totals and per-row averages per bucket and, under a null bucket, overall."""
    rows = records.select("bucket", "seconds", "calls")
    parts = [F.count("*").alias("n"), rnd(F.sum("seconds"), 3).alias("sum_seconds"), rnd(F.avg("seconds")).alias("avg_seconds"), F.sum("calls").alias("sum_calls"), rnd(F.avg("calls")).alias("avg_calls")]
    return rows.groupingSets([["bucket"], []], "bucket").agg(*parts)


def set_precision(flagged: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """flagged and gold: (by, element_id). Distinct flagged elements that are gold, those that are not, and precision."""
    hits = flagged.select(*by, "element_id").distinct().join(gold.select(*by, "element_id").distinct().withColumn("is_gold", F.lit(True)), [*by, "element_id"], "left")
    tp, n = F.count("is_gold"), F.count("*")
    return hits.groupBy(*by).agg(tp.alias("tp"), (n - tp).alias("fp"), n.alias("n_flagged"), rnd(tp / n).alias("precision"))


def precision_at_k(ranked: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5), *by: str) -> DataFrame:
    """ranked: (by, element_id, score, is_gold). Positive scores alone are ranked; equal scores by element.

    The denominator is the number of items present at the cutoff, not k; a group without positive scores has
    null precision and no hit.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "element_id")
    rn = ranked.where("score > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(ks))
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    at = rn.select(*by, "rn", "is_gold", cut).where("rn <= k").groupBy(*by, "k").agg(F.count("*").alias("n"), count_if(F.col("is_gold")).alias("tp"))
    every = ranked.select(*by).distinct().select(*by, cut)
    got = every.join(at, [*by, "k"], "left").fillna(0, ["n", "tp"])
    return got.select(*by, "k", "n", "tp", rnd(F.col("tp") / F.nullif(F.col("n"), F.lit(0))).alias("precision"), (F.col("tp") > 0).cast("int").alias("hit"))


def correctness_block(metrics: DataFrame) -> DataFrame:
    """metrics: (direction, tp, n_flagged, precision). Per direction and, under null, overall, rounded to 4 digits."""
    parts = [F.count("*").alias("n"), rnd(F.avg("precision"), 4).alias("macro_precision"), rnd(F.sum("tp") / F.nullif(F.sum("n_flagged"), F.lit(0)), 4).alias("micro_precision"), rnd(F.avg((F.col("tp") > 0).cast("int")), 4).alias("hit_rate")]
    return metrics.groupingSets([["direction"], []], "direction").agg(*parts)


def flip_stability(runs: DataFrame, case: str, flipped: Column) -> DataFrame:
    """Per case: runs, runs that flipped and their share."""
    k, n = count_if(flipped), F.count("*")
    return runs.groupBy(case).agg(n.alias("n"), k.alias("flipped"), rnd(k / n).alias("stability"))


def flip_buckets(stability: DataFrame) -> DataFrame:
    """Cases whose runs all flip, some flip, none flips."""
    k, n = F.col("flipped"), F.col("n")
    return stability.agg(F.count("*").alias("cases"), count_if(k == n).alias("perfect"), count_if((k > 0) & (k < n)).alias("partial"), count_if(k == 0).alias("zero"), rnd(F.avg("stability")).alias("avg_stability"), rnd(100.0 * count_if(k == n) / F.count("*")).alias("pct_all"))


def noise_rate(runs: DataFrame, *by: str) -> DataFrame:
    """Share of runs whose explanation holds no noise node."""
    clean = count_if(F.size("noise_nodes") == 0)
    return runs.groupBy(*by).agg(F.count("*").alias("total"), clean.alias("resistant"), rnd(clean / F.count("*")).alias("rate"))


def noise_mass(scores: DataFrame, *by: str) -> DataFrame:
    """scores: (by, score, is_noise). Share of absolute, positive and signed mass on noise; 0 without mass."""
    s, z = F.col("score"), F.col("is_noise")

    def share(part: Column) -> Column:
        return rnd(F.coalesce(F.sum(F.when(z, part).otherwise(0.0)) / F.nullif(F.sum(part), F.lit(0.0)), F.lit(0.0)))

    positive = F.greatest(s, F.lit(0.0))
    return scores.groupBy(*by).agg(share(F.abs(s)).alias("abs_share"), share(positive).alias("positive_share"), rnd(F.avg(F.when(z, s))).alias("mean_noise"), rnd(F.max(F.when(z, s))).alias("max_noise"), rnd(F.avg(F.when(~z, s))).alias("mean_original"), rnd(F.max(F.when(~z, s))).alias("max_original"))


def noise_levels(runs: DataFrame) -> DataFrame:
    """Per level: runs, judged runs, the robust share of those, and mean edits overall, of robust and of fragile runs."""
    r = F.col("noise_robust")
    judged = F.count("noise_robust")
    return runs.groupBy("noise_level").agg(F.count("*").alias("n"), judged.alias("n_judged"), count_if(r).alias("n_robust"), rnd(100.0 * count_if(r) / F.nullif(judged, F.lit(0))).alias("pct_noise_robust"), rnd(F.avg("num_ops")).alias("avg_ops"), rnd(avg_if(r, F.col("num_ops"))).alias("avg_ops_robust"), rnd(avg_if(~r, F.col("num_ops"))).alias("avg_ops_fragile"))


def noise_leak(runs: DataFrame) -> DataFrame:
    """runs: (noise_level, cf, noise) with arrays of element names. Leaked elements, recall and contamination per level."""
    both = F.size(F.array_intersect("cf", "noise"))
    each = runs.select("noise_level", both.alias("leaked"), F.size(F.array_distinct("cf")).alias("n_cf"), F.size(F.array_distinct("noise")).alias("n_noise"))
    return each.groupBy("noise_level").agg(F.count("*").alias("n"), F.sum("leaked").alias("leaked"), rnd(F.avg(F.col("leaked") / F.nullif(F.col("n_noise"), F.lit(0)))).alias("recall"), rnd(F.avg(F.col("leaked") / F.nullif(F.col("n_cf"), F.lit(0)))).alias("contamination"))


def infiltration(base: DataFrame, noisy: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """base and noisy: (qid, element_id, score). Share of questions with an element in the noisy top k that is new.

    Scores are ranked by absolute value, ties by element; questions of both sides count.
    """
    w = Window.partitionBy("qid").orderBy(F.desc(F.abs("score")), "element_id")
    top = noisy.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(ks))
    new = top.join(base.select("qid", "element_id").distinct(), ["qid", "element_id"], "left_anti").groupBy("qid").agg(F.min("rn").alias("first"))
    both = noisy.select("qid").distinct().join(base.select("qid").distinct(), "qid", "left_semi").join(new, "qid", "left")
    each = both.select("qid", "first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return each.groupBy("k").agg(F.count("*").alias("n"), rnd(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("int"))).alias("infiltrated"))


def tau_levels(taus: DataFrame, by: str) -> DataFrame:
    """Mean, population deviation and number of the rank correlations per level."""
    return taus.groupBy(by).agg(rnd(F.avg("tau")).alias("mean_tau"), rnd(F.stddev_pop("tau")).alias("std_tau"), F.count("tau").alias("n"))


def auc_trapezoid(points: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Area under y over x by trapezoids; 0 with fewer than two points."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("part", part).groupBy(*by).agg(rnd(F.coalesce(F.sum("part"), F.lit(0.0))).alias("auc"), F.count("*").alias("points"))


def cost_gap(costs: DataFrame) -> DataFrame:
    """costs: (attributed, actual). Mean and median gap, mean absolute gap and mean ratio; rows with a null are counted as skipped."""
    a, b = F.col("attributed").cast("double"), F.col("actual").cast("double")
    gap = a - b
    median = Q.quantiles(costs.select(gap.alias("gap")), "gap", [], {"median_gap": 0.5}).select(rnd(F.col("median_gap")).alias("median_gap"))
    whole = costs.agg(F.count(gap).alias("n"), (F.count("*") - F.count(gap)).alias("skipped"), rnd(F.avg(gap)).alias("mean_gap"), rnd(F.avg(F.abs(gap))).alias("mean_abs_gap"), rnd(F.avg(a / F.nullif(b, F.lit(0.0)))).alias("mean_ratio"))
    return Q.joined(whole, median, [])


def centrality_compare(measures: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """measures: (qid, side, value) with sides a and b. Mean and largest value of each and who wins per question."""
    a, b = F.col("side") == "a", F.col("side") == "b"
    v = F.col("value")
    each = measures.groupBy("qid").agg(avg_if(a, v).alias("mean_a"), avg_if(b, v).alias("mean_b"), F.max(F.when(a, v)).alias("max_a"), F.max(F.when(b, v)).alias("max_b")).where("mean_a IS NOT NULL AND mean_b IS NOT NULL")
    d = F.col("mean_a") - F.col("mean_b")
    return each.agg(F.count("*").alias("n"), rnd(F.avg("mean_a")).alias("mean_a"), rnd(F.avg("mean_b")).alias("mean_b"), rnd(F.avg("max_a")).alias("max_a"), rnd(F.avg("max_b")).alias("max_b"), count_if(d > tolerance).alias("a_wins"), count_if(d < -tolerance).alias("b_wins"), count_if(F.abs(d) <= tolerance).alias("ties"))


def degenerate(scores: DataFrame, *by: str) -> DataFrame:
    """Whether all entity scores are equal and all relation scores are equal."""
    k = ids.kind(F.col("element_id"))
    e = F.count_distinct(F.when(k == "entity", F.col("score")))
    r = F.count_distinct(F.when(k == "relation", F.col("score")))
    return scores.groupBy(*by).agg(e.alias("entity_values"), r.alias("relation_values"), ((e <= 1) & (r <= 1)).alias("degenerate"))


def permutation_spread(scores: DataFrame, *by: str) -> DataFrame:
    """Mean, population deviation and extremes of each element's scores over the permutations."""
    s = F.col("score")
    return scores.groupBy(*by, "element_id").agg(F.count("*").alias("n"), rnd(F.avg(s)).alias("mean"), rnd(F.stddev_pop(s)).alias("std"), rnd(F.min(s)).alias("min"), rnd(F.max(s)).alias("max"), rnd(F.max(s) - F.min(s)).alias("range"))


def modal_rankings(rankings: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """rankings: (qid, ranking array). Per question and k: rankings, distinct top-k sets and the size of the largest
    group of equal sets; k 0 stands for whole rankings in order."""
    parts = [rankings.select("qid", F.lit(k).alias("k"), F.array_join(F.array_sort(F.slice("ranking", 1, k)), "\x1f").alias("key")) for k in ks]
    parts.append(rankings.select("qid", F.lit(0).alias("k"), F.array_join("ranking", "\x1f").alias("key")))
    groups = reduce(DataFrame.unionByName, parts).groupBy("qid", "k", "key").agg(F.count("*").alias("c"))
    return groups.groupBy("qid", "k").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.max("c").alias("modal"))


def enrichment_ratio(modified: DataFrame, graph: DataFrame) -> DataFrame:
    """Both: (type), a row per node. Share among modified over share in the graph; +inf where the graph has none."""
    a = modified.groupBy("type").agg(F.count("*").alias("n_modified"))
    b = graph.groupBy("type").agg(F.count("*").alias("n_graph"))
    na, nb = modified.agg(F.count("*").alias("all_modified")), graph.agg(F.count("*").alias("all_graph"))
    j = a.join(b, "type", "full").fillna(0, ["n_modified", "n_graph"])
    totals = F.broadcast(na.withColumn("one", F.lit(1)).join(nb.withColumn("one", F.lit(1)), "one"))  # a single row
    j = j.withColumn("one", F.lit(1)).join(totals, "one")
    pa, pb = 100.0 * F.col("n_modified") / F.col("all_modified"), 100.0 * F.col("n_graph") / F.col("all_graph")
    ratio = F.when(F.col("n_graph") == 0, F.lit(float("inf"))).otherwise(rnd(pa / F.nullif(pb, F.lit(0.0))))
    return j.select("type", "n_modified", "n_graph", rnd(pa).alias("pct_modified"), rnd(pb).alias("pct_graph"), ratio.alias("ratio"))


def type_lift(nodes: DataFrame, floor: float = 1e-9) -> DataFrame:
    """nodes: (type, modified). log2 of the type's share among modified nodes over that among the others."""
    m = F.col("modified")
    each = nodes.groupBy("type").agg(count_if(m).alias("n_mod"), count_if(~m).alias("n_bg"))
    totals = F.broadcast(nodes.agg(count_if(m).alias("all_mod"), count_if(~m).alias("all_bg")).withColumn("one", F.lit(1)))  # a single row
    j = each.withColumn("one", F.lit(1)).join(totals, "one")
    lift = F.log2(F.greatest(F.col("n_mod") / F.greatest("all_mod", F.lit(1)), F.lit(floor)) / F.greatest(F.col("n_bg") / F.greatest("all_bg", F.lit(1)), F.lit(floor)))
    return j.select("type", "n_mod", "n_bg", rnd(lift, 5).alias("lift"))


def auc_and_ks(values: DataFrame, *by: str) -> DataFrame:
    """values: (by, x, positive). Area under the ROC curve, ties one half, and the largest gap of the two distributions."""
    per = values.where("x IS NOT NULL").groupBy(*by, "x").agg(count_if(F.col("positive")).alias("p"), count_if(~F.col("positive")).alias("q"))
    w = Window.partitionBy(*by).orderBy("x")
    whole = Window.partitionBy(*by)
    run = per.withColumn("cp", F.sum("p").over(w)).withColumn("cq", F.sum("q").over(w)).withColumn("tp", F.sum("p").over(whole)).withColumn("tq", F.sum("q").over(whole))
    u = F.sum(F.col("p") * (F.col("cq") - F.col("q") + F.col("q") / 2.0))
    return run.where("tp > 0 AND tq > 0").groupBy(*by).agg(F.max("tp").alias("n_pos"), F.max("tq").alias("n_neg"), rnd(u / (F.max("tp") * F.max("tq"))).alias("auc"), rnd(F.max(F.abs(F.col("cp") / F.col("tp") - F.col("cq") / F.col("tq")))).alias("ks"))


def op_composition(ops: DataFrame, by: str) -> DataFrame:
    """Share of each kind of edit, one column per kind, and their number."""
    kinds = ("delete_node", "delete_edge", "add_node", "add_edge")
    n = F.count("*")
    return ops.groupBy(by).agg(n.alias("n"), *(rnd(count_if(F.col("op") == k) / n).alias(k) for k in kinds))


def zipf(elements: DataFrame, n: int = 50) -> DataFrame:
    """elements: (exp_id, element_id). Rank and frequency of elements, counted once per record; the first ``n`` ranks."""
    counts = elements.distinct().groupBy("element_id").agg(F.count("*").alias("freq"))
    top = counts.orderBy(F.desc("freq"), "element_id").limit(n)
    w = Window.orderBy(F.desc("freq"), "element_id")  # over n rows
    return top.withColumn("rank", F.row_number().over(w))


def describe(values: DataFrame, x: str, *by: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles."""
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    whole = values.groupBy(*by).agg(F.count(x).alias("n"), rnd(F.avg(x)).alias("mean"), rnd(F.stddev_samp(x)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    j = Q.joined(whole, Q.quantiles(values, x, list(by), names), list(by))
    return reduce(lambda df, q: df.withColumn(q, rnd(F.col(q))), names, j)


def by_size_bins(records: DataFrame, size: str, value: str, bins: int = 10) -> DataFrame:
    """Mean value per equal-width bin of size, the upper edge one above the largest size."""
    edges = F.broadcast(records.agg(F.min(size).alias("lo"), (F.max(size) + 1).alias("hi")).withColumn("one", F.lit(1)))  # a single row
    r = records.withColumn("one", F.lit(1)).join(edges, "one")
    bin_ = F.floor((F.col(size) - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))).cast("int") + 1
    return r.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), rnd(F.avg(value)).alias("mean"))


def log_histogram(values: DataFrame, x: str, bins: int = 7) -> DataFrame:
    """Percentage of positive values per bin between log-spaced edges; the last bin is closed above."""
    edges = F.broadcast(values.where(F.col(x) > 0).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("all")).withColumn("one", F.lit(1)))  # a single row
    r = values.where(F.col(x) > 0).withColumn("one", F.lit(1)).join(edges, "one")
    step = F.ln(F.col("hi") / F.col("lo")) / F.lit(bins)
    at = F.when(step > 0, F.floor(F.ln(F.col(x) / F.col("lo")) / step + 1e-9)).otherwise(0)
    return r.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), rnd(100.0 * F.count("*") / F.max("all")).alias("pct"))


def jaccard_of_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap of two key sets and the size of each difference; 0 if both are empty."""
    j = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    both = count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return j.agg(both.alias("both"), count_if(F.col("b").isNull()).alias("only_a"), count_if(F.col("a").isNull()).alias("only_b"), rnd(F.coalesce(both / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))).alias("jaccard"))


def regression(points: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return points.agg(F.regr_count(a, b).alias("n"), rnd(F.regr_slope(a, b)).alias("slope"), rnd(F.regr_intercept(a, b)).alias("intercept"))


def relevant_elements(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """elements: (exp_id, element_id); facts: (exp_id, unit_pos, unit). Adds ``relevant``.

    An entity must be named within one unit; the ends of a relation may be named in different units.
    """
    e = elements.select("exp_id", "element_id").distinct()
    e = e.withColumn("h", ids.head(F.col("element_id"))).withColumn("t", ids.tail(F.col("element_id")))
    j = e.join(facts.select("exp_id", "unit"), "exp_id", "left")
    has_h = F.coalesce(F.max(text.norm_contains(F.col("unit"), F.col("h"))), F.lit(False))
    has_t = F.coalesce(F.max(text.norm_contains(F.col("unit"), F.col("t"))), F.lit(False))
    return j.groupBy("exp_id", "element_id").agg((has_h & (has_t | F.max(F.col("t").isNull()))).alias("relevant"))


def fact_coverage(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """Per record: elements, relevant ones, units, and units in which an element is named, a relation by both ends."""
    rel = relevant_elements(elements, facts).groupBy("exp_id").agg(F.count("*").alias("n_elements"), count_if(F.col("relevant")).alias("n_gold_elements"))
    e = elements.select("exp_id", "element_id").distinct().select("exp_id", ids.head(F.col("element_id")).alias("h"), ids.tail(F.col("element_id")).alias("t"))
    u, h, t = F.col("unit"), F.col("h"), F.col("t")
    named = text.norm_contains(u, h) & (t.isNull() | text.norm_contains(u, t))
    units = facts.join(e, "exp_id", "left").groupBy("exp_id", "unit_pos").agg(F.max(F.coalesce(named, F.lit(False))).alias("covered"))
    cov = units.groupBy("exp_id").agg(F.count("*").alias("n_facts_total"), count_if(F.col("covered")).alias("n_facts_covered"))
    return rel.join(cov, "exp_id", "left").fillna(0, ["n_facts_total", "n_facts_covered"])
