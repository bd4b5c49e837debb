"""Generators of perturbed inputs: left-out units, swaps, permutations, coalitions and injected noise.

Random choices are taken from a hash of the row's id, the draw's number and a seed, so that a lost task repeats them.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipgraph.operators.ranking import ranked_split
from flipgraph.session import cut


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2 ** 32 - 1 that depends on the parts alone."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def order_key(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in cols)))


def leave_one_unit_out(units: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, removed, rest): each unit of an array left out once."""
    each = units.select(key, column, F.posexplode(column).alias("pos", "removed"))
    return each.select(key, "pos", "removed", F.filter(column, lambda x, i: i != F.col("pos")).alias("rest"))


def swaps(units: DataFrame, key: str, column: str, most: int = 50) -> DataFrame:
    """(key, a, b, units): every swap of two units of one array; arrays above ``most`` units are an error."""
    n = F.when(F.size(column) <= most, F.size(column)).otherwise(F.raise_error(F.lit(f"more than {most} units")))
    a = units.withColumn("n", n).select(key, column, "n", F.posexplode(column).alias("a", "_")).drop("_")
    b = a.select(key, column, "a", F.explode(F.when(F.col("a") + 1 < F.col("n"), F.sequence(F.col("a") + 1, F.col("n") - 1))).alias("b"))
    swapped = F.transform(column, lambda x, i: F.when(i == F.col("a"), F.get(column, F.col("b"))).when(i == F.col("b"), F.get(column, F.col("a"))).otherwise(x))
    return b.select(key, "a", "b", swapped.alias("units"))


def object_permutations(items: DataFrame, key: str, item: str, count: int = 5, seed: int = 0) -> DataFrame:
    """items: (key, idx, item). (key, perm_id, pos, idx, item): ``count`` random orders of each key's items."""
    p = items.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(count))))
    w = Window.partitionBy(key, "perm_id").orderBy(order_key(key, "perm_id", "idx", F.lit(seed)), "idx")
    return p.withColumn("pos", F.row_number().over(w) - 1).select(key, "perm_id", "pos", "idx", item)


def third_permutations(items: DataFrame, key: str, section: str) -> DataFrame:
    """items: (key, section, idx). (key, perm_id, section, pos, idx): each section's thirds in all six orders.

    Thirds are as even as can be, the earlier ones larger. Orders that give the same sequence come out once, under
    the least name; the order that changes nothing is 0_1_2.
    """
    t = items.withColumn("third", F.ntile(3).over(Window.partitionBy(key, section).orderBy("idx")) - 1)
    orders = F.explode(F.array(*(F.struct(F.lit("_".join(map(str, p))).alias("perm_id"), F.array(*map(F.lit, p)).alias("p")) for p in permutations(range(3)))))
    each = t.withColumn("o", orders).select(key, section, "idx", F.col("o.perm_id").alias("perm_id"), (F.array_position("o.p", F.col("third")) - 1).alias("place"))
    rows = each.withColumn("pos", F.row_number().over(Window.partitionBy(key, "perm_id", section).orderBy("place", "idx")) - 1)
    look = rows.groupBy(key, "perm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(section, "pos", "idx"))), lambda x: x["idx"].cast("string")), ",").alias("look"))
    first = look.groupBy(key, "look").agg(F.min("perm_id").alias("perm_id")).select(key, "perm_id")
    return rows.join(first, [key, "perm_id"], "left_semi").select(key, "perm_id", section, "pos", "idx")


def ranked_permutations(cap: int = 6) -> list[tuple[int, tuple[int, ...], float]]:
    """(n, order, tau) of all orders of up to ``cap`` items."""
    out = []
    for n in range(1, cap + 1):
        for p in permutations(range(n)):
            pairs = [(p[i] < p[j]) - (p[i] > p[j]) for i in range(n) for j in range(i + 1, n)]
            out.append((n, p, sum(pairs) / len(pairs) if pairs else 1.0))
    return out


def tau_permutations(items: DataFrame, key: str, column: str, cap: int = 4) -> DataFrame:
    """(key, perm, tau): all orders of an array of up to ``cap`` items, for more items the swaps of two of them."""
    table = items.sparkSession.createDataFrame([(n, list(p), t) for n, p, t in ranked_permutations(cap)], "n int, perm array<int>, tau double")  # at most cap! * 2 rows
    small = items.withColumn("n", F.size(column)).where(F.col("n").between(1, cap)).join(F.broadcast(table), "n").select(key, "perm", "tau")
    large = items.withColumn("n", F.size(column)).where(F.col("n") > cap).select(key, "n", F.sequence(F.lit(0), F.col("n") - 1).alias("ids"))
    s = swaps(large.drop("n"), key, "ids").withColumnRenamed("units", "perm")
    n, gap = F.size("perm"), F.col("b") - F.col("a")
    return small.unionByName(s.select(key, "perm", (1.0 - 2.0 * (2 * gap - 1) / (n * (n - 1) / 2)).alias("tau")))


def sampled_percent(rows: DataFrame, key: str, pct: int, seed: int = 0) -> DataFrame:
    """Exactly round(n * pct / 100) rows, half to even, those with the least hash (a sampling operator).

    Ranks are exact over all rows but are computed in ranges of the hash, so no task sorts the whole table.
    """
    h = rows.withColumn("h", order_key(key, F.lit(seed)))
    prefix = h.withColumn("p", F.substring("h", 1, 3))
    sizes = prefix.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 4096 rows
    total = sizes.agg(F.bround(F.sum("c") * pct / 100.0, 0).cast("long").alias("want")).withColumn("one", F.lit(1))
    ranked = prefix.join(F.broadcast(before), "p").withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("h", key)))
    return ranked.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").where("rn <= want").select(*rows.columns)


def noise_nodes(graph_nodes: DataFrame, kg_nodes: DataFrame, key: str, share: float, seed: int = 0, tries: int = 4) -> DataFrame:
    """(key, name, anchor): max(1, round(n * share)) foreign nodes per graph, each tied to a random node of it.

    graph_nodes: (key, kg_id, name); kg_nodes: (kg_id, name). A foreign node is drawn by its number in its knowledge
    graph, so graphs are not compared with whole knowledge graphs; nodes that the graph holds or that were drawn
    before are passed over, with ``tries`` draws for each wanted one.
    """
    numbered = cut(ranked_split(kg_nodes.select("kg_id", "name").distinct(), ["kg_id"], F.asc("name"), "name", "no").withColumn("no", F.col("no") - 1), "numbered")
    size = numbered.groupBy("kg_id").agg(F.count("*").alias("kg_size"))
    g = graph_nodes.groupBy(key, "kg_id").agg(F.count("*").alias("n")).join(size, "kg_id")
    want = F.greatest(F.lit(1), F.bround(F.col("n") * share, 0).cast("int"))
    d = g.withColumn("want", want).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("want") * tries)))
    d = d.withColumn("no", (draw(key, "t", F.lit(seed)) % F.col("kg_size")).cast("int"))
    names = d.join(numbered, ["kg_id", "no"]).join(graph_nodes.select(key, "name"), [key, "name"], "left_anti")
    first = names.groupBy(key, "kg_id", "name", "n", "want").agg(F.min("t").alias("t"))
    kept = first.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("t"))).where("rn <= want")
    anchors = graph_nodes.select(key, "name").withColumn("a", F.row_number().over(Window.partitionBy(key).orderBy("name")) - 1).withColumnRenamed("name", "anchor")
    at = kept.withColumn("a", (draw(key, "name", F.lit(seed)) % F.col("n")).cast("int"))
    return at.join(anchors, [key, "a"]).select(key, "name", "anchor")


def insert_unit(rows: DataFrame, key: str, units: str, noise: str, seed: int = 0) -> DataFrame:
    """Adds ``at`` and ``noisy``: the noise unit inserted at a random place of the array."""
    at = (draw(key, F.lit(seed)) % (F.size(units) + 1)).cast("int")
    return rows.withColumn("at", at).withColumn("noisy", F.concat(F.slice(units, 1, F.col("at")), F.array(noise), F.slice(units, F.col("at") + 1, F.size(units))))


def triple_masks(triples: DataFrame, key: str, samples: int = 5, seed: int = 0) -> DataFrame:
    """triples: (key, pos). (key, sample, pos): triples kept in each sample, a random number of them left out, at least one."""
    s = triples.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("n", F.count("*").over(Window.partitionBy(key, "sample")))
    drop = 1 + draw(key, "sample", F.lit(seed)) % F.col("n")
    w = Window.partitionBy(key, "sample").orderBy(order_key(key, "sample", "pos", F.lit(seed)), "pos")
    return s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") > drop).select(key, "sample", "pos")


def strings_of_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value): all strings in a column of JSON texts, at any depth; texts that are no JSON give none."""
    import json

    import pandas as pd

    def walk(x, path):
        if isinstance(x, str):
            yield path, x
        elif isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}")
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")

    def part(frames):
        for frame in frames:
            out = []
            for k, t in zip(frame["k"], frame["t"], strict=True):
                try:
                    out.extend((k, p, v) for p, v in walk(json.loads(t), "$") if t is not None)
                except (ValueError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["k", "path", "value"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(part, f"k {kind}, path string, value string")
    return rows.withColumnRenamed("k", key)
