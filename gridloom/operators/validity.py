"""External validity of a clustering against classes, from their confusion counts."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(labels: DataFrame, cls: str = "cls", cluster: str = "cluster") -> DataFrame:
    """(cls, cluster, n) of the pairs that occur."""
    return labels.groupBy(F.col(cls).alias("cls"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def _margins(cm: DataFrame) -> DataFrame:
    by_class, by_cluster = Window.partitionBy("cls"), Window.partitionBy("cluster")
    out = cm.withColumn("n_cls", F.sum("n").over(by_class)).withColumn("n_cluster", F.sum("n").over(by_cluster))
    return out.crossJoin(cm.agg(F.sum("n").alias("total")))  # one row


def purity(cm: DataFrame) -> DataFrame:
    """Share of items in their cluster's largest class."""
    best = cm.groupBy("cluster").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return best.agg((F.sum("m") / F.sum("s")).alias("purity"))


def entropy(cm: DataFrame) -> DataFrame:
    """Class entropy in the clusters (bits), weighted by size."""
    m = _margins(cm)
    return m.agg(F.sum(-F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("n_cluster"))).alias("entropy"))


def mutual_information(cm: DataFrame) -> DataFrame:
    """MI in bits, both entropies, and MI normalised by their mean and by their geometric mean (0 if either is 0)."""
    m = _margins(cm)
    p = F.col("n") / F.col("total")
    mi = m.agg(F.sum(p * F.log2(F.col("n") * F.col("total") / (F.col("n_cls") * F.col("n_cluster")))).alias("mi"))
    h = lambda name, out: cm.groupBy(name).agg(F.sum("n").alias("k")).withColumn("p", F.col("k") / F.lit(1.0)).crossJoin(cm.agg(F.sum("n").alias("total"))).agg(F.sum(-F.col("k") / F.col("total") * F.log2(F.col("k") / F.col("total"))).alias(out))
    j = mi.crossJoin(h("cls", "hx")).crossJoin(h("cluster", "hy"))  # one row each
    both = (F.col("hx") > 0) & (F.col("hy") > 0)
    return j.select("mi", "hx", "hy", F.when(both, F.col("mi") / ((F.col("hx") + F.col("hy")) / 2)).otherwise(0.0).alias("nmi_mean"), F.when(both, F.col("mi") / F.sqrt(F.col("hx") * F.col("hy"))).otherwise(0.0).alias("nmi_sqrt"))


def f_measure(cm: DataFrame) -> DataFrame:
    """Best F of each class over the clusters, weighted by class size."""
    m = _margins(cm)
    p, r = F.col("n") / F.col("n_cluster"), F.col("n") / F.col("n_cls")
    best = m.groupBy("cls").agg(F.max(2 * p * r / (p + r)).alias("f"), F.max("n_cls").alias("n_cls"))
    return best.agg((F.sum(F.col("f") * F.col("n_cls")) / F.sum("n_cls")).alias("f_measure"))


def micro_precision_recall(cm: DataFrame) -> DataFrame:
    """Each cluster stands for its largest class (smallest name of several): precision and recall over all items."""
    m = _margins(cm)
    major = cm.groupBy("cluster").agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("major"))
    j = m.join(major, "cluster")
    hit = F.sum(F.when(F.col("cls") == F.col("major"), F.col("n")).otherwise(0))
    return j.agg((hit / F.sum("n")).alias("precision"), (hit / F.max("total")).alias("recall"))


def accuracy(cm: DataFrame, most: int = 8) -> float:
    """Share of items on the diagonal under the best matching of clusters to classes (at most ``most`` of each)."""
    rows = cm.collect() if cm.count() <= most * most else None
    if rows is None:
        raise ValueError("too many classes for a full search")
    classes, clusters = sorted({r["cls"] for r in rows}), sorted({r["cluster"] for r in rows})
    n = {(r["cls"], r["cluster"]): r["n"] for r in rows}
    short, long = (classes, clusters) if len(classes) <= len(clusters) else (clusters, classes)
    at = (lambda s, x: n.get((s, x), 0)) if short is classes else (lambda s, x: n.get((x, s), 0))
    return max((sum(at(s, x) for s, x in zip(short, p, strict=False)) for p in permutations(long, len(short))), default=0) / max(1, sum(n.values()))
