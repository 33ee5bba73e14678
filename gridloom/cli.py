"""Co-clustering program: ``python -m gridloom.cli MATRIX -a mssr1 -R 3 -C 4 -O OUT``.

Reads a matrix (dense text, four compressed text files, or Parquet cells), runs the algorithm from several
starts, keeps the best, and writes labels, objectives and, given classes, validity measures.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import CoordMatrix
from .operators import bregman, cocluster, cocluster_moves, cocluster_signed, validity
from .sources import formats


def starts(spark: SparkSession, n: int, k: int, run: int) -> DataFrame:
    """Balanced labels dealt in an order that differs by run."""
    return spark.range(n).select("id", F.pmod(F.pmod((F.col("id") + 1) * F.lit(7919 + 2 * run), F.lit(1000003)) + F.col("id") * run, F.lit(k)).cast("int").alias("cluster")) if run else bregman.initial_labels(spark.range(n), k)


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("matrix")
    p.add_argument("-I", "--input", choices=("dense", "ccs", "parquet"), default="parquet")
    p.add_argument("-a", "--algorithm", choices=("itcc", "mssr1", "mssr2", "idiv", "euclid"), default="mssr1")
    p.add_argument("-R", "--rows", type=int, default=2)
    p.add_argument("-C", "--cols", type=int, default=2)
    p.add_argument("-b", "--basis", type=int, default=2, choices=sorted(bregman.BASES))
    p.add_argument("-n", "--runs", type=int, default=1)
    p.add_argument("-i", "--rounds", type=int, default=20)
    p.add_argument("-U", "--schedule", choices=[s.name.lower() for s in cocluster.Schedule], default="alternate")
    p.add_argument("-t", "--threshold", type=float, default=1e-3)
    p.add_argument("-l", "--local-search", type=int, default=0, help="length of chains of single moves, of rows and columns in turn (itcc, mssr1, mssr2)")
    p.add_argument("-r", "--reverse", choices=("none", "rows", "both"), default="none", help="rows, or rows and columns, may be reversed (mssr1, mssr2)")
    p.add_argument("-s", "--start", choices=("dealt", "farthest"), default="dealt", help="farthest: rows and columns far from each other (itcc)")
    p.add_argument("-T", "--chain-threshold", type=float, default=-1e-6)
    p.add_argument("-K", "--classes", help="file of row classes")
    p.add_argument("-O", "--output", required=True)
    return p


def read(spark: SparkSession, path: str, kind: str) -> CoordMatrix:
    if kind == "ccs":
        return formats.read_ccs_text(spark, path)[0]
    cells = formats.read_dense(spark, path) if kind == "dense" else spark.read.parquet(path).select("row", "col", "value")
    return CoordMatrix.of(cells, "row", "col", "value")


def run(spark: SparkSession, argv: list[str]) -> dict[str, float]:
    a = options().parse_args(argv)
    m = read(spark, a.matrix, a.input)
    best, values = None, []
    for r in range(a.runs):
        rows, cols = starts(spark, m.n_rows, a.rows, r), starts(spark, m.n_cols, a.cols, r)
        if a.algorithm in ("idiv", "euclid"):
            res = bregman.cocluster(m, a.rows, a.cols, a.basis, "i" if a.algorithm == "idiv" else "e", a.rounds, a.threshold, rows, cols)
        elif a.algorithm == "itcc":
            if a.start == "farthest":
                p = cocluster.joint(m)
                rows, cols = cocluster.farthest_start(p, a.rows), cocluster.farthest_start(p.transpose(), a.cols)
            res = cocluster.itcc(m, a.rows, a.cols, a.rounds, cocluster.Schedule[a.schedule.upper()], threshold=a.threshold, rows=rows, cols=cols)
        elif a.reverse != "none":
            if a.local_search:
                raise SystemExit("no local search of reversed rows")
            found = cocluster_signed.mssr_signed(m, a.rows, a.cols, int(a.algorithm[-1]), a.rounds, a.threshold, rows, cols, both=a.reverse == "both")
            res = cocluster.Result(found.rows, found.cols, found.objectives)
        else:
            res = cocluster.mssr(m, a.rows, a.cols, int(a.algorithm[-1]), a.rounds, cocluster.Schedule[a.schedule.upper()], a.threshold, rows, cols)
        if a.local_search and a.algorithm in ("itcc", "mssr1", "mssr2"):
            kind = "itcc" if a.algorithm == "itcc" else int(a.algorithm[-1])
            rows, cols, gains = cocluster_moves.alternating_search(cocluster.joint(m) if kind == "itcc" else m, res.rows, res.cols, a.local_search, -a.chain_threshold, kind)
            res = cocluster.Result(rows, cols, [*res.objectives, res.objectives[-1] + sum(gains)])
        values.append(res.objectives[-1])
        if best is None or values[-1] < best.objectives[-1]:
            best = res
    formats.write_coclusters(best.rows, best.cols, a.output)
    mean = sum(values) / len(values)
    out = {"best": min(values), "worst": max(values), "mean": mean, "variance": sum((v - mean) ** 2 for v in values) / len(values)}
    if a.classes:
        labels = best.rows.join(formats.read_labels(spark, a.classes).withColumnRenamed("cluster", "cls"), "id")
        cm = validity.confusion(labels)
        out |= {"purity": validity.purity(cm).first()[0], "nmi": validity.mutual_information(cm).first()["nmi_mean"], "f_measure": validity.f_measure(cm).first()[0]}
    return out


if __name__ == "__main__":
    import sys

    for name, value in run(SparkSession.builder.appName("gridloom").getOrCreate(), sys.argv[1:]).items():
        print(f"{name}\t{value}")
