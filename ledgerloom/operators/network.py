"""Risk that spreads along payments, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import stage


def spread_risk(edges: DataFrame, labels: DataFrame, hops: int = 3, decay: float = 0.5, least: float = 0.0,
                source: str = "from_address", target: str = "to_address") -> DataFrame:
    """(address, risk, hops) of every address that a labelled one is reached from within ``hops`` payments.

    An address that pays one of risk r has at least the risk r * ``decay``; its risk is the
    greatest over all ways, and ``hops`` the length of the shortest of those. Risks at or below
    ``least`` spread no further. ``edges`` may repeat and hold nulls; ``labels(address,
    risk_score)`` may repeat too, the highest score counts.

    Edges are made distinct once. A round sends only the addresses whose risk grew in the last
    one, so rounds shrink and stop by themselves; what arrives at an address is reduced to its
    maximum map-side, so a hub that many pay, or that pays many, moves one row per task. Rounds are written to
    the shared folder: a plan of many rounds is never rerun, and a lost executor costs tasks only.
    """
    pairs = stage(edges.select(F.col(source).alias("payer"), F.col(target).alias("paid")).where(
        "payer IS NOT NULL AND paid IS NOT NULL AND payer <> paid").distinct(), "payments")
    risk = stage(labels.where("address IS NOT NULL AND risk_score IS NOT NULL").groupBy("address").agg(
        F.max("risk_score").alias("risk")).withColumn("hops", F.lit(0)), "risk-0")
    grown = risk
    for hop in range(1, hops + 1):
        sending = grown.where(F.col("risk") * decay > least).select(F.col("address").alias("paid"), (F.col("risk") * decay).alias("risk"))
        if sending.isEmpty():
            break
        # One row per address on the sending side: a hub's payments can be split by the skew join.
        arrived = pairs.join(sending, "paid").groupBy(F.col("payer").alias("address")).agg(F.max("risk").alias("risk"))
        grown = stage(arrived.join(risk.select("address", F.col("risk").alias("_known")), "address", "left").where(
            F.col("_known").isNull() | (F.col("risk") > F.col("_known"))).select("address", "risk", F.lit(hop).alias("hops")), f"grown-{hop}")
        best = F.max_by(F.struct("risk", "hops"), F.struct("risk", -F.col("hops"))).alias("best")
        risk = stage(risk.unionByName(grown).groupBy("address").agg(best).select("address", "best.risk", "best.hops"), f"risk-{hop}")
    return risk
