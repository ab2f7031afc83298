"""Mix sources to target shares of the tokens.

Method: Sainte-Lague apportionment.  The mixture consists of blocks of equal numbers of
tokens.  Blocks go to the sources by the highest quotients share / (2 * given + 1), then each
source's quota to its shards in the same way.  A shard lays its records in seeded order on
an axis of tokens that is cut into equal blocks; whole passes take all of them, the rest of
the quota is a seeded choice of blocks.  A record belongs to the block that holds its middle.

Scale: a shard is a part of a source by hash of the record, of a bounded number of tokens,
so a source with most of the rows has most of the shards.  Tokens are counted once and
written; what follows works on (source, record, tokens).  Quotas are computed over one row
per source on the driver and one row per shard in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from millrace.plans import durable


def sainte_lague(shares: Sequence[float], seats: int, capacity: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients share / (2 * given + 1), none above its capacity; ties to the first.

    Equal to giving one seat after the other, but found by bisecting the divisor.
    """
    w = np.array([max(0.0, float(s)) for s in shares])
    cap = np.array(capacity if capacity is not None else [seats] * len(w), dtype=np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    seats = int(min(seats, cap.sum()))
    if not seats:
        return [0] * len(w)

    def given(d: float) -> np.ndarray:  # seats whose quotient is above d
        return np.minimum(np.ceil(np.minimum(w / d / 2 - 0.5, 4e18)).clip(0).astype(np.int64), cap)

    lo, hi = w[w > 0].min() / (2.0 * (seats + 1)) / 4, w.max() * 2
    while given(lo).sum() < seats:
        lo /= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if given(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    got = given(hi)
    while got.sum() < seats:  # those whose quotients tie
        q = np.where(got < cap, w / (2 * got + 1), -1)
        got[int(q.argmax())] += 1
    return got.tolist()


def mix_sources(
    records: DataFrame,
    targets: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    blocks: int = 100_000,
    shard_blocks: int = 1_000,
    total_tokens: int | None = None,
    shard_tokens: int = 20_000_000,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).  ``targets``: ``source``, ``target_share``, ``max_repeats``, one row per source.

    The mixture has ``source``, ``id``, ``tokens`` and ``copies``, how often the record is
    used.  Without ``total_tokens`` the mixture is as large as the repeats allow with every
    target met.  A block is one of ``blocks`` of the mixture or one of ``shard_blocks`` of a
    shard of ``shard_tokens``, whichever is smaller.  The report has one row per target: ``source``, ``target_share``,
    ``actual_share``, ``records``, ``tokens``, ``available_tokens``, ``most_copies``.
    Defined cases: records without source, target or tokens aren't used; a null id is an id;
    records that repeat an id are records of their own; a source without tokens is reported
    with share 0 and the others keep their proportions; if ``total_tokens`` asks more of a
    source than its repeats give, the others fill up and the report shows it; empty tables
    give an empty mixture.
    """
    spark = records.sparkSession
    plan = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).filter("source is not null").toPandas()
    sized = count_tokens(records.select(F.col(source).alias("source"), F.col(id).alias("id"), F.col(text).alias("text")).filter("source is not null"), "text", ["source", "id"], vocabulary=vocabulary)
    sized = durable(sized.filter("tokens > 0"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available")).filter(F.col("source").isin(plan["source"].tolist()))
    have = {r["source"]: r["available"] for r in have.collect()}
    plan["available"] = [int(have.get(s, 0)) for s in plan["source"]]
    live = (plan["available"] > 0) & (plan["target_share"] > 0) & (plan["max_repeats"] > 0)
    plan["share"] = np.where(live, plan["target_share"], 0.0)
    plan["share"] /= max(plan["share"].sum(), 1e-300)
    most = plan["available"] * plan["max_repeats"]
    if total_tokens is None:
        total_tokens = int((most[live] / plan["share"][live]).min()) if live.any() else 0
    block = max(1.0, min(total_tokens / max(1, blocks), shard_tokens / max(1, shard_blocks)))
    # the last block of a source may be a short one
    plan["capacity"] = np.ceil(most / block).astype("int64").where(live, 0)
    quota = sainte_lague(plan["share"].tolist(), int(round(total_tokens / block)), plan["capacity"].tolist())
    plan["quota"] = np.minimum(np.array(quota, dtype="float64") * block, most.to_numpy(dtype="float64")) if len(plan) else []
    plan["shards"] = np.ceil(plan["available"] / shard_tokens).clip(lower=1).astype("int64")
    # one row per source of the targets
    quotas = F.broadcast(spark.createDataFrame(plan[["source", "quota", "shards", "max_repeats"]], "source string, quota double, shards long, max_repeats long"))
    h = F.xxhash64(F.lit(seed), F.col("source"), F.col("id"), F.col("tokens"))
    placed = sized.join(quotas, "source").withColumn("h", h).withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    shards = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("held"), F.first("quota").alias("quota"), F.first("max_repeats").alias("max_repeats"))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        """The quota of one source, in tokens, to its shards: whole blocks, then what short blocks left over."""
        most = (pdf["held"] * pdf["max_repeats"]).to_numpy(dtype="float64")
        quota = min(float(pdf["quota"].iloc[0]), most.sum())
        given = np.array(sainte_lague(pdf["held"].tolist(), int(quota // block), np.ceil(most / block).astype("int64").tolist()), dtype="float64")
        tokens = np.minimum(given * block, most)
        room = most - tokens
        before = np.cumsum(room) - room
        tokens += np.clip(quota - tokens.sum() - before, 0.0, room)
        return pdf.assign(asked=tokens)[["source", "shard", "held", "asked"]]

    given = shards.groupBy("source").applyInPandas(apportion, "source string, shard long, held long, asked double")
    in_shard = Window.partitionBy("source", "shard").orderBy("h", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    on_axis = placed.select("source", "shard", "id", "tokens", "h").join(given, ["source", "shard"])
    middle = F.sum("tokens").over(in_shard) - F.col("tokens") / 2
    passes = F.floor(F.col("asked") / F.col("held"))
    # The rest of the quota: the blocks from a seeded one on, around the axis; the last of them may be a part of one.
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source", "shard"), F.ceil(F.col("held") / block)) * block
    chosen = F.pmod(middle - start, F.col("held").cast("double")) < F.col("asked") - passes * F.col("held")
    mixed = on_axis.withColumn("copies", passes + F.when(chosen, 1).otherwise(0)).filter("copies > 0")
    mixed = mixed.select("source", F.col("id").alias(id), "tokens", F.col("copies").cast("int").alias("copies"))
    totals = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    asked = F.broadcast(spark.createDataFrame(plan[["source", "target_share", "available"]], "source string, target_share double, available_tokens long"))
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # over one row per source of the targets
    report = asked.join(totals, "source", "left").fillna(0, subset=["records", "tokens", "most_copies"])
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0)))
    return mixed, report.select("source", "target_share", "actual_share", "records", "tokens", "available_tokens", "most_copies")
