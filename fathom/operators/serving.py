"""Access control, quotas and request batching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_allowed(email: Column, domains: tuple[str, ...]) -> Column:
    """Whether an address belongs to one of the domains; case matters."""
    hits = [F.endswith(email, F.lit("@" + d)) for d in domains]
    return F.coalesce(sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) > 0, F.lit(False)) if hits else F.lit(False)


def jwt_claims(token: Column) -> Column:
    """struct<sub, email> of a token's payload; parsing only, the signature is not checked."""
    body = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), "sub string, email string")


def _windows(seconds: float, limit: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, used, number = None, None, 0, -1
        span = pd.Timedelta(seconds=seconds)
        for batch in batches:
            starts, counts, numbers = [], [], []
            for user, ts in zip(batch["user_id"], batch["ts"], strict=True):
                if user != key:
                    key, anchor, number = user, None, -1
                if anchor is None or ts >= anchor + span:
                    anchor, used, number = ts, 0, number + 1
                used += 1
                starts.append(anchor)
                counts.append(used)
                numbers.append(number)
            yield batch.assign(anchor=starts, used=counts, number=numbers, allowed=[c <= limit for c in counts])

    return fold


def anchored_windows(events: DataFrame, seconds: float, limit: int) -> DataFrame:
    """Adds anchor, used, number and allowed: windows of fixed length that begin at a user's first event outside
    the window before; denied calls count too.

    The fold is sequential for a user. It runs over sorted partitions with the state of one user in memory, so
    a user's number of events is bounded by disk only.
    """
    ordered = events.select("user_id", "ts", "event_id").where("user_id is not null and ts is not null").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(_windows(seconds, limit), "user_id long, ts timestamp_ntz, event_id long, anchor timestamp_ntz, used long, number long, allowed boolean")


def answer_mode(allowed: Column) -> Column:
    """Within the quota a model answers, beyond it the template does."""
    return F.when(allowed, "LLM").otherwise("NoLLM")


def batch_slices(requests: DataFrame) -> DataFrame:
    """(request_id, n, texts): texts that were handled one by one, gathered again for each request in order."""
    each = requests.select("request_id", F.posexplode("texts").alias("pos", "text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return each.groupBy("request_id").agg(F.count("*").alias("n"), ordered.alias("o")).select("request_id", "n", F.col("o.text").alias("texts"))
