"""Looking up per-key values for rows when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 256  # the broadcast side never has more rows than this, whatever the data size
SPREAD = 1 << 20  # salts for rows of hot (or null) keys; nothing is copied per salt, so many cost nothing


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, row_id: list[str]) -> DataFrame:
    """Left join ``rows`` with ``per_key`` (unique on ``keys``) without a hot partition.

    ``weight`` names the row count per key. The ``HOT_KEYS`` heaviest keys are answered from
    a broadcast of that many rows; every other key holds less than 1/HOT_KEYS of all rows and
    goes through the ordinary shuffle join. Rows of hot or null keys get a salt no
    ``per_key`` row has, so they spread over all partitions instead of one. ``row_id``
    must tell rows apart; the salt is a hash of it, so a re-run task repeats its output.
    """
    values = [c for c in per_key.columns if c not in keys]
    key_sql = [f"`{k}`" for k in keys]
    # Null keys match nothing. Dropping them first leaves both uses below the same aggregation,
    # so Spark computes it once and reuses the exchange.
    packed = per_key.where(" AND ".join(f"{k} IS NOT NULL" for k in key_sql)).selectExpr(
        *key_sql, f"struct({', '.join(f'`{v}`' for v in values)}) AS _v"
    )
    hot = packed.orderBy(F.desc(f"_v.{weight}"), *keys).limit(HOT_KEYS).withColumnRenamed("_v", "_hot")
    off_shuffle = " OR ".join(["_hot IS NOT NULL", *[f"{k} IS NULL" for k in key_sql]])
    salt = f"CASE WHEN {off_shuffle} THEN 1 + CAST(pmod(xxhash64({', '.join(row_id)}), {SPREAD}) AS INT) ELSE 0 END"
    tagged = rows.join(F.broadcast(hot), keys, "left").selectExpr("*", f"{salt} AS _salt")
    # Always 0, but not a constant to the optimizer: it would turn a constant into a filter on the
    # other side and take the salt out of the partitioning.
    zero = f"coalesce(CAST(pmod(xxhash64({', '.join(key_sql)}), 1) AS INT), 0)"
    cold = packed.selectExpr(*key_sql, f"{zero} AS _salt", "_v AS _cold")
    found = tagged.join(cold, [*keys, "_salt"], "left")
    return found.selectExpr(
        *[f"`{c}`" for c in rows.columns], *[f"coalesce(_hot, _cold).`{v}` AS `{v}`" for v in values]
    )
