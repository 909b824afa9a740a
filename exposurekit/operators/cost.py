"""Spend of model calls from a usage log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wording import FALLBACK_PRICE_MODEL, TOKEN_PRICES
from .ordinal import prefix_sums

Prices = Mapping[str, tuple[float, float]]


def token_price(
    model: Column, provider: Column, prices: Prices, direction: int, credit_providers: Sequence[str], fallback: str
) -> Column:
    """US dollars per million tokens: the model's own price, 0 on credit, else the fallback model's."""
    table = F.create_map(*[x for m, pair in prices.items() for x in (F.lit(m), F.lit(float(pair[direction])))])
    unknown = F.when(provider.isin(*credit_providers), F.lit(0.0)).otherwise(F.lit(float(prices[fallback][direction])))
    return F.coalesce(F.try_element_at(table, model), unknown)


def usage_cost(
    log: DataFrame,
    prices: Prices = TOKEN_PRICES,
    credit_providers: Sequence[str] = ("credit",),
    fallback: str = FALLBACK_PRICE_MODEL,
) -> DataFrame:
    """``run, calls, tin, tout, usd``. Tokens are summed per model before prices apply."""
    per_model = log.groupBy("run", "model", "provider").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tin"), F.sum("tokens_out").alias("tout")
    )
    p_in, p_out = (
        token_price(F.col("model"), F.col("provider"), prices, d, credit_providers, fallback) for d in (0, 1)
    )
    usd = F.col("tin") / 1e6 * p_in + F.col("tout") / 1e6 * p_out
    return per_model.withColumn("usd", usd).groupBy("run").agg(
        F.sum("calls").alias("calls"), F.sum("tin").alias("tin"), F.sum("tout").alias("tout"), F.sum("usd").alias("usd")
    )


def budget_cut(
    log: DataFrame,
    cap: float,
    prices: Prices = TOKEN_PRICES,
    credit_providers: Sequence[str] = ("credit",),
    fallback: str = FALLBACK_PRICE_MODEL,
) -> DataFrame:
    """``run, call, over``: whether the run had already spent more than ``cap`` before the call.

    ``call`` numbers the calls of a run, which may use several models. Every call is
    priced first, in whole billionths of a dollar, so the running spend does not depend on
    how a long run is cut into buckets.
    """
    billionths = F.lit(0).cast("long")
    for direction, tokens in enumerate(("tokens_in", "tokens_out")):
        price = token_price(F.col("model"), F.col("provider"), prices, direction, credit_providers, fallback)
        billionths = billionths + F.coalesce(F.round(F.col(tokens) * price * 1000).cast("long"), F.lit(0))
    running = prefix_sums(log.select("run", "call", billionths.alias("spent")), "call", ["spent"], ["run"])
    return running.select("run", "call", (F.col("spent_cum") - F.col("spent") > F.lit(round(cap * 1e9))).alias("over"))
