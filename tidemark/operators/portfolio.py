"""Position sizes, trading costs and exits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates of the cost model, as parts of the turnover; the depository's charge is per sale.
SLIPPAGE, STT, TXN, SEBI, STAMP, GST, DEPOSITORY = 0.005, 0.001, 0.0000325, 0.000001, 0.00015, 0.18, 15.93


def kelly_pct(p: Column, win: Column, loss: Column, cap: float = 5.0) -> Column:
    """Half of the Kelly fraction in per cent, between 0 and cap; 0 for inputs that aren't positive."""
    full = (p - (1 - p) / (win / loss)) * 100
    return F.when((p > 0) & (win > 0) & (loss > 0) & (full > 0), F.least(full * 0.5, F.lit(cap))).otherwise(0.0)


def costs(price: Column, quantity: Column, is_buy: Column) -> dict[str, Column]:
    """executed, turnover and each charge of a trade, rounded to 2, and their total."""
    executed = price * F.when(is_buy, 1 + SLIPPAGE).otherwise(1 - SLIPPAGE)
    turnover = executed * quantity
    stt, txn, sebi = F.round(turnover * STT, 2), F.round(turnover * TXN, 2), F.round(turnover * SEBI, 2)
    stamp = F.when(is_buy, F.round(turnover * STAMP, 2)).otherwise(0.0)
    gst = F.round((txn + sebi) * GST, 2)
    held = F.when(is_buy, 0.0).otherwise(DEPOSITORY)
    return {"executed": executed, "turnover": turnover, "stt": stt, "txn": txn, "sebi": sebi, "stamp": stamp, "gst": gst, "dp": held, "total": F.round(stt + txn + sebi + stamp + gst + held, 2)}


def exit_reason(price: Column, stop: Column, bought: Column, as_of: Column, days: int = 90) -> Column:
    return F.when(price < stop, "stop").when(F.datediff(as_of, bought) >= days, "held")


def paper_trades(orders: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """account, seq, quantity, spent, cash: each account's buys in order, each sized by the cash that earlier ones left.

    orders: account, seq, price, conviction. A share of the cash by conviction (8: 25 %, 6: 15 %, 4: 5 %) is spent, 1000 at
    least, and 99 % of it on whole shares. What an order may spend hangs on all before it, so a partition has whole accounts,
    sorted, and is gone through once, a batch at a time: only the last account and its cash are kept.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, cash
        for batch in batches:
            rows = []
            for account, price, conviction in zip(batch.account, batch.price, batch.conviction, strict=True):
                if account != last and not (account != account and last != last):  # a missing account is one, too
                    last, left = account, cash
                share = 0.25 if conviction >= 8 else 0.15 if conviction >= 6 else 0.05 if conviction >= 4 else 0.0
                target = left * share
                quantity = int(0.99 * target / (price * (1 + SLIPPAGE))) if target >= 1000 and price > 0 else 0
                spent = quantity * price * (1 + SLIPPAGE)
                left -= spent
                rows.append((quantity, spent, left))
            out = pd.DataFrame(rows, columns=["quantity", "spent", "cash"])
            out.insert(0, "seq", batch.seq.to_numpy())
            out.insert(0, "account", batch.account.to_numpy())
            yield out

    asked = orders.select("account", "seq", F.col("price").cast("double").alias("price"), F.col("conviction").cast("double").alias("conviction"))
    kinds = dict(asked.dtypes)
    lined = asked.repartition("account").sortWithinPartitions("account", "seq", "price", "conviction")
    done = lined.mapInPandas(fold, f"account {kinds['account']}, seq {kinds['seq']}, quantity long, spent double, cash double")
    return done.select("account", "seq", "quantity", F.round("spent", 2).alias("spent"), F.round("cash", 2).alias("cash"))


def close_positions(positions: DataFrame) -> DataFrame:
    """The history rows of positions(scrip_code, bought, buy_price, quantity, invested) sold at price on day, as a trade log has them.

    The profit is what the sale brings after its costs, less what was invested; the history states no stamp duty, as that
    was paid on buying. A position without a positive price isn't sold.
    """
    c = costs(F.col("price"), F.col("quantity"), F.lit(False))
    sold = positions.filter("price > 0")
    pnl = c["turnover"] - c["total"] - F.col("invested")
    return sold.select("scrip_code", "bought", F.col("day").alias("sold"), "buy_price", c["executed"].alias("sell_price"), "quantity", c["stt"].alias("stt"), F.lit(0.0).alias("stamp"), c["txn"].alias("txn"), F.lit(DEPOSITORY).alias("dp"), pnl.alias("pnl"))
