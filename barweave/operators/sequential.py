"""Operators that are sequential by nature: one group is one book or series, held by one task as a bounded frame.

A group is a symbol's bars (or one experiment's book), whose size is the length of a price history and does not grow
with the number of symbols or experiments; Spark spreads the groups.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

import pandas as pd
from pyspark.sql import DataFrame

SCHEDULE = "symbol string, candle_index bigint, action string"


def zscore_schedule(bars: DataFrame, window: int = 24, entry: float = -1.5, stop_atr: float = 2.5, trail_atr: float = 3.0) -> DataFrame:
    """Mean reversion: enter when the z-score of the last ``window`` closes is at or below entry; leave when the low
    touches the stop that the bar before left, or the z-score is back at 0.  The stop starts at close - stop_atr * ATR
    and on each bar held trails the highest close by trail_atr * ATR."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = group.sort_values("candle_index", ignore_index=True)
        prev = b["close"].shift(1)
        tr = pd.concat([b["high"] - b["low"], (b["high"] - prev).abs(), (b["low"] - prev).abs()], axis=1).max(axis=1)
        z = (b["close"] - b["close"].rolling(window).mean()) / b["close"].rolling(window).std(ddof=0).where(lambda s: s > 0)
        atr = tr.rolling(window).mean()
        actions, long, stop, peak = [], False, 0.0, 0.0
        for i in range(len(b)):
            close = b["close"][i]
            if long:
                if b["low"][i] <= stop or z[i] >= 0:
                    actions.append("EXIT")
                    long = False
                else:
                    actions.append("HOLD")
                    peak = max(peak, close)
                    stop = max(stop, peak - trail_atr * atr[i])
            elif pd.notna(z[i]) and z[i] <= entry and close - stop_atr * atr[i] > 0:
                actions.append("ENTER")
                long, stop, peak = True, close - stop_atr * atr[i], close
            else:
                actions.append("CASH")
        return pd.DataFrame({"symbol": b["symbol"], "candle_index": b["candle_index"], "action": actions})

    return bars.select("symbol", "candle_index", "high", "low", "close").groupBy("symbol").applyInPandas(run, SCHEDULE)


FILLS = "symbol string, candle_index bigint, side string, quantity decimal(38,18), price decimal(38,18), fee decimal(38,18), cash decimal(38,18), position decimal(38,18), reason string"


def simulate(bars: DataFrame, schedule: DataFrame, cash: str = "10000", fee: str = "0.001", half_spread_bps: str = "5", slippage_bps: str = "10", tick: str = "0.01", step: str = "0.0001", participation: str = "0.25", min_notional: str = "1") -> DataFrame:
    """Long-or-cash orders from a schedule, filled at the next bar's open in exact decimals.

    A buy pays the open raised by half spread and slippage, rounded up to the tick, a sell gets it lowered and rounded
    down; a price outside the bar's range is no fill.  The quantity is bounded by cash after fees, by the bar's volume
    times participation and rounded down to the step; a fill under min_notional is refused.
    """
    d = {k: Decimal(v) for k, v in (("cash", cash), ("fee", fee), ("cost", half_spread_bps), ("slip", slippage_bps), ("tick", tick), ("step", step), ("part", participation), ("least", min_notional))}

    def book(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("candle_index", ignore_index=True)
        money, held, rows = d["cash"], Decimal(0), []
        move = (d["cost"] + d["slip"]) / 10000
        for i in range(1, len(g)):
            action = g["action"][i - 1]
            if not ((action == "ENTER" and held == 0) or (action == "EXIT" and held > 0)):
                continue
            buy = action == "ENTER"
            opened = Decimal(repr(float(g["open"][i])))
            price = opened * (1 + move if buy else 1 - move)
            price = (price / d["tick"]).to_integral_value(ROUND_CEILING if buy else ROUND_FLOOR) * d["tick"]
            room = Decimal(repr(float(g["volume"][i]))) * d["part"]
            want = min(room, money / (price * (1 + d["fee"])) if buy and price > 0 else held)
            quantity = (want / d["step"]).to_integral_value(ROUND_FLOOR) * d["step"]
            inside = Decimal(repr(float(g["low"][i]))) <= price <= Decimal(repr(float(g["high"][i])))
            reason = "fill_price_outside_candle" if not inside else "below_min_notional" if quantity * price < d["least"] else "filled"
            if reason != "filled":
                quantity = Decimal(0)
            paid = quantity * price * d["fee"]
            money += -quantity * price - paid if buy else quantity * price - paid
            held += quantity if buy else -quantity
            rows.append((g["symbol"][i], int(g["candle_index"][i]), "BUY" if buy else "SELL", quantity, price, paid, money, held, reason))
        places = Decimal(1).scaleb(-18)
        fixed = [[x.quantize(places) if isinstance(x, Decimal) else x for x in r] for r in rows]
        return pd.DataFrame(fixed, columns=["symbol", "candle_index", "side", "quantity", "price", "fee", "cash", "position", "reason"])

    joined = bars.join(schedule, ["symbol", "candle_index"]).select("symbol", "candle_index", "open", "high", "low", "close", "volume", "action")
    return joined.groupBy("symbol").applyInPandas(book, FILLS)
