"""Arbitration between two specialists: what can be decided from a row alone is columns, only the state is sequential.

``verdicts`` says for each bar whether a flat book may enter, with the first rule that forbids it, and ``arbitrate`` then
walks each (symbol, variant) once, carrying position, stop, hold age, tolerance and cooldown.  A group is one book over
one price history.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Thresholds of entry, holding and exit; probabilities, returns, bars and multiples of the average true range."""

    entry: float = 0.62
    floor: float = 0.45
    disagreement: float = 0.25
    hurdle: float = 0.007
    leave: float = 0.45
    least_hold: int = 2
    most_hold: int = 18
    tolerance: int = 1
    cooldown: int = 2
    stop_atr: float = 2.5
    trail_atr: float = 3.0


#: A variant changes rules, or reads the probabilities in another way ("delayed", "inverted", "shrunk").
VARIANTS: dict[str, dict] = {
    "base": {},
    "delayed": {"reading": "delayed"},
    "inverted": {"reading": "inverted"},
    "volume_ablation": {"reading": "shrunk"},
    "no_disagreement": {"disagreement": 1.0},
    "no_stops": {"stop_atr": 100.0, "trail_atr": 100.0},
    "entry_59": {"entry": 0.59},
    "hold_12": {"most_hold": 12},
    "cooldown_3": {"cooldown": 3},
}


def with_variants(rows: DataFrame, variants: dict[str, dict] | None = None) -> DataFrame:
    """rows once for each variant, with its rules as column ``rule`` and its probabilities read as it says."""
    made = []
    for name, change in (VARIANTS if variants is None else variants).items():
        rules = asdict(Rules(**{k: v for k, v in change.items() if k != "reading"}))
        made.append(F.struct(F.lit(name).alias("variant"), F.lit(change.get("reading", "plain")).alias("reading"), *[F.lit(v).alias(k) for k, v in rules.items()]))
    from pyspark.sql import Window

    before = Window.partitionBy("symbol").orderBy("candle_index")
    lagged = rows.withColumns({f"_{c}": F.lag(c).over(before) for c in ("p_trend", "p_mean")})
    each = lagged.withColumn("rule", F.explode(F.array(*made)))

    def read(name: str) -> Column:
        p, r = F.col(name), F.col("rule.reading")
        return F.when(r == "delayed", F.coalesce(F.col(f"_{name}"), F.lit(0.0))).when(r == "inverted", 1 - p).when(r == "shrunk", (p + 0.5) / 2).otherwise(p)

    return each.withColumns({"variant": F.col("rule.variant"), "p_trend": read("p_trend"), "p_mean": read("p_mean")}).drop("_p_trend", "_p_mean")


def verdicts(rows: DataFrame) -> DataFrame:
    """rows with ``own`` (the regime's specialist) and ``verdict``: what forbids entry, or 'enter'.

    Vetoes are joined by commas in the order probability, companion, disagreement, edge."""
    trending, ranging = F.col("state") == "TRENDING", F.col("state") == "RANGING"
    active, companion = F.when(trending, F.col("p_trend")).otherwise(F.col("p_mean")), F.when(trending, F.col("p_mean")).otherwise(F.col("p_trend"))
    edge = F.when(trending, F.col("e_trend")).otherwise(F.col("e_mean"))
    vetoes = F.concat_ws(
        ",",
        F.when(active < F.col("rule.entry"), "probability"),
        F.when(companion < F.col("rule.floor"), "companion"),
        F.when(F.abs(F.col("p_trend") - F.col("p_mean")) > F.col("rule.disagreement"), "disagreement"),
        F.when(edge <= F.col("rule.hurdle"), "edge"),
    )
    alone = F.when(F.col("state") == "UNSTABLE", "unstable").when(~trending & ~ranging, "indeterminate").when(ranging & ~F.col("stretch"), "no_stretch")
    stopless = F.when(F.col("close") - F.col("rule.stop_atr") * F.col("atr") <= 0, "no_stop")
    verdict = F.coalesce(alone, F.when(vetoes != "", vetoes), stopless, F.lit("enter"))
    return rows.withColumns({"own": F.when(trending, "TREND").otherwise("MEAN"), "verdict": verdict})


DECISIONS = "symbol string, variant string, candle_index bigint, action string, reason string, stop double"


def arbitrate(judged: DataFrame) -> DataFrame:
    """ENTER, HOLD, EXIT or CASH for each bar of each (symbol, variant), with its reason and the stop in force.

    The state starts anew where a bar is missing; the last bar before a gap or a new segment leaves the market and
    never enters."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("candle_index", ignore_index=True)
        step = g["candle_index"].diff().ne(1) | g["segment"].diff().ne(0)
        fresh = step.to_numpy()
        closing = step.shift(-1, fill_value=True).to_numpy()
        leave, least, most, tolerance, pause, stop_atr, trail_atr = (g[c].iloc[0] for c in ("leave", "least_hold", "most_hold", "tolerance", "cooldown", "stop_atr", "trail_atr"))
        out, held, wait, age, odd, stop, peak = [], "", 0, 0, 0, 0.0, 0.0
        for i, row in enumerate(g.itertuples(index=False)):
            if fresh[i]:
                held, wait, age, odd = "", 0, 0, 0
            if not held:
                if wait:
                    wait, said = wait - 1, "cooldown"
                else:
                    said = "boundary" if row.verdict == "enter" and closing[i] else row.verdict
                if said == "enter":
                    held, age, odd, stop, peak = row.own, 0, 0, row.close - stop_atr * row.atr, row.close
                out.append(("ENTER" if held else "CASH", said, stop if held else None))
                continue
            stop = max(stop, peak - trail_atr * row.atr)
            p = row.p_trend if held == "TREND" else row.p_mean
            gone = ""
            if row.low <= stop:
                gone = "stop"
            elif row.state == "UNSTABLE":
                gone = "unstable"
            elif age >= most:
                gone = "most_hold"
            elif row.state == "INDETERMINATE":
                odd += 1
                gone = "indeterminate" if odd > tolerance else ""
            else:
                odd = 0
                gone = "probability" if age >= least and p <= leave else ""
            if not gone and closing[i]:
                gone = "boundary"
            out.append(("EXIT" if gone else "HOLD", gone or "hold", stop))
            if gone:
                held, wait = "", int(pause)
            else:
                age, peak = age + 1, max(peak, row.close)
        found = pd.DataFrame(out, columns=["action", "reason", "stop"])
        return pd.concat([g[["symbol", "variant", "candle_index"]], found], axis=1)

    rules = ("leave", "least_hold", "most_hold", "tolerance", "cooldown", "stop_atr", "trail_atr")
    needed = judged.select("symbol", "variant", "segment", "candle_index", "state", "close", "low", "atr", "p_trend", "p_mean", "own", "verdict", *[F.col(f"rule.{r}").alias(r) for r in rules])
    return needed.groupBy("symbol", "variant").applyInPandas(walk, DECISIONS)
