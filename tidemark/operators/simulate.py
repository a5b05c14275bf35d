"""One-unit position simulation from signals: decide at a session's close, hold from the next session on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

DAILY = "s long, position int, daily_pnl double, equity double, reason string"


def simulate_path(level: list, signal: list, hold: int | None = 6, reverse: bool = False, neutral: bool = False) -> list[tuple]:
    """(position, daily pnl, equity, reason) by session.

    A trade opened at close t earns from t to t+1 on. It ends ``hold`` sessions after its entry decision, or earlier on an
    opposite signal (``reverse``) or none (``neutral``). The session's profit counts before the exit; a new trade may
    open at the close that ends the old one. The last session decides nothing, exits included. A held session without a price raises.
    """
    out, held, age, equity = [], 0, 0, 0.0
    for t, now in enumerate(level):
        pnl, reason, position = 0.0, "", held
        if held:
            if now is None or level[t - 1] is None:
                raise ValueError(f"no price while a position is held, session {t}")
            pnl = held * (now - level[t - 1])
            age += 1
            if t + 1 == len(level):
                reason = ""  # an exit at the last close is a plan for the next session
            elif hold and age >= hold:
                reason = "max_hold"
            elif reverse and signal[t] == -held:
                reason = "reverse"
            elif neutral and not signal[t]:
                reason = "neutral"
        equity += pnl
        if t + 1 < len(level) and (reason or not held):
            held, age = int(signal[t]), 0
        out.append((position, pnl, equity, reason))
    return out


def simulate(df: DataFrame, keys: list[str], hold: int | None = 6, reverse: bool = False, neutral: bool = False) -> DataFrame:
    """Paths of ``df`` (keys, s, level, signal), one strategy to a group: its own sessions are all that a task holds."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("s")
        level = [None if pd.isna(v) else float(v) for v in group["level"]]
        path = simulate_path(level, [0 if pd.isna(v) else int(v) for v in group["signal"]], hold, reverse, neutral)
        out = pd.DataFrame(path, columns=["position", "daily_pnl", "equity", "reason"])
        for k in (*keys, "s"):
            out[k] = group[k].to_numpy()
        return out

    types = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {types[k]}" for k in keys] + [DAILY]))
