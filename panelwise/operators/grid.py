"""Parameter grid of strategies: option lists, validity, configuration table, names and counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.functions.exprs import literal_rows
from panelwise.operators import signals as S

# The searched parameter values by schedule and model, and the portfolio sizes.
WEEKLY = {
    "momentum": {"lookback_days": [21, 42, 63, 126], "min_periods": [15, 30, 50]},
    "momentum_acceleration": {
        "short_lookback_days": [21, 42, 63], "long_lookback_days": [63, 126, 189], "min_periods": [30, 50]},
    "vol_adjusted_momentum": {
        "lookback_days": [42, 63, 126], "vol_floor": [0.005, 0.01, 0.02], "min_periods": [30, 50]},
    "residual_momentum": {"lookback_days": [63, 126], "min_periods": [50, 100]},
    "trend_filtered_momentum": {"momentum_lookback": [63, 126], "ma_period": [100, 150], "min_periods": [50]},
    "dual_momentum": {"lookback": [63, 126], "risk_free_rate": [0.0, 0.02], "min_periods": [50]},
    "value_momentum": {"momentum_weight": [0.3, 0.5, 0.7], "momentum_lookback": [63, 126], "min_periods": [50]},
}
MONTHLY = {
    "momentum": {"lookback_days": [63, 126, 189, 252], "min_periods": [50, 100, 150]},
    "momentum_acceleration": {
        "short_lookback_days": [21, 42, 63], "long_lookback_days": [126, 189, 252], "min_periods": [50, 100, 150]},
    "vol_adjusted_momentum": {
        "lookback_days": [63, 126, 189, 252], "vol_floor": [0.005, 0.01, 0.02], "min_periods": [50, 100, 150]},
    "residual_momentum": {"lookback_days": [126, 189, 252], "min_periods": [100, 150]},
    "trend_filtered_momentum": {"momentum_lookback": [126, 189, 252], "ma_period": [150, 200], "min_periods": [100]},
    "dual_momentum": {"lookback": [126, 189, 252], "risk_free_rate": [0.0, 0.02, 0.04], "min_periods": [100]},
    "value_momentum": {"momentum_weight": [0.3, 0.5, 0.7], "momentum_lookback": [126, 189, 252], "min_periods": [100]},
}
GRIDS = {"weekly": WEEKLY, "monthly": MONTHLY}
TOP_N = [3, 5, 7]

# Name of the parameter that holds a model's main lookback.
LOOKBACK_KEY = {
    "momentum_acceleration": "long_lookback_days", "trend_filtered_momentum": "momentum_lookback",
    "value_momentum": "momentum_lookback", "dual_momentum": "lookback",
}
PERIODS = {"weekly": 52, "monthly": 12}


@dataclass(frozen=True)
class ParamSet:
    """One model with one choice of parameters under one schedule."""

    param_id: int
    schedule: str
    alpha: str
    params: dict = field(hash=False)

    @property
    def lookback(self) -> int:
        return self.params[LOOKBACK_KEY.get(self.alpha, "lookback_days")]

    @property
    def label(self) -> str:
        return self.alpha + "_" + "_".join(f"{k}{v}" for k, v in sorted(self.params.items()))

    @property
    def warmup_days(self) -> int:
        """Calendar days before an evaluation period; models without the usual key count a year of rows."""
        key = "long_lookback_days" if self.alpha == "momentum_acceleration" else "lookback_days"
        return int(self.params.get(key, 252) * 1.5)

    def signals(self, benchmark: str) -> list[S.Signal]:
        """Score columns of this set: one, or two for the blend."""
        p, name = self.params, f"p{self.param_id}"
        n = p["min_periods"]
        if self.alpha == "momentum":
            return [S.momentum(p["lookback_days"], n, name)]
        if self.alpha == "momentum_acceleration":
            # The grid also holds sets whose history test is shorter than the short lookback.
            return [S.acceleration(p["short_lookback_days"], p["long_lookback_days"], n, name)]
        if self.alpha == "vol_adjusted_momentum":
            return [S.vol_adjusted_momentum(p["lookback_days"], n, p["vol_floor"], name)]
        if self.alpha == "residual_momentum":
            return [S.residual_momentum(p["lookback_days"], n, benchmark, name)]
        if self.alpha == "trend_filtered_momentum":
            look = p["momentum_lookback"]
            return [S.momentum(look, n, name, max(look, p["ma_period"]) + S.BUFFER_DAYS)]
        if self.alpha == "dual_momentum":
            return [S.momentum(p["lookback"], n, name)]
        if self.alpha == "value_momentum":
            look = p["momentum_lookback"]
            days = max(look, S.YEAR) + S.BUFFER_DAYS
            return [S.momentum(look, n, name, days), S.momentum(S.YEAR, n, name + "v", days)]
        raise ValueError(f"unknown model {self.alpha}")


def is_valid(alpha: str, params: dict) -> bool:
    """Short below long; history test below the main lookback."""
    if alpha == "momentum_acceleration" and params["short_lookback_days"] >= params["long_lookback_days"]:
        return False
    return params["min_periods"] < params[LOOKBACK_KEY.get(alpha, "lookback_days")]


def param_sets(schedules: list[str] | None = None, alphas: list[str] | None = None) -> list[ParamSet]:
    """Valid parameter sets in grid order; ids do not depend on the selection."""
    out, next_id = [], 0
    for schedule in GRIDS:
        for alpha, space in GRIDS[schedule].items():
            for combo in product(*space.values()):
                params = dict(zip(space, combo))
                if not is_valid(alpha, params):
                    continue
                if (schedules is None or schedule in schedules) and (alphas is None or alpha in alphas):
                    out.append(ParamSet(next_id, schedule, alpha, params))
                next_id += 1
    if not out:
        raise ValueError("no configuration left")
    return out


def param_table(spark: SparkSession, sets: list[ParamSet]) -> DataFrame:
    """The sets as rows, with the values the cross-sectional step needs."""
    rows = []
    for s in sets:
        p = s.params
        mw = p.get("momentum_weight", 0.5)
        rows.append((
            s.param_id, s.schedule, s.alpha, s.label, float(p.get("risk_free_rate", 0.0)) * s.lookback / S.YEAR,
            mw / (mw + 0.5), int(p.get("ma_period", 0)), s.warmup_days, float(PERIODS[s.schedule]),
        ))
    return literal_rows(
        spark, ["param_id", "schedule", "alpha", "label", "hurdle", "momentum_weight", "ma_period", "warmup_days", "periods_per_year"], rows
    )


def strategy_key(param_id: Column, universe_no: Column, top_n: Column) -> Column:
    """One long per configuration, cheaper to shuffle than its name; 20 bits each for universe and size."""
    return F.shiftleft(param_id.cast("long"), 40).bitwiseOR(F.shiftleft(universe_no.cast("long"), 20)).bitwiseOR(top_n.cast("long"))


def config_table(spark: SparkSession, sets: list[ParamSet], universes: list[str], top_n: list[int] = TOP_N) -> DataFrame:
    """(strategy_id, config_name, ...): every set with every size and universe."""
    u = F.array(*[F.struct(F.lit(i).alias("universe_no"), F.lit(n).alias("universe")) for i, n in enumerate(universes)])
    t = param_table(spark, sets).select("*", F.explode(F.array(*[F.lit(n) for n in top_n])).alias("top_n"))
    t = t.select("*", F.inline(u))
    name = F.concat_ws("_", "label", F.concat(F.lit("top"), F.col("top_n")), "universe", "schedule")
    return t.withColumns({"strategy_id": strategy_key(F.col("param_id"), F.col("universe_no"), F.col("top_n")), "config_name": name})


def config_counts(configs: DataFrame) -> DataFrame:
    return configs.groupBy("schedule", "alpha").agg(F.count("*").alias("n"))
