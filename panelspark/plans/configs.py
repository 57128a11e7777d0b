"""Named book configurations and their cost sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import brake, features, ledger, select
from panelspark.session import materialize

# The configurations.
CONFIGS = {
    "base": {"kind": "threshold", "thresh": 0.30, "n": 10},
    "wide": {"kind": "risk", "thresh": 0.30, "n": 20, "min_names": 1, "stop": 0.85, "brake": 0.15},
    "v2": {"kind": "risk", "thresh": 0.30, "n": 20, "min_names": 10, "stop": 0.85, "brake": 0.15},
    "ls": {"kind": "long_short", "thresh": 0.30, "n": 10, "stop": 0.85, "borrow_apr": 0.05},
}


def config_ledger(scores: DataFrame, config: dict, costs: Sequence[float],
                  keys: Sequence[str] = select.KEYS) -> DataFrame:
    """Month rows (keys, ``cost_bps``, ``d0``, ``turnover``, ``net``) of one configuration at
    every cost. Scores are read, never refitted."""
    keys = list(keys)
    cands = materialize(select.candidates(scores, keys))
    stop = config.get("stop")
    if config["kind"] == "risk":
        vol = features.universe_vol(scores, "simple", keys)
        books = materialize(select.pick_risk(cands, vol, config["thresh"], config["n"], config["min_names"], keys=keys))
        gross = ledger.gross_returns(books, scores, keys, keys, stop=stop)
        run = brake.brake_ledger(books, gross, cands, costs, keys, config["brake"])
    elif config["kind"] == "long_short":
        books = select.pick_long_short(cands, config["thresh"], config["n"], config["n"], keys)
        base = materialize(ledger.run_book(books, cands, scores, keys, keys, borrow_apr=config["borrow_apr"], stop=stop,
                                           stop_short=stop, shorts=True))
        run = ledger.cost_sweep(base, costs, keys, config["borrow_apr"])
    else:
        books = select.pick_threshold(cands, config["thresh"], config["n"], keys)
        run = ledger.cost_sweep(materialize(ledger.run_book(books, cands, scores, keys, keys)), costs, keys)
    return run.select(*keys, "cost_bps", "d0", "turnover", "net")


def config_sweep(scores: DataFrame, configs: dict[str, dict], costs: Sequence[float],
                 keys: Sequence[str] = select.KEYS) -> DataFrame:
    """All configurations in one table, tagged by name."""
    out = None
    for name, config in configs.items():
        rows = config_ledger(scores, config, costs, keys).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
