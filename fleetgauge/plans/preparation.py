"""From raw readings to scaled training and test tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fleetgauge.operators.filters import (
    date_range_filter,
    hosts_blacklist,
    remove_periods,
    top_nodes,
)
from fleetgauge.operators.grid import time_grid
from fleetgauge.operators.scale import apply_scale, fit_scale
from fleetgauge.schema import CHANNELS
from fleetgauge.session import written


@dataclass(frozen=True)
class Settings:
    train: tuple[str, str]
    test: tuple[str, str]
    train_remove: list[tuple[str, str]] = field(default_factory=list)
    test_remove: list[tuple[str, str]] = field(default_factory=list)
    blacklist: list[str] = field(default_factory=list)
    nodes: int = 200
    channels: list[str] = field(default_factory=lambda: list(CHANNELS))
    seconds: int = 60
    fill: float | None = 0.0

    @staticmethod
    def periods(text: str) -> list[tuple[str, str]]:
        """`"a,b&c,d"` as a list of day pairs."""
        pairs = [part.split(",") for part in text.split("&") if part.strip()]
        return [(a.strip(), b.strip()) for a, b in pairs]

    @staticmethod
    def hosts(text: str) -> list[str]:
        return [h.strip() for h in text.split(",") if h.strip()]


def prepare_dataset(raw: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, scale). The scale is fitted on the training table and used for both.

    The readings of the chosen machines are written once; bounds, axes and values all come from there.
    """
    wanted = raw.select("node", "ts", *[c for c in dict.fromkeys([*s.channels, "power"]) if c in raw.columns])
    chosen = written(top_nodes(hosts_blacklist(wanted, s.blacklist), s.nodes), "chosen")

    def period(span: tuple[str, str], gaps: list[tuple[str, str]]) -> DataFrame:
        grid = time_grid(date_range_filter(chosen, *span), s.channels, s.seconds, s.fill)
        return remove_periods(grid, gaps)

    train, test = period(s.train, s.train_remove), period(s.test, s.test_remove)
    scale = fit_scale(train, s.channels)
    return apply_scale(train, scale, s.channels), apply_scale(test, scale, s.channels), scale
