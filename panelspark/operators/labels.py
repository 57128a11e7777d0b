"""Forward labels and the training panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ranks import share_cut
from panelspark.functions.windows import own_rows
from panelspark.operators.features import FEATURES, add_features, with_complete
from panelspark.session import materialize

HORIZON = 20
TOP_SHARE = 0.20


def add_labels(panel: DataFrame, market: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Forward return, market forward return, excess, label end date and the
    cross-sectional top-share label.

    The market has one row per day, which bounds the broadcast. Ranks are taken over
    all rows of a date, before incomplete rows are dropped; a null excess labels 0.
    """
    # Ranking reads the rows twice, so the feature windows are not run again.
    return top_share(materialize(forward_returns(panel, market, horizon)))


def forward_returns(panel: DataFrame, market: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Forward return, label end date, market forward return and excess."""
    w = own_rows()
    mkt = market.select("Date", F.col("Close").alias("mkt"),
                        F.ln(F.lead("Close", horizon).over(own_rows()) / F.col("Close")).alias("mkt_fwd"))
    forward = panel.select(
        "*",
        F.ln(F.lead("Close", horizon).over(w) / F.col("Close")).alias("fwd_ret"),
        F.lead("Date", horizon).over(w).alias("label_end"))
    return forward.join(F.broadcast(mkt), "Date", "left").withColumn("excess", F.col("fwd_ret") - F.col("mkt_fwd"))


def top_share(rows: DataFrame) -> DataFrame:
    """``rows`` with the label. A date's cut is one value, so the rows are joined with one row per day."""
    cuts = share_cut(rows, ["Date"], "excess", 1 - TOP_SHARE, "_cut")
    return rows.join(F.broadcast(cuts), "Date", "left").withColumn(
        "label", F.when(F.col("excess") >= F.col("_cut"), 1.0).otherwise(0.0)).drop("_cut")


def build_panel(bars: DataFrame, market: str = "MKT", horizon: int = HORIZON) -> DataFrame:
    """Complete feature and label rows. ``bars`` holds the market ticker too, whose
    rows stay in the panel."""
    featured = add_features(bars).select("Date", "ticker", "Close", *FEATURES)
    labelled = add_labels(featured, bars.where(F.col("ticker") == market), horizon)
    return labelled.dropna(subset=[*FEATURES, "excess"])


def labelled_rows(bars: DataFrame, market: str = "MKT", horizon: int = HORIZON) -> DataFrame:
    """The rows and label columns of ``build_panel`` without its features, which are only asked whether they are there."""
    flagged = with_complete(bars).select("Date", "ticker", "Close", "complete")
    # The excess is a difference of two columns that are written, so it is not written itself.
    forward = materialize(forward_returns(flagged, bars.where(F.col("ticker") == market), horizon).drop("mkt", "excess"))
    labelled = top_share(forward.withColumn("excess", F.col("fwd_ret") - F.col("mkt_fwd")))
    return labelled.where("complete").drop("complete").dropna(subset=["excess"])


def build_latest(bars: DataFrame, market: str = "MKT") -> DataFrame:
    """Complete feature rows of the newest date, without the market and without
    needing an outcome."""
    rows = bars.where(F.col("ticker") != market)
    newest = rows.agg(F.max("Date").alias("Date"))
    featured = add_features(rows).select("Date", "ticker", "Close", *FEATURES)
    return featured.join(F.broadcast(newest), "Date", "left_semi").dropna(subset=FEATURES)
