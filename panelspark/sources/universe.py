"""Universe dimension: named ticker lists and exclusions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Assets of the trend sleeve.
TREND_ASSETS = ["SPY", "IWM", "TLT", "GLD"]

# Members of the SP100 universe.
SP100 = [
    "AAPL", "MSFT", "NVDA", "AMZN", "META", "GOOGL", "AVGO", "COST", "JPM", "V", "MA", "XOM", "UNH", "LLY", "JNJ",
    "WMT", "BAC", "PG", "ORCL", "HD", "CVX", "MRK", "ABBV", "KO", "CSCO", "CRM", "ACN", "AMD", "LIN", "TXN", "DHR",
    "DIS", "VZ", "PFE", "T", "INTC", "CMCSA", "NEE", "UPS", "QCOM", "HON", "AMGN", "LOW", "SBUX", "IBM", "GE", "SPGI",
    "INTU", "MDT", "CAT", "GS", "DE", "BLK", "AXP", "PLD", "GILD", "BK", "ADP", "TJX", "VRTX", "REGN", "MU", "PANW",
    "LRCX", "KLAC", "ADI", "MCHP", "CSX", "FDX", "EMR", "ETN", "PH", "ROST", "ODFL", "CTAS", "PAYX", "MNST", "KDP",
    "KHC", "MDLZ", "PM", "MO", "CL", "ECL", "SHW", "APD", "NEM", "DUK", "SO", "AEP", "XEL", "WEC", "ES", "AWK", "CNP",
    "NI", "AMT", "CCI", "EQIX", "WY", "VICI", "ARE", "DLR", "O",
]

# Members of the SMALLCAP universe.
SMALLCAP = [
    "AAMI", "ACA", "AGX", "AMTM", "ARR", "AWR", "BFAM", "BMI", "BTU", "CC", "CON", "CRI", "CWEN", "DAN", "DFIN",
    "DXC", "EMN", "EPC", "FBP", "FMC", "GFF", "GPOR", "HAYW", "HMN", "IIPR", "JOE", "KMT", "KSS", "LEG", "LTH", "MAN",
    "MHK", "MTX", "NGVT", "NPO", "OGN", "PBI", "PMT", "RCUS", "RHP", "SAFE", "SHO", "SM", "SXT", "TGTX", "UA", "UVV",
    "VSXY", "WHD", "WU", "ACAD", "ADAM", "AGYS", "ALRM", "AOSL", "AZTA", "BL", "CARG", "CENTA", "CLSK", "COLL", "CSW",
    "DAVE", "EBC", "EYE", "FHB", "FRPT", "GSHD", "HLIT", "HUBG", "INDV", "IRDM", "KLIC", "LKFN", "LYFT", "MBGL",
    "MIR", "MSEX", "NBHC", "NSSC", "OPLN", "PAYO", "PENN", "PLUS", "PRDO", "PSMT", "QDEL", "REYN", "RUSHA", "SDGR",
    "SHEN", "SPNT", "STRA", "TMDX", "UCB", "UPBD", "VCTR", "VSAT", "WDFC", "WSC",
]

# Members of the MIDCAP universe.
MIDCAP = [
    "AA", "AFG", "ALK", "AM", "APG", "ASB", "AVNT", "AYI", "BCO", "BJ", "BURL", "CAVA", "CDP", "CLF", "CNM", "CR",
    "CTRE", "CXT", "DKS", "DT", "EHC", "ENS", "ESNT", "FBIN", "FLG", "FNB", "FR", "GATX", "GME", "GXO", "HL", "HRB",
    "IRT", "KBH", "KNF", "LAD", "MLI", "MP", "MTG", "MUSA", "NLY", "NVT", "OGE", "ONTO", "OVV", "PB", "PII", "POR",
    "PSN", "RBC", "RLI", "RRX", "SAIC", "SF", "SNX", "SSD", "SUI", "THG", "TOL", "TTC", "ULS", "VFC", "VNT", "WCC",
    "WLK", "WTRG", "AAL", "AMH", "AVAV", "BSY", "CART", "CGNX", "COKE", "CRUS", "DOCU", "ENTG", "EXPO", "GBCI",
    "HIMS", "HWC", "ILMN", "KRYS", "LFUS", "LSCC", "MEDP", "MTSI", "NTNX", "OLED", "OZK", "PPC", "RMBS", "SANM",
    "SHC", "SLAB", "SOLS", "TCBI", "TXRH", "UTHR", "VNOM", "WTFC",
]

NAMED = {"TREND": TREND_ASSETS, "SP100": SP100, "SMALLCAP": SMALLCAP, "MIDCAP": MIDCAP}


def universe(spark: SparkSession, name: str, exclude: Iterable[str] = ()) -> DataFrame:
    """A named list as a one-column table."""
    gone = {t.upper() for t in exclude}
    return spark.createDataFrame([(t,) for t in NAMED[name.upper()] if t not in gone], "ticker STRING")


def keep_universe(df: DataFrame, names: Iterable[str], exclude: Iterable[str] = ()) -> DataFrame:
    """Rows of the named tickers. A list this short is a pushed-down filter, not a join."""
    wanted = sorted({t.upper() for t in names} - {t.upper() for t in exclude})
    return df.where(F.col("ticker").isin(wanted))


def drop_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.where(~F.col("ticker").isin(sorted({t.upper() for t in names})))


def in_universe(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose ticker is a member; the member table's size decides the join."""
    return df.join(members.select("ticker").distinct(), "ticker", "left_semi")
