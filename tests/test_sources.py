import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from panelspark.operators import provenance
from panelspark.sources import bars as bar_sources
from panelspark.sources import external, factors, filings, fundamentals, tables, universe
from tests.helpers import bars, day, days


def test_read_bars_csv_folder(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "aaa.csv").write_text("date,open,HIGH,low,close,volume\n2020-01-01,1,2,0.5,1.5,10\n2020-01-01,1,2,0.5,1.6,10\n2020-01-02,1,2,0.5,1.7,10\n")
    (folder / "BBB.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,9,10\n")
    rows = {(r.ticker, str(r.Date)): r.Close for r in bar_sources.read_bars(spark, str(folder)).collect()}
    assert rows == {("AAA", "2020-01-01"): 1.5, ("AAA", "2020-01-02"): 1.7, ("BBB", "2020-01-02"): 9.0}


def test_quote_payload(spark):
    payload = {"chart": {"result": [{"timestamp": [86400, 172800, 259200], "indicators": {
        "quote": [{"open": [10, 10, None], "high": [12, 12, 4], "low": [8, 8, 4], "close": [10, None, 4], "volume": [5, 5, None]}],
        "adjclose": [{"adjclose": [5, 5, None]}]}}]}}
    rows = bar_sources.bars_from_payload(spark.createDataFrame([("xyz", json.dumps(payload))], "ticker STRING, payload STRING")).collect()
    assert [(r.ticker, str(r.Date), r.Open, r.High, r.Close, r.Volume) for r in rows] == [
        ("XYZ", "1970-01-02", 5.0, 6.0, 5.0, 5.0), ("XYZ", "1970-01-04", None, 4.0, 4.0, 0.0)]


def test_payload_without_adjustment(spark):
    payload = {"chart": {"result": [{"timestamp": [86400], "indicators": {"quote": [
        {"open": [1], "high": [1], "low": [1], "close": [1], "volume": [1]}]}}]}}
    row = bar_sources.bars_from_payload(spark.createDataFrame([("a", json.dumps(payload))], "ticker STRING, payload STRING")).first()
    assert (row.Close, row.Volume) == (1.0, 1.0)


def test_vintage_guard(spark):
    px = bars(spark, [("A", day("2020-01-31"), 1.0), ("B", day("2020-01-05"), 1.0)])
    with pytest.raises(ValueError, match="mixed vintages: 26 days"):
        bar_sources.assert_vintage(px)
    bar_sources.assert_vintage(px, 30)


def test_slice_dates(spark):
    px = bars(spark, [("A", d, 1.0) for d in days(5)])
    assert bar_sources.slice_dates(px, "2020-01-02", "2020-01-03").count() == 2
    with pytest.raises(ValueError):
        bar_sources.slice_dates(px, "2021-01-01", None, require_rows=True)


PAGE = """<html><table class="x"><tr><td>no</td></tr></table><table width="100%" class="tinytable">
<tr><th>X</th></tr>
<tr>{short}</tr>
<tr>{a}</tr><tr class="r">{b}</tr></table></html>"""


def cells(*values):
    return "".join(f"<td>{v}</td>" for v in values)


def test_filings_from_pages(spark):
    a = cells("M", '<a href="/x">2020-01-03 18:00:00</a>', "2020-01-01", '<b><a href="/ABC" title="t">ABC</a></b>', "Smith &amp; Co",
              "CEO", "P - Purchase", "$10.50", "+1,000", "5", "6", "+$10,500", "y")
    b = cells("M", "2020-02-03", "2020-02-01", "X.Y lower", "Jo", "Dir", "S - Sale", "$1", "-5", "5", "6", "-$5", "y", "z")
    page = PAGE.format(short=cells("1", "2"), a=a, b=b)
    df = spark.createDataFrame([(1, page), (2, "<html>none</html>")], "page_id INT, html STRING")
    raw = filings.filings_from_pages(df)
    got = sorted((r.ticker, r.filing_dt, r.insider, r.ttype, r.value) for r in raw.collect())
    assert got == [("ABC", "2020-01-03", "Smith & Co", "P - Purchase", "+$10,500"), ("X.Y", "2020-02-03", "Jo", "S - Sale", "-$5")]
    clean = {r.ticker: (r.side, r.qty, r.price, r.sval) for r in filings.clean_filings(raw).collect()}
    assert clean == {"ABC": ("P", 1000.0, 10.5, 10500.0), "X.Y": ("S", 5.0, 1.0, -5.0)}


def test_clean_filings_drops_and_dedupes(spark):
    row = ("2020-01-03", "2020-01-01", "A", "i", "CEO", "P - Purchase", "$1", "10", "$60,000")
    rows = [row, row, ("bad",) + row[1:], row[:5] + ("A - Grant",) + row[6:]]
    raw = spark.createDataFrame(rows, "filing_dt STRING, trade_dt STRING, ticker STRING, insider STRING, title STRING, ttype STRING, price STRING, qty STRING, value STRING")
    assert filings.clean_filings(raw).count() == 1


def test_conviction_gate_and_buckets(spark):
    def buy(d, who="i", v=60_000.0, title="CEO", side="P"):
        return ("A", who, day(d), title, side, v if side == "P" else -v)
    rows = [buy("2020-01-10"), buy("2020-01-10", v=70_000.0), buy("2020-06-01"), buy("2021-08-01"), buy("2020-02-01", "j", title="Dir"),
            buy("2020-03-01", "k", v=50_000.0), buy("2020-04-01", "k", side="S")]
    df = spark.createDataFrame(rows, "ticker STRING, insider STRING, filing_dt DATE, title STRING, side STRING, sval DOUBLE")
    got = sorted((r.insider, str(r.filing_dt), r.sval) for r in filings.conviction_buys(df).collect())
    assert got == [("i", "2020-01-10", 60_000.0), ("i", "2021-08-01", 60_000.0)]
    m = {str(r.avail): (r.ins_conv_3m, r.ins_convval_3m) for r in filings.monthly_conviction(df).collect()}
    assert m["2020-02-03"] == (1.0, 60_000.0)
    assert m["2020-04-03"] == (pytest.approx(1 / 3), pytest.approx(20_000.0))
    assert m["2020-05-03"] == (0.0, 0.0)


def test_factor_text(spark):
    lines = ["This file", ",Mkt-RF,SMB", "202001,  1.50, -0.20", "202002, -99.99, 0.1", "", " Annual", "2020, 3.0, 4.0"]
    df = factors.factors_from_text(spark.createDataFrame([(x,) for x in lines], "value STRING"), ["mkt_rf", "smb"])
    rows = [(str(r.month), round(r.mkt_rf, 9), round(r.smb, 9)) for r in df.orderBy("month").collect()]
    assert rows == [("2020-01-31", 0.015, -0.002), ("2020-02-29", -0.9999, 0.001)]
    mom = df.select("month", F.col("mkt_rf").alias("mom"))
    joined = {str(r.month): r.mom for r in factors.factor_table(df, mom).collect()}
    assert joined == {"2020-01-31": 0.015, "2020-02-29": None}


def test_last_close_per_new_york_day(spark):
    # 2023-01-03 14:30 UTC, 21:00 UTC, and 2023-01-04 21:00 UTC
    values = [[1672756200, 1, 1, 1, 101], [1672779600, 1, 1, 1, 102], [1672866000, 1, 1, 1, 103], [1672866000, 1, 1, 1, 104]]
    payload = {"charts": {"Strategy Equity": {"series": {"Equity": {"values": values}}}}}
    docs = spark.createDataFrame([("d", json.dumps(payload))], "source STRING, payload STRING")
    got = {str(r.Date): r.equity for r in external.daily_equity(docs).collect()}
    assert got == {"2023-01-03": 102.0, "2023-01-04": 104.0}


def test_symbol_map_and_log(spark):
    payload = {"orders": {"1": {"symbol": {"value": "RHP", "id": "GET XYZ"}}, "2": {"symbol": {"value": "UCB", "id": "UCBI ABC"}},
                          "3": {"symbol": {"value": "AAMI", "id": "OMAM QQ"}}}}
    docs = spark.createDataFrame([("d", json.dumps(payload))], "source STRING, payload STRING")
    lines = spark.createDataFrame([("d", "2020-01-02 10:30:00 picks: BSIG,GET,UCBI,NEW"), ("d", "2020-01-02 noise")], "source STRING, value STRING")
    picks = external.current_symbols(external.picks_from_log(lines), external.symbol_map(docs))
    row = external.pick_sets(picks).first()
    assert (row.ext_picks, row.ext_n, str(row.month)) == (["AAMI", "NEW", "RHP", "UCB"], 4, "2020-01-01")


def test_tables(spark, tmp_path):
    path = str(tmp_path / "grades")
    assert tables.read_table(spark, path, tables.GRADE_SCHEMA).count() == 0
    row = spark.createDataFrame([("r", day("2020-01-01"), "A", "m", 0.1)], "run_id STRING, decision_date DATE, ticker STRING, model STRING, ret DOUBLE")
    for _ in range(2):
        tables.append_table(row, path, tables.GRADE_SCHEMA)
    back = tables.read_table(spark, path, tables.GRADE_SCHEMA)
    assert back.count() == 2 and back.first().series is None
    for kind in ("csv", "json"):
        tables.export(row, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[0] == "run_id"


def test_snapshot_is_written_once(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = [("r1", day("2020-01-01"), "m", t, 0.5, 10.0, 0.85) for t in "AB"]
    df = spark.createDataFrame(rows, "run_id STRING, decision_date DATE, model STRING, ticker STRING, signal_value DOUBLE, signal_close DOUBLE, stop_frac DOUBLE")
    tables.write_snapshot(df, path)
    with pytest.raises(ValueError):
        tables.write_snapshot(df, path)
    assert {r.run_id for r in tables.read_snapshots(spark, path).collect()} == {"r1"}


def test_upsert_distinct(spark, tmp_path):
    path = str(tmp_path / "buckets")
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "v INT")
    tables.upsert_distinct(frame([1, 2, 2]), path)
    tables.upsert_distinct(frame([2, 3]), path)
    assert sorted(r.v for r in tables.latest_version(spark, path).collect()) == [1, 2, 3]


def test_fundamentals_file(spark, tmp_path):
    good = tmp_path / "f.csv"
    good.write_text("bvps,ticker,filed_date,period_end,qeps,eps_ttm\n5,A,2020-02-15,2019-12-31,1.5,bad\n")
    row = fundamentals.read_fundamentals(spark, str(good)).first()
    assert (row.ticker, row.bvps, row.qeps, row.eps_ttm) == ("A", 5.0, 1.5, None)
    short = tmp_path / "s.csv"
    short.write_text("ticker,filed_date\nA,2020-01-01\n")
    with pytest.raises(ValueError, match="missing"):
        fundamentals.read_fundamentals(spark, str(short))


def test_statement_merge(spark):
    schema = "symbol STRING, date STRING, filingDate STRING, epsDiluted STRING, weightedAverageShsOutDil STRING"
    income = spark.createDataFrame([("a", "2020-12-31", "2021-02-01", "2.5", "10"), ("a", "2019-12-31", "2020-02-01", "x", "10"),
                                    ("b", "2020-12-31", "2021-02-01", "1", "0")], schema)
    balance = spark.createDataFrame([("a", "2020-12-31", "100", "0"), ("b", "2020-12-31", "100", None)],
                                    "symbol STRING, date STRING, totalStockholdersEquity STRING, weightedAverageShsOutDil STRING")
    rows = fundamentals.fundamentals_from_statements(income, balance).collect()
    assert [(r.ticker, r.eps_ttm, r.bvps) for r in rows] == [("A", 2.5, 10.0)]


def test_universe(spark):
    members = universe.universe(spark, "smallcap", exclude=["LEG"])
    assert members.count() == len(universe.SMALLCAP) - 1 and len(universe.SMALLCAP) == len(universe.MIDCAP) == 100
    px = bars(spark, [("AAMI", days(1)[0], 1.0), ("LEG", days(1)[0], 1.0), ("ZZZ", days(1)[0], 1.0)])
    assert [r.ticker for r in universe.in_universe(px, members).collect()] == ["AAMI"]
    assert universe.keep_universe(px, universe.SMALLCAP).count() == 2 and universe.drop_names(px, ["ZZZ"]).count() == 2


def test_bundle_digest_follows_folds_only(spark, tmp_path):
    def digest():
        files = provenance.fingerprint(spark, str(tmp_path / "c"))
        return provenance.bundle_digest(files, r"^fold\d+").first()
    folder = tmp_path / "c"
    folder.mkdir()
    for name in ("fold2.csv", "fold10.csv", "notes.txt"):
        (folder / name).write_text(name)
    first = digest()
    (folder / "notes.txt").write_text("other")
    assert digest() == first and first.files == 2
    (folder / "fold2.csv").write_text("changed")
    assert digest().digest != first.digest


def test_hash_tree_is_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(40)}.{i}", f"{rng.randrange(16 ** 8):08x}") for i in range(130)]
    plain = [f"{n} {h}" for n, h in sorted(rows, key=lambda r: (int(re.search(r"\d+", r[0])[0]), *r))]
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    while True:
        plain = [sha(plain[k:k + 5]) for k in range(0, len(plain), 5)]
        if len(plain) == 1:
            break
    df = spark.createDataFrame(rows, "name STRING, sha256 STRING")
    for parts in (1, 7):
        assert tuple(provenance.bundle_digest(df.repartition(parts), fan=5).first()) == (130, plain[0])
    assert tuple(provenance.bundle_digest(df.limit(0)).first()) == (0, sha([]))


def test_record_hash_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "a", None)], "x INT, y STRING, z DOUBLE")
    a, b = df.select(provenance.record_hash(["x", "y", "z"]).alias("a"), provenance.record_hash(["z", "y", "x"]).alias("b")).first()
    assert a == b and len(a) == 64


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path STRING, sha256 STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path STRING, sha256 STRING")
    assert {r.path: r.status for r in provenance.diff_manifest(old, new).collect()} == {"b": "changed", "c": "missing", "d": "new"}


def test_bars_by_supplier_and_by_nation(spark):
    lines = spark.createDataFrame([(1, 10, 2.0, "2020-01-02"), (1, 11, 1.0, "2020-01-02"), (2, 11, 3.0, "2020-01-03")],
                                  "l_partkey INT, l_suppkey INT, l_quantity DOUBLE, l_shipdate STRING")
    supplier = spark.createDataFrame([(10, 3), (11, 3)], "s_suppkey INT, s_nationkey INT")
    part = spark.createDataFrame([(1, 5.0), (2, 7.0)], "p_partkey INT, p_retailprice DOUBLE")
    volumes = lambda names: {(r.ticker, str(r.Date), r.Volume) for r in bar_sources.bars_from_lines(
        lines, supplier, part, names=names).collect()}
    assert volumes("nation") == {("T03", "2020-01-02", 3.0), ("T03", "2020-01-03", 3.0)}
    assert volumes("supplier") == {("S10", "2020-01-02", 2.0), ("S11", "2020-01-02", 1.0), ("S11", "2020-01-03", 3.0)}
