"""SQL for the registered queries, assembled from shared CTEs.

``CTES`` lists building blocks in dependency order; ``query`` prepends the ones a
statement names.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
SQL: dict[str, str] = {}


def _needs(text: str, seen: dict[str, str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            _needs(CTES[name], seen)
            seen[name] = CTES[name]


def query(sql: str, recursive: str = "") -> str:
    """``recursive`` holds extra CTE definitions that may refer to themselves."""
    seen: dict[str, str] = {}
    _needs(sql + " " + recursive, seen)
    parts = [f"{n} AS ({body})" for n, body in seen.items()]
    if recursive:
        parts.append(recursive)
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
    return head + sql


NATION = "concat('T', lpad(cast(s_nationkey AS VARCHAR), 2, '0'))"


def bars_cte(period: str, market: bool) -> str:
    day = "cast(l_shipdate AS DATE)" if period == "day" else f"cast(date_trunc('{period}', l_shipdate) AS DATE)"
    ticker = "'MKT'" if market else NATION
    join = "" if market else "JOIN supplier ON l_suppkey = s_suppkey"
    return f"""SELECT {ticker} AS ticker, {day} AS "Date",
  cast(sum(cast(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS "Open",
  max(p_retailprice) AS "High", min(p_retailprice) AS "Low",
  cast(sum(cast(p_retailprice AS DECIMAL(18,2)) * cast(l_quantity AS DECIMAL(9,2))) AS DOUBLE)
    / cast(sum(cast(l_quantity AS DECIMAL(9,2))) AS DOUBLE) AS "Close",
  cast(sum(cast(l_quantity AS DECIMAL(9,2))) AS DOUBLE) AS "Volume"
FROM lineitem {join} JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


CTES["bars"] = bars_cte("day", False)
CTES["mkt"] = bars_cte("day", True)
CTES["allbars"] = "SELECT * FROM bars UNION ALL SELECT * FROM mkt"
CTES["wbars"] = bars_cte("week", False)
CTES["wmkt"] = bars_cte("week", True)
CTES["allwbars"] = "SELECT * FROM wbars UNION ALL SELECT * FROM wmkt"

# sessions, decisions and momentum on weekly bars
CTES["wcal"] = """SELECT "Date", row_number() OVER (ORDER BY "Date") AS ord, count(*) OVER () AS last_ord
  FROM (SELECT DISTINCT "Date" FROM wbars)"""
CTES["wpx"] = """SELECT b.ticker, b."Date", b."Close" AS p, c.ord FROM wbars b JOIN wcal c ON b."Date" = c."Date" """
CTES["wdec"] = """SELECT d0, month, ord, m FROM (
  SELECT max("Date") AS d0, cast(date_trunc('month', "Date") AS DATE) AS month, max(ord) AS ord,
         row_number() OVER (ORDER BY cast(date_trunc('month', "Date") AS DATE)) AS m
  FROM wcal GROUP BY cast(date_trunc('month', "Date") AS DATE))"""
CTES["wmom"] = """SELECT d.d0, d.m, r.ticker, r.p / b.p - 1 AS mom FROM wdec d
  JOIN wpx r ON r.ord = d.ord - 3 JOIN wpx b ON b.ord = d.ord - 51 AND b.ticker = r.ticker
  WHERE d.m > 13 AND d.ord >= 57"""
CTES["wcut"] = """SELECT d0, count(*) AS total, quantile_cont(mom, 0.9) AS cut FROM wmom GROUP BY d0 HAVING count(*) >= 5"""
CTES["wpicks"] = """SELECT d0, ticker, mom, 1.0::DOUBLE / count(*) OVER (PARTITION BY d0) AS weight FROM (
  SELECT x.d0, x.ticker, x.mom, c.total, row_number() OVER (PARTITION BY x.d0 ORDER BY x.ticker) AS place
  FROM wmom x JOIN wcut c ON x.d0 = c.d0 WHERE x.mom >= c.cut)
  WHERE place <= greatest(5, floor(total * 0.1::DOUBLE) + 1)"""


def ledger_ctes(prefix: str, books: str, decisions: str, px: str, cal: str, keys: tuple[str, ...] = (),
                grid: tuple[str, ...] = (), horizon: int = 20, stop: float | None = None,
                cost: float = 5.0, missing: str = "cash", shorts: bool = False, borrow: float = 0.0) -> None:
    """Register <prefix>_num, _turn, _legs, _gross and _led. ``px`` has ticker, ord, p
    and the grid keys; ``cal`` has "Date", ord, last_ord and the grid keys."""
    k = "".join(f"{c}, " for c in keys)
    on = lambda a, b, cols: " AND ".join([f"{a}.{c} = {b}.{c}" for c in cols]) or "1=1"
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    CTES[f"{prefix}_num"] = f"""SELECT {k}d0, row_number() OVER ({part}ORDER BY d0) AS m
      FROM (SELECT DISTINCT {k}d0 FROM {decisions})"""
    ak = "".join(f"a.{c}, " for c in keys)
    ck = "".join(f"coalesce(a.{c}, b.{c}) AS {c}, " for c in keys)
    CTES[f"{prefix}_bk"] = f"""SELECT a.*, n.m FROM {books} a JOIN {prefix}_num n ON {on('a', 'n', keys)} AND a.d0 = n.d0"""
    CTES[f"{prefix}_turn"] = f"""SELECT {k}m, 0.5::DOUBLE * sum(abs(w)) AS turnover FROM (
      SELECT {ck}coalesce(a.m, b.m) AS m, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS w
      FROM (SELECT {k}m, ticker, weight FROM {prefix}_bk) a
      FULL JOIN (SELECT {k}m + 1 AS m, ticker, weight FROM {prefix}_bk) b
        ON {on('a', 'b', keys)} AND a.m = b.m AND a.ticker = b.ticker) GROUP BY ALL"""
    gk = "".join(f"e.{c}, " for c in grid)
    if stop is None:
        hit = "NULL"
    else:
        hit = (f"min_by(f.p, f.ord) FILTER (WHERE CASE WHEN e.side < 0 THEN f.p / e.p0 >= 1 / {stop}::DOUBLE "
               f"ELSE f.p / e.p0 <= {stop}::DOUBLE END)")
    CTES[f"{prefix}_legs"] = f"""SELECT * FROM (
      SELECT {gk}e.ticker, e.d0, e.side, CASE WHEN any_value(e.x) = any_value(e.o) THEN 0.0::DOUBLE
        WHEN e.side < 0 THEN any_value(e.p0) / coalesce({hit}, max(f.p) FILTER (WHERE f.ord = e.x)) - 1
        ELSE coalesce({hit}, max(f.p) FILTER (WHERE f.ord = e.x)) / any_value(e.p0) - 1 END AS ret
      FROM (SELECT DISTINCT {''.join(f'a.{c}, ' for c in grid)}a.ticker, a.d0, CASE WHEN a.weight < 0 THEN -1 ELSE 1 END AS side,
              p.p AS p0, c.ord AS o, least(c.ord + {horizon}, c.last_ord) AS x
            FROM {books} a JOIN {cal} c ON {on('a', 'c', grid)} AND c."Date" = a.d0
            JOIN {px} p ON {on('a', 'p', grid)} AND p.ticker = a.ticker AND p.ord = c.ord) e
      LEFT JOIN {px} f ON {on('e', 'f', grid)} AND f.ticker = e.ticker AND f.ord > e.o AND f.ord <= e.x
      GROUP BY {gk}e.ticker, e.d0, e.side) WHERE ret IS NOT NULL"""
    value = "avg(l.ret)" if missing == "survivors" else "sum(abs(a.weight) * l.ret)"
    CTES[f"{prefix}_gross"] = f"""SELECT {ak}a.d0, coalesce({value}, 0) AS gross, count(*) AS n,
        sum(CASE WHEN a.weight < 0 THEN -a.weight ELSE 0 END) AS short_weight
      FROM {books} a LEFT JOIN {prefix}_legs l ON {on('a', 'l', grid)} AND a.ticker = l.ticker AND a.d0 = l.d0
        AND l.side = CASE WHEN a.weight < 0 THEN -1 ELSE 1 END
      GROUP BY {ak}a.d0"""
    nk = "".join(f"n.{c}, " for c in keys)
    CTES[f"{prefix}_led"] = f"""SELECT {k}d0, m, n, gross, turnover, cost, gross - cost AS net FROM (
      SELECT {nk}n.d0, n.m, coalesce(g.n, 0) AS n, coalesce(g.gross, 0) AS gross, coalesce(t.turnover, 0) AS turnover,
        coalesce(t.turnover, 0) * {cost}::DOUBLE / 10000 + coalesce(g.short_weight, 0) * {borrow}::DOUBLE / 12 AS cost
      FROM {prefix}_num n LEFT JOIN {prefix}_turn t ON {on('n', 't', keys)} AND n.m = t.m
      LEFT JOIN {prefix}_gross g ON {on('n', 'g', keys)} AND n.d0 = g.d0)"""
    CTES[f"{prefix}_eq"] = f"""SELECT *, equity / peak - 1 AS drawdown FROM (
      SELECT *, greatest(1.0::DOUBLE, max(equity) OVER ({part}ORDER BY d0)) AS peak FROM (
        SELECT *, product(1 + net) OVER ({part}ORDER BY d0) AS equity FROM {prefix}_led))"""


def summary_sql(source: str, keys: tuple[str, ...] = (), extra: str = "") -> str:
    """Summary over an _eq CTE."""
    k = "".join(f"{c}, " for c in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}count(*) AS months, round(product(1 + net), 6) AS equity_end,
      round(avg(net) / (stddev_samp(net) + 1e-12) * sqrt(12), 6) AS sharpe, round(min(least(drawdown, 0)), 6) AS max_dd,
      {extra} round(CASE WHEN product(1 + net) > 0 THEN pow(product(1 + net), 12.0::DOUBLE / count(*)) - 1 END, 6) AS cagr
    FROM {source} {group}"""


FULL = "round(avg(turnover), 6) AS avg_turnover, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS exposure,"

ledger_ctes("mo", "wpicks", "wpicks", "wpx", "wcal", horizon=4, cost=25.0, missing="survivors")

SQL["bars_daily"] = query("""SELECT ticker, "Date", round("Open", 9) AS "Open", round("High", 9) AS "High",
  round("Low", 9) AS "Low", round("Close", 9) AS "Close", round("Volume", 9) AS "Volume" FROM bars""")
SQL["formation_momentum"] = query("SELECT d0, ticker, round(mom, 6) AS mom FROM wmom")
SQL["pick_momentum"] = query("SELECT d0, ticker, round(mom, 6) AS mom, round(weight, 6) AS weight FROM wpicks")
SQL["momentum_ledger"] = query("""SELECT d0, m, n, round(gross, 8) AS gross, round(turnover, 8) AS turnover,
  round(cost, 8) AS cost, round(net, 8) AS net, round(equity, 8) AS equity, round(drawdown, 8) AS drawdown FROM mo_eq""")
CTES["mo_half"] = """SELECT l.*, CASE WHEN m <= floor((SELECT count(*) FROM mo_led) / 2.0)
    THEN 'tune' ELSE 'hold' END AS half FROM mo_led l"""


def rebased(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""(SELECT *, equity / greatest(1.0::DOUBLE, max(equity) OVER ({part}ORDER BY d0)) - 1 AS drawdown
    FROM (SELECT *, product(1 + net) OVER ({part}ORDER BY d0) AS equity FROM {source}))"""


SQL["momentum_summary"] = query(summary_sql(rebased("mo_half", "half"), ("half",), FULL))


# ---- features, labels, folds, scores ------------------------------------------------
FEATURES = ["ret_1", "ret_5", "ret_20", "mom_20", "vol_20", "range", "range_20", "vol_chg", "rsi_14", "ma10_gap", "ma50_gap"]


def roll(fn: str, col: str, n: int, need: int | None = None, part: str = "ticker", order: str = '"Date"') -> str:
    head = f"PARTITION BY {part} " if part else ""
    w = f"OVER ({head}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} >= {n if need is None else need} THEN {fn}({col}) {w} END"


def feature_ctes(name: str, source: str) -> None:
    CTES[f"{name}_base"] = f"""SELECT *, ln("Close") - ln(lag("Close", 1) OVER w) AS ret_1, ln("Close") - ln(lag("Close", 5) OVER w) AS ret_5,
      ln("Close") - ln(lag("Close", 20) OVER w) AS ret_20, "Close" / lag("Close", 20) OVER w - 1 AS mom_20,
      ("High" - "Low") / lag("Close", 1) OVER w AS range,
      CASE WHEN lag("Close", 1) OVER w IS NOT NULL THEN greatest("Close" - lag("Close", 1) OVER w, 0) END AS up,
      CASE WHEN lag("Close", 1) OVER w IS NOT NULL THEN greatest(lag("Close", 1) OVER w - "Close", 0) END AS down
      FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY "Date")"""
    CTES[name] = f"""SELECT ticker, "Date", "Close", ret_1, ret_5, ret_20, mom_20, {roll('stddev_samp', 'ret_1', 20)} AS vol_20,
      range, {roll('avg', 'range', 20)} AS range_20, "Volume" / ({roll('avg', '"Volume"', 20)}) - 1 AS vol_chg,
      100 - 100 / (1 + ({roll('avg', 'up', 14)}) / nullif({roll('avg', 'down', 14)}, 0)) AS rsi_14,
      "Close" / ({roll('avg', '"Close"', 10)}) - 1 AS ma10_gap, "Close" / ({roll('avg', '"Close"', 50)}) - 1 AS ma50_gap
      FROM {name}_base"""


feature_ctes("feat", "allbars")
CTES["mktf"] = """SELECT "Date", "Close" AS mkt, ln(lead("Close", 20) OVER (ORDER BY "Date") / "Close") AS mkt_fwd FROM mkt"""
CTES["lab0"] = """SELECT f.*, m.mkt, m.mkt_fwd, f.fwd_ret - m.mkt_fwd AS excess FROM (
    SELECT *, ln(lead("Close", 20) OVER (PARTITION BY ticker ORDER BY "Date") / "Close") AS fwd_ret,
      lead("Date", 20) OVER (PARTITION BY ticker ORDER BY "Date") AS label_end FROM feat) f LEFT JOIN mktf m USING ("Date")"""
CTES["panel"] = f"""SELECT *, CASE WHEN pct >= 0.8::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS label FROM (
    SELECT *, (rank() OVER (PARTITION BY "Date" ORDER BY excess) + (count(*) OVER (PARTITION BY "Date", excess) - 1) / 2.0::DOUBLE)
      / count(excess) OVER (PARTITION BY "Date") AS pct FROM lab0)
    WHERE excess IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}"""
CTES["fcal"] = """SELECT cast(k AS BIGINT) AS fold, cast(a + cast(180 * k AS INT) AS DATE) AS train_start,
      cast(a + 1095 + cast(180 * k AS INT) AS DATE) AS val_start, cast(a + 1275 + cast(180 * k AS INT) AS DATE) AS test_start,
      cast(a + 1455 + cast(180 * k AS INT) AS DATE) AS test_end
    FROM (SELECT min("Date") AS a, max("Date") AS b FROM panel), generate_series(0, 200) g(k)
    WHERE a + 1095 + cast(180 * k AS INT) + 360 <= b"""
CTES["assigned"] = """SELECT p.*, f.fold, f.val_start, f.test_start, r.role FROM panel p
    JOIN fcal f ON p."Date" >= f.train_start AND p."Date" < f.test_end
    JOIN (VALUES ('train'), ('val'), ('test')) r(role) ON CASE r.role WHEN 'train' THEN p."Date" < f.val_start
      WHEN 'val' THEN p."Date" >= f.val_start AND p."Date" < f.test_start ELSE p."Date" >= f.test_start END"""
CTES["purged"] = """SELECT * FROM assigned WHERE role = 'test' OR (role = 'train' AND label_end < val_start - 20)
    OR (role = 'val' AND label_end < test_start - 20)"""
CTES["purged_old"] = """SELECT * FROM assigned WHERE role <> 'train' OR "Date" < val_start - 20"""


def unit(prefix: str) -> str:
    return (f"cast(('0x' || substr(md5('{prefix}|' || ticker || '|' || strftime(\"Date\", '%Y-%m-%d')), 1, 6))::INT AS DOUBLE)"
            " / 16777216.0::DOUBLE")


CTES["scores"] = f"""SELECT arm, fold, ticker, "Date", "Close", label,
      CASE arm WHEN 'legacy' THEN p1 ELSE 0.8::DOUBLE * p1 + 0.2::DOUBLE * p2 END AS proba
    FROM (SELECT *, {unit('legacy')} AS p1, {unit('other')} AS p2 FROM assigned WHERE role = 'test') t,
      (VALUES ('legacy'), ('corrected')) a(arm)"""
CTES["cands"] = """SELECT s.* EXCLUDE ("Date"), s."Date" AS d0, m.month FROM scores s JOIN (
      SELECT arm, fold, cast(date_trunc('month', "Date") AS DATE) AS month, max("Date") AS d0 FROM scores GROUP BY ALL) m
    ON s.arm = m.arm AND s.fold = m.fold AND s."Date" = m.d0"""
CTES["scal"] = """SELECT arm, fold, "Date", row_number() OVER (PARTITION BY arm, fold ORDER BY "Date") AS ord,
      count(*) OVER (PARTITION BY arm, fold) AS last_ord FROM (SELECT DISTINCT arm, fold, "Date" FROM scores)"""
CTES["spx"] = """SELECT s.arm, s.fold, s.ticker, s."Date", s."Close" AS p, c.ord FROM scores s
    JOIN scal c ON s.arm = c.arm AND s.fold = c.fold AND s."Date" = c."Date" """

SQL["features"] = query('SELECT ticker, "Date", round("Close", 6) AS "Close", ' + ", ".join(
    f"round({c}, 6) AS {c}" for c in FEATURES if c != "rsi_14") + " FROM feat")
SQL["rsi"] = query('SELECT ticker, "Date", round(rsi_14, 6) AS rsi_14 FROM feat WHERE rsi_14 IS NOT NULL')
SQL["labels"] = query("""SELECT ticker, "Date", round(fwd_ret, 6) AS fwd_ret, round(mkt_fwd, 6) AS mkt_fwd,
  round(excess, 6) AS excess, label_end, label FROM panel""")
feature_ctes("feat_own", "bars")
SQL["latest_slice"] = query('SELECT ticker, "Date", round("Close", 6) AS "Close", ' + ", ".join(
    f"round({c}, 6) AS {c}" for c in FEATURES) + f""" FROM feat_own WHERE "Date" = (SELECT max("Date") FROM bars)
    AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}""")
SQL["vintage"] = query("""WITH e AS (SELECT ticker, max("Date") AS last_date FROM bars GROUP BY 1)
  SELECT ticker, last_date, (SELECT count(*) FROM e) AS symbols,
    (SELECT date_diff('day', min(last_date), max(last_date)) FROM e) AS span_days,
    (SELECT date_diff('day', min(last_date), max(last_date)) FROM e) <= 7 AS ok
  FROM e ORDER BY last_date, ticker LIMIT 5""".replace("WITH e AS", "SELECT * FROM (WITH e AS") + ")")
SQL["panel_coverage"] = query("""SELECT fold, role, count(*) AS rows, count(DISTINCT "Date") AS dates,
  count(DISTINCT ticker) AS tickers, min("Date") AS first_date, max("Date") AS last_date FROM purged GROUP BY 1, 2""")
CTES["cal"] = """SELECT "Date", row_number() OVER (ORDER BY "Date") AS ord, count(*) OVER () AS last_ord
  FROM (SELECT DISTINCT "Date" FROM bars)"""


def vol_cte(source: str, keys: str, kind: str) -> str:
    """Regime volatility over ``source`` (keys, ticker, "Date", ord, p)."""
    k = f"{keys}, " if keys else ""
    step = "ln(p / lag(p) OVER w)" if kind == "log" else "p / lag(p) OVER w - 1"
    return f"""SELECT {k}"Date", uret, ({roll('stddev_samp', 'uret', 60, 20, keys)}) * sqrt(252) AS uvol FROM (
      SELECT {k}"Date", avg(r) AS uret FROM (
        SELECT {k}"Date", CASE WHEN lag(ord) OVER w = ord - 1 THEN {step} END AS r FROM {source}
        WINDOW w AS (PARTITION BY {k}ticker ORDER BY ord)) GROUP BY {k}"Date") WHERE uret IS NOT NULL"""


CTES["px"] = 'SELECT b.ticker, b."Date", b."Close" AS p, c.ord FROM bars b JOIN cal c USING ("Date")'
CTES["uvol_simple"] = vol_cte("px", "", "simple")
CTES["uvol_log"] = vol_cte("px", "", "log")
SQL["universe_vol"] = query("""SELECT s."Date", round(s.uret, 6) AS uret, round(s.uvol, 6) AS uvol, round(l.uvol, 6) AS uvol_log
  FROM uvol_simple s JOIN uvol_log l USING ("Date")""")
CTES["dv"] = f"""SELECT ticker, "Date", coalesce({roll('avg', '("Close" * "Volume")', 20)}, 0) AS dv FROM allbars"""
CTES["tvol"] = f"""SELECT ticker, "Date", ({roll('stddev_samp', 'ret_1', 20)}) * sqrt(252) AS vol FROM feat_base"""
SQL["trailing_risk"] = query("""SELECT ticker, "Date", round(dv, 4) AS dv, round(vol, 6) AS vol FROM dv JOIN tvol USING (ticker, "Date")""")
CTES["trend"] = """SELECT ticker, "Date", p, sma, p > sma AS above FROM (
    SELECT ticker, "Date", ord, p, avg(p) OVER (PARTITION BY ticker ORDER BY ord RANGE BETWEEN 209 PRECEDING AND CURRENT ROW) AS sma
    FROM px) WHERE ord >= 215"""
SQL["trend_signal"] = query("""SELECT ticker, "Date", round(p, 6) AS "Close", round(sma, 6) AS sma, above FROM trend""")
SQL["fold_calendar"] = query("SELECT * FROM fcal")
for _n, _src in (("fold_assign_purged", "purged"), ("fold_assign_legacy", "purged_old")):
    SQL[_n] = query(f"""SELECT fold, role, ticker, "Date", label_end FROM {_src} WHERE fold IN (
      SELECT fold FROM {_src} GROUP BY fold HAVING count(*) FILTER (WHERE role = 'train') > 500
        AND count(*) FILTER (WHERE role = 'val') > 100 AND count(*) FILTER (WHERE role = 'test') > 100)""")
SQL["trailing_split"] = query("""SELECT role, ticker, "Date" FROM (SELECT *, CASE WHEN "Date" >= b - 180 THEN 'val'
    WHEN "Date" >= b - 180 - 1095 AND label_end < b - 180 - 20 THEN 'train' END AS role
  FROM panel, (SELECT max("Date") AS b FROM panel)) WHERE role IS NOT NULL""")
SQL["scored_folds"] = query("""SELECT arm, fold, ticker, "Date", round("Close", 6) AS "Close", label, round(proba, 6) AS proba FROM scores""")

# ---- filings ------------------------------------------------------------------------
CTES["rawf"] = """SELECT cast(o_orderdate AS DATE) AS filing_dt, cast(o_orderdate AS DATE) - 2 AS trade_dt,
    concat('T', lpad(cast(c_nationkey AS VARCHAR), 2, '0')) AS ticker, cast(o_custkey AS VARCHAR) AS insider,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CEO' WHEN '2' THEN 'CFO' WHEN '3' THEN 'Dir' WHEN '4' THEN 'VP' ELSE 'COO' END AS title,
    CASE o_orderstatus WHEN 'P' THEN 'P - Purchase' WHEN 'F' THEN 'S - Sale' END AS ttype,
    (100 + o_orderkey % 9900) / 100.0::DOUBLE AS price, cast(1000 + o_orderkey % 7919 AS DOUBLE) AS qty,
    cast(cast(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('P', 'F')"""
CTES["fil"] = """SELECT * EXCLUDE (rn) FROM (SELECT *, substr(ttype, 1, 1) AS side,
    CASE WHEN ttype LIKE 'P%' THEN abs(value) ELSE -abs(value) END AS sval,
    row_number() OVER (PARTITION BY filing_dt, trade_dt, ticker, insider, substr(ttype, 1, 1), qty, price
      ORDER BY title, ttype, value) AS rn FROM rawf) WHERE rn = 1"""
SQL["clean_filings"] = query("""SELECT filing_dt, trade_dt, ticker, insider, side, qty, price, title, ttype, value, sval FROM fil""")
CTES["mfil"] = """SELECT ticker, cast(date_trunc('month', filing_dt) AS DATE) AS month, count(*) FILTER (WHERE side = 'P') AS n_buy,
    count(*) FILTER (WHERE side = 'S') AS n_sell, count(DISTINCT insider) FILTER (WHERE side = 'P') AS buyers,
    cast(sum(cast(sval AS DECIMAL(20,2))) AS DOUBLE) AS netval FROM fil GROUP BY 1, 2"""
SQL["monthly_filings"] = query("""SELECT ticker, cast(last_day(month) + 3 AS DATE) AS avail, round(avg(n_buy) OVER w, 6) AS ins_nbuy_3m,
    round(avg(netval) OVER w, 4) AS ins_netval_3m, round(avg(n_buy / greatest(n_buy + n_sell, 1)) OVER w, 6) AS ins_buy_ratio_3m,
    cast(CASE WHEN buyers >= 3 THEN 1 ELSE 0 END AS BIGINT) AS ins_cluster_buy FROM mfil
  WINDOW w AS (PARTITION BY ticker ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
CTES["convb"] = """SELECT * FROM (SELECT *, lag(filing_dt) OVER (PARTITION BY ticker, insider ORDER BY filing_dt, sval) AS prev FROM fil
    WHERE side = 'P' AND title IN ('CEO', 'CFO', 'COO') AND sval > 50000) WHERE prev IS NULL OR filing_dt - prev > 365"""
SQL["conviction_buys"] = query("SELECT ticker, insider, filing_dt, sval FROM convb")
CTES["conv"] = """SELECT s.ticker, cast(last_day(s.month) + 3 AS DATE) AS avail,
    avg(CASE WHEN c.n > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS ins_conv_3m, avg(coalesce(c.val, 0)) OVER w AS ins_convval_3m
  FROM (SELECT DISTINCT ticker, cast(date_trunc('month', filing_dt) AS DATE) AS month FROM fil) s
  LEFT JOIN (SELECT ticker, cast(date_trunc('month', filing_dt) AS DATE) AS month, count(*) AS n,
      cast(sum(cast(sval AS DECIMAL(20,2))) AS DOUBLE) AS val FROM convb GROUP BY 1, 2) c USING (ticker, month)
  WINDOW w AS (PARTITION BY s.ticker ORDER BY s.month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
SQL["conviction"] = query("""SELECT ticker, avail, round(ins_conv_3m, 6) AS ins_conv_3m, round(ins_convval_3m, 4) AS ins_convval_3m FROM conv""")
SQL["asof_insider"] = query("""SELECT p.ticker, p."Date", round(coalesce(c.ins_conv_3m, 0), 6) AS ins_conv_3m,
    round(coalesce(c.ins_convval_3m, 0), 4) AS ins_convval_3m, cast(CASE WHEN c.avail IS NULL THEN 1 ELSE 0 END AS BIGINT) AS ins_missing
  FROM panel p ASOF LEFT JOIN conv c ON p.ticker = c.ticker AND p."Date" >= c.avail""")


# ---- selection ----------------------------------------------------------------------
def topn(source: str, n: str, where: str, part: str = "arm, fold, d0", order: str = "proba DESC, ticker",
         cols: str = "arm, fold, d0, ticker, proba") -> str:
    return f"""SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY {part}) AS weight FROM (
      SELECT {cols}, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn <= {n}"""


CTES["pt"] = topn("cands", "10", "proba >= 0.3::DOUBLE")
SQL["pick_threshold"] = query("SELECT arm, fold, d0, ticker, round(proba, 6) AS proba, rn, round(weight, 6) AS weight FROM pt")
CTES["gridc"] = """SELECT c.*, v.* FROM cands c JOIN (VALUES ('base', 0.30::DOUBLE, 10), ('gate25', 0.25::DOUBLE, 20),
    ('gate35', 0.35::DOUBLE, 20), ('gate60', 0.60::DOUBLE, 5), ('top40', 0.25::DOUBLE, 40)) v(variant, gate, names) ON proba >= gate"""
CTES["gridb"] = topn("gridc", "names", "1=1", "arm, fold, variant, d0", cols="arm, fold, variant, d0, ticker, proba, names")
SQL["pick_variants"] = query("SELECT arm, fold, variant, d0, ticker, round(weight, 6) AS weight FROM gridb")
CTES["fvol"] = vol_cte("spx", "arm, fold", "simple")
CTES["rexp"] = """SELECT q.arm, q.fold, q.d0, CASE WHEN v.uvol > 0 THEN least(1.0::DOUBLE, 0.2::DOUBLE / v.uvol) ELSE 1 END AS exposure
  FROM (SELECT arm, fold, d0 FROM cands WHERE proba >= 0.25::DOUBLE GROUP BY ALL HAVING count(*) >= 5) q
  ASOF LEFT JOIN fvol v ON q.arm = v.arm AND q.fold = v.fold AND q.d0 >= v."Date" """
CTES["rtop"] = topn("cands", "20", "proba >= 0.25::DOUBLE")
CTES["rbook"] = """SELECT t.* EXCLUDE (weight), e.exposure, t.weight * e.exposure AS weight FROM rtop t JOIN rexp e USING (arm, fold, d0)"""
SQL["pick_risk"] = query("SELECT arm, fold, d0, ticker, round(exposure, 6) AS exposure, round(weight, 6) AS weight FROM rbook")
CTES["lsw"] = topn("cands", "5", "proba <= 1 - 0.3::DOUBLE", order="proba, ticker DESC")
CTES["lsl"] = topn("cands", "5", "proba >= 0.3::DOUBLE")
CTES["lsb"] = """SELECT arm, fold, d0, ticker, proba, 0.5::DOUBLE * side / count(*) OVER (PARTITION BY arm, fold, d0, side) AS weight FROM (
    SELECT arm, fold, d0, ticker, proba, -1 AS side FROM lsw UNION ALL
    SELECT arm, fold, d0, ticker, proba, 1 FROM lsl WHERE (arm, fold, d0, ticker) NOT IN (SELECT (arm, fold, d0, ticker) FROM lsw))
  QUALIFY count(DISTINCT side) OVER (PARTITION BY arm, fold, d0) = 2"""
SQL["pick_long_short"] = query("SELECT arm, fold, d0, ticker, round(proba, 6) AS proba, round(weight, 6) AS weight FROM lsb")
CTES["acal"] = """SELECT "Date", row_number() OVER (ORDER BY "Date") AS ord, count(*) OVER () AS last_ord
  FROM (SELECT DISTINCT "Date" FROM allbars)"""
CTES["apx"] = """SELECT b.ticker, b."Date", b."Close" AS p, c.ord FROM allbars b JOIN acal c USING ("Date")"""
CTES["dmom"] = """SELECT d.d0, r.ticker, r.p / b.p - 1 AS mom FROM (SELECT DISTINCT d0 FROM cands) d JOIN acal c ON d.d0 = c."Date"
  JOIN apx r ON r.ord = c.ord - 20 JOIN apx b ON b.ord = c.ord - 251 AND b.ticker = r.ticker WHERE c.ord >= 252"""


def pct_rank_sql(value: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER (PARTITION BY {part})")


CTES["dmomr"] = f"SELECT d0, ticker, {pct_rank_sql('mom', 'd0')} AS mom_rank FROM dmom"
CTES["mlr"] = f"SELECT arm, fold, d0, ticker, proba, {pct_rank_sql('proba', 'arm, fold, d0')} AS ml_rank FROM cands"


def blend_cte(w: float, fill: str | None) -> str:
    mr = f"coalesce(g.mom_rank, {fill}::DOUBLE)" if fill else "g.mom_rank"
    return f"""SELECT *, {w}::DOUBLE * ml_rank + {1 - w}::DOUBLE * mom_rank AS score FROM (
      SELECT m.*, {mr} AS mom_rank FROM mlr m {'LEFT JOIN' if fill else 'JOIN'} dmomr g USING (d0, ticker))"""


CTES["bl25"] = blend_cte(0.25, None)
CTES["bl50"] = blend_cte(0.5, None)
CTES["bl50f"] = blend_cte(0.5, "0.5")
CTES["bl0"] = blend_cte(0.0, None)
SQL["blend_scores"] = query("""SELECT arm, fold, d0, ticker, round(proba, 6) AS proba, round(ml_rank, 6) AS ml_rank,
  round(mom_rank, 6) AS mom_rank, round(score, 6) AS score FROM bl25""")
BLC = dict(order="score DESC, ticker", cols="arm, fold, d0, ticker, score")
CTES["blb"] = topn("bl50f", "8", "1=1", **BLC)
CTES["conb"] = topn("bl50", "20", "ml_rank >= 0.6::DOUBLE AND mom_rank >= 0.6::DOUBLE", **BLC)
for _n, _c in (("pick_blend", "blb"), ("pick_consensus", "conb")):
    SQL[_n] = query(f"SELECT arm, fold, d0, ticker, round(score, 6) AS score, rn, round(weight, 6) AS weight FROM {_c}")
CTES["liqc"] = """SELECT c.* FROM cands c JOIN dv v ON c.ticker = v.ticker AND c.d0 = v."Date" WHERE v.dv >= 60000"""
CTES["liqb"] = topn("liqc", "10", "proba >= 0.3::DOUBLE")
SQL["pick_liquid"] = query("SELECT arm, fold, d0, ticker, round(proba, 6) AS proba, rn, round(weight, 6) AS weight FROM liqb")


def inverse_vol_cte(book: str) -> str:
    return f"""SELECT arm, fold, d0, ticker, vol, CASE WHEN sum(inv) OVER w > 0 THEN sum(weight) OVER w * inv / sum(inv) OVER w
      ELSE weight END AS weight FROM (SELECT b.*, v.vol, CASE WHEN v.vol > 0 THEN 1 / v.vol ELSE 0 END AS inv
        FROM {book} b LEFT JOIN tvol v ON b.ticker = v.ticker AND b.d0 = v."Date") WINDOW w AS (PARTITION BY arm, fold, d0)"""


CTES["ivb"] = inverse_vol_cte("rtop")
SQL["weight_inverse_vol"] = query("SELECT arm, fold, d0, ticker, round(vol, 6) AS vol, round(weight, 6) AS weight FROM ivb")
CTES["stf"] = topn("cands", "5", "proba >= 0.3::DOUBLE", cols="arm, fold, d0, month, ticker, proba")
CTES["sth"] = """SELECT d.arm, d.fold, d.d0, f.ticker, min((f.d0, f.rn)) AS first FROM (SELECT DISTINCT arm, fold, d0 FROM cands) d
  JOIN stf f ON d.arm = f.arm AND d.fold = f.fold AND f.d0 < d.d0 GROUP BY ALL HAVING d.d0 - max(f.d0) < 40"""
CTES["stb"] = """SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY arm, fold, d0) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY arm, fold, d0 ORDER BY fresh, first) AS rn FROM (
      SELECT arm, fold, d0, ticker, 0 AS fresh, first FROM sth UNION ALL
      SELECT arm, fold, d0, ticker, 1, (d0, rn) FROM stf WHERE (arm, fold, d0, ticker) NOT IN (SELECT (arm, fold, d0, ticker) FROM sth)))
  WHERE rn <= 5"""
SQL["pick_sticky"] = query("SELECT arm, fold, d0, ticker, cast(fresh AS BIGINT) AS fresh, rn, round(weight, 6) AS weight FROM stb")
CTES["tmon"] = """SELECT max("Date") AS d0, max(ord) AS ord, row_number() OVER (ORDER BY date_trunc('month', "Date")) - 1 AS i
  FROM cal GROUP BY date_trunc('month', "Date")"""
CTES["tbook"] = """SELECT m.d0, t.ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY m.d0) AS weight FROM tmon m
  JOIN tmon s ON s.i = m.i - m.i % 3 JOIN trend t ON t."Date" = s.d0 AND t.above WHERE m.ord >= 215"""
CTES["tdec"] = "SELECT d0 FROM tmon WHERE ord >= 215"
SQL["pick_trend"] = query("SELECT d0, ticker, round(weight, 6) AS weight FROM tbook")
SQL["liquid_universe"] = query("""SELECT * FROM (SELECT "Date" AS d0, ticker, round("Close" * "Volume", 6) AS dv, row_number() OVER (
  PARTITION BY "Date" ORDER BY "Close" * "Volume" DESC, ticker) AS rn FROM bars WHERE "Close" > 5 AND "Close" * "Volume" > 30000) WHERE rn <= 10""")
CTES["wliq"] = """SELECT * FROM (SELECT "Date" AS d0, ticker, row_number() OVER (PARTITION BY "Date" ORDER BY "Close" * "Volume" DESC, ticker) AS rn
  FROM wbars WHERE "Close" > 5 AND "Close" * "Volume" > 100000) WHERE rn <= 20"""
CTES["wown"] = """SELECT "Date" AS d0, ticker, CASE WHEN row_number() OVER w >= 52 THEN lag("Close", 3) OVER w / lag("Close", 51) OVER w - 1 END AS mom
  FROM wbars WINDOW w AS (PARTITION BY ticker ORDER BY "Date")"""
SQL["pick_momentum_topk"] = query("""SELECT d0, ticker, round(mom, 6) AS mom, round(1.0::DOUBLE / count(*) OVER (PARTITION BY d0), 6) AS weight FROM (
  SELECT o.*, row_number() OVER (PARTITION BY d0 ORDER BY mom DESC, ticker) AS rn, count(*) OVER (PARTITION BY d0) AS total
  FROM wown o JOIN wdec USING (d0) JOIN wliq USING (d0, ticker) WHERE mom IS NOT NULL)
  WHERE total >= 5 AND rn <= greatest(5, floor(total * 0.1::DOUBLE) + 1)""")
SQL["pick_momentum_score"] = query("""SELECT d0, ticker, round(mom, 6) AS mom, round(1.0::DOUBLE / count(*) OVER (PARTITION BY d0), 6) AS weight FROM (
  SELECT x.*, c.total, row_number() OVER (PARTITION BY x.d0 ORDER BY x.mom DESC, x.ticker) AS place FROM wmom x JOIN wcut c ON x.d0 = c.d0
  WHERE x.mom >= c.cut) WHERE place <= greatest(5, floor(total * 0.1::DOUBLE) + 1)""")
SQL["pick_momentum_live"] = query("""SELECT d0, ticker, round(mom, 6) AS mom, round(1.0::DOUBLE / n, 6) AS weight FROM (
  SELECT x.*, count(*) OVER (PARTITION BY x.d0) AS n FROM wmom x JOIN (SELECT d0, quantile_cont(mom, 0.9) AS cut FROM wmom GROUP BY d0) c
  ON x.d0 = c.d0 WHERE x.mom >= c.cut) WHERE n >= 3""")
CTES["live"] = f"""SELECT "Date" AS d0, ticker, {unit('live')} AS proba FROM feat_own WHERE "Date" = (SELECT max("Date") FROM bars)
  AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}"""
SQL["pick_live"] = query("SELECT d0, ticker, round(proba, 6) AS proba, rn, round(weight, 6) AS weight FROM (" + topn(
    "live", "20", "proba >= 0.3::DOUBLE", "d0", cols="d0, ticker, proba") + ")")
SQL["selection_boundary"] = query(f"""SELECT arm, fold, d0, string_agg(ticker, ',' ORDER BY ticker) AS picks,
  round(CASE WHEN count(*) = 10 THEN greatest(0.25::DOUBLE, min(proba)) ELSE 0.25::DOUBLE END, 6) AS boundary
  FROM ({topn("cands", "10", "proba >= 0.25::DOUBLE")}) GROUP BY 1, 2, 3""")

# ---- ledger -------------------------------------------------------------------------
KEYS = ("arm", "fold")
COLS8 = ", ".join(f"round({c}, 8) AS {c}" for c in ("gross", "turnover", "cost", "net", "equity", "drawdown"))
FOLD = dict(decisions="cands", px="spx", cal="scal", keys=KEYS, grid=KEYS)
FULLPX = dict(decisions="cands", px="apx", cal="acal", keys=KEYS, grid=())
ledger_ctes("lb", "pt", **FOLD)
ledger_ctes("lst", "pt", stop=0.95, **FOLD)
ledger_ctes("lls", "lsb", stop=0.95, borrow=0.05, **FOLD)
ledger_ctes("lr", "rbook", stop=0.95, cost=25.0, **FOLD)
ledger_ctes("lh", "rtop", stop=0.95, cost=25.0, horizon=10, missing="survivors", **FOLD)
ledger_ctes("lk", "stb", cost=25.0, horizon=21, missing="survivors", **FULLPX)
ledger_ctes("lt", "tbook", decisions="tdec", px="px", cal="cal", cost=10.0, horizon=21, missing="survivors")
CTES["rk_top"] = topn("bl25", "5", "1=1", **BLC)
CTES["rk_book"] = inverse_vol_cte("rk_top")
ledger_ctes("lrk", "rk_book", stop=0.95, cost=25.0, **FULLPX)
CTES["ctl_book"] = topn("bl0", "5", "1=1", **BLC)
ledger_ctes("lc", "ctl_book", stop=0.95, cost=25.0, **FULLPX)
CTES["ptshort"] = "SELECT * REPLACE (-weight AS weight) FROM pt"
ledger_ctes("lsh", "ptshort", stop=0.95, **FOLD)

SQL["turnover"] = query("""SELECT n.arm, n.fold, n.d0, n.m, round(coalesce(t.turnover, 0), 8) AS turnover
  FROM lb_num n LEFT JOIN lb_turn t USING (arm, fold, m)""")
SQL["legs_stop"] = query("SELECT arm, fold, ticker, d0, round(ret, 8) AS ret FROM lst_legs")
SQL["legs_short"] = query("SELECT arm, fold, ticker, d0, round(ret, 8) AS ret FROM lsh_legs")
for _n, _c in (("ledger_base", "lb"), ("ledger_ls", "lls"), ("ledger_hold10", "lh"),
               ("ledger_sticky", "lk"), ("ledger_rank", "lrk")):
    SQL[_n] = query(f"SELECT arm, fold, d0, m, n, {COLS8} FROM {_c}_eq")
SQL["ledger_trend"] = query(f"SELECT d0, m, n, {COLS8} FROM lt_eq")
SQL["ledger_summary"] = query(summary_sql("lb_eq", KEYS, FULL))
CTES["avol"] = vol_cte("apx", "", "log")


def brake_rows(prefix: str) -> str:
    """Decisions with unbraked gross and the (previous, current) weight pairs."""
    return f"""SELECT n.arm, n.fold, n.d0, n.m AS i, coalesce(g.gross, 0) AS gross0, p.pairs FROM {prefix}_num n
  LEFT JOIN {prefix}_gross g USING (arm, fold, d0) LEFT JOIN (
    SELECT coalesce(a.arm, b.arm) AS arm, coalesce(a.fold, b.fold) AS fold, coalesce(a.m, b.m) AS m,
      list({{'a': coalesce(b.weight, 0), 'b': coalesce(a.weight, 0)}} ORDER BY coalesce(a.ticker, b.ticker)) AS pairs
    FROM (SELECT arm, fold, m, ticker, weight FROM {prefix}_bk) a FULL JOIN (SELECT arm, fold, m + 1 AS m, ticker, weight FROM {prefix}_bk) b
      ON a.arm = b.arm AND a.fold = b.fold AND a.m = b.m AND a.ticker = b.ticker GROUP BY 1, 2, 3) p
    ON n.arm = p.arm AND n.fold = p.fold AND n.m = p.m"""


def brake_path(name: str, rows: str) -> str:
    """The braked ledger as a recursion over the decisions of each key."""
    return f"""{name} AS (
  SELECT arm, fold, cost_bps, 0::BIGINT AS i, NULL::DATE AS d0, 0.0::DOUBLE AS f, 0.0::DOUBLE AS gross, 0.0::DOUBLE AS turnover,
    0.0::DOUBLE AS net, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak
  FROM (SELECT DISTINCT arm, fold FROM {rows}), (VALUES (5.0::DOUBLE), (25.0::DOUBLE)) c(cost_bps)
  UNION ALL
  SELECT arm, fold, cost_bps, i, d0, f, gross, turnover, net, e0 * (1 + net) AS equity, greatest(p0, e0 * (1 + net)) AS peak FROM (
    SELECT *, gross - turnover * cost_bps / 10000 AS net FROM (
      SELECT *, gross0 * f AS gross, 0.5::DOUBLE * coalesce(list_sum(list_transform(pairs, lambda x: abs(f * x.b - f0 * x.a))), 0) AS turnover FROM (
        SELECT b.*, p.cost_bps, p.equity AS e0, p.peak AS p0, p.f AS f0,
          CASE WHEN p.equity / p.peak - 1 < -0.02::DOUBLE THEN 0.5::DOUBLE ELSE 1 END AS f
        FROM {name} p JOIN {rows} b ON p.arm = b.arm AND p.fold = b.fold AND b.i = p.i + 1))))"""


CTES["brk"] = brake_rows("lr")
SQL["brake_ledger"] = query("""SELECT arm, fold, cost_bps, d0, f AS exposure, round(gross, 8) AS gross, round(turnover, 8) AS turnover,
    round(net, 8) AS net, round(equity, 8) AS equity, round(equity / peak - 1, 8) AS drawdown FROM path WHERE i > 0""",
                            recursive=brake_path("path", "brk"))


def braked(*more: str) -> str:
    """The braked risk ledger at its cost, and CTEs built on it."""
    return ",\n".join([brake_path("path", "brk"), """risk AS (SELECT p.arm, p.fold, p.d0, i AS m, coalesce(g.n, 0) AS n, gross, turnover,
  turnover * cost_bps / 10000 AS cost, net, equity, equity / peak - 1 AS drawdown
  FROM path p LEFT JOIN (SELECT arm, fold, d0, n FROM lr_gross) g USING (arm, fold, d0) WHERE i > 0 AND cost_bps = 25)""", *more])


SQL["ledger_risk"] = query(f"SELECT arm, fold, d0, m, n, {COLS8} FROM risk", braked())
SQL["ensemble"] = query(f"""SELECT arm, fold, d0, round(net, 8) AS net, round(equity, 8) AS equity,
  round(drawdown, 8) AS drawdown FROM {rebased('ens', 'arm, fold')}""", braked(
    "ens AS (SELECT a.arm, a.fold, a.d0, (a.net + b.net) / 2 AS net FROM risk a JOIN lc_led b USING (arm, fold, d0))"))
SQL["calm_only"] = query(f"""SELECT arm, fold, d0, round(uvol, 8) AS uvol, round(net, 8) AS net, round(equity, 8) AS equity
  FROM {rebased('calm', 'arm, fold')}""", braked(
    """calm AS (SELECT l.arm, l.fold, l.d0, v.uvol, CASE WHEN v.uvol > 0.25::DOUBLE THEN 0 ELSE l.net END AS net
  FROM risk l ASOF LEFT JOIN avol v ON l.d0 >= v."Date")"""))
CTES["sweep"] = """SELECT l.* REPLACE (gross - turnover * c / 10000 AS net), c AS cost_bps FROM lb_led l,
  (VALUES (0.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) v(c)"""
CTES["sweep_all"] = summary_sql(rebased("sweep", "arm, cost_bps"), ("arm", "cost_bps"))
CTES["sweep_fold"] = """SELECT arm, cost_bps, avg(s) AS sharpe_mean, avg(g) AS fold_cagr_mean FROM (
    SELECT arm, cost_bps, fold, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(12) AS s,
      pow(product(1 + net), 12.0::DOUBLE / count(*)) - 1 AS g FROM sweep GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTES["sweep_net"] = "SELECT arm, cost_bps, avg(net) AS avg_net FROM sweep GROUP BY 1, 2"
SQL["cost_sweep"] = query("""SELECT arm, cost_bps, months, equity_end, sharpe AS stitched_sharpe, max_dd, cagr,
  round(sharpe_mean, 6) AS sharpe_mean, round(fold_cagr_mean, 6) AS fold_cagr_mean, round(avg_net, 6) AS avg_net
  FROM sweep_all JOIN sweep_fold USING (arm, cost_bps) JOIN sweep_net USING (arm, cost_bps)""")
CTES["nb_names"] = """SELECT arm, fold, d0, ticker, row_number() OVER (PARTITION BY arm, fold, d0 ORDER BY ticker) - 1 AS ordinal,
  count(*) OVER (PARTITION BY arm, fold, d0) AS total FROM (SELECT DISTINCT arm, fold, d0, ticker FROM cands)"""
CTES["nb_0"] = """SELECT arm, fold, d0, total, trial, cast([] AS BIGINT[]) AS taken
  FROM (SELECT DISTINCT arm, fold, d0, total FROM nb_names), range(200) r(trial)"""
for _i in range(5):
    CTES[f"nb_{_i + 1}"] = f"""SELECT * EXCLUDE (last, drawn) REPLACE (CASE WHEN last IS NULL THEN taken
        WHEN list_contains(taken, drawn) THEN list_append(taken, last) ELSE list_append(taken, drawn) END AS taken) FROM (
      SELECT *, cast('0x' || substr(md5(concat_ws('|', '0', trial, strftime(d0, '%Y-%m-%d'), '{_i}')), 1, 12) AS BIGINT) % (last + 1) AS drawn
      FROM (SELECT *, CASE WHEN {_i} < total THEN total - least(total, 5) + {_i} END AS last FROM nb_{_i}))"""
CTES["nb"] = """SELECT arm, fold, trial, d0, ticker, 1.0::DOUBLE / least(total, 5) AS weight
  FROM (SELECT arm, fold, trial, d0, unnest(taken) AS ordinal FROM nb_5) JOIN nb_names USING (arm, fold, d0, ordinal)"""
ledger_ctes("ln", "nb", "nb", "spx", "scal", ("arm", "fold", "trial"), KEYS)
SQL["null_books"] = query("""SELECT arm, fold, count(*) AS trials, round(avg(e), 6) AS null_mean, round(stddev_samp(e), 6) AS null_std,
  round(quantile_cont(e, 0.05), 6) AS null_p5, round(quantile_cont(e, 0.95), 6) AS null_p95
  FROM (SELECT arm, fold, trial, product(1 + net) AS e FROM ln_led GROUP BY 1, 2, 3) GROUP BY 1, 2""")
CTES["mcal"] = 'SELECT "Date", "Close" AS p, row_number() OVER (ORDER BY "Date") AS ord FROM mkt'
SQL["benchmark_legs"] = query("""SELECT d.d0, round(f.p / s.p - 1, 8) AS bench FROM (SELECT DISTINCT d0 FROM cands) d
  ASOF JOIN mcal s ON d.d0 >= s."Date" JOIN mcal f ON f.ord = s.ord + 21""")


# ---- evaluation and stability -------------------------------------------------------
SQL["auc_by_fold"] = query("""SELECT arm, fold, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives,
  round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
    / nullif(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0), 0), 6) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY arm, fold ORDER BY proba)
    + (count(*) OVER (PARTITION BY arm, fold, proba) - 1) / 2.0::DOUBLE AS r FROM scores) GROUP BY 1, 2""")
CTES["common"] = """SELECT a."Date", a.ticker, a."Close" AS cl, b."Close" AS cr, a.label AS ll, b.label AS lr, a.proba AS pl, b.proba AS pr
  FROM scores a JOIN scores b ON a."Date" = b."Date" AND a.ticker = b.ticker WHERE a.arm = 'legacy' AND b.arm = 'corrected'"""


def avg_rank(value: str, part: str) -> str:
    p, v = (f"PARTITION BY {part} ", f"PARTITION BY {part}, {value}") if part else ("", f"PARTITION BY {value}")
    return f"(rank() OVER ({p}ORDER BY {value}) + (count(*) OVER ({v}) - 1) / 2.0::DOUBLE)"


SQL["score_compare"] = query(f"""SELECT count(*) AS rows, round(avg(CASE WHEN ll = lr THEN 1.0::DOUBLE ELSE 0 END), 6) AS label_match,
  round(max(abs(cl / cr - 1)), 6) AS close_max_diff, round(corr(pl, pr), 6) AS pearson, round(corr(a, b), 6) AS spearman,
  round(avg(abs(pl - pr)), 6) AS mean_abs_diff, round(quantile_cont(abs(cl / cr - 1), 0.5), 6) AS close_gap
  FROM (SELECT *, {avg_rank('pl', '')} AS a, {avg_rank('pr', '')} AS b FROM common)""")
SQL["spearman_by_date"] = query(f"""SELECT "Date", count(*) AS rows, round(corr(a, b), 6) AS spearman
  FROM (SELECT *, {avg_rank('pl', '"Date"')} AS a, {avg_rank('pr', '"Date"')} AS b FROM common) GROUP BY 1""")


def arm_picks(source: str, col: str, n: int) -> str:
    return f"""SELECT d0, list(ticker ORDER BY ticker) AS picks,
      CASE WHEN count(*) = {n} THEN greatest(0.25::DOUBLE, min({col})) ELSE 0.25::DOUBLE END AS bound FROM (
        SELECT *, row_number() OVER (PARTITION BY d0 ORDER BY {col} DESC, ticker) AS rn FROM {source} WHERE {col} >= 0.25::DOUBLE)
      WHERE rn <= {n} GROUP BY d0"""


def chosen(source: str, n: int) -> str:
    return f"""SELECT s.d0, coalesce(l.picks, []) AS lp, coalesce(r.picks, []) AS rp, coalesce(l.bound, 0.25::DOUBLE) AS lb,
      coalesce(r.bound, 0.25::DOUBLE) AS rb FROM (SELECT DISTINCT d0 FROM {source}) s
      LEFT JOIN ({arm_picks(source, 'pl', n)}) l ON s.d0 = l.d0 LEFT JOIN ({arm_picks(source, 'pr', n)}) r ON s.d0 = r.d0"""


CTES["cdays"] = 'SELECT *, "Date" AS d0 FROM common'
CTES["cmonths"] = """SELECT * FROM cdays WHERE "Date" IN (SELECT max("Date") FROM common GROUP BY date_trunc('month', "Date"))"""
CTES["jday"] = chosen("cdays", 5)
CTES["jmon"] = chosen("cmonths", 5)
SIZES = """cast(len(lp) AS BIGINT) AS left_n, cast(len(rp) AS BIGINT) AS right_n,
  cast(len(list_intersect(lp, rp)) AS BIGINT) AS intersection_n, cast(len(list_distinct(lp || rp)) AS BIGINT) AS union_n"""
JAC = "len(list_intersect(lp, rp)) / nullif(len(list_distinct(lp || rp)), 0)"
SQL["jaccard"] = query(f"SELECT d0, {SIZES}, round(coalesce({JAC}, 1.0::DOUBLE), 6) AS jaccard, lp = rp AS exact_match FROM jday")
CTES["smon"] = f"""SELECT j.d0, {SIZES}, {JAC} AS jaccard, lp = rp AS exact_match, x.rs AS rank_spearman, lb AS left_boundary,
    rb AS right_boundary, x.mad AS mean_abs_change FROM jmon j JOIN (
    SELECT d0, corr(a, b) AS rs, avg(abs(pl - pr)) AS mad FROM (
      SELECT *, {avg_rank('pl', 'd0')} AS a, {avg_rank('pr', 'd0')} AS b FROM cmonths) GROUP BY d0) x ON j.d0 = x.d0"""
SQL["stability_monthly"] = query("""SELECT d0, left_n, right_n, intersection_n, union_n, round(jaccard, 6) AS jaccard, exact_match,
  round(rank_spearman, 6) AS rank_spearman, round(left_boundary, 6) AS left_boundary, round(right_boundary, 6) AS right_boundary,
  round(mean_abs_change, 6) AS mean_abs_change FROM smon""")
CTES["sdist"] = """SELECT list_contains(lp, ticker) <> list_contains(rp, ticker) AS changed,
    0.5::DOUBLE * (abs(pl - lb) + abs(pr - rb)) AS dist FROM cmonths JOIN jmon USING (d0)"""
SQL["stability_distance"] = query("""SELECT b.pos, b.distance_bin, count(s.dist) AS names, count(*) FILTER (WHERE changed) AS changed,
  round(count(*) FILTER (WHERE changed) / nullif(count(s.dist), 0), 6) AS disagreement_rate
  FROM (VALUES (0::BIGINT, '0-1 pp', -1::DOUBLE, 0.01::DOUBLE), (1, '1-2 pp', 0.01, 0.02), (2, '2-5 pp', 0.02, 0.05),
    (3, '5-10 pp', 0.05, 0.1), (4, '>10 pp', 0.1, 9)) b(pos, distance_bin, lo, hi)
  LEFT JOIN sdist s ON s.dist > b.lo AND s.dist <= b.hi GROUP BY 1, 2""")
SQL["stability_summary"] = query("""SELECT count(*) AS months, count(jaccard) AS nonempty_months, round(avg(jaccard), 6) AS mean_jaccard,
  round(quantile_cont(jaccard, 0.5), 6) AS median_jaccard, round(quantile_cont(jaccard, 0.1), 6) AS p10_jaccard,
  round(quantile_cont(jaccard, 0.9), 6) AS p90_jaccard, count(*) FILTER (WHERE exact_match AND jaccard IS NOT NULL) AS exact_months,
  round(avg(rank_spearman), 6) AS mean_spearman, round(quantile_cont(rank_spearman, 0.5), 6) AS median_spearman,
  round(avg(left_n), 6) AS mean_left_n, round(avg(right_n), 6) AS mean_right_n FROM smon""")
SQL["stability_rolling"] = query(f"""SELECT d0, round(jaccard, 6) AS jaccard, round({roll('avg', 'jaccard', 12, 3, '', 'd0')}, 6) AS rolling FROM smon""")

# ---- trials and statistics ----------------------------------------------------------
CTES["gridd"] = """SELECT DISTINCT arm, fold, variant, d0 FROM cands, (VALUES ('base'), ('gate25'), ('gate35'), ('gate60'), ('top40')) v(variant)"""
ledger_ctes("lg", "gridb", "gridd", "spx", "scal", ("arm", "fold", "variant"), KEYS, stop=0.95, cost=25.0)
CTES["tn"] = """SELECT *, CASE WHEN dense_rank() OVER (ORDER BY fold) <= floor((SELECT count(DISTINCT fold) FROM cands) / 2.0)
  THEN 'tune' ELSE 'hold' END AS half FROM lg_led"""
TK = ("arm", "variant", "half")
CTES["trialt"] = summary_sql(rebased("tn", "arm, variant, half"), TK, FULL)
SQL["trials"] = query("SELECT * FROM trialt")
SQL["promotion_gate"] = query("""SELECT arm, variant, sharpe, max_dd, cagr, sharpe > 0 AND max_dd > -0.35 AS passed
  FROM trialt WHERE half = 'tune'""")
SQL["best_trial"] = query("""SELECT arm, half, variant, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY arm, half
  ORDER BY sharpe DESC, variant) AS rn FROM trialt) WHERE rn = 1""")


def gate_side(source: str, p: str) -> str:
    return f"""SELECT arm, count(*) AS {p}_months, pow(product(1 + net), 12.0::DOUBLE / count(*)) - 1 AS {p}_cagr,
      avg(net) / (stddev_samp(net) + 1e-12) * sqrt(12) AS {p}_sharpe, min(least(drawdown, 0)) AS {p}_max_dd
      FROM {rebased(source, 'arm')} GROUP BY arm"""


SQL["validation_gate"] = query(f"""SELECT arm, cand_months, round(cand_cagr, 6) AS cand_cagr, round(cand_sharpe, 6) AS cand_sharpe,
  round(cand_max_dd, 6) AS cand_max_dd, ctrl_months, round(ctrl_cagr, 6) AS ctrl_cagr, round(ctrl_sharpe, 6) AS ctrl_sharpe,
  round(ctrl_max_dd, 6) AS ctrl_max_dd, cand_cagr > ctrl_cagr AND cand_sharpe > ctrl_sharpe AND cand_max_dd >= ctrl_max_dd - 0.02::DOUBLE AS passed
  FROM ({gate_side('vcand', 'cand')}) JOIN ({gate_side('vctrl', 'ctrl')}) USING (arm)""", braked(
    "vcand AS (SELECT a.arm, a.d0, a.net FROM risk a JOIN lc_led b USING (arm, fold, d0))",
    "vctrl AS (SELECT b.arm, b.d0, b.net FROM risk a JOIN lc_led b USING (arm, fold, d0))"))
CTES["moments"] = """SELECT arm, variant, half, count(*) AS months, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) AS sharpe_m,
    avg(pow(net - mu, 3)) / pow(avg(pow(net - mu, 2)), 1.5) AS skew, avg(pow(net - mu, 4)) / pow(avg(pow(net - mu, 2)), 2) AS kurtosis
  FROM (SELECT *, avg(net) OVER (PARTITION BY arm, variant, half) AS mu FROM tn) GROUP BY 1, 2, 3"""
SQL["return_moments"] = query("""SELECT arm, variant, half, months, round(sharpe_m, 6) AS sharpe_m, round(skew, 6) AS skew,
  round(kurtosis, 6) AS kurtosis FROM moments""")


def expected_max(n: int) -> str:
    """Factor on the deviation of trial Sharpes; normal quantiles as fixed numbers."""
    import math
    from statistics import NormalDist
    q, g = NormalDist().inv_cdf, 0.5772156649015329
    return repr((1 - g) * q(1 - 1 / n) + g * q(1 - 1 / (n * math.e)))


def normal_cdf(z: str) -> str:
    """Simpson's rule on 2000 intervals."""
    return f"""(SELECT 0.5::DOUBLE + ({z}) / 6000.0::DOUBLE / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
      * exp(-pow(({z}) * k / 2000.0::DOUBLE, 2) / 2)) FROM range(2001) r(k))"""


CTES["dm"] = "SELECT * REPLACE (arm || '/' || variant AS variant) FROM moments WHERE half = 'tune'"
CTES["dbest"] = "SELECT variant AS best, sharpe_m AS sharpe, months, skew, kurtosis FROM dm ORDER BY sharpe_m DESC, variant LIMIT 1"
CTES["dsc"] = f"""SELECT scenario, trials, variance, variance_f * 1.0 AS star_f, b.* FROM dbest b, (
    SELECT 'formal' AS scenario, count(*) AS trials, var_samp(sharpe_m) AS variance, {expected_max(10)}::DOUBLE AS variance_f FROM dm UNION ALL
    SELECT 'formal, variance without base', count(*), var_samp(sharpe_m) FILTER (WHERE variant NOT LIKE '%/base'), {expected_max(10)}::DOUBLE FROM dm UNION ALL
    SELECT 'broad', count(*) + 33, var_samp(sharpe_m) FILTER (WHERE variant NOT LIKE '%/base'), {expected_max(43)}::DOUBLE FROM dm)"""
CTES["dz"] = """SELECT *, sqrt(variance) * star_f AS sharpe_star,
    sharpe * sqrt(months - 1) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)) AS z0,
    (sharpe - sqrt(variance) * star_f) * sqrt(months - 1) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)) AS z1 FROM dsc"""
SQL["deflated_sharpe"] = query(f"""SELECT scenario, trials, round(variance, 6) AS variance, best, round(sharpe, 6) AS sharpe, months,
  round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(sharpe_star, 6) AS sharpe_star, round({normal_cdf('dz.z0')}, 6) AS psr0,
  round({normal_cdf('dz.z1')}, 6) AS dsr FROM dz""")
CTES["bs"] = "SELECT row_number() OVER (ORDER BY d0) - 1 AS idx, net AS v, count(*) OVER () AS n FROM mo_led"
CTES["bd"] = """SELECT draw, v FROM (SELECT draw, (s + j) % n AS idx FROM (
      SELECT draw, b, n, ('0x' || substr(md5(concat_ws('|', '0', draw, b)), 1, 7))::BIGINT % n AS s
      FROM (SELECT DISTINCT n FROM bs), range(5000) d(draw), range(200) k(b) WHERE b * 6 < n), range(6) q(j) WHERE b * 6 + j < n)
  JOIN bs USING (idx)"""
CTES["bstat"] = """SELECT draw, avg(v) AS mean, pow(product(1 + v), 12.0::DOUBLE / count(*)) - 1 AS cagr,
    avg(v) / nullif(stddev_samp(v), 0) * sqrt(12) AS sharpe FROM bd GROUP BY 1"""
_ci = ", ".join(f"round(quantile_cont({s}, {q}), 6) AS {s}_{t}" for s in ("mean", "cagr", "sharpe") for q, t in ((0.025, "lo"), (0.975, "hi")))
SQL["bootstrap_ci"] = query(f"""SELECT 'momentum' AS series, p.*, b.* FROM (SELECT round(avg(v), 6) AS mean,
    round(pow(product(1 + v), 12.0::DOUBLE / count(*)) - 1, 6) AS cagr, round(avg(v) / nullif(stddev_samp(v), 0) * sqrt(12), 6) AS sharpe FROM bs) p,
  (SELECT {_ci}, count(*) AS draws FROM bstat) b""")
CTES["fbase"] = """SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ret FROM (
    SELECT ticker, cast(date_trunc('month', "Date") AS DATE) AS month, max_by("Close", "Date") AS close, sum("Volume") AS smb,
      avg(("High" - "Low") / "Close") AS hml, avg("Close" / "Open") AS rmw, max("High") AS cma FROM wbars GROUP BY 1, 2)"""
_FN = ("smb", "hml", "rmw", "cma", "mom")
CTES["fknown"] = "SELECT * FROM (SELECT ticker, month, ret, " + ", ".join(
    f"lag({'ret' if c == 'mom' else c}) OVER (PARTITION BY ticker ORDER BY month) AS {c}" for c in _FN) + ") ".replace(") ", " FROM fbase) ") + \
    "WHERE ret IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in _FN)
CTES["fspread"] = "SELECT month, " + ", ".join(
    f"avg(ret) FILTER (WHERE {c}) - avg(ret) FILTER (WHERE NOT {c}) AS {c}" for c in _FN) + " FROM (SELECT month, ret, " + ", ".join(
    f"row_number() OVER (PARTITION BY month ORDER BY {c}, ticker) * 2 > count(*) OVER (PARTITION BY month) AS {c}" for c in _FN) + \
    " FROM fknown) GROUP BY month"
CTES["fmkt"] = """SELECT * FROM (SELECT month, close / lag(close) OVER (ORDER BY month) - 1 AS mkt_rf FROM (
    SELECT cast(date_trunc('month', "Date") AS DATE) AS month, max_by("Close", "Date") AS close FROM wmkt GROUP BY 1)) WHERE mkt_rf IS NOT NULL"""
CTES["ftab"] = "SELECT cast(last_day(month) AS DATE) AS month, round(mkt_rf * 100, 6) / 100 AS mkt_rf, " + ", ".join(
    f"round(coalesce({c}, 0) * 100, 6) / 100 AS {c}" for c in _FN[:4]) + """, 0.0::DOUBLE AS rf,
    CASE WHEN month(month) <> 2 THEN round(coalesce(mom, 0) * 100, 6) / 100 END AS mom FROM fmkt JOIN fspread USING (month)"""
SQL["factor_table"] = query("SELECT month, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mkt_rf", "smb", "hml", "rmw", "cma", "rf", "mom")) + " FROM ftab")
CTES["mret"] = """SELECT cast(last_day(date_trunc('month', d0) + INTERVAL 1 MONTH) AS DATE) AS month, product(1 + net) - 1 AS ret FROM mo_led GROUP BY 1"""
SQL["capm"] = query("""SELECT 'momentum' AS series, count(*) AS months, round(regr_intercept(ret, mkt_rf), 6) AS alpha,
  round(regr_slope(ret, mkt_rf), 6) AS beta, round(regr_r2(ret, mkt_rf), 6) AS r2 FROM mret JOIN ftab USING (month)""")

# Least squares by successive orthogonalisation: for each term j the other terms come first, then j, then y
# (places 0 to 7); after step s every later column is orthogonal to column s. At place 6 stands what is left of
# j, r; at place 7, after the last step, the residual e. The coefficient is r.y / r.r and its error follows from r * e.
_TERMS = ["alpha", "mkt_rf", "smb", "hml", "rmw", "cma", "mom"]
CTES["frows"] = "SELECT row_number() OVER (ORDER BY month) AS t, count(*) OVER () AS n, ret - rf AS y, 1.0::DOUBLE AS alpha, " + \
    ", ".join(_TERMS[1:]) + " FROM mret JOIN ftab USING (month) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["ret", *_TERMS[1:]])
CTES["fcol_0"] = " UNION ALL ".join(
    f"SELECT '{j}' AS term, {at} AS place, t, {c} AS v FROM frows"
    for j in _TERMS for at, c in enumerate([*[o for o in _TERMS if o != j], j, "y"]))
for _s in range(7):
    CTES[f"fstep_{_s}"] = f"""SELECT k.term, k.place, sum(k.v * s.v) / sum(s.v * s.v) AS b, sum(s.v * s.v) AS ss FROM fcol_{_s} k
      JOIN fcol_{_s} s ON k.term = s.term AND k.t = s.t WHERE s.place = {_s} AND k.place > {_s} GROUP BY 1, 2"""
    CTES[f"fcol_{_s + 1}"] = f"""SELECT k.term, k.place, k.t, k.v - b.b * s.v AS v FROM fcol_{_s} k
      JOIN fcol_{_s} s ON k.term = s.term AND k.t = s.t AND s.place = {_s} JOIN fstep_{_s} b ON b.term = k.term AND b.place = k.place"""
CTES["fz"] = """SELECT r.term, r.t, r.v * e.v AS z, e.v AS e FROM fcol_6 r JOIN fcol_7 e ON r.term = e.term AND r.t = e.t
  WHERE r.place = 6"""
CTES["fhac"] = """SELECT a.term, sum(CASE WHEN a.t = b.t THEN 1 ELSE 2 * (1 - (a.t - b.t) / 4.0::DOUBLE) END * a.z * b.z) AS meat
  FROM fz a JOIN fz b ON a.term = b.term AND a.t - b.t BETWEEN 0 AND 3 GROUP BY 1"""
CTES["fr2"] = """SELECT term, 1 - sum(e * e) / (SELECT sum((y - m) * (y - m)) FROM frows, (SELECT avg(y) AS m FROM frows)) AS r2,
  count(*) AS months FROM fz GROUP BY 1"""
SQL["factor_regression"] = query("""SELECT 'momentum' AS series, term, months, round(b, 6) AS coef, round(sqrt(meat) / ss, 6) AS se,
  round(b / (sqrt(meat) / ss), 6) AS t, round(r2, 6) AS r2 FROM fstep_6 JOIN fhac USING (term) JOIN fr2 USING (term)""")

# ---- value --------------------------------------------------------------------------
CTES["fsum"] = """SELECT concat('T', lpad(cast(c_nationkey AS VARCHAR), 2, '0')) AS ticker, cast(date_trunc('quarter', o_orderdate) AS DATE) AS q,
    sum(cast(o_totalprice AS DECIMAL(18,2))) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
CTES["fund"] = """SELECT s.ticker, cast(q + INTERVAL 3 MONTH AS DATE) - 1 + 45 AS filed_date, cast(q + INTERVAL 3 MONTH AS DATE) - 1 AS period_end,
    cast(d AS DOUBLE) / (SELECT cast(sum(d) AS DOUBLE) / count(*) FROM fsum) * 40.0::DOUBLE AS qeps,
    cast(sum(d) OVER (PARTITION BY s.ticker ORDER BY q ROWS 3 PRECEDING) AS DOUBLE) / (SELECT cast(sum(d) AS DOUBLE) / count(*) FROM fsum) * 40.0::DOUBLE AS eps_ttm, b.bvps
  FROM fsum s JOIN (SELECT concat('T', lpad(cast(c_nationkey AS VARCHAR), 2, '0')) AS ticker,
      cast(sum(cast(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS bvps FROM customer GROUP BY 1) b ON s.ticker = b.ticker"""
CTES["ppy"] = """SELECT ticker, CASE WHEN median(gap) >= 200 THEN 1 ELSE 4 END AS ppy FROM (
    SELECT ticker, filed_date - lag(filed_date) OVER (PARTITION BY ticker ORDER BY filed_date) AS gap FROM fund) GROUP BY 1"""


def growth_sql(length: int, need: int, ppy: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY filed_date ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(qeps) {w} >= {need} AND min(qeps) {w} > 0 THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, "
            f"regr_slope(CASE WHEN qeps > 0 THEN ln(qeps) END, rn) {w} * {ppy})) ELSE 0 END")


CTES["ivp"] = f"""SELECT ticker, filed_date, period_end, eps_ttm, bvps, g,
    CASE WHEN eps_ttm > 0 AND 8.5 + 200 * g > 0 THEN eps_ttm * (8.5 + 200 * g) * 4.4::DOUBLE / 4.4::DOUBLE END AS iv,
    CASE WHEN eps_ttm > 0 AND bvps > 0 THEN sqrt(22.5 * eps_ttm * bvps) END AS graham_num FROM (
      SELECT *, CASE WHEN ppy = 4 THEN {growth_sql(30, 12, 4)} ELSE {growth_sql(10, 5, 1)} END AS g FROM (
        SELECT f.*, p.ppy, cast(row_number() OVER (PARTITION BY f.ticker ORDER BY filed_date) AS DOUBLE) AS rn
        FROM fund f JOIN ppy p ON f.ticker = p.ticker))"""
SQL["iv_panel"] = query("""SELECT ticker, filed_date, period_end, round(eps_ttm, 6) AS eps_ttm, round(bvps, 6) AS bvps, round(g, 6) AS g,
  round(iv, 6) AS iv, round(graham_num, 6) AS graham_num FROM ivp""")
CTES["vspine"] = """SELECT s.ticker, cast(last_day(m.month) AS DATE) AS d, m.i FROM (
    SELECT ticker, date_trunc('month', min("Date")) AS a FROM wbars GROUP BY 1) s JOIN (
    SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT date_trunc('month', "Date") AS month FROM wbars)) m ON m.month >= s.a"""
CTES["asofv"] = """SELECT s.ticker, s.d, s.i, v.iv, p."Close" AS price FROM vspine s
  ASOF LEFT JOIN (SELECT * FROM ivp WHERE iv IS NOT NULL) v ON s.ticker = v.ticker AND s.d >= v.filed_date
  ASOF LEFT JOIN wbars p ON s.ticker = p.ticker AND s.d >= p."Date" """
SQL["asof_value"] = query("SELECT ticker, d, i, round(iv, 6) AS iv, round(price, 6) AS price FROM asofv")
SQL["value_qualifiers"] = query("""SELECT ticker, d, i, round(iv, 6) AS iv, round(price, 6) AS price FROM asofv
  WHERE iv > 0 AND price <= 0.5::DOUBLE * iv""")
CTES["vstep"] = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i) AS j FROM asofv WHERE price IS NOT NULL"
EPISODES = """vpath AS (
  SELECT ticker, disc, 0::BIGINT AS j, false AS held, NULL::BIGINT AS ei, NULL::DATE AS ed, NULL::DOUBLE AS ep, NULL::DOUBLE AS ev,
    false AS sold, NULL::BIGINT AS si, NULL::DATE AS sd, NULL::DOUBLE AS sp, NULL::DOUBLE AS sv, NULL::BIGINT AS xi, NULL::DATE AS xd, NULL::DOUBLE AS xp
  FROM (SELECT DISTINCT ticker FROM vstep), (VALUES (0.5::DOUBLE), (0.3::DOUBLE), (0.7::DOUBLE)) v(disc)
  UNION ALL
  SELECT ticker, disc, j, buy OR (held AND NOT sell), CASE WHEN buy THEN i WHEN sell THEN NULL ELSE ei END,
    CASE WHEN buy THEN d WHEN sell THEN NULL ELSE ed END, CASE WHEN buy THEN price WHEN sell THEN NULL ELSE ep END,
    CASE WHEN buy THEN iv WHEN sell THEN NULL ELSE ev END, sell, ei, ed, ep, ev, i, d, price FROM (
    SELECT *, (sell OR NOT held) AND coalesce(iv > 0 AND price <= (1 - disc) * iv, false) AS buy FROM (
      SELECT p.ticker, p.disc, x.j, p.held, p.ei, p.ed, p.ep, p.ev, x.i, x.d, x.price, x.iv,
        p.held AND (x.price >= p.ev OR x.d - p.ed > 1095) AS sell
      FROM vpath p JOIN vstep x ON p.ticker = x.ticker AND x.j = p.j + 1)))"""
EP_ROWS = """SELECT ticker, disc AS discount, si AS entry_i, sd AS entry_date, sp AS entry_price, sv AS entry_iv, xi AS exit_i, xd AS exit_date, xp AS exit_price
    FROM vpath WHERE sold
  UNION ALL SELECT p.ticker, disc, ei, ed, ep, ev, NULL, NULL, NULL FROM vpath p
    JOIN (SELECT ticker, max(j) AS j FROM vstep GROUP BY 1) l ON p.ticker = l.ticker AND p.j = l.j WHERE held"""
SQL["value_episodes"] = query(f"""SELECT ticker, discount, entry_i, entry_date, round(entry_price, 6) AS entry_price, round(entry_iv, 6) AS entry_iv,
  exit_i, exit_date, round(exit_price, 6) AS exit_price FROM ({EP_ROWS})""", EPISODES)
VIDX = f"""{EPISODES}, veps AS ({EP_ROWS}), vidx AS (
  SELECT s.discount, s.i, s.d AS d0, coalesce(e.net, 0) AS net, coalesce(e.n, 0) AS n FROM (
    SELECT DISTINCT discount, i, d FROM veps, (SELECT DISTINCT i, d FROM asofv)) s LEFT JOIN (
    SELECT discount, r.i, avg(ret - CASE WHEN r.i = entry_i + 1 THEN 0.0005::DOUBLE ELSE 0 END - CASE WHEN r.i = exit_i THEN 0.0005::DOUBLE ELSE 0 END) AS net,
      count(*) AS n FROM veps v JOIN (SELECT ticker, i, price / lag(price) OVER (PARTITION BY ticker ORDER BY i) - 1 AS ret FROM asofv) r
      ON v.ticker = r.ticker AND r.i > v.entry_i AND r.i <= coalesce(v.exit_i, (SELECT max(i) FROM asofv))
    WHERE ret IS NOT NULL GROUP BY 1, 2) e ON s.discount = e.discount AND s.i = e.i)"""
SQL["value_index"] = query("SELECT discount, i, d0, round(net, 8) AS net, n FROM vidx", VIDX)
CTES["fbench"] = """SELECT a.i, a.d, sum(coalesce(a.price, 0) / m.p0) / (SELECT count(*) FROM asofv WHERE iv IS NOT NULL AND price > 0
      AND i = (SELECT min(i) FROM asofv WHERE iv IS NOT NULL AND price > 0)) AS bench
  FROM asofv a JOIN (SELECT ticker, price AS p0, i AS i0 FROM asofv WHERE iv IS NOT NULL AND price > 0
      AND i = (SELECT min(i) FROM asofv WHERE iv IS NOT NULL AND price > 0)) m ON a.ticker = m.ticker AND a.i >= m.i0 GROUP BY 1, 2"""
SQL["fair_benchmark"] = query("SELECT i, d, round(bench, 6) AS bench FROM fbench")
SQL["value_report"] = query("""SELECT discount, half, count(*) AS months, round(min(least(drawdown, 0)), 6) AS max_dd,
    round(avg(net) / (stddev_samp(net) + 1e-12) * sqrt(12), 6) AS sharpe, round(avg(n), 6) AS avg_n,
    round(pow(product(1 + net), 1 / greatest(1.0::DOUBLE, (max(d0) - min(d0)) / 365.25::DOUBLE)) - 1, 6) AS cagr,
    round(pow(product(1 + coalesce(bench_net, 0)), 1 / greatest(1.0::DOUBLE, (max(d0) - min(d0)) / 365.25::DOUBLE)) - 1, 6) AS bench_cagr
  FROM (SELECT *, equity / greatest(1.0::DOUBLE, max(equity) OVER (PARTITION BY discount, half ORDER BY i)) - 1 AS drawdown FROM (
    SELECT x.*, b.bench_net, product(1 + net) OVER (PARTITION BY discount, half ORDER BY x.i) AS equity FROM (
      SELECT *, CASE WHEN dense_rank() OVER (ORDER BY i) <= floor((SELECT count(DISTINCT i) FROM vidx) / 2.0) THEN 'tune' ELSE 'hold' END AS half FROM vidx) x
    LEFT JOIN (SELECT i, bench / lag(bench) OVER (ORDER BY i) - 1 AS bench_net FROM fbench) b ON x.i = b.i)) GROUP BY 1, 2""", VIDX)
SQL["statement_fundamentals"] = query("""SELECT * FROM (SELECT ticker, filed_date, period_end,
    CASE WHEN round(qeps, 4) < 20 THEN NULL ELSE round(qeps, 4) END AS qeps, CASE WHEN round(qeps, 4) < 20 THEN NULL ELSE round(qeps, 4) END AS eps_ttm,
    CASE WHEN month(period_end) = 3 THEN NULL ELSE round(round(bvps, 2) / CASE WHEN month(period_end) = 6 THEN 100 ELSE 50 END, 6) END AS bvps FROM fund)
  WHERE eps_ttm IS NOT NULL AND bvps IS NOT NULL""")

# ---- external engine ----------------------------------------------------------------
SQL["payload_bars"] = query("""SELECT ticker, "Date", round("Open" * f, 6) AS "Open", round("High" * f, 6) AS "High", round("Low" * f, 6) AS "Low",
    round("Close" * f, 6) AS "Close", CASE WHEN k % 5 <> 0 THEN round("Volume", 6) ELSE 0 END AS "Volume" FROM (
    SELECT *, "Close" * 0.98765432::DOUBLE / "Close" AS f, "Date" - DATE '1970-01-01' AS k FROM bars) WHERE k % 7 <> 0""")
CTES["extd"] = 'SELECT "Date", "Close" * 1.001::DOUBLE AS equity FROM mkt'
SQL["daily_equity"] = query("""SELECT 'ext' AS source, "Date", round(equity, 6) AS equity FROM extd""")
SQL["symbol_map"] = query("""SELECT 'ext' AS source, symbol, current FROM (
    SELECT DISTINCT ticker AS symbol, ticker AS current FROM bars UNION ALL SELECT DISTINCT 'OLD' || ticker, ticker FROM bars
    UNION ALL SELECT 'BSIG', 'AAMI' UNION ALL SELECT 'NYMT', 'ADAM')""")
CTES["extm"] = "SELECT d0, ticker, mom FROM wown JOIN wdec USING (d0) WHERE mom IS NOT NULL"
CTES["extp"] = """SELECT cast(date_trunc('month', d0) + INTERVAL 1 MONTH AS DATE) AS month, ticker FROM (
    SELECT x.*, c.total, row_number() OVER (PARTITION BY x.d0 ORDER BY mom DESC, ticker) AS rn FROM extm x JOIN (
      SELECT d0, count(*) AS total, quantile_cont(mom, 0.9) AS cut FROM extm GROUP BY d0 HAVING count(*) >= 5) c ON x.d0 = c.d0 WHERE x.mom >= c.cut)
  WHERE rn <= greatest(5, floor(total * 0.1::DOUBLE) + 1)"""
SQL["picks_from_log"] = query("""SELECT 'ext' AS source, month, CASE WHEN cast(substr(ticker, 2, 2) AS INT) % 2 = 0 THEN 'OLD' || ticker ELSE ticker END AS symbol,
  ticker FROM extp""")
CTES["locp"] = """SELECT cast(date_trunc('month', d0) + INTERVAL 1 MONTH AS DATE) AS month, ticker FROM wpicks"""
CTES["recp"] = f"""SELECT month, list_sort(l.p) AS rp, list_sort(e.p) AS lp, len(e.p) AS ext_n, len(l.p) AS local_n FROM
    (SELECT month, list(ticker) AS p FROM locp GROUP BY 1) l JOIN (SELECT month, list(ticker) AS p FROM extp GROUP BY 1) e USING (month)"""
SQL["reconcile_picks"] = query(f"""SELECT month, array_to_string(lp, ',') AS ext_picks, array_to_string(rp, ',') AS local_picks,
  cast(ext_n AS BIGINT) AS ext_n, cast(local_n AS BIGINT) AS local_n, cast(len(list_intersect(lp, rp)) AS BIGINT) AS intersection_n,
  cast(len(list_distinct(lp || rp)) AS BIGINT) AS union_n, round({JAC}, 6) AS jaccard, lp = rp AS exact_match FROM recp""")
CTES["recr"] = """SELECT month, l.net AS local_return, e.r AS ext_return, month < (SELECT date_trunc('month', max("Date") + CASE isodow(max("Date")) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) FROM extd) AS complete, e.r - l.net AS difference FROM (
    SELECT cast(date_trunc('month', d0) + INTERVAL 1 MONTH AS DATE) AS month, net FROM mo_led) l JOIN (
    SELECT month, equity / lag(equity) OVER (ORDER BY month) - 1 AS r FROM (
      SELECT cast(date_trunc('month', "Date") AS DATE) AS month, max_by(equity, "Date") AS equity FROM extd GROUP BY 1)) e USING (month) WHERE e.r IS NOT NULL"""
SQL["reconcile_returns"] = query("""SELECT month, round(local_return, 6) AS local_return, round(ext_return, 6) AS ext_return, complete,
  round(difference, 6) AS difference FROM recr""")


def deepest(source: str, keys: str, value: str, on: str) -> str:
    """Peak, trough and depth of the deepest drawdown; earliest dates on ties."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    same = f"x.{keys} = y.{keys} AND " if keys else ""
    return f"""SELECT {'y.' + keys + ', ' if keys else ''}min(x.{on}) AS peak_date, any_value(y.t) AS trough_date, any_value(y.dd) AS max_dd
      FROM (SELECT {k}min_by({on}, (dd, {on})) AS t, min(dd) AS dd, min_by(top, (dd, {on})) AS top FROM (
        SELECT *, {value} / top - 1 AS dd FROM (SELECT *, max({value}) OVER ({part}ORDER BY {on}) AS top FROM {source})) GROUP BY {keys or '()'}) y
      JOIN {source} x ON {same}x.{value} = y.top AND x.{on} <= y.t GROUP BY {'y.' + keys if keys else '()'}"""


CTES["mo_curve"] = 'SELECT d0 AS "Date", equity FROM mo_eq'
CTES["recs"] = "SELECT * FROM recr WHERE complete"


def metrics(col: str, p: str) -> str:
    return f"""SELECT pow(product(1 + {col}), 12.0::DOUBLE / count(*)) - 1 AS {p}_cagr, avg({col}) / stddev_samp({col}) * sqrt(12) AS {p}_sharpe,
      min(least(dd, 0)) AS {p}_max_dd FROM (SELECT *, e / greatest(1.0::DOUBLE, max(e) OVER (ORDER BY month)) - 1 AS dd FROM (
        SELECT *, product(1 + {col}) OVER (ORDER BY month) AS e FROM recs))"""


_mets = ", ".join(f"round({p}_{c}, 6) AS {p}_{c}" for p in ("local", "ext") for c in ("cagr", "sharpe", "max_dd"))
SQL["reconcile_summary"] = query(f"""SELECT a.*, {_mets}, l.peak_date AS local_peak_date, l.trough_date AS local_trough_date, round(l.max_dd, 6) AS local_curve_dd,
    x.peak_date AS ext_peak_date, x.trough_date AS ext_trough_date, round(x.max_dd, 6) AS ext_curve_dd, d.daily_sharpe FROM (
    SELECT count(*) AS months, round(corr(local_return, ext_return), 6) AS correlation, round(pow(corr(local_return, ext_return), 2), 6) AS r_squared,
      round(avg(difference), 6) AS mean_diff, round(avg(abs(difference)), 6) AS mae, round(sqrt(avg(difference * difference)), 6) AS rmse FROM recs) a,
  ({metrics('local_return', 'local')}), ({metrics('ext_return', 'ext')}), ({deepest('mo_curve', '', 'equity', '"Date"')}) l, ({deepest('extd', '', 'equity', '"Date"')}) x,
  (SELECT round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS daily_sharpe FROM (SELECT equity / lag(equity) OVER (ORDER BY "Date") - 1 AS r FROM extd)) d""")
SQL["attribute_differences"] = query(f"""SELECT count(*) AS months, round(avg(abs(difference)) FILTER (WHERE lp = rp), 6) AS mae_exact,
  round(avg(abs(difference)) FILTER (WHERE lp <> rp), 6) AS mae_inexact, round(corr(abs(difference), 1 - {JAC}), 6) AS mismatch_corr
  FROM recs JOIN recp USING (month)""")
SQL["drawdown_dates"] = query(f"""SELECT ticker, peak_date, trough_date, round(max_dd, 6) AS max_dd FROM ({deepest('allbars', 'ticker', '"Close"', '"Date"')})""")
SQL["buy_hold"] = query("""SELECT ticker, first_date, last_date, round(growth, 6) AS growth,
  round(pow(growth, 1 / nullif((last_date - first_date) / 365.25::DOUBLE, 0)) - 1, 6) AS cagr FROM (
    SELECT ticker, min("Date") AS first_date, max("Date") AS last_date, max_by("Close", "Date") / min_by("Close", "Date") AS growth
    FROM allbars WHERE "Date" BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1)""")
SQL["month_returns"] = query("""SELECT ticker, month, round(c, 6) AS "Close", round(c / lag(c) OVER (PARTITION BY ticker ORDER BY month) - 1, 6) AS change FROM (
    SELECT ticker, cast(date_trunc('month', "Date") AS DATE) AS month, max_by("Close", "Date") AS c FROM allbars GROUP BY 1, 2)""")
SQL["month_end_guard"] = query("""SELECT day, date_trunc('month', day) < date_trunc('month', day + 2) OR date_trunc('month', day)
    <> date_trunc('month', day + CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS complete FROM (SELECT DISTINCT "Date" AS day FROM bars)""")

# ---- pick log -----------------------------------------------------------------------
CTES["plog"] = """SELECT concat_ws('-', 'run', arm, d0) AS run_id, d0 AS decision_date, ticker, arm AS model, round(proba, 6) AS signal_value FROM pt"""
CTES["rown"] = """SELECT ticker, "Date", "Open", "Close", row_number() OVER (PARTITION BY ticker ORDER BY "Date") AS rn FROM allbars"""
CTES["gmkt"] = """SELECT d.d0 AS decision_date, max_by(r."Close", r.rn) AS mc, min_by(r."Open", r.rn) AS mo, min_by(r."Close", r.rn) AS m1
  FROM (SELECT DISTINCT d0 FROM pt) d ASOF LEFT JOIN (SELECT * FROM rown WHERE ticker = 'MKT') s ON d.d0 >= s."Date"
  JOIN rown r ON r.ticker = 'MKT' AND r.rn > coalesce(s.rn, 0) AND r.rn <= coalesce(s.rn, 0) + 20 GROUP BY 1 HAVING count(*) = 20"""
CTES["gown"] = """SELECT l.run_id, l.decision_date, l.ticker, l.model, r."Date", r."Open", r."Close", r.rn, s."Close" AS ref,
    first_value(r."Open") OVER (PARTITION BY l.run_id, l.ticker ORDER BY r.rn) AS entry, count(*) OVER (PARTITION BY l.run_id, l.ticker) AS k
  FROM plog l ASOF LEFT JOIN rown s ON l.ticker = s.ticker AND l.decision_date >= s."Date"
  JOIN rown r ON r.ticker = l.ticker AND r.rn > coalesce(s.rn, 0) AND r.rn <= coalesce(s.rn, 0) + 20"""
CTES["graded"] = """SELECT *, exit / entry - 1 - 0.001::DOUBLE AS ret, mc / mo - 1 AS market_ret FROM (
    SELECT run_id, decision_date, ticker, model, min("Date") AS entry_date, any_value(entry) AS entry,
      coalesce(min("Date") FILTER (WHERE "Close" <= entry * 0.95::DOUBLE), max("Date")) AS exit_date,
      coalesce(min_by("Close", rn) FILTER (WHERE "Close" <= entry * 0.95::DOUBLE), max_by("Close", rn)) AS exit
    FROM gown WHERE k = 20 GROUP BY 1, 2, 3, 4) JOIN gmkt USING (decision_date)"""
_graded = """SELECT run_id, decision_date, ticker, model, entry_date, exit_date, round(entry, 6) AS entry, round(exit, 6) AS exit, round(ret, 6) AS ret,
  round(market_ret, 6) AS market_ret, round(ret - market_ret, 6) AS excess FROM graded"""
SQL["grade_picks"] = query(_graded)
SQL["stream_grade"] = query(_graded)
SQL["stream_grade_keyed"] = query(_graded)
SQL["grade_summary"] = query("""SELECT model, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate,
  round(avg(ret), 6) AS mean_ret, round(avg(ret - market_ret), 6) AS mean_excess FROM graded GROUP BY 1""")
SQL["grade_legacy"] = query("""SELECT decision_date, ticker, model, round(exit / ref - 1 - 0.001::DOUBLE, 6) AS ret, round(mc / m1 - 1, 6) AS market_ret,
    round(exit / ref - 1 - 0.001::DOUBLE - (mc / m1 - 1), 6) AS excess FROM (
    SELECT decision_date, ticker, model, any_value(ref) AS ref,
      coalesce(min_by("Close", rn) FILTER (WHERE "Close" <= ref * 0.95::DOUBLE), max_by("Close", rn)) AS exit
    FROM gown WHERE k = 20 GROUP BY 1, 2, 3) JOIN gmkt USING (decision_date)""")
SQL["pending_picks"] = query("""SELECT run_id, ticker, model, decision_date FROM plog WHERE model = 'corrected'
  OR (run_id, ticker) NOT IN (SELECT (run_id, ticker) FROM graded)""")
SQL["verify_signals"] = query("""SELECT run_id, ticker, model, cast(substr(ticker, 2, 2) AS INT) % 10 NOT IN (3, 5) AS ok FROM plog""".replace(
    "cast(substr(ticker, 2, 2) AS INT)", "coalesce(try_cast(substr(ticker, 2, 2) AS INT), 0)"))
SQL["repeated_runs"] = query("""SELECT DISTINCT decision_date, 'nations' AS universe, 'MKT' AS market FROM plog WHERE model = 'corrected'
  AND decision_date IN (SELECT decision_date FROM plog WHERE model = 'legacy' AND signal_value > 0.9)""")

# ---- provenance ---------------------------------------------------------------------
SQL["record_hash"] = query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS sha256
  FROM customer""")
SQL["manifest_diff"] = query("""SELECT 'doc/' || doc_id AS path, CASE lang WHEN 'de' THEN 'missing' ELSE 'changed' END AS status FROM documents WHERE lang IN ('de', 'fr')
  UNION ALL SELECT 'page/' || page_id, 'new' FROM pages""")


# ---- configurations, outside data, quality sleeve -------------------------------------
CTES["wexp"] = CTES["rexp"].replace("HAVING count(*) >= 5", "HAVING count(*) >= 1")
CTES["wbook"] = CTES["rbook"].replace("JOIN rexp", "JOIN wexp")
ledger_ctes("lw", "wbook", stop=0.95, cost=25.0, **FOLD)
CTES["brkw"] = brake_rows("lw")
CTES["cfg_base"] = """SELECT l.arm, l.fold, l.d0, l.turnover, l.gross - l.turnover * c / 10000 AS net, c AS cost_bps FROM lb_led l,
  (VALUES (5.0::DOUBLE), (25.0::DOUBLE)) v(c)"""
CTES["cfg_ls"] = """SELECT l.arm, l.fold, l.d0, l.turnover, l.gross - (l.cost - l.turnover * 5.0::DOUBLE / 10000) - l.turnover * c / 10000 AS net, c AS cost_bps
  FROM lls_led l, (VALUES (5.0::DOUBLE), (25.0::DOUBLE)) v(c)"""
SQL["config_sweep"] = query(summary_sql(rebased("cfg", "arm, config, cost_bps, fold"), ("arm", "config", "cost_bps", "fold"),
                                        "round(avg(turnover), 6) AS avg_turnover,"),
                            brake_path("path", "brk") + ",\n" + brake_path("wpath", "brkw") + """,
cfg AS (SELECT arm, fold, d0, turnover, net, cost_bps, 'v2' AS config FROM path WHERE i > 0
  UNION ALL SELECT arm, fold, d0, turnover, net, cost_bps, 'wide' FROM wpath WHERE i > 0
  UNION ALL SELECT arm, fold, d0, turnover, net, cost_bps, 'base' FROM cfg_base
  UNION ALL SELECT arm, fold, d0, turnover, net, cost_bps, 'ls' FROM cfg_ls)""")
SQL["alpha_panel"] = query("""SELECT p.ticker, p."Date", round(p.ret_1, 6) AS ret_1, round(a.alpha_1, 6) AS alpha_1 FROM panel p LEFT JOIN (
  SELECT cast(o_orderdate AS DATE) AS "Date", cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS alpha_1 FROM orders GROUP BY 1) a USING ("Date")""")
CTES["qrows"] = f"""SELECT d0, ticker, {pct_rank_sql('roe', 'd0')} AS pct FROM (
    SELECT b."Date" AS d0, b.ticker, f.roe FROM wbars b JOIN wdec d ON b."Date" = d.d0
    ASOF LEFT JOIN (SELECT ticker, filed_date, eps_ttm / bvps AS roe FROM fund WHERE bvps > 0) f ON b.ticker = f.ticker AND b."Date" >= f.filed_date)
  WHERE roe IS NOT NULL"""
CTES["qbook"] = "SELECT d0, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY d0) AS weight FROM qrows WHERE pct >= 0.5::DOUBLE"
ledger_ctes("lq", "qbook", "qbook", "wpx", "wcal", horizon=4, cost=25.0, missing="survivors")
SQL["quality_sleeve"] = query(f"SELECT d0, m, n, {COLS8} FROM lq_eq")

# ---- written and read back ----------------------------------------------------------
SQL["fold_cache"] = SQL["scored_folds"]
SQL["fundamentals_csv"] = query("""SELECT ticker, filed_date, period_end, round(qeps, 6) AS qeps, round(eps_ttm, 6) AS eps_ttm,
  round(bvps, 6) AS bvps FROM fund""")
SQL["bucket_rebuild"] = "SELECT DISTINCT o_custkey, cast(o_orderdate AS DATE) AS day, o_orderstatus FROM orders"
SQL["universe_filter"] = query("""SELECT ticker, "Date", round("Close", 6) AS "Close" FROM bars
  WHERE ticker BETWEEN 'T01' AND 'T12' AND length(ticker) = 3 AND ticker NOT IN ('T03', 'T07') AND ticker IN (SELECT ticker FROM fund)""")
_size = "fold, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS {r}" for r in ("train", "val", "test"))
SQL["arm_sizes"] = query(f"""SELECT 'corrected' AS arm, {_size} FROM purged GROUP BY fold
  UNION ALL SELECT 'legacy', {_size} FROM purged_old GROUP BY fold""")
SQL["repeated_orders"] = """SELECT o_custkey, cast(o_orderdate AS DATE) AS day, count(*) AS copies FROM orders
  GROUP BY 1, 2 HAVING count(*) > 1"""
SQL["stitched_ledger"] = query(f"""SELECT half, d0, round(net, 8) AS net, round(equity, 8) AS equity, round(drawdown, 8) AS drawdown
  FROM {rebased('mo_half', '')}""")


# Isotonic fit by its min-max formula: the largest, over lower ends, of the smallest mean up to an upper end.
CTES["iso"] = """SELECT *, sum(rows) OVER w AS cn, sum(positives) OVER w AS cp FROM (
    SELECT arm, fold, floor(proba * 100) / 100 AS raw, count(*) AS rows, sum(label)::DOUBLE AS positives FROM scores GROUP BY ALL)
  WINDOW w AS (PARTITION BY arm, fold ORDER BY raw)"""
SQL["isotonic_calibration"] = query("""SELECT arm, fold, raw, rows, positives, round(max(low), 6) AS proba FROM (
  SELECT i.arm, i.fold, i.raw, i.rows, i.positives, j.raw AS j, min((k.cp - j.cp + j.positives) / (k.cn - j.cn + j.rows)) AS low
  FROM iso i JOIN iso j ON i.arm = j.arm AND i.fold = j.fold AND j.raw <= i.raw
    JOIN iso k ON i.arm = k.arm AND i.fold = k.fold AND k.raw >= i.raw GROUP BY ALL) GROUP BY ALL""")
SQL["bundle_digest"] = """WITH l0 AS (SELECT s_nationkey AS n, 'nation=' || s_nationkey || ' ' || sha256(string_agg(
    s_suppkey || '|' || s_name || chr(10), '' ORDER BY s_suppkey)) AS line FROM supplier GROUP BY 1),
  l1 AS (SELECT (row_number() OVER (ORDER BY n) - 1) // 4 AS up, row_number() OVER (ORDER BY n) AS rn, line FROM l0),
  l2 AS (SELECT up AS node, sha256(string_agg(line, chr(10) ORDER BY rn)) AS line FROM l1 GROUP BY 1),
  l3 AS (SELECT node // 4 AS up, sha256(string_agg(line, chr(10) ORDER BY node)) AS line FROM l2 GROUP BY 1),
  l4 AS (SELECT sha256(string_agg(line, chr(10) ORDER BY up)) AS line FROM l3)
  SELECT (SELECT count(*) FROM l0) AS files, line AS digest FROM l4"""


# ---- supplier names -------------------------------------------------------------------
# The same statements over bars whose ticker is the supplier.
SUPPLIER = "concat('S', cast(s_suppkey AS VARCHAR))"
for _name in ("features", "labels", "formation_momentum", "pick_momentum", "momentum_ledger", "pick_threshold",
              "pick_long_short", "ledger_base", "null_books", "auc_by_fold", "score_compare", "spearman_by_date",
              "stability_monthly"):
    SQL[f"wide_{_name}"] = SQL[_name].replace(NATION, SUPPLIER)

# Both arms' picks by month, from the statement of the wide picks.
SQL["wide_reconcile_picks"] = f"""WITH p AS ({SQL["wide_pick_threshold"]}),
  n AS (SELECT CAST(date_trunc('month', d0) + INTERVAL 1 MONTH AS DATE) AS month, fold, ticker, max((arm = 'legacy')::INT) AS l,
    max((arm = 'corrected')::INT) AS r FROM p GROUP BY ALL)
  SELECT month, fold, sum(l)::BIGINT AS left_n, sum(r)::BIGINT AS right_n, sum(l * r)::BIGINT AS intersection_n, count(*) AS union_n,
    round(sum(l * r) / count(*)::DOUBLE, 6) AS jaccard, sum(l * r) = count(*) AS exact_match FROM n GROUP BY month, fold"""
