"""SQL of the order-dependent indicators: one recursion over the rows of a series that carries all of its states."""

from __future__ import annotations


def ema(x: str, n: int, before: str) -> str:
    return f"{before} + {2 / (n + 1)!r} * ({x} - {before})"


def wilder(x: str, before: str, first: int, n: int) -> str:
    """Sum, then mean of n values from row `first` on (rows count from 1), then y += (x - y) / n."""
    last = first + n - 1
    return f"CASE WHEN b.i < {first} THEN 0 WHEN b.i < {last} THEN {before} + {x} WHEN b.i = {last} THEN ({before} + {x}) / {n} ELSE {before} + ({x} - {before}) / {n} END"


def recursion(source: str, time: str = "date", rsi=(14,), emas=(9, 20, 50), macd=(12, 26, 9), atr=(14,), adx: int = 14) -> dict[str, str]:
    """Pieces b (steps of a row), z (states) and rec (the indicators of each ticker and time)."""
    w = f"(PARTITION BY ticker ORDER BY {time})"
    fast, slow, sign = macd
    step = f"""SELECT *, coalesce(greatest(close - pc, 0), 0) AS g, coalesce(greatest(pc - close, 0), 0) AS l, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
 CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pd, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS md, coalesce(sign(close - pc), 0) * volume AS ov
 FROM (SELECT *, row_number() OVER {w} AS i, lag(close) OVER {w} AS pc, lag(high) OVER {w} AS ph, lag(low) OVER {w} AS pl FROM {source})"""
    exp = {f"e{n}": n for n in dict.fromkeys([*emas, fast, slow])}
    wild = {f"g{n}": ("b.g", 2, n) for n in rsi} | {f"l{n}": ("b.l", 2, n) for n in rsi} | {f"a{n}": ("b.tr", 1, n) for n in atr} | {"t": ("b.tr", 2, adx), "p": ("b.pd", 2, adx), "m": ("b.md", 2, adx)}
    one = ", ".join([*[f"close::DOUBLE AS {c}" for c in exp], *[f"(CASE WHEN {first} = 1 THEN {x.replace('b.', '')} ELSE 0 END)::DOUBLE AS {c}" for c, (x, first, _) in wild.items()], "0::DOUBLE AS obv", "0::DOUBLE AS onum", "1::DOUBLE AS oden"])
    more = ", ".join([*[ema("b.close", n, f"z.{c}") for c, n in exp.items()], *[wilder(x, f"z.{c}", first, n) for c, (x, first, n) in wild.items()], "z.obv + b.ov", f"z.onum * {19 / 21!r} + z.obv + b.ov", f"z.oden * {19 / 21!r} + 1"])
    z = f"SELECT ticker, {time}, i, {one} FROM b WHERE i = 1 UNION ALL SELECT b.ticker, b.{time}, b.i, {more} FROM z JOIN b ON b.ticker = z.ticker AND b.i = z.i + 1"
    ready = f"""SELECT *, CASE WHEN i >= {slow} THEN e{fast} - e{slow} END AS macd, CASE WHEN i > {adx} THEN 100 * p / nullif(t, 0) END AS adx_plus, CASE WHEN i > {adx} THEN 100 * m / nullif(t, 0) END AS adx_minus FROM z"""
    dx = "SELECT *, coalesce(100 * abs(adx_plus - adx_minus) / nullif(adx_plus + adx_minus, 0), 0) AS dx FROM r0"
    second = f"""SELECT ticker, i, (CASE WHEN i = {slow} THEN macd END)::DOUBLE AS sg, 0::DOUBLE AS ax FROM r1 WHERE i = 1
 UNION ALL SELECT b.ticker, b.i, CASE WHEN b.i = {slow} THEN b.macd WHEN b.i > {slow} THEN {ema("b.macd", sign, "y.sg")} END, {wilder("b.dx", "y.ax", adx + 1, adx)} FROM y JOIN r1 b ON b.ticker = y.ticker AND b.i = y.i + 1"""
    columns = [
        *[f"CASE WHEN r1.i > {n} THEN 100 * coalesce(g{n} / nullif(g{n} + l{n}, 0), 0.5) END AS rsi_{n}" for n in rsi], *[f"CASE WHEN r1.i >= {n} THEN e{n} END AS ema_{n}" for n in emas], "macd",
        f"CASE WHEN r1.i >= {slow + sign - 1} THEN sg END AS macd_signal", f"CASE WHEN r1.i >= {slow + sign - 1} THEN macd - sg END AS macd_hist", *[f"CASE WHEN r1.i >= {n} THEN a{n} END AS atr_{n}" for n in atr],
        f"CASE WHEN r1.i >= {2 * adx} THEN ax END AS adx", "adx_plus", "adx_minus", "obv", "onum / oden AS obv_ema",
    ]
    rec = f"SELECT r1.ticker, r1.{time}, {', '.join(columns)} FROM r1 JOIN y ON y.ticker = r1.ticker AND y.i = r1.i"
    return {"b": f"MATERIALIZED {step}", "z": z, "r0": ready, "r1": f"MATERIALIZED {dx}", "y": second, "rec": rec}


def flags(time: str = "date", rsi=(14,), emas=(9, 20, 50), atr=(14,)) -> list[str]:
    """Columns that follow from `rec` joined with the bars; over w, a window by ticker in time."""
    yes = lambda c: f"coalesce({c}, false)::INT"
    out = [x for n in rsi for tag in [f"{n}" if n != 14 else ""] for x in (f"{yes(f'rsi_{n} < 30')} AS rsi_oversold{'_' + tag if tag else ''}", f"{yes(f'rsi_{n} > 70')} AS rsi_overbought{'_' + tag if tag else ''}")]
    out += [f"close / nullif(ema_{n}, 0) - 1 AS close_to_ema_{n}" for n in emas] + [f"atr_{n} / nullif(close, 0) * 100 AS atr_{n}_percent" for n in atr]
    if {9, 20} <= set(emas):
        out.append(f"{yes('ema_9 > ema_20 AND NOT lag(ema_9 > ema_20) OVER w')} AS ema_9_20_cross")
    out += [f"{yes('macd > macd_signal AND NOT lag(macd > macd_signal) OVER w')} AS macd_cross_above", f"{yes('NOT macd > macd_signal AND lag(macd > macd_signal) OVER w')} AS macd_cross_below"]
    return out + [f"{yes('adx > 25')} AS adx_strong", f"{yes('adx < 20')} AS adx_weak", f"{yes('obv > obv_ema')} AS obv_trend"]


BARS = ("ticker", "date", "open", "high", "low", "close", "volume", "adjusted_close")
MEANS, WIDE = ("sma_", "bb_middle"), ("ema_", "macd", "bb_upper", "bb_lower", "momentum", "high_20", "low_20")


def digits(column: str) -> int:
    """Decimals in which two orders of adding agree: fewer for columns of the size of prices, more for means of
    prices, which end on halves of a shorter decimal."""
    if column.startswith(MEANS):
        return 6
    large = column.startswith(WIDE) and "cross" not in column or column == "vwap" or column.startswith("atr_") and not column.endswith("percent")
    return 3 if large else 4


def roll(f: str, x: str, n: int, time: str = "date") -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY {time} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {n} THEN {f}({x}) {w} END)"


def daily(source: str) -> dict[str, str]:
    """Pieces up to `ind`, every daily indicator of a table of bars."""
    yes = lambda c: f"coalesce({c}, false)::INT"
    lag = lambda c, n: f"lag({c}, {n}) OVER w"
    s1 = "SELECT *, " + ", ".join([
        *[f"{roll('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200)], f"{roll('stddev_pop', 'close', 20)} AS sd", f"{roll('max', 'high', 20)} AS high_20", f"{roll('min', 'low', 20)} AS low_20",
        f"close / nullif({lag('close', 1)}, 0) - 1 AS return_1", f"volume / nullif({lag('volume', 1)}, 0) - 1 AS volume_change", *[f"{roll('avg', 'volume', n)} AS volume_ma_{n}" for n in (10, 20)], f"{roll('stddev_samp', 'volume', 20)} AS vsd",
    ]) + f" FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY date)"
    s2 = "SELECT *, 4 * sd / nullif(sma_20, 0) * 100 AS bb_width FROM s1"
    far = "PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
    columns = [
        *flags(), *[f"close / nullif(sma_{n}, 0) - 1 AS close_to_sma_{n}" for n in (20, 50, 200)], f"{yes('sma_50 > sma_200 AND NOT lag(sma_50 > sma_200) OVER w')} AS golden_cross", f"{yes('NOT sma_50 > sma_200 AND lag(sma_50 > sma_200) OVER w')} AS death_cross",
        "sma_20 AS bb_middle", "sma_20 + 2 * sd AS bb_upper", "sma_20 - 2 * sd AS bb_lower", "(close - sma_20 + 2 * sd) / nullif(4 * sd, 0) AS bb_percent", f"{yes('bb_width < ' + roll('avg', 'bb_width', 20))} AS bb_squeeze",
        f"{yes('close > sma_20 + 2 * sd')} AS bb_overbought", f"{yes('close < sma_20 - 2 * sd')} AS bb_oversold", "(high + low + close) / 3 AS vwap", "(close - (high + low + close) / 3) / nullif((high + low + close) / 3, 0) * 100 AS vwap_deviation",
        *[f"close / nullif({lag('close', n)}, 0) - 1 AS return_{n}" for n in (5, 20)], "high / nullif(low, 0) AS high_low_ratio", "close / nullif(high, 0) AS close_to_high", "close / nullif(low, 0) AS close_to_low",
        *[f"close - {lag('close', n)} AS momentum_{n}" for n in (10, 30)], "(close - low_20) / nullif(high_20 - low_20, 0) AS price_position", *[f"{roll('stddev_samp', 'return_1', n)} AS volatility_{n}" for n in (20, 60)],
        "volume / nullif(volume_ma_20, 0) AS volume_ratio", f"{yes('volume > volume_ma_20 + 2 * vsd')} AS volume_spike",
        f"CASE WHEN count(return_1) OVER f >= 20 AND count(volume_change) OVER f >= 20 AND min(return_1) OVER f < max(return_1) OVER f AND min(volume_change) OVER f < max(volume_change) OVER f THEN corr(return_1, volume_change) OVER f END AS price_volume_corr",
    ]
    ind = f"SELECT s2.* EXCLUDE (sd, vsd), rec.* EXCLUDE (ticker, date), {', '.join(columns)} FROM s2 JOIN rec ON rec.ticker = s2.ticker AND rec.date = s2.date WINDOW w AS (PARTITION BY s2.ticker ORDER BY s2.date), f AS (PARTITION BY s2.ticker ORDER BY s2.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return recursion(source) | {"s1": s1, "s2": s2, "ind": ind.replace("PARTITION BY ticker ORDER BY date", "PARTITION BY s2.ticker ORDER BY s2.date")}


def hourly(source: str) -> dict[str, str]:
    """Pieces up to `ind`, the hourly set of a table of hourly bars."""
    rsi, emas, atr = (14, 98), (12, 84, 182), (14, 98)
    yes = lambda c: f"coalesce({c}, false)::INT"
    s1 = "SELECT *, " + ", ".join([*[f"{roll('avg', 'close', n, 'datetime')} AS sma_{n}h" for n in (20, 140, 350)], *[f"{roll('stddev_pop', 'close', n, 'datetime')} AS sd{n}" for n in (20, 140)]]) + f" FROM {source}"
    names = {f"{kind}_{n}": f"{kind}_{n}h" for kind, ns in (("rsi", rsi), ("ema", emas), ("atr", atr)) for n in ns}
    so_far = "OVER (PARTITION BY ticker, date ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    plain = [x for x in flags("datetime", rsi, emas, atr)]
    columns = [
        *plain, *[f"close / nullif(sma_{n}h, 0) - 1 AS close_to_sma_{n}h" for n in (20, 140, 350)], f"{yes('sma_140h > sma_350h AND NOT lag(sma_140h > sma_350h) OVER w')} AS golden_cross", f"{yes('NOT sma_140h > sma_350h AND lag(sma_140h > sma_350h) OVER w')} AS death_cross",
        *[x for n, m in ((20, "sma_20h"), (140, "sma_140h")) for x in (f"{m} + 2 * sd{n} AS bb_upper_{n}h", f"{m} AS bb_middle_{n}h", f"{m} - 2 * sd{n} AS bb_lower_{n}h")],
        "hour AS hour_of_day", "(hour BETWEEN 9 AND 15)::INT AS is_market_open", "(row_number() OVER d = 1)::INT AS is_first_hour", "(lead(datetime) OVER d IS NULL)::INT AS is_last_hour", f"max(high) {so_far} AS high_of_day", f"min(low) {so_far} AS low_of_day",
        f"(close - max(high) {so_far}) / nullif(max(high) {so_far}, 0) * 100 AS pct_from_high", f"(close - min(low) {so_far}) / nullif(min(low) {so_far}, 0) * 100 AS pct_from_low",
    ]
    both = "SELECT s1.*, rec.* EXCLUDE (ticker, datetime) FROM s1 JOIN rec ON rec.ticker = s1.ticker AND rec.datetime = s1.datetime"
    ind = f"SELECT * EXCLUDE (sd20, sd140, {', '.join(names)}), {', '.join(f'{a} AS {b}' for a, b in names.items())}, {', '.join(columns)} FROM both_ WINDOW w AS (PARTITION BY ticker ORDER BY datetime), d AS (PARTITION BY ticker, date ORDER BY datetime)"
    return recursion(source, "datetime", rsi, emas, (84, 182, 63), atr) | {"s1": s1, "both_": both, "ind": ind}


def final(columns: list[str], table: str = "ind", keys: tuple[str, ...] = BARS) -> str:
    """The columns of an indicator table, doubles rounded as `digits` says."""
    return "SELECT " + ", ".join(c if c in (*keys, "datetime", "hour") else f'round("{c}"::DOUBLE, {digits(c)}) AS "{c}"' for c in columns) + f" FROM {table}"
