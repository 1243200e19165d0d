"""The same inputs as SQL common table expressions, for checking results."""

from __future__ import annotations

import re

from volscribe.plans.datasets import CORE_SECURITIES


# Rounds half up, but with the edge a little below the exact half: exact halves are
# common among short decimals, and sums taken in another order may fall either side.
EDGE = 0.5317


def rounded(value: str, digits: int = 6) -> str:
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"floor(({value}) * {scale} + CAST({EDGE} AS DOUBLE)) / {scale}"


def _prices(key: str) -> str:
    return (
        f"SELECT CAST({key} AS BIGINT) AS PERMNO, CAST(l_shipdate AS DATE) AS date, "
        "avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1, 2"
    )


def _raw_returns(prices: str) -> str:
    digits = "CAST(CAST(round(r, 6) AS DECIMAL(12, 6)) AS VARCHAR)"
    return f"""
    SELECT PERMNO, strftime(date, '%Y%m%d') AS date,
           CASE WHEN day(date) % 11 = 0 THEN 'C' WHEN day(date) % 13 = 0 THEN '' ELSE {digits} END AS RET,
           CASE WHEN day(date) % 22 = 0 THEN 'B' ELSE {digits} END AS RETX,
           CASE WHEN day(date) = 22 AND month(date) = 6 THEN '-0.5' END AS DLRET
    FROM (SELECT PERMNO, date, 0.02 * ln(p / lag(p) OVER (PARTITION BY PERMNO ORDER BY date)) AS r FROM {prices})"""


def _number(column: str) -> str:
    return f"TRY_CAST(regexp_replace({column}, '^[A-Z]$', '') AS DOUBLE)"


def _returns(raw: str) -> str:
    return (
        "SELECT PERMNO, CAST(try_strptime(date, '%Y%m%d') AS DATE) AS date, "
        f"coalesce({_number('RET')}, {_number('RETX')}, {_number('DLRET')}) AS ret FROM {raw}"
    )


def _panel(returns: str) -> str:
    vols = ", ".join(
        f"sqrt(sum(ret * ret) OVER (PARTITION BY PERMNO ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)) "
        f"AS vol_{w}"
        for w in (1, 5, 22, 63)
    )
    leads = ", ".join(f"lead(vol_{w}) OVER (PARTITION BY PERMNO ORDER BY date) AS y_{w}" for w in (1, 5, 22, 63))
    return f"SELECT *, {leads} FROM (SELECT PERMNO, date, ret, {vols} FROM {returns})"


def day_of(seconds: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor({seconds} / 86400) AS INTEGER))"


def epoch_of(text: str) -> str:
    return f"CAST(epoch(try_strptime({text}, '%Y%m%d')) AS BIGINT)"


def cleaned(text: str) -> str:
    no_links = f"lower(regexp_replace({text}, 'https?://\\S+|www\\.\\S+', ' ', 'g'))"
    no_marks = f"regexp_replace({no_links}, '[*_`>~\\[\\]\\(\\)]', ' ', 'g')"
    return f"trim(regexp_replace({no_marks}, '\\s+', ' ', 'g'))"


def has_real_text(text: str) -> str:
    return f"({text} IS NOT NULL AND trim({text}) <> '' AND lower(trim({text})) NOT IN ('[removed]', '[deleted]'))"


def md5_head(*keys: str, salt: str = "") -> str:
    parts = ", ".join([*(f"CAST({k} AS VARCHAR)" for k in keys), f"'{salt}'"])
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 8) AS BIGINT)"


TABLES: dict[str, str] = {
    "raw_posts": """
    SELECT 'p' || doc_id AS id,
           CAST(788918400 + ((doc_id * 37) % 2400) * 86400 + (doc_id % 24) * 3600 AS VARCHAR) AS created_utc,
           source AS subreddit,
           CASE WHEN doc_id % 3 = 0 THEN 'Title $OF ' || doc_id END AS title,
           CASE WHEN doc_id % 25 = 1 THEN '[removed]' WHEN doc_id % 25 = 2 THEN ' [Deleted] '
                WHEN doc_id % 25 = 3 THEN '   ' WHEN doc_id % 25 = 4 THEN NULL
                WHEN doc_id % 10 = 0 THEN
                  '**Buy** $A now https://x.example.org/a?b=1 (see [this](www.y.example.com/z)) ' || text
                ELSE text END AS selftext
    FROM documents""",
    "raw_comments": """
    SELECT 'c' || conv_id || '_' || turn AS id,
           CAST(788918400 + ((conv_id * 53 + turn) % 2400) * 86400 + (turn % 24) * 3600 AS VARCHAR) AS created_utc,
           role AS subreddit,
           CASE WHEN (conv_id + turn) % 4 = 0 THEN text || ' $TO $OF moon' ELSE text END AS body
    FROM conversations""",
    "posts": "SELECT id, CAST(created_utc AS BIGINT) AS created_utc, subreddit, title, selftext FROM raw_posts",
    "comments": """
    SELECT id, CAST(created_utc AS BIGINT) AS created_utc, subreddit, CAST(NULL AS VARCHAR) AS title, body AS selftext
    FROM raw_comments""",
    "texts": """
    SELECT *, false AS is_comment FROM posts UNION ALL SELECT *, true AS is_comment FROM comments""",
    "core_securities": (
        "SELECT Ticker, SecInfoStartDt, SecInfoEndDt, CAST(PERMNO AS BIGINT) AS PERMNO "
        f"FROM (VALUES {CORE_SECURITIES}) v(Ticker, SecInfoStartDt, SecInfoEndDt, PERMNO)"
    ),
    "raw_securities": """
    SELECT * FROM core_securities UNION ALL
    SELECT CASE WHEN s_suppkey % 7 <> 0 THEN 'zq' || s_suppkey END,
           CASE WHEN s_suppkey % 11 = 0 THEN 'n/a'
                ELSE strftime(DATE '1995-01-01' + CAST(s_suppkey % 1000 AS INTEGER), '%Y%m%d') END,
           '20011231', s_suppkey % 10
    FROM supplier""",
    "securities": f"""
    SELECT upper(Ticker) AS ticker, {epoch_of('SecInfoStartDt')} AS start_ts, {epoch_of('SecInfoEndDt')} AS end_ts
    FROM raw_securities WHERE Ticker IS NOT NULL""",
    "tokens_found": r"""
    SELECT id, created_utc, subreddit, is_comment,
           unnest(regexp_extract_all(concat_ws(' ', title, selftext), '\$?[A-Z]{1,5}\b')) AS token
    FROM texts""",
    "named": r"SELECT *, upper(regexp_replace(token, '^\$', '')) AS ticker FROM tokens_found",
    "mentions": """
    SELECT n.id, n.created_utc, n.subreddit, n.is_comment, n.ticker
    FROM named n JOIN securities s ON n.ticker = s.ticker
    WHERE n.created_utc BETWEEN s.start_ts AND s.end_ts AND (length(n.ticker) >= 2 OR n.token LIKE '$%')""",
    "mention_keys": "SELECT DISTINCT id, created_utc, subreddit, is_comment, ticker FROM mentions",
    "clean_mentions": f"""
    SELECT m.id, m.created_utc, m.subreddit, m.ticker, {cleaned('t.selftext')} AS clean_text
    FROM mention_keys m JOIN texts t ON m.id = t.id WHERE {has_real_text('t.selftext')}""",
    "px_wide": _prices("l_suppkey"),
    "px_symbol": _prices("l_suppkey % 10"),
    "raw_wide": _raw_returns("px_wide"),
    "raw_symbol": _raw_returns("px_symbol"),
    "ret_wide": _returns("raw_wide"),
    "ret_symbol": _returns("raw_symbol"),
    "panel_wide": _panel("ret_wide"),
    "panel_symbol": _panel("ret_symbol"),
    "har_rows": """
    SELECT PERMNO, date, year(date) AS yr, y_1 AS y, vol_1 AS x1, vol_5 AS x2, vol_22 AS x3, vol_63 AS x4
    FROM panel_wide
    WHERE y_1 IS NOT NULL AND vol_1 IS NOT NULL AND vol_5 IS NOT NULL AND vol_22 IS NOT NULL AND vol_63 IS NOT NULL""",
    "emb": """
    SELECT 'p' || d.doc_id AS id, e.embedding AS embed
    FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""",
    "ticker_map": """
    SELECT DISTINCT p.date AS DATE, upper(m.Ticker) AS TICKER, m.PERMNO
    FROM px_symbol p JOIN core_securities m ON p.PERMNO = m.PERMNO WHERE m.Ticker IS NOT NULL""",
    "mapped": f"""
    SELECT k.*, {day_of('k.created_utc')} AS created_date, t.PERMNO
    FROM mention_keys k JOIN ticker_map t ON t.DATE = {day_of('k.created_utc')} AND t.TICKER = k.ticker""",
    "linked": """
    SELECT m.id AS r_id, m.ticker AS r_ticker, m.created_utc AS r_created_utc, m.PERMNO,
           p.date AS c_date, p.ret AS c_ret, p.vol_1 AS c_vol_1, p.vol_5 AS c_vol_5, p.vol_22 AS c_vol_22,
           p.vol_63 AS c_vol_63, p.y_1 AS c_y_1
    FROM mapped m JOIN panel_symbol p ON p.PERMNO = m.PERMNO AND p.date = m.created_date""",
    "linked_vec": "SELECT l.*, e.embed AS r_embed FROM linked l LEFT JOIN emb e ON e.id = l.r_id",
    "design": f"""
    SELECT PERMNO, c_date AS date, r_id || '_' || r_ticker AS id,
           CAST({md5_head("r_id || '_' || r_ticker")} % 3 AS INTEGER) AS fold,
           list_concat([c_vol_1, c_vol_5, c_vol_22, c_vol_63], CAST(r_embed AS DOUBLE[])) AS x, c_y_1 AS y
    FROM linked_vec
    WHERE r_embed IS NOT NULL AND c_y_1 IS NOT NULL AND c_vol_1 IS NOT NULL AND c_vol_5 IS NOT NULL
      AND c_vol_22 IS NOT NULL AND c_vol_63 IS NOT NULL""",
    # Least squares by successive orthogonalisation: a route that shares no step
    # with the moment-based fit it checks.
    "har_windows": """
    SELECT t.yr AS test_year FROM (SELECT DISTINCT yr FROM har_rows) t
    JOIN (SELECT DISTINCT yr FROM har_rows) p ON p.yr BETWEEN t.yr - 4 AND t.yr - 1
    GROUP BY 1 HAVING count(*) = 4""",
    "fit_rows": """
    SELECT w.test_year AS g, h.* FROM har_windows w JOIN har_rows h ON h.yr BETWEEN w.test_year - 4 AND w.test_year - 1""",
    "score_rows": "SELECT w.test_year AS g, h.* FROM har_windows w JOIN har_rows h ON h.yr = w.test_year",
}


def least_squares(fit: str, score: str, out: str) -> dict[str, str]:
    """Tables that fit y on x1..x4 within each group of ``fit`` and predict ``score``."""
    first = "x1 - m1 AS e1, x2 - m2 - b21 * (x1 - m1) AS f2, x3 - m3 - b31 * (x1 - m1) AS f3, x4 - m4 - b41 * (x1 - m1) AS f4"
    return {
        f"{out}_a1": f"""
        SELECT g, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, avg(y) AS my,
               regr_slope(x2, x1) AS b21, regr_slope(x3, x1) AS b31, regr_slope(x4, x1) AS b41, regr_slope(y, x1) AS c1
        FROM {fit} GROUP BY g""",
        f"{out}_r1": f"SELECT g, {first}, y - my - c1 * (x1 - m1) AS u FROM {fit} JOIN {out}_a1 USING (g)",
        f"{out}_a2": f"""
        SELECT g, regr_slope(f3, f2) AS b32, regr_slope(f4, f2) AS b42, regr_slope(u, f2) AS c2 FROM {out}_r1 GROUP BY g""",
        f"{out}_r2": f"""
        SELECT g, f3 - b32 * f2 AS h3, f4 - b42 * f2 AS h4, u - c2 * f2 AS u FROM {out}_r1 JOIN {out}_a2 USING (g)""",
        f"{out}_a3": f"SELECT g, regr_slope(h4, h3) AS b43, regr_slope(u, h3) AS c3 FROM {out}_r2 GROUP BY g",
        f"{out}_a4": f"""
        SELECT g, regr_slope(u - c3 * h3, h4 - b43 * h3) AS c4 FROM {out}_r2 JOIN {out}_a3 USING (g) GROUP BY g""",
        out: f"""
        SELECT g, PERMNO, date, y,
               my + c1 * e1 + c2 * f2 + c3 * (f3 - b32 * f2)
                  + c4 * ((f4 - b42 * f2) - b43 * (f3 - b32 * f2)) AS prediction
        FROM (SELECT *, {first} FROM {score} JOIN {out}_a1 USING (g))
        JOIN {out}_a2 USING (g) JOIN {out}_a3 USING (g) JOIN {out}_a4 USING (g)""",
    }


TABLES.update(least_squares("fit_rows", "score_rows", "har_pred"))
TABLES["pooled_rows"] = """
    SELECT 0 AS g, h.* FROM har_rows h WHERE h.yr >= (SELECT min(test_year) FROM har_windows)"""
TABLES.update(least_squares("pooled_rows", "pooled_rows", "pooled_pred"))

_X = ("x1", "x2", "x3", "x4")
_CLIPPED = ", ".join(f"least(greatest({x}, l_{x}), h_{x}) AS {x}" for x in _X)
_LOGS = ", ".join(f"ln(greatest({x}, 1e-6)) AS {x}" for x in (*_X, "y"))
TABLES["win_bounds"] = "SELECT g, " + ", ".join(
    f"quantile_disc({x}, 0.01) AS l_{x}, quantile_disc({x}, 0.99) AS h_{x}" for x in (*_X, "y")
) + " FROM fit_rows GROUP BY g"
TABLES["win_fit"] = f"SELECT g, PERMNO, date, {_CLIPPED}, least(greatest(y, l_y), h_y) AS y FROM fit_rows JOIN win_bounds USING (g)"
TABLES["win_score"] = f"SELECT g, PERMNO, date, {_CLIPPED}, y FROM score_rows JOIN win_bounds USING (g)"
TABLES.update(least_squares("win_fit", "win_score", "win_pred"))
TABLES["log_fit"] = f"SELECT g, PERMNO, date, {_LOGS} FROM fit_rows"
TABLES["log_score"] = f"SELECT g, PERMNO, date, {_LOGS} FROM score_rows"
TABLES.update(least_squares("log_fit", "log_score", "log_pred"))


def with_tables(body: str) -> str:
    """``body`` preceded by exactly the tables it needs, in order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for name in (words & TABLES.keys()) - needed:
            needed.add(name)
            todo.append(TABLES[name])
    # Shared tables are computed once instead of once per reference.
    parts = [f"{name} AS MATERIALIZED ({sql})" for name, sql in TABLES.items() if name in needed]
    # A body may go on with tables of its own, after a comma.
    return (f"WITH {', '.join(parts)} " if parts else "") + body
