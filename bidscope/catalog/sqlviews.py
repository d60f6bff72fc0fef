"""DuckDB views used by the SQL oracles: the same adapter and side tables written independently in SQL.

Each oracle string is ``WITH <views it needs> <query>``; ``with_views`` assembles the prefix in dependency order.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-10-01 00:00:00'"
AS_OF_DATE_SQL = "DATE '2001-10-01'"

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    _VIEWS[name] = (deps, sql)


def with_views(query: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return query
    ctes = ",\n".join(f"{n} AS (\n{_VIEWS[n][1]}\n)" for n in order)
    body = query.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{query}"


view("obs", """
SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS scan_date,
       row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs_seq,
       CASE WHEN l_linenumber = 6 OR p_partkey % 12 = 11 THEN 'Property Listing P1-' || CAST(p_partkey % 5 AS VARCHAR)
            ELSE ['2 Storey Terrace House', '3 Storey Semi Detached House', 'Service Apartment', 'Condominium',
                  'Shop Office', 'Retail Lot', '1.5 Storey Factory', 'Warehouse', 'Agricultural Land',
                  'Office Unit', 'Bungalow'][p_partkey % 12 + 1] END AS title,
       ['Kuala Lumpur', 'Selangor [Strata]', 'Selangor;', 'Kuala Lumpur & Selangor', 'KL'][p_partkey % 5 + 1] AS location,
       CASE WHEN p_partkey % 10 = 0 THEN 'Size not specified'
            ELSE format('{:,}', 400 + p_size * 75) || ' sq.ft' END AS size,
       'Residensi ' || replace(p_brand, '#', ' ') || ', ' || CASE WHEN p_partkey % 2 = 0 THEN 'Kuala Lumpur' ELSE 'Selangor' END AS header_short,
       CASE WHEN p_partkey % 7 = 0 THEN ''
            ELSE 'No. ' || CAST(p_partkey AS VARCHAR) || ', Jalan ' || p_brand || ', '
                 || CAST(40000 + p_partkey % 10000 AS VARCHAR) || ' Shah Alam, Selangor' END AS header_full,
       CASE WHEN l_linenumber = 7 OR p_partkey % 11 = 0 THEN '' ELSE 'L' || CAST(p_partkey // 2 AS VARCHAR) END AS listing_id,
       'RM' || format('{:,}', CAST((p_partkey % 40 + 1) * 250 * (100 - 10 * (l_linenumber % 4)) AS BIGINT)) AS price,
       strftime(date_trunc('month', l_shipdate) + to_days(CAST(30 + p_partkey % 28 AS INTEGER)), '%-d %b %Y (%a)') AS auction_date,
       CASE WHEN l_discount >= 0.05 THEN '-' || CAST(CAST(round(l_discount * 500) AS INTEGER) AS VARCHAR) || '%' ELSE '' END AS discount,
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS last_updated,
       CAST((p_partkey % 40 + 1) * 250 * (100 - 10 * (l_linenumber % 4)) AS BIGINT) AS price_value,
       p_partkey
FROM lineitem JOIN part ON l_partkey = p_partkey
""")

# Observations with blank strings as nulls (absent keys).
view("obsn", """
SELECT scan_date, obs_seq, nullif(title, '') AS title, nullif(location, '') AS location, nullif(size, '') AS size,
       nullif(header_short, '') AS header_short, nullif(header_full, '') AS header_full,
       nullif(listing_id, '') AS listing_id, nullif(price, '') AS price, nullif(auction_date, '') AS auction_date,
       nullif(discount, '') AS discount, nullif(last_updated, '') AS last_updated, price_value, p_partkey
FROM obs
""", ("obs",))


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_type(title: str) -> str:
    """B9 in DuckDB SQL: CASE over the ordered type rules on the cleaned title."""
    t = f"lower({sql_strip(f'regexp_replace(coalesce({title}, {chr(39)}{chr(39)}), {chr(39)}\\[.*?\\]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}gs{chr(39)})')})"
    tr = f"regexp_replace({t}, '\\s+$', '')"
    rules = [
        ("Landed", f"regexp_matches({t}, '(semi.?detached|detached)\\s*(house|home|plot|lot)')"),
        ("Landed", f"regexp_matches({t}, 'bungalow')"),
        ("Landed", f"regexp_matches({t}, 'terrace\\s*house')"),
        ("Landed", f"regexp_matches({t}, 'cluster\\s*(semi|house|design)')"),
        ("Landed", f"regexp_matches({t}, 'link\\s*(semi|house|bungalow)')"),
        ("Landed", f"regexp_matches({t}, 'town\\s*(house|villa)')"),
        ("Landed", f"regexp_matches({t}, 'villa\\b')"),
        ("Landed", f"regexp_matches({t}, '\\d+\\.?\\d*\\s*storey\\s*(semi|detached|cluster|link|zero)')"),
        ("Landed", f"(ends_with({tr}, 'house') OR ends_with({tr}, 'houses'))"),
        ("Landed", f"regexp_matches({t}, '(detached|semi|terrace|house|bungalow)\\s*(plot|lot)\\b')"),
        ("Landed", f"regexp_matches({t}, 'residential\\s*(lot|plot|building|terrace)')"),
        ("Landed", f"regexp_matches({t}, 'vacant\\s*(semi|detached|residential|terrace)')"),
        ("Landed", f"regexp_matches({t}, 'housing\\s*(lot|plot|land)')"),
        ("High-rise", f"regexp_matches({t}, 'apartment|condominium|condo\\b|flat\\b|penthouse|service\\s+suite')"),
        ("High-rise", f"regexp_matches({t}, '\\bsoho\\b')"),
        ("High-rise", f"(regexp_matches({t}, 'resid(ential|ence)') AND NOT contains({t}, 'land'))"),
        ("Industrial", f"regexp_matches({t}, 'factory|warehouse|industrial')"),
        ("Land", f"regexp_matches({t}, '\\bland\\b')"),
        ("Land", f"regexp_matches({t}, 'vacant\\s*(plot|lot|building)')"),
        ("Land", f"regexp_matches({t}, 'parcels?\\s+of')"),
        ("Land", f"regexp_matches({t}, 'residential\\s*land')"),
    ]
    whens = "\n".join(f"  WHEN {cond} THEN '{ty}'" for ty, cond in rules)
    return f"(CASE\n{whens}\n  ELSE 'Commercial' END)"


def _last_nonnull(c: str) -> str:
    return f"arg_max({c}, obs_seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"


view("state", f"""
SELECT p_partkey,
       {_last_nonnull('title')}, {_last_nonnull('location')}, {_last_nonnull('size')},
       {_last_nonnull('header_short')}, {_last_nonnull('header_full')}, {_last_nonnull('listing_id')},
       {_last_nonnull('price')}, {_last_nonnull('price_value')}, {_last_nonnull('auction_date')},
       {_last_nonnull('discount')}, {_last_nonnull('last_updated')},
       arg_min(coalesce(last_updated, strftime(scan_date, '%Y-%m-%d')), obs_seq) AS first_seen,
       min(scan_date) AS first_scan, max(scan_date) AS last_scan, count(*) AS n_obs,
       max(obs_seq) AS last_obs_seq, min(obs_seq) AS first_obs_seq
FROM obsn GROUP BY p_partkey
""", ("obsn",))

view("statet", f"""
SELECT *, {sql_type('title')} AS property_type FROM state
""", ("state",))


def sql_norm_text(x: str) -> str:
    return f"coalesce(lower({sql_strip(f'regexp_replace({x}, {chr(39)}\\s+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}), '')"


def sql_norm_size(x: str) -> str:
    return (f"coalesce(regexp_replace(lower({x}), '[^0-9]', '', 'g') || CASE WHEN contains(lower({x}), 'sq.ft') "
            f"OR contains(lower({x}), 'sqft') THEN 'sqft' ELSE '' END, '')")


def sql_norm_address(x: str) -> str:
    return f"regexp_replace({sql_norm_text(x)}, '\\s*,\\s*', ', ', 'g')"


def sql_stable_key(t="title", l="location", s="size", a="header_full", address_form="text") -> str:
    addr = sql_norm_address(a) if address_form == "address" else sql_norm_text(a)
    return f"({sql_norm_text(t)} || '|' || {sql_norm_text(l)} || '|' || {sql_norm_size(s)} || '|' || {addr})"


def sql_price_value(x: str) -> str:
    """First digits/commas run as bigint, else 0."""
    return f"coalesce(TRY_CAST(nullif(replace(regexp_extract(coalesce({x}, ''), '[0-9,]+', 0), ',', ''), '') AS BIGINT), 0)"


def sql_auction_day(x: str) -> str:
    """Leading 'd Mon yyyy' -> date."""
    m = "'^(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})'"
    return (f"CASE WHEN regexp_matches(coalesce({x}, ''), {m}) THEN TRY_CAST(try_strptime(regexp_extract({x}, {m}, 1) || ' ' || "
            f"regexp_extract({x}, {m}, 2) || ' ' || regexp_extract({x}, {m}, 3), '%d %b %Y') AS DATE) END")


EVENT_DATE = "coalesce(last_updated, strftime(scan_date, '%Y-%m-%d'))"

view("price_pts", f"""
SELECT p_partkey, scan_date, obs_seq, price, date, url FROM (
  SELECT p_partkey, scan_date, obs_seq, coalesce(price, '') AS price, {EVENT_DATE} AS date, '' AS url,
         lag(coalesce(price, '')) OVER (PARTITION BY p_partkey ORDER BY scan_date, obs_seq) AS prev
  FROM obsn) t
WHERE prev IS NULL OR prev <> price
""", ("obsn",))

view("auction_pts", f"""
SELECT p_partkey, scan_date, obs_seq, auction_date, date FROM (
  SELECT p_partkey, scan_date, obs_seq, coalesce(auction_date, '') AS auction_date, {EVENT_DATE} AS date,
         lag(coalesce(auction_date, '')) OVER (PARTITION BY p_partkey ORDER BY scan_date, obs_seq) AS prev
  FROM obsn) t
WHERE prev IS NULL OR prev <> auction_date
""", ("obsn",))

view("recent5", f"""
SELECT p_partkey, n_kept - rd + 1 AS pos, price, day, url, n_kept FROM (
  SELECT p_partkey, price, substr(date, 1, 10) AS day, coalesce(nullif(url, ''), '') AS url,
         row_number() OVER (PARTITION BY p_partkey ORDER BY scan_date DESC, obs_seq DESC) AS rd,
         count(*) OVER (PARTITION BY p_partkey) AS n_all
  FROM price_pts WHERE {sql_price_value('price')} >= 10000) t
  JOIN (SELECT p_partkey AS k2, least(count(*), 5) AS n_kept FROM price_pts
        WHERE {sql_price_value('price')} >= 10000 GROUP BY 1) c ON c.k2 = t.p_partkey
WHERE rd <= 5
""", ("price_pts",))

view("rounds", f"""
SELECT p_partkey, n - rd + 1 AS pos, day, price, auction_date, url FROM (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY day DESC) AS rd,
         least(count(*) OVER (PARTITION BY p_partkey), 10) AS n
  FROM (
    SELECT * FROM (
      SELECT p_partkey, day, url, price, auction_date,
             row_number() OVER w AS rn,
             lag(price) OVER w AS pp, lag(auction_date) OVER w AS pa
      FROM (
        SELECT p_partkey, day, u AS url,
               last_value(p IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price,
               last_value(ad IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS auction_date
        FROM (
          SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(a.day, b.day) AS day, a.p, b.ad,
                 CASE WHEN a.has_price THEN a.pu ELSE NULL END AS u
          FROM (SELECT p_partkey, substr(date, 1, 10) AS day,
                       arg_max(CASE WHEN {sql_price_value('price')} >= 10000 THEN price END, obs_seq)
                         FILTER (WHERE {sql_price_value('price')} >= 10000) AS p,
                       arg_max(nullif(url, ''), obs_seq) AS pu, true AS has_price
                FROM price_pts WHERE substr(date, 1, 10) <> '' GROUP BY 1, 2) a
          FULL OUTER JOIN
               (SELECT p_partkey, substr(date, 1, 10) AS day,
                       arg_max(nullif({sql_strip("regexp_replace(auction_date, '\\s*\\(.*$', '', 's')")}, ''), obs_seq)
                         FILTER (WHERE nullif({sql_strip("regexp_replace(auction_date, '\\s*\\(.*$', '', 's')")}, '') IS NOT NULL) AS ad
                FROM auction_pts WHERE substr(date, 1, 10) <> '' GROUP BY 1, 2) b
          ON a.p_partkey = b.p_partkey AND a.day = b.day) d) r
      WINDOW w AS (PARTITION BY p_partkey ORDER BY day)) s
    WHERE rn = 1 OR NOT (price IS NOT DISTINCT FROM pp AND auction_date IS NOT DISTINCT FROM pa)) k) z
WHERE rd <= 10 AND n > 1
""", ("price_pts", "auction_pts"))


def sql_is_expired(x: str = "auction_date") -> str:
    return f"coalesce({sql_auction_day(x)} < {AS_OF_DATE_SQL}, false)"


def sql_is_active(x: str = "auction_date") -> str:
    return f"coalesce({sql_auction_day(x)} >= {AS_OF_DATE_SQL}, false)"


def _published_sql() -> str:
    from .q_expr import SQL_CLEAN_LOCATION, SQL_SCHEME_ADDR, _SCHEME_HDR
    pv_now = sql_price_value("s.price")
    return f"""
SELECT *, lower(title || ' ' || address || ' ' || location || ' ' || property_type || ' ' || price || ' ' || size) AS search_text
FROM (
SELECT s.p_partkey, coalesce(s.title, '') AS title,
       CASE WHEN {pv_now} >= 10000 THEN s.price WHEN r.lastp IS NOT NULL THEN r.lastp
            WHEN coalesce(s.price_value, 0) >= 10000 THEN 'RM' || format('{{:,}}', s.price_value)
            ELSE coalesce(s.price, '') END AS price,
       CASE WHEN NOT ({pv_now} >= 10000) AND r.lastp IS NOT NULL THEN {sql_price_value('r.lastp')}
            ELSE coalesce(s.price_value, 0) END AS price_value,
       {SQL_CLEAN_LOCATION} AS location, coalesce(size, '') AS size,
       {sql_strip("regexp_replace(coalesce(auction_date, ''), '\\s*\\(.*$', '', 's')")} AS auction_text, auction_date,
       coalesce(property_type, '') AS property_type, coalesce(discount, '') AS discount,
       '' AS listing_url, '' AS image_url, substr(coalesce(header_full, ''), 1, 120) AS address,
       coalesce(r.n, 0) AS n_ph, coalesce(h.n, 0) AS n_hist, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng,
       coalesce(nullif({_SCHEME_HDR}, ''), nullif({SQL_SCHEME_ADDR}, ''), '') AS scheme_name,
       {sql_is_expired()} AS is_expired, {sql_is_active()} AS is_active, first_obs_seq AS arrival
FROM statet s
LEFT JOIN (SELECT p_partkey, arg_max(price, pos) AS lastp, count(*) AS n FROM recent5 GROUP BY 1) r ON r.p_partkey = s.p_partkey
LEFT JOIN (SELECT p_partkey, count(*) AS n FROM rounds GROUP BY 1) h ON h.p_partkey = s.p_partkey
) z
"""


def register_published() -> None:
    if "published" not in _VIEWS:
        view("published", _published_sql(), ("statet", "recent5", "rounds"))
        view("dedup_pub", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY title, price_value, auction_text, address
                               ORDER BY CASE WHEN size <> '' AND size <> 'Size not specified' THEN 0 ELSE 1 END, arrival) AS rn
  FROM published) t WHERE rn = 1
""", ("published",))
