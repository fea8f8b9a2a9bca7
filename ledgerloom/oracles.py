"""The same results as ``queries`` in ANSI SQL, for comparison in another engine."""

from __future__ import annotations

from ledgerloom.queries import AMOUNTS, APART, KEY, PROFILED, SCALES, TX, VELOCITY
from ledgerloom.schema import FEATURE_GROUPS
from ledgerloom.sources.samples import ADDRESS_LABELS, TX_EVENTS, TX_LINEITEM

DOUBLES = {"amount_usd", "gas_fee_usd"}
BAD = "(amount_usd IS NULL OR amount_usd <= 0 OR transaction_hash IS NULL OR timestamp IS NULL)"
LATEST_FIRST = "timestamp DESC NULLS FIRST, block_number DESC NULLS LAST, transaction_hash DESC NULLS LAST"
EARLIEST_FIRST = "timestamp ASC NULLS LAST, block_number ASC NULLS FIRST, transaction_hash ASC NULLS FIRST"


def digits(expression: str) -> str:
    return f"round({expression} + 1e-9, 4) + 0e0"


def cols(names: list[str], doubles: set[str] = DOUBLES) -> str:
    return ", ".join(f"{digits(n)} AS {n}" if n in doubles else n for n in names)


ALL = cols(TX)
KEYS = cols(KEY)


def deduped(source: str, keep: str = "last", keys: str = "transaction_hash") -> str:
    if keep == "none":
        return (f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n "
                f"FROM {source}) WHERE n = 1")
    order = LATEST_FIRST if keep == "last" else EARLIEST_FIRST
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1")


def over(view: str) -> str:
    return f"WITH tx AS ({view}), clean AS (SELECT * FROM tx WHERE NOT {BAD}), " \
           f"settled AS (SELECT * FROM ({deduped('clean')}) WHERE status = 'confirmed')"


EV, LI = over(TX_EVENTS), over(TX_LINEITEM)

TIME_PARTS = """CAST(year(timestamp) AS BIGINT) AS year, CAST(month(timestamp) AS BIGINT) AS month,
    CAST(day(timestamp) AS BIGINT) AS day, CAST(hour(timestamp) AS BIGINT) AS hour,
    strftime(timestamp, '%Y-%m-%d') AS date_partition, strftime(timestamp, '%Y-%m-%d-%H') AS hour_partition"""
AMOUNT_PARTS = (f"{digits('ln(1 + amount_usd)')} AS amount_log, "
                f"{digits('gas_fee_usd / (amount_usd + 1e-6)')} AS fee_ratio, "
                f"{digits('amount_usd + gas_fee_usd')} AS total_cost_usd")


def rolled(windows: dict[str, int], group: str = "from_address") -> str:
    order = f"PARTITION BY {group} ORDER BY {EARLIEST_FIRST}"
    parts = []
    for label, w in windows.items():
        frame = f"OVER ({order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        parts += [f"count(timestamp) OVER ({order} ROWS UNBOUNDED PRECEDING) AS txn_count_{label}",
                  f"{digits(f'sum(amount_usd) {frame}')} AS amount_sum_{label}",
                  f"{digits(f'avg(amount_usd) {frame}')} AS amount_mean_{label}"]
    return ", ".join(parts)


def within(interval: str) -> str:
    return (f"OVER (PARTITION BY from_address ORDER BY timestamp "
            f"RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")


def ranged() -> str:
    parts = []
    for label, interval in {"1h": "1 HOUR", "24h": "24 HOURS", "7d": "7 DAYS"}.items():
        parts += [f"count(timestamp) {within(interval)} AS txn_count_{label}",
                  f"{digits(f'sum(amount_usd) {within(interval)}')} AS amount_sum_{label}",
                  f"{digits(f'avg(amount_usd) {within(interval)}')} AS amount_mean_{label}"]
    return ", ".join(parts)


STANDARD = {"1h": 1, "1d": 24, "7d": 168}
ROWS_FRAME = f"{EV} SELECT {KEYS}, from_address, {rolled(STANDARD)} FROM settled"
RANGE_FRAME = f"{EV} SELECT {KEYS}, from_address, {ranged()} FROM settled"

VELOCITY_SQL = f"""{EV} SELECT {KEYS}, from_address, {ranged()},
    count(DISTINCT to_address) {within('24 HOURS')} AS unique_recipients_24h,
    count(DISTINCT chain) {within('24 HOURS')} AS unique_chains_24h FROM settled"""

HISTORY = f"OVER (PARTITION BY from_address ORDER BY {EARLIEST_FIRST} ROWS UNBOUNDED PRECEDING)"
AMOUNTS_SQL = f"""{EV}, w AS (
  SELECT *, avg(amount_usd) {HISTORY} AS m, stddev_samp(amount_usd) {HISTORY} AS sd,
    avg(amount_usd) {within('7 DAYS')} AS m7, stddev_samp(amount_usd) {within('7 DAYS')} AS sd7,
    max(amount_usd) {within('7 DAYS')} AS x7,
    percent_rank() OVER (PARTITION BY strftime(timestamp, '%Y-%m-%d') ORDER BY amount_usd) AS pr
  FROM settled)
  SELECT {KEYS}, from_address, {AMOUNT_PARTS},
    {digits('(amount_usd - m) / nullif(sd, 0)')} AS amount_zscore, {digits('pr')} AS amount_percentile,
    {digits('amount_usd / m7 - 1')} AS amount_momentum, {digits('x7')} AS max_single_txn_7d,
    {digits('sd7 / nullif(m7, 0)')} AS amount_cv_7d FROM w"""

LAST_SEEN = f"lag(timestamp) OVER (PARTITION BY from_address ORDER BY {EARLIEST_FIRST})"


def mode(value: str, name: str) -> str:
    return f"""{name} AS (SELECT from_address, {value} AS {name} FROM (
      SELECT from_address, {value}, row_number() OVER (PARTITION BY from_address ORDER BY count(*) DESC, {value} DESC) AS rn
      FROM settled WHERE timestamp <= TIMESTAMP '2024-01-15' GROUP BY from_address, {value}) WHERE rn = 1)"""


BEHAVIORAL_SQL = f"""{EV}, {mode('chain', 'preferred_chain')}, {mode('token_symbol', 'preferred_token')},
  w AS (SELECT *, min(timestamp) OVER (PARTITION BY from_address) AS first_at, {LAST_SEEN} AS last_at FROM settled)
  SELECT {KEYS}, w.from_address, CAST(hour(timestamp) AS BIGINT) AS hour_of_day,
    CAST(isodow(timestamp) - 1 AS BIGINT) AS day_of_week, isodow(timestamp) >= 6 AS is_weekend,
    hour(timestamp) < 6 AS is_night, preferred_chain, preferred_token,
    date_sub('day', first_at, timestamp) AS days_since_first_txn,
    date_sub('day', last_at, timestamp) AS days_since_last_txn,
    date_sub('day', first_at, TIMESTAMP '2024-01-15') AS account_age_days
  FROM w LEFT JOIN preferred_chain pc ON w.from_address = pc.from_address
  LEFT JOIN preferred_token pt ON w.from_address = pt.from_address"""

RISK_SQL = f"""{EV}, w AS (SELECT *, min(timestamp) OVER (PARTITION BY from_address) AS first_at, {LAST_SEEN} AS last_at,
    count(timestamp) {within('24 HOURS')} AS c24, count(DISTINCT chain) {within('24 HOURS')} AS u24 FROM settled)
  SELECT {KEYS}, from_address, {digits('c24 * amount_usd')} AS velocity_x_amount, u24 > 1 AS cross_chain_activity,
    amount_usd > 100 AS high_value_flag,
    coalesce(date_sub('second', last_at, timestamp) < 3600, false) AS rapid_succession_flag,
    coalesce(date_sub('second', last_at, timestamp) > 2 * 86400, false) AS dormant_account_flag,
    date_sub('second', first_at, timestamp) < 86400 AS new_address_flag,
    amount_usd >= 10 AND amount_usd % 5 = 0 AS large_round_amount_flag,
    hour(timestamp) < 6 AND amount_usd > 100 AS off_hours_large_txn FROM w"""

NETWORK_SQL = f"""{EV}, labels AS ({ADDRESS_LABELS}),
  j AS (SELECT settled.*, category, risk_score FROM settled LEFT JOIN labels ON to_address = address)
  SELECT {KEYS}, from_address, count(DISTINCT to_address) {within('7 DAYS')} AS unique_counterparties_7d,
    {digits(f"avg(risk_score) {within('7 DAYS')}")} AS counterparty_risk_score_avg,
    count(CASE WHEN category = 'risky' THEN 1 END) {within('7 DAYS')} > 0 AS known_risky_address,
    count(CASE WHEN category = 'mixer' THEN 1 END) {within('7 DAYS')} > 0 AS mixer_interaction,
    {digits(f"100.0 * sum(CASE WHEN category = 'exchange' THEN amount_usd ELSE 0 END) {within('7 DAYS')} / sum(amount_usd) {within('7 DAYS')}")}
      AS exchange_volume_pct FROM j"""

FEATURES = f"""{EV}, f AS (SELECT from_address, timestamp, block_number, transaction_hash, {rolled(STANDARD)}, {AMOUNT_PARTS} FROM settled),
  known AS (SELECT * FROM f WHERE timestamp <= TIMESTAMP '2024-01-15'),
  latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY from_address ORDER BY timestamp DESC) AS rn
             FROM known) WHERE rn = 1)"""
V = ", ".join(VELOCITY)

SPANS = """parts AS (SELECT *, CASE WHEN timestamp < TIMESTAMP '2024-01-11' THEN 1
    WHEN timestamp < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS part FROM clean),
  members(version, part, added) AS (VALUES (1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 3, 3), (4, 3, 3), (4, 1, 4))"""

STATUS_BAD = "(status IS NULL OR status NOT IN ('confirmed', 'failed', 'pending'))"
CHAIN_BAD = "(chain IS NULL OR chain NOT IN ('ethereum', 'bitcoin', 'polygon', 'solana', 'avalanche', 'arbitrum'))"
FUTURE = "count(*) FILTER (timestamp > TIMESTAMP '2024-01-20')"
TOO_OLD = "count(*) FILTER (timestamp < TIMESTAMP '2015-01-01')"
SURPLUS = "(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS s FROM (SELECT count(*) AS n FROM tx GROUP BY transaction_hash))"
NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("transaction_hash", "timestamp", "chain"))
REPORT = f"""{EV}, m AS (SELECT {NULLS} AS f0, count(*) FILTER (amount_usd <= 0) AS f1, {FUTURE} + {TOO_OLD} AS f2,
    count(*) FILTER ({STATUS_BAD}) AS f3, count(*) FILTER ({CHAIN_BAD}) AS f5,
    count(*) FILTER (gas_fee_usd > amount_usd) AS f6 FROM tx),
  r(position, rule, findings) AS (
    SELECT 0, 'no_nulls_in_key_columns', f0 FROM m UNION ALL SELECT 1, 'amount_usd_positive', f1 FROM m
    UNION ALL SELECT 2, 'timestamp_in_valid_range', f2 FROM m UNION ALL SELECT 3, 'status_valid_enum', f3 FROM m
    UNION ALL SELECT 4, 'transaction_hash_unique', s FROM {SURPLUS} UNION ALL SELECT 5, 'chain_valid_enum', f5 FROM m)"""


def rule(view: str, name: str, zero: str, metrics: str) -> str:
    return f"{view} SELECT '{name}' AS rule, ({zero}) = 0 AS passed, {metrics} FROM tx"


def time_rule(view: str) -> str:
    return rule(view, "timestamp_in_valid_range", f"{FUTURE} + {TOO_OLD}", f"{FUTURE} AS future, {TOO_OLD} AS too_old")


def unique_rule(view: str) -> str:
    return f"{view} SELECT 'transaction_hash_unique' AS rule, s = 0 AS passed, s AS duplicate_count FROM {SURPLUS}"


def backfilled(start: str, days: int, rolled_columns: str) -> str:
    """Each one-day window by itself."""
    return f"""WITH tx AS ({TX_EVENTS}),
  win AS (SELECT *, time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '{start}') AS window_start FROM tx
          WHERE NOT {BAD} AND timestamp >= TIMESTAMP '{start}' AND timestamp < TIMESTAMP '{start}' + INTERVAL {days} DAY),
  settled AS (SELECT * FROM ({deduped('win', keys='transaction_hash, window_start')}) WHERE status = 'confirmed')
  SELECT window_start, {KEYS}, from_address, {rolled_columns} FROM settled"""


TEXT = f"""{EV}, text AS (SELECT transaction_hash, block_number,
    CASE WHEN token_symbol = 'MATIC' THEN NULL ELSE timestamp END AS timestamp,
    CASE WHEN tx_type = 'burn' THEN NULL ELSE amount_usd END AS amount_usd,
    CASE WHEN tx_type = 'burn' THEN 'n/a' END AS said FROM tx)"""

def asked_sql(view: str, oldest: str) -> str:
    """Each event that did not go through with its address's latest features at that time."""
    found = ", ".join([*VELOCITY, "f.amount_log AS amount_statistics_amount_log", "fee_ratio", "total_cost_usd"])
    return f"""{view}, f AS (SELECT from_address, timestamp, {rolled(STANDARD)}, {AMOUNT_PARTS} FROM settled),
      asked AS (SELECT from_address, timestamp AS asked_at, block_number, {digits('amount_usd')} AS amount_log FROM tx WHERE status <> 'confirmed')
      SELECT a.from_address, a.asked_at, a.block_number, a.amount_log, {found} FROM asked a
      LEFT JOIN LATERAL (SELECT * FROM f WHERE f.from_address = a.from_address AND f.timestamp <= a.asked_at {oldest}
        ORDER BY f.timestamp DESC LIMIT 1) f ON true"""


HOT = "CASE WHEN tx_type IN ('transfer', 'swap', 'stake') THEN '0xhot' ELSE from_address END AS from_address"

REPLAYS = f"""WITH tx AS ({TX_EVENTS}),
  landed AS (SELECT * FROM tx UNION ALL SELECT * REPLACE (timestamp + INTERVAL 4 DAY AS timestamp, block_number + 1000000 AS block_number)
    FROM tx WHERE block_number % 3 = 0),
  win AS (SELECT *, time_bucket(INTERVAL 4 DAY, timestamp, TIMESTAMP '2024-01-05') AS window_start FROM landed
    WHERE NOT {BAD} AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-17'),
  loadable AS (SELECT * FROM ({deduped('win', keys='transaction_hash, window_start')}) WHERE status = 'confirmed'),
  settled AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY transaction_hash ORDER BY window_start) AS nth FROM loadable) WHERE nth = 1)"""

JOBS = f"""WITH tx AS ({TX_EVENTS}),
  win AS (SELECT *, time_bucket(INTERVAL 3 DAY, timestamp, TIMESTAMP '2024-01-05') AS window_start FROM tx
          WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-11'),
  good AS (SELECT * FROM win WHERE NOT {BAD}),
  settled AS (SELECT * FROM ({deduped('good', keys='transaction_hash, window_start')}) WHERE status = 'confirmed')"""


def job_feature_values_sql() -> str:
    """All rows at once; ``until`` is the end of a row's window."""
    users = "CAST(substr(from_address, 3) AS BIGINT) % 3"
    windows = ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in zip(APART, APART[1:]))

    def preferred(value: str, name: str) -> str:
        return f"""{name} AS (SELECT until, from_address, {value} AS {name} FROM (
          SELECT w.until, from_address, {value}, row_number() OVER (PARTITION BY w.until, from_address ORDER BY count(*) DESC, {value} DESC) AS rn
          FROM windows w JOIN settled s ON s.timestamp < w.until GROUP BY w.until, from_address, {value}) WHERE rn = 1)"""

    return f"""WITH tx AS ({TX_EVENTS}),
  moved AS (SELECT * REPLACE (timestamp + CASE WHEN timestamp < TIMESTAMP '2024-01-15' THEN INTERVAL 0 DAY
      WHEN {users} = 0 THEN INTERVAL 45 DAY WHEN {users} = 1 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS timestamp) FROM tx),
  windows(since, until) AS (VALUES {windows}),
  good AS (SELECT moved.*, since, until FROM moved JOIN windows ON timestamp >= since AND timestamp < until WHERE NOT {BAD}),
  settled AS (SELECT * FROM ({deduped('good', keys='transaction_hash, until')}) WHERE status = 'confirmed'),
  labels AS ({ADDRESS_LABELS}), {preferred('chain', 'preferred_chain')}, {preferred('token_symbol', 'preferred_token')},
  days AS (SELECT a.from_address, a.timestamp, a.block_number, count(CASE WHEN b.amount_usd < a.amount_usd THEN 1 END) AS smaller, count(*) AS n
    FROM settled a JOIN settled b ON date_trunc('day', a.timestamp) = date_trunc('day', b.timestamp) AND b.timestamp < a.until GROUP BY ALL),
  w AS (SELECT settled.*, category, risk_score, min(timestamp) OVER (PARTITION BY from_address) AS first_at, {LAST_SEEN} AS last_at,
    count(timestamp) {within('24 HOURS')} AS c24, count(DISTINCT chain) {within('24 HOURS')} AS u24,
    avg(amount_usd) {HISTORY} AS m, stddev_samp(amount_usd) {HISTORY} AS sd,
    avg(amount_usd) {within('7 DAYS')} AS m7, stddev_samp(amount_usd) {within('7 DAYS')} AS sd7, max(amount_usd) {within('7 DAYS')} AS x7
    FROM settled LEFT JOIN labels ON to_address = address)
  SELECT w.from_address, w.timestamp, {ranged()},
    count(DISTINCT to_address) {within('24 HOURS')} AS unique_recipients_24h, u24 AS unique_chains_24h,
    {AMOUNT_PARTS}, {digits('(amount_usd - m) / nullif(sd, 0)')} AS amount_zscore,
    {digits('coalesce(smaller / nullif(n - 1, 0), 0)')} AS amount_percentile,
    {digits('amount_usd / m7 - 1')} AS amount_momentum, {digits('x7')} AS max_single_txn_7d, {digits('sd7 / nullif(m7, 0)')} AS amount_cv_7d,
    CAST(hour(timestamp) AS BIGINT) AS hour_of_day, CAST(isodow(timestamp) - 1 AS BIGINT) AS day_of_week, isodow(timestamp) >= 6 AS is_weekend,
    hour(timestamp) < 6 AS is_night, preferred_chain, preferred_token,
    date_sub('day', first_at, timestamp) AS days_since_first_txn, date_sub('day', last_at, timestamp) AS days_since_last_txn,
    date_sub('day', first_at, until) AS account_age_days,
    {digits('c24 * amount_usd')} AS velocity_x_amount, u24 > 1 AS cross_chain_activity, amount_usd > 100 AS high_value_flag,
    coalesce(date_sub('second', last_at, timestamp) < 3600, false) AS rapid_succession_flag,
    coalesce(date_sub('second', last_at, timestamp) > 2 * 86400, false) AS dormant_account_flag,
    date_sub('second', first_at, timestamp) < 86400 AS new_address_flag,
    amount_usd >= 10 AND amount_usd % 5 = 0 AS large_round_amount_flag, hour(timestamp) < 6 AND amount_usd > 100 AS off_hours_large_txn,
    count(DISTINCT to_address) {within('7 DAYS')} AS unique_counterparties_7d, {digits(f"avg(risk_score) {within('7 DAYS')}")} AS counterparty_risk_score_avg,
    count(CASE WHEN category = 'risky' THEN 1 END) {within('7 DAYS')} > 0 AS known_risky_address,
    count(CASE WHEN category = 'mixer' THEN 1 END) {within('7 DAYS')} > 0 AS mixer_interaction,
    {digits(f"100.0 * sum(CASE WHEN category = 'exchange' THEN amount_usd ELSE 0 END) {within('7 DAYS')} / sum(amount_usd) {within('7 DAYS')}")}
      AS exchange_volume_pct
  FROM w JOIN days USING (from_address, timestamp, block_number)
  LEFT JOIN preferred_chain USING (until, from_address) LEFT JOIN preferred_token USING (until, from_address)"""


NUMBERS = {"amount_usd", "gas_fee_usd", "block_number"}


def profile_sql() -> str:
    parts = []
    for c in PROFILED:
        number = c in NUMBERS
        low, high = (f"{digits(f'CAST({pick}({c}) AS DOUBLE)')}" if number else "CAST(NULL AS DOUBLE)" for pick in ("min", "max"))
        first, last = ("CAST(NULL AS VARCHAR)" if number else f"{pick}({c})" for pick in ("min", "max"))
        shares = ", ".join((digits(f"quantile_disc(CAST({c} AS DOUBLE), {p})") if number else "CAST(NULL AS DOUBLE)") + f" AS q{p * 100:.0f}" for p in (0.1, 0.5, 0.9))
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS records, count(*) - count({c}) AS nulls, {low} AS low, {high} AS high,
          {first} AS first, {last} AS last, {f"count(DISTINCT {c})" if not number else "CAST(NULL AS BIGINT)"} AS members, {shares} FROM span""")
    return f"""{EV}, span AS (SELECT * FROM tx WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21') """ + " UNION ALL ".join(parts)


def drift_sql() -> str:
    parts = []
    for c in PROFILED:
        if c == "to_address":
            parts.append("""SELECT 'to_address' AS "column", true AS one_sided, false AS shifted, CAST(NULL AS DOUBLE) AS null_change,
              CAST(NULL AS BIGINT) AS new_members, CAST(NULL AS DOUBLE) AS overlap, false AS passed""")
            continue
        q = lambda side, p: f"(SELECT quantile_disc({c}, {round(p, 2)}) FROM {side})"
        shifted = " OR ".join(f"{q('later', p)} < {q('early', p - 0.05)} OR {q('later', p)} > {q('early', p + 0.05)}"
                              for p in (0.1, 0.25, 0.5, 0.75, 0.9)) if c in NUMBERS else "false"
        nulls = lambda side: f"(SELECT (count(*) - count({c})) * 1e0 / count(*) FROM {side})"
        common = f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM later WHERE {c} IS NOT NULL INTERSECT SELECT DISTINCT {c} FROM early))"
        every = f"(SELECT count(*) FROM (SELECT {c} FROM later WHERE {c} IS NOT NULL UNION SELECT {c} FROM early WHERE {c} IS NOT NULL))"
        mine = f"(SELECT count(DISTINCT {c}) FROM later)"
        overlap = "CAST(NULL AS DOUBLE)" if c in NUMBERS else f"{common} * 1e0 / {every}"
        parts.append(f"""SELECT *, NOT shifted AND abs(change) <= 0.01 AND coalesce(share, 1) >= 0.5 AS ok FROM (
          SELECT '{c}' AS name, false AS one, coalesce({shifted}, false) AS shifted, {nulls('later')} - {nulls('early')} AS change,
          {"CAST(NULL AS BIGINT)" if c in NUMBERS else f"{mine} - {common}"} AS fresh, {overlap} AS share)""")
    return f"""{EV}, early AS (SELECT * FROM tx WHERE timestamp < TIMESTAMP '2024-01-16'),
      later AS (SELECT * REPLACE (amount_usd * 1.5 AS amount_usd, CASE WHEN token_symbol <> 'BTC' THEN token_symbol END AS token_symbol,
        CASE WHEN chain IN ('solana', 'polygon') THEN chain ELSE 'l2-' || chain END AS chain) FROM tx WHERE timestamp >= TIMESTAMP '2024-01-16')
      SELECT "column", one_sided, shifted, {digits('null_change')} AS null_change, new_members, {digits('overlap')} AS overlap, passed FROM (
      {parts[0].replace("SELECT *", 'SELECT name AS "column", one AS one_sided, shifted, change AS null_change, fresh AS new_members, share AS overlap', 1).replace("AS ok", "AS passed")}
      UNION ALL {' UNION ALL '.join(parts[1:])})"""


PAYLOADS = """WITH p AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, day(ts) AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    event_id % 50 = 3 AS broken FROM events),
  fields AS (SELECT day, 'k' AS field, CASE WHEN kind <= 10 THEN 'BIGINT' WHEN kind <= 20 THEN 'STRING' ELSE 'OBJECT<v: BIGINT>' END AS type,
      count(*) AS n FROM p WHERE NOT broken GROUP BY day, kind
    UNION ALL SELECT day, 'tag', 'BOOLEAN', count(*) FROM p WHERE NOT broken AND kind > 10 GROUP BY day)"""


def scaled_sql() -> str:
    parts = []
    for name, (factor, base) in SCALES.items():
        shift = "1e6" if name == "near" else "1e0"
        parts.append(f"""SELECT '{name}' AS scale, {KEYS}, from_address, round({shift} * sd7 / nullif(m7, 0) + 1e-9, 2) + 0e0 AS cv,
          round((x - m) / nullif(sd, 0) + 1e-9, 2) + 0e0 AS zscore FROM (
          SELECT *, avg(x) {HISTORY} AS m, stddev_samp(x) {HISTORY} AS sd, avg(x) {within('7 DAYS')} AS m7, stddev_samp(x) {within('7 DAYS')} AS sd7
          FROM (SELECT *, amount_usd * {factor!r}::DOUBLE + {base!r}::DOUBLE AS x FROM settled))""")
    return f"{EV} " + " UNION ALL ".join(parts)


SCALES_SQL = scaled_sql()


def sources_sql() -> str:
    parts = [f"SELECT {', '.join(TX[:-1])}, '{n}' AS _source FROM tx WHERE chain = '{c}'" for n, c in
             [("ethereum_mainnet", "ethereum"), ("bitcoin_mainnet", "bitcoin"),
              ("polygon_matic", "polygon"), ("solana_mainnet", "solana")]]
    return (f"{EV}, u AS ({' UNION ALL '.join(parts)}) SELECT {ALL} FROM u "
            "WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-20'")


def tagged(source: str, where: str) -> str:
    return f"SELECT {cols(TX[:-1])}, '{source}' AS _source FROM tx WHERE {where}"


ORACLES: dict[str, str] = {
    "src_window": f"{EV} " + tagged(
        "three_chains", "chain IN ('ethereum', 'bitcoin', 'solana') AND timestamp >= TIMESTAMP '2024-01-05' "
        "AND timestamp < TIMESTAMP '2024-01-12'"),
    "src_incremental": f"{EV} " + tagged(
        "everything", "(timestamp >= TIMESTAMP '2024-01-12' AND timestamp < TIMESTAMP '2024-01-20') OR "
        "(timestamp >= TIMESTAMP '2024-01-04 22:30:00' AND timestamp < TIMESTAMP '2024-01-05')"),
    "src_union": sources_sql(),
    "src_normalize": f"{EV} SELECT {ALL} FROM tx",
    "schema_evolve": f"""{EV} SELECT transaction_hash, CAST(block_number AS VARCHAR) AS block_number, timestamp,
        {digits('amount_usd')} AS amount_usd, CAST(0 AS DOUBLE) AS gas_fee_usd, tx_type,
        chain || '-' || token_symbol AS extra FROM tx""",
    "schema_defaults": f"""{EV} SELECT block_number, CAST(0 AS DOUBLE) AS rate, CAST(0 AS BIGINT) AS hops, '' AS memo,
        CAST(NULL AS VARCHAR) AS raw, false AS flag, CAST(NULL AS VARCHAR) AS other FROM tx""",
    "filter_confirmed": f"{EV} SELECT {ALL} FROM tx WHERE status = 'confirmed'",
    "reject_rows": f"{EV} SELECT {ALL} FROM tx WHERE {BAD}",
    "clean_rows": f"{EV} SELECT {ALL} FROM clean",
    "enum_violations": f"""{EV} SELECT {KEYS}, status, chain, {STATUS_BAD} AS bad_status, {CHAIN_BAD} AS bad_chain
        FROM tx WHERE {STATUS_BAD} OR {CHAIN_BAD}""",
    "asof_filter": f"{EV} SELECT {ALL} FROM tx WHERE timestamp <= TIMESTAMP '2024-01-15'",
    "entity_filter": f"{EV} SELECT {ALL} FROM tx WHERE from_address IN ('0x1', '0x2', '0x3')",
    "entity_semi_join": f"""{EV} SELECT {ALL} FROM tx WHERE from_address IN
        (SELECT from_address FROM tx WHERE status = 'unknown')""",
    "feature_projection": f"""{EV} SELECT from_address, {digits('ln(1 + amount_usd)')} AS amount_log,
        {digits('amount_usd + gas_fee_usd')} AS total_cost_usd FROM clean""",
    "dedup_last": f"{EV} SELECT {ALL} FROM ({deduped('tx')})",
    "dedup_first": f"{EV} SELECT {ALL} FROM ({deduped('tx', 'first')})",
    "dedup_none": f"{EV} SELECT {ALL} FROM ({deduped('tx', 'none')})",
    "dedup_last_lineitem": f"{LI} SELECT {ALL} FROM ({deduped('tx')})",
    "dedup_none_lineitem": f"{LI} SELECT {ALL} FROM ({deduped('tx', 'none')})",
    "time_features": f"{EV} SELECT {KEYS}, {TIME_PARTS} FROM tx",
    "time_iso": f"""{EV} SELECT block_number, CASE WHEN timestamp = date_trunc('second', timestamp)
        THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, strftime(date_trunc('hour', timestamp), '%Y-%m-%dT%H:%M:%S') AS hour FROM tx""",
    "time_features_text": f"{EV} SELECT block_number, {TIME_PARTS} FROM tx WHERE timestamp IS NOT NULL",
    "amount_features": f"{EV} SELECT {KEYS}, {AMOUNT_PARTS} FROM clean",
    "rolling_rows_frame": ROWS_FRAME,
    "rolling_rows_chunked": ROWS_FRAME,
    "rolling_labels": f"{EV} SELECT {KEYS}, from_address, {rolled({'3h': 3, '12h': 12, '2d': 48})} FROM settled",
    "rolling_range_frame": RANGE_FRAME,
    "rolling_range_dense": RANGE_FRAME,
    "rolling_range_mixed": RANGE_FRAME,
    "rolling_range_chunked": RANGE_FRAME,
    "transform_chain_rows": f"{EV} SELECT {ALL}, {TIME_PARTS}, {AMOUNT_PARTS}, {rolled(STANDARD)} FROM settled",
    "transform_chain_range": f"""{EV} SELECT {KEYS}, from_address, {digits('ln(1 + amount_usd)')} AS amount_log,
        {ranged()} FROM settled""",
    "transform_chain_lineitem": f"{LI} SELECT {ALL}, {TIME_PARTS}, {AMOUNT_PARTS}, {rolled(STANDARD)} FROM settled",
    "transform_chain_rows_chunked": f"{EV} SELECT {ALL}, {TIME_PARTS}, {AMOUNT_PARTS}, {rolled(STANDARD)} FROM settled",
    "transform_chain_range_chunked": f"""{EV} SELECT {KEYS}, from_address, {digits('ln(1 + amount_usd)')} AS amount_log,
        {ranged()} FROM settled""",
    "rolling_range_hot": f"""{EV}, hot AS (SELECT * REPLACE (CASE WHEN tx_type IN ('transfer', 'swap', 'stake') THEN '0xhot'
        ELSE from_address END AS from_address) FROM settled) SELECT {KEYS}, from_address, {ranged()} FROM hot""",
    "contract_failures": f"""{REPORT} SELECT TIMESTAMP '2024-02-01' AS evaluated_at, (SELECT count(*) FROM tx) AS total_records,
        rule, findings FROM r WHERE findings > 0""",
    "contract_text_columns": f"""{TEXT} SELECT transaction_hash, block_number, timestamp, {digits('amount_usd')} AS amount_usd,
        CASE WHEN {BAD} THEN 'rejected' ELSE 'clean' END AS outcome FROM text""",
    "rule_text_columns": f"""{TEXT} SELECT 'amount_usd_positive' AS rule, f = 0 AS passed, f AS findings, n AS total_records
        FROM (SELECT count(*) FILTER (amount_usd <= 0 OR said = 'n/a') AS f, count(*) AS n FROM text)
        UNION ALL SELECT 'timestamp_in_valid_range', f = 0, f, n FROM (SELECT {FUTURE} + {TOO_OLD} AS f, count(*) AS n FROM text)""",
    "dead_letters_drift": f"""{TEXT} SELECT {KEYS}, {digits('amount_usd')} AS amount_usd, CAST(NULL AS VARCHAR) AS said,
        '20240101' AS batch_id FROM tx WHERE {BAD}
        UNION ALL SELECT transaction_hash, block_number, timestamp, {digits('amount_usd')}, said, '20240102' FROM text WHERE {BAD}""",
    "rule_nulls": rule(EV, "no_nulls_in_key_columns", NULLS,
                       "count(*) FILTER (transaction_hash IS NULL) AS null_hashes, "
                       "count(*) FILTER (timestamp IS NULL) AS null_times, count(*) FILTER (chain IS NULL) AS null_chains"),
    "rule_amount": rule(EV, "amount_usd_positive", "count(*) FILTER (amount_usd <= 0)",
                        "count(*) FILTER (amount_usd <= 0) AS invalid_count, "
                        "round(100.0 * count(*) FILTER (amount_usd <= 0) / greatest(count(*), 1), 3) AS pct"),
    "rule_time": time_rule(EV),
    "rule_time_lineitem": time_rule(LI),
    "rule_status": rule(EV, "status_valid_enum", f"count(*) FILTER ({STATUS_BAD})",
                        f"count(*) FILTER ({STATUS_BAD}) AS invalid_count"),
    "rule_unique": unique_rule(EV),
    "rule_unique_lineitem": unique_rule(LI),
    "rule_chain": rule(EV, "chain_valid_enum", f"count(*) FILTER ({CHAIN_BAD})",
                       f"count(*) FILTER ({CHAIN_BAD}) AS invalid_count"),
    "contract_report": f"{REPORT} SELECT CAST(position AS BIGINT) AS position, rule, findings = 0 AS passed, findings FROM r",
    "contract_custom_rule": f"""{REPORT}, a AS (SELECT position, rule, findings FROM r UNION ALL
        SELECT 6, 'fee_below_amount', f6 FROM m)
        SELECT 'ledger' AS source, count(*) FILTER (findings = 0) AS rules_passed,
        count(*) FILTER (findings > 0) AS rules_failed, bool_and(findings = 0) AS passed,
        string_agg(rule, ',' ORDER BY rule) FILTER (findings > 0) AS failed_rules FROM a""",
    "run_metrics": f"""{EV} SELECT count(*) AS raw_records, count(*) FILTER (NOT {BAD}) AS clean_records,
        count(*) FILTER ({BAD}) AS rejected_records,
        round(100.0 * count(*) FILTER ({BAD}) / greatest(count(*), 1), 3) AS rejection_rate_pct FROM tx""",
    "dead_letter_readback": f"""{EV} SELECT {KEYS}, {digits('amount_usd')} AS amount_usd, 'ledger' AS source,
        CASE WHEN block_number < 500 THEN 'b1' ELSE 'b2' END AS batch_id FROM tx WHERE {BAD}""",
    "snapshot_read": f"{EV}, {SPANS} SELECT CAST(version AS BIGINT) AS version, {ALL} FROM parts JOIN members USING (part)",
    "snapshot_as_of": f"{EV} SELECT {ALL} FROM clean WHERE timestamp < TIMESTAMP '2024-01-21'",
    "snapshot_history": f"""{EV}, {SPANS} SELECT CAST(added AS BIGINT) AS version,
        TIMESTAMP '2024-03-01' + INTERVAL 1 DAY * (added - 1) AS committed_at,
        CASE added WHEN 3 THEN 'OVERWRITE' ELSE 'APPEND' END AS operation, count(*) AS num_records,
        'batch-' || added AS batch_id, CAST(added AS VARCHAR) AS day
        FROM parts JOIN members USING (part) WHERE added = version GROUP BY added""",
    "snapshot_current": f"{EV}, {SPANS} SELECT CAST(max(version) AS BIGINT) AS version FROM members",
    "snapshot_expired": f"""{EV}, {SPANS} SELECT DISTINCT CAST(added AS BIGINT) AS version FROM members
        WHERE added NOT IN (SELECT added FROM members WHERE version IN (3, 4))""",
    "snapshot_vacuumed": f"""{EV}, {SPANS} SELECT CAST(added AS BIGINT) AS _v, {ALL}
        FROM parts JOIN members USING (part) WHERE version = 4""",
    "snapshot_drift": f"""{EV}, {SPANS} SELECT {KEYS},
        CASE WHEN part < 3 THEN {digits('amount_usd')} END AS amount_usd,
        CASE WHEN part = 2 THEN {digits('gas_fee_usd')} END AS gas_fee_usd,
        CASE WHEN part = 3 THEN token_symbol END AS token_symbol FROM parts""",
    "feature_velocity": VELOCITY_SQL,
    "feature_velocity_dense": VELOCITY_SQL,
    "feature_velocity_chunked": VELOCITY_SQL,
    "feature_amounts": AMOUNTS_SQL,
    "feature_amounts_chunked": AMOUNTS_SQL,
    "feature_behavioral": BEHAVIORAL_SQL,
    "feature_behavioral_chunked": BEHAVIORAL_SQL,
    "feature_risk": RISK_SQL,
    "feature_risk_dense": RISK_SQL,
    "feature_risk_chunked": RISK_SQL,
    "feature_network": NETWORK_SQL,
    "feature_network_dense": NETWORK_SQL,
    "feature_network_chunked": NETWORK_SQL,
    "amount_scales": SCALES_SQL,
    "amount_scales_dense": SCALES_SQL,
    "amount_scales_chunked": SCALES_SQL,
    "job_run": f"""{JOBS} SELECT {cols(TX[:-1])}, 'all' AS _source, {TIME_PARTS}, {AMOUNT_PARTS},
        {rolled(STANDARD, 'from_address, window_start')} FROM settled""",
    "job_runs": f"""{JOBS}, w AS (SELECT window_start, count(*) AS raw, count(*) FILTER (NOT {BAD}) AS good FROM win GROUP BY window_start),
        l AS (SELECT window_start, count(*) AS loaded FROM settled GROUP BY window_start),
        f AS (SELECT a.window_start, 5 * sum(b.loaded) AS records FROM l a JOIN l b ON b.window_start <= a.window_start GROUP BY a.window_start)
        SELECT w.window_start AS start_time, w.window_start + INTERVAL 3 DAY AS end_time, status,
        CASE WHEN status = 'success' THEN raw END AS raw_records, CASE WHEN status = 'success' THEN good END AS clean_records,
        CASE WHEN status = 'success' THEN raw - good END AS rejected_records,
        CAST(CASE WHEN status = 'success' THEN CASE w.window_start WHEN TIMESTAMP '2024-01-05' THEN 1 ELSE 2 END END AS BIGINT) AS snapshot_version,
        CAST(CASE WHEN status = 'success' THEN 5 END AS BIGINT) AS feature_groups,
        CAST(CASE WHEN status = 'success' THEN records END AS BIGINT) AS feature_records,
        CAST(CASE WHEN status = 'success' THEN 0 ELSE 1 END AS BIGINT) AS errors
        FROM w JOIN f ON w.window_start = f.window_start
        JOIN (VALUES (TIMESTAMP '2024-01-05', 'success'), (TIMESTAMP '2024-01-08', 'failed'), (TIMESTAMP '2024-01-08', 'success')) s(began, status)
        ON w.window_start = s.began""",
    "job_features": f"""{JOBS}, g(group_name, features) AS (VALUES {', '.join(f"('{g}', {len(f)})" for g, f in FEATURE_GROUPS.items())})
        SELECT group_name, CAST(features AS BIGINT) AS features, (SELECT count(*) FROM settled) AS records FROM g""",
    "snapshot_changes": f"""{EV}, {SPANS.split('members(')[0].rstrip().rstrip(',')},
        held(version, part, n) AS (VALUES (1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 2), (3, 3, 1), (4, 1, 1), (4, 2, 2), (4, 3, 1), (5, 1, 1), (5, 2, 2), (5, 3, 1)),
        spans(span, since, until) AS (VALUES ('1-2', 1, 2), ('2-3', 2, 3), ('1-4', 1, 4), ('4-5', 4, 5)),
        moved AS (SELECT span, p.part, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS n FROM spans CROSS JOIN (VALUES (1), (2), (3)) p(part)
          LEFT JOIN held a ON a.version = since AND a.part = p.part LEFT JOIN held b ON b.version = until AND b.part = p.part)
        SELECT span, {ALL}, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, abs(n) AS copies FROM parts JOIN moved USING (part) WHERE n <> 0""",
    "network_risk_hops": f"""{EV.replace('WITH', 'WITH RECURSIVE', 1)}, labels AS (SELECT address, risk_score + 0.1E0 AS risk FROM ({ADDRESS_LABELS})
          WHERE category IN ('risky', 'mixer') AND CAST(substr(address, 3) AS BIGINT) % 4 = 1),
        edges AS (SELECT DISTINCT CASE WHEN tx_type = 'mint' THEN '0xhub' ELSE '0x' || CAST(substr(from_address, 3) AS BIGINT) % 40 END AS payer,
          CASE tx_type WHEN 'stake' THEN '0xhub' WHEN 'swap' THEN '0xfar' || to_address ELSE '0x' || CAST(substr(to_address, 3) AS BIGINT) % 40 END AS paid FROM clean),
        r(address, risk, hops) AS (SELECT address, risk, 0 FROM labels
          UNION SELECT payer, risk * 0.5E0, hops + 1 FROM r JOIN edges ON paid = r.address WHERE hops < 3)
        SELECT address, {digits('risk')} AS risk, CAST(hops AS BIGINT) AS hops FROM
        (SELECT *, row_number() OVER (PARTITION BY address ORDER BY risk DESC, hops) AS rn FROM r) WHERE rn = 1""",
    "backfill_after_changes": f"""WITH tx AS (SELECT * REPLACE (CASE WHEN block_number = 500 THEN amount_usd + 7 ELSE amount_usd END AS amount_usd)
          FROM ({TX_EVENTS})),
        win AS (SELECT *, date_trunc('day', timestamp) AS window_start FROM tx WHERE NOT {BAD} AND timestamp >= TIMESTAMP '2024-01-01'
          AND timestamp < TIMESTAMP '2024-01-31' AND NOT (timestamp >= TIMESTAMP '2024-01-20' AND timestamp < TIMESTAMP '2024-01-21')),
        settled AS (SELECT * FROM ({deduped('win', keys='transaction_hash, window_start')}) WHERE status = 'confirmed'),
        changed(day) AS (SELECT TIMESTAMP '2024-01-20' UNION SELECT date_trunc('day', timestamp) FROM tx WHERE block_number = 500)
        SELECT CAST(window_start AS TIMESTAMP) AS window_start, EXISTS (SELECT 1 FROM changed WHERE window_start >= day AND window_start <= day + INTERVAL 7 DAY) AS redone,
          {KEYS}, from_address, {ranged()} FROM settled""",
    "schema_variant": f"{PAYLOADS} SELECT day, field, type, n FROM fields",
    "schema_variant_drift": f"""{PAYLOADS} SELECT field, string_agg(DISTINCT type, ' | ' ORDER BY type) AS types, count(*) AS batches,
        (SELECT count(DISTINCT day) FROM fields) - count(*) AS missing FROM fields GROUP BY field
        HAVING count(DISTINCT type) > 1 OR count(*) < (SELECT count(DISTINCT day) FROM fields)""",
    "payload_typed": f"""{PAYLOADS} SELECT event_id, broken, CASE WHEN NOT broken AND kind <= 10 THEN k END AS number,
        CASE WHEN NOT broken AND kind > 20 THEN k END AS nested,
        CASE WHEN NOT broken AND kind <= 10 THEN CAST(k AS VARCHAR) WHEN NOT broken AND kind <= 20 THEN 'n' || k END AS said,
        CASE WHEN NOT broken AND kind > 10 THEN kind <= 20 END AS tag FROM p""",
    "stream_activity": f"""{EV}, hourly AS (SELECT from_address, date_trunc('hour', timestamp) AS pane, amount_usd FROM clean WHERE from_address IS NOT NULL),
        spans AS (SELECT from_address, unnest(generate_series(pane - INTERVAL 23 HOUR, pane, INTERVAL 1 HOUR)) AS window_start, amount_usd FROM hourly)
        SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, from_address, count(*) AS txn_count, {digits('sum(amount_usd)')} AS amount_sum,
        {digits('max(amount_usd)')} AS max_single_txn, count(*) >= 5 AS busy_flag, max(amount_usd) > 100 AS high_value_flag FROM spans GROUP BY ALL""",
    "stream_sessions": f"""{EV}, gaps AS (SELECT *, coalesce(timestamp - {LAST_SEEN} >= INTERVAL 2 DAY, true) AS begins FROM clean WHERE from_address IS NOT NULL),
        numbered AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY from_address ORDER BY {EARLIEST_FIRST} ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
        SELECT from_address, min(timestamp) AS first_time, max(timestamp) AS last_time, max(timestamp) + INTERVAL 2 DAY AS dormant_at,
        count(*) AS txn_count, {digits('sum(amount_usd)')} AS amount_sum FROM numbered GROUP BY from_address, session""",
    "contract_profile": profile_sql(),
    "contract_drift": drift_sql(),
    "job_unique": f"{REPLAYS} SELECT {KEYS}, from_address, status, {rolled(STANDARD, 'from_address, window_start')} FROM settled",
    "feature_asof_join": asked_sql(EV, "AND f.timestamp >= a.asked_at - INTERVAL 3 DAY"),
    "feature_asof_join_hot": asked_sql(over(f"SELECT * REPLACE ({HOT}) FROM ({TX_EVENTS})"), ""),
    "job_feature_values": job_feature_values_sql(),
    "snapshot_compacted": f"""{EV}, {SPANS} SELECT CAST(5 AS BIGINT) AS _v, {ALL} FROM parts JOIN members USING (part) WHERE version = 4""",
    "feature_history": f"{FEATURES} SELECT from_address, timestamp, {V}, TIMESTAMP '2024-02-01' AS _ingested_at FROM known",
    "feature_clustered": f"""{FEATURES} SELECT from_address, timestamp, {V}, TIMESTAMP '2024-02-01' AS _ingested_at FROM known
        WHERE from_address IN ('0x1', '0x2', '0x3')""",
    "feature_named": f"{FEATURES} SELECT from_address, fee_ratio FROM known WHERE from_address IN ('0x1', '0x2', '0x3')",
    "feature_latest": f"{FEATURES} SELECT from_address, timestamp, {V} FROM latest",
    "feature_join": f"{FEATURES} SELECT from_address, {V}, {', '.join(AMOUNTS)} FROM latest",
    "feature_describe": f"""{EV}, g(group_name, features, filled) AS (VALUES
        {', '.join(f"('{g}', {len(f)}, {1 if g in ('transaction_velocity', 'amount_statistics') else 0})" for g, f in FEATURE_GROUPS.items())})
        SELECT group_name, CAST(features AS BIGINT) AS features, filled * (SELECT count(*) FROM settled) AS records FROM g""",
    "feature_totals": f"""{EV} SELECT CAST({len(FEATURE_GROUPS)} AS BIGINT) AS feature_groups,
        CAST({sum(map(len, FEATURE_GROUPS.values()))} AS BIGINT) AS total_features, 2 * count(*) AS total_records FROM settled""",
    "backfill_days": f"""{EV} SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(timestamp) AS raw_records
        FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) s(window_start)
        LEFT JOIN tx ON date_trunc('day', timestamp) = window_start GROUP BY window_start""",
    "backfill_transform": backfilled("2024-01-01", 30, rolled(STANDARD, "from_address, window_start")),
    "backfill_shifted": backfilled(
        "2024-01-10 17:00:00", 20,
        f"count(timestamp) OVER (PARTITION BY from_address, window_start ORDER BY {EARLIEST_FIRST} ROWS UNBOUNDED PRECEDING) AS txn_count_7d, "
        + digits(f"sum(amount_usd) OVER (PARTITION BY from_address, window_start ORDER BY {EARLIEST_FIRST} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)")
        + " AS amount_sum_7d"),
    "load_check": f"""{EV} SELECT count(*) AS records, CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS repeated_hashes,
        count(*) AS expected_records, true AS passed FROM settled""",
    "load_check_failing": f"""{EV} SELECT count(*) AS records, {NULLS} AS null_keys, (SELECT s FROM {SURPLUS}) AS repeated_hashes,
        (SELECT count(*) FROM clean) AS expected_records, false AS passed FROM tx""",
    "stream_ingest": f"{EV} SELECT CASE WHEN {BAD} THEN 'rejected' ELSE 'clean' END AS outcome, {ALL} FROM tx",
    "stream_report": f"{REPORT} SELECT rule, findings, (SELECT count(*) FROM tx) AS total_records FROM r WHERE rule <> 'transaction_hash_unique'",
    "stream_dedup_rows": f"{EV} SELECT {ALL} FROM ({deduped('clean', 'first')})",
    "stream_dedup": f"{EV} SELECT DISTINCT transaction_hash FROM clean",
}
