"""The same queries in SQL for DuckDB, over the same tables.

Written from the definitions, not from the operators: trailing windows are framed lists of amounts,
prior-fraud counts are running sums over steps of a line, histories are resolved cell by cell.
"""

from __future__ import annotations

from knownthen.operators.features import FEATURES
from knownthen.plans.queries import LIMIT, MODEL

NOW = "TIMESTAMP '2024-01-31'"
PAST = "TIMESTAMP '2024-01-20'"
SETTLED = f"{NOW} - INTERVAL 10 DAY"
SETTLED_PAST = f"{PAST} - INTERVAL 10 DAY"
EVER = "TIMESTAMP '9999-12-31'"
LATEST = "TIMESTAMP '9999-01-01'"


def r(x: str) -> str:
    return f"round({x} + 1e-9, 6) + 0.0"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def base(at: str = LATEST) -> str:
    """Logs as known at a system time, with their current and timeline reads."""
    return f"""WITH truth AS (
  SELECT event_id AS id, user_id AS account_id, ts AS txn_ts, date_trunc('day', ts) AS seen, event_id // 3 AS k,
         event_type = 'error' AND event_id % 3 = 0 AS fraud,
         date_trunc('day', ts) + to_days(CAST(2 + (event_id // 3) % 9 AS INTEGER)) AS confirmed,
         ts + to_days(CAST(2 + (event_id // 3) % 9 AS INTEGER)) AS due
  FROM events),
txn_log AS (
  SELECT e.event_id AS id, e.user_id AS account_id, e.ts AS txn_ts, e.value AS amount, e.event_type AS category,
         CAST(CASE WHEN e.event_id % 10 = 0 THEN (c.c_nationkey + 7) % 25 ELSE c.c_nationkey END AS BIGINT) AS country,
         date_trunc('day', e.ts) AS system_from
  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id),
all_labels AS (
  SELECT id, false AS is_fraud, seen AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, seen AS system_from, 0 AS seq, 'put' AS op, 'replayed' AS kind FROM truth
  UNION ALL SELECT id, true, confirmed, NULL, confirmed, 0, 'put', 'replayed' FROM truth WHERE fraud
  UNION ALL SELECT id, false, confirmed + INTERVAL 5 DAY, NULL, confirmed + INTERVAL 5 DAY, 0, 'put', 'replayed' FROM truth WHERE fraud AND k % 7 = 0
  UNION ALL SELECT id, true, confirmed + INTERVAL 10 DAY, NULL, confirmed + INTERVAL 10 DAY, 0, 'put', 'replayed' FROM truth WHERE fraud AND k % 14 = 0
  UNION ALL SELECT id, false, confirmed, confirmed + INTERVAL 2 DAY, confirmed + INTERVAL 4 DAY, 1, 'put', 'corrected' FROM truth WHERE fraud AND k % 5 = 0
  UNION ALL SELECT id, true, seen + INTERVAL 1 DAY, NULL, confirmed + INTERVAL 6 DAY, 2, 'put', 'corrected' FROM truth WHERE fraud AND k % 11 = 0),
label_log AS (SELECT * FROM all_labels WHERE kind = 'replayed' AND system_from <= {NOW} AND system_from <= {at}),
corrected_log AS (SELECT * FROM all_labels WHERE system_from <= {NOW} AND system_from <= {at}),
account_log AS (SELECT * FROM (
  SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS home_country, c_mktsegment AS tier,
         TIMESTAMP '2023-01-01' AS valid_from FROM customer
  UNION ALL SELECT c_custkey, c_name, CAST((c_nationkey + 1) % 25 AS BIGINT), c_mktsegment,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INTEGER)) FROM customer WHERE c_custkey % 4 = 0)
  WHERE valid_from <= {at}),
txn AS (SELECT * FROM txn_log WHERE system_from <= {at}),
label AS (
  SELECT id, is_fraud, system_from FROM label_log
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY system_from DESC, seq DESC) = 1),
label_held AS (
  SELECT a.id, a.is_fraud, a.valid_from, min(b.valid_from) AS valid_to
  FROM label_log a LEFT JOIN label_log b ON b.id = a.id AND b.system_from > a.system_from
  GROUP BY a.id, a.is_fraud, a.valid_from),
account_held AS (
  SELECT a.id, a.name, a.home_country, a.tier, a.valid_from, min(b.valid_from) AS valid_to
  FROM account_log a LEFT JOIN account_log b ON b.id = a.id AND b.valid_from > a.valid_from
  GROUP BY ALL),
pending AS (
  SELECT id, account_id, txn_ts, due FROM truth
  WHERE fraud AND seen <= {at} AND seen <= {NOW} AND confirmed > least({at}, {NOW}))
"""


# cells of valid time by versions of system time, merged into maximal rectangles
RECTANGLES = f""", edges AS (
  SELECT id, valid_from AS e FROM corrected_log UNION SELECT id, coalesce(valid_to, {EVER}) FROM corrected_log),
cells AS (SELECT id, e AS lo, lead(e) OVER (PARTITION BY id ORDER BY e) AS hi FROM edges),
numbered_cells AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lo) AS n FROM cells WHERE hi IS NOT NULL),
believed AS (
  SELECT c.id, c.lo, c.hi, c.n, f.is_fraud, f.system_from, f.seq,
         lead(f.system_from) OVER (PARTITION BY c.id, c.n ORDER BY f.system_from, f.seq) AS system_to
  FROM numbered_cells c JOIN corrected_log f
    ON f.id = c.id AND f.valid_from <= c.lo AND c.hi <= coalesce(f.valid_to, {EVER})),
runs AS (
  SELECT *, n - row_number() OVER (PARTITION BY id, system_from, seq, system_to ORDER BY n) AS run FROM believed
  WHERE system_to IS NULL OR system_from < system_to),
rectangles AS (
  SELECT id, is_fraud, min(lo) AS valid_from, nullif(max(hi), {EVER}) AS valid_to, system_from, system_to
  FROM runs GROUP BY id, is_fraud, system_from, seq, system_to, run)
"""


def prior(anchors: str = "txn", held: str = "label_held", current: str = "label", days: int = 90) -> str:
    """Both prior-fraud counts of each anchor: a fraud counts from one instant to another, so both are running sums
    of steps up and down along the time of an account."""
    after = f"txn_ts + INTERVAL {days} DAY + INTERVAL 1 MICROSECOND"
    return f""", spans AS (
  SELECT account_id, greatest(valid_from, txn_ts + INTERVAL 1 MICROSECOND) AS up, least(coalesce(valid_to, {EVER}), {after}) AS down, 1 AS then_, 0 AS now_
  FROM (SELECT id, valid_from AS valid_from, valid_to FROM {held} WHERE is_fraud) JOIN (SELECT id, account_id, txn_ts FROM txn) USING (id)
  UNION ALL SELECT account_id, txn_ts + INTERVAL 1 MICROSECOND, {after}, 0, 1 FROM txn WHERE id IN (SELECT id FROM {current} WHERE is_fraud)),
line AS (
  SELECT account_id, up AS instant, then_, now_, NULL AS id FROM spans WHERE up < down
  UNION ALL SELECT account_id, down, -then_, -now_, NULL FROM spans WHERE up < down
  UNION ALL SELECT account_id, txn_ts, 0, 0, id FROM {anchors}),
pcf AS (
  SELECT id, instant AS txn_ts, account_id, {big("sum_then")} AS known, {big("sum_now")} AS hindsight
  FROM (SELECT *, sum(then_) OVER so_far AS sum_then, sum(now_) OVER so_far AS sum_now FROM line
        WINDOW so_far AS (PARTITION BY account_id ORDER BY instant RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE id IS NOT NULL)
"""


def z(amount: str, mean: str, std: str, n: str) -> str:
    return (f"CASE WHEN {n} < 5 OR {std} IS NULL OR {std} = 0 THEN 0.0 "
            f"ELSE least(8.0, greatest(-8.0, ({amount} - {mean}) / {std})) END")


def frame(width: str) -> str:
    return (f"(PARTITION BY account_id ORDER BY instant RANGE BETWEEN INTERVAL {width} PRECEDING "
            "AND INTERVAL 1 MICROSECOND PRECEDING)")


def window(txn: str = "txn", fast: str = "24 HOUR", slow: str = "30 DAY") -> str:
    """Trailing count and moments of each transaction, from the list of amounts that its window holds."""
    return f""", w AS (
  SELECT id, account_id, txn_ts, amount, fast, list_count(held) AS n, list_avg(held) AS mean, list_stddev_samp(held) AS std
  FROM (SELECT id, account_id, txn_ts, amount, count(*) OVER brief AS fast, coalesce(list(amount) OVER wide, []) AS held
        FROM (SELECT *, txn_ts::TIMESTAMP AS instant FROM {txn}) WINDOW brief AS {frame(fast)}, wide AS {frame(slow)}))
"""


def extract(at: str = LATEST, until: str = NOW, since: str | None = None, slow: str = "30 DAY", days: int = 90,
            limit: int | None = None, knowledge: str = "known") -> str:
    lower = f" AND txn_ts >= {since}" if since else ""
    cut = f" ORDER BY txn_ts DESC, id DESC LIMIT {limit}" if limit else ""
    return base(at) + window(slow=slow) + prior(days=days) + f""", placed AS (
  SELECT w.*, country, home_country FROM w JOIN (SELECT id, country FROM txn) USING (id)
  ASOF JOIN (SELECT id AS holder, home_country, valid_from FROM account_log) v ON w.account_id = v.holder AND w.txn_ts >= v.valid_from),
feat AS (
  SELECT id, account_id, txn_ts, amount, country, {big("is_fraud")} AS label, n AS n_30d, mean AS mean_30d, std AS std_30d,
         known AS prior_confirmed_fraud_as_known_then, hindsight AS prior_confirmed_fraud_with_hindsight,
         {z("amount", "mean", "std", "n")} AS amount_zscore, fast AS txn_count_24h,
         {big("home_country <> country")} AS "foreign", {knowledge} AS prior_confirmed_fraud
  FROM placed JOIN (SELECT id, is_fraud FROM label) USING (id) JOIN (SELECT id, known, hindsight FROM pcf) USING (id)
  WHERE txn_ts <= {until}{lower}{cut})
"""


FEATURE_COLUMNS = f"""id, account_id, txn_ts, {r("amount")} AS amount, country, label, n_30d, {r("mean_30d")} AS mean_30d,
  {r("std_30d")} AS std_30d, prior_confirmed_fraud_as_known_then, prior_confirmed_fraud_with_hindsight,
  {r("amount_zscore")} AS amount_zscore, txn_count_24h, "foreign", prior_confirmed_fraud"""


def contribution(i: int, value: str | None = None) -> str:
    name = value or f'"{FEATURES[i]}"'
    return f"({MODEL.coef[i]!r}::DOUBLE * (({name} - {MODEL.mean[i]!r}::DOUBLE) / {MODEL.scale[i]!r}::DOUBLE))"


def logit(pcf: str | None = None) -> str:
    return f"({MODEL.intercept!r}::DOUBLE + {' + '.join(contribution(i, pcf if i == 3 else None) for i in range(4))})"


def prob(pcf: str | None = None) -> str:
    return f"(1 / (1 + exp(-{logit(pcf)})))"


def vectors(requests: str, facts: str = "txn JOIN label USING (id)", label: str = "label") -> str:
    """Serving vectors of (req_id, account_id, t, amount, country) rows: requests and facts in one time line per account."""
    return f""", requests AS ({requests}),
mixed AS (
  SELECT account_id, t AS instant, req_id, NULL::DOUBLE AS spent, false AS bad FROM requests
  UNION ALL SELECT account_id, txn_ts, NULL, amount, id IN (SELECT id FROM {label} WHERE is_fraud) FROM (SELECT id, account_id, txn_ts, amount FROM {facts})),
looked AS (
  SELECT req_id, count(*) FILTER (req_id IS NULL) OVER day_ AS txn_count_24h, coalesce(list(spent) FILTER (req_id IS NULL) OVER month_, []) AS held,
         count(*) FILTER (bad) OVER season AS prior_confirmed_fraud
  FROM mixed WINDOW day_ AS {frame("24 HOUR")}, month_ AS {frame("30 DAY")}, season AS {frame("90 DAY")}),
served AS (
  SELECT requests.*, txn_count_24h, list_count(held) AS n_30d, list_avg(held) AS mean_30d, list_stddev_samp(held) AS std_30d, prior_confirmed_fraud
  FROM requests JOIN looked USING (req_id)),
vec AS (
  SELECT s.*, {z("amount", "mean_30d", "std_30d", "n_30d")} AS amount_zscore, {big("coalesce(home_country <> country, false)")} AS "foreign"
  FROM served s ASOF LEFT JOIN (SELECT id AS holder, home_country, valid_from FROM account_log) v ON s.account_id = v.holder AND s.t >= v.valid_from)
"""


LATER_REQUESTS = "SELECT id AS req_id, account_id, txn_ts + INTERVAL 6 HOUR AS t, amount + 10.0 AS amount, country FROM txn"
VECTOR_COLUMNS = f"""req_id, account_id, t, {r("amount")} AS amount, n_30d, {r("mean_30d")} AS mean_30d,
  {r("std_30d")} AS std_30d, {r("amount_zscore")} AS amount_zscore, txn_count_24h, "foreign", prior_confirmed_fraud"""

#: a transaction whose first fraud fact comes after a legit one
CORRECTED = """, opening AS (
  SELECT id, is_fraud, system_from FROM label_log QUALIFY row_number() OVER (PARTITION BY id, is_fraud ORDER BY system_from) = 1),
late AS (
  SELECT id, system_from AS confirmed_at, lag(system_from) OVER (PARTITION BY id ORDER BY system_from, is_fraud) AS first_seen, is_fraud FROM opening),
flips AS (SELECT id, confirmed_at, first_seen FROM late WHERE is_fraud AND first_seen < confirmed_at),
corrected AS (SELECT id, account_id, amount, country, txn_ts AS event_at, confirmed_at FROM txn JOIN flips USING (id))
"""

#: arrivals by tick; a tick is stamped with the newest event time seen so far, and settles what is due by then
TICKED = """, arrivals AS (
  SELECT *, (came >= TIMESTAMP '2024-01-08')::INT + (came >= TIMESTAMP '2024-01-16')::INT + (came >= TIMESTAMP '2024-01-24')::INT AS tick
  FROM (SELECT *, CASE WHEN id % 7 = 0 THEN txn_ts + INTERVAL 3 DAY ELSE txn_ts END AS came FROM truth)),
ticks AS (SELECT tick, max(max(txn_ts)) OVER (ORDER BY tick) AS stamp FROM arrivals GROUP BY tick),
arrived AS (SELECT a.*, stamp FROM arrivals a JOIN ticks USING (tick)),
settled AS (SELECT a.id, min(t.stamp) AS settled FROM arrived a JOIN ticks t ON t.tick >= a.tick AND t.stamp >= a.due WHERE a.fraud GROUP BY a.id)
"""

#: runs of an account without a pause of over eight hours: gaps and islands
BURSTS = """, apart AS (
  SELECT *, coalesce(txn_ts - lag(txn_ts) OVER w > INTERVAL 8 HOUR, true) AS new FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY txn_ts, id)),
island AS (SELECT *, sum(new::INT) OVER (PARTITION BY account_id ORDER BY txn_ts, id ROWS UNBOUNDED PRECEDING) AS k FROM apart),
burst AS (
  SELECT account_id, min(txn_ts) AS start, max(txn_ts) + INTERVAL 8 HOUR AS "end", count(*) AS n, round(sum(amount) + 1e-9, 6) + 0.0 AS amount
  FROM island WHERE account_id IS NOT NULL GROUP BY account_id, k)
"""

STATES = """, states AS (
  SELECT *, CASE WHEN id IN (SELECT id FROM label WHERE is_fraud) THEN 'fraud' WHEN id IN (SELECT id FROM pending) THEN 'pending' ELSE 'legit' END AS state
  FROM txn JOIN (SELECT id, system_from AS learned_at FROM label) USING (id))
"""


def page(at: str, where: str) -> str:
    return base(at) + STATES + f"""SELECT id, account_id, {r("amount")} AS amount, country, txn_ts AS happened_at,
  system_from AS recorded_at, state AS label FROM states WHERE {where} ORDER BY txn_ts DESC, id DESC LIMIT 40"""


def rows(table: str, kind: str, where: str = "true") -> str:
    return f"SELECT '{kind}' AS table_name, * FROM ({table}) WHERE {where}"


LOGS = f""", replay AS (
  SELECT 'account' AS table_name, id, CAST(NULL AS BOOLEAN) AS is_fraud, valid_from, valid_from AS system_from, 'put' AS op FROM account_log
  UNION ALL SELECT 'txn', id, NULL, txn_ts, system_from, 'put' FROM txn_log
  UNION ALL SELECT 'label', id, is_fraud, valid_from, system_from, op FROM label_log
  UNION ALL SELECT 'pending_chargeback', id, NULL, txn_ts, seen, 'put' FROM truth WHERE fraud AND seen <= {NOW}
  UNION ALL SELECT 'pending_chargeback', id, NULL, confirmed, confirmed, 'del' FROM truth WHERE fraud AND confirmed <= {NOW})
"""

IMPACT = f""", burst AS (SELECT * FROM pending WHERE txn_ts < {NOW} AND txn_ts >= {NOW} - INTERVAL 90 DAY),
recent AS (
  SELECT * FROM txn WHERE txn_ts > {NOW} - INTERVAL 120 DAY AND account_id IN (SELECT account_id FROM burst)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_ts DESC, id DESC) <= 4)
""" + vectors("SELECT id AS req_id, account_id, txn_ts AS t, amount, country FROM recent") + f""", moved AS (
  SELECT v.*, (SELECT count(*) FROM burst b WHERE b.account_id = v.account_id AND b.txn_ts < v.t) AS n,
         (SELECT count(*) FROM burst b WHERE b.account_id = v.account_id) AS n_account FROM vec v),
impact AS (
  SELECT account_id, req_id AS txn_id, t AS valid_time, amount, country, {prob()} AS before,
         {prob("(prior_confirmed_fraud + n)")} AS after, n, n_account FROM moved WHERE n > 0
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY round(after - before, 12) DESC, t DESC, req_id DESC) = 1)
"""
IMPACT_COLUMNS = f"""account_id, txn_id, valid_time, {r("amount")} AS amount, country, {r("before")} AS before,
  {r("after")} AS after, {r("after - before")} AS delta, n, n_account, 'fixed-1' AS model_version"""

GAPPED = f""", gapped_log AS (
  SELECT id, is_fraud, valid_from, system_from, 0 AS seq, 'put' AS op FROM all_labels
  WHERE kind = 'replayed' AND system_from <= {NOW}
    AND (id, system_from) IN (SELECT id, seen FROM truth UNION SELECT id, confirmed FROM truth)
  UNION ALL SELECT id, NULL, confirmed + INTERVAL 1 DAY, confirmed + INTERVAL 1 DAY, 1, 'del' FROM truth
  WHERE fraud AND k % 13 = 0 AND confirmed + INTERVAL 1 DAY <= {NOW}),
bounded AS (SELECT id, CASE WHEN confirmed <= {NOW} THEN confirmed + INTERVAL 3 DAY ELSE confirmed END AS ends FROM truth WHERE fraud AND k % 17 = 0),
last_fact AS (
  SELECT id, CASE WHEN op = 'del' THEN valid_from END AS gone FROM gapped_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY system_from DESC, seq DESC) = 1)
"""

NEWEST_SUBJECTS = """SELECT id AS req_id, account_id, txn_ts AS t, amount, country FROM txn
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_ts DESC, id DESC) = 1"""

#: what a query of today's labels counts too much at each decision
LEAKAGE = f""", settled AS (SELECT * FROM txn WHERE txn_ts <= {SETTLED})""" + prior("settled") + """, leak AS (
  SELECT id, account_id, txn_ts, known AS leak_free, hindsight AS pcf_leaky, hindsight - known AS over FROM pcf)
"""

TRAILING = base() + window()
DAILY = "SELECT date_trunc('day', ts) AS day, count(*) AS n, " + r("sum(value)") + " AS amount FROM events GROUP BY 1"
VELOCITY = """SELECT e.event_id AS id, e.user_id AS account_id, e.ts AS txn_ts, count(p.event_id) AS txn_count_24h
FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 24 HOUR
GROUP BY e.event_id, e.user_id, e.ts"""
REGISTRY = base() + """, registry AS (
  SELECT strftime(system_from, '%Y%m%d') AS version, system_from AS trained_at_wall,
         count(*) FILTER (NOT is_fraud) AS n_train, count(*) FILTER (is_fraud) AS n_fraud
  FROM label_log GROUP BY system_from)
"""


NEXT_COMMIT = f"(SELECT greatest({NOW}, max(system_from) + INTERVAL 1 MICROSECOND) FROM label_log)"


def commit(stamp: str, due: str) -> str:
    return base() + f"""SELECT 'label' AS table_name, true AS is_fraud, id, {stamp} AS valid_from, {stamp} AS system_from, 'put' AS op
FROM pending WHERE {due}
UNION ALL SELECT 'pending_chargeback', NULL, id, {stamp}, {stamp}, 'del' FROM pending WHERE {due}"""


def moves() -> str:
    """Both bases in one statement: each side keeps its own prelude."""
    side = lambda at: extract(at, knowledge="hindsight") + f"SELECT id, {prob()} AS p FROM feat"
    return f"""SELECT b.id, {r("a.p")} AS p_from, {r("b.p")} AS p_to
FROM ({side(LATEST)}) b LEFT JOIN ({side(PAST)}) a ON a.id = b.id WHERE a.p IS NULL OR abs(b.p - a.p) > 5e-4"""


def diff() -> str:
    side = lambda at: base(at) + STATES + "SELECT id, account_id, state FROM states"
    return f"""SELECT b.id, b.account_id, a.state AS state_before, b.state AS state_after,
  CASE WHEN a.state IS NULL THEN 'new' ELSE 'corrected' END AS change
FROM ({side(LATEST)}) b LEFT JOIN ({side(PAST)}) a ON a.id = b.id
WHERE a.state IS NULL OR (b.state = 'fraud' AND a.state <> 'fraud')"""


def replay(subjects: str) -> str:
    """Each side reads the label log with the confirmed facts in it, as known at its own instant: before them, with them, and just before their commit."""
    confirmed = f""", stamp AS (SELECT greatest({NOW}, max(s) + INTERVAL 1 MICROSECOND) AS moment FROM (
  SELECT max(system_from) AS s FROM label_log UNION ALL SELECT max(system_from) FROM txn UNION ALL SELECT max(confirmed) FROM truth WHERE fraud AND confirmed <= {NOW})),
confirmed_log AS (SELECT id, is_fraud, system_from, seq FROM label_log UNION ALL SELECT id, true, moment, 0 FROM pending, stamp),
rewound AS (SELECT id, is_fraud FROM confirmed_log, stamp WHERE system_from <= moment - INTERVAL 1 MICROSECOND
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY system_from DESC, seq DESC) = 1),
confirmed_label AS (SELECT id, is_fraud FROM confirmed_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY system_from DESC, seq DESC) = 1)"""
    side = lambda label: (base() + confirmed + vectors(subjects, "txn", label)
                          + f"SELECT req_id, account_id, t, prior_confirmed_fraud AS pcf, {prob()} AS p FROM vec")
    pending = base() + "SELECT id, account_id, txn_ts FROM pending"
    return f"""SELECT b.req_id AS txn_id, b.account_id, {r("b.p")} AS before, {r("a.p")} AS after, {r("c.p")} AS reproduced,
  b.pcf AS pcf_before, a.pcf AS pcf_after, c.pcf AS pcf_reproduced, coalesce(n.n_confirmed, 0) AS n_confirmed,
  coalesce(len(list_filter(n.times, lambda x: x < b.t)), 0) AS n_prior, 'fixed-1' AS model_version
FROM ({side("label")}) b JOIN ({side("confirmed_label")}) a ON a.req_id = b.req_id JOIN ({side("rewound")}) c ON c.req_id = b.req_id
LEFT JOIN (SELECT account_id, count(*) AS n_confirmed, list(txn_ts) AS times FROM ({pending}) GROUP BY account_id) n ON n.account_id = b.account_id"""


def arrival_scores() -> str:
    """Each half of the arrivals, scored with what was known at its newest instant."""
    half, watched = "TIMESTAMP '2024-01-20'", "TIMESTAMP '2024-01-05'"
    def side(test, lower):
        newest = f"(SELECT max(ts) FROM events WHERE ts {test} {half})"
        asked = f"SELECT id AS req_id, account_id, txn_ts AS t, amount, country FROM txn WHERE txn_ts {test} {half} AND txn_ts >= {lower}"
        return base(newest) + vectors(asked) + f"SELECT req_id AS id, {r(prob())} AS p, 'fixed-1' AS model_version FROM vec"
    return f"SELECT * FROM ({side('<', watched)}) UNION ALL SELECT * FROM ({side('>=', half)})"


def store_scores() -> str:
    """Each part of the arrivals, scored when those up to its newest instant have arrived and what is due by then has settled."""
    half, watched = "TIMESTAMP '2024-01-20'", "TIMESTAMP '2024-01-05'"
    def side(test, lower):
        newest = f"(SELECT max(txn_ts) FROM truth WHERE txn_ts {test} {half})"
        known = f""", come AS (SELECT * FROM txn WHERE txn_ts <= {newest}),
decided AS (SELECT id, fraud AND due <= {newest} AS is_fraud FROM truth)"""
        asked = f"SELECT id AS req_id, account_id, txn_ts AS t, amount, country FROM come WHERE txn_ts {test} {half} AND txn_ts >= {lower}"
        return base() + known + vectors(asked, "come", "decided") + f"SELECT req_id AS id, {r(prob())} AS p, 'fixed-1' AS model_version FROM vec"
    return f"SELECT * FROM ({side('<', watched)}) UNION ALL SELECT * FROM ({side('>=', half)})"


def newton_step(k: int) -> str:
    """The next coefficients from those of step k: sums of gradient and Hessian, then a Cholesky solution of five equations."""
    n = range(5)
    low = lambda i, j: f"l{max(i, j)}{min(i, j)}"
    minus = lambda terms: "".join(f" - {t}" for t in terms)
    sums = [f"sum(r * x{i}) AS g{i}" for i in n] + [f"sum(h * x{i} * x{j}) AS h{i}{j}" for i in n for j in n if i <= j]
    levels = []  # each uses columns of the ones before it
    for j in n:
        own = lambda i: f"h{j}{i}{' + 1' if i == j > 0 else ''}" + minus(f"{low(i, m)} * {low(j, m)}" for m in range(j))  # noqa: B023, E731
        levels.append([f"sqrt({own(j)}) AS l{j}{j}"])
        levels.append([f"({own(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, 5)])
    levels += [[f"(g{i}{f' + b{i}' if i else ''}{minus(f'l{i}{m} * u{m}' for m in range(i))}) / l{i}{i} AS u{i}"] for i in n]
    levels += [[f"(u{i}{minus(f'l{m}{i} * d{m}' for m in range(i + 1, 5))}) / l{i}{i} AS d{i}"] for i in reversed(n)]
    solved = f"(SELECT * FROM sums{k}, t{k})"
    for level in filter(None, levels):
        solved = f"(SELECT *, {', '.join(level)} FROM {solved})"
    z = " + ".join(f"b{i} * x{i}" for i in n)
    return f""", sums{k} AS MATERIALIZED (
  SELECT {", ".join(sums)} FROM (SELECT *, w * (p - y) AS r, w * p * (1 - p) AS h FROM (SELECT x.*, 1 / (1 + exp(-({z}))) AS p FROM x, t{k}))),
t{k + 1} AS MATERIALIZED (SELECT {", ".join(f"b{i} - d{i} AS b{i}" for i in n)} FROM {solved})"""


def fitted(steps: int = 9) -> str:
    """Mean and spread of each feature over the part that is learned from, the coefficients after some Newton steps, the rank AUC of the
    held-out part, and the sizes of the whole extract."""
    z = " + ".join(["b0", *[f'b{i} * ("{f}" - m{i}) / s{i}' for i, f in enumerate(FEATURES, 1)]])
    ranked = extract(until=SETTLED) + f""", part AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) > 0.3 * count(*) OVER (PARTITION BY label) AS learns FROM feat),
stats AS MATERIALIZED (SELECT count(*) AS n, sum(label) AS pos, {", ".join(f'avg("{f}") AS m{i}, coalesce(nullif(stddev_pop("{f}"), 0), 1) AS s{i}' for i, f in enumerate(FEATURES, 1))} FROM part WHERE learns),
x AS MATERIALIZED (SELECT label::DOUBLE AS y, CASE WHEN label = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS w, 1.0::DOUBLE AS x0,
  {", ".join(f'("{f}" - m{i}) / s{i} AS x{i}' for i, f in enumerate(FEATURES, 1))} FROM part, stats WHERE learns),
t0 AS MATERIALIZED (SELECT {", ".join(f"0.0::DOUBLE AS b{i}" for i in range(5))})""" + "".join(newton_step(k) for k in range(steps)) + f""",
ranks AS (SELECT label, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS place
          FROM (SELECT label, 1 / (1 + exp(-({z}))) AS z FROM part, stats, t{steps} WHERE NOT learns)),
held AS (SELECT (sum(place) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * count(*) FILTER (label = 0)) AS auc FROM ranks)
"""
    sizes = f"(SELECT count(*) FROM part) AS n_train, (SELECT {big('sum(label)')} FROM part) AS n_fraud"
    one = lambda i, f: f"""SELECT '{f}' AS feature, {r(f"m{i}")} AS mean, {r(f"s{i}")} AS scale, {r(f"b{i}")} AS coef, {r("b0")} AS intercept, {r("auc")} AS auc,
  {sizes}, true AS at_optimum FROM stats, t{steps}, held"""  # noqa: E731
    return ranked + " UNION ALL ".join(one(i, f) for i, f in enumerate(FEATURES, 1))


def stored() -> str:
    def side(name, at, until, when):
        return (extract(at, until) + f"""SELECT '{name}' AS version, {when} AS trained_at_wall, {when} AS trained_at_sim,
  count(*) AS n_train, {big("sum(label)")} AS n_fraud FROM feat""")
    return f"SELECT * FROM ({side('past', PAST, SETTLED_PAST, PAST)}) UNION ALL SELECT * FROM ({side('now', LATEST, SETTLED, NOW)})"


def oracle_sql() -> dict[str, str]:
    training = extract(until=SETTLED)
    return {
        "fact_log_replay": base() + LOGS + "SELECT * FROM replay",
        "facts_per_system_day": base() + LOGS + """SELECT system_from, table_name, count(*) AS facts,
  count(*) FILTER (is_fraud) AS frauds, count(*) FILTER (op = 'del') AS deletes FROM replay GROUP BY 1, 2""",
        "append_facts": base() + f"""SELECT CASE WHEN system_from <= {PAST} THEN {PAST} ELSE {NOW} END AS system_from,
  is_fraud, count(*) AS facts FROM label_log GROUP BY 1, 2""",
        "current_txn": base() + f"SELECT id, account_id, txn_ts, {r('amount')} AS amount, category, country, system_from FROM txn",
        "basis_label_counts": f"""SELECT 'past' AS basis, n, n_fraud FROM ({base(PAST)} SELECT count(*) AS n, count(*) FILTER (is_fraud) AS n_fraud FROM label)
UNION ALL SELECT 'latest', n, n_fraud FROM ({base()} SELECT count(*) AS n, count(*) FILTER (is_fraud) AS n_fraud FROM label)""",
        "account_asof": base() + """SELECT id, name, home_country, tier, valid_from FROM account_held
WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')""",
        "label_timeline": base(PAST) + "SELECT id, is_fraud, valid_from, valid_to FROM label_held",
        "label_intervals": base() + "SELECT id, is_fraud, valid_from, valid_to FROM label_held",
        "label_timeline_corrected": base() + RECTANGLES + "SELECT id, is_fraud, valid_from, valid_to FROM rectangles WHERE system_to IS NULL",
        "label_versions": base() + RECTANGLES + "SELECT id, is_fraud, valid_from, system_from, system_to FROM rectangles WHERE valid_to IS NULL",
        "label_rectangles": base() + RECTANGLES + "SELECT * FROM rectangles",
        "pending_current": base() + "SELECT * FROM pending",
        "pending_at_basis": base(PAST) + "SELECT * FROM pending",
        "basis_bounds": base() + f"""SELECT min(txn_ts) AS valid_min, {NOW} AS valid_now, min(system_from) AS system_min,
  max(system_from) AS system_now FROM txn""",
        "latest_commit": base() + LOGS + "SELECT max(system_from) AS latest_commit FROM replay",
        "anchors_filtered": base() + f"SELECT id, account_id, txn_ts FROM txn WHERE txn_ts BETWEEN {SETTLED_PAST} AND {SETTLED}",
        "settled_anchors": base() + f"SELECT category, count(*) AS n FROM txn WHERE txn_ts <= {SETTLED} GROUP BY 1",
        "txn_state": base() + STATES + "SELECT id, account_id, txn_ts, state, learned_at FROM states",
        "status": base() + f"""SELECT {NOW} AS sim_now, (SELECT count(*) FROM txn) AS n_txn,
  (SELECT count(*) FROM label WHERE is_fraud) AS n_fraud""",
        "accounts": "SELECT c_custkey AS id FROM customer ORDER BY 1",
        "trailing_features": TRAILING + f"""SELECT id, account_id, txn_ts, fast AS txn_count_24h, n AS n_30d, {r("mean")} AS mean_30d,
  {r("std")} AS std_30d, {r(z("amount", "mean", "std", "n"))} AS amount_zscore FROM w""",
        "trailing_features_7d": base() + window(slow="7 DAY") + f"""SELECT id, fast AS txn_count_24h, n AS n_7d, {r("mean")} AS mean_7d,
  {r("std")} AS std_7d, {r(z("amount", "mean", "std", "n"))} AS amount_zscore FROM w""",
        "orders_trailing_features": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS account_id, o_orderdate AS txn_ts,
  o_totalprice AS amount FROM orders)""" + window("o", "90 DAY", "365 DAY") + f"""SELECT id, fast AS n_90d, n AS n_365d,
  {r("mean")} AS mean_365d, {r("std")} AS std_365d, {r(z("amount", "mean", "std", "n"))} AS amount_zscore FROM w""",
        "txn_count_24h": TRAILING + "SELECT fast AS txn_count_24h, count(*) AS txns FROM w GROUP BY 1",
        "amount_zscore": TRAILING + f"""SELECT id, n AS n_30d, {r(z("amount", "mean", "std", "n"))} AS amount_zscore FROM w WHERE n >= 5""",
        "foreign_asof": base() + f"""SELECT t.id, t.country, a.home_country, {big("a.home_country <> t.country")} AS "foreign"
FROM txn t JOIN account_held a ON a.id = t.account_id AND a.valid_from <= t.txn_ts AND (a.valid_to IS NULL OR t.txn_ts < a.valid_to)""",
        "foreign_flag": base() + """SELECT a.home_country, count(*) AS n, count(*) FILTER (a.home_country <> t.country) AS n_foreign
FROM txn t JOIN account_held a ON a.id = t.account_id AND a.valid_from <= t.txn_ts AND (a.valid_to IS NULL OR t.txn_ts < a.valid_to)
GROUP BY 1""",
        "targets": base() + f"SELECT t.id, {big('l.is_fraud')} AS label FROM txn t JOIN label l ON l.id = t.id",
        "pcf_as_known_then": base() + prior() + "SELECT id, known AS prior_confirmed_fraud_as_known_then FROM pcf",
        "pcf_known_14d": base() + prior(days=14) + """SELECT id, known AS prior_confirmed_fraud_as_known_then,
  hindsight AS prior_confirmed_fraud_with_hindsight FROM pcf""",
        "pcf_hindsight": base() + prior() + "SELECT id, hindsight AS prior_confirmed_fraud_with_hindsight FROM pcf",
        "pcf_leaky": base() + prior() + "SELECT id, hindsight AS pcf_leaky FROM pcf",
        "pcf_compare": base(PAST) + prior() + """SELECT id, txn_ts, known AS prior_confirmed_fraud_as_known_then,
  hindsight AS prior_confirmed_fraud_with_hindsight FROM pcf""",
        "pcf_corrected": base() + RECTANGLES + """, held AS (SELECT * FROM rectangles WHERE system_to IS NULL),
  now_held AS (SELECT * FROM held WHERE valid_to IS NULL)""" + prior(held="held", current="now_held") + """SELECT id,
  known AS prior_confirmed_fraud_as_known_then, hindsight AS prior_confirmed_fraud_with_hindsight FROM pcf""",
        "training_set": training + f"SELECT {FEATURE_COLUMNS} FROM feat",
        "training_set_7d": extract(until=SETTLED, since=SETTLED_PAST, slow="7 DAY", days=14) + f"SELECT {FEATURE_COLUMNS} FROM feat",
        "training_set_limited": extract(until=SETTLED, limit=LIMIT) + f"SELECT {FEATURE_COLUMNS} FROM feat",
        "training_set_at_basis": extract(PAST, SETTLED_PAST) + f"SELECT {FEATURE_COLUMNS} FROM feat",
        "leakage_rows": base() + LEAKAGE + "SELECT * FROM leak",
        "leakage_summary": base() + LEAKAGE + f"""SELECT count(*) AS rows, count(*) FILTER (over <> 0) AS differing,
  {big("sum(over)")} AS overcount FROM leak""",
        "leakage_examples": base() + LEAKAGE + """SELECT id, account_id, txn_ts, leak_free, pcf_leaky, over FROM leak
WHERE over > 0 ORDER BY over DESC, id LIMIT 8""",
        "training_totals": base(PAST) + f"""SELECT count(*) AS total_rows, count(*) FILTER (l.is_fraud) AS total_fraud
FROM txn t JOIN label l ON l.id = t.id WHERE t.txn_ts <= {SETTLED_PAST}""",
        "training_sample": base(PAST) + f""", chosen AS (SELECT t.*, l.is_fraud FROM txn t JOIN label l ON l.id = t.id
  WHERE t.txn_ts <= {SETTLED_PAST} ORDER BY t.txn_ts DESC, t.id DESC LIMIT 60)""" + prior("chosen") + f"""SELECT c.id, c.txn_ts,
  c.account_id, {r("c.amount")} AS amount, c.country, {big("c.is_fraud")} AS label, p.known AS prior_confirmed_fraud_as_known_then,
  p.hindsight AS prior_confirmed_fraud_with_hindsight, p.known <> p.hindsight AS differs FROM chosen c JOIN pcf p ON p.id = c.id""",
        "serve_maintained": base() + vectors(LATER_REQUESTS) + f"SELECT {VECTOR_COLUMNS} FROM vec",
        "serve_batch": base() + vectors(LATER_REQUESTS) + f"SELECT {VECTOR_COLUMNS} FROM vec",
        "serve_vector": base(PAST) + vectors(LATER_REQUESTS.replace("FROM txn", "FROM txn_log"), "txn") + f"SELECT {VECTOR_COLUMNS} FROM vec",
        "train_serve_parity": base() + """SELECT count(*) AS n, 0::BIGINT AS amount_zscore_differs, 0::BIGINT AS txn_count_24h_differs,
  0::BIGINT AS foreign_differs, 0::BIGINT AS prior_confirmed_fraud_differs FROM txn JOIN label USING (id)""",
        "explain": training + "SELECT id, " + ", ".join(
            f"{r(contribution(i))} AS contrib_{f}" for i, f in enumerate(FEATURES))
        + f", {r(repr(MODEL.intercept) + '::DOUBLE')} AS intercept, {r(logit())} AS logit, {r(prob())} AS prob FROM feat",
        "verdicts": training + f"SELECT CASE WHEN {prob()} >= 0.5 THEN 'fraud' ELSE 'legit' END AS verdict, label, count(*) AS n FROM feat GROUP BY 1, 2",
        "auc": training + f""", s AS (SELECT label, {prob()} AS p FROM feat),
  k AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s)
SELECT {r("(sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))")} AS auc FROM k""",
        "score_recent": extract() + f"SELECT id, {r(prob())} AS p FROM feat",
        "score_account": extract(knowledge="hindsight") + f"SELECT account_id, id, {r(prob())} AS p FROM feat",
        "scored_frame": extract(limit=LIMIT) + f"""SELECT id, txn_ts, label, {r("amount_zscore")} AS amount_zscore, txn_count_24h, "foreign",
  prior_confirmed_fraud, {r(prob())} AS p FROM feat""",
        "score_moves": moves(),
        "train_test_split": base() + f"""SELECT t.id, {big("l.is_fraud")} AS label,
  row_number() OVER (PARTITION BY l.is_fraud ORDER BY md5(CAST(t.id AS VARCHAR)), t.id)
    <= 0.3 * count(*) OVER (PARTITION BY l.is_fraud) AS is_test
FROM txn t JOIN label l ON l.id = t.id WHERE t.txn_ts <= {SETTLED}""",
        "train_guard": base() + f""", c AS (SELECT count(*) AS n, count(*) FILTER (l.is_fraud) AS n_fraud
  FROM txn t JOIN label l ON l.id = t.id WHERE t.txn_ts <= {SETTLED})
SELECT n, n_fraud, n_fraud >= 5 AS can_train, n_fraud >= 2 AND n - n_fraud >= 2 AS can_fit FROM c""",
        "fit_metrics": fitted(),
        "model_store": training + "SELECT id, true AS same_score, 'stored-1' AS model_version FROM feat",
        "model_registry": stored(),
        "registry_latest": REGISTRY + "SELECT * FROM registry ORDER BY trained_at_wall DESC LIMIT 1",
        "registry_version": REGISTRY + "SELECT * FROM registry WHERE version = '20240115'",
        "corrections": base() + CORRECTED + f"SELECT id, account_id, {r('amount')} AS amount, country, event_at, confirmed_at FROM corrected",
        "corrections_feed": base() + CORRECTED + f"""SELECT id, account_id, {r("amount")} AS amount, country, event_at, confirmed_at
FROM corrected ORDER BY confirmed_at DESC, id DESC LIMIT 40""",
        "activity_feed": base() + CORRECTED + f""", items AS (
  SELECT * FROM (SELECT id, account_id, amount, country, 'txn' AS kind, txn_ts AS happened_at, system_from AS learned_at
    FROM txn ORDER BY system_from DESC, id DESC LIMIT 40)
  UNION ALL SELECT * FROM (SELECT id, account_id, amount, country, 'correction', event_at, confirmed_at
    FROM corrected ORDER BY confirmed_at DESC, id DESC LIMIT 40))
SELECT id, account_id, {r("amount")} AS amount, country, kind, happened_at, learned_at FROM items
ORDER BY learned_at DESC, id DESC, kind LIMIT 40""",
        "data_head": page(LATEST, f"txn_ts < {NOW} AND txn_ts >= {NOW} - INTERVAL 1 DAY"),
        "data_head_scored": f"""SELECT h.*, s.p, true AS live FROM ({page(LATEST, f"txn_ts < {NOW} AND txn_ts >= {NOW} - INTERVAL 1 DAY")}) h
LEFT JOIN ({extract()} SELECT id, {r(prob())} AS p FROM feat) s ON s.id = h.id
UNION ALL SELECT *, NULL, false FROM ({page(PAST, f"txn_ts < {PAST} AND txn_ts >= {PAST} - INTERVAL 1 DAY")})""",
        "data_head_at_basis": page(PAST, f"txn_ts < {PAST} AND txn_ts >= {PAST} - INTERVAL 1 DAY"),
        "data_page": page(LATEST, "(txn_ts, id) < (TIMESTAMP '2024-01-15 12:00:00', 0)"),
        "basis_diff": diff(),
        "audit_candidates": base() + f"""SELECT p.id AS fraud_id, p.account_id, p.txn_ts AS fraud_ts, t.id AS later_id,
  t.txn_ts AS later_ts, {r("t.amount")} AS amount, t.country
FROM pending p JOIN txn t ON t.account_id = p.account_id AND t.txn_ts > p.txn_ts
ORDER BY t.txn_ts DESC, t.id DESC, p.id DESC LIMIT 40""",
        "pending_accounts": base() + "SELECT DISTINCT account_id FROM pending",
        "pending_burst": base() + f"SELECT * FROM pending WHERE txn_ts < {NOW} AND txn_ts >= {NOW} - INTERVAL 90 DAY",
        "account_history": f"""SELECT h.account_id, h.id, h.txn_ts AS ts, {r("h.amount")} AS amount, h.country, h.state, h.learned_at, {r("s.p")} AS p
FROM ({base()}{STATES} SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_ts DESC, id DESC) <= 30) h
LEFT JOIN ({extract(knowledge="hindsight")} SELECT id, {prob()} AS p FROM feat) s ON s.id = h.id""",
        "impact_per_account": base() + IMPACT + f"SELECT {IMPACT_COLUMNS} FROM impact",
        "impactful_cases": base() + IMPACT + f"""SELECT {IMPACT_COLUMNS} FROM impact WHERE after - before > 0.02
ORDER BY round(after - before, 12) DESC, account_id LIMIT 12""",
        "subject_impact": base() + vectors("SELECT id AS req_id, account_id, txn_ts AS t, amount, country FROM txn") + f""", moved AS (
  SELECT v.*, (SELECT count(*) FROM pending b WHERE b.account_id = v.account_id AND b.txn_ts < v.t) AS n FROM vec v)
SELECT account_id, req_id AS txn_id, t AS valid_time, {r("amount")} AS amount, country, {r(prob())} AS before,
  {r(prob("(prior_confirmed_fraud + n)"))} AS after, {r(prob("(prior_confirmed_fraud + n)") + " - " + prob())} AS delta, n,
  (SELECT count(*) FROM pending b WHERE b.account_id = moved.account_id) AS n_account,
  req_id IN (SELECT id FROM pending) AS self_pending, 'fixed-1' AS model_version FROM moved""",
        "confirm_account": commit(NEXT_COMMIT, "true"),
        "settle_due": commit(f"({NOW} + INTERVAL 4 DAY)", f"due <= {NOW} + INTERVAL 4 DAY"),
        "replay_before_after": replay(NEWEST_SUBJECTS),
        "replay_all_before_after": replay("SELECT id AS req_id, account_id, txn_ts AS t, amount, country FROM txn"),
        "unlabelled_txns": base() + GAPPED + """SELECT t.id, t.account_id, t.txn_ts FROM txn t
WHERE id IN (SELECT id FROM last_fact WHERE gone IS NOT NULL UNION SELECT id FROM bounded)""",
        "finite_tail_labels": base() + GAPPED + "SELECT id, coalesce(gone, ends) AS ends FROM last_fact LEFT JOIN bounded USING (id) WHERE gone IS NOT NULL OR ends IS NOT NULL",
        "label_time_mismatch": base() + """SELECT is_fraud, count(*) AS n FROM corrected_log WHERE valid_from <> system_from GROUP BY 1""",
        "daily_activity": DAILY,
        "velocity_sliding": """SELECT user_id AS account_id, w AS window_start, count(*) AS n FROM (
  SELECT user_id, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events)
GROUP BY 1, 2""",
        "stream_ingest": base() + TICKED + """SELECT 'txn' AS table_name, id, CAST(NULL AS BOOLEAN) AS is_fraud, txn_ts AS valid_from, stamp AS system_from, 'put' AS op FROM arrived
UNION ALL SELECT 'label', id, false, stamp, stamp, 'put' FROM arrived
UNION ALL SELECT 'label', id, true, settled, settled, 'put' FROM settled
UNION ALL SELECT 'pending', id, NULL, txn_ts, stamp, 'put' FROM arrived WHERE fraud
UNION ALL SELECT 'pending', id, NULL, settled, settled, 'del' FROM settled""",
        "stream_settle": base() + """, late AS (SELECT *, CASE WHEN id % 7 = 0 THEN txn_ts + INTERVAL 3 DAY ELSE txn_ts END AS arrived FROM truth)
SELECT id, account_id, due, greatest(due, arrived) AS settled_at FROM late
WHERE fraud AND (due <= arrived OR epoch_ms(due) < epoch_ms((SELECT max(arrived) FROM late)))""",
        "stream_confirm_join": base() + """SELECT t.id, t.txn_ts, min(l.system_from) AS confirmed_at FROM truth t
JOIN label_log l ON l.id = t.id AND l.is_fraud GROUP BY t.id, t.txn_ts""",
        "stream_velocity": VELOCITY,
        "stream_score": arrival_scores(),
        "stream_score_store": store_scores(),
        "burst_sessions": base() + BURSTS + "SELECT * FROM burst",
        "stream_burst_sessions": base() + BURSTS + """SELECT * FROM burst
WHERE epoch_ms("end") <= (SELECT epoch_ms(max(txn_ts)) FROM txn) - 3 * 86400000""",
        "confirm_committed": base() + f"""SELECT 'label' AS table_name, true AS is_fraud, id, {NOW} + INTERVAL 1 MICROSECOND AS system_from, 'put' AS op FROM pending
UNION ALL SELECT 'pending_chargeback', NULL, id, {NOW} + INTERVAL 1 MICROSECOND, 'del' FROM pending""",
        "stream_corrections": base() + CORRECTED + "SELECT * FROM flips",
        "stream_dedup": f"SELECT event_id AS id, user_id AS account_id, ts AS txn_ts, {r('value')} AS amount FROM events",
        "stream_daily": DAILY,
    }
