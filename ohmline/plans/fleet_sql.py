"""SQL of the fleet queries, in the plainest form: complements by filters, slices by range joins."""

from __future__ import annotations

from ohmline.plans import standins as I

NO_DAEMONS = "app <> 'app0' AND NOT starts_with(app, 'app1')"
RATES_OUT = "uuid, os, model, round(time1, 3) AS time1, round(time2, 3) AS time2, round(rate, 9) AS rate, round(rate_lo, 9) AS rate_lo, round(rate_hi, 9) AS rate_hi"
DIST = "CASE WHEN ev = 0 AND ev_neg = 0 THEN 0 WHEN ev <> 0 THEN 1 - ev_neg / ev END"
CMP_OUT = f"round(ev, 8) AS ev, round(ev_neg, 8) AS ev_neg, round({DIST}, 5) AS distance"
HISTORY = I.ASOF + """, u AS (SELECT uuid, time, unnest(['level', 'state', 'event', 'model', 'os', 'apps', 'kind']) AS feature,
  unnest([round(level * 100)::BIGINT::VARCHAR, state, event, model, os, array_to_string(apps, ' '), kind[1]]) AS value FROM a
  UNION ALL SELECT uuid, time, 'wifi', array_to_string(wifi, ' ') FROM a WHERE wifi IS NOT NULL),
h AS (SELECT uuid, feature, time, value FROM (SELECT *, lag(value) OVER w AS b, row_number() OVER w AS k FROM u WINDOW w AS (PARTITION BY uuid, feature ORDER BY time, value)) WHERE k = 1 OR value IS DISTINCT FROM b)"""
HIST = """, g20 AS (SELECT flag, b AS bucket FROM (SELECT DISTINCT flag FROM d), range(20) t(b)),
h AS (SELECT flag, least(floor(x / 105.0 * 20), 19)::INT AS bucket, sum(p) AS mass FROM d GROUP BY ALL),
eq AS (SELECT flag, bucket::INT AS bucket, coalesce(mass, 0) AS mass FROM g20 LEFT JOIN h USING (flag, bucket))"""
LOGH = """, g20 AS (SELECT flag, b AS bucket FROM (SELECT DISTINCT flag FROM d), range(20) t(b)),
h AS (SELECT flag, least(greatest(trunc(20 - ln(105.5 / x) / (ln(105.5 / 0.7) / 20)), 0), 19)::INT AS bucket, sum(p) AS mass FROM d GROUP BY ALL),
lg AS (SELECT flag, bucket::INT AS bucket, coalesce(mass, 0) AS mass FROM g20 LEFT JOIN h USING (flag, bucket))"""


def centre(top: str, smallest: str) -> str:
    step = f"(ln({top} / {smallest}) / 20)"
    return f"((CASE WHEN bucket = 0 THEN 0 ELSE {top} * exp(-{step} * (20 - bucket)) END + {top} * exp(-{step} * (19 - bucket))) / 2)"


RANGES = """, rg AS (SELECT os, coalesce(rate_lo, rate) AS lo, coalesce(rate_hi, rate) AS hi FROM r), mx AS (SELECT max(hi) AS xm FROM rg)"""
RANGE_HIST = I.PAIRS + RANGES + """, g20 AS (SELECT os, b AS bucket, xm, {edges} FROM (SELECT DISTINCT os FROM rg), range(20) t(b), mx),
parts AS (SELECT g20.os, bucket, CASE WHEN lo = hi THEN 1.0::DOUBLE ELSE greatest(least(hi, e) - greatest(lo, s), 0) / (hi - lo) END AS part FROM g20 JOIN rg ON g20.os IS NOT DISTINCT FROM rg.os AND
  CASE WHEN lo = hi THEN {place} = bucket ELSE lo < e AND hi > s END),
sums AS (SELECT os, bucket, sum(part) AS mass FROM parts GROUP BY ALL)
SELECT g20.os, g20.bucket::INT AS bucket, round(coalesce(mass, 0) / sum(mass) OVER (PARTITION BY g20.os), {digits}) AS mass FROM g20 LEFT JOIN sums ON g20.os IS NOT DISTINCT FROM sums.os AND g20.bucket = sums.bucket"""
STEP = "(ln(xm / 0.00001) / 20)"
KS = I.PRICES + """, pairs(flags, one, two) AS (VALUES ('AN', 'A', 'N'), ('AR', 'A', 'R'), ('NR', 'N', 'R')),
a AS (SELECT flags, x, p FROM pairs JOIN d ON flag = one), n AS (SELECT flags, x, p FROM pairs JOIN d ON flag = two),
k AS (SELECT DISTINCT flags, x FROM (SELECT flags, x FROM a UNION ALL SELECT flags, x FROM n)),
f AS (SELECT k.flags, k.x, coalesce((SELECT sum(p) FROM n WHERE n.flags = k.flags AND n.x <= k.x), 0) - coalesce((SELECT sum(p) FROM a WHERE a.flags = k.flags AND a.x <= k.x), 0) AS diff,
             (SELECT max(x) FROM a WHERE a.flags = k.flags AND a.x <= k.x) AS la, (SELECT max(x) FROM n WHERE n.flags = k.flags AND n.x <= k.x) AS lb FROM k)"""

USERS = "(SELECT count(DISTINCT uuid) FROM pt)"
#: Operating systems and models with rates on both sides, as (nature, what, key1, key2).
GROUPS = "".join(
    f" UNION ALL SELECT '{k}', '{what}', {k}, NULL FROM (SELECT {k}, sum(mass) AS m FROM pt GROUP BY {k}) WHERE m > 0 AND (SELECT sum(mass) FROM pt) - m > 0" for k, what in (("os", "OS "), ("model", "Model "))
)
APPS = I.POINTS + f""", ex AS (SELECT rate_id, uuid, os, model, time2, mass, mean, unnest(apps) AS app FROM pt), xa AS (SELECT * FROM ex WHERE {NO_DAEMONS}),
uw AS (SELECT app, count(DISTINCT uuid) AS users_with FROM xa GROUP BY app),
na AS (SELECT app, uuid FROM (SELECT DISTINCT app FROM xa) q, pt WHERE NOT list_contains(pt.apps, q.app) GROUP BY app, uuid),
un AS (SELECT app, count(*) AS users_without FROM na GROUP BY app),
au AS (SELECT app, users_with, coalesce(users_without, 0) AS users_without FROM uw LEFT JOIN un USING (app)),
ca AS (SELECT app, users_with, users_without, (SELECT sum(mass * mean) / sum(mass) FROM pt WHERE list_contains(pt.apps, au.app)) AS ev, (SELECT sum(mass * mean) / sum(mass) FROM pt WHERE NOT list_contains(pt.apps, au.app)) AS ev_neg FROM au),
hg AS (SELECT *, {DIST} AS distance FROM ca WHERE users_with >= 5 AND users_without >= 5 AND {DIST} > 0)"""
BUGS = APPS + f""", el AS (SELECT app FROM au WHERE users_with >= 5 AND users_without >= 5 AND app NOT IN (SELECT app FROM hg)),
nw AS (SELECT xa.app, xa.uuid, count(*) AS n, sum(mass * mean) / nullif(sum(mass), 0) AS ev FROM xa JOIN el USING (app) JOIN cu ON cu.uuid = xa.uuid AND cu.os IS NOT DISTINCT FROM xa.os GROUP BY xa.app, xa.uuid),
bg AS (SELECT nw.*, (SELECT sum(mass * mean) / nullif(sum(mass), 0) FROM xa WHERE xa.app = nw.app AND xa.uuid <> nw.uuid) AS ev_neg FROM nw),
bb AS (SELECT *, {DIST} AS distance FROM bg WHERE ev IS NOT NULL AND ev_neg IS NOT NULL AND {DIST} > 0)"""
PROFILE = I.POINTS + f""", ua AS (SELECT DISTINCT uuid, app FROM (SELECT pt.uuid, unnest(apps) AS app FROM pt JOIN cu ON cu.uuid = pt.uuid AND cu.os IS NOT DISTINCT FROM pt.os) WHERE {NO_DAEMONS}),
up AS (SELECT pt.uuid, count(*) AS n_rates, sum(mass * mean) / nullif(sum(mass), 0) AS ev FROM pt JOIN cu ON cu.uuid = pt.uuid AND cu.os IS NOT DISTINCT FROM pt.os GROUP BY pt.uuid),
pf AS (SELECT up.*, (SELECT count(*) FROM ua WHERE ua.uuid = up.uuid) AS n_apps, (SELECT sum(mass * mean) / nullif(sum(mass), 0) FROM pt WHERE pt.uuid <> up.uuid) AS ev_neg FROM up WHERE ev IS NOT NULL)"""


def lb(xm: str) -> str:
    return f"(CASE WHEN x > 0 THEN least(greatest(trunc(100 - ln({xm} / x) / (ln({xm} / 0.0001) / 100)), 0), 99) ELSE 0 END)::INT"


TEXT = "string_agg(b::VARCHAR || ':' || floor({w} / t * 10000 + 0.500001)::BIGINT::VARCHAR, ',' ORDER BY b)"
D30_SIDE = f"(SELECT {TEXT.format(w='w')} FROM (SELECT *, sum(w) OVER () AS t FROM (SELECT {lb('xmax')} AS b, sum(w) AS w FROM fq, z WHERE {{}}list_contains(apps, 'app3') GROUP BY 1)))"


def sides(own: str, total: str, keys: str) -> str:
    """Texts of both sides of each key, of tables (keys, b, w)."""
    one = f"(SELECT {keys}, {TEXT.format(w='w')} AS prob FROM (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS t FROM {own} WHERE w > 1e-9) GROUP BY {keys})"
    same = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in keys.split(", "))
    two = f"(SELECT {keys}, {TEXT.format(w='w')} AS prob_neg FROM (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS t FROM {total} WHERE w > 1e-9) GROUP BY {keys})"
    return f"SELECT o.*, prob_neg FROM {one} o LEFT JOIN {two} n ON {same}"


STORED = BUGS + PROFILE[len(I.POINTS) :] + I.FREQS[len(I.POINTS) :] + f""", us AS (SELECT uuid, list(app) AS al FROM ua GROUP BY uuid HAVING count(*) > 1),
sm AS (SELECT us.uuid, pt.rate_id, pt.mass, pt.mean, len(list_intersect(al, apps)) >= ln(len(al)) AS sim FROM us, pt),
cp AS (SELECT uuid, sum(mass * mean) FILTER (sim) / nullif(sum(mass) FILTER (sim), 0) AS ev, sum(mass * mean) FILTER (NOT sim) / nullif(sum(mass) FILTER (NOT sim), 0) AS ev_neg FROM sm GROUP BY uuid),
gm AS (SELECT max(x) AS gx FROM fq),
fb AS (SELECT rate_id, any_value(uuid) AS uuid, any_value(os) AS os, any_value(model) AS model, any_value(apps) AS apps, {lb('gx')} AS b, sum(w) AS w FROM fq, gm GROUP BY rate_id, {lb('gx')}),
ft AS (SELECT b, sum(w) AS w FROM fb GROUP BY b),
go AS (SELECT 'os' AS nature, os AS k, b, sum(w) AS w FROM fb GROUP BY ALL UNION ALL SELECT 'model', model, b, sum(w) FROM fb GROUP BY ALL
       UNION ALL SELECT 'hog', app, b, sum(w) FROM (SELECT unnest(apps) AS app, b, w FROM fb) WHERE app IN (SELECT app FROM hg) GROUP BY ALL
       UNION ALL SELECT 'similar', sm.uuid, b, sum(w) FROM sm JOIN fb USING (rate_id) WHERE sim GROUP BY ALL),
gr AS (SELECT z.nature, z.k, ft.b, ft.w - coalesce(go.w, 0) AS w FROM (SELECT DISTINCT nature, k FROM go) z CROSS JOIN ft LEFT JOIN go ON go.nature = z.nature AND go.k IS NOT DISTINCT FROM z.k AND go.b = ft.b),
ga AS ({sides('go', 'gr', 'nature, k')}),
ux AS (SELECT uuid, os, x, sum(w) AS w FROM fq GROUP BY ALL),
ut AS (SELECT uuid, max(x) AS top FROM ux GROUP BY uuid),
pr AS (SELECT n.uuid, greatest(n.top, (SELECT max(top) FROM ut WHERE ut.uuid <> n.uuid)) AS xm FROM (SELECT ux.uuid, max(x) AS top FROM ux JOIN cu ON cu.uuid = ux.uuid AND cu.os IS NOT DISTINCT FROM ux.os GROUP BY ux.uuid) n),
ro AS (SELECT ux.uuid, {lb('xm')} AS b, sum(w) AS w FROM ux JOIN cu ON cu.uuid = ux.uuid AND cu.os IS NOT DISTINCT FROM ux.os JOIN pr ON pr.uuid = ux.uuid GROUP BY 1, 2),
rm AS (SELECT ux.uuid, {lb('xm')} AS b, sum(w) AS w FROM ux JOIN pr ON pr.uuid = ux.uuid GROUP BY 1, 2),
rt AS (SELECT xm, {lb('xm')} AS b, sum(w) AS w FROM ux, (SELECT DISTINCT xm FROM pr) GROUP BY 1, 2),
rr AS (SELECT pr.uuid, rt.b, rt.w - coalesce(rm.w, 0) AS w FROM pr JOIN rt USING (xm) LEFT JOIN rm ON rm.uuid = pr.uuid AND rm.b = rt.b),
rp AS ({sides('ro', 'rr', 'uuid')}),
ax AS (SELECT app, uuid, os, x, sum(w) AS w FROM (SELECT unnest(apps) AS app, uuid, os, x, w FROM fq) WHERE app IN (SELECT app FROM bb) GROUP BY ALL),
axt AS (SELECT app, uuid, max(x) AS top FROM ax GROUP BY ALL),
br AS (SELECT n.app, n.uuid, greatest(n.top, (SELECT max(top) FROM axt WHERE axt.app = n.app AND axt.uuid <> n.uuid)) AS xm
       FROM (SELECT ax.app, ax.uuid, max(x) AS top FROM ax JOIN cu ON cu.uuid = ax.uuid AND cu.os IS NOT DISTINCT FROM ax.os GROUP BY ALL) n SEMI JOIN bb ON bb.app = n.app AND bb.uuid = n.uuid),
bo AS (SELECT ax.app, ax.uuid, {lb('xm')} AS b, sum(w) AS w FROM ax JOIN cu ON cu.uuid = ax.uuid AND cu.os IS NOT DISTINCT FROM ax.os JOIN br ON br.app = ax.app AND br.uuid = ax.uuid GROUP BY 1, 2, 3),
bm AS (SELECT ax.app, ax.uuid, {lb('xm')} AS b, sum(w) AS w FROM ax JOIN br ON br.app = ax.app AND br.uuid = ax.uuid GROUP BY 1, 2, 3),
bt AS (SELECT ax.app, xm, {lb('xm')} AS b, sum(w) AS w FROM ax JOIN (SELECT DISTINCT app, xm FROM br) d ON d.app = ax.app GROUP BY 1, 2, 3),
bx AS (SELECT br.app, br.uuid, bt.b, bt.w - coalesce(bm.w, 0) AS w FROM br JOIN bt ON bt.app = br.app AND bt.xm = br.xm LEFT JOIN bm ON bm.app = br.app AND bm.uuid = br.uuid AND bm.b = bt.b),
bp AS ({sides('bo', 'bx', 'app, uuid')})"""
EVS = """SELECT {key} AS key, sum(mass * mean) / nullif(sum(mass), 0) AS ev, (SELECT sum(mass * mean) / nullif(sum(mass), 0) FROM pt b WHERE b.{key} IS DISTINCT FROM a.{key}) AS ev_neg FROM pt a GROUP BY {key}"""


def compare(key: str) -> str:
    return I.POINTS + f"""SELECT {key}, n, {CMP_OUT} FROM (SELECT {key}, count(*) AS n, sum(mass * mean) / nullif(sum(mass), 0) AS ev,
      (SELECT sum(mass * mean) / nullif(sum(mass), 0) FROM pt b WHERE b.{key} IS DISTINCT FROM a.{key}) AS ev_neg FROM pt a GROUP BY {key}) WHERE ev IS NOT NULL AND ev_neg IS NOT NULL""".replace("SELECT", " SELECT", 1)


def indicator(table: str, kind: str, extra: str = "") -> str:
    keys = f"{extra}, " if extra else ""
    same = f"b.{extra} = a.{extra}" if extra else "true"
    return f"""SELECT {keys}'{kind}' AS kind, {kind} AS value, round((SELECT CASE WHEN stddev_pop(b.mean) > 1e-12 AND stddev_pop((b.{kind} IS NOT DISTINCT FROM a.{kind})::INT) > 1e-12 THEN corr(b.mean, (b.{kind} IS NOT DISTINCT FROM a.{kind})::INT) END FROM {table} b WHERE {same}), 5) AS r FROM (SELECT DISTINCT {keys}{kind} FROM {table}) a"""


def with_(text: str) -> str:
    return f"WITH {text}"


P5 = f"""{I.SAMPLES}, q AS (SELECT uuid, lag(time) OVER w AS time1, time AS time2, lag(level) OVER w AS level1, level AS level2, lag(event) OVER w AS event1, event AS event2, lag(state) OVER w AS state1, state AS state2
  FROM s WHERE uuid = '7' WINDOW w AS (PARTITION BY uuid ORDER BY time, event, level)),
p AS (SELECT *, (level1 - level2) * 100 / (time2 - time1) AS drain, event1 = 'batterylevelchanged' AND event2 = 'batterylevelchanged' AS point, greatest(((level1 - level2) - 0.05) * 100 / (time2 - time1), 0) AS lo, ((level1 - level2) + 0.05) * 100 / (time2 - time1) AS hi FROM q WHERE time1 IS NOT NULL AND time1 <> time2)
SELECT uuid, 'v9' AS os, 'm9' AS model, round(time1, 3) AS time1, round(time2, 3) AS time2, round(CASE WHEN point THEN drain ELSE (lo + hi) / 2 END, 9) AS rate, round(CASE WHEN NOT point THEN lo END, 9) AS rate_lo, round(CASE WHEN NOT point THEN hi END, 9) AS rate_hi
FROM p WHERE state1 <> 'charging' AND state2 <> 'charging' AND level1 - level2 >= 0 AND NOT (level1 = 0 AND level2 = 0)"""

SLICES = I.POINTS + """, rg AS (SELECT uuid, min(time1) AS t0, min(time1) + 1200000 AS t1 FROM pt WHERE uuid IN ('3', '7', '11') GROUP BY uuid), rest AS (SELECT * FROM pt WHERE uuid NOT IN ('3', '7', '11'))"""

SQL = {
    "p1_registration_history": f"WITH {I.ALL_REGS} SELECT uuid, os, model, round(time, 3) AS time FROM (SELECT *, lag(os) OVER w AS b, row_number() OVER w AS k FROM g WINDOW w AS (PARTITION BY uuid ORDER BY time)) WHERE k = 1 OR os IS DISTINCT FROM b",
    "p2_asof": f"WITH {I.ASOF} SELECT uuid, round(time, 3) AS time, os, model FROM a",
    "p3_rates": f"WITH {I.PAIRS} SELECT {RATES_OUT}, array_to_string(apps, ',') AS apps FROM r",
    "p4_unabridged_rates": f"WITH {I.PAIRS} SELECT uuid, count(*) AS n, sum((event2 = 'batterylevelchanged')::BIGINT)::BIGINT AS points, round(sum(CASE WHEN event2 = 'batterylevelchanged' THEN drain ELSE (lo + hi) / 2 END), 6) AS rate FROM p WHERE model IS DISTINCT FROM 'Simulator' AND state1 <> 'charging' AND state2 <> 'charging' AND level1 - level2 >= 0 AND NOT (level1 = 0 AND level2 = 0) GROUP BY uuid",
    "p5_rates_of": f"WITH {P5}",
    "p6_rate_value": f"WITH {I.PAIRS} SELECT uuid, round(time2, 3) AS time2, round(drain, 9) AS point, round(lo, 9) + 0.0::DOUBLE AS lo, round(hi, 9) + 0.0::DOUBLE AS hi FROM p",
    "p7_rate_attributes": f"WITH {I.PAIRS} SELECT uuid, round(time2, 3) AS time2, array_to_string(list_sort(list_distinct(list_concat(apps1, apps2))), ',') AS apps, array_to_string(list_sort(list_distinct(list_concat(string_split(event1, ' '), string_split(event2, ' ')))), ',') AS events, 'kind=' || array_to_string(list_sort(list_distinct(list_concat(kind1, kind2))), '|') || CASE WHEN wifi1 IS NOT NULL OR wifi2 IS NOT NULL THEN ',wifi=' || array_to_string(list_sort(list_distinct(list_concat(coalesce(wifi1, []), coalesce(wifi2, [])))), '|') ELSE '' END AS features FROM p",
    "p8_plausible": f"WITH {I.PAIRS} SELECT uuid, count(*) AS n FROM c WHERE (reject_reason IS NULL OR reject_reason IN ('zero drain', 'abandoned')) AND (NOT point OR (drain > 0 AND drain <= 0.0005)) GROUP BY uuid",
    "p9_rejections": f"WITH {I.PAIRS} SELECT coalesce(reject_reason, CASE WHEN point THEN 'point' ELSE 'range' END) AS kind, count(*) AS n FROM c GROUP BY 1",
    "p10_feature_history": f"WITH {HISTORY} SELECT uuid, feature, round(time, 3) AS time, value FROM h",
    "p11_feature_changes": f"WITH {HISTORY} SELECT DISTINCT feature, before, value AS after FROM (SELECT *, lag(value) OVER (PARTITION BY uuid, feature ORDER BY time, value) AS before FROM h) WHERE before IS NOT NULL",
    "p12_last_features": f"WITH {HISTORY} SELECT h.uuid, feature, arg_max_null(value, h.time) AS value, CASE WHEN h.uuid::BIGINT % 13 <> 4 THEN 'm' || (h.uuid::BIGINT % 7)::VARCHAR END AS model FROM h GROUP BY ALL",
    "p13_current_os": f"WITH {I.PAIRS} SELECT uuid, max_by(os, time2) AS os, max_by(model, time2) AS model FROM r GROUP BY uuid",
    "p14_limit_users": f"WITH {I.PAIRS} SELECT uuid, count(*) AS n FROM r WHERE uuid IN (SELECT DISTINCT uuid FROM r ORDER BY uuid LIMIT 12) GROUP BY uuid",
    "p15_current_os_rates": f"WITH {I.PAIRS}, cu AS (SELECT uuid, max_by(os, time2) AS os FROM r GROUP BY uuid) SELECT r.uuid, r.os, count(*) AS n FROM r JOIN cu ON r.uuid = cu.uuid AND r.os IS NOT DISTINCT FROM cu.os GROUP BY ALL",
    "p16_exclude_daemons": f"WITH {I.PAIRS} SELECT app, count(*) AS n FROM (SELECT unnest(apps) AS app FROM r) WHERE {NO_DAEMONS} GROUP BY app",
    "p17_samples_text": f"WITH {I.SAMPLES} SELECT concat_ws(', ', uuid, floor(time)::BIGINT::VARCHAR, level::VARCHAR, event, state, array_to_string(apps, ' '), 'kind=' || kind[1], CASE WHEN wifi IS NOT NULL THEN 'wifi=[' || array_to_string(wifi, ' ') || ']' END) AS line, count(*) AS n FROM s GROUP BY 1",
    "p17_registrations_text": f"WITH {I.ALL_REGS} SELECT concat_ws(', ', uuid, model, os, floor(time)::BIGINT::VARCHAR) AS line FROM g",
    "p18_rates_text": f"WITH {I.PAIRS} SELECT uuid, floor(time2)::BIGINT AS time2, concat_ws(' ', uuid, os, model, CASE WHEN rate_lo IS NULL THEN printf('%.6f', rate) ELSE printf('%.6f', rate_lo) || '..' || printf('%.6f', rate_hi) END, array_to_string(apps, ',')) AS line FROM r",
    "p19_point_rates": f"WITH {I.PAIRS} SELECT uuid, round(time1, 3) AS time1, round(rate, 9) AS rate FROM r WHERE rate_lo IS NULL",
    "p20_by_rate": f"WITH {I.PAIRS} SELECT uuid, round(time2, 3) AS time2, round(rate, 9) AS rate FROM r",
    "d1_a_priori": f"WITH {I.PRIOR} SELECT round(x, 9) AS x, round(p, 9) AS p FROM ap",
    "d2_frequencies": f"WITH {I.FREQS} SELECT os, round(x, 9) AS x, round(sum(w), 5) AS w FROM fq GROUP BY os, x",
    "d3_prob_dist": f"WITH {I.FREQS} SELECT model, round(x, 9) AS x, round(sum(w) / sum(sum(w)) OVER (PARTITION BY model), 6) AS p FROM fq GROUP BY model, x",
    "d4_expected_value": f"WITH {I.FREQS} SELECT os, round(sum(x * w) / sum(w), 8) AS ev FROM fq GROUP BY os",
    "d5_equal_histogram_ev": f"WITH {I.PRICES}{HIST} SELECT flag, round(sum((bucket + 0.5) / 20 * 105.0 * mass), 6) AS ev FROM eq GROUP BY flag",
    "d6_log_histogram_ev": f"WITH {I.PRICES}{LOGH} SELECT flag, round(sum({centre('105.5', '0.7')} * mass), 6) AS ev FROM lg GROUP BY flag",
    "d7_rate_ev": f"WITH {I.POINTS} SELECT uuid, round(time2, 3) AS time2, mass, round(mean, 8) AS mean FROM pt",
    "d8_uniform_functions": """WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS lo, round(l_discount + l_tax, 2) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN lo = hi THEN 0.0501 >= lo - 0.0005 AND 0.0501 < lo + 0.0005 ELSE 0.0501 >= lo AND 0.0501 < hi END AS holds, CASE WHEN lo = hi THEN lo >= 0.0303 AND lo < 0.0705 ELSE lo < 0.0705 AND 0.0303 < hi END AS meets,
 round(CASE WHEN lo = hi THEN (lo >= 0.0303 AND lo < 0.0705)::INT ELSE greatest(least(hi, 0.0705) - greatest(lo, 0.0303), 0) / (hi - lo) END, 6) AS part,
 round(CASE WHEN lo = hi THEN (0.0501 >= lo - 0.0005 AND 0.0501 < lo + 0.0005)::INT WHEN 0.0501 >= lo AND 0.0501 < hi THEN 1 / (hi - lo) ELSE 0 END, 6) AS at, lo = hi AS point, round((lo + hi) / 2, 6) AS mean FROM x""",
    "d9_discretize": """WITH x AS (SELECT l_orderkey, l_linenumber, round(l_discount * 100)::BIGINT AS a, round(round(l_discount + l_tax, 2) * 100)::BIGINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, b - a + 1 AS n, round((a + b) * (b - a + 1) / 200.0::DOUBLE, 6) AS total FROM x""",
    "d10_xmax": f"WITH {I.PRICES} SELECT flags, max(x) AS xmax FROM (VALUES ('AN', 'A', 'N'), ('AR', 'A', 'R'), ('NR', 'N', 'R')) v(flags, one, two) JOIN d ON flag = one OR flag = two GROUP BY flags",
    "d11_equal_histogram": f"WITH {I.PRICES}{HIST} SELECT flag, bucket, round(mass, 6) AS mass FROM eq",
    "d12_range_histogram": "WITH " + RANGE_HIST.format(edges="b * xm / 20 AS s, (b + 1) * xm / 20 AS e", place="least(floor(lo / xm * 20), 19)", digits=6),
    "d13_log_histogram": f"WITH {I.PRICES}{LOGH} SELECT flag, bucket, round(mass, 6) AS mass FROM lg",
    "d14_normalised_log_histogram": f"WITH {I.PRICES}{LOGH} SELECT flag, bucket, round(mass, 6) AS mass, round(sum({centre('105.5', '0.7')} * mass) OVER (PARTITION BY flag), 6) AS ev, sum(mass) OVER (PARTITION BY flag) BETWEEN 0.99 AND 1.01 AS sums_to_one FROM lg",
    "d15_range_log_histogram": "WITH " + RANGE_HIST.format(edges=f"CASE WHEN b = 0 THEN 0 ELSE xm * exp(-{STEP} * (20 - b)) END AS s, xm * exp(-{STEP} * (19 - b)) AS e", place=f"CASE WHEN lo > 0 THEN least(greatest(trunc(20 - ln(xm / lo) / {STEP}), 0), 19) ELSE 0 END", digits=5),
    "d16_bucket_coordinates": f"WITH {I.PRICES}{HIST} SELECT flag, bucket, round((bucket + 0.5) / 20 * 105.0, 6) AS equal, round({centre('105.0', '0.7')}, 6) AS log FROM eq",
    "d17_cdf": f"WITH {I.PRICES} SELECT flag, x, round(sum(p) OVER (PARTITION BY flag ORDER BY x), 6) AS cumulative FROM d WHERE x <> 106 UNION ALL SELECT DISTINCT flag, 106.0::DOUBLE, 1.0::DOUBLE FROM d",
    "d18_upper_edge_log": f"WITH {I.PRICES}, e AS (SELECT flag, 106.0::DOUBLE / pow(1.5::DOUBLE, 22 - i) AS edge, CASE WHEN i = 0 THEN -1 ELSE 106.0::DOUBLE / pow(1.5::DOUBLE, 23 - i) END AS below FROM (SELECT DISTINCT flag FROM d), range(23) t(i)) SELECT e.flag, round(edge, 6) AS edge, round(coalesce(sum(p), 0), 6) AS mass FROM e LEFT JOIN d ON d.flag = e.flag AND x <= edge AND x > below GROUP BY e.flag, edge",
    "d19_upper_edge_equal": f"WITH {I.PRICES}, e AS (SELECT flag, 106.5::DOUBLE / 20 * (i + 1) AS edge, 106.5::DOUBLE / 20 * i AS below FROM (SELECT DISTINCT flag FROM d), range(20) t(i)) SELECT e.flag, round(edge, 6) AS edge, round(coalesce(sum(p), 0), 6) AS mass FROM e LEFT JOIN d ON d.flag = e.flag AND x <= edge AND x > below GROUP BY e.flag, edge",
    "d20_ks_signed": f"WITH {KS} SELECT flags, round(greatest(max(diff), 0), 6) + 0.0::DOUBLE AS distance FROM f WHERE CASE WHEN (SELECT min(x) FROM a WHERE a.flags = f.flags) > (SELECT min(x) FROM n WHERE n.flags = f.flags) THEN x IN (SELECT x FROM a WHERE a.flags = f.flags) ELSE x IN (SELECT x FROM n WHERE n.flags = f.flags) END GROUP BY flags",
    "d21_ks_absolute": f"WITH {KS} SELECT flags, round(max_by(diff, abs(diff)), 6) + 0.0::DOUBLE AS distance FROM f GROUP BY flags",
    "d22_ks_weighted": f"WITH {KS}, v AS (SELECT flags, diff * (la - lb) / 2 AS z FROM f WHERE la IS NOT NULL AND lb IS NOT NULL) SELECT flags, round(max_by(z, abs(z)), 6) + 0.0::DOUBLE AS distance FROM v GROUP BY flags",
    "d23_spread": f"WITH {I.MEASUREMENTS} SELECT series_id, round(avg(cents), 3) AS mean, round(var_pop(cents) * count(*), 3) AS sum_sq_dev, round(sqrt(var_pop(cents) * count(*)), 3) AS root FROM m GROUP BY series_id",
    "d24_normalize": f"WITH {I.MEASUREMENTS} SELECT series_id, num, cents, round((cents - avg(cents) OVER w) / nullif(sqrt(var_pop(cents) OVER w * count(*) OVER w), 0), 6) AS normalized FROM m WINDOW w AS (PARTITION BY series_id)",
    "d25_pearson": f"WITH {I.MEASUREMENTS}, x AS (SELECT series_id, sum(cents)::DOUBLE AS x FROM m GROUP BY series_id), y AS (SELECT series_id, count(*)::DOUBLE AS y FROM m WHERE event_type = 'error' GROUP BY series_id) SELECT round(corr(x, coalesce(y, 0)), 6) AS r FROM x LEFT JOIN y USING (series_id)",
    "d26_mixture_stddev": f"WITH {I.PAIRS}{RANGES} SELECT os, round(avg((lo + hi) / 2), 8) AS ev, round(sqrt(greatest(avg((lo * lo + lo * hi + hi * hi) / 3) - pow(avg((lo + hi) / 2), 2), 0)), 8) AS stddev FROM rg GROUP BY os",
    "d27_rounding": "SELECT event_id, floor((value - 50.125) * 10.0 + 0.5) / 10.0 AS one, floor(value - 50.125 + 0.5)::BIGINT AS whole FROM events",
    "d28_ev_difference": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 WHEN l_discount <> 0 THEN 1 - l_tax / l_discount END, 6) AS d FROM lineitem",
    "d29_improvement": """WITH x AS (SELECT l_orderkey, l_linenumber, round((CASE WHEN l_tax <> 0 THEN 100 / (l_tax / 1000) END - CASE WHEN l_discount <> 0 THEN 100 / (l_discount / 1000) END) / 3600, 6) AS hours FROM lineitem)
SELECT l_orderkey, l_linenumber, hours, floor(hours / 24)::BIGINT AS days, round(hours - floor(hours / 24) * 24, 6) AS rest FROM x""",
    "d30_compare_distributions": f"WITH {I.FREQS}, z AS (SELECT sum(x * w) FILTER (list_contains(apps, 'app3')) / sum(w) FILTER (list_contains(apps, 'app3')) AS ev, sum(x * w) FILTER (NOT list_contains(apps, 'app3')) / sum(w) FILTER (NOT list_contains(apps, 'app3')) AS ev_neg, max(x) AS xmax FROM fq) SELECT round(ev, 8) AS ev, round(ev_neg, 8) AS ev_neg, round(xmax, 8) AS xmax, round({DIST}, 5) AS distance, {D30_SIDE.format('')} AS prob, {D30_SIDE.format('NOT ')} AS prob_neg FROM z",
    "d31_evidence": f"WITH {I.POINTS} SELECT model, os, round(sum(mass * mean) / nullif(sum(mass), 0), 8) AS ev, count(*) AS n_rates, count(DISTINCT uuid) AS n_users FROM pt GROUP BY model, os HAVING count(*) >= 10",
    "d32_non_zero": f"WITH {I.PRICES}{HIST} SELECT flag, bucket, round(mass, 6) AS mass, round(sum(mass) OVER (PARTITION BY flag), 6) AS total FROM eq WHERE mass > 0",
    "c1_compare_os": "WITH " + compare("os"),
    "c2_compare_model": "WITH " + compare("model"),
    "c3_user_profile": f"WITH {STORED} SELECT p.uuid, n_rates, n_apps, {CMP_OUT}, coalesce((SELECT string_agg(app, ',' ORDER BY app) FROM ua WHERE ua.uuid = p.uuid), '') AS apps, round(xm, 8) AS xmax, prob, prob_neg FROM pf p JOIN pr ON pr.uuid = p.uuid JOIN rp ON rp.uuid = p.uuid WHERE ev IS NOT NULL AND ev_neg IS NOT NULL",
    "c4_similar_users": f"""WITH {PROFILE}, us AS (SELECT uuid, list(app) AS al FROM ua GROUP BY uuid HAVING count(*) > 1),
sm AS (SELECT us.uuid, pt.mass, pt.mean, len(list_intersect(al, apps)) >= ln(len(al)) AS sim FROM us, pt),
cp AS (SELECT uuid, count(*) FILTER (sim) AS n_similar, sum(mass * mean) FILTER (sim) / nullif(sum(mass) FILTER (sim), 0) AS ev, sum(mass * mean) FILTER (NOT sim) / nullif(sum(mass) FILTER (NOT sim), 0) AS ev_neg FROM sm GROUP BY uuid)
SELECT uuid, n_similar, {CMP_OUT} FROM cp WHERE ev IS NOT NULL AND ev_neg IS NOT NULL""",
    "c5_hogs": f"WITH {APPS} SELECT app, users_with, users_without, round(ev, 8) AS ev, round(ev_neg, 8) AS ev_neg, round(distance, 5) AS distance FROM hg",
    "c6_bugs": f"WITH {BUGS} SELECT app, uuid, n, round(ev, 8) AS ev, round(ev_neg, 8) AS ev_neg, round(distance, 5) AS distance FROM bb",
    "c7_skipped": f"WITH {APPS} SELECT app, users_with, users_without, CASE WHEN users_with < 100 AND users_without < 100 THEN 'both' WHEN users_with < 100 THEN 'with' ELSE 'without' END AS reason FROM au WHERE NOT (users_with >= 100 AND users_without >= 100)",
    "c8_relaxed_hogs": f"WITH {APPS} SELECT app, users_with, users_without, {CMP_OUT} FROM ca WHERE users_with >= 100 AND users_without >= 100 AND {DIST} > 0",
    "c9_j_scores": f"WITH {PROFILE}, dd AS (SELECT uuid, round({DIST}, 5) AS distance FROM pf) SELECT uuid, CASE WHEN distance = 0 THEN 0 ELSE floor((rank() OVER (ORDER BY distance DESC) - 1) / (count(*) OVER ())::DOUBLE * 100 + 0.5) / 100 END AS j_score FROM dd WHERE distance IS NOT NULL",
    "c10_correlations": f"""WITH {PROFILE}, nu AS (SELECT pt.mean, coalesce(n_rates, 0)::DOUBLE AS a, coalesce((SELECT count(*) FROM ua WHERE ua.uuid = pt.uuid), 0)::DOUBLE AS b FROM pt LEFT JOIN (SELECT pt.uuid, count(*) AS n_rates FROM pt JOIN cu ON cu.uuid = pt.uuid AND cu.os IS NOT DISTINCT FROM pt.os GROUP BY pt.uuid) q ON q.uuid = pt.uuid)
{indicator('pt', 'os')} UNION ALL {indicator('pt', 'model')} UNION ALL SELECT 'user', 'rates', round(corr(mean, a), 5) FROM nu UNION ALL SELECT 'user', 'apps', round(corr(mean, b), 5) FROM nu""",
    "c11_correlations_by_app": f"WITH {APPS}, e2 AS (SELECT * FROM ex) {indicator('e2', 'os', 'app')} UNION ALL {indicator('e2', 'model', 'app')}",
    "c12_group_variance": f"""WITH {I.FREQS}, nv AS (SELECT 'os' AS nature, os AS value, * FROM pt UNION ALL SELECT 'model', model, * FROM pt),
u AS (SELECT nature, value, uuid, sum(mass) AS m, sum(mass * mean) AS s, count(*) AS n FROM nv GROUP BY ALL),
v AS (SELECT nature, value, sum(s) / nullif(sum(m), 0) AS ev, avg(s / nullif(m, 0)) AS user_mean, var_pop(s / nullif(m, 0)) * count(s / nullif(m, 0)) AS user_sd, count(s / nullif(m, 0)) AS users, sum(n)::BIGINT AS samples FROM u GROUP BY ALL),
fx AS (SELECT nature, value, x, sum(w) AS w FROM (SELECT 'os' AS nature, os AS value, x, w FROM fq UNION ALL SELECT 'model', model, x, w FROM fq) GROUP BY ALL),
t AS (SELECT nature, value, avg(x * p) AS term_mean, var_pop(x * p) * count(*) AS term_sd FROM (SELECT *, w / sum(w) OVER (PARTITION BY nature, value) AS p FROM fx) GROUP BY ALL)
SELECT v.nature, v.value, round(ev, 8) AS ev, round(user_mean, 8) AS user_mean, round(user_sd, 10) AS user_sum_sq_dev, users, samples, round(term_mean, 8) AS term_mean, round(term_sd, 10) AS term_sum_sq_dev,
       round((100 / ev - 100 / (ev + term_sd)) / 3600, 3) AS term_all_hours, round((100 / ev - 100 / (ev + user_sd)) / 3600, 3) AS user_all_hours
FROM v JOIN t ON t.nature = v.nature AND t.value IS NOT DISTINCT FROM v.value""",
    "c13_app_usage": f"WITH {I.PAIRS}, u AS (SELECT uuid, count(*) AS an, sum(time2 - time1) AS alltime FROM r GROUP BY uuid) SELECT r.uuid, app, round(count(*) / any_value(an), 6) AS rate_share, round(sum(t) / any_value(alltime), 6) AS time_share FROM (SELECT uuid, time2 - time1 AS t, unnest(apps) AS app FROM r) r JOIN u USING (uuid) GROUP BY r.uuid, app",
    "c14_excluding": f"WITH {SLICES}, z AS (SELECT 'app3' AS app, sum(mass * mean) FILTER (list_contains(apps, 'app3')) / sum(mass) FILTER (list_contains(apps, 'app3')) AS ev, sum(mass * mean) FILTER (NOT list_contains(apps, 'app3')) / sum(mass) FILTER (NOT list_contains(apps, 'app3')) AS ev_neg FROM rest), o AS (SELECT count(DISTINCT uuid) AS u, count(*) AS n, count(DISTINCT uuid) FILTER (uuid IN ('3', '7', '11')) AS ru, count(*) FILTER (uuid IN ('3', '7', '11')) AS rn FROM pt) SELECT app, {CMP_OUT}, ru AS users_removed, u AS users, rn AS rates_removed, n AS rates FROM z, o",
    "c14_slices": f"""WITH {SLICES}, i AS (SELECT rg.uuid, t0, count(*) AS n, sum(mass * mean) / nullif(sum(mass), 0) AS ev FROM rg JOIN pt ON pt.uuid = rg.uuid AND time1 > t0 AND time2 < t1 AND list_contains(apps, 'app3') GROUP BY ALL),
z AS (SELECT *, (SELECT sum(mass * mean) / sum(mass) FROM rest WHERE list_contains(apps, 'app3')) AS ev_neg FROM i WHERE ev IS NOT NULL) SELECT uuid, round(t0, 3) AS t0, n, {CMP_OUT} FROM z""",
    "c15_ev_by_user_count": f"""WITH {I.POINTS}, e AS (SELECT uuid, mass, mean, unnest(apps) AS app FROM pt), g2 AS (SELECT app, uuid, sum(mass) AS m, sum(mass * mean) AS s, count(*) AS n FROM e GROUP BY ALL)
SELECT app, users, round(s / nullif(m, 0), 8) AS ev, n FROM (SELECT app, row_number() OVER w AS users, sum(m) OVER w AS m, sum(s) OVER w AS s, (sum(n) OVER w)::BIGINT AS n FROM g2 WINDOW w AS (PARTITION BY app ORDER BY uuid)) WHERE n >= 10""",
    "c15_user_ev_by_user_count": f"""WITH {I.POINTS}, e AS (SELECT uuid, mass, mean, unnest(apps) AS app FROM pt), g2 AS (SELECT app, uuid, sum(mass) AS m, sum(mass * mean) AS s, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS users, (sum(n) OVER w)::BIGINT AS alln FROM g2 WINDOW w AS (PARTITION BY app ORDER BY uuid)),
first AS (SELECT app, min(users) AS enough FROM k WHERE alln >= 10 GROUP BY app)
SELECT app, uuid, round(s / m, 8) AS ev, n, greatest(users, enough) AS from_users FROM k JOIN first USING (app) WHERE m > 0""",
    "c16_user_slice": f"WITH {I.FREQS} SELECT round(x, 9) AS x, round(sum(w), 6) AS w FROM fq JOIN (SELECT rate_id FROM pt WHERE uuid = '7' AND time1 > 1704500000 AND time2 < 1706000000) USING (rate_id) GROUP BY x",
    "c18_labels": f"""WITH {STORED}, z AS (SELECT 'hog' AS nature, 'Hog ' AS what, app AS key1, NULL::VARCHAR AS key2 FROM hg UNION ALL SELECT 'bug', 'Bug ', app, uuid FROM bb {GROUPS}
  UNION ALL SELECT 'similar', 'Similar users ', uuid, NULL FROM cp WHERE ev IS NOT NULL AND ev_neg IS NOT NULL UNION ALL SELECT 'result', 'User ', uuid, NULL FROM pf WHERE ev_neg IS NOT NULL)
SELECT nature, key1, key2, what || coalesce(key1, 'unknown') || coalesce(' on ' || key2, '') || ' running' AS title, what || coalesce(key1, 'unknown') || coalesce(' on ' || key2, '') || ' not running' AS title_neg FROM z""",
    "k1_results": f"""WITH {STORED}, found AS (
  SELECT 'os' AS nature, key AS key1, NULL::VARCHAR AS key2, gx AS xmax, ev, ev_neg, NULL::BIGINT AS users_with, NULL::BIGINT AS users_without, prob, prob_neg, NULL::VARCHAR AS apps FROM ({EVS.format(key='os')}) JOIN ga ON nature = 'os' AND k IS NOT DISTINCT FROM key, gm
  UNION ALL SELECT 'model', key, NULL, gx, ev, ev_neg, NULL, NULL, prob, prob_neg, NULL FROM ({EVS.format(key='model')}) JOIN ga ON nature = 'model' AND k IS NOT DISTINCT FROM key, gm
  UNION ALL SELECT 'similar', uuid, NULL, gx, ev, ev_neg, NULL, NULL, prob, prob_neg, NULL FROM cp JOIN ga ON nature = 'similar' AND k = uuid, gm
  UNION ALL SELECT 'hog', app, NULL, gx, ev, ev_neg, users_with, users_without, prob, prob_neg, NULL FROM hg JOIN ga ON nature = 'hog' AND k = app, gm
  UNION ALL SELECT 'result', p.uuid, NULL, xm, ev, ev_neg, NULL, NULL, prob, prob_neg, coalesce((SELECT string_agg(app, ',' ORDER BY app) FROM ua WHERE ua.uuid = p.uuid), '') FROM pf p JOIN pr ON pr.uuid = p.uuid JOIN rp ON rp.uuid = p.uuid
  UNION ALL SELECT 'bug', b.app, b.uuid, xm, ev, ev_neg, NULL, NULL, prob, prob_neg, NULL FROM bb b JOIN br ON br.app = b.app AND br.uuid = b.uuid JOIN bp ON bp.app = b.app AND bp.uuid = b.uuid)
SELECT nature, key1, key2, round(xmax, 8) AS xmax, {CMP_OUT}, users_with, users_without, prob, prob_neg, apps FROM found WHERE ev IS NOT NULL AND ev_neg IS NOT NULL""",
    "k3_expire": f"WITH {BUGS}, z AS (SELECT 'hog' AS nature, '' AS what, app AS key1, NULL::VARCHAR AS key2 FROM hg UNION ALL SELECT 'bug', '', app, uuid FROM bb {GROUPS}) SELECT nature, key1, key2 FROM z",
    "k4_remove_daemons": f"WITH {APPS}, z AS (SELECT 'hog' AS nature, '' AS what, app AS key1, NULL::VARCHAR AS key2 FROM ca WHERE users_with >= 5 AND users_without >= 5 {GROUPS}) SELECT nature, key1 FROM z",
    "k5_delete": f"WITH {I.SAMPLES} SELECT uuid, count(*) AS n FROM s WHERE NOT (uuid = '7' OR state = 'charging') GROUP BY uuid",
    "k6_device": f"WITH {I.SAMPLES} SELECT round(time, 3) AS time, level, state FROM s WHERE uuid = '7' AND time > 1704500000",
    "k9_plot_data": f"WITH {I.PRICES} SELECT flag, x, round(p, 6) AS y FROM d",
    "k12_larger_first": f"WITH {I.PAIRS} SELECT uuid, round(time2, 3) AS time2, count(*) OVER (PARTITION BY uuid) AS group_size FROM r",
    "s1_measurements": f"WITH {I.MEASUREMENTS} SELECT series_id, event_type = 'error' AS bad, count(*) AS n, round(sum(CASE WHEN event_type <> 'error' THEN cents / 100 END), 2) AS ma FROM m GROUP BY ALL",
    "s6_fleet_text": "SELECT user_id::VARCHAR AS uuid, epoch_us(ts) // 1000000 AS time, round((event_id % 101) / 100, 2) AS level, 'changed' AS event, CASE WHEN event_type = 'error' THEN 'charging' ELSE 'unplugged' END AS state, 'Mail,Maps' AS apps FROM events",
    "s8_latest_registrations": f"WITH {I.ALL_REGS} SELECT uuid, max_by(model, time) AS model, max_by(os, time) AS os FROM g GROUP BY uuid",
    "s10_scan": "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id IN (3, 7, 11) AND value > 20",
    "s12_incremental": f"WITH {I.SAMPLES} SELECT uuid, count(*) AS n, round((SELECT max(time) FROM s), 3) AS watermark FROM s GROUP BY uuid",
    "s16_replicate": f"WITH {I.SAMPLES}, z AS (SELECT CASE WHEN k = 0 THEN uuid ELSE uuid || '-' || k::VARCHAR END AS uuid, time + k * 2678400 AS time FROM s, range(3) t(k)) SELECT uuid, count(*) AS n, round(max(time), 3) AS last FROM z GROUP BY uuid",
}
