"""The same queries as plain SQL on the given tables, for checking results."""

from __future__ import annotations

from statewave.functions.iir import butterworth_bandpass, notch_section
from statewave.plans.queries import (
    CLASSES, DIMS, MODEL_MEANS, MODEL_MOVE, MODEL_STAY, MODEL_VARIANCE, QUERY_BAND, QUERY_NOTCH,
    QUERY_QUALITY, STATES)

SIGNAL = """
sig AS (SELECT event_id AS i, value AS eeg,
               CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS emg
        FROM events),
len AS (SELECT max(i) + 1 AS n FROM sig)"""


def wins(size: int, step: int) -> str:
    return f"""
wins AS (SELECT unnest(range(0, (n - {size}) // {step} + 1)) AS w FROM len),
x AS (SELECT w.w, s.i - w.w * {step} AS o, s.i, s.eeg, s.emg
      FROM wins w JOIN sig s ON s.i >= w.w * {step} AND s.i < w.w * {step} + {size})"""


def shape(channel: str) -> str:
    """Time-domain features per window of x, as CTE t_<channel>."""
    return f"""
n_{channel} AS (SELECT w, o, {channel} AS v, lag({channel}) OVER q AS p, lead({channel}) OVER q AS f,
                  stddev_pop({channel}) OVER (PARTITION BY w) AS sd
           FROM x WINDOW q AS (PARTITION BY w ORDER BY o)),
t_{channel} AS (SELECT w, sum((v * v + p * p) / 2) / 10.0 AS energy, max(v) - min(v) AS peak_to_peak,
             sum(CASE WHEN p IS NOT NULL AND signbit(v) <> signbit(p) THEN 1.0 ELSE 0.0 END) / 99 AS zcr,
             sum(CASE WHEN abs(v) > abs(p) AND abs(v) >= abs(f)
                       AND abs(v) >= greatest(0.75 * sd, 1e-8) THEN 1.0::DOUBLE ELSE 0.0 END) AS peak_count,
             sum((v * v + p * p) / 2) / 100 AS iemg2
      FROM n_{channel} GROUP BY w)"""


SPECTRUM = """
taper AS (SELECT o, 0.5 - 0.5 * cos(2 * pi() * o / 99) AS h FROM range(0, 100) r(o)),
wave AS (SELECT b, o, cos(2 * pi() * b * o / 100) AS c, sin(2 * pi() * b * o / 100) AS s
         FROM range(0, 51) r(b), range(0, 100) q(o)),
pw AS (SELECT x.w, v.b, (pow(sum(x.eeg * t.h * v.c), 2) + pow(sum(x.eeg * t.h * v.s), 2))
                         / (SELECT sum(h * h) FROM taper) AS p
       FROM x JOIN taper t ON t.o = x.o JOIN wave v ON v.o = x.o GROUP BY x.w, v.b),
tot AS (SELECT w, (sum(p) - (sum(CASE WHEN b IN (0, 50) THEN p ELSE 0 END)) / 2) * 0.1 AS total
        FROM pw GROUP BY w),
spec AS (SELECT p.w, any_value(t.total) AS total,
                min(CASE WHEN p.p = m.top THEN p.b END) * 0.1::DOUBLE AS dominant,
                -sum(CASE WHEN p.p > 0 THEN p.p / greatest(t.total, 1e-12)
                          * log2(p.p / greatest(t.total, 1e-12)) ELSE 0 END) AS entropy
         FROM pw p JOIN tot t ON t.w = p.w
         JOIN (SELECT w, max(p) AS top FROM pw GROUP BY w) m ON m.w = p.w GROUP BY p.w)"""

# The bands in bins of 0.1 Hz, half-open.
BAND_BINS = {"delta": (5, 40), "theta": (40, 80), "alpha": (80, 120), "sigma": (120, 160),
             "beta": (160, 300)}

BANDS = """
bp AS (SELECT t.w, any_value(t.total) AS total, """ + ", ".join(
    f"""coalesce((sum(CASE WHEN b >= {lo} AND b < {hi} THEN p END)
     - (sum(CASE WHEN b = {lo} THEN p ELSE 0 END)
     + sum(CASE WHEN b = {min(hi - 1, 50)} AND b >= {lo} THEN p ELSE 0 END)) / 2) * 0.1, 0) AS {name}"""
    for name, (lo, hi) in BAND_BINS.items()) + """
       FROM pw JOIN tot t ON t.w = pw.w GROUP BY t.w)"""

FULL = """
feat AS (SELECT e.w, e.energy AS eeg_energy, e.peak_to_peak AS eeg_peak_to_peak, e.zcr AS eeg_zcr,
         e.peak_count AS eeg_peak_count, s.dominant AS eeg_dominant_frequency,
         s.entropy AS eeg_spectral_entropy, s.total AS eeg_total_power, """ + ", ".join(
    f"b.{n} AS eeg_{n}_power, b.{n} / greatest(b.total, 1e-12) AS eeg_{n}_ratio" for n in BAND_BINS) + """,
         m.energy AS emg_energy, m.peak_to_peak AS emg_peak_to_peak, m.zcr AS emg_zcr,
         m.peak_count AS emg_peak_count
         FROM t_eeg e JOIN t_emg m ON m.w = e.w JOIN spec s ON s.w = e.w JOIN bp b ON b.w = e.w)"""

FULL_NAMES = (["eeg_energy", "eeg_peak_to_peak", "eeg_zcr", "eeg_peak_count",
               "eeg_dominant_frequency", "eeg_spectral_entropy", "eeg_total_power"]
              + [f"eeg_{n}_{k}" for n in BAND_BINS for k in ("power", "ratio")]
              + ["emg_energy", "emg_peak_to_peak", "emg_zcr", "emg_peak_count"])

WINDOWED = "WITH" + SIGNAL + "," + wins(100, 50)
TIMED = WINDOWED + "," + shape("eeg")
BOTH = TIMED + "," + shape("emg")
SPECTRAL = WINDOWED + "," + SPECTRUM
EVERYTHING = BOTH + "," + SPECTRUM + "," + BANDS + "," + FULL


def zscaled(names, source: str, digits: int = 5) -> str:
    return ", ".join(
        f"round(({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () < 1e-8 THEN 1.0 "
        f"ELSE stddev_pop({n}) OVER () END, {digits}) AS {n}" for n in names)


def minmaxed(names, digits: int = 5) -> str:
    return ", ".join(
        f"round(({n} - min({n}) OVER ()) / CASE WHEN max({n}) OVER () - min({n}) OVER () < 1e-8 "
        f"THEN 1.0 ELSE max({n}) OVER () - min({n}) OVER () END, {digits}) AS {n}" for n in names)


EMB = """WITH e AS (SELECT vec_id AS i, label, unnest(embedding)::DOUBLE AS v,
                          unnest(range(0, 64)) AS d FROM embeddings)"""
NEAREST = EMB + f""",
dist AS (SELECT a.i, c.i AS c, sum((a.v - c.v) * (a.v - c.v)) AS d2
         FROM e a JOIN e c ON c.d = a.d AND c.i < {STATES} GROUP BY a.i, c.i),
near AS (SELECT i, arg_min(c, (d2, c)) AS label, min(d2) AS d2 FROM dist GROUP BY i)"""

GMM = NEAREST + f""",
n0 AS (SELECT label AS k, count(*) AS n FROM near GROUP BY label),
start AS (SELECT c.i AS k, c.d, c.v AS mu, coalesce(s.var + 1e-3, 1.0) AS var
          FROM e c LEFT JOIN (SELECT n.label AS k, a.d, var_pop(a.v) AS var
                              FROM near n JOIN e a ON a.i = n.i GROUP BY n.label, a.d) s
          ON s.k = c.i AND s.d = c.d WHERE c.i < {STATES}),
lp AS (SELECT a.i, s.k, sum(-0.5 * (ln(2 * pi() * greatest(s.var, 1e-6))
                                    + (a.v - s.mu) * (a.v - s.mu) / greatest(s.var, 1e-6)))
              + ln(greatest(any_value(coalesce(n0.n, 0)) / (SELECT count(*) FROM near)::DOUBLE, 1e-12)) AS l
       FROM e a JOIN start s ON s.d = a.d LEFT JOIN n0 ON n0.k = s.k GROUP BY a.i, s.k),
top AS (SELECT i, max(l) AS m FROM lp GROUP BY i),
norm AS (SELECT lp.i, any_value(m) + ln(sum(exp(l - m))) AS z FROM lp JOIN top ON top.i = lp.i GROUP BY lp.i),
resp AS (SELECT lp.i, k, exp(l - z) AS r FROM lp JOIN norm ON norm.i = lp.i),
nk AS (SELECT k, sum(r) + 1e-12 AS nk FROM resp GROUP BY k),
mean AS (SELECT r.k, a.d, sum(r.r * a.v) / any_value(nk.nk) AS mu
         FROM resp r JOIN e a ON a.i = r.i JOIN nk ON nk.k = r.k GROUP BY r.k, a.d)"""

USERS = """
u AS (SELECT CAST(user_id AS VARCHAR) AS rec,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events)"""
LOG_A = f"CASE WHEN a.s = b.s THEN ln({MODEL_STAY}) ELSE ln({MODEL_MOVE}) END"
USER_MODEL = USERS + f""",
z AS (SELECT rec, i, (v - avg(v) OVER (PARTITION BY rec))
             / CASE WHEN stddev_pop(v) OVER (PARTITION BY rec) < 1e-8 THEN 1.0
                    ELSE stddev_pop(v) OVER (PARTITION BY rec) END AS v FROM u),
st AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, {m})" for i, m in enumerate(MODEL_MEANS)) + f""") t(s, mu)),
em AS (SELECT rec, i, s, -0.5 * (ln(2 * pi() * {MODEL_VARIANCE}) + (v - mu) * (v - mu) / {MODEL_VARIANCE}) AS l
       FROM z, st),
emw AS (SELECT rec, i, max(CASE WHEN s = 0 THEN l END) AS l0, max(CASE WHEN s = 1 THEN l END) AS l1,
               max(CASE WHEN s = 2 THEN l END) AS l2 FROM em GROUP BY rec, i)"""


def _step(op: str, to: int) -> str:
    terms = [f"a{s} + ln({MODEL_STAY if s == to else MODEL_MOVE})" for s in range(STATES)]
    if op == "max":
        return f"greatest({', '.join(terms)})"
    top = f"greatest({', '.join(terms)})"
    return f"{top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)})"


def recursion(op: str) -> str:
    """Forward messages per user, one level per sample."""
    start = ", ".join(f"l{s} - ln({STATES}.0) AS a{s}" for s in range(STATES))
    return "WITH RECURSIVE" + USER_MODEL + f""",
fw AS (SELECT rec, i, {start} FROM emw WHERE i = 0
       UNION ALL
       SELECT e.rec, e.i, {', '.join(f'e.l{s} + {_step(op, s)}' for s in range(STATES))}
       FROM fw JOIN emw e ON e.rec = fw.rec AND e.i = fw.i + 1)"""


VITERBI = recursion("max") + f""",
ptr AS (SELECT rec, i, """ + ", ".join(
    "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END AS b{t}".format(
        *[f"a{s} + ln({MODEL_STAY if s == t else MODEL_MOVE})" for s in range(STATES)], t=t)
    for t in range(STATES)) + """ FROM fw),
fin AS (SELECT rec, i, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS s
        FROM fw WHERE (rec, i) IN (SELECT rec, max(i) FROM emw GROUP BY rec)),
path AS (SELECT rec, i, s FROM fin
         UNION ALL
         SELECT p.rec, p.i, CASE q.s WHEN 0 THEN p.b0 WHEN 1 THEN p.b1 ELSE p.b2 END
         FROM path q JOIN ptr p ON p.rec = q.rec AND p.i = q.i - 1)
SELECT rec AS recording_id, i AS sample_idx, s AS state FROM path"""

LEVEL = "WITH" + SIGNAL + """,
lv AS (SELECT i, CASE WHEN eeg < 20 THEN 0 WHEN eeg < 60 THEN 1 ELSE 2 END AS state FROM sig)"""
RUNS = LEVEL + """,
fl AS (SELECT i, state, CASE WHEN lag(state) OVER (ORDER BY i) = state THEN 0 ELSE 1 END AS f FROM lv),
gr AS (SELECT i, state, sum(f) OVER (ORDER BY i) AS g FROM fl),
runs AS (SELECT any_value(state) AS state, min(i) AS run_start, count(*) AS run_length FROM gr GROUP BY g)"""
HOPS = LEVEL + """,
pr AS (SELECT lag(state) OVER (ORDER BY i) AS from_state, state AS to_state FROM lv),
ct AS (SELECT from_state, to_state, count(*) AS n FROM pr WHERE from_state IS NOT NULL GROUP BY ALL),
tr AS (SELECT from_state, to_state, n, n / sum(n) OVER (PARTITION BY from_state) AS probability FROM ct)"""

LABELS = BOTH + f""",
lab AS (SELECT w, 'kmeans' AS method, CAST(peak_count AS INT) % {STATES} AS label FROM t_eeg
        UNION ALL SELECT w, 'gmm', CAST(peak_count AS INT) % {STATES} FROM t_emg)"""
CROSS = LABELS + f""",
grid AS (SELECT m.method, a.r AS ref_label, b.l AS label FROM (SELECT DISTINCT method FROM lab) m,
         range(0, {STATES}) a(r), range(0, {STATES}) b(l)),
cf AS (SELECT g.method, g.ref_label, g.label, count(x.w) AS n FROM grid g
       LEFT JOIN (SELECT l.w, l.method, r.label AS ref_label, l.label FROM lab l
                  JOIN lab r ON r.w = l.w AND r.method = 'kmeans') x
       ON x.method = g.method AND x.ref_label = g.ref_label AND x.label = g.label
       GROUP BY g.method, g.ref_label, g.label)"""
PERMUTED = CROSS + """,
perm AS (SELECT * FROM (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)) t(p0, p1, p2)),
tr AS (SELECT c.method, p.p0, p.p1, p.p2, sum(c.n) AS agreement FROM perm p JOIN cf c
       ON (c.label = 0 AND c.ref_label = p.p0) OR (c.label = 1 AND c.ref_label = p.p1)
       OR (c.label = 2 AND c.ref_label = p.p2) WHERE c.method <> 'kmeans' GROUP BY ALL)"""

CELLS = EMB + """,
nu AS (SELECT d, count(DISTINCT v) AS u, count(*) AS n FROM e GROUP BY d),
dv AS (SELECT DISTINCT d, v FROM e),
mid AS (SELECT d, (v + lead(v) OVER (PARTITION BY d ORDER BY v)) / 2 AS t FROM dv),
qs AS (SELECT d, unnest(quantile_cont(v, [""" + ", ".join(
    repr(0.05 + 0.9 / 31 * i) for i in range(32)) + """])) AS t FROM e GROUP BY d),
cand AS (SELECT DISTINCT q.d, q.t FROM qs q JOIN nu ON nu.d = q.d WHERE nu.u > 32
         UNION ALL SELECT m.d, m.t FROM mid m JOIN nu ON nu.d = m.d
         WHERE nu.u <= 32 AND nu.u > 1 AND m.t IS NOT NULL)"""
SIDES = CELLS + """,
sd AS (SELECT c.d, c.t, e.label, count(*) FILTER (e.v <= c.t) AS l, count(*) AS n
       FROM cand c JOIN e ON e.d = c.d GROUP BY c.d, c.t, e.label),
sm AS (SELECT d, t, sum(l) AS nl, sum(n) AS n, sum(n - l) AS nr FROM sd GROUP BY d, t)"""
SPLITS = SIDES + """,
gn AS (SELECT sd.d, sd.t, any_value(sm.nl) AS nl, any_value(sm.nr) AS nr,
              (1 - sum(pow(sd.n / sm.n, 2))) - (any_value(sm.nl) * (1 - sum(pow(sd.l / greatest(sm.nl, 1), 2)))
              + any_value(sm.nr) * (1 - sum(pow((sd.n - sd.l) / greatest(sm.nr, 1), 2)))) / any_value(sm.n) AS gain
       FROM sd JOIN sm ON sm.d = sd.d AND sm.t = sd.t GROUP BY sd.d, sd.t),
bs AS (SELECT d, t, gain FROM gn WHERE nl >= 10 AND nr >= 10
       ORDER BY round(gain, 12) DESC, d, t LIMIT 1)"""
STUMP = SPLITS + """,
side AS (SELECT e.i, e.label, CASE WHEN e.v <= bs.t THEN 'L' ELSE 'R' END AS s FROM e JOIN bs ON bs.d = e.d),
vote AS (SELECT s, label, count(*) AS n FROM side GROUP BY s, label),
win AS (SELECT s, arg_max(label, (n, -label)) AS predicted FROM vote GROUP BY s)"""
RULES = SIDES + f""",
cl AS (SELECT unnest(range(0, {CLASSES})) AS c),
hit AS (SELECT cl.c, sm.d, sm.t, sm.nl, sm.nr, coalesce(sd.l, 0) AS l, coalesce(sd.n, 0) AS a
        FROM cl CROSS JOIN sm LEFT JOIN sd ON sd.d = sm.d AND sd.t = sm.t AND sd.label = cl.c),
both_ AS (SELECT c, d, t, 0 AS side, '<=' AS direction, l AS tp, nl AS picked, a FROM hit
          UNION ALL SELECT c, d, t, 1, '>', a - l, nr, a FROM hit),
sc AS (SELECT *, tp / greatest(picked, 1)::DOUBLE AS p, tp / greatest(a, 1)::DOUBLE AS r FROM both_),
f1 AS (SELECT c, d, t, side, direction,
              CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END AS score FROM sc),
top AS (SELECT * FROM f1 QUALIFY row_number() OVER (
        PARTITION BY c, d ORDER BY score DESC, t, side) = 1)"""


def _filter_sql(sections, pad: int) -> str:
    """Forward and backward recursion of a section cascade per user, one level per sample."""
    n = len(sections)
    sections = [[float(c) for c in section] for section in sections]
    rest, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        q = b2 - a2 * gain
        rest += [(b1 - a1 * gain + q) * scale, q * scale]
        scale *= gain

    def level(prev: str, x: str) -> str:
        u, cells = x, []
        for s, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            p, q = f"{prev}p{s}", f"{prev}q{s}"
            y = f"({b0!r} * {u} + {p})"
            cells += [f"({b1!r} * {u} - {a1!r} * {y} + {q}) AS p{s}",
                      f"({b2!r} * {u} - {a2!r} * {y}) AS q{s}"]
            u = y
        return ", ".join([f"{u} AS y"] + cells)

    def first(x: str) -> str:
        zero = {f"p{s}": f"({rest[2 * s]!r} * {x})" for s in range(n)}
        zero |= {f"q{s}": f"({rest[2 * s + 1]!r} * {x})" for s in range(n)}
        text = level("@", x)
        for k, v in zero.items():
            text = text.replace("@" + k, v)
        return text

    def walk(name: str, source: str) -> str:
        return f"""
{name} AS (SELECT rec, j, {first('x')} FROM {source} WHERE j = 0
           UNION ALL
           SELECT s.rec, s.j, {level('f.', 's.x')} FROM {name} f
           JOIN {source} s ON s.rec = f.rec AND s.j = f.j + 1)"""

    return "WITH RECURSIVE" + USERS + f""",
ln_ AS (SELECT rec, max(i) + 1 AS n FROM u GROUP BY rec),
ends AS (SELECT u.rec, l.n, max(CASE WHEN i = 0 THEN v END) AS a, max(CASE WHEN i = n - 1 THEN v END) AS z
         FROM u JOIN ln_ l ON l.rec = u.rec GROUP BY u.rec, l.n),
ext AS (SELECT u.rec, u.i + {pad} AS j, u.v AS x FROM u
        UNION ALL SELECT u.rec, {pad} - u.i, 2 * a - v FROM u JOIN ends e ON e.rec = u.rec
                  WHERE u.i BETWEEN 1 AND {pad}
        UNION ALL SELECT u.rec, {pad} + n - 1 + (n - 1 - u.i), 2 * z - v FROM u JOIN ends e ON e.rec = u.rec
                  WHERE u.i BETWEEN n - 1 - {pad} AND n - 2),""" + walk("fw", "ext") + f""",
rev AS (SELECT fw.rec, n + {2 * pad - 1} - j AS j, y AS x FROM fw JOIN ln_ l ON l.rec = fw.rec),""" + \
        walk("bw", "rev") + f"""
SELECT bw.rec AS recording_id, n + {pad - 1} - j AS sample_idx, round(y, 5) AS eeg
FROM bw JOIN ln_ l ON l.rec = bw.rec WHERE j >= {pad} AND j < n + {pad}"""


def _spans(size: int, step: int) -> str:
    return "WITH" + SIGNAL + "," + wins(size, step) + f"""
SELECT w AS window_index, min(i) AS start_idx, max(i) AS end_idx, count(*) AS n,
       round(min(i) / 10.0, 6) AS start_time_sec FROM x GROUP BY w"""


def _pyramid() -> str:
    level = "SELECT CAST(b * {m} AS BIGINT) AS block_size, i // (b * {m}) AS bin, round(min(eeg), 6) AS low, " \
            "round(max(eeg), 6) AS high FROM sig, fb WHERE b * {g} < n OR {m} = 1 GROUP BY ALL"
    parts = " UNION ALL ".join(level.format(m=4**k, g=4 ** max(k - 1, 0)) for k in range(4))
    return "WITH" + SIGNAL + ", fb AS (SELECT greatest(1, CAST(ceil(n / 2000.0) AS BIGINT)) AS b, n FROM len) " + parts


def _histogram() -> str:
    cells = " UNION ALL ".join(
        f"SELECT 'eeg_{n}' AS feature, {n} AS v FROM t_eeg"
        for n in ("energy", "peak_to_peak", "zcr", "peak_count", "iemg2"))
    return TIMED + f""", c AS ({cells}),
b AS (SELECT feature, min(v) AS a, max(v) AS z FROM c GROUP BY feature),
k AS (SELECT feature, CASE WHEN a = z THEN a - 0.5 ELSE a END AS a, CASE WHEN a = z THEN z + 0.5 ELSE z END AS z FROM b)
SELECT c.feature, least(CAST(floor((v - a) / (z - a) * 30.0) AS BIGINT), 29) AS bin, count(*) AS n
FROM c JOIN k ON k.feature = c.feature GROUP BY ALL"""


def _boxes() -> str:
    cells = " UNION ALL ".join(
        f"SELECT 'eeg_{n}' AS feature, CAST(peak_count AS INT) % {STATES} AS label, {n} AS v FROM t_eeg"
        for n in ("energy", "peak_to_peak", "zcr", "peak_count", "iemg2"))
    return TIMED + f""", c AS ({cells})
SELECT feature, label, round(min(v), 8) AS low, round(quantile_cont(v, 0.25), 8) AS q1,
       round(quantile_cont(v, 0.5), 8) AS median, round(quantile_cont(v, 0.75), 8) AS q3,
       round(max(v), 8) AS high FROM c GROUP BY feature, label"""


def _shape_out(channel: str) -> str:
    names = ("energy", "peak_to_peak", "zcr", "peak_count", "iemg2")
    return WINDOWED + "," + shape(channel) + " SELECT w AS window_index, 'all' AS recording_id, " + ", ".join(
        f"round({n}, 6) AS {channel}_{n}" for n in names) + f" FROM t_{channel}"


LL = "greatest(a0, a1, a2) + ln(exp(a0 - greatest(a0, a1, a2)) + exp(a1 - greatest(a0, a1, a2)) " \
     "+ exp(a2 - greatest(a0, a1, a2)))"
N_PARAMS = (STATES - 1) + STATES * (STATES - 1) + 2 * STATES

ORACLES: dict[str, str] = {
    "csv_channels": """
WITH a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS eeg FROM events WHERE event_id % 7 <> 3),
b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i,
             CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS emg
      FROM events WHERE event_id % 5 <> 2)
SELECT 'all' AS recording_id, a.i AS sample_idx, round(eeg, 6) AS eeg, round(emg, 6) AS emg
FROM a JOIN b ON a.i = b.i""",
    "signal_by_user": """
SELECT CAST(user_id AS VARCHAR) AS recording_id,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_idx, round(value, 6) AS eeg,
       CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS emg FROM events""",
    "signal_zscore": "WITH" + SIGNAL + """
SELECT 'all' AS recording_id, i AS sample_idx,
       round((eeg - avg(eeg) OVER ()) / stddev_pop(eeg) OVER (), 6) AS eeg,
       round((emg - avg(emg) OVER ()) / stddev_pop(emg) OVER (), 6) AS emg FROM sig""",
    "filter_bandpass": _filter_sql(butterworth_bandpass(4, *QUERY_BAND, 10.0), 27),
    "filter_notch": _filter_sql(notch_section(QUERY_NOTCH, QUERY_QUALITY, 10.0), 9),
    "windows_tumbling": _spans(100, 100),
    "windows_overlapping": _spans(100, 50),
    "windows_spaced": _spans(40, 70),
    "windows_auto": "WITH" + SIGNAL + """
SELECT n AS n_rows, least(n // 20, 1) AS window_size,
       CAST(floor(least(n // 20, 1) * 0.25) AS BIGINT) AS overlap FROM len""",
    "window_metadata": WINDOWED + """
SELECT 'all' AS recording_id, w AS window_index, round(w * 5.0::DOUBLE, 6) AS start_time_sec,
       round(w * 5.0::DOUBLE + 10.0, 6) AS end_time_sec FROM wins""",
    "window_matrix": WINDOWED + """
SELECT w AS window_index, CAST(count(*) AS INT) AS size, round(sum(eeg * (o + 1)), 3) AS eeg,
       round(sum(emg * (o + 1)), 3) AS emg FROM x GROUP BY w""",
    "time_features_eeg": _shape_out("eeg"),
    "time_features_emg": _shape_out("emg"),
    "spectrum_power": SPECTRAL + """
SELECT w AS window_index, b AS bin, round(b * 0.1::DOUBLE, 6) AS freq, round(p, 4) AS power FROM pw""",
    "spectrum_features": SPECTRAL + """
SELECT w AS window_index, round(total, 5) AS eeg_total_power, round(dominant, 5) AS eeg_dominant_frequency,
       round(entropy, 5) AS eeg_spectral_entropy FROM spec""",
    "band_features": SPECTRAL + "," + BANDS + " SELECT w AS window_index, " + ", ".join(
        f"round({n}, 5) AS eeg_{n}_power, round({n} / greatest(total, 1e-12), 5) AS eeg_{n}_ratio"
        for n in BAND_BINS) + " FROM bp",
    "features_full_zscore": EVERYTHING + f" SELECT w AS window_index, {zscaled(FULL_NAMES, 'feat')} FROM feat",
    "features_full_minmax": EVERYTHING + f" SELECT w AS window_index, {minmaxed(FULL_NAMES)} FROM feat",
    "features_legacy_minmax": WINDOWED + "," + shape("emg") + """,
leg AS (SELECT w, peak_to_peak, zcr AS zero_crossing_rate, peak_count, iemg2 FROM t_emg)
SELECT w AS window_index, """ + minmaxed(
        ["peak_to_peak", "zero_crossing_rate", "peak_count", "iemg2"]) + " FROM leg",
    "features_inverse_scaling": BOTH + """
SELECT e.w AS window_index, round(e.energy, 6) AS eeg_energy, round(e.peak_to_peak, 6) AS eeg_peak_to_peak,
       round(m.energy, 6) AS emg_energy, round(m.peak_to_peak, 6) AS emg_peak_to_peak
FROM t_eeg e JOIN t_emg m ON m.w = e.w""",
    "nearest_centroid": NEAREST + " SELECT i AS window_index, CAST(label AS INT) AS label FROM near",
    "lloyd_step": NEAREST + f""",
nw AS (SELECT n.label AS k, a.d, avg(a.v) AS v FROM near n JOIN e a ON a.i = n.i GROUP BY n.label, a.d)
SELECT c.i AS cluster, c.d AS dim, round(coalesce(nw.v, c.v), 6) AS value
FROM e c LEFT JOIN nw ON nw.k = c.i AND nw.d = c.d WHERE c.i < {STATES}""",
    "kmeans_inertia": NEAREST + " SELECT round(sum(d2), 4) AS inertia FROM near",
    "gmm_em_step": GMM + """
SELECT r.k AS component, a.d AS dim, round(any_value(nk.nk) / (SELECT count(*) FROM near), 6) AS weight,
       round(any_value(m.mu), 6) AS mean,
       round(greatest(sum(r.r * (a.v - m.mu) * (a.v - m.mu)) / any_value(nk.nk), 1e-6), 6) AS variance
FROM resp r JOIN e a ON a.i = r.i JOIN nk ON nk.k = r.k JOIN mean m ON m.k = r.k AND m.d = a.d
GROUP BY r.k, a.d""",
    "gmm_information_criteria": GMM + f""",
ll AS (SELECT sum(z) AS l, count(*) AS n FROM norm)
SELECT round(l, 3) AS log_likelihood, round(-2 * l + 2.0 * {STATES - 1 + 2 * STATES * DIMS}, 3) AS aic,
       round(-2 * l + {STATES - 1 + 2 * STATES * DIMS} * ln(n), 3) AS bic FROM ll""",
    "silhouette": EMB + """,
pr AS (SELECT a.i, a.label, b.label AS o, b.i AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
       FROM e a JOIN e b ON b.d = a.d GROUP BY a.i, a.label, b.label, b.i),
intra AS (SELECT i, coalesce(avg(CASE WHEN d > 0 THEN d END), 0) AS a, count(*) AS n FROM pr WHERE o = label GROUP BY i),
inter AS (SELECT i, min(m) AS b FROM (SELECT i, o, avg(d) AS m FROM pr WHERE o <> label GROUP BY i, o) GROUP BY i)
SELECT 'given' AS method, round(avg(CASE WHEN n <= 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0
       ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM intra LEFT JOIN inter ON inter.i = intra.i""",
    "davies_bouldin": EMB + """,
c AS (SELECT label, d, avg(v) AS m FROM e GROUP BY label, d),
g AS (SELECT e.i, e.label, sqrt(sum((e.v - c.m) * (e.v - c.m))) AS r FROM e
      JOIN c ON c.label = e.label AND c.d = e.d GROUP BY e.i, e.label),
s AS (SELECT label, avg(r) AS s FROM g GROUP BY label),
f AS (SELECT a.label AS l, b.label AS o, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a
      JOIN c b ON b.d = a.d AND b.label <> a.label GROUP BY a.label, b.label),
w AS (SELECT f.l, max(CASE WHEN d > 0 THEN (x.s + y.s) / d ELSE 0 END) AS r FROM f
      JOIN s x ON x.label = f.l JOIN s y ON y.label = f.o GROUP BY f.l)
SELECT 'given' AS method, round(avg(r), 6) AS davies_bouldin FROM w""",
    "balance_entropy": """
WITH c AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS p FROM embeddings GROUP BY label)
SELECT 'given' AS method, round(-sum(p * log2(p)), 6) AS balance_entropy FROM c""",
    "average_spectra": LABELS + "," + SPECTRUM + f""",
a AS (SELECT l.method, l.label, p.b, avg(p.p) AS p FROM lab l JOIN pw p ON p.w = l.w GROUP BY ALL)
SELECT m.method, CAST(k.k AS INT) AS label, b.b AS bin, round(coalesce(a.p, 0), 4) AS power
FROM (SELECT DISTINCT method FROM lab) m CROSS JOIN range(0, {STATES}) k(k) CROSS JOIN range(0, 51) b(b)
LEFT JOIN a ON a.method = m.method AND a.label = k.k AND a.b = b.b""",
    "label_confusion": CROSS + " SELECT method, CAST(ref_label AS INT) AS ref_label, CAST(label AS INT) AS label, n FROM cf",
    "label_matching": PERMUTED + """
SELECT method, CAST(max(agreement) AS BIGINT) AS agreement FROM tr GROUP BY method
UNION ALL SELECT 'kmeans', CAST(sum(n) AS BIGINT) FROM cf WHERE method = 'kmeans' AND ref_label = label""",
    "label_relabel": LABELS + """
SELECT method, count(*) AS n, count(DISTINCT label) AS labels FROM lab GROUP BY method""",
    "hmm_log_emission": "WITH" + USER_MODEL + """
SELECT rec AS recording_id, i AS sample_idx, CAST(s AS INT) AS state, round(l, 6) AS log_density FROM em""",
    "hmm_forward_likelihood": recursion("sum") + f"""
SELECT rec AS recording_id, round({LL}, 5) AS log_likelihood FROM fw
WHERE (rec, i) IN (SELECT rec, max(i) FROM emw GROUP BY rec)""",
    "hmm_viterbi": VITERBI,
    "hmm_run_lengths": RUNS + " SELECT state, run_start, run_length FROM runs",
    "hmm_durations": RUNS + """
SELECT state, count(*) AS runs, round(avg(run_length / 10.0), 6) AS mean_duration_sec,
       round(max(run_length / 10.0), 6) AS longest_sec FROM runs GROUP BY state""",
    "hmm_transitions": HOPS + " SELECT from_state, to_state, n, round(probability, 6) AS probability FROM tr",
    "hmm_self_transition": HOPS + f""",
g AS (SELECT k, coalesce((SELECT probability FROM tr WHERE from_state = k AND to_state = k), 0) AS p
      FROM range(0, {STATES}) r(k))
SELECT round(avg(p), 6) AS mean_self_transition FROM g""",
    "hmm_bic": recursion("sum") + f"""
SELECT rec AS recording_id, {STATES} AS n_states, round(-2 * ({LL}) + {N_PARAMS} * ln(i + 1), 4) AS bic FROM fw
WHERE (rec, i) IN (SELECT rec, max(i) FROM emw GROUP BY rec)""",
    "pca_covariance": EMB + """,
c AS (SELECT i, d, v - avg(v) OVER (PARTITION BY d) AS v FROM e)
SELECT a.d AS i, b.d AS j, round(sum(a.v * b.v) / (count(*) - 1), 8) AS value
FROM c a JOIN c b ON b.i = a.i GROUP BY a.d, b.d""",
    "diffusion_kernel": EMB + """,
pr AS (SELECT a.i, b.i AS j, sum((a.v - b.v) * (a.v - b.v)) AS d FROM e a JOIN e b ON b.d = a.d GROUP BY a.i, b.i),
ep AS (SELECT greatest(coalesce(median(d), 1.0), 1e-6) AS e FROM pr WHERE d > 0)
SELECT i AS window_index, round(any_value(e), 6) AS epsilon, round(sum(exp(-d / e)), 6) AS row_sum
FROM pr, ep GROUP BY i""",
    "split_candidates": CELLS + """
SELECT 'd' || d AS feature, row_number() OVER (PARTITION BY d ORDER BY t) - 1 AS i, round(t, 6) AS threshold FROM cand""",
    "best_split": SPLITS + " SELECT d AS feature, round(t, 6) AS threshold, round(gain, 6) AS gain FROM bs",
    "f1_thresholds": RULES + """
SELECT c AS cluster, d AS feature, direction, round(t, 6) AS threshold, round(score, 6) AS score_f1 FROM top""",
    "tree_stump_predictions": STUMP + """
SELECT i AS window_index, CAST(label AS INT) AS label, CAST(predicted AS INT) AS predicted
FROM side JOIN win ON win.s = side.s""",
    "tree_stump_fidelity": STUMP + """
SELECT round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) AS fidelity
FROM side JOIN win ON win.s = side.s""",
    "minmax_pyramid": _pyramid(),
    "quantised_signal": "WITH" + SIGNAL + """
SELECT i AS sample_idx, CAST(least(greatest(round_even((eeg - min(eeg) OVER ())
       / (max(eeg) OVER () - min(eeg) OVER ()) * 65535.0 - 32768.0, 0), -32768), 32767) AS INT) AS eeg FROM sig""",
    "feature_histograms": _histogram(),
    "feature_box_stats": _boxes(),
    "threshold_summary": RULES + """
SELECT 'd' || d AS feature, round(avg(abs(t)), 6) AS mean_abs_threshold FROM top GROUP BY d""",
    "threshold_pivot": RULES + " SELECT c AS cluster, " + ", ".join(
        f"round(max(CASE WHEN d = {i} THEN t END), 6) AS d{i}" for i in range(DIMS)) + " FROM top GROUP BY c",
    "method_metrics": LABELS + """,
p AS (SELECT method, label, count(*) / sum(count(*)) OVER (PARTITION BY method) AS p FROM lab GROUP BY method, label)
SELECT method, round(-sum(p * log2(p)), 6) AS balance_entropy,
       CASE WHEN method = 'gmm' THEN count(DISTINCT label) END AS classes FROM p GROUP BY method""",
    "top_windows": TIMED + """
SELECT w AS window_index, round(energy, 6) AS eeg_energy FROM t_eeg ORDER BY energy DESC, w LIMIT 8""",
    "signal_opening": "WITH" + SIGNAL + """
SELECT i AS sample_idx, round(eeg, 6) AS eeg, emg FROM sig WHERE i < 200""",
    "window_stride": TIMED + " SELECT w AS window_index, round(zcr, 6) AS eeg_zcr FROM t_eeg WHERE w % 5 = 0",
    "transition_edges": HOPS + """
SELECT from_state, to_state, n, round(probability, 6) AS probability FROM tr WHERE probability >= 0.3""",
}

# The same results from recordings cut into many blocks.
ORACLES |= {many: ORACLES[one] for many, one in {
    "filter_bandpass_blocks": "filter_bandpass", "filter_notch_blocks": "filter_notch",
    "lloyd_step_blocks": "lloyd_step", "kmeans_inertia_blocks": "kmeans_inertia",
    "gmm_em_step_blocks": "gmm_em_step", "hmm_forward_blocks": "hmm_forward_likelihood",
    "hmm_viterbi_blocks": "hmm_viterbi", "pca_covariance_blocks": "pca_covariance",
    "diffusion_kernel_blocks": "diffusion_kernel"}.items()}
