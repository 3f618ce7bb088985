"""SQL for DuckDB that gives the rows of plans.queries from the same tables."""

from __future__ import annotations

from ..constants import METRICS, PRIORS, precision
from .queries import AS_OF, SQUEEZE

COLUMNS = {"pH": "ph", "turbidity": "turbidity", "conductivity": "conductivity", "temperature": "temperature"}
SEQ = "arrival_ts, event_id, copy"

BASE = """
tele as (select user_id sensor_id, date_trunc('hour', ts)::timestamp event_ts, case when event_id % 10 = 3 then ts + interval 20 hour else ts end arrival0, event_id,
 case event_type when 'signup' then 'lab' when 'purchase' then 'calibration' when 'view' then 'field' when 'click' then 'mobile' when 'error' then 'backup' end source,
 cast(regexp_extract(props, '[0-9]+') as int) k, value v from events),
base as (select sensor_id, event_ts, event_id, copy, source, case when copy = 1 then arrival0 + interval 1 minute else arrival0 end::timestamp arrival_ts,
 case when event_id % 5 <> 0 then 7.3e0 + (k - 50)::double / 50e0 end ph, case when event_id % 5 <> 1 then v / 20e0 end turbidity,
 case when event_id % 5 <> 2 then 420e0 + (k - 50)::double * 2e0 + v / 5e0 end conductivity, case when event_id % 5 <> 3 then 21e0 + ((k * 37) % 100 - 50)::double / 10e0 end temperature
 from tele, (values (0), (1)) c(copy) where copy = 0 or event_id % 20 = 7)"""

#: The same with event times close together and spikes of turbidity.
DENSE = BASE.replace("date_trunc('hour', ts)::timestamp event_ts", f"make_timestamp(epoch_us(ts::timestamp) // {SQUEEZE * 1_000_000} * 1000000) event_ts").replace("then v / 20e0 end turbidity", "then case when v > 200 then v * 2.5e0 else v / 20e0 end end turbidity")

MICRO = {c: f"'{m}=' || round({c} * 1e6)::bigint::varchar" for m, c in COLUMNS.items()}
FINGERPRINT = f"""sha256(concat_ws('|', sensor_id::varchar, strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || 'Z', concat_ws(',', {MICRO["conductivity"]}, {MICRO["ph"]}, {MICRO["temperature"]}, {MICRO["turbidity"]}), source))"""
UNIQUE = f"""{BASE},
fp as (select *, {FINGERPRINT} fingerprint, row_number() over (order by {SEQ}) sq from base),
u as (select * from fp qualify row_number() over (partition by fingerprint order by {SEQ}) = 1)"""
WEIGHT = "case source when 'lab' then 1e0 when 'calibration' then 0.95e0 when 'field' then 0.8e0 when 'mobile' then 0.6e0 else 0.5e0 end"
CONFIDENCE = "case source when 'lab' then 0.99e0 when 'calibration' then 0.95e0 when 'field' then 0.8e0 when 'mobile' then 0.65e0 else 0.5e0 end"
ROWS = f"""{UNIQUE},
m as ({" union all ".join(f"select sensor_id, event_ts, sq, event_id, copy, source, '{m}' metric, {c} as value from u where {c} is not null" for m, c in COLUMNS.items())})"""

P = precision()
DIFF = {c: f"coalesce({c} - {PRIORS[m][0]!r}e0, 0e0)" for m, c in COLUMNS.items()}


def square(prefix: str = "") -> str:
    cols = list(COLUMNS.values())
    diff = [f"coalesce({prefix}{c} - {PRIORS[m][0]!r}e0, 0e0)" for m, c in COLUMNS.items()]
    return " + ".join(f"({float(P[i][j]) * (1 if i == j else 2):.17e}) * {diff[i]} * {diff[j]}" for i in range(len(cols)) for j in range(i, len(cols)))


RUNNING = f"""{UNIQUE},
run as (select u.*, row_number() over w rn, {", ".join(f"(max({{'t': event_ts, 'w': {WEIGHT}, 's': sq, 'v': {c}}}) filter ({c} is not null) over w)['v'] m_{c}" for c in COLUMNS.values())},
 {", ".join(f"min({{'t': event_ts, 's': sq, 'p': {i}}}) filter ({c} is not null) over w f_{c}" for i, c in enumerate(COLUMNS.values()))}
 from u window w as (partition by sensor_id order by sq rows between unbounded preceding and current row))"""

LIMITS = {c: (PRIORS[m][2], PRIORS[m][3]) for m, c in COLUMNS.items()}
VIOLATION = "(list_sort([x for x in [" + ", ".join(f"case when m_{c} < {lo}e0 or m_{c} > {hi}e0 then {{'f': f_{c}, 'm': '{m}'}} end" for (m, c), (lo, hi) in zip(COLUMNS.items(), LIMITS.values())) + "] if x is not null]))[1]['m']"
SECONDS = "greatest(1e0, epoch_us(r.event_ts)::double / 1e6 - epoch_us(p.p_ts)::double / 1e6)"


def step(first: bool) -> str:
    """One event of the detector's recursion: r is the event, p the memory before it."""
    z = {c: f"((r.m_{c} - {PRIORS[m][0]!r}e0) / {PRIORS[m][1]!r}e0)" for m, c in COLUMNS.items()}
    find = (
        f"case when r.violation is not null then 'bounds' when p.p_ts is not null and abs((r.m_ph - p.p_ph) / {SECONDS} * 60e0) > 0.8e0 then 'ph_rate'"
        f" when p.p_ts is not null and (r.m_turbidity - p.p_turbidity) / {SECONDS} * 60e0 > 15e0 then 'turbidity_rate'"
        f" when p.p_ts is not null and r.m_temperature - p.p_temperature >= 3.5e0 and r.m_ph - p.p_ph <= -0.4e0 and {SECONDS} <= 300e0 then 'thermal' else 'retained' end"
    )
    rate = f"case when p.p_ts is not null and abs((r.m_ph - p.p_ph) / {SECONDS} * 60e0) > 0.8e0 then abs((r.m_ph - p.p_ph) / {SECONDS} * 60e0) / 1.5e0 else (r.m_turbidity - p.p_turbidity) / {SECONDS} * 60e0 / 30e0 end"
    keep = lambda new, old: f"case when ({find}) = 'retained' then {new} else {old} end"
    cols = [f"{keep('r.event_ts', 'p.p_ts')} p_ts"]
    cols += [f"{keep(f'r.m_{c}', f'p.p_{c}')} p_{c}" for c in COLUMNS.values()]
    for c in COLUMNS.values():
        cols.append(f"case when ({find}) = 'retained' and r.m_{c} is not null then greatest(0e0, p.up_{c} + {z[c]} - 0.5e0) else p.up_{c} end up_{c}")
        cols.append(f"case when ({find}) = 'retained' and r.m_{c} is not null then greatest(0e0, p.down_{c} - {z[c]} - 0.5e0) else p.down_{c} end down_{c}")
    zero = "(select null::timestamp p_ts, " + ", ".join(f"null::double p_{c}, 0e0 up_{c}, 0e0 down_{c}" for c in COLUMNS.values()) + ") p"
    source = f"from seen r, {zero} where r.rn = 1" if first else "from rec p join seen r on r.sensor_id = p.sensor_id and r.rn = p.rn + 1"
    return f"select r.sensor_id, r.rn, {find} finding, least(1e0, {rate}) rate_score, {', '.join(cols)} {source}"


DRIFTING = {c: f"(x.m_{c} is not null and greatest(up_{c}, down_{c}) > 4.5e0)" for c in COLUMNS.values()}
DRIFT = "greatest(" + ", ".join(f"case when {DRIFTING[c]} then greatest(up_{c}, down_{c}) / 8e0 else 0e0 end" for c in COLUMNS.values()) + ")"
DRIFT_METRIC = "case " + " ".join(f"when {DRIFTING[c]} then '{m}'" for m, c in reversed(COLUMNS.items())) + " end"
CONTRIBUTING = lambda p: "array_to_string([x for x in [" + ", ".join(f"case when abs({p}{c} - {PRIORS[m][0]!r}e0) / {PRIORS[m][1]!r}e0 > 2e0 then '{m}' end" for m, c in COLUMNS.items()) + "] if x is not null], ',')"
CLASSIFIED = f"""{RUNNING},
seen as materialized (select *, {VIOLATION} violation, {square("m_")} square from run),
rec as ({step(True)} union all {step(False)}),
typed as (select x.*, finding, rate_score, case when finding = 'retained' then {DRIFT} end drift, {DRIFT_METRIC} drift_metric, sqrt(greatest(0e0, square)) d,
 case when finding = 'bounds' then 'OUT_OF_BOUNDS' when finding in ('ph_rate', 'turbidity_rate') then 'TEMPORAL_RATE_OF_CHANGE' when finding = 'thermal' then 'THERMAL_PH_COUPLING'
 when square > 13.28e0 then 'MULTIVARIATE_OUTLIER' when {DRIFT} > 0 then 'SENSOR_DRIFT' else 'NONE' end anomaly_type
 from seen x join rec on rec.sensor_id = x.sensor_id and rec.rn = x.rn),
cls as materialized (select *, anomaly_type <> 'NONE' is_anomaly,
 case anomaly_type when 'OUT_OF_BOUNDS' then 'CRITICAL' when 'THERMAL_PH_COUPLING' then 'CRITICAL' when 'TEMPORAL_RATE_OF_CHANGE' then 'HIGH' when 'MULTIVARIATE_OUTLIER' then case when least(1e0, d / 6e0) > 0.75e0 then 'HIGH' else 'MEDIUM' end when 'SENSOR_DRIFT' then 'MEDIUM' else 'NORMAL' end severity,
 case anomaly_type when 'OUT_OF_BOUNDS' then 1e0 when 'THERMAL_PH_COUPLING' then 0.95e0 when 'TEMPORAL_RATE_OF_CHANGE' then rate_score when 'MULTIVARIATE_OUTLIER' then round(least(1e0, d / 6e0), 3) when 'SENSOR_DRIFT' then round(least(1e0, drift), 3) else round(d / 10e0, 3) end score,
 case when finding = 'bounds' then violation when finding = 'ph_rate' then 'pH' when finding = 'turbidity_rate' then 'turbidity' when finding = 'thermal' then 'temperature,pH'
 when anomaly_type = 'MULTIVARIATE_OUTLIER' then {CONTRIBUTING("m_")} when anomaly_type = 'SENSOR_DRIFT' then drift_metric else '' end contributing from typed)"""

CORROBORATED = f"""{CLASSIFIED},
pairs as (select a.sensor_id, b.sensor_id nb from (select distinct sensor_id from u) a join (select distinct sensor_id from u) b on a.sensor_id // 5 = b.sensor_id // 5 and a.sensor_id <> b.sensor_id),
known as (select a.sensor_id, a.sq, a.event_ts, nb, arg_max(n.is_anomaly, n.sq) last_flag, max(n.event_ts) filter (n.is_anomaly) ahead
 from cls a join pairs using (sensor_id) join cls n on n.sensor_id = nb and n.sq < a.sq where a.is_anomaly group by all),
near as (select distinct a.sensor_id, a.sq, a.nb from known a join cls n on n.sensor_id = a.nb and n.is_anomaly and n.sq < a.sq
 and n.event_ts between a.event_ts - interval 30 minute and a.event_ts + interval 30 minute and n.event_ts >= a.ahead - interval 3 hour),
by_nb as (select a.sensor_id, a.sq, string_agg(a.nb::varchar, ',' order by a.nb % 5) names from known a left join near n using (sensor_id, sq, nb) where last_flag or n.nb is not null group by all)"""

CHAIN = f"""{UNIQUE},
blocks as materialized (select sensor_id, row_number() over (partition by sensor_id order by sq) audit_id, sensor_id::varchar || '|' || event_id::varchar || '|' || fingerprint body from u),
chain as (select sensor_id, audit_id, body, repeat('0', 64) prev_hash, sha256(repeat('0', 64) || '|' || body) current_hash from blocks where audit_id = 1
 union all select b.sensor_id, b.audit_id, b.body, c.current_hash, sha256(c.current_hash || '|' || b.body) from chain c join blocks b on b.sensor_id = c.sensor_id and b.audit_id = c.audit_id + 1)"""

CELL = "round(value, 6) as value, event_ts, source"
LATE = "coalesce(event_ts < max(event_ts) over (partition by sensor_id order by sq rows between unbounded preceding and 1 preceding), false)"


def _state(rows: str, order: str, confidence: str, where: str = "true") -> str:
    return f"with {rows} select sensor_id, metric, {CELL}, {confidence} confidence from m where {where} qualify row_number() over (partition by sensor_id, metric order by {order}) = 1"


COUNTERS = "(select count(*) from base)"
PICK = ", ".join(f"round({c}, 6) {c}" for c in COLUMNS.values())
PERM = """perms as (select u.*, p perm, case when p > 0 then (event_id * 7919 + copy * 31 + p * 104729) % 1000003 else 0 end h from u, range(4) t(p)),
pm as ({rows}),
best as (select perm, sensor_id, metric, value from pm qualify row_number() over (partition by perm, sensor_id, metric order by event_ts desc, h desc, sq desc) = 1)"""

ORACLE = {
    "telemetry_normalized": f"with {BASE} select sensor_id, event_id, copy, event_ts, arrival_ts, source, {PICK} from base",
    "event_fingerprint": f"with {UNIQUE} select sensor_id, event_id, copy, fingerprint from fp",
    "fingerprint_canonical": f"""with {BASE} select sensor_id, event_id, copy, sha256('{{"readings":{{' || concat_ws(',', {", ".join(f"""'"{m}":' || round({c}, 6)::varchar""" for m, c in sorted(COLUMNS.items()))}) || '}},"sensor_id":"' || sensor_id || '","source":"' || source || '","timestamp":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || 'Z"}}') fingerprint from base""",
    "dedup_first_arrival": f"with {UNIQUE} select sensor_id, event_id, copy, event_ts, source from u",
    "dedup_incremental": f"with {UNIQUE} select sensor_id, event_id, copy from fp where (event_id % 2 = 1 or copy = 1) and fingerprint not in (select fingerprint from fp where event_id % 2 = 0 and copy = 0) qualify row_number() over (partition by fingerprint order by {SEQ}) = 1",
    "duplicate_status": f"with {UNIQUE}, l as (select sq, {LATE} is_late from u) select sensor_id, event_id, copy, case when l.sq is null then 'DUPLICATE_SKIPPED' when is_late then 'OUT_OF_ORDER_RECONSTRUCTED' else 'PROCESSED' end status from fp left join l using (sq)",
    "out_of_order_flags": f"with {UNIQUE} select sensor_id, event_id, copy, {LATE} is_late, case when {LATE} then 'OUT_OF_ORDER_INGEST' else 'TELEMETRY_INGEST' end as action from u",
    "timeline_positions": f"with {UNIQUE} select sensor_id, event_id, copy, event_ts, row_number() over (partition by sensor_id order by event_ts, sq) as position from u",
    "state_source_priority": _state(ROWS, f"event_ts desc, {WEIGHT} desc, sq desc", f"round({WEIGHT}, 6)"),
    "state_latest": _state(ROWS, "event_ts desc, sq desc", "1e0"),
    "state_confidence_weighted": f"""with recursive {ROWS}, ties as (select * from m qualify event_ts = max(event_ts) over (partition by sensor_id, metric)), last as (select *, row_number() over (partition by sensor_id, metric order by sq) rn from ties),
 fold as (select sensor_id, metric, rn, event_ts, value, source, {CONFIDENCE} w, {CONFIDENCE} confidence from last where rn = 1
 union all select l.sensor_id, l.metric, l.rn, l.event_ts, round((l.value * ({CONFIDENCE.replace("source", "l.source")}) + f.value * f.w) / (({CONFIDENCE.replace("source", "l.source")}) + f.w), 4), 'weighted_fusion(' || f.source || '+' || l.source || ')', 0.5e0, least(1e0, (({CONFIDENCE.replace("source", "l.source")}) + f.w) / 1.5e0)
 from fold f join last l on l.sensor_id = f.sensor_id and l.metric = f.metric and l.rn = f.rn + 1)
 select sensor_id, metric, round(value, 3) as value, event_ts, source, round(confidence, 6) confidence from fold qualify row_number() over (partition by sensor_id, metric order by rn desc) = 1""",
    "state_as_of": _state(ROWS, f"event_ts desc, {WEIGHT} desc, sq desc", f"round({WEIGHT}, 6)", f"event_ts <= timestamp '{AS_OF}'"),
    "state_headers": f"with {UNIQUE} select sensor_id, event_ts last_event_time, source last_source, count(*) over (partition by sensor_id) as version from u qualify row_number() over (partition by sensor_id order by event_ts desc, sq desc) = 1",
    "state_running": f"with {RUNNING} select sensor_id, event_id, copy, {', '.join(f'round(m_{c}, 6) {c}' for c in COLUMNS.values())} from run",
    "fleet_states": f"with {RUNNING} select sensor_id, rn as version, {', '.join(f'round(m_{c}, 6) {c}' for c in COLUMNS.values())} from run qualify row_number() over (partition by sensor_id order by sq desc) = 1",
    "decision_trace": f"""with {ROWS}, prev as (select *, max(event_ts) over (partition by sensor_id, metric order by sq rows between unbounded preceding and 1 preceding) had from m),
 n as (select sq, count(*) n_notes, coalesce(string_agg(metric, ',' order by case metric when 'pH' then 0 when 'turbidity' then 1 when 'conductivity' then 2 else 3 end) filter (had is not null and event_ts >= had), '') conflicting_fields from prev group by sq)
 select sensor_id, event_id, copy, coalesce(conflicting_fields, '') conflicting_fields, coalesce(n_notes, 0) n_notes from u left join n using (sq)""",
    "source_weights": f"with {UNIQUE} select source, max({WEIGHT}) weight, count(*) n_events from u group by source",
    "out_of_bounds": f"with {ROWS} select metric, count(*) n_violations, round(max(value), 6) max_value from m where "
    + " or ".join(f"(metric = '{m}' and (value * 2 < {PRIORS[m][2]!r}e0 or value * 2 > {PRIORS[m][3]!r}e0))" for m in METRICS)
    + " group by metric",
    "mahalanobis_score": f"with {UNIQUE} select sensor_id, event_id, copy, round({square()}, 4) mahalanobis_sq, ({square()}) > 13.28e0 is_outlier from u",
    "zscore_contributors": f"with {UNIQUE} select sensor_id, event_id, copy, {CONTRIBUTING('')} contributing from u",
    "display_bands": f"with {ROWS} select metric, count(*) filter (case metric when 'pH' then value > 8.5e0 or value < 6.5e0 when 'turbidity' then value > 5e0 when 'conductivity' then value > 800e0 else value > 26e0 end) n_outside, count(*) n from m group by metric",
    "rate_of_change_pairs": f"with {ROWS} select sensor_id, event_id, copy, metric, round((value - lag(value) over w) / greatest(1e0, (epoch_us(event_ts) - epoch_us(lag(event_ts) over w)) / 1e6) * 60e0, 8) rate_per_min from m window w as (partition by sensor_id, metric order by sq)",
    "cusum_running": f"""with {ROWS}, z as (select *, case metric {" ".join(f"when '{m}' then (value - {PRIORS[m][0]!r}e0) / {PRIORS[m][1]!r}e0" for m in METRICS)} end z from m),
 c as (select *, sum(z - 0.5e0) over w cp, sum(-z - 0.5e0) over w cn from z window w as (partition by sensor_id, metric order by sq rows between unbounded preceding and current row))
 select sensor_id, event_id, copy, metric, round(cp - least(0e0, min(cp) over w), 5) s_pos, round(cn - least(0e0, min(cn) over w), 5) s_neg from c window w as (partition by sensor_id, metric order by sq rows between unbounded preceding and current row)""",
    "anomaly_classify": f"with recursive {CLASSIFIED} select sensor_id, event_id, copy, anomaly_type, severity, is_anomaly, round(score, 3) anomaly_score, contributing from cls",
    "spatial_corroboration": f"with recursive {CORROBORATED} select sensor_id, event_id, copy, names is not null is_corroborated, coalesce(names, '') corroborated_by from cls left join by_nb using (sensor_id, sq) where is_anomaly",
    "cluster_status": f"""with recursive {CLASSIFIED}, f as (select sensor_id, arg_max(is_anomaly, sq) a from cls group by 1)
 select sensor_id // 5 as cluster, count(*) total_sensors, count(*) filter (a) anomalous_sensors, case when count(*) filter (a) >= 2 then 'CONTAMINATION_PLUME_ALERT' when count(*) filter (a) = 1 then 'LOCAL_SENSOR_WARNING' else 'HEALTHY' end status from f group by 1""",
    "fleet_overview": f"""with recursive {CLASSIFIED}, f as (select sensor_id, arg_max(is_anomaly, sq) a from cls group by 1), l as (select {LATE} is_late from u)
 select (select count(*) from f) total_sensors, (select count(*) filter (a) from f) anomalous_sensors, (select count(*) from base) processed, (select count(*) from base) - (select count(*) from u) duplicates, (select count(*) filter (is_late) from l) out_of_order""",
    "replay_summary": f"""with recursive {CLASSIFIED}, l as (select {LATE} is_late from u)
 select (select count(*) from base) received, (select count(*) from u) unique_events, (select count(*) from base) - (select count(*) from u) duplicates, (select count(*) filter (is_late) from l) out_of_order, (select count(*) filter (is_anomaly) from cls) anomalies, (select count(distinct sensor_id) from u) sensors""",
    "order_invariance": f"""with {UNIQUE}, {PERM.format(rows=" union all ".join(f"select perm, sensor_id, event_ts, h, sq, source, '{m}' metric, {c} as value from perms where {c} is not null" for m, c in COLUMNS.items()))}
 select o.perm::int perm, o.sensor_id, o.metric, round(b.value, 6) base, round(o.value, 6) other from best b join best o using (sensor_id, metric) where b.perm = 0 and o.perm > 0 and abs(b.value - o.value) > 1e-5""",
    "ledger_chain": f"with recursive {CHAIN} select sensor_id, audit_id, prev_hash, current_hash from chain",
    "ledger_continued": f"""with recursive {CHAIN.replace("order by sq) audit_id, sensor_id::varchar", "order by event_id % 2, sq) audit_id, event_id, sensor_id::varchar").replace("select sensor_id, audit_id, body, repeat", "select sensor_id, event_id, audit_id, body, repeat").replace("select b.sensor_id, b.audit_id", "select b.sensor_id, b.event_id, b.audit_id")}
 select sensor_id, event_id, audit_id, prev_hash, current_hash, true as holds from chain""",
    "ledger_faults": f"""with recursive {CHAIN}, edited as (select sensor_id, audit_id, case when audit_id % 7 = 0 then body || 'x' else body end body, case when audit_id % 11 = 0 then repeat('0', 64) else prev_hash end prev_hash, current_hash from chain),
 checked as (select *, coalesce(lag(current_hash) over (partition by sensor_id order by audit_id), repeat('0', 64)) expected from edited)
 select sensor_id, audit_id, case when prev_hash <> expected then 'Broken link' else 'Hash mismatch' end reason from checked where prev_hash <> expected or current_hash <> sha256(prev_hash || '|' || body)""",
    "audit_page": f"with recursive {CHAIN} select sensor_id, audit_id, current_hash from chain where sensor_id = 7 order by audit_id limit 10 offset 5",
    "ledger_heads": f"with recursive {CHAIN} select sensor_id, count(*) as blocks, arg_max(current_hash, audit_id) head from chain group by 1",
    "csv_projection": f"with {UNIQUE} select sensor_id, event_id, copy, strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || 'Z' event_timestamp, source, {', '.join(f"""coalesce(round({c} * 1000)::bigint::varchar, '') {c}""" for c in COLUMNS.values())} from u",
    "csv_export": f"""with recursive {CLASSIFIED}, {CHAIN.removeprefix(UNIQUE).lstrip().removeprefix(",")}, l as (select sq, {LATE} is_late from u)
 select audit_id, case when is_late then 'OUT_OF_ORDER_INGEST' else 'TELEMETRY_INGEST' end as action, cls.sensor_id, strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || 'Z' event_timestamp, '1970-01-01T00:00:00Z' received_timestamp, {PICK}, source,
 is_anomaly, anomaly_type, round(score, 3) anomaly_score, 'source_priority' conflict_strategy, current_hash, prev_hash from cls join l using (sq) join chain on chain.sensor_id = cls.sensor_id and chain.audit_id = cls.rn""",
    "anomaly_dense": f"with recursive {CLASSIFIED.replace(BASE, DENSE)} select sensor_id, event_id, copy, anomaly_type, severity, is_anomaly, round(score, 6) anomaly_score, contributing from cls",
    "timeline_states": f"""with {UNIQUE} select sensor_id, event_id, copy, count(*) over w known_events, {", ".join(f"round((max({{'t': event_ts, 'w': {WEIGHT}, 's': sq, 'v': {c}}}) filter ({c} is not null) over w)['v'], 6) {c}" for c in COLUMNS.values())}
 from u window w as (partition by sensor_id order by event_ts range between unbounded preceding and current row)""",
    "state_mismatches": f"""with {ROWS}, a as (select sensor_id, metric, arg_max(value, {{'t': event_ts, 's': sq}}) v from m where event_ts <= timestamp '{AS_OF}' group by all), b as (select sensor_id, metric, arg_max(value, {{'t': event_ts, 's': sq}}) v from m group by all)
 select sensor_id, metric, round(a.v, 6) base, round(b.v, 6) as other, case when b.v is null then 'missing in the other run' when a.v is null then 'missing in the first run' else 'differs' end reason
 from a full join b using (sensor_id, metric) where a.v is null or b.v is null or abs(a.v - b.v) > 1e-5""",
    "cluster_lookup": "select distinct user_id sensor_id, case when user_id % 7 = 0 then 1000 + user_id // 70 else user_id // 5 end as cluster from events",
    "text_normalized": f"""with {BASE} select sensor_id::varchar sensor_id, event_id, event_ts, case when event_id % 3 > 0 then source else 'field' end source, round((event_id % 140) / 10e0, 6) ph, event_id::double turbidity, 2::bigint n_readings
 from base where copy = 0 and event_id % 4 <> 3 and event_id % 9 <> 0""",
    "text_rejected": "select case when event_id % 4 = 3 then 'bad timestamp' else 'non-numeric reading' end reject_reason, count(*) n from events where event_id % 4 = 3 or event_id % 9 = 0 group by 1",
    "fleet_filtered": f"""with recursive {CLASSIFIED}, f as (select *, rn = max(rn) over (partition by sensor_id) is_last from cls)
 select sensor_id, sensor_id // 5 as cluster, rn as version, {", ".join(f"round(m_{c}, 6) {c}" for c in COLUMNS.values())} from f where is_last and is_anomaly and sensor_id::varchar like '%1%'""",
    "top_anomalies": f"with recursive {CLASSIFIED.replace(BASE, DENSE)} select sensor_id, event_id, copy, anomaly_type, severity, is_anomaly, round(score, 6) anomaly_score, contributing from cls where is_anomaly order by round(score, 6) desc, sq desc limit 25",
    "anomaly_explanations": f"""with recursive {CLASSIFIED.replace(BASE, DENSE)} select sensor_id, event_id, copy,
 case anomaly_type when 'OUT_OF_BOUNDS' then violation || ' is outside its physical limits' when 'TEMPORAL_RATE_OF_CHANGE' then contributing || ' changes by # per minute' when 'THERMAL_PH_COUPLING' then 'temperature # with pH # within # s'
 when 'MULTIVARIATE_OUTLIER' then 'Mahalanobis distance #' when 'SENSOR_DRIFT' then 'cumulative drift of ' || drift_metric else 'within statistical and temporal bounds' end explanation,
 case when anomaly_type in ('MULTIVARIATE_OUTLIER', 'NONE') then round(square, 2) end mahalanobis_sq from cls""",
    "anomaly_diagnoses": f"""with recursive {CORROBORATED}, size as (select sensor_id // 5 as cluster, count(distinct sensor_id) members from u group by 1)
 select sensor_id, event_id, copy, case when names is not null then 'SYSTEMIC PLUME: corroborated by ' || replace(names, ',', ', ') || ' of ' || cluster::bigint::varchar
 when members < 2 then 'no neighbours known of ' || sensor_id::varchar else 'LOCALIZED ISOLATED: no neighbour corroborates' end diagnosis
 from cls left join by_nb using (sensor_id, sq) join size on cls.sensor_id // 5 = size.cluster where is_anomaly""",
    # format rounds the exact value of the double, as the fold does.
    "state_running_fused": f"""with recursive {ROWS}, arrived as materialized (select *, {CONFIDENCE} w, row_number() over (partition by sensor_id, metric order by sq) rn from m),
 fold as (select sensor_id, metric, rn, event_id, copy, event_ts, value, source, w, w confidence from arrived where rn = 1
 union all select a.sensor_id, a.metric, a.rn, a.event_id, a.copy, greatest(a.event_ts, f.event_ts),
 case when a.event_ts > f.event_ts then a.value when a.event_ts < f.event_ts then f.value else format('{{:.4f}}', (a.value * a.w + f.value * f.w) / (a.w + f.w))::double end,
 case when a.event_ts > f.event_ts then a.source when a.event_ts < f.event_ts then f.source else 'weighted_fusion(' || f.source || '+' || a.source || ')' end,
 case when a.event_ts > f.event_ts then a.w when a.event_ts < f.event_ts then f.w else 0.5e0 end,
 case when a.event_ts > f.event_ts then a.w when a.event_ts < f.event_ts then f.confidence else least(1e0, (a.w + f.w) / 1.5e0) end
 from fold f join arrived a on a.sensor_id = f.sensor_id and a.metric = f.metric and a.rn = f.rn + 1)
 select sensor_id, event_id, copy, metric, round(value, 6) as value, source, round(confidence, 6) confidence from fold""",
    "state_as_of_known": f"""with {UNIQUE}, k as (select * from u where arrival_ts <= timestamp '{AS_OF}' + interval 12 hour), p as (select * from k where event_ts <= timestamp '{AS_OF}')
 select sensor_id, case when n is null then 1 else n end as version, coalesce(n, 0) total_events, last_event_time, coalesce(n_readings, 0) n_readings from (select distinct sensor_id from k)
 left join (select sensor_id, count(*) n, max(event_ts) last_event_time, {" + ".join(f"(count({c}) > 0)::bigint" for c in COLUMNS.values())} n_readings from p group by 1) using (sensor_id)""",
    "ledger_global": f"with {UNIQUE}, b as (select list(sensor_id::varchar || '|' || event_id::varchar || '|' || fingerprint order by sq) bodies from u) select len(bodies) as blocks, list_reduce(bodies, lambda h, x: sha256(h || '|' || x), repeat('0', 64)) head from b",
    "runs_compared": f"""with {ROWS}, runs as (select m.*, p::int perm from m, range(5) t(p)),
 c as (select perm, sensor_id, metric, arg_max(value, {{'t': event_ts, 's': sq}}) v from runs
 where not (perm = 1 and event_id % 9 = 0 or perm = 2 and sensor_id % 7 = 0 or perm = 3 and sensor_id % 5 = 0 and metric = 'conductivity' or perm = 4) group by all),
 g as (select p::int perm, sensor_id, metric, v from c, range(1, 5) t(p) where perm = 0),
 b as (select coalesce(g.perm, o.perm) perm, coalesce(g.sensor_id, o.sensor_id) sensor_id, coalesce(g.metric, o.metric) metric, g.v base, o.v as other from g full join (select * from c where perm > 0) o on o.perm = g.perm and o.sensor_id = g.sensor_id and o.metric = g.metric),
 f as (select *, count(other) over (partition by perm, sensor_id) n from b)
 select perm, sensor_id, metric, round(base, 6) base, round(other, 6) as other, case when other is null and n = 0 then 'sensor missing in the other run' when other is null then 'missing in the other run' else 'differs' end reason
 from f where other is null or abs(base - other) > 1e-5""",
    "replay_battery": f"""with recursive {CLASSIFIED.replace("user_id sensor_id", "user_id * 10 + event_id % 5 sensor_id")}, l as (select sensor_id, {LATE} is_late from u),
 r as (select 'file' || sensor_id % 10 file, count(*) received from base group by 1), n as (select 'file' || sensor_id % 10 file, count(*) unique_events, count_if(is_late)::bigint out_of_order, count(distinct sensor_id) sensors from l group by 1),
 a as (select 'file' || sensor_id % 10 file, count_if(is_anomaly)::bigint anomalies from cls group by 1)
 select file, received, unique_events, received - unique_events duplicates, out_of_order, anomalies, sensors, true ledger_valid, sensors n_states from r join n using (file) join a using (file)""",
    "timeline_states_fused": f"""with recursive {ROWS}, ties as materialized (select *, {CONFIDENCE} w, row_number() over (partition by sensor_id, metric, event_ts order by sq) rn, count(*) over (partition by sensor_id, metric, event_ts) n from m),
 fold as (select sensor_id, metric, event_ts, rn, n, value, source, w, w confidence from ties where rn = 1
 union all select a.sensor_id, a.metric, a.event_ts, a.rn, a.n, round((a.value * a.w + f.value * f.w) / (a.w + f.w), 4), 'weighted_fusion(' || f.source || '+' || a.source || ')', 0.5e0, least(1e0, (a.w + f.w) / 1.5e0)
 from fold f join ties a on a.sensor_id = f.sensor_id and a.metric = f.metric and a.event_ts = f.event_ts and a.rn = f.rn + 1),
 done as (select * from fold where rn = n),
 k as (select *, count(*) over (partition by sensor_id order by event_ts range between unbounded preceding and current row) known_events from u)
 select k.sensor_id, k.event_id, k.copy, known_events, d.metric, case when d.rn > 1 then round(d.value, 3) else round(d.value, 6) end as value, d.event_ts, d.source, round(d.confidence, 6) confidence
 from k cross join (select unnest(['pH', 'turbidity', 'conductivity', 'temperature']) metric) x asof join done d on d.sensor_id = k.sensor_id and d.metric = x.metric and k.event_ts >= d.event_ts""",
    "state_own_strategy": f"""with {ROWS}, ties as (select *, {CONFIDENCE} w from m qualify event_ts = max(event_ts) over (partition by sensor_id, metric))
 select sensor_id, metric, round(sum(value * w) / sum(w), 6) as value, event_ts, string_agg(distinct source, '+' order by source) source, round(sum(w) / (sum(w) + 1), 6) confidence from ties group by sensor_id, metric, event_ts""",
    "state_own_weights": f"with {RUNNING.replace(WEIGHT, "case source when 'mobile' then 0.9e0 when 'backup' then 0.7e0 when 'lab' then 0.6e0 else 0.5e0 end")} select sensor_id, event_id, copy, {', '.join(f'round(m_{c}, 6) {c}' for c in COLUMNS.values())} from run",
    "neighbour_list": "with s as (select distinct user_id s from events) select a.s // 5 as cluster, a.s sensor_id, b.s neighbour, (b.s % 5)::int pos from s a join s b on a.s // 5 = b.s // 5 and a.s <> b.s",
    "decisions_annotated": f"""with recursive {CORROBORATED}, l as (select sq, {LATE} is_late from u)
 select sensor_id, event_id, copy, anomaly_type, case when is_anomaly then names is not null end is_corroborated, case when is_anomaly then coalesce(names, '') end corroborated_by,
 case when is_late then 'OUT_OF_ORDER_INGEST' else 'TELEMETRY_INGEST' end as action, case when is_late then 'OUT_OF_ORDER_RECONSTRUCTED' else 'PROCESSED' end status from cls join l using (sq) left join by_nb using (sensor_id, sq)""",
    "document_exact_dedup": "select sha256(text) digest, min(doc_id) doc_id, count(*) n_copies from documents group by 1",
}
