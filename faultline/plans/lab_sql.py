"""The same ledger in DuckDB's SQL, written apart from the DataFrame operators."""

from __future__ import annotations


def prefixed(value: str) -> str:
    return f"coalesce('s' || length({value}) || ':' || {value} || '|', 'n|')"


def event_id(*fields: str) -> str:
    return "sha256('dqm-event-v1|' || " + " || ".join(prefixed(f) for f in fields) + ")"


def shown(column: str) -> str:
    """A timestamp as text."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def hours(a: str, b: str) -> str:
    return f"date_diff('hour', {a}, {b})"


NOW = "timestamp '2024-02-01 06:30:00'"
USER, USER_AND_TYPE = "dqm-id-v1|k7:user_id|", "dqm-id-v1|k7:user_id|k10:event_type|"
_SCHEME = f"case when event_type = 'purchase' and n between 5 and 18 then null when event_type = 'view' and n >= 20 then '{USER_AND_TYPE}' else '{USER}' end"
_STATUS = """case when event_type = 'signup' and n % 13 = 5 then 'collection_error' when event_type = 'error' and n = 29 then 'pending'
    when event_type in ('click', 'view') and n % 10 = 7 then 'limit_reached' else 'success' end"""
USABLE = "status in ('success', 'not_applicable', 'limit_reached') and result in ('pass', 'warn', 'fail')"
CONCLUSIVE = "status in ('success', 'not_applicable') and result in ('pass', 'warn', 'fail')"

BASE = f"""
daily as (
    select event_type, user_id, cast(ts as date) as day, day(ts) as n, count(*) as row_count, cast(max(event_id) % 3 as varchar) as band
    from events group by all),
obs as (
    select 'events.' || event_type as check_id, 'run-' || strftime(day, '%Y%m%d') as invocation_id,
        sha256('dqm-id-v1|k7:user_id|' || {prefixed("cast(user_id as varchar)")} ||
            case when {_SCHEME} = '{USER_AND_TYPE}' then 'k10:event_type|' || {prefixed("event_type")} else '' end) as identity,
        {_SCHEME} as scheme,
        cast(json_object('user_id', cast(user_id as varchar), 'event_type', event_type, 'band', band) as varchar) as payload,
        row_count, case user_id % 4 when 0 then 'alice' when 1 then ' bob ' end as owner,
        'ask ' || event_type || case when n % 2 = 0 then ' today' else ' soon' end as call_to_action, n
    from daily where {_STATUS} = 'success' or ({_STATUS} = 'limit_reached' and user_id % 2 = 0)),
runs as (
    select event_type, cast(day as date) as day, day(day) as n
    from (select distinct event_type from events), (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day)) as day)),
execs as (
    select *, case when failure_count = 0 then 'pass' when check_id = 'events.view' then 'warn' else 'fail' end as result from (
        select 'events.' || event_type as check_id, 'run-' || strftime(day, '%Y%m%d') as invocation_id,
            cast(day as timestamp) + interval 1 day as captured_at, n, {_STATUS} as status, {_SCHEME} as scheme,
            case when n % 9 = 0 then null when event_type = 'error' then 'critical' else 'medium' end as priority,
            '["' || event_type || '"," ops "]' as tags, 'Check ' || event_type || case when n > 20 then ' v2' else '' end as check_name,
            'raw.events' as source_id, 'db.raw.' || event_type as source_name, case when n % 5 = 0 then 'warn' else 'error' end as severity,
            case when {_SCHEME} = '{USER_AND_TYPE}' then '["user_id","event_type"]' when {_SCHEME} = '{USER}' then '["user_id"]' end as granularity,
            case when n % 4 <> 0 then 'c' || n % 3 end as criticality,
            (select count(*) from obs o where o.check_id = 'events.' || runs.event_type and o.n = runs.n) as failure_count,
            case when n % 3 = 0 then 1 else 0 end as owner_conflicts
        from runs)),
tracked as (select distinct 'events.' || event_type as check_id, event_type as check_name, 'error' as severity from events where event_type <> 'signup'),
receipts as (select check_id, invocation_id, 'applied' as outcome from execs where {USABLE} and n <= 28),
missed as (
    select 'missed-' || c_custkey as missed_id, case when c_custkey % 100 = 0 then 'events.error' else 'events.click' end as check_id,
        case when c_custkey % 150 <> 0 then 'area.' || c_custkey % 3 end as source_id,
        case when c_custkey % 150 = 0 then c_mktsegment end as area_label,
        {NOW} - to_days(cast(c_custkey % 60 as integer)) as discovered_at
    from customer)"""

_NOTHING = """none_occ as (select null::varchar as occurrence_id, null::varchar as check_id, null::varchar as identity, null::varchar as scheme, 0 as number,
    null::varchar as payload, 0::bigint as row_count, null::varchar as tags, null::varchar as priority, null::timestamp as first_seen_at,
    null::timestamp as last_seen_at, null::timestamp as archived_at, null::varchar as record_status, null::varchar as close_reason,
    null::varchar as first_invocation, null::varchar as last_seen_invocation, null::varchar as last_invocation, null::varchar as workflow_status,
    null::varchar as owner, null::varchar as verdict, 0 as version, null::varchar as workflow_at_close, null::varchar as check_name, null::varchar as source_id, null::varchar as source_name,
    null::varchar as severity, null::varchar as test_status, null::varchar as call_to_action, null::varchar as ticket_url, null::varchar as notes,
    null::timestamp as annotated_at, null::varchar as granularity, null::varchar as criticality where false)"""


def replayed(t: str, first: int, last: int, history: str) -> str:
    """CTEs {t}_st, {t}_ok, {t}_occ and {t}_ev: a replay of the runs of these days over a history."""
    key = "check_id, identity, scheme"
    same = lambda a, b: " and ".join(f"{a}.{c} is not distinct from {b}.{c}" for c in ("check_id", "identity", "scheme"))
    return f"""
{t}_e as (select * from execs where {USABLE} and n between {first} and {last}),
{t}_o as (select * from obs where n between {first} and {last}),
{t}_a as (select * from {history} where record_status = 'Active'),
{t}_c as (select {key} from {t}_o union select {key} from {t}_a),
{t}_m as (
    select c.*, e.invocation_id, e.captured_at, e.status, e.scheme as run_scheme, e.priority, e.tags, e.check_name, e.source_id, e.source_name, e.severity,
        e.granularity, e.criticality, o.identity is not null as failing, o.payload, o.row_count, o.owner, o.call_to_action, a.occurrence_id as open_id, a.payload as open_payload
    from {t}_c c join {t}_e e on c.check_id = e.check_id
        left join {t}_o o on {same("o", "c")} and o.invocation_id = e.invocation_id
        left join {t}_a a on {same("a", "c")}
    where o.identity is not null or e.status <> 'limit_reached'),
{t}_l as (
    select *, case when row_number() over w = 1 then open_id is not null else lag(failing) over w end as was_failing,
        case when row_number() over w = 1 then open_payload else lag(payload) over w end as was_payload
    from {t}_m window w as (partition by {key} order by captured_at, invocation_id)),
{t}_st as (
    select *, failing and not was_failing as starts,
        cast(sum(case when failing and not was_failing then 1 else 0 end) over (
            partition by {key} order by captured_at, invocation_id rows unbounded preceding) as integer) as episode
    from {t}_l),
{t}_ok as (
    select * from (
        select *, min(captured_at) filter (not failing) over (partition by {key}, episode) as absent_at from {t}_st)
    where (episode > 0 or open_id is not null) and captured_at <= coalesce(absent_at, captured_at)),
{t}_r as (
    select {key}, episode, count(*) filter (failing) as n_failing,
        arg_min({{'at': captured_at, 'inv': invocation_id, 'owner': owner, 'action': call_to_action, 'name': check_name, 'sid': source_id, 'sname': source_name,
            'sev': severity, 'gran': granularity}}, captured_at) filter (failing) as f,
        arg_max({{'at': captured_at, 'inv': invocation_id, 'payload': payload, 'row_count': row_count}}, captured_at) filter (failing) as l,
        arg_min({{'at': captured_at, 'scheme': run_scheme}}, captured_at) filter (not failing) as a,
        arg_max({{'inv': invocation_id, 'priority': priority, 'tags': tags, 'crit': criticality}}, captured_at) as x
    from {t}_ok group by {key}, episode),
{t}_occ as (
    select case when r.episode = 0 then o.occurrence_id else sha256(r.check_id || '|' || r.identity || '|' || f.inv) end as occurrence_id,
        r.check_id, r.identity, r.scheme,
        cast(case when r.episode = 0 then o.number else coalesce((select max(number) from {history} h where h.check_id = r.check_id and h.identity = r.identity), 0) + r.episode end as integer) as number,
        case when r.episode = 0 then coalesce(l.payload, o.payload) else l.payload end as payload,
        case when r.episode = 0 then coalesce(l.row_count, o.row_count) else l.row_count end as row_count,
        x.tags as tags, x.priority as priority,
        case when r.episode = 0 then o.first_seen_at else f.at end as first_seen_at,
        case when r.episode = 0 then coalesce(l.at, o.last_seen_at) else l.at end as last_seen_at,
        a.at as archived_at, case when a.at is null then 'Active' else 'Archived' end as record_status,
        case when a.at is null then null when r.scheme = a.scheme then 'Passed' else 'IDENTITY_CHANGED' end as close_reason,
        case when r.episode = 0 then o.first_invocation else f.inv end as first_invocation,
        case when r.episode = 0 then coalesce(l.inv, o.last_seen_invocation) else l.inv end as last_seen_invocation,
        x.inv as last_invocation,
        case when r.episode = 0 then o.workflow_status else 'NEW' end as workflow_status,
        case when r.episode = 0 then o.owner else f.owner end as owner,
        case when r.episode = 0 then o.verdict else 'UNREVIEWED' end as verdict,
        cast(case when r.episode = 0 then o.version else 0 end as integer) as version,
        case when a.at is not null then case when r.episode = 0 then o.workflow_status else 'NEW' end end as workflow_at_close,
        coalesce(f.name, o.check_name) as check_name, coalesce(f.sid, o.source_id) as source_id, coalesce(f.sname, o.source_name) as source_name,
        coalesce(f.sev, o.severity) as severity, case when r.episode = 0 then o.test_status else 'NEW' end as test_status,
        case when r.episode = 0 then o.call_to_action else f.action end as call_to_action, case when r.episode = 0 then o.ticket_url end as ticket_url,
        case when r.episode = 0 then o.notes end as notes, case when r.episode = 0 then o.annotated_at end as annotated_at,
        coalesce(f.gran, o.granularity) as granularity, x.crit as criticality, r.episode
    from {t}_r r left join {t}_a o on {same("o", "r")}),
{t}_n as (
    select check_id, identity, scheme, number, close_reason from {t}_occ
    union all select check_id, identity, scheme, number, close_reason from {history} h
        where not exists (select 1 from {t}_occ c where c.occurrence_id = h.occurrence_id)),
{t}_k as (
    select s.check_id, s.identity, s.invocation_id, s.captured_at as event_at, o.occurrence_id, coalesce(s.payload, s.was_payload) as payload,
        case when s.was_failing then s.was_payload end as previous_payload,
        case when starts then case when p.close_reason = 'Passed' then 'REAPPEARED' else 'APPEARED' end
            when not failing and was_failing then case when s.scheme is not distinct from s.run_scheme then 'DISAPPEARED' else 'CLOSED_STRUCTURAL' end
            when failing and s.payload <> s.was_payload then 'VALUES_CHANGED' end as event_type
    from {t}_ok s join {t}_occ o on {same("o", "s")} and o.episode = s.episode
        left join {t}_n p on {same("p", "s")} and p.number = o.number - 1),
{t}_ev as (select {event_id("check_id", "occurrence_id", "invocation_id", "event_type")} as event_id, * from {t}_k where event_type is not null)"""


_LEDGER = f"""{_NOTHING}, {replayed("r1", 1, 15, "none_occ")},
occ1 as (
    select * exclude (episode) replace (
        case when identity[1] <= '2' then 'RESOLVED' when identity[1] <= '4' then 'ACCEPTED_RISK' when identity[1] = '5' then 'BLOCKED' else 'NEW' end as workflow_status,
        case when identity[2] <= '4' then 'TRUE_POSITIVE' when identity[2] <= '6' then 'FALSE_POSITIVE' else 'UNREVIEWED' end as verdict,
        cast(identity[1] <= '5' as integer) as version,
        case when record_status = 'Archived' then case when identity[1] <= '2' then 'RESOLVED' when identity[1] <= '4' then 'ACCEPTED_RISK' when identity[1] = '5' then 'BLOCKED' else 'NEW' end end as workflow_at_close)
    from r1_occ), {replayed("r2", 16, 28, "occ1")},
occ as (
    select * from occ1 where occurrence_id not in (select occurrence_id from r2_occ)
    union all by name select * exclude (episode) from r2_occ),
ev as (select * from r1_ev union all select * from r2_ev),
hist as (
    select c.*, p.occurrence_id as previous_occurrence_id, p.close_reason as previous_close_reason, p.workflow_at_close as previous_workflow_at_close,
        p.occurrence_id is not null as has_previous, coalesce(p.close_reason = 'Passed', false) as is_recurrence,
        coalesce(p.close_reason = 'Passed' and p.workflow_at_close = 'RESOLVED', false) as is_potential_regression
    from occ c left join occ p on p.check_id = c.check_id and p.identity = c.identity and p.scheme is not distinct from c.scheme and p.number = c.number - 1),
hw as (select check_id, max(captured_at) as captured_at, max(invocation_id) as invocation_id from execs where {USABLE} and n <= 28 group by check_id),
skips as (
    select {event_id("check_id", "null::varchar", "invocation_id", "'EVIDENCE_SKIPPED'")} as event_id, check_id, invocation_id, {NOW} as event_at
    from execs where n between 10 and 12 and {USABLE})"""


def base(query: str) -> str:
    return f"with {BASE}\n{query}"


def ledger(query: str) -> str:
    return f"with {BASE}, {_LEDGER}\n{query}"
