"""Password guessing, credential stuffing and distributed login attacks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.operators.runs import in_runs, long_keys, with_carries
from logvigil.operators.skew import attach
from logvigil.schema import EVIDENCE_COLUMNS, EVIDENCE_STRUCT, ROW_ORDER, shape_alerts
from logvigil.session import stage

DETECTOR, DETECTOR_ORD = "brute_force", 0

PAIR = ["source_ip", "account"]
GROUPS = {
    "brute_force": ["source_ip", "account"],
    "credential_stuffing": ["source_ip"],
    "distributed_brute_force": ["account"],
}
KINDS = tuple(GROUPS)
EVENT_COLUMNS = [*[c for c in EVIDENCE_COLUMNS if c != "entry_hash"], "tz_offset"]


@dataclass(frozen=True)
class AuthConfig:
    failed_attempts: int = 5
    window_minutes: int = 10
    stuffing_users: int = 3
    distributed_ips: int = 10
    evidence: int = 10
    samples: int = 20

    @property
    def window_micros(self) -> int:
        return self.window_minutes * 60_000_000


# SQL text: a failed login, in whatever log it is reported.
FAILED_AUTH = """(rlike(message, '(?i)failed|failure|invalid|denied')
  OR coalesce(action IN ('ssh_failure', 'ssh_invalid_user', 'sudo_failure', 'logon_failure'), false)
  OR coalesce(status_code = 0 AND log_type = 'auth', false)
  OR coalesce(event_id = 4625, false))"""

# SQL text: a successful login, provided it is not a failed one.
SUCCESSFUL_AUTH = """(rlike(message, '(?i)accepted|succeeded')
  OR coalesce(action IN ('ssh_success', 'sudo_success', 'logon_success'), false)
  OR coalesce(status_code = 1 AND log_type = 'auth', false)
  OR coalesce(event_id = 4624, false))"""


def login_outcomes(entries: DataFrame) -> DataFrame:
    """Rows that tell a login result, with the account the attempt counts for.

    The generator gives such a row its outcome and drops all others, testing each row once.
    """
    return entries.where("source_ip <> ''").selectExpr(
        *[f"`{c}`" for c in EVENT_COLUMNS],
        "coalesce(`user` <> '', false) AS named",
        "coalesce(nullif(`user`, ''), 'unknown') AS account",
        f"inline(CASE WHEN {FAILED_AUTH} THEN array(named_struct('is_failure', true, 'is_success', false)) "
        f"WHEN {SUCCESSFUL_AUTH} THEN array(named_struct('is_failure', false, 'is_success', true)) END)",
    )


def pair_totals(outcomes: DataFrame) -> DataFrame:
    """Per (source_ip, account): all failures, the last one, and the last successful login."""
    return (
        outcomes.groupBy(*PAIR)
        .agg(
            F.expr("count(CASE WHEN is_failure THEN 1 END) AS failures"),
            F.expr("max(CASE WHEN is_failure THEN ts END) AS last_failure"),
            F.expr("max(CASE WHEN is_success AND named THEN ts END) AS last_success"),
            F.expr("bool_or(is_failure AND named) AS named_account"),
        )
        .where("failures > 0")
    )


def pair_windows(outcomes: DataFrame, config: AuthConfig = AuthConfig()) -> DataFrame:
    """Per (source_ip, account): the failures in the window that ends with the last failure."""
    failures = outcomes.where("is_failure").select(*PAIR, "ts", "ts_local", "tz_offset", "file_path", "line_seq")
    looked_up = attach(failures, pair_totals(outcomes), PAIR, "failures", ROW_ORDER)
    return (
        looked_up.where(_in_window("last_failure", config))
        .groupBy(*PAIR)
        .agg(
            F.expr("count(*) AS attempt_count"),
            F.expr("min(ts) AS first_ts"),
            F.expr("max(struct(ts, ts_local, tz_offset)) AS last"),
            F.expr("bool_or(named_account) AS named_account"),
            F.expr("max(last_success) AS last_success"),
        )
    )


def _in_window(end: str, config: AuthConfig) -> str:
    return f"unix_micros(ts) >= unix_micros({end}) - {config.window_micros}"


def _newest(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ROW_ORDER])


def _recent_failures(outcomes: DataFrame, config: AuthConfig) -> DataFrame:
    """The newest failures per pair, as far as they lie in the pair's window.

    ``row_number <= n`` is cut down on the map side already, so a hot pair ships n rows
    per task and not its history.
    """
    return (
        outcomes.where("is_failure")
        .select("account", *EVENT_COLUMNS)
        .withColumn("_n", F.row_number().over(_newest(PAIR)))
        .where(F.col("_n") <= config.evidence)
        .withColumn("_last", F.max("ts").over(Window.partitionBy(*PAIR)))
        .where(_in_window("_last", config))
        .drop("_n", "_last")
    )


def _evidence(recent: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The last ``limit`` failures per key, oldest first; other pair columns are null."""
    newest_first = (
        recent.select(*[F.col(k).alias(f"_{k}") for k in keys], *ROW_ORDER, F.expr(EVIDENCE_STRUCT).alias("_row"))
        .withColumn("_n", F.row_number().over(_newest([f"_{k}" for k in keys])))
        .where(F.col("_n") <= limit)
    )
    return newest_first.groupBy(*[f"_{k}" for k in keys]).agg(
        F.sort_array(F.collect_list(F.struct(*ROW_ORDER, "_row")))["_row"].alias("evidence")
    ).select(
        *[(F.col(f"_{k}") if k in keys else F.lit(None).cast("string")).alias(f"_{k}") for k in PAIR],
        "evidence",
    )


def _evidence_for(kinds: tuple[str, ...], outcomes: DataFrame, config: AuthConfig) -> DataFrame:
    recent = _recent_failures(outcomes, config)
    named = pair_totals(outcomes).where("named_account").select(*PAIR)
    of_named = recent.join(named, PAIR, "left_semi")
    parts = [
        _evidence(recent if kind == "brute_force" else of_named, GROUPS[kind], config.evidence) for kind in kinds
    ]
    return reduce(DataFrame.unionByName, parts)


def _samples(outcomes: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """The first ``limit`` members per key in sorted order."""
    order = Window.partitionBy(key).orderBy(member)
    return (
        pair_totals(outcomes)
        .where("named_account")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= limit)
        .groupBy(F.col(key).alias(f"_{key}"))
        .agg(F.sort_array(F.collect_list(member)).alias(f"sample_{member}"))
    )


def grouped_attempts(outcomes: DataFrame, config: AuthConfig, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One pass over the pair windows for all requested groupings, cut to those over threshold.

    A row with both keys is a guessing attack, one without account is stuffing from one ip,
    one without source_ip is an attack on one account from many.
    """
    grouped = pair_windows(outcomes, config).groupingSets([GROUPS[kind] for kind in kinds], *PAIR)
    return (
        grouped.agg(
            F.expr("sum(attempt_count) AS all_attempts"),
            F.expr("min(first_ts) AS first_ts"),
            F.expr("max(last) AS last_all"),
            F.expr("max(last_success) AS last_success"),
            F.expr("count_if(named_account) AS members"),
            F.expr("sum(CASE WHEN named_account THEN attempt_count END) AS named_attempts"),
            F.expr("max(CASE WHEN named_account THEN last END) AS last_named"),
        )
        .selectExpr(
            "*",
            "CASE WHEN account IS NULL THEN 'credential_stuffing' "
            "WHEN source_ip IS NULL THEN 'distributed_brute_force' ELSE 'brute_force' END AS threat_type",
        )
        .selectExpr(
            "threat_type", *PAIR, "members", "first_ts", "last_success",
            "CASE WHEN threat_type = 'brute_force' THEN all_attempts ELSE named_attempts END AS attempts",
            "CASE WHEN threat_type = 'brute_force' THEN last_all ELSE last_named END AS last",
        )
        .where(
            f"CASE threat_type WHEN 'brute_force' THEN attempts >= {config.failed_attempts} "
            f"WHEN 'credential_stuffing' THEN members >= {config.stuffing_users} "
            f"ELSE members >= {config.distributed_ips} END"
        )
        .selectExpr(
            "threat_type", *PAIR, "attempts", "members", "first_ts", "last_success", "last.ts", "last.ts_local",
            "last.tz_offset",
        )
    )


def with_time_span(alerts: DataFrame) -> DataFrame:
    """Minutes between first and last attempt (at least one) and the attempts per minute."""
    return alerts.selectExpr(
        "*", "greatest(1.0D, (unix_micros(ts) - unix_micros(first_ts)) / 60000000.0D) AS span_minutes"
    ).selectExpr("*", "attempts / span_minutes AS attempts_per_minute")


# Descriptions, advice and technique per kind of attack. As SQL over the grouped row.
_WORDING = {
    "brute_force": {
        "level": "CASE WHEN last_success IS NOT NULL THEN 5 WHEN attempts >= 50 THEN 4 WHEN attempts >= 20 THEN 3 ELSE 2 END",
        "source": "source_ip",
        "target": "account",
        "description": "concat('Brute force attack detected: ', attempts, ' failed login attempts from ', source_ip, "
        "' targeting user \\'', account, '\\'', "
        "CASE WHEN last_success IS NOT NULL THEN ' - SUCCESSFUL LOGIN DETECTED AFTER ATTACK' ELSE '' END)",
        "mitre": "array('T1110.001')",
        "advice": "concat(CASE WHEN last_success IS NOT NULL THEN array("
        "concat('URGENT: Force password reset for user \\'', account, '\\''), "
        "'Check for unauthorized activities from this account') ELSE array() END, "
        "array(concat('Block IP address ', source_ip, ' at the firewall'), "
        "concat('Review account \\'', account, '\\' for unauthorized access'), "
        "'Implement rate limiting on authentication endpoints', "
        "'Consider implementing multi-factor authentication'))",
        "facts": "named_struct('attempt_count', attempts, 'compromised', last_success IS NOT NULL, "
        "'success_after', last_success > ts, 'time_span_minutes', span_minutes, "
        "'attempts_per_minute', attempts_per_minute)",
    },
    "credential_stuffing": {
        "level": "4",
        "source": "source_ip",
        "target": "concat(members, ' accounts')",
        "description": "concat('Credential stuffing attack detected: ', source_ip, ' attempted to authenticate to ', "
        "members, ' different accounts')",
        "mitre": "array('T1110.004')",
        "advice": "array(concat('Block IP address ', source_ip, ' immediately'), "
        "'Review all targeted accounts for compromise', 'Implement CAPTCHA on login pages', "
        "'Check if credentials appear in known breach databases')",
        "facts": "named_struct('targeted_users', sample_account, 'total_users_targeted', members, "
        "'total_attempts', attempts)",
    },
    "distributed_brute_force": {
        "level": "4",
        "source": "concat(members, ' IPs')",
        "target": "account",
        "description": "concat('Distributed brute force attack detected: ', members, "
        "' different IPs targeting user \\'', account, '\\'')",
        "mitre": "array('T1110.003')",
        "advice": "array(concat('Force password reset for user \\'', account, '\\''), "
        "'Enable multi-factor authentication for this account', 'Review source IPs for botnet indicators', "
        "'Consider geo-blocking if IPs are from unusual locations')",
        "facts": "named_struct('source_ips', sample_source_ip, 'total_ips', members, 'total_attempts', attempts)",
    },
}


def _by_kind(part: str, wrap: str = "{}") -> str:
    arms = " ".join(f"WHEN '{kind}' THEN {wrap.format(texts[part])}" for kind, texts in _WORDING.items())
    return f"CASE threat_type {arms} END"


def _texts(alerts: DataFrame) -> DataFrame:
    return alerts.selectExpr(
        "ts", "ts_local", "tz_offset", "threat_type", "evidence",
        f"{_by_kind('level')} AS level_value",
        f"{_by_kind('source')} AS source_ip",
        f"{_by_kind('target')} AS target",
        f"{_by_kind('description')} AS description",
        f"{_by_kind('mitre')} AS mitre_attack",
        f"{_by_kind('advice')} AS recommendations",
        f"{_by_kind('facts', 'to_json({})')} AS metadata",
    )


def auth_alerts(
    entries: DataFrame,
    config: AuthConfig = AuthConfig(),
    kinds: tuple[str, ...] = KINDS,
    staged: bool = True,
) -> DataFrame:
    """Alerts on login attacks of the given kinds.

    The login outcomes are a small part of the logs; they are written out once so that the
    groupings, the evidence and the samples do not scan the logs again.
    """
    outcomes = login_outcomes(entries)
    if staged:
        outcomes = stage(outcomes, "login-outcomes")
    alerts = with_time_span(grouped_attempts(outcomes, config, kinds))
    found = _evidence_for(kinds, outcomes, config)
    alerts = alerts.join(
        found,
        F.col("source_ip").eqNullSafe(F.col("_source_ip")) & F.col("account").eqNullSafe(F.col("_account")),
        "left",
    ).drop("_source_ip", "_account")
    for kind, key, member in (
        ("credential_stuffing", "source_ip", "account"),
        ("distributed_brute_force", "account", "source_ip"),
    ):
        if kind in kinds:
            samples = _samples(outcomes, key, member, config.samples)
            alerts = alerts.join(
                samples, (F.col("threat_type") == kind) & (F.col(key) == F.col(f"_{key}")), "left"
            ).drop(f"_{key}")
        else:
            alerts = alerts.withColumn(f"sample_{member}", F.lit(None).cast("array<string>"))
    return shape_alerts(_texts(alerts), detector=DETECTOR, detector_ord=DETECTOR_ORD)


def failures_of(entries: DataFrame) -> DataFrame:
    return login_outcomes(entries).where("is_failure").drop("is_failure", "is_success")


def trailing_failures(entries: DataFrame, config: AuthConfig = AuthConfig()) -> DataFrame:
    """Every failed login with the number of failures of its pair in the window ending there, and the first time among them.

    A pair with a long history becomes a stream of events: a failure comes in, and leaves again when the window has passed. The number
    in the window is the sum of both so far, and the first failure in it is the one that leaves next. Both carry over from run to run, so a pair
    is spread over tasks even if all its failures lie in one window.
    """
    width = config.window_micros
    failures = failures_of(entries).selectExpr("*", "unix_micros(ts) AS _us")
    found = [c for c in failures.columns if c != "_us"]
    long = long_keys(failures, PAIR)
    short = failures if long is None else failures.join(F.broadcast(long), PAIR, "left_anti")
    pair = "OVER (PARTITION BY source_ip, account ORDER BY _us"
    counted = short.selectExpr(
        *[f"`{c}`" for c in found],
        f"row_number() {pair}, file_path, line_seq) "
        f"- count(*) {pair} RANGE BETWEEN UNBOUNDED PRECEDING AND {width + 1} PRECEDING) AS trailing_count",
        f"timestamp_micros(min(_us) {pair} RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)) AS first_ts",
    )
    if long is None:
        return counted
    comes = failures.join(F.broadcast(long), PAIR, "left_semi").selectExpr("*", "_us AS _at", "1 AS _change", "CAST(NULL AS BIGINT) AS _left")
    leaves = comes.selectExpr(*PAIR, "file_path", "line_seq", f"_us + {width + 1} AS _at", "-1 AS _change", "_us AS _left")
    order = ["_at", "_change", "file_path", "line_seq"]
    runs = in_runs(comes.unionByName(leaves, allowMissingColumns=True), PAIR, order, "failure-events")
    sums = runs.groupBy(*PAIR, "_run").agg(F.sum("_change").alias("_sum"), F.min("_left").alias("_next"))
    along = "OVER (PARTITION BY source_ip, account ORDER BY _run{} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carries = sums.selectExpr(
        *PAIR, "_run", f"coalesce(sum(_sum) {along.format('')}, 0) AS _inside", f"min(_next) {along.format(' DESC')} AS _later"
    )
    forth = "OVER (PARTITION BY source_ip, account, _run ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    forward, backward = forth.format(", ".join(order)), forth.format(", ".join(f"{c} DESC" for c in order))
    scanned = runs.selectExpr("*", f"sum(_change) {forward} AS _so_far", f"min(_left) {backward} AS _leaves_next").where("_change = 1")
    return counted.unionByName(
        with_carries(scanned, PAIR, carries).selectExpr(
            *[f"`{c}`" for c in found], "_inside + _so_far AS trailing_count", "timestamp_micros(coalesce(_leaves_next, _later)) AS first_ts"
        )
    )


def any_window(entries: DataFrame, config: AuthConfig = AuthConfig()) -> DataFrame:
    """Pairs over the threshold in any window, not only the one that ends with the last failure."""
    return (
        trailing_failures(entries, config)
        .groupBy(*PAIR)
        .agg(F.expr("max(trailing_count) AS most_attempts"))
        .where(f"most_attempts >= {config.failed_attempts}")
    )


def online_alerts(counted: DataFrame, config: AuthConfig = AuthConfig()) -> DataFrame:
    """Alerts of the one-record-at-a-time form: every failure from the threshold on.

    It knows nothing of later logins, so no account counts as compromised. The evidence is the
    failure that raised the alert.
    """
    facts = (
        "named_struct('attempt_count', attempts, 'compromised', false, 'time_span_minutes', span_minutes, "
        "'attempts_per_minute', attempts_per_minute)"
    )
    # The texts below.
    found = with_time_span(
        counted.where(f"trailing_count >= {config.failed_attempts}").withColumnRenamed("trailing_count", "attempts")
    )
    alerts = found.selectExpr(
        "ts", "ts_local", "tz_offset", "source_ip", "file_path", "line_seq",
        "'brute_force' AS threat_type",
        "CASE WHEN attempts >= 50 THEN 4 WHEN attempts >= 20 THEN 3 ELSE 2 END AS level_value",
        "if(named, account, NULL) AS target",
        "concat('Brute force attack detected: ', attempts, ' failed login attempts from ', source_ip, "
        "' targeting user \\'', account, '\\'') AS description",
        f"array({EVIDENCE_STRUCT}) AS evidence",
        "array('T1110.001') AS mitre_attack",
        "array(concat('Block IP address ', source_ip, ' at the firewall'), "
        "concat('Review account \\'', if(named, account, 'None'), '\\' for unauthorized access'), "
        "'Implement rate limiting on authentication endpoints', "
        "'Consider implementing multi-factor authentication') AS recommendations",
        f"to_json({facts}) AS metadata",
    )
    return shape_alerts(alerts, detector=DETECTOR, detector_ord=DETECTOR_ORD)


def online_brute_force(entries: DataFrame, config: AuthConfig = AuthConfig()) -> DataFrame:
    """What the one-record-at-a-time form reports when rows arrive in time order."""
    return online_alerts(trailing_failures(entries, config), config)
