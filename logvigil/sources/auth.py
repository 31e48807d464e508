"""Linux authentication logs: ssh, sudo and PAM events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from logvigil.functions.lines import LineParser, bsd_clock, extract, found, groups, optional, parse

# Fixed value: time, host, process, pid, message.
LINE = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"

# Fixed values: (pattern, event type, success, user group, ip group, port group, extras) in order.
# Group 0 stands for "has none".
SSH_EVENTS = [
    (r"Accepted password for (\S+) from ([\d.]+) port (\d+)", "ssh_success", "true", 1, 2, 3, "'auth_method', 'password'"),
    (r"Accepted publickey for (\S+) from ([\d.]+) port (\d+)", "ssh_success", "true", 1, 2, 3, "'auth_method', 'publickey'"),
    (r"Failed password for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)", "ssh_failure", "false", 1, 2, 3, ""),
    (r"Invalid user (\S+) from ([\d.]+)", "ssh_invalid_user", "false", 1, 2, 0, ""),
    (r"Connection closed by (?:authenticating user (\S+) )?([\d.]+) port (\d+)", "other", "NULL", 1, 2, 3, ""),
    (r"Disconnected from (?:authenticating user (\S+) )?([\d.]+) port (\d+)", "other", "NULL", 1, 2, 3, ""),
    (r"Disconnecting.*: Too many authentication failures", "ssh_failure", "false", 0, 0, 0, "'critical', 'true'"),
    (r"reverse mapping checking.*POSSIBLE BREAK-IN ATTEMPT", "ssh_failure", "false", 0, 0, 0, "'critical', 'true'"),
]
SUDO_COMMAND = r"(\S+)\s+:\s+TTY=(\S+)\s+;\s+PWD=(\S+)\s+;\s+USER=(\S+)\s+;\s+COMMAND=(.+)$"
SUDO_FAILURES = [r"(\S+)\s+:\s+.*authentication failure", r"(\S+)\s+:\s+\d+ incorrect password attempts?"]
PAM_OPENED = r"pam_unix\([^)]+\):\s+session opened for user (\S+)"
PAM_CLOSED = r"pam_unix\([^)]+\):\s+session closed for user (\S+)"
PAM_FAILURE = r"pam_unix\([^)]+\):\s+authentication failure.*user=(\S+)"


def matched(line: str) -> str:
    return groups(line, LINE, 5)


def _event(kind: str, success: str, user: str, ip: str = "NULL", port: str = "NULL", extras: str = "") -> str:
    more = f"map({extras})" if extras else "map()"
    return (
        f"named_struct('type', '{kind}', 'success', CAST({success} AS BOOLEAN), 'user', CAST({user} AS STRING), "
        f"'ip', CAST({ip} AS STRING), 'port', CAST({port} AS STRING), 'extras', CAST({more} AS MAP<STRING, STRING>))"
    )


def ssh_event(message: str) -> str:
    """The first ssh pattern that matches, null without one."""
    arms = []
    for pattern, kind, success, *places, extras in SSH_EVENTS:
        parts = [extract(message, pattern, place) if place else "NULL" for place in places]
        arms.append(f"WHEN {found(message, pattern)} THEN {_event(kind, success, *parts, extras=extras)}")
    return f"CASE {' '.join(arms)} END"


def sudo_event(message: str) -> str:
    command = _event(
        "sudo_success", "true", extract(message, SUDO_COMMAND, 1),
        extras=f"'target_user', {extract(message, SUDO_COMMAND, 4)}, 'command', {extract(message, SUDO_COMMAND, 5)}",
    )
    failures = " ".join(
        f"WHEN {found(message, p)} THEN {_event('sudo_failure', 'false', extract(message, p))}" for p in SUDO_FAILURES
    )
    return f"CASE WHEN {found(message, SUDO_COMMAND)} THEN {command} {failures} END"


def pam_event(message: str) -> str:
    return (
        f"CASE WHEN {found(message, PAM_OPENED)} THEN {_event('session_open', 'true', extract(message, PAM_OPENED))} "
        f"WHEN {found(message, PAM_CLOSED)} THEN {_event('session_close', 'NULL', extract(message, PAM_CLOSED))} "
        f"WHEN {found(message, PAM_FAILURE)} THEN {_event('pam_auth', 'false', extract(message, PAM_FAILURE))} END"
    )


def parser(line: str = "line", year: int | None = None) -> LineParser:
    """Authentication lines.

    ssh and sudo events are told by the process. PAM texts count for every process and
    override user and type; only a closed session keeps an earlier outcome.
    """
    year = year if year is not None else datetime.now().year
    steps = (
        {"au": matched(line)},
        {"au_message": "au[5]", "au_process": "au[3]"},
        {
            "au_ev": f"CASE WHEN contains(lower(au_process), 'sshd') THEN {ssh_event('au_message')} "
            f"WHEN contains(lower(au_process), 'sudo') THEN {sudo_event('au_message')} END",
            "au_pam": pam_event("au_message"),
        },
        {
            "au_type": "coalesce(au_pam.type, au_ev.type, 'other')",
            "au_success": "if(au_pam.type IN ('session_open', 'pam_auth'), au_pam.success, au_ev.success)",
        },
    )
    return LineParser(
        "auth",
        steps,
        "au IS NOT NULL",
        {
            "source_ip": "au_ev.ip",
            "user": "if(au_pam IS NOT NULL, au_pam.user, au_ev.user)",
            "action": "au_type",
            "status_code": "CAST(au_success AS INT)",
            "message": "au_message",
            "log_type": "'auth'",
            "hostname": "au[2]",
            "process": "au_process",
            "metadata": f"map_concat(map('pid', {optional('au[4]')}, 'event_type', au_type, 'success', CAST(au_success AS STRING), "
            "'port', au_ev.port), coalesce(au_ev.extras, CAST(map() AS MAP<STRING, STRING>)))",
        },
        bsd_clock('au[1]', year),
        "NULL",
    )


def parse_auth(lines: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """Entries of authentication lines."""
    return parse(lines, parser(year=year), now)
