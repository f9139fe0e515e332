"""Row types and the fixed dimension values shared by all operators."""

from pyspark.sql import types as T

MICROS = 1_000_000
MINUTE_US = 60 * MICROS
DAY_S = 86_400

RAW_ALERT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("full_log", T.StringType()),
    T.StructField("agent", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ip", T.StringType()),
    ])),
    T.StructField("rule", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("level", T.StringType()),  # a number in any spelling
        T.StructField("description", T.StringType()),
        T.StructField("firedtimes", T.StringType()),
        T.StructField("groups", T.ArrayType(T.StringType())),
        T.StructField("mitre", T.StructType([
            T.StructField("tactic", T.ArrayType(T.StringType())),
            T.StructField("technique", T.ArrayType(T.StringType())),
            T.StructField("id", T.ArrayType(T.StringType())),
        ])),
    ])),
    T.StructField("data", T.StructType([
        T.StructField("srcip", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("audit", T.StructType([T.StructField("command", T.StringType())])),
    ])),
    T.StructField("syscheck", T.StructType([
        T.StructField("event", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("mode", T.StringType()),
    ])),
    T.StructField("decoder", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("manager", T.StructType([T.StructField("name", T.StringType())])),
])

# --------------------------------------------------------------------------------------------------
# These must equal the values the alert source and its analysts use for results to match.
# --------------------------------------------------------------------------------------------------

# Column order of the two ingest layers.
MINIMAL_COLUMNS = [
    "wazuh_alert_id", "timestamp_utc", "agent_id", "agent_name", "rule_group_primary", "rule_level", "rule_id",
    "srcip", "srcip_type", "criticality_score", "has_mitre", "has_critical_mitre",
]
FULL_COLUMNS = MINIMAL_COLUMNS + [
    "agent_criticality", "mitre_tactic", "mitre_technique", "mitre_id", "syscheck_event", "syscheck_path",
    "syscheck_mode", "rule_description", "rule_groups_all", "rule_firedtimes", "agent_ip", "decoder_name",
    "location", "data_url", "audit_command", "manager_name", "full_log",
]

# Stored column name -> canonical name; the second map holds columns that may be absent.
REQUIRED_COLUMNS = {
    "timestamp_utc": "timestamp",
    "agent_id": "agent_id",
    "agent_name": "agent_name",
    "rule_group_primary": "rule_groups",
    "rule_level": "rule_level",
    "srcip": "srcip",
    "rule_id": "rule_id",
    "criticality_score": "criticality_score",
    "has_mitre": "has_mitre",
    "has_critical_mitre": "has_critical_mitre",
}
OPTIONAL_COLUMNS = {
    "srcip_type": "srcip_type",
    "agent_criticality": "agent_criticality_label",
    "rule_firedtimes": "rule_firedtimes",
    "mitre_tactic": "mitre_tactic",
    "mitre_id": "mitre_id",
    "wazuh_alert_id": "wazuh_alert_id",
    "is_synthetic": "is_synthetic",
    "scenario_id": "scenario_id",
}

FEATURES = [
    "alert_count_log", "max_severity", "duration_sec", "rule_group_severity_enc", "agent_criticality", "hour_of_day",
    "alert_velocity", "mitre_hit_count", "rule_concentration", "severity_spread", "deviation_from_baseline",
]

# Known agents, their ids and the criticality label of each.
AGENT_IDS = {
    "soc-1": "001", "pusatkarir": "002", "dfir-iris": "003", "siput": "004",
    "proxy-manager": "005", "e-kuesioner": "006", "sads": "007", "DVWA": "008",
}
AGENT_LABELS = {
    "soc-1": "low", "pusatkarir": "high", "dfir-iris": "critical", "siput": "medium",
    "proxy-manager": "high", "e-kuesioner": "medium", "sads": "high", "DVWA": "low",
}
LABEL_SCORES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 1}

# Weight used to pick the primary element of an alert's rule groups (absent: 0).
GROUP_PICK_WEIGHT = {
    "attack": 10, "sql_injection": 10, "authentication_failed": 9, "access_control": 8, "pam": 7, "web": 7,
    "virus": 7, "nginx": 6, "audit": 6, "clamd": 6, "accesslog": 5, "system_error": 5, "audit_selinux": 5,
    "syscheck": 5, "syscheck_file": 5, "syscheck_entry_modified": 5, "syscheck_entry_added": 4,
    "authentication_success": 3, "freshclam": 3, "syslog": 3, "rootcheck": 2, "ossec": 1,
}

# Ordinal severity code of a rule group (absent: 2).
GROUP_SEVERITY_CODE = {
    "ossec": 1, "syslog": 1, "authentication_success": 1, "stats": 1, "accesslog": 1, "wazuh": 1, "local": 1,
    "dpkg": 2, "config_changed": 2, "virus": 2, "sudo": 2, "pam": 2, "sca": 2, "sca_check": 2, "linux": 2,
    "rootcheck": 3, "syscheck_file": 3, "syscheck_entry_deleted": 3, "syscheck_entry_added": 3, "system_error": 3,
    "docker-error": 3, "docker": 3, "syscheck": 3, "windows": 3, "virustotal": 3,
    "web": 4, "apache": 4, "nginx": 4, "authentication_failed": 4, "audit": 4, "auditd": 4,
    "attack": 5, "access_control": 5,
    "sql_injection": 6, "vulnerability-detector": 6, "webshell": 6, "judol_file": 6,
}
DEFAULT_GROUP_CODE = 2

CRITICAL_TACTICS = [
    "Execution", "Lateral Movement", "Credential Access", "Exfiltration", "Privilege Escalation", "Defense Evasion",
]
INTERNAL_PREFIXES = ["10.", "172.16.", "172.17.", "192.168.", "127."]
HASH_TOKENS = ["md5", "sha1", "sha256", "mtime", "inode"]

# Groups whose alerts are single events by nature, so that a low reduction rate is expected.
EXPECTED_LOW_REDUCTION = ["virus", "local", "access_control", "stats", "dpkg", "config_changed", "sudo", "pam"]

ATTACKER_IPS = ["185.220.101.45", "45.142.212.100", "194.165.16.11"]
SWEEP_MINUTES = [1, 5, 10, 15, 20, 30, 45, 60]
NOISE_RATES = [0.0, 0.05, 0.10, 0.20, 0.30]
HIGH_SEVERITY = 7
REFERENCE_ZONE = "Asia/Makassar"

# Upper level of each severity bucket and zone, and the label above the last.
SEVERITY_BUCKETS, SEVERITY_ABOVE = {2: "1-2_Info", 4: "3-4_Medium", 6: "5-6_High"}, "7+_Critical"
SEVERITY_ZONES, ZONE_ABOVE = {4: "Low", 6: "Medium", 11: "High"}, "Critical"

# Wording of outgoing messages.
PAYLOAD_REASON = "score=%.4f sev=%d mitre=%d entropy=0.000 dev=%.3f"
MESSAGE_TAGS = ("[ESCALATE]", "[DIGEST]")
MESSAGE_LINES = (
    "%s %s | %s | %s",
    "Severity: %d/%d  |  %d alerts dalam %d menit",
    "Mulai: %s %s  |  Selesai: %s %s",
    "Score anomali: %.2f",
)
