"""Fixed column lists and names of the data model."""

from __future__ import annotations

# The 82 columns of a flow record, in file order.
FLOW_COLUMNS = """
src_ip dst_ip src_port dst_port protocol timestamp flow_duration flow_byts_s flow_pkts_s
fwd_pkts_s bwd_pkts_s tot_fwd_pkts tot_bwd_pkts totlen_fwd_pkts totlen_bwd_pkts
fwd_pkt_len_max fwd_pkt_len_min fwd_pkt_len_mean fwd_pkt_len_std
bwd_pkt_len_max bwd_pkt_len_min bwd_pkt_len_mean bwd_pkt_len_std
pkt_len_max pkt_len_min pkt_len_mean pkt_len_std pkt_len_var
fwd_header_len bwd_header_len fwd_seg_size_min fwd_act_data_pkts
flow_iat_mean flow_iat_max flow_iat_min flow_iat_std
fwd_iat_tot fwd_iat_max fwd_iat_min fwd_iat_mean fwd_iat_std
bwd_iat_tot bwd_iat_max bwd_iat_min bwd_iat_mean bwd_iat_std
fwd_psh_flags bwd_psh_flags fwd_urg_flags bwd_urg_flags
fin_flag_cnt syn_flag_cnt rst_flag_cnt psh_flag_cnt ack_flag_cnt urg_flag_cnt ece_flag_cnt
down_up_ratio pkt_size_avg init_fwd_win_byts init_bwd_win_byts
active_max active_min active_mean active_std idle_max idle_min idle_mean idle_std
fwd_byts_b_avg fwd_pkts_b_avg bwd_byts_b_avg bwd_pkts_b_avg fwd_blk_rate_avg bwd_blk_rate_avg
fwd_seg_size_avg bwd_seg_size_avg cwr_flag_count
subflow_fwd_pkts subflow_bwd_pkts subflow_fwd_byts subflow_bwd_byts
""".split()

# Columns that are text or time; every other one is a number.
FLOW_TEXT_COLUMNS = ("src_ip", "dst_ip", "timestamp")

# Tactic class numbers and their names.
TACTIC_NAMES = {
    0: "Benign",
    1: "Credential Access (TA0006)",
    2: "DoS Impact (TA0040)",
    3: "DDoS Impact (TA0040)",
    4: "Web Exploit (TA0001)",
    5: "Lateral Movement (TA0008)",
    6: "C2 / Botnet (TA0011)",
}

# Verdict texts of a detection summary.
VERDICT_ATTACK = "ATTACK DETECTED - malicious traffic flagged in this capture."
VERDICT_CLEAR = "No attack detected in this capture."

# Sensor logs read by default.
DEFAULT_LOGS = ("conn.log", "dns.log", "http.log", "ssl.log", "notice.log")

# Defaults of the settings.
EVENT_RETENTION_MINUTES = 10
EVENT_ROTATION_MINUTES = 15
FLOW_ROTATION_MINUTES = 1
BUFFER_RETENTION_SECONDS = 300
BUFFER_KEY = "cic:flows"

# Columns of the normalised events, as (output name, log field, kind); the kinds are
# the cleaning rules of operators.normalize.
EVENT_HEAD = [
    ("timestamp", "ts", "time"),
    ("event_type", None, "type"),
    ("src_ip", "id.orig_h", "text"),
    ("src_port", "id.orig_p", "port"),
    ("dst_ip", "id.resp_h", "text"),
    ("dst_port", "id.resp_p", "port"),
]
EVENT_BODY = {
    "conn": [
        ("protocol", "proto", "text"),
        ("duration", "duration", "real"),
        ("orig_bytes", "orig_bytes", "long"),
        ("resp_bytes", "resp_bytes", "long"),
        ("orig_pkts", "orig_pkts", "long"),
        ("resp_pkts", "resp_pkts", "long"),
        ("conn_state", "conn_state", "text"),
    ],
    "dns": [
        ("protocol", "proto", "text"),
        ("query", "query", "text"),
        ("qclass_name", "qclass_name", "text"),
        ("qtype_name", "qtype_name", "text"),
        ("rcode_name", "rcode_name", "text"),
        ("answers", "answers", "text"),
    ],
    "http": [
        ("method", "method", "text"),
        ("host", "host", "text"),
        ("uri", "uri", "text"),
        ("status_code", "status_code", "port"),
        ("user_agent", "user_agent", "text"),
    ],
}
EVENT_TYPE_NAMES = {"conn": "connection"}
