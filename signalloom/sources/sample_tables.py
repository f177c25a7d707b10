"""Trace tables derived from the star-schema and event tables, one portable SQL text per table.

The same text runs in any ANSI engine; only ``EPOCH_US(x)``, ``ISO_TEXT(x)`` and ``//`` (integer
division) are spelled per engine. Frame
numbers are unique per capture, and both directions of a flow, retransmitted requests, lost
responses, sequence wraps and ties occur.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from signalloom.streaming.replay import stream_of

# Frames of the derived tables are spread wide, so that a chunk of them is wide as well.
SAMPLE_SPAN = 1 << 46

_FRAME = (
    "CAST(l_orderkey * 10 + l_linenumber AS BIGINT) * 1000000000"
    " + (l_partkey * 1000 + l_suppkey % 1000) * 50 + CAST(l_quantity AS BIGINT) - 1"
)

TABLES: dict[str, str] = {}

TABLES["packets"] = f"""
SELECT concat('cap', CAST(l_orderkey % 3 AS STRING)) AS capture_id,
       {_FRAME} AS frame_number,
       EPOCH_US(l_shipdate) + CAST(l_orderkey % 86400 AS BIGINT) * 1000000
         + CAST(l_linenumber AS BIGINT) * 20000 AS ts_us,
       CAST(40 + l_quantity * 20 AS INT) AS length,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('10.0.0.', CAST(l_suppkey % 20 AS STRING))
            ELSE concat('10.1.0.', CAST(l_partkey % 20 AS STRING)) END AS src_ip,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('10.1.0.', CAST(l_partkey % 20 AS STRING))
            ELSE concat('10.0.0.', CAST(l_suppkey % 20 AS STRING)) END AS dst_ip,
       CAST(CASE WHEN l_linenumber % 2 = 1 THEN 40000 + l_suppkey % 3
            ELSE CASE l_partkey % 12 WHEN 0 THEN 5060 WHEN 1 THEN 2123 WHEN 2 THEN 2152
              WHEN 3 THEN 8805 WHEN 4 THEN 3868 WHEN 5 THEN 38412 WHEN 6 THEN 53 WHEN 8 THEN 36412
              WHEN 9 THEN 1812 WHEN 10 THEN 20000 + l_partkey % 5 * 2 WHEN 11 THEN 2905 ELSE 443 END END AS INT)
         AS src_port,
       CAST(CASE WHEN l_linenumber % 2 = 1 THEN
            CASE l_partkey % 12 WHEN 0 THEN 5060 WHEN 1 THEN 2123 WHEN 2 THEN 2152
              WHEN 3 THEN 8805 WHEN 4 THEN 3868 WHEN 5 THEN 38412 WHEN 6 THEN 53 WHEN 8 THEN 36412
              WHEN 9 THEN 1812 WHEN 10 THEN 20000 + l_partkey % 5 * 2 WHEN 11 THEN 2905 ELSE 443 END
            ELSE 40000 + l_suppkey % 3 END AS INT) AS dst_port,
       CASE l_partkey % 12 WHEN 5 THEN 'SCTP' WHEN 4 THEN 'SCTP' WHEN 7 THEN 'TCP'
         WHEN 8 THEN 'SCTP' WHEN 11 THEN 'SCTP' ELSE 'UDP' END AS transport,
       CASE WHEN l_partkey % 12 = 7 THEN CASE l_linenumber WHEN 1 THEN 'S' WHEN 2 THEN 'SA'
         ELSE 'A' END END AS tcp_flags,
       CAST(CASE WHEN l_partkey % 12 IN (1, 2) THEN l_orderkey % 50 END AS BIGINT) AS gtp_teid,
       CAST(CASE WHEN l_partkey % 12 = 2 THEN 255 WHEN l_partkey % 12 = 1
         THEN CASE l_linenumber WHEN 1 THEN 32 WHEN 2 THEN 33 ELSE 1 END END AS INT) AS gtp_type,
       CAST(CASE WHEN l_partkey % 12 = 4 THEN 16777216 + l_orderkey % 4 END AS BIGINT)
         AS diameter_app_id,
       CAST(CASE WHEN l_partkey % 12 = 6 THEN l_linenumber % 2 END AS INT) AS dns_qr,
       CAST(CASE WHEN l_partkey % 12 = 0 AND l_returnflag = 'R' THEN 400 + l_linenumber * 80 END
         AS INT) AS sip_status,
       CASE WHEN l_partkey % 12 = 0 AND l_returnflag = 'R' THEN 'Busy' END AS sip_reason,
       CASE WHEN l_partkey % 12 = 0 AND l_linenumber = 1 THEN 'INVITE' END AS sip_method,
       CASE WHEN l_partkey % 12 = 3 THEN CAST(50 + l_linenumber AS STRING) END AS pfcp_type
FROM lineitem
"""

# Every third line of an order responds, the others ask or ask again; a response to another number leaves its requests
# unanswered.
TABLES["transactions"] = f"""
SELECT concat('cap', CAST(l_orderkey % 3 AS STRING)) AS capture_id,
       {_FRAME} AS frame_number,
       CAST(l_orderkey AS BIGINT) * 100000 + CAST(l_linenumber AS BIGINT) * 1000
         + CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity * 60000 AS BIGINT)
             * CASE WHEN l_orderkey > 4500 THEN 2 ELSE 1 END ELSE 0 END AS ts_us,
       CASE WHEN l_orderkey % 2 = 0 THEN 'PFCP' ELSE 'GTPv2-C' END AS protocol,
       CASE WHEN l_orderkey % 2 = 0 THEN concat('PFCP-Msg-', CAST(50 + l_orderkey % 3 * 2
              + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS STRING))
            ELSE concat('GTP-Msg-', CAST(32 + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END
              AS STRING)) END AS message_type,
       CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0
              THEN CASE WHEN l_returnflag = 'R' THEN '64'
                WHEN l_returnflag = 'A' AND l_orderkey > 4500 THEN '72' ELSE '1' END
              ELSE CASE WHEN l_returnflag = 'R' THEN '70' ELSE '16' END END END AS cause,
       CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0
              THEN CASE WHEN l_returnflag = 'R' THEN 'Remote Node Not Responsive'
                WHEN l_returnflag = 'A' AND l_orderkey > 4500 THEN 'System Failure'
                ELSE 'Request Accepted' END
              ELSE CASE WHEN l_returnflag = 'R' THEN 'System Failure'
                ELSE 'Request Accepted' END END END AS cause_label,
       CAST(l_orderkey % 64 + CASE WHEN l_linenumber % 3 = 0 AND l_linestatus <> 'O' THEN 64 ELSE 0 END AS STRING) AS seq,
       CAST(l_orderkey % 11 AS STRING) AS sess_id,
       CASE WHEN l_linenumber % 3 = 0 THEN '10.2.0.2' ELSE '10.2.0.1' END AS src,
       CASE WHEN l_linenumber % 3 = 0 THEN '10.2.0.1' ELSE '10.2.0.2' END AS dst,
       l_linenumber % 3 = 2 AND l_returnflag = 'A' AS retransmission
FROM lineitem
"""

# SDP bodies offer and answer audio (and, for some, video) on endpoints the packets also use.
_SDP = """concat('v=0', chr(13), chr(10), 'c=IN IP4 10.0.0.', CAST(l_suppkey % 20 AS STRING), chr(13), chr(10),
         'a=', CASE l_partkey % 5 WHEN 0 THEN 'sendonly' WHEN 1 THEN 'recvonly' WHEN 2 THEN 'inactive'
           ELSE 'sendrecv' END, chr(13), chr(10),
         'm=audio ', CAST(CASE WHEN l_suppkey % 2 = 0 THEN 40000 + l_suppkey % 3
           ELSE 20000 + l_partkey % 5 * 2 END AS STRING), ' RTP/AVP ',
         CASE WHEN l_linenumber = 1 THEN '96 97' ELSE CASE l_partkey % 4 WHEN 0 THEN '97' WHEN 1 THEN '0'
           WHEN 2 THEN '98 96' ELSE '96' END END, chr(13), chr(10),
         'a=rtpmap:96 AMR-WB/16000', chr(13), chr(10), 'a=rtpmap:97 AMR/8000', chr(10), 'a=rtpmap:0 PCMU/8000',
         CASE WHEN l_orderkey % 4 = 0 THEN concat(chr(10), 'a=curr:qos local ',
           CASE WHEN l_partkey % 3 = 0 THEN 'none' ELSE 'sendrecv' END, chr(10),
           'a=des:qos mandatory local sendrecv') ELSE '' END,
         CASE WHEN l_linenumber = 1 AND l_orderkey % 6 = 1 THEN concat(chr(10), 'm=video ',
           CAST(30000 + l_suppkey % 7 * 2 AS STRING), ' RTP/AVP 99') ELSE '' END)"""

TABLES["sip_messages"] = f"""
SELECT concat('cap', CAST(l_orderkey % 3 AS STRING)) AS capture_id,
       {_FRAME} AS frame_number,
       CAST(l_orderkey AS BIGINT) * 1000000
         + CAST(l_linenumber AS BIGINT) * CAST(l_quantity * 50000 + 1000 AS BIGINT) AS ts_us,
       concat('call-', CAST(l_orderkey AS STRING)) AS call_id,
       CASE l_linenumber WHEN 1 THEN CASE WHEN l_orderkey % 5 = 0 THEN 'REGISTER' ELSE 'INVITE' END
         WHEN 5 THEN CASE l_orderkey % 7 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'REFER' WHEN 2 THEN 'NOTIFY'
           WHEN 3 THEN 'INVITE' WHEN 4 THEN 'CANCEL' ELSE 'ACK' END
         WHEN 6 THEN 'BYE' WHEN 7 THEN CASE l_orderkey % 7 WHEN 1 THEN 'NOTIFY' ELSE 'Response' END
         ELSE 'Response' END AS msg_type,
       CAST(CASE l_linenumber WHEN 2 THEN 100 WHEN 3 THEN CASE WHEN l_returnflag = 'A' THEN 183 ELSE 180 END
         WHEN 4 THEN CASE WHEN l_returnflag = 'R' THEN CASE l_partkey % 4 WHEN 0 THEN 486 WHEN 1 THEN 503
           WHEN 2 THEN 401 ELSE 580 END ELSE 200 END
         WHEN 7 THEN CASE WHEN l_orderkey % 7 = 1 AND l_returnflag = 'N' THEN 486 ELSE 200 END END AS INT)
         AS status_code,
       CASE WHEN l_linenumber = 6 THEN CASE l_partkey % 6
         WHEN 1 THEN 'SIP;cause=503;text="Handover triggered"'
         WHEN 2 THEN 'SIP;cause=380;text="CS Fallback required"'
         WHEN 3 THEN 'Q.850;cause=16;text="RELEASE FROM CC"'
         WHEN 4 THEN 'X.int;reasoncode=0x0000070E;add-info=0132.0001.0B2E'
         WHEN 5 THEN 'SIP;cause=200;text="PS to CS"' END END AS reason,
       CASE WHEN l_linenumber = 4 THEN CASE l_suppkey % 3 WHEN 0 THEN '1800;refresher=uac'
         WHEN 1 THEN '2' END END AS session_expires,
       CASE WHEN l_linenumber = 4 AND l_suppkey % 3 = 0 THEN '90' END AS min_se,
       CASE WHEN l_linenumber = 5 AND l_orderkey % 7 = 1 THEN concat('sip:', CAST(l_partkey AS STRING)) END
         AS refer_to,
       CASE WHEN l_linenumber = 5 AND l_orderkey % 7 = 1 THEN concat('sip:', CAST(l_suppkey AS STRING)) END
         AS referred_by,
       CASE WHEN l_orderkey % 7 IN (1, 2) AND l_linenumber IN (5, 7) THEN 'Refer' END AS event,
       CASE WHEN l_linenumber = 3 AND l_partkey % 9 = 0 THEN 'Inactive' END AS p_early_media,
       CASE WHEN l_linenumber IN (1, 3, 4) AND l_partkey % 10 <> 7 THEN {_SDP} END AS sdp,
       concat('10.3.0.', CAST(l_suppkey % 9 AS STRING)) AS src,
       concat('10.4.0.', CAST(l_partkey % 9 AS STRING)) AS dst
FROM lineitem
"""

TABLES["rtp_packets"] = f"""
SELECT concat('cap', CAST(l_suppkey % 2 AS STRING)) AS capture_id,
       {_FRAME} AS frame_number,
       CAST(l_orderkey AS BIGINT) * 20000 + CAST(l_quantity * 300 AS BIGINT) AS ts_us,
       concat('call-', CAST(l_partkey % 40 AS STRING)) AS call_id,
       concat('0x', CAST(l_suppkey % 4 AS STRING)) AS ssrc,
       CAST((l_orderkey + 65000) % 65536 AS INT) AS seq,
       CAST(l_orderkey AS BIGINT) * 160 AS rtp_ts,
       concat('10.0.0.', CAST(l_suppkey % 20 AS STRING)) AS dst_ip,
       CAST(CASE WHEN l_suppkey % 2 = 0 THEN 40000 + l_suppkey % 3 ELSE 20000 + l_partkey % 5 * 2 END AS INT)
         AS dst_port
FROM lineitem
"""

# Media in the time of the calls above: a burst per message, on endpoints that calls offer again and again.
TABLES["media_packets"] = f"""
SELECT concat('cap', CAST(l_orderkey % 3 AS STRING)) AS capture_id,
       {_FRAME} * 32 + k AS frame_number,
       CAST(l_orderkey AS BIGINT) * 1000000
         + CAST(l_linenumber AS BIGINT) * CAST(l_quantity * 50000 + 1000 AS BIGINT)
         + CAST(k AS BIGINT) * CASE WHEN l_partkey % 4 = 0 THEN 500000 ELSE 20000 END AS ts_us,
       CAST(60 + l_quantity AS INT) AS length,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('10.8.0.', CAST(l_orderkey % 9 AS STRING))
         ELSE concat('10.0.0.', CAST(l_suppkey % 20 AS STRING)) END AS src_ip,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('10.0.0.', CAST(l_suppkey % 20 AS STRING))
         ELSE concat('10.8.0.', CAST(l_orderkey % 9 AS STRING)) END AS dst_ip,
       CAST(CASE WHEN l_linenumber % 2 = 1 THEN 50000 WHEN l_suppkey % 2 = 0 THEN 40000 + l_suppkey % 3
         ELSE 20000 + l_partkey % 5 * 2 END AS INT) AS src_port,
       CAST(CASE WHEN l_linenumber % 2 = 0 THEN 50000 WHEN l_suppkey % 2 = 0 THEN 40000 + l_suppkey % 3
         ELSE 20000 + l_partkey % 5 * 2 END AS INT) AS dst_port
FROM (SELECT *, EACH(CAST(l_quantity AS INT) // 2 + 1) AS k
FROM lineitem)
"""

TABLES["rtcp_reports"] = """
SELECT concat('cap', CAST(o_orderkey % 3 AS STRING)) AS capture_id,
       concat('call-', CAST(o_custkey % 200 AS STRING)) AS call_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL
         ELSE CAST(o_custkey % 400 AS STRING) END AS jitter,
       CAST(o_orderkey % 5 AS STRING) AS lost,
       CAST(o_orderkey % 256 AS STRING) AS fraction
FROM orders
"""

TABLES["ran_events"] = """
SELECT concat('cap', CAST(user_id % 3 AS STRING)) AS capture_id,
       event_id AS frame_number, EPOCH_US(ts) // 10000 AS ts_us,
       CASE WHEN event_id % 10 = 9 THEN 'Unknown' WHEN user_id % 2 = 0 THEN '4G' ELSE '5G' END AS generation,
       CASE WHEN event_id % 10 = 9 THEN 'SCTP' WHEN user_id % 2 = 0 THEN 'S1AP' ELSE 'NGAP' END AS protocol,
       CAST(CASE event_type WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 0 ELSE 12 END
         WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 23 ELSE 41 END
         WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 4 ELSE 16 END
         WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 14 ELSE 36 END END AS INT) AS procedure_code,
       CASE event_type WHEN 'signup' THEN 'HandoverPreparation' WHEN 'error' THEN 'UEContextRelease'
         WHEN 'purchase' THEN 'HandoverCancel' WHEN 'view' THEN 'Paging'
         ELSE 'UplinkNASTransport' END AS procedure_label,
       CASE WHEN event_type IN ('error', 'click') THEN CASE CAST(event_id % 6 AS INT)
         WHEN 0 THEN 'Radio link failure' WHEN 1 THEN 'user inactivity' WHEN 2 THEN 'Congestion'
         WHEN 3 THEN 'Handover triggered' WHEN 4 THEN 'unspecified' END END AS cause_label,
       CASE WHEN event_id % 10 <> 9 AND user_id % 2 = 0 AND event_id % 23 <> 0
         THEN CAST(user_id % 24 AS STRING) END AS mme_id,
       CASE WHEN event_id % 10 <> 9 AND user_id % 2 = 0 AND event_id % 4 <> 0
         THEN CAST(user_id % 24 AS STRING) END AS enb_id,
       CASE WHEN event_id % 10 <> 9 AND user_id % 2 = 1 AND event_id % 23 <> 0
         THEN CAST(user_id % 24 AS STRING) END AS amf_id,
       CASE WHEN event_id % 10 <> 9 AND user_id % 2 = 1 AND event_id % 4 <> 0
         THEN CAST(user_id % 24 AS STRING) END AS ran_id,
       CASE WHEN event_id % 10 = 9 AND event_id % 3 = 0 THEN CAST(user_id % 5 AS STRING) END AS sccp_calling,
       CASE WHEN event_id % 10 = 9 AND event_id % 3 = 0 THEN '8' END AS sccp_called,
       CASE WHEN event_id % 10 = 9 AND event_id % 3 = 1 THEN concat('0x', CAST(user_id % 7 AS STRING)) END
         AS sctp_assoc,
       CASE WHEN event_id % 50 = 9 THEN '6' WHEN event_id % 10 = 9 THEN '0' END AS chunk_type,
       event_id % 10 = 9 AND event_id % 4 = 1 AS retransmission,
       CASE WHEN event_id % 41 <> 0 THEN concat('10.5.0.', CAST(user_id % 4 AS STRING)) END AS src,
       concat('10.5.1.', CAST(user_id % 3 AS STRING)) AS dst
FROM events
"""

TABLES["hinted_calls"] = """
SELECT concat('cap', CAST(user_id % 3 AS STRING)) AS capture_id,
       concat('call-', CAST(event_id AS STRING)) AS call_id,
       EPOCH_US(ts) // 10000 - 1000000 AS start_us, EPOCH_US(ts) // 10000 AS end_us,
       CASE WHEN user_id % 2 = 0 THEN 'TERMINATED' ELSE 'FAILED' END AS state,
       CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'SIP;cause=503;text="Handover triggered"'
         WHEN 1 THEN 'SIP;cause=380;text="CS Fallback required"' WHEN 2 THEN 'SIP;cause=500;text="PS to CS"'
         WHEN 3 THEN 'SIP;cause=200;text="Bye"' END AS reason_header
FROM events
"""

TABLES["radio_rows"] = """
SELECT concat('trace', CAST(user_id % 3 AS STRING)) AS trace_id, event_id AS row_no,
       CASE CAST(event_id % 7 AS INT)
         WHEN 0 THEN concat(CAST(EPOCH_US(ts) // 1000000 AS STRING), '.',
           lpad(CAST(EPOCH_US(ts) % 1000000 AS STRING), 6, '0'))
         WHEN 1 THEN CAST(EPOCH_US(ts) // 1000 AS STRING)
         WHEN 2 THEN concat(replace(ISO_TEXT(ts), ' ', 'T'), 'Z')
         WHEN 3 THEN concat(ISO_TEXT(ts), '+02:00')
         WHEN 4 THEN ISO_TEXT(ts)
         WHEN 5 THEN concat(substring(ISO_TEXT(ts), 9, 2), '/', substring(ISO_TEXT(ts), 6, 2), '/',
           substring(ISO_TEXT(ts), 1, 4), ' ', substring(ISO_TEXT(ts), 12, 8))
         ELSE CASE WHEN event_id % 5 = 0 THEN 'no time' ELSE concat('at ', substring(ISO_TEXT(ts), 1, 19), ' UE') END
       END AS event_time,
       CASE event_type WHEN 'error' THEN CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Radio Link Failure'
           WHEN 1 THEN 'INTERNAL_PROC_ERAB_SETUP' WHEN 2 THEN 'DU_PER_UE_TRAFFIC_REP'
           ELSE 'X2_SGNB_ADDITION_REJECT' END
         WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Handover Failure' ELSE 'HO success' END
         WHEN 'purchase' THEN 'Paging'
         WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'RRC_RRC_CONNECTION_RECONFIGURATION'
           WHEN event_id % 3 = 1 THEN 'RRC_RRC_CONNECTION_RECONFIGURATION_COMPLETE'
           ELSE 'Measurement Report' END
         ELSE CASE WHEN event_id % 2 = 0 THEN 'RRC Re-establishment' ELSE 'INTERNAL_PROC_RRC_CONN_RECONF_NO_MOB' END
       END AS event_name,
       CASE WHEN event_id % 9 = 0 THEN 'CS fallback seen' WHEN event_id % 9 = 1 THEN 'success on NR' END AS detail,
       CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '4g' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'custom' END AS network_type,
       concat('cell-', CAST(user_id % 7 AS STRING)) AS cell_id,
       concat(CAST(CAST(floor(value) AS INT) - 140 AS STRING), '.5 dBm') AS rsrp,
       CASE WHEN event_id % 3 = 0 THEN concat(CAST(CAST(floor(value) AS INT) % 30 - 5 AS STRING), ' dB') END AS sinr,
       concat(CAST(CAST(floor(value * 20) AS INT) AS STRING), ' kbps') AS dl_throughput,
       CASE WHEN event_id % 4 = 0 THEN concat('42701', lpad(CAST(user_id AS STRING), 10, '0')) END AS imsi,
       CASE WHEN event_id % 6 = 0 THEN '1850' END AS earfcn,
       CASE WHEN event_id % 2 = 0 THEN 'UE' ELSE 'eNB' END AS from_node,
       CASE WHEN event_id % 5 < 3 THEN 'ue' ELSE 'eNB' END AS to_node,
       CASE WHEN event_id % 4 < 3 THEN '1' ELSE '0' END AS rrc_reconfig_result,
       CASE WHEN event_id % 40 = 7 THEN 'radio-link-failure-x' END AS release_cause,
       CASE WHEN event_id % 4 = 2 THEN concat('<nack_64_qam>', CAST(event_id % 25 AS STRING), '</nack_64_qam>') END
         AS payload,
       CASE WHEN event_id % 8 = 1 THEN '1' END AS result,
       CASE WHEN event_id % 16 = 1 THEN 'congested' END AS cause
FROM events
"""

TABLES["radio_events"] = """
SELECT concat('trace', CAST(user_id % 3 AS STRING)) AS trace_id, event_id AS row_no,
       EPOCH_US(ts) // 1000 AS ts_us,
       CASE event_type WHEN 'error' THEN 'RLF' WHEN 'signup' THEN 'HO_FAIL' WHEN 'purchase' THEN 'PAGING'
         WHEN 'view' THEN 'MEASUREMENT_REPORT' ELSE 'RRC_REESTABLISHMENT' END AS event_type,
       CASE WHEN event_id % 3 = 0 THEN concat('42701', lpad(CAST(user_id AS STRING), 10, '0')) END AS imsi,
       CASE WHEN event_id % 11 = 0 THEN concat('guti-', CAST(user_id % 50 AS STRING)) END AS guti,
       CASE WHEN event_id % 13 = 0 THEN concat('tmsi-', CAST(user_id % 50 AS STRING)) END AS tmsi,
       CASE WHEN event_id % 7 = 0 THEN concat('10.9.0.', CAST(user_id % 30 AS STRING)) END AS ue_ip,
       CASE WHEN event_id % 5 = 0 THEN concat('cell-', CAST(user_id % 7 AS STRING)) END AS cell_id
FROM events
"""

# Both planes have a row of every event; times and the rows that carry an identity differ between them.
TABLES["signals"] = """
SELECT concat('trace', CAST(user_id % 3 AS STRING)) AS trace_id, event_id AS event_no,
       CASE WHEN event_id % 19 <> 0 THEN EPOCH_US(ts) // 1000 + CAST(event_id % 37 AS BIGINT) * 800000 END AS ts_us,
       CASE WHEN event_id % 4 = 1 THEN 'SIP' ELSE 'S1AP' END AS type,
       CASE WHEN event_id % 9 = 4 THEN concat('42701', lpad(CAST(user_id AS STRING), 10, '0')) END AS imsi,
       CASE WHEN event_id % 11 = 5 THEN concat('guti-', CAST(user_id % 50 AS STRING)) END AS guti,
       CASE WHEN event_id % 13 = 6 THEN concat('tmsi-', CAST(user_id % 50 AS STRING)) END AS tmsi,
       CASE WHEN event_id % 7 = 3 THEN concat('10.9.0.', CAST(user_id % 30 AS STRING)) END AS ue_ip,
       CASE WHEN event_id % 5 = 2 THEN concat('cell-', CAST(user_id % 7 AS STRING)) END AS cell_id
FROM events
"""

TABLES["identified"] = """
SELECT concat('cap', CAST(o_orderkey % 3 AS STRING)) AS capture_id, o_orderkey AS frame_number,
       CASE o_orderkey % 4 WHEN 0 THEN 'SIP' WHEN 1 THEN 'Diameter' ELSE 'S1AP' END AS protocol,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('imsi-42701', lpad(CAST(o_custkey AS STRING), 10, '0')) END AS imsi,
       CASE WHEN o_orderkey % 7 = 0 THEN concat('+9745', lpad(CAST(o_custkey % 300 AS STRING), 7, '0')) END AS user_name,
       CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0
         THEN concat('sip:+9745', lpad(CAST(o_custkey % 400 AS STRING), 7, '0'), ';x') END AS sip_from,
       CASE WHEN o_orderkey % 6 = 0 THEN concat('tel:+9746', lpad(CAST(o_custkey % 200 AS STRING), 7, '0')) END AS sip_to,
       CASE WHEN o_orderkey % 9 = 0 THEN concat('35', lpad(CAST(o_custkey AS STRING), 14, '0')) END AS imei,
       CASE WHEN o_orderkey % 4 = 1 THEN concat('42702', lpad(CAST(o_custkey AS STRING), 9, '0'), '@ims') END
         AS diameter_user,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS cause,
       CASE WHEN o_orderkey % 3 = 0 THEN 'failure' ELSE 'success' END AS status
FROM orders
"""

TABLES["fields"] = f"""
SELECT concat('cap', CAST(l_orderkey % 3 AS STRING)) AS capture_id,
       CAST({_FRAME} AS STRING) AS frame_number,
       concat(CAST(l_orderkey AS STRING), '.', lpad(CAST(l_linenumber * 1000 AS STRING), 6, '0')) AS frame_time_epoch,
       concat('10.6.0.', CAST(l_suppkey % 9 AS STRING)) AS ip_src, concat('10.6.1.', CAST(l_partkey % 9 AS STRING)) AS ip_dst,
       CASE WHEN l_partkey % 10 = 0 THEN CAST(50 + l_linenumber AS STRING) END AS pfcp_msg_type,
       CASE WHEN l_partkey % 10 = 0 THEN CAST(l_orderkey % 64 AS STRING) END AS pfcp_seqno,
       CASE WHEN l_partkey % 10 = 0 THEN CAST(l_orderkey % 11 AS STRING) END AS pfcp_seid,
       CASE WHEN l_partkey % 10 = 0 AND l_linenumber > 4 THEN CAST(l_suppkey % 80 AS STRING) END AS pfcp_cause,
       CASE WHEN l_partkey % 10 = 1 THEN CAST(31 + l_linenumber AS STRING) END AS gtp_message,
       CASE WHEN l_partkey % 10 IN (1, 2) THEN CAST(l_orderkey % 90 AS STRING) END AS gtp_teid,
       CASE WHEN l_partkey % 10 = 1 THEN CAST(l_orderkey % 64 AS STRING) END AS gtp_seq,
       CASE WHEN l_partkey % 10 = 1 AND l_linenumber = 2 THEN CAST(l_suppkey % 101 AS STRING) END AS gtp_cause,
       CASE WHEN l_partkey % 10 = 3 THEN CAST(l_suppkey % 47 AS STRING) END AS ngap_procedureCode,
       CASE WHEN l_partkey % 10 = 3 THEN CAST(l_orderkey % 20 AS STRING) END AS ngap_AMF_UE_NGAP_ID,
       CASE WHEN l_partkey % 10 = 3 AND l_returnflag = 'R' THEN CAST(l_linenumber * 5 AS STRING) END AS ngap_cause,
       CASE WHEN l_partkey % 10 = 3 AND l_returnflag = 'N' THEN CAST(l_suppkey % 30 AS STRING) END AS ngap_cause_radioNetwork,
       CASE WHEN l_partkey % 10 = 3 AND l_linenumber = 1 THEN '65' END AS nas_5gs_mm_message_type,
       CASE WHEN l_partkey % 10 = 3 AND l_linenumber = 1 AND l_returnflag = 'A' THEN '11' END AS nas_5gs_mm_5gmm_cause,
       CASE WHEN l_partkey % 10 = 4 THEN CAST(l_suppkey % 30 AS STRING) END AS s1ap_procedureCode,
       CASE WHEN l_partkey % 10 = 4 THEN CAST(l_orderkey % 20 AS STRING) END AS s1ap_MME_UE_S1AP_ID,
       CASE WHEN l_partkey % 10 = 5 THEN CASE l_linenumber WHEN 1 THEN '316' WHEN 2 THEN '317' WHEN 3 THEN '272'
         ELSE '999' END END AS diameter_cmd_code,
       CASE WHEN l_partkey % 10 = 5 THEN CASE l_returnflag WHEN 'R' THEN '5001' WHEN 'A' THEN '2001' END END
         AS diameter_Result_Code,
       CASE WHEN l_partkey % 10 = 5 AND l_returnflag = 'N' THEN '5420' END AS diameter_Experimental_Result_Code,
       CASE WHEN l_partkey % 10 = 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN '16777251' ELSE '16777238' END END
         AS diameter_applicationId,
       CASE WHEN l_partkey % 10 = 6 AND l_linenumber < 3 THEN 'INVITE' END AS sip_Method,
       CASE WHEN l_partkey % 10 = 6 AND l_linenumber >= 3 THEN CAST(100 * l_linenumber AS STRING) END AS sip_Status_Code,
       CASE WHEN l_partkey % 10 = 6 THEN concat('c', CAST(l_orderkey AS STRING)) END AS sip_Call_ID,
       CASE WHEN l_partkey % 10 = 6 AND l_linenumber > 4 THEN CASE l_returnflag
         WHEN 'R' THEN 'X.int;reasoncode=0x00000603;add-info=01.0B' WHEN 'A' THEN 'SIP;cause=480;text="query ADB failed now"'
         ELSE 'Q.850;cause=16' END END AS sip_Reason,
       CASE WHEN l_partkey % 10 IN (3, 4, 7) THEN concat('0x', CAST(l_suppkey % 5 AS STRING)) END AS sctp_verification_tag,
       CASE WHEN l_partkey % 10 = 7 THEN CASE WHEN l_linenumber = 7 THEN '6' ELSE '0' END END AS sctp_chunk_type,
       CASE WHEN l_partkey % 10 IN (4, 7) AND l_linenumber = 2 THEN '1' END AS sctp_retransmission
FROM lineitem
"""

_TOKENS = {
    "spark": [
        (r"EPOCH_US\((\w+)\)", r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)"),
        (r"ISO_TEXT\((\w+)\)", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"),
        (r"EACH\((.*)\) AS k", r"explode(sequence(1, CAST(\1 AS INT))) AS k"),
        (r" // ", " div "),
    ],
    "duckdb": [
        (r"EPOCH_US\((\w+)\)", r"epoch_us(\1)"),
        (r"ISO_TEXT\((\w+)\)", r"strftime(\1, '%Y-%m-%d %H:%M:%S.%f')"),
        (r"EACH\((.*)\) AS k", r"unnest(range(1, CAST(\1 AS INT) + 1)) AS k"),
    ],
}


def table_sql(name: str, engine: str) -> str:
    """SQL text of a derived table for ``spark`` or ``duckdb``."""
    text = TABLES[name]
    for pattern, replacement in _TOKENS[engine]:
        text = re.sub(pattern, replacement, text)
    return text.strip()


def sample_table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A derived table over the parquet files in ``sf_dir``, or a stream of its rows."""
    text = table_sql(name, "spark")
    source = re.search(r"^FROM (\w+)", text, re.MULTILINE).group(1)
    text = re.sub(rf"^FROM {source}\b", "FROM {source}", text, flags=re.MULTILINE)
    path = f"{sf_dir}/{source}.parquet"
    return spark.sql(text, source=stream_of(spark, path) if stream else spark.read.parquet(path))
