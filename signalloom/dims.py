"""Standard codes, ports, rules and word lists the operators look up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str | int | float) -> str:
    """A constant as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def sql_list(values: list) -> str:
    """Constants as the inside of an ``IN (...)``."""
    return ", ".join(sql_text(v) for v in values)


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a constant table, NULL when absent. Constant-folded by Catalyst."""
    pairs = sql_list([x for item in table.items() for x in item])
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def first_match(text: Column, words: dict[str, str] | list[tuple[str, str]]) -> Column:
    """Result of the first word, in the order given, that ``text`` contains; NULL without a hit."""
    items = list(words.items()) if isinstance(words, dict) else words
    out = None
    for word, result in items:
        hit = text.contains(word)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out


def contains_any(text: Column, words: list[str]) -> Column:
    """TRUE when ``text`` contains one of ``words``; FALSE for NULL."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return F.coalesce(out, F.lit(False))


# PFCP cause codes (3GPP TS 29.244).
PFCP_CAUSES = {
    1: "Request Accepted",
    2: "Request Rejected",
    3: "Session Context Not Found",
    4: "Mandatory IE Missing",
    5: "Conditional IE Missing",
    6: "Invalid Length",
    7: "Mandatory IE Incorrect",
    8: "Invalid Forwarding Policy",
    9: "Request Rejected (Reason not specified)",
    19: "No Established PFCP Association",
    64: "Remote Node Not Responsive",
    72: "System Failure",
    73: "No Resources Available",
}

# GTPv2-C cause codes (3GPP TS 29.274).
GTPV2_CAUSES = {
    16: "Request Accepted",
    64: "Context Not Found",
    66: "No Resources Available",
    70: "System Failure",
    72: "Mandatory IE Missing",
    73: "Conditional IE Missing",
    74: "Invalid Length",
    83: "Preferred PDN Type not supported",
    84: "All dynamic addresses are occupied",
    88: "UE refuses",
    89: "Service denied",
    100: "Remote Node Not Responsive",
}

# NGAP / S1AP cause codes (3GPP TS 38.413).
NGAP_CAUSES = {
    15: "Unspecified",
    20: "Release due to UE generated signalling connection release",
    26: "Failure in the Radio Interface Procedure",
    27: "Release due to pre-emption",
    113: "Transport Resource Unavailable",
    114: "Unspecified Transport Layer Cause",
    115: "Transfer Syntax Error",
    116: "Abstract Syntax Error (Reject)",
    118: "Message not Compatible with Receiver State",
}

# Diameter result codes (RFC 6733).
DIAMETER_BASE = {
    2001: "DIAMETER_SUCCESS",
    2002: "DIAMETER_LIMITED_SUCCESS",
    3001: "DIAMETER_COMMAND_UNSUPPORTED",
    3002: "DIAMETER_UNABLE_TO_DELIVER",
    3003: "DIAMETER_REALM_NOT_SERVED",
    3004: "DIAMETER_TOO_BUSY",
    3005: "DIAMETER_LOOP_DETECTED",
    3006: "DIAMETER_REDIRECT_INDICATION",
    3007: "DIAMETER_APPLICATION_UNSUPPORTED",
    3008: "DIAMETER_INVALID_HDR_BITS",
    3009: "DIAMETER_INVALID_AVP_BITS",
    3010: "DIAMETER_UNKNOWN_PEER",
    4001: "DIAMETER_AUTHENTICATION_REJECTED",
    4002: "DIAMETER_OUT_OF_SPACE",
    4003: "ELECTION_LOST",
    5001: "DIAMETER_AVP_UNSUPPORTED",
    5002: "DIAMETER_UNKNOWN_SESSION_ID",
    5003: "DIAMETER_AUTHORIZATION_REJECTED",
    5004: "DIAMETER_INVALID_AVP_VALUE",
    5005: "DIAMETER_MISSING_AVP",
    5006: "DIAMETER_RESOURCES_EXCEEDED",
    5007: "DIAMETER_CONTRADICTING_AVPS",
    5008: "DIAMETER_AVP_NOT_ALLOWED",
    5009: "DIAMETER_AVP_OCCURS_TOO_MANY_TIMES",
    5010: "DIAMETER_NO_COMMON_APPLICATION",
    5011: "DIAMETER_UNSUPPORTED_VERSION",
    5012: "DIAMETER_UNABLE_TO_COMPLY",
    5014: "DIAMETER_INVALID_BIT_IN_HEADER",
    5015: "DIAMETER_INVALID_AVP_LENGTH",
    5016: "DIAMETER_INVALID_MESSAGE_LENGTH",
    5017: "DIAMETER_INVALID_AVP_BIT_COMBO",
    5018: "DIAMETER_NO_COMMON_SECURITY",
}

# Diameter experimental result codes (3GPP TS 29.229, TS 29.272).
DIAMETER_3GPP = {
    2001: "DIAMETER_FIRST_REGISTRATION",
    2002: "DIAMETER_SUBSEQUENT_REGISTRATION",
    2003: "DIAMETER_UNREGISTERED_SERVICE",
    5001: "DIAMETER_ERROR_USER_UNKNOWN",
    5002: "DIAMETER_ERROR_IDENTITIES_DONT_MATCH",
    5003: "DIAMETER_ERROR_IDENTITY_NOT_REGISTERED",
    5004: "DIAMETER_ERROR_ROAMING_NOT_ALLOWED",
    5005: "DIAMETER_ERROR_IDENTITY_ALREADY_REGISTERED",
    5006: "DIAMETER_ERROR_AUTH_SCHEME_NOT_SUPPORTED",
    5007: "DIAMETER_ERROR_IN_ASSIGNMENT_TYPE",
    5008: "DIAMETER_ERROR_TOO_MUCH_DATA",
    5009: "DIAMETER_ERROR_NOT_SUPPORTED_USER_DATA",
    5011: "DIAMETER_ERROR_FEATURE_UNSUPPORTED",
    5401: "DIAMETER_ERROR_USER_UNKNOWN",
    5402: "DIAMETER_ERROR_UNKNOWN_EPS_SUBSCRIPTION",
    5420: "DIAMETER_ERROR_UNKNOWN_SERVING_NODE",
    5421: "DIAMETER_ERROR_RAT_NOT_ALLOWED",
    5450: "DIAMETER_ERROR_ROAMING_NOT_ALLOWED",
}

# SIP status codes (RFC 3261).
SIP_STATUS = {
    100: "Trying",
    180: "Ringing",
    183: "Session Progress",
    200: "OK",
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    408: "Request Timeout",
    480: "Temporarily Unavailable",
    486: "Busy Here",
    487: "Request Terminated",
    488: "Not Acceptable Here",
    500: "Server Internal Error",
    502: "Bad Gateway",
    503: "Service Unavailable",
    504: "Server Time-out",
    600: "Busy Everywhere",
    603: "Decline",
    604: "Does Not Exist Anywhere",
}

# NAS EMM cause codes (3GPP TS 24.301).
NAS_EMM_CAUSES = {
    2: "IMSI unknown in HSS",
    3: "Illegal UE",
    5: "IMEI not accepted",
    6: "Illegal ME",
    7: "EPS services not allowed",
    8: "EPS services and non-EPS services not allowed",
    9: "UE identity cannot be derived",
    10: "Implicitly detached",
    11: "PLMN not allowed",
    12: "Tracking Area not allowed",
    13: "Roaming not allowed in this TA",
    14: "EPS services not allowed in this PLMN",
    15: "No suitable cells in TA",
    16: "MSC temporarily not reachable",
    17: "Network failure",
    18: "CS domain not available",
    19: "ESM failure",
    20: "MAC failure",
    21: "Synch failure",
    22: "Congestion",
    23: "UE security capabilities mismatch",
    25: "Not authorized for this CSG",
    35: "Requested service option not authorized in this PLMN",
    39: "CS service temporarily not available",
    40: "No EPS bearer context activated",
}

# NAS ESM cause codes (3GPP TS 24.301).
NAS_ESM_CAUSES = {
    8: "Operator Determined Barring",
    26: "Insufficient resources",
    27: "Missing or unknown APN",
    28: "Unknown PDN type",
    29: "User authentication failed",
    30: "Request rejected by Serving GW or PDN GW",
    31: "Request rejected, unspecified",
    32: "Service option not supported",
    33: "Requested service option not subscribed",
    34: "Service option temporarily out of order",
    35: "PTI already in use",
    36: "Regular deactivation",
    37: "EPS QoS not accepted",
    38: "Network failure",
    39: "Reactivation requested",
    41: "Semantic error in the TFT operation",
    42: "Syntactical error in the TFT operation",
    43: "Invalid EPS bearer identity",
    44: "Semantic errors in packet filter(s)",
    45: "Syntactical errors in packet filter(s)",
    46: "Unused (see annex I)",
    47: "PTI mismatch",
    50: "PDN type IPv4 only allowed",
    51: "PDN type IPv6 only allowed",
    52: "Single address bearers only allowed",
    53: "ESM information not received",
    54: "PDN connection does not exist",
    55: "Multiple PDN connections for APN not allowed",
    56: "Collision with network initiated request",
    59: "Unsupported QCI value",
    60: "Bearer handling not supported",
    65: "Maximum number of EPS bearers reached",
    66: "Requested APN not supported in current RAT",
}

# Dissector dictionary fields that hold the causes of a protocol, in lookup order.
CAUSE_FIELDS = {
    "GTPv2-C": ["gtpv2.cause", "gtpv2.cause_type"],
    "PFCP": ["pfcp.cause", "pfcp.cause_ie"],
    "Diameter": ["diameter.Result-Code", "diameter.Experimental-Result-Code"],
    "NGAP": [
        "ngap.Cause",
        "ngap.CauseRadioNetwork",
        "ngap.CauseTransport",
        "ngap.CauseNas",
        "ngap.CauseProtocol",
        "ngap.CauseMisc",
    ],
    "S1AP": [
        "s1ap.Cause",
        "s1ap.CauseRadioNetwork",
        "s1ap.CauseTransport",
        "s1ap.CauseNAS",
        "s1ap.CauseProtocol",
        "s1ap.CauseMisc",
    ],
    "NAS-EMM": ["nas_eps.emm.cause"],
    "NAS-ESM": ["nas_eps.esm.cause"],
    "SIP": ["sip.Status-Code"],
}

# Diameter application ids (name, interface, description).
DIAMETER_APPS = {
    0: ("Base", "Generic", "Diameter Base Protocol"),
    4: ("Ro", "OCS", "Online Charging"),
    16777216: ("Cx", "P-CSCF↔HSS", "IMS Registration"),
    16777217: ("Sh", "Unknown", ""),
    16777236: ("Rx", "P-CSCF↔PCRF", "Policy/QoS"),
    16777238: ("Gx", "PGW↔PCRF", "Policy Control"),
    16777251: ("S6a", "MME↔HSS", "EPS Subscriber Data"),
    16777252: ("S6d", "SGSN↔HSS", "EPS Subscriber Data"),
    16777255: ("SWx", "3GPP AAA↔HSS", "Non-3GPP Access"),
    16777272: ("S6b", "PGW↔3GPP AAA", "Trusted WLAN"),
}

# Application ids and command codes used for node roles.
ROLE_APPS = {
    16777251: "S6a",
    16777238: "Gx",
    16777236: "Rx",
    4: "Gy",
    16777216: "Cx",
    16777272: "S6b",
}
DIAMETER_COMMANDS = {
    265: "AAR",
    266: "AAA",
    272: "CCR",
    273: "CCA",
    300: "UAR",
    301: "SAR",
    302: "SAA",
    303: "MAR",
    304: "MAA",
    316: "ULR",
    317: "CLR",
    318: "AIR",
    319: "AIA",
}
DIAMETER_ROLE_ORDER = ["S6a", "Gx", "Rx", "Gy", "Cx"]
DIAMETER_ROLES = {
    "S6a": {"ULR": "MME", "ULA": "HSS", "AIR": "MME", "AIA": "HSS", "CLR": "HSS", "PUR": "MME"},
    "Gx": {"CCR": "PCEF", "CCA": "PCRF", "RAR": "PCRF"},
    "Rx": {"AAR": "AF", "AAA": "PCRF", "STR": "AF"},
    "Gy": {"CCR": "PCEF", "CCA": "OCS"},
    "Cx": {
        "UAR": "I-CSCF",
        "UAA": "HSS",
        "SAR": "S-CSCF",
        "SAA": "HSS",
        "MAR": "I-CSCF",
        "MAA": "HSS",
    },
}

# Role of the sender per procedure code or message type.
NGAP_ROLES = {
    "15": "gNB",
    "4": "AMF",
    "46": "gNB",
    "14": "AMF",
    "InitialContextSetupResponse": "gNB",
    "29": "AMF",
    "PDUSessionResourceSetupResponse": "gNB",
    "41": "AMF",
    "UEContextReleaseComplete": "gNB",
    "0": "gNB",
    "1": "AMF",
}
S1AP_ROLES = {
    "12": "eNB",
    "11": "MME",
    "13": "eNB",
    "9": "MME",
    "InitialContextSetupResponse": "eNB",
    "23": "MME",
    "17": "eNB",
    "S1SetupResponse": "MME",
}
PFCP_ROLES = {
    "50": "SMF",
    "51": "UPF",
    "52": "SMF",
    "53": "UPF",
    "54": "SMF",
    "55": "UPF",
    "5": "PFCP_CP",
    "6": "PFCP_UP",
}
GTPV2_ROLES = {"32": "MME", "33": "SGW"}

# Procedure labels. A code listed twice by the standard keeps its later name.
S1AP_PROCEDURES = {
    0: "HandoverPreparation",
    1: "HandoverResourceAllocation",
    2: "HandoverNotification",
    3: "PathSwitchRequest",
    4: "HandoverCancel",
    5: "E-RABSetup",
    6: "E-RABModify",
    7: "E-RABRelease",
    8: "E-RABReleaseIndication",
    9: "InitialContextSetup",
    10: "InitialContextSetupFailure",
    12: "InitialUEMessage",
    13: "DownlinkNASTransport",
    14: "Paging",
    17: "UECapabilityInfoIndication",
    21: "UEContextReleaseRequest",
    23: "UEContextRelease",
    24: "UEContextReleaseCommand",
    25: "UEContextModification",
    27: "UplinkNASTransport",
}
NGAP_PROCEDURES = {
    12: "HandoverPreparation",
    13: "HandoverResourceAllocation",
    14: "InitialContextSetup",
    15: "InitialUEMessage",
    16: "HandoverCancel",
    25: "DownlinkNASTransport",
    26: "PDUSessionResourceSetup",
    27: "PDUSessionResourceModify",
    28: "PDUSessionResourceRelease",
    36: "Paging",
    41: "UEContextRelease",
    42: "UEContextReleaseRequest",
    43: "UEContextModification",
    46: "UplinkNASTransport",
}

# Words in RAN cause labels.
RADIO_CAUSE_WORDS = [
    "radio",
    "rlf",
    "radio link failure",
    "radio network layer failure",
    "radio connection",
    "radio resources",
    "handover cancelled",
    "handover failure",
    "ho failure",
    "lost coverage",
    "user inactivity",
    "release due to",
    "connection with ue lost",
]
HANDOVER_CAUSE_WORDS = [
    "handover",
    "ho failure",
    "ho cancelled",
    "relocation",
    "target not allowed",
    "no radio resources",
    "resource unavailable",
]
CONGESTION_CAUSE_WORDS = [
    "congestion",
    "overload",
    "no resources",
    "resource unavailable",
    "capacity exceeded",
    "reject",
]

# Words in SIP Reason headers that hint at a move to the circuit-switched domain.
SRVCC_WORDS = ["srvcc", "ps to cs", "ps-to-cs", "handover", "interworking", "msc", "scc as"]
CSFB_WORDS = ["csfb", "cs fallback", "cs-fallback", "fallback", "cs domain", "geran", "utran"]
HANDOVER_CAUSE_CODES = ["503"]
S1AP_HANDOVER_CODES = [0, 1, 2, 3, 5, 23, 24, 25]
NGAP_HANDOVER_CODES = [12, 13, 14, 15, 41]

# Vendor reason codes (hex, lower case) and Reason text patterns.
NOKIA_CODES = {
    "0x00000000": "Normal clearing",
    "0x00000603": "Call release",
    "0x0000070e": "Timeout/interworking",
}
HUAWEI_PATTERNS = {
    "RELEASE FROM CC": ("Call Control", "Internal release"),
    "query adb failed": ("HSS", "Subscriber lookup failed"),
    "No Prack received": ("SCSCF", "PRACK timeout"),
    "Invalid number format": ("AS", "Address incomplete"),
}

# Codec quality ranks and families.
CODEC_RANK = {
    "EVS": 100,
    "AMR-WB": 80,
    "AMR": 60,
    "AMR-NB": 60,
    "G729": 40,
    "PCMA": 30,
    "PCMU": 30,
}
CODEC_FAMILY = {
    "AMR": "AMR",
    "AMR-NB": "AMR",
    "AMR-WB": "AMR-WB",
    "EVS": "EVS",
    "PCMU": "G711",
    "PCMA": "G711",
    "G711": "G711",
    "G729": "G729",
    "G729A": "G729",
}

# Hint -> (generation, radio access technology), in order of precedence.
GENERATION_HINTS = {
    "LTE": ("4G", "EUTRAN"),
    "4G": ("4G", "EUTRAN"),
    "EUTRAN": ("4G", "EUTRAN"),
    "E-UTRAN": ("4G", "EUTRAN"),
    "NR": ("5G", "NR"),
    "5G": ("5G", "NR"),
    "5G-NR": ("5G", "NR"),
    "WCDMA": ("3G", "UTRAN"),
    "3G": ("3G", "UTRAN"),
    "UTRAN": ("3G", "UTRAN"),
    "UMTS": ("3G", "UTRAN"),
    "GSM": ("2G", "GERAN"),
    "2G": ("2G", "GERAN"),
    "GERAN": ("2G", "GERAN"),
    "GPRS": ("2G", "GERAN"),
    "EDGE": ("2G", "GERAN"),
}

# Words that decide the type of a radio event, in order of precedence.
RADIO_EVENT_WORDS = [
    ("RLF", ["RADIO LINK FAILURE", "RLF", "RADIO_LINK_FAILURE"]),
    ("HO_FAIL", ["HANDOVER FAILURE", "HO FAIL", "HO_FAIL", "HANDOVER_FAILURE"]),
    ("HO_SUCCESS", ["HANDOVER SUCCESS", "HO SUCCESS", "HO_SUCCESS", "HANDOVER_SUCCESS"]),
    ("HO_ATTEMPT", ["HANDOVER ATTEMPT", "HO ATTEMPT", "HO_ATTEMPT", "HANDOVER PREPARATION"]),
    ("CSFB", ["CSFB", "CS FALLBACK", "CS_FALLBACK"]),
    ("SRVCC", ["SRVCC"]),
    ("PAGING", ["PAGING"]),
    ("RRC_SETUP", ["RRC SETUP", "RRC_SETUP", "RRC CONNECTION SETUP"]),
    ("RRC_RELEASE", ["RRC RELEASE", "RRC_RELEASE", "RRC CONNECTION RELEASE"]),
    (
        "RRC_REESTABLISHMENT",
        ["RRC RE-ESTABLISHMENT", "RRC REESTABLISHMENT", "RRC_REESTABLISHMENT"],
    ),
    ("ATTACH", ["ATTACH"]),
    ("DETACH", ["DETACH"]),
    ("TAU", ["TRACKING AREA UPDATE", "TAU"]),
    ("SERVICE_REQUEST", ["SERVICE REQUEST", "SERVICE_REQUEST"]),
    ("MEASUREMENT_REPORT", ["MEASUREMENT REPORT", "MEASUREMENT_REPORT"]),
]

# Zone names and their offset in seconds; other names count as +3 h.
ZONE_OFFSETS = {
    "Asia/Qatar": 10800,
    "UTC": 0,
    "GMT": 0,
    "AST": 10800,
    "GST": 14400,
    "IST": 19800,
    "CET": 3600,
    "EET": 7200,
    "EST": -18000,
    "PST": -28800,
    "CST": -21600,
}
DEFAULT_ZONE = "Asia/Qatar"

# Technologies in display order.
PRIMARY_TECHNOLOGIES = [
    "5G/NR",
    "5G/SBI",
    "4G/LTE",
    "3G/UMTS",
    "2G/GSM",
    "VoLTE/VoNR",
    "VoIP",
    "2G/3G/SS7",
]

# Protocols a capture is checked for.
COMMON_PROTOCOLS = ["SIP", "RTP", "DIAMETER", "GTP", "PFCP", "S1AP", "NGAP", "SCTP", "HTTP2"]
