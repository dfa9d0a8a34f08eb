"""Diagnostic service tables and the expressions that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.bits import byte_at, byte_hex

# Request services, positive responses that are not request + 0x40, negative response codes.
SERVICES = {
    0x04: "ClearDiagnosticInformationLegacy",
    0x09: "RequestVehicleInformation",
    0x10: "DiagnosticSessionControl",
    0x11: "ECUReset",
    0x12: "GMFailureRecord",
    0x18: "ReadDTCInformationLegacy",
    0x22: "ReadDataByIdentifier",
    0x27: "SecurityAccess",
    0x28: "CommunicationControl",
    0x2C: "DynamicallyDefineDataIdentifier",
    0x2E: "WriteDataByIdentifier",
    0x31: "RoutineControl",
    0x34: "RequestDownload",
    0x35: "RequestUpload",
    0x36: "TransferData",
    0x37: "RequestTransferExit",
    0x3E: "TesterPresent",
    0x85: "ControlDTCSetting",
    0xA9: "GMReadDTCInformation",
    0xAA: "GMDynamicDataPacketControl",
}
SPECIAL_POSITIVE = {0x44: 0x04, 0x49: 0x09, 0x52: 0x12, 0x58: 0x18, 0x81: 0xA9}
NRC_NAMES = {
    0x10: "generalReject",
    0x11: "serviceNotSupported",
    0x12: "subFunctionNotSupported",
    0x13: "incorrectMessageLengthOrInvalidFormat",
    0x14: "responseTooLong",
    0x21: "busyRepeatRequest",
    0x22: "conditionsNotCorrect",
    0x24: "requestSequenceError",
    0x31: "requestOutOfRange",
    0x33: "securityAccessDenied",
    0x35: "invalidKey",
    0x36: "exceedNumberOfAttempts",
    0x37: "requiredTimeDelayNotExpired",
    0x70: "uploadDownloadNotAccepted",
    0x71: "transferDataSuspended",
    0x72: "generalProgrammingFailure",
    0x73: "wrongBlockSequenceCounter",
    0x78: "responsePending",
    0x7E: "subFunctionNotSupportedInActiveSession",
    0x7F: "serviceNotSupportedInActiveSession",
}
PROGRAMMING_SERVICES = [
    "DiagnosticSessionControl",
    "ECUReset",
    "SecurityAccess",
    "WriteDataByIdentifier",
    "RoutineControl",
    "RequestDownload",
    "RequestUpload",
    "TransferData",
    "RequestTransferExit",
]
SENSITIVE_SERVICES = ["SecurityAccess", "TransferData"]


def code_map(table: dict[int, object]) -> Column:
    """A constant map; Spark folds it into the plan once."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def service_name(code: Column) -> Column:
    return F.try_element_at(code_map(SERVICES), code)


def nrc_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(code_map(NRC_NAMES), code), F.lit("unknown"))


def positive_map() -> dict[int, int]:
    """Positive response to request: the special ones, then request + 0x40 where still free."""
    table = dict(SPECIAL_POSITIVE)
    for sid in SERVICES:
        if sid + 0x40 <= 0xFF:
            table.setdefault(sid + 0x40, sid)
    return table


def request_of_positive(code: Column) -> Column:
    return F.try_element_at(code_map(positive_map()), code)


def normalise_service(text: Column) -> Column:
    """``0xNN`` of a service given as decimal, 0x, 0o or 0b text; null when it is none of these."""
    t = F.lower(F.trim(text))
    number = (
        F.when(t.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substr(t, F.lit(3)), 16, 10))
        .when(t.rlike("^0o[0-7]{1,20}$"), F.conv(F.substr(t, F.lit(3)), 8, 10))
        .when(t.rlike("^0b[01]{1,62}$"), F.conv(F.substr(t, F.lit(3)), 2, 10))
        .when(t.rlike("^(0+|[1-9][0-9]{0,17})$"), t)
    ).cast("bigint")
    return byte_hex(number.bitwiseAND(255))


def candidate_response_id(request_id: Column) -> Column:
    """Legacy normal addressing: request + 0x400, only for 0x200..0x2FF."""
    return F.when(request_id.between(0x200, 0x2FF), request_id + 0x400)


def single_frame_payload(data: Column) -> Column:
    """Payload of an ISO-TP single frame, null when it is not one."""
    n = byte_at(data, 0)
    return F.when(n.between(1, 7) & (F.length(data) > n), F.substr(data, F.lit(2), n))
