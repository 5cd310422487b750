"""Payloads: schema, validation with a reason, and the 14-feature projection.

Differences from a byte-exact parser, all of them accepting more: members may
come in any order, unknown ones are ignored, numbers may have exponents,
strings may have escapes, and an absent ``last_transaction`` counts as null.
Timestamps of the last transaction must be valid; the request's own day of the
month may lie beyond the month's end (up to 31) and runs on into the next.
What follows the object's end is ignored, as there.

Strict mode takes only what such a parser takes: the members in their fixed
order and no others, numbers without exponent or plus sign, strings without
escapes, ``last_transaction`` present; the first member's name is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors
from vicinal.functions.scalars import day_of, ratio_or_zero, scaled

PAYLOAD = """id string,
transaction struct<amount: double, installments: bigint, requested_at: string>,
customer struct<avg_amount: double, tx_count_24h: bigint, known_merchants: array<string>>,
merchant struct<id: string, mcc: string, avg_amount: double>,
terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>,
last_transaction struct<timestamp: string, km_from_current: double>,
_corrupt_record string"""

FEATURES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)

# Fixed values that results depend on: the largest amount and so on of the scales, and risks by merchant category.
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H = 10_000, 12, 10, 1440, 1000, 20
MCC_RISK = {
    "4511": 0.35, "5311": 0.25, "5411": 0.15, "5812": 0.30, "5912": 0.20,
    "5944": 0.45, "5999": 0.50, "7801": 0.80, "7802": 0.75, "7995": 0.85,
}
UNKNOWN_RISK = 0.5
U32 = 4294967295
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def strict_pattern() -> str:
    """The text of a payload for a strict parser, as a regular expression."""
    text, number, whole, flag = r'"[^"\\]*"', r"-?[0-9]+(?:\.[0-9]+)?", r"[0-9]+", r"(?:true|false)"
    gap = r"[ \t\r\n]*"
    members = lambda *pairs: rf"\{{{gap}" + rf"{gap},{gap}".join(f"{name}{gap}:{gap}{value}" for name, value in pairs) + rf"{gap}\}}"
    names = rf"\[{gap}(?:{text}(?:{gap},{gap}{text})*)?{gap}\]"
    return f"^{gap}" + members(
        (text, text),
        ('"transaction"', members(('"amount"', number), ('"installments"', whole), ('"requested_at"', text))),
        ('"customer"', members(('"avg_amount"', number), ('"tx_count_24h"', whole), ('"known_merchants"', names))),
        ('"merchant"', members(('"id"', text), ('"mcc"', text), ('"avg_amount"', number))),
        ('"terminal"', members(('"is_online"', flag), ('"card_present"', flag), ('"km_from_home"', number))),
        ('"last_transaction"', "(?:null|" + members(('"timestamp"', text), ('"km_from_current"', number)) + ")"),
    )


def parse(payloads: DataFrame, column: str = "value") -> DataFrame:
    """``payloads`` with the parsed request as ``p``.

    It passes through an array of one element, which keeps the optimizer from
    parsing once for each field that is used later.
    """
    request = F.from_json(column, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return payloads.select("*", F.explode(F.array(request)).alias("p"))


def mcc_risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MCC_RISK.items()), "mcc string, risk double")


def _digits(stamp: Column, at: int, length: int) -> Column:
    return F.substring(stamp, at, length).try_cast("int")


def _in_u32(x: Column) -> Column:
    return x.between(0, U32)


def rejection(p: str = "p") -> Column:
    """Why a parsed payload is rejected; null where it is valid."""
    c = lambda name: F.col(f"{p}.{name}")
    at, last = c("transaction.requested_at"), c("last_transaction")
    needed = (
        "id", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h",
        "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
    )
    missing = F.lit(False)
    for name in needed:
        missing = missing | c(name).isNull()
    bad_stamp = ~at.rlike(_STAMP) | (_digits(at, 12, 2) > 23) | ~_digits(at, 6, 2).between(1, 12) | ~_digits(at, 9, 2).between(1, 31)
    stamp = last["timestamp"]
    bad_last = last.isNotNull() & (stamp.isNull() | last["km_from_current"].isNull() | ~stamp.rlike(_STAMP) | F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNull())
    return (
        F.when(F.col(p).isNull() | c("_corrupt_record").isNotNull(), "malformed")
        .when(missing, "missing_field")
        .when(~_in_u32(c("transaction.installments")) | ~_in_u32(c("customer.tx_count_24h")), "invalid_number")
        .when(bad_stamp, "invalid_date")
        .when(~c("merchant.mcc").rlike(r"^[0-9]{4}$"), "invalid_mcc")
        .when(bad_last, "invalid_last_transaction")
    )


def _seconds(stamp: Column) -> Column:
    """Seconds of a timestamp's digits since 1970, its day of the month running on beyond the month's end."""
    day = day_of(_digits(stamp, 1, 4), _digits(stamp, 6, 2), _digits(stamp, 9, 2))
    return F.unix_date(day).cast("bigint") * 86400 + _digits(stamp, 12, 2) * 3600 + _digits(stamp, 15, 2) * 60 + _digits(stamp, 18, 2)


def feature_vector(p: str = "p", risk: str = "risk") -> Column:
    """The 14 features, in order, of a valid payload that was joined with its category's risk."""
    c = lambda name: F.col(f"{p}.{name}")
    at, last = c("transaction.requested_at"), c("last_transaction")
    day = day_of(_digits(at, 1, 4), _digits(at, 6, 2), _digits(at, 9, 2))
    minutes = F.floor(F.abs(_seconds(at) - _seconds(last["timestamp"])) / 60)
    or_none = lambda x: F.when(last.isNull(), F.lit(-1.0).cast("float")).otherwise(x)
    flag = lambda b: b.cast("int").cast("float")
    return F.array(
        scaled(c("transaction.amount"), MAX_AMOUNT),
        scaled(c("transaction.installments"), MAX_INSTALLMENTS),
        scaled(ratio_or_zero(c("transaction.amount"), c("customer.avg_amount")), MAX_RATIO),
        scaled(_digits(at, 12, 2), 23),
        scaled(F.weekday(day), 6),
        or_none(scaled(minutes, MAX_MINUTES)),
        or_none(scaled(last["km_from_current"], MAX_KM)),
        scaled(c("terminal.km_from_home"), MAX_KM),
        scaled(c("customer.tx_count_24h"), MAX_TX_24H),
        flag(c("terminal.is_online")),
        flag(c("terminal.card_present")),
        flag(~F.array_contains(c("customer.known_merchants"), c("merchant.id"))),
        F.coalesce(F.col(risk), F.lit(UNKNOWN_RISK)).cast("float"),
        scaled(c("merchant.avg_amount"), MAX_AMOUNT),
    )


def _reason(column: str, strict: bool) -> Column:
    reason = rejection()
    if strict:
        reason = F.coalesce(F.when(F.col(column).isNull() | ~F.col(column).rlike(strict_pattern()), "not_strict"), reason)
    return reason


def _with_risk(parsed: DataFrame) -> DataFrame:
    risks = F.broadcast(mcc_risks(parsed.sparkSession))  # ten fixed rows
    return parsed.join(risks, F.col("p.merchant.mcc") == F.col("mcc"), "left")


def vectorize(payloads: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """``payloads`` with ``reason`` (null: valid) and ``features`` (null: rejected)."""
    joined = _with_risk(parse(payloads, column).withColumn("reason", _reason(column, strict)))
    return joined.withColumn("features", F.when(F.col("reason").isNull(), feature_vector())).drop("p", "mcc", "risk")


def quantized(payloads: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """``payloads`` with ``reason`` and ``v``, the quantized features.

    Reason and features pass through arrays of one element, as the parsed
    request does: a filter would work out the reason again, and Spark does not
    compile what it pulls into the transform that quantizes.
    """
    checked = parse(payloads, column).select("*", F.explode(F.array(_reason(column, strict))).alias("reason"))
    found = F.when(F.col("reason").isNull(), feature_vector())
    rows = _with_risk(checked).select(*(payloads[c] for c in payloads.columns), "reason", F.explode(F.array(found)).alias("features"))
    return rows.withColumn("v", vectors.quantize("features")).drop("features")
