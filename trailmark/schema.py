"""The canonical ledger: one row for each leg of a money trail."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: A column that equal legs of a source share, if it knows one; see `core.flag_duplicates`.
LEG_GROUP = "_leg_group"
#: Wall-clock times have no zone; they are never shifted.
TIME = T.TimestampNTZType()

LEDGER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("report_id", T.LongType()),
        T.StructField("ack_no", T.StringType()),
        T.StructField("complaint_date", TIME),
        T.StructField("victim_account", T.StringType()),
        T.StructField("victim_bank", T.StringType()),
        T.StructField("beneficiary_account", T.StringType()),
        T.StructField("beneficiary_bank", T.StringType()),
        T.StructField("beneficiary_name", T.StringType()),
        T.StructField("ifsc_code", T.StringType()),
        T.StructField("transaction_date", TIME),
        T.StructField("transaction_amount", MONEY),
        T.StructField("disputed_amount", MONEY),
        T.StructField("utr_no", T.StringType()),
        T.StructField("payment_mode", T.StringType()),
        T.StructField("layer_no", T.IntegerType()),
        T.StructField("atm_id", T.StringType()),
        T.StructField("atm_location", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("remarks", T.StringType()),
    ]
)

#: Thresholds of the analyses (fixed values).
RESPONSE_GAP_DAYS = (7, 14)
RECOVERY_RATE_PCT = (25, 0)
FANOUT_HIGH = 2.0
AGGREGATOR_MIN, AGGREGATOR_RED = 3, 5
RAPID_COUNT, RAPID_MINUTES = 3, 60
MULTI_ATM_COUNT = 3
MERCHANT_COUNT, MERCHANT_MINUTES = 3, 60
CYCLE_MAX_LENGTH, CYCLE_TOP, COLLECTOR_TOP = 6, 10, 25
#: Points of each signal of the risk score (fixed values).
WEIGHTS = {
    "pass_through": 30, "cashout_speed": 20, "txn_count": 15, "cross_case": 20, "geo_spread": 10, "kyc_variance": 5,
    "both_sheets": 18, "multi_channel": 8, "fan_in": 8, "high_cashout_ratio": 15, "same_day_in_out": 17, "in_degree_collector": 6,
}
RISK_HIGH, RISK_MEDIUM = 70, 40
