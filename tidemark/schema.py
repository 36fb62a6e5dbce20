"""Declared columns and roles of the transaction data; what is categorical is declared, never inferred."""

from __future__ import annotations

# Fixed values of the data model.
ID, TARGET, TIME, AMOUNT = "TransactionID", "isFraud", "TransactionDT", "TransactionAmt"
DAY = 86_400
VALID_FRACTION, TEST_FRACTION, FOLDS, BUDGET, SEED = 0.15, 0.20, 5, 0.01, 42
LABEL_LAG_DAYS, SMOOTHING = 30, 50.0

TRANSACTION_CATEGORICAL = ["ProductCD", *(f"card{i}" for i in range(1, 7)), "addr1", "addr2", "P_emaildomain", "R_emaildomain", *(f"M{i}" for i in range(1, 10))]
IDENTITY_CATEGORICAL = ["DeviceType", "DeviceInfo", *(f"id_{i}" for i in range(12, 39))]
CATEGORICAL = TRANSACTION_CATEGORICAL + IDENTITY_CATEGORICAL
NUMERIC_BLOCKS = {"C": [f"C{i}" for i in range(1, 15)], "D": [f"D{i}" for i in range(1, 16)], "V": [f"V{i}" for i in range(1, 340)], "id": [f"id_{i:02d}" for i in range(1, 12)], "dist": ["dist1", "dist2"]}

ENTITIES = {
    "uid_card1": ["card1"],
    "uid_card_addr": ["card1", "card2", "card3", "card5", "addr1"],
    "uid_card_addr_d1": ["card1", "card2", "card3", "card5", "addr1", "D1_ref_day"],
}
INTERACTIONS = [("ProductCD", "card4"), ("ProductCD", "card6"), ("card1", "addr1"), ("DeviceType", "P_emaildomain"), ("P_emaildomain", "R_emaildomain")]
ISNULL = ["dist1", "dist2", "D7", "D12", "D13", "D14", "D6", "D8", "D9", "M1", "M4", "M5", "M6", "M7", "M8", "M9", "card2", "card5", "addr1", "P_emaildomain", "R_emaildomain"]
REF_DAY = ["D1", "D2", "D4", "D10", "D11", "D15"]
FREQUENCY = ["card1", "card2", "card3", "card5", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo", "id_31", "id_30", "id_33", "id_19", "id_20"]
TARGET_ENCODED = ["card1", "addr1", "P_emaildomain", "ProductCD_x_card4"]


def present(columns, names) -> list[str]:
    """Those of ``names`` that the frame has, in their declared order."""
    held = set(columns)
    return [c for c in names if c in held]
