"""Fixed business values.

Thresholds, labels and formula constants that results depend on.  Operators take
them as default arguments, so a caller can override any of them.
"""

# Stock formulas
TURNOVER_NUMERATOR = 12.0
TURNOVER_QTY_UNIT = 100
DAYS_QTY_UNIT = 10
DAYS_PER_MONTH = 30

# Alert and report thresholds
OVERSTOCK_TURNOVER = 4.0
ALERT_DAYS = 60
KPI_DAYS = 90
ALERT_ROWS = 20
SUPPLIER_ROWS = 15
WORST_ROWS = 10
CRITICAL_TURNOVER = 1.5
CRITICAL_DAYS = 300
GOOD_TURNOVER = 1.5

# Action rules
HIGH_TURNOVER_BELOW = 1.0
HIGH_DAYS_ABOVE = 60
MEDIUM_TURNOVER = (1.0, 1.5)
MEDIUM_DAYS = (30, 60)
EMERGENCY_SHARE = 0.2
FORECAST_GAP_PCT = 30.0
DAYS_UNTIL_NEED = 7
SURPLUS_FACTOR = 2

# labels
PRIORITY_HIGH = "HIGH"
PRIORITY_MEDIUM = "MEDIUM"
PRIORITY_LOW = "LOW"
PROPOSAL_STATUS = "PENDING"
PROPOSAL_AUTHOR = "ai-agent"
STATUS_SHORT = "不足"
STATUS_SURPLUS = "過剰"
STATUS_ADEQUATE = "適正"
URGENT = "特急"
NORMAL = "通常"
VERDICT_GOOD = "良好"
VERDICT_POOR = "要改善"
TOTAL_LABEL = "合 計"
NO_TOTAL = "—"

# Column-name words that mark a report column as summable
NUMERIC_WORDS = ("金額", "数量", "qty", "value", "rate", "率", "日数", "days",
                 "price", "amount", "pct", "%")

# Order status
DELIVERED = "delivered"
IN_TRANSIT = "in_transit"
PENDING = "pending"

# Generator profile per category
# (code, name, items, price low, price high, lot low, lot high, stock low, stock high,
#  stock noise low, stock noise high, forecast low, forecast high, actual low, actual high)
CATEGORY_PROFILES = (
    ("A", "機械部品", 150, 500, 5000, 50, 300, 100, 500, 0.7, 1.3, 0.9, 1.15, 0.85, 1.1),
    ("B", "電子部品", 120, 200, 8000, 200, 1000, 300, 1200, 0.8, 1.3, 1.2, 1.8, 0.5, 1.0),
    ("C", "素材・原料", 130, 100, 3000, 100, 500, 150, 600, 0.8, 1.2, 0.85, 1.2, 0.8, 1.15),
    ("D", "包装・梱包材", 100, 50, 1500, 30, 200, 50, 300, 0.9, 1.1, 0.9, 1.1, 0.88, 1.08),
)
GROWTH_CATEGORY = "B"
MONTHLY_GROWTH = 0.05
LONG_LEAD_DAYS = 30

# warehouses
WAREHOUSES = ("東京倉庫", "大阪倉庫", "名古屋倉庫", "福岡倉庫")

# Suppliers (id, name, lead time in days)
SUPPLIERS = (
    ("SUP-001", "東洋精密工業", 14),
    ("SUP-002", "グローバルパーツ", 21),
    ("SUP-003", "日本電子商事", 45),
    ("SUP-004", "アジア素材", 30),
    ("SUP-005", "中部金属", 10),
    ("SUP-006", "九州マテリアル", 18),
    ("SUP-007", "関東パッケージ", 7),
    ("SUP-008", "大阪部品", 25),
    ("SUP-009", "北海道工業", 35),
    ("SUP-010", "四国電子", 42),
    ("SUP-011", "信越精密", 12),
    ("SUP-012", "東北素材", 20),
)
