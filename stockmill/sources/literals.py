"""Hand-entered overstock and shortage rows."""

from datetime import date

from stockmill.schemas import OVERSTOCK_ENTRIES, STOCK_POSITION

_MONTH = date(2026, 2, 1)

# Overstock rows (item, name, category, category name, quantity, value,
# unit price, turnover, days on hand, recommended action)
OVERSTOCK_ROWS = (
    ("ITM-D0201", "電子部品_マイコンチップA", "B", "電子部品", 1850, 14_800_000, 8000, 1.2, 185, "販売促進または廃棄検討"),
    ("ITM-D0202", "電子部品_センサーモジュールB", "B", "電子部品", 2200, 13_200_000, 6000, 0.9, 220, "発注停止・在庫消化優先"),
    ("ITM-D0203", "電子部品_電源ICチップC", "B", "電子部品", 3100, 9_920_000, 3200, 0.8, 310, "発注停止・在庫消化優先"),
    ("ITM-D0204", "電子部品_パワートランジスタD", "B", "電子部品", 4500, 9_000_000, 2000, 1.1, 450, "販売促進または廃棄検討"),
    ("ITM-D0205", "電子部品_高精度コンデンサE", "B", "電子部品", 6200, 7_440_000, 1200, 0.7, 620, "発注停止・廃棄検討"),
    ("ITM-D0206", "電子部品_RF通信モジュールF", "B", "電子部品", 1100, 6_600_000, 6000, 1.5, 110, "需要予測見直し"),
    ("ITM-D0207", "電子部品_LEDドライバICG", "B", "電子部品", 2800, 5_600_000, 2000, 1.3, 280, "発注ロット縮小"),
    ("ITM-D0208", "電子部品_メモリチップH", "B", "電子部品", 1600, 6_400_000, 4000, 2.1, 160, "需要予測見直し"),
    ("ITM-D0209", "電子部品_水晶発振子I", "B", "電子部品", 8000, 4_800_000, 600, 0.6, 800, "発注停止・廃棄検討"),
    ("ITM-D0210", "電子部品_フォトカプラJ", "B", "電子部品", 5500, 4_400_000, 800, 1.8, 550, "発注ロット縮小"),
    ("ITM-D0211", "電子部品_マグネティックセンサK", "B", "電子部品", 2100, 6_300_000, 3000, 2.3, 210, "需要予測見直し"),
    ("ITM-D0212", "電子部品_熱電変換モジュールL", "B", "電子部品", 900, 5_400_000, 6000, 1.9, 90, "需要予測見直し"),
    ("ITM-D0213", "電子部品_デジタルポテンショM", "B", "電子部品", 3700, 3_700_000, 1000, 2.8, 370, "発注ロット縮小"),
    ("ITM-D0214", "電子部品_フラッシュメモリN", "B", "電子部品", 1300, 5_200_000, 4000, 3.1, 130, "需要予測見直し"),
    ("ITM-D0215", "電子部品_MPU加速度センサO", "B", "電子部品", 2600, 5_200_000, 2000, 2.6, 260, "発注ロット縮小"),
    ("ITM-D0101", "機械部品_精密ベアリングP", "A", "機械部品", 1200, 3_600_000, 3000, 3.5, 120, "季節需要見直し"),
    ("ITM-D0102", "機械部品_ステッピングモータQ", "A", "機械部品", 750, 2_625_000, 3500, 3.2, 95, "季節需要見直し"),
    ("ITM-D0301", "素材・原料_特殊合金粉末R", "C", "素材・原料", 4200, 2_100_000, 500, 3.0, 420, "一括調達を分割発注に見直し"),
)

# Stock positions (item, name, location, stock, required, lead time, status,
# category, category name)
SHORTAGE_ROWS = (
    ("ITM-S0001", "機械部品_特注モーターX", "東京倉庫", 100, 500, 45, "不足（来週分）", "A", "機械部品"),
    ("ITM-S0001", "機械部品_特注モーターX", "大阪倉庫", 600, 50, 45, "過剰（滞留中）", "A", "機械部品"),
    ("ITM-S0002", "電子部品_センサーY", "東京倉庫", 300, 200, 15, "適正", "B", "電子部品"),
    ("ITM-S0002", "電子部品_センサーY", "福岡倉庫", 50, 50, 15, "適正", "B", "電子部品"),
    ("ITM-S0003", "素材・原料_高強度樹脂Z", "名古屋倉庫", 1200, 1000, 30, "適正", "C", "素材・原料"),
    ("ITM-S0003", "素材・原料_高強度樹脂Z", "大阪倉庫", 1500, 1000, 30, "適正", "C", "素材・原料"),
)


def overstock_entries(spark):
    rows = [
        (item, name, code, label, _MONTH, float(qty), float(value), float(price), turn, days, todo)
        for item, name, code, label, qty, value, price, turn, days, todo in OVERSTOCK_ROWS
    ]
    return spark.createDataFrame(rows, OVERSTOCK_ENTRIES)


def shortage_entries(spark):
    return spark.createDataFrame(list(SHORTAGE_ROWS), STOCK_POSITION)
