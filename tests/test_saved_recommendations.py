"""Replay of published saved recommendations through the stats-file source
and the rules (G7-G16), comparing every output field.

Values are copied from the published recommendation files (those written by
the current per-category rules) and from the published nested statistics
file (discounted-price quartiles; counts there are strings).
"""

import json
import os
import tempfile

import pytest

from pricelens import settings as S
from pricelens.operators import pricing as G
from pricelens.sources import io as A

# category: (Q1, Q3) of discounted_price in the published statistics file
QUARTILES = {
    'Audio': (999.0, 9990.0),
    'Cameras': (499.0, 4691.5),
    'Climate Control': (880.0, 8962.0),
    'Home Improvement': (310.0, 2269.0),
    'Kitchen Appliances': (554.5, 3046.0),
    'Mobile Accessories': (266.0, 1089.0),
    'Smartwatches': (319.0, 4499.0),
}

FIELDS = ["recommended_price", "min_competitive_price", "max_competitive_price", "minimum_viable_price",
          "profit_margin_percentage", "discount_from_market", "price_elasticity", "estimated_sales_impact",
          "strategy", "market_position_percentile", "viability_issue", "high_cost_warning", "recommended_max_cost"]

# (category, market price, cost, saturation, brand) + FIELDS
SAVED = [
    ('Audio', 1278.0879974365234, 500.0, 'high', 'low', 830.7571983337402, 830.7571983337402, 958.5659980773926, 568.1818181818181, 39.813943110832376, 35.0, -1.5, 52.5, 'Deep Discount Strategy', 20.78971967802153, None, None, None),
    ('Audio', 2263.04443359375, 1000.0, 'medium', 'medium', 1697.2833251953125, 1697.2833251953125, 1923.5877685546875, 1136.3636363636363, 41.08231753912233, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 28.88323504168231, None, None, None),
    ('Audio', 330.35152435302734, 100.0, 'medium', 'medium', 247.7636432647705, 247.7636432647705, 280.79879570007324, 113.63636363636364, 59.63895320463307, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 6.200291372992255, None, None, None),
    ('Audio', 170.15474319458008, 100.0, 'medium', 'medium', 127.61605739593506, 127.61605739593506, 144.63153171539307, 113.63636363636364, 21.63995500210047, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 3.193595029928305, None, None, None),
    ('Kitchen Appliances', 145.4770477294922, 100.0, 'medium', 'medium', 109.10778579711915, 109.10778579711915, 123.65549057006837, 108.69565217391303, 8.347512260999094, 25.0, -1.5, 37.5, 'Thin-Margin Volume Strategy', 4.9191968348565895, None, None, None),
    ('Home Improvement', 287.21629028320314, 300.0, 'high', 'high', 322.58064516129036, 258.4946612548828, 287.21629028320314, 322.58064516129036, 7.000000000000001, 12.312795643734901, -1.2, -15.0, 'Cost Reconsideration Required', None, True, None, 229.7730322265625),
    ('Cameras', 373.4186645507812, 300.0, 'high', 'high', 317.40586486816403, 280.0639984130859, 317.40586486816403, 333.3333333333333, 5.483788043864166, 15.0, -1.5, 22.5, 'Thin-Margin Volume Strategy', 15.902097438284772, None, None, None),
    ('Climate Control', 375.53477783203124, 150.0, 'medium', 'medium', 281.6510833740234, 281.6510833740234, 319.2045611572265, 164.83516483516482, 46.742615649447046, 25.000000000000007, -1.5, 37.500000000000014, 'Aggressive Market Entry', 8.001451232216574, None, None, None),
    ('Climate Control', 791.46767578125, 400.0, 'medium', 'medium', 593.6007568359375, 593.6007568359375, 672.7475244140625, 439.56043956043953, 32.61464117193603, 24.999999999999996, -1.5, 37.49999999999999, 'Value-Oriented Strategy', 16.863657864657316, None, None, None),
    ('Kitchen Appliances', 653.39677734375, 400.0, 'high', 'high', 490.04758300781253, 490.04758300781253, 555.3872607421876, 434.78260869565213, 18.37527336735726, 25.0, -1.5, 37.5, 'Deep Discount Strategy', 22.09412006347216, None, None, None),
    ('Kitchen Appliances', 1094.2788452148438, 660.0, 'high', 'high', 820.7091339111329, 820.7091339111329, 930.1370184326172, 717.391304347826, 19.58174062779891, 25.0, -1.5, 37.5, 'Deep Discount Strategy', 30.342346656855966, None, None, None),
    ('Audio', 302.39418029785156, 100.0, 'medium', 'medium', 226.79563522338867, 226.79563522338867, 257.0350532531738, 113.63636363636364, 55.90744067825546, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 5.675566447031748, None, None, None),
    ('Cameras', 5766.18515625, 50000.0, 'medium', 'medium', 53763.44086021506, 5189.566640625, 5766.18515625, 53763.44086021506, 7.000000000000001, 832.3918570658552, -1.2, -15.0, 'Cost Reconsideration Required', None, True, None, 4901.2573828125),
    ('Climate Control', 7281.9041015625, 5000.0, 'medium', 'medium', 5494.505494505494, 5461.428076171875, 6189.618486328125, 5494.505494505494, 8.999999999999998, 24.54575866597142, -1.5, 36.81863799895713, 'Thin-Margin Volume Strategy', 53.54804191107086, None, None, None),
    ('Cameras', 5766.18515625, 10000.0, 'high', 'high', 10752.688172043012, 5189.566640625, 5766.18515625, 10752.688172043012, 7.000000000000001, 86.47837141317105, -1.2, -15.0, 'Cost Reconsideration Required', None, True, None, 4901.2573828125),
    ('Smartwatches', 7473.144287109375, 3500.0, 'medium', 'medium', 5604.858215332031, 5604.858215332031, 6352.172644042968, 3684.2105263157896, 37.55417415509662, 25.0, -1.5, 37.5, 'Premium Brand Position', 81.61398454145952, None, None, None),
    ('Smartwatches', 2347.9561157226562, 890.0, 'high', 'medium', 1643.5692810058592, 1643.5692810058592, 1878.3648925781251, 936.8421052631579, 45.84955983995255, 30.000000000000004, -1.5, 45.00000000000001, 'Premium Brand Position', 40.84413015557248, None, None, None),
    ('Smartwatches', 2584.074353027344, 1200.0, 'low', 'medium', 2067.2594824218754, 2067.2594824218754, 2325.6669177246094, 1263.157894736842, 41.952134688280495, 19.99999999999999, -1.5, 29.999999999999986, 'Premium Brand Position', 45.912194765811904, None, None, None),
    ('Smartwatches', 3361.359155273438, 1850.0, 'medium', 'medium', 2521.0193664550784, 2521.0193664550784, 2857.155281982422, 1947.3684210526317, 26.616985786929103, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 51.339944574821516, None, None, None),
    ('Mobile Accessories', 1129.47333984375, 350.0, 'high', 'medium', 790.6313378906249, 790.6313378906249, 903.578671875, 376.3440860215054, 55.73158016556907, 30.00000000000001, -1.5, 45.000000000000014, 'High-Volume Entry Strategy', 56.873106797729335, None, None, None),
    ('Mobile Accessories', 1499.6501953125, 980.0, 'medium', 'medium', 1124.737646484375, 1124.737646484375, 1274.702666015625, 1053.763440860215, 12.868569567026206, 24.999999999999996, -1.5, 37.49999999999999, 'High-Volume Entry Strategy', 76.08559071945247, None, None, None),
    ('Mobile Accessories', 627.719677734375, 180.0, 'medium', 'medium', 470.7897583007812, 470.7897583007812, 533.5617260742187, 193.5483870967742, 61.76637303035797, 25.0, -1.5, 37.5, 'High-Volume Entry Strategy', 37.44166210818841, None, None, None),
    ('Mobile Accessories', 627.719677734375, 120.0, 'high', 'medium', 439.40377441406247, 439.40377441406247, 502.17574218749996, 129.03225806451613, 72.69026645025569, 30.0, -1.5, 45.0, 'High-Volume Entry Strategy', 35.534858712883505, None, None, None),
    ('Audio', 7354.0631103515625, 4200.0, 'medium', 'medium', 5515.547332763672, 5515.547332763672, 6250.953643798828, 4772.727272727273, 23.85161894902081, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 50.11704667313798, None, None, None),
    ('Audio', 2953.9047241210938, 1250.0, 'high', 'medium', 2067.7333068847656, 2067.7333068847656, 2363.123779296875, 1420.4545454545455, 39.54732963685523, 30.0, -1.5, 45.0, 'Deep Discount Strategy', 30.943350611082003, None, None, None),
    ('Audio', 3415.1431274414062, 1800.0, 'medium', 'medium', 2561.3573455810547, 2561.3573455810547, 2902.8716583251953, 2045.4545454545455, 29.724760853637843, 25.0, -1.5, 37.5, 'Aggressive Market Entry', 33.68845148248835, None, None, None),
    ('Audio', 1430.2485656738281, 450.0, 'low', 'medium', 1144.1988525390625, 1144.1988525390625, 1287.2237091064453, 511.3636363636364, 60.67117188577698, 20.0, -1.5, 30.0, 'Value-Oriented Strategy', 25.807467759643323, None, None, None),
    ('Audio', 1127.3623657226562, 500.0, 'high', 'low', 732.7855377197266, 732.7855377197266, 845.5217742919922, 568.1818181818181, 31.767212333925947, 35.0, -1.5, 52.5, 'Deep Discount Strategy', 18.337976419412577, None, None, None),
    ('Audio', 330.35152435302734, 100.0, 'high', 'low', 214.72849082946777, 214.72849082946777, 247.7636432647705, 113.63636363636364, 53.42956138996124, 35.0, -1.5, 52.5, 'Deep Discount Strategy', 5.373585856593287, None, None, None),
    ('Smartwatches', 1695.8849670410157, 810.0, 'medium', 'medium', 1271.9137252807618, 1271.9137252807618, 1441.5022219848634, 852.6315789473684, 36.31643531315767, 24.999999999999996, -1.5, 37.49999999999999, 'Premium Brand Position', 36.398489536851216, None, None, None),
]


def test_saved_recommendations_replay(spark):
    d = tempfile.mkdtemp(prefix="stats-")
    doc = {c: {"discounted_price": {"Q1": q1, "Q3": q3, "IQR": q3 - q1, "lower_bound": 0,
                                    "upper_bound": q3 + 1.5 * (q3 - q1), "outliers_lower": "0",
                                    "outliers_upper": "1"}} for c, (q1, q3) in QUARTILES.items()}
    with open(os.path.join(d, "outlier_stats.json"), "w") as f:
        json.dump(doc, f, indent=4)
    stats = A.price_stats_wide(A.read_price_stats_json(spark, d))
    req = spark.createDataFrame([s[:5] for s in SAVED], "category string, predicted_market_price double, "
                                "manufacturing_cost double, market_saturation string, brand_strength string")
    got = {(r.category, r.predicted_market_price, r.manufacturing_cost, r.market_saturation, r.brand_strength): r
           for r in G.recommend(req, S.settings_table(spark), stats).collect()}
    for s in SAVED:
        r = got[s[:5]]
        for name, want in zip(FIELDS, s[5:]):
            have = r[name]
            if isinstance(want, float):
                assert have == pytest.approx(want, rel=1e-9, abs=1e-9), (s[:5], name)
            else:
                assert have == want, (s[:5], name, have, want)
