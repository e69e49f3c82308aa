"""Golden replay: published scenario results re-priced by the rules.

Inputs (market price, cost, market levels) and expected outputs (price,
discount, strategy) are values copied from the published scenario results:
4 rows per category, covering the viability, high-cost and normal branches.
"""

import pytest

from pricelens import settings as S
from pricelens.operators import pricing as G

# (category, market price, cost, saturation, brand, expected price, expected discount, expected strategy)
GOLDEN = [
    ('Audio', 4296.30615234375, 4120.88, 'medium', 'medium', 4528.43956043956, 5.403092793309793, 'Cost Reconsideration Required'),
    ('Audio', 4296.30615234375, 5219.77, 'medium', 'medium', 5736.010989010989, 33.51029432299282, 'Cost Reconsideration Required'),
    ('Audio', 4296.30615234375, 3846.15, 'low', 'medium', 4437.865384615385, 3.294905606166134, 'Premium Cost Recovery'),
    ('Audio', 4296.30615234375, 3846.15, 'high', 'medium', 4437.865384615385, 3.294905606166134, 'Premium Cost Recovery'),
    ('Cameras', 2009.9683593749999, 2076.2, 'medium', 'medium', 2232.47311827957, 11.07006276326449, 'Cost Reconsideration Required'),
    ('Cameras', 2009.9683593749999, 2595.25, 'medium', 'medium', 2790.5913978494627, 38.83757845408063, 'Cost Reconsideration Required'),
    ('Cameras', 2009.9683593749999, 1816.67, 'low', 'medium', 2051.079032258065, 2.0453393055325826, 'Premium Cost Recovery'),
    ('Cameras', 2009.9683593749999, 1816.67, 'high', 'medium', 2051.079032258065, 2.0453393055325826, 'Premium Cost Recovery'),
    ('Climate Control', 3787.3025390625, 3936.8, 'medium', 'medium', 4188.08510638298, 10.582269654636267, 'Cost Reconsideration Required'),
    ('Climate Control', 3792.3966796874997, 4921.0, 'medium', 'medium', 5235.106382978724, 38.04216238819473, 'Cost Reconsideration Required'),
    ('Climate Control', 3787.3025390625, 3444.7, 'low', 'medium', 3847.803191489362, 1.5974602451970514, 'Premium Cost Recovery'),
    ('Climate Control', 3787.3025390625, 3444.7, 'high', 'medium', 3847.803191489362, 1.5974602451970514, 'Premium Cost Recovery'),
    ('Computers', 1525.047509765625, 1631.8, 'medium', 'medium', 1735.9574468085107, 13.829728955480162, 'Cost Reconsideration Required'),
    ('Computers', 1525.047509765625, 2039.75, 'medium', 'medium', 2169.946808510638, 42.28716119435019, 'Cost Reconsideration Required'),
    ('Computers', 1525.047509765625, 1427.82, 'low', 'medium', 1594.9053191489363, 4.580697252772632, 'Premium Cost Recovery'),
    ('Computers', 1525.047509765625, 1427.82, 'high', 'medium', 1594.9053191489363, 4.580697252772632, 'Premium Cost Recovery'),
    ('Home Entertainment', 2473.050402832031, 2400.84, 'medium', 'medium', 2638.285714285714, 6.681437275377113, 'Cost Reconsideration Required'),
    ('Home Entertainment', 2473.050402832031, 3041.07, 'medium', 'medium', 3341.835164835165, 35.13008715909061, 'Cost Reconsideration Required'),
    ('Home Entertainment', 2473.050402832031, 2240.79, 'low', 'medium', 2585.526923076923, 4.548088470663146, 'Premium Cost Recovery'),
    ('Home Entertainment', 2473.050402832031, 2240.79, 'high', 'medium', 2585.526923076923, 4.548088470663146, 'Premium Cost Recovery'),
    ('Home Improvement', 976.8427734375, 967.12, 'medium', 'medium', 1039.9139784946237, 6.456638342645131, 'Cost Reconsideration Required'),
    ('Home Improvement', 976.8427734375, 1225.02, 'medium', 'medium', 1317.225806451613, 34.84522200193061, 'Cost Reconsideration Required'),
    ('Home Improvement', 976.8427734375, 902.65, 'low', 'medium', 1019.1209677419356, 4.328044947874165, 'Premium Cost Recovery'),
    ('Home Improvement', 976.8427734375, 902.65, 'high', 'medium', 1019.1209677419356, 4.328044947874165, 'Premium Cost Recovery'),
    ('Home Office', 2996.96025390625, 2879.25, 'medium', 'medium', 3095.967741935484, 3.3035969662990134, 'Cost Reconsideration Required'),
    ('Home Office', 2996.96025390625, 3647.05, 'medium', 'medium', 3921.5591397849466, 30.851222823978762, 'Cost Reconsideration Required'),
    ('Home Office', 2996.96025390625, 2687.3, 'low', 'medium', 3034.0483870967746, 1.237525026973046, 'Premium Cost Recovery'),
    ('Home Office', 2996.96025390625, 2687.3, 'high', 'medium', 3034.0483870967746, 1.237525026973046, 'Premium Cost Recovery'),
    ('Kitchen Appliances', 1406.085205078125, 1530.21, 'medium', 'medium', 1610.7473684210527, 14.555459555635977, 'Cost Reconsideration Required'),
    ('Kitchen Appliances', 1406.085205078125, 1890.26, 'medium', 'medium', 1989.7473684210527, 41.50972937024099, 'Cost Reconsideration Required'),
    ('Kitchen Appliances', 1406.085205078125, 1260.17, 'low', 'medium', 1265.4766845703125, 10.0, 'Thin-Margin Volume Strategy'),
    ('Kitchen Appliances', 1406.085205078125, 1260.17, 'high', 'medium', 1369.75, 2.584139634418964, 'Thin-Margin Volume Strategy'),
    ('Mobile Accessories', 561.6075439453125, 575.88, 'medium', 'medium', 629.86875, 12.15460988560626, 'Premium Cost Recovery'),
    ('Mobile Accessories', 561.6075439453125, 711.38, 'medium', 'medium', 741.0208333333334, 31.946381654284107, 'Cost Reconsideration Required'),
    ('Mobile Accessories', 561.6075439453125, 474.25, 'low', 'medium', 505.44678955078126, 9.999999999999998, 'Thin-Margin Volume Strategy'),
    ('Mobile Accessories', 561.6075439453125, 474.25, 'high', 'medium', 509.94623655913983, 9.19882717800587, 'Thin-Margin Volume Strategy'),
    ('Smartwatches', 1946.661932373047, 2168.1, 'medium', 'medium', 2346.9123711340208, 20.560860214339062, 'Premium Cost Recovery'),
    ('Smartwatches', 1946.661932373047, 2770.35, 'medium', 'medium', 2856.0309278350514, 46.71427433490996, 'Cost Reconsideration Required'),
    ('Smartwatches', 1946.661932373047, 1686.3, 'low', 'medium', 1751.9957391357423, 10.0, 'Thin-Margin Volume Strategy'),
    ('Smartwatches', 1946.661932373047, 1686.3, 'high', 'medium', 1775.0526315789475, 8.815567713131468, 'Thin-Margin Volume Strategy'),
]


def test_golden_replay(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN],
                               "category string, predicted_market_price double, manufacturing_cost double, "
                               "market_saturation string, brand_strength string")
    out = G.recommend(df, S.settings_table(spark)).collect()
    got = sorted((r.category, r.predicted_market_price, r.manufacturing_cost, r.market_saturation,
                  r.recommended_price, r.discount_from_market, r.strategy) for r in out)
    exp = sorted((g[0], g[1], g[2], g[3], g[5], g[6], g[7]) for g in GOLDEN)
    assert len(got) == len(exp)
    for a, b in zip(got, exp):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == b[6]
