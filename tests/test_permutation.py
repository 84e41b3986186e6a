"""Mixing is a permutation; the feature a score rests on is the one that counts."""

import pytest
from pyspark.sql import functions as F

from farebox.models import permutation
from farebox.models.features import FEATURES

SCHEMA = (
    "fk_contact string, recency int, frequency long, monetary double, days_until_next_purchase int, "
    "will_buy_next_7_days int, will_buy_next_15_days int, will_buy_next_30_days int, purchases long"
)


@pytest.fixture(scope="module")
def planted(spark):
    """Those with a frequency above 300 come back; a third of the rows are one customer's."""
    rows = [
        ("hot" if i % 3 == 0 else f"c{i}", i % 7, i, 10.0 * (i % 11), i, *[int(i > 300)] * 3, 1 + i % 2)
        for i in range(600)
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_frequency(frame):
    return frame.withColumns({f"prob_{h}": F.when(F.col("frequency") > 300, 0.9).otherwise(0.1) for h in (7, 15, 30)})


def test_every_value_is_given_once(planted):
    mixed = permutation.with_mixed_features(planted).collect()
    assert len(mixed) == 600
    for feature in FEATURES:
        assert sorted(r[f"mixed_{feature}"] for r in mixed) == sorted(r[feature] for r in mixed)
    assert sum(r.mixed_frequency == r.frequency for r in mixed) < 15
    away = [abs(r.mixed_frequency - r.frequency) for r in mixed]
    assert 170 < sum(away) / 600 < 230  # 200 for a uniform permutation


def test_mixing_does_not_depend_on_the_layout(planted):
    key = lambda r: (r.fk_contact, r.days_until_next_purchase)
    one, other = (sorted(permutation.with_mixed_features(planted.repartition(n)).collect(), key=key) for n in (1, 13))
    assert one == other


def test_only_the_used_feature_counts(planted):
    found = permutation.permutation_importance(planted, by_frequency).collect()
    assert {(r.horizon_days, r.feature) for r in found} == {(h, f) for h in (7, 15, 30) for f in FEATURES}
    for r in found:
        if r.feature == "frequency":
            assert 0.4 < r.auc_drop < 0.6 and r.f1_drop > 0.4 and r.rmse_rise > 0.4
        else:
            assert (r.auc, r.auc_drop, r.f1_drop, r.rmse_rise) == (1.0, 0.0, 0.0, 0.0)


def test_no_rows(planted):
    assert permutation.permutation_importance(planted.where("false"), by_frequency).count() == 0
