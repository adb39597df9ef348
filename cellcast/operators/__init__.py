"""DataFrame operators (lookups, calibration, cascades, as-of, lags, features,
blends, metrics, profiles, models)."""
