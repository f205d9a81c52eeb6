"""Fixed values and small configuration maps."""

# Civil time zone, market clock and label convention per market region.
CIVIL_ZONE = {
    "NSW1": "Australia/Sydney",
    "QLD1": "Australia/Brisbane",
    "VIC1": "Australia/Melbourne",
    "SA1": "Australia/Adelaide",
    "TAS1": "Australia/Hobart",
    "WA": "Australia/Perth",
}
MARKET_ZONE = {
    "NSW1": "Etc/GMT-10",
    "QLD1": "Etc/GMT-10",
    "VIC1": "Etc/GMT-10",
    "SA1": "Etc/GMT-10",
    "TAS1": "Etc/GMT-10",
    "WA": "Etc/GMT-8",
}
LABEL = {
    "NSW1": "ending",
    "QLD1": "ending",
    "VIC1": "ending",
    "SA1": "ending",
    "TAS1": "ending",
    "WA": "beginning",
}

# Grid, thresholds and horizon parameters.
STEP_MINUTES = 30
DAY = 48
WARMUP = 14 * DAY
SHORT_GAP = 2
IQR_K = 3.0
MAD_SCALE = 1.4826
SMAPE_FLOOR = 1.0
TIE_TOLERANCE = 0.01
RAIN_DAY_MM = 0.2

#: Our own; nothing depends on which it is.
SEED = 17

# Feature names of the core set (39) and the weather set (15 more).
LAGS = {"lag_48": 48, "lag_96": 96, "lag_336": 336}
CALENDAR = [
    "half_hour_index", "hour", "day_of_week", "day_of_month", "week_of_year",
    "month", "quarter", "day_of_year", "is_weekend",
    "sin_half_hour", "cos_half_hour", "sin_day_of_week", "cos_day_of_week",
    "sin_month", "cos_month", "sin_day_of_year", "cos_day_of_year",
]
HOLIDAY = ["is_public_holiday", "is_day_before_holiday", "is_day_after_holiday"]
PROFILE = [
    "historical_month_halfhour_mean", "historical_month_halfhour_median",
    "historical_month_dow_halfhour_mean", "historical_month_daily_mean",
    "historical_month_peak_mean", "historical_month_variability",
]
DEMAND = [
    "previous_day_mean", "previous_day_peak", "previous_day_min",
    "same_half_hour_7day_mean", "same_half_hour_14day_mean",
    "rolling_mean_24h_at_t_minus_48", "rolling_std_24h_at_t_minus_48",
]
TREND = ["time_index", "days_since_start", "year"]
WEATHER_INPUT = [
    "weather_temp_c", "weather_humidity_pct", "weather_daily_temp_max_c",
    "weather_daily_temp_min_c", "weather_daily_temp_mean_c", "weather_daily_rainfall_mm",
]
WEATHER_CONTEXT = [
    "temp_mean_lag_1d", "temp_mean_lag_7d", "rolling_temp_mean_7d",
    "expected_temp_climatology", "historical_rain_probability",
    "hdd_lag_1d", "cdd_lag_1d", "expected_hdd_climatology", "expected_cdd_climatology",
]
FEATURES_A = list(LAGS) + CALENDAR + HOLIDAY + PROFILE + DEMAND + TREND
FEATURES_B = FEATURES_A + WEATHER_INPUT + WEATHER_CONTEXT

# Name patterns never allowed as predictors.
UNSAFE_PATTERNS = [
    "aemo", "predispatch", "pre_dispatch", "marketrequirement",
    "^temp_mean_c$", "^temp_max_c$", "^temp_min_c$", "^rainfall_mm$",
    "^humidity_pct$", "^temp_halfhourly_c$", "^hdd$", "^cdd$",
]

# Model names in evaluation order, with their complexity rank.
MODEL_ORDER = ["Naive48", "Naive336", "RandomForest_A", "RandomForest_B",
               "XGBoost_A", "XGBoost_B", "SARIMA", "SARIMAX"]
COMPLEXITY = {"Naive48": 0, "Naive336": 0, "SARIMA": 2, "SARIMAX": 3,
              "RandomForest_A": 4, "XGBoost_A": 4, "RandomForest_B": 5, "XGBoost_B": 5}
NAIVE_LAG = {"Naive48": 48, "Naive336": 336}

# Lead bands of a four-month horizon, as [from, to) half-hour steps.
LEAD_BANDS = [("first_7d", 0, 336), ("days_8_30", 336, 1440), ("month_2", 1440, 2928),
              ("month_3", 2928, 4416), ("month_4", 4416, None)]
