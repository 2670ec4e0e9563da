"""Default parameters.  Operators take such dicts as arguments; nothing reads these behind their back."""

from __future__ import annotations

HOUR = 3600
DAY = 24 * HOUR

# Fixed values of the ruleset: they decide the results, so they stand here as plain text.
STABILITY = {"hours": 72, "min_coverage": 0.8, "pressure_full": 12.0, "temp_full": 14.0, "day_pressure_max": 4.0, "day_temp_max": 8.0, "days": 7, "ideal_days": 2.0}
NORM = {"min_samples": 8760, "window_days": 1095, "step_days": 30}
WATER = {"tau_days_per_m": 0.9, "air_weight": 1.0, "sun_gain": 2.5, "evaporation": 0.10, "wind_ref": 8.0, "wind_cap": 2.0, "below_min": 6.0, "above_max": 4.0, "hours": 72, "min_coverage": 0.8, "depth_m": 2.9}
ENSEMBLE = {"tau": (0.6, 1.0, 1.6), "sun": (0.5, 1.0, 1.5), "evaporation": (0.5, 1.0, 1.5)}
OXYGEN = {"saturation": (14.652, -0.41022, 0.007991, -0.000077774), "wind_ref": 6.0, "max_boost": 0.35, "r20": 2.0, "q10": 2.3, "stops": None, "good": None, "provisional_stops": 5.0, "provisional_good": 8.5, "fetch": 0.5}
SPECIES = {"roach": 26.8, "bream": 27.9, "crucian": 27.0, "carp": 26.0, "rudd": 24.0, "ide": 20.0}
T_ZERO = 4.0
BITE = {"comfort_width": 14.0, "approach_full": 6.0, "w_approach": 0.25, "blend": 0.35, "stability_floor": 0.55}
CONFIDENCE = {"base": 0.25, "stability": 0.45, "days": 0.20, "coverage": 0.10, "heat_penalty": 0.35}
ZONE = {"weights": {"w_o2": 0.45, "w_temp": 0.30, "w_food": 0.15, "w_margin": 0.10, "w_exposure": 0.25}, "overrides": {"commercial": {"w_food": 0.05, "w_exposure": 0.10, "w_margin": 0.25}}, "t_dir_full": 2.0, "dead_spread": 0.02, "gate_floor": 0.45}
FALLBACK = {
    "margin_m": 25.0,
    "max_fetch_m": 400.0,
    "default": "summer_stagnation",
    "phases": {
        "spring_warming": {"w_fetch": -0.5, "w_margin": 1.0, "w_shelter": 0.7, "w_lee": 0.1},
        "summer_stagnation": {"w_fetch": 0.3, "w_margin": 0.25, "w_shelter": -0.35, "w_lee": 1.0},
        "autumn_cooling": {"w_fetch": 0.25, "w_margin": 0.45, "w_shelter": 0.05, "w_lee": 0.8},
    },
}
RIVER = {"w_bend": 0.6, "w_wind_cross": 0.4}
PHASE = {"warming": 0.15, "cooling": -0.15}
MONTH_PHASES = {3: "spring_warming", 4: "spring_warming", 5: "spring_warming", 6: "summer_stagnation", 7: "summer_stagnation", 8: "summer_stagnation", 9: "autumn_cooling", 10: "autumn_cooling", 11: "autumn_cooling"}
MONTH_DEFAULT = "summer_stagnation"
#: Ordered: the first predicate that holds names the regime.
REGIMES = {
    "falling_fast": "dp_6h <= -3.0",
    "falling_slow": "dp_6h < -0.7 and dp_6h > -3.0",
    "stable": "abs(dp_6h) <= 0.7 and stability_48h < 2.0",
    "rising_slow": "dp_6h > 0.7 and dp_6h < 3.0",
    "rising_fast": "dp_6h >= 3.0",
}
DAY_SCORE = {"w_pressure": 0.6, "w_light": 0.4, "light": 1.0, "go": 5.5, "regimes": {"falling_slow": 1.0, "stable": 0.6, "falling_fast": 0.3, "rising_slow": 0.4, "rising_fast": -0.5}, "bands": ((3.5, "red"), (5.5, "orange"), (7.5, "yellow"), (None, "green")), "window_hours": 2}
