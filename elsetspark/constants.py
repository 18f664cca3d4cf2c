"""Fixed values that define results (WGS-72, detector, benchmark)."""

MU, EARTH_RADIUS, J2 = 398600.8, 6378.135, 1.082616e-3
US_PER_DAY = 86_400_000_000
WINDOW, THRESHOLD, ALPHA, BETA, RADIAL_FACTOR, REVERT = 4, 6.0, 0.5, 0.1, 0.6, 0.5
DT_FLOOR_DAYS, SCALE_FLOOR, ECC_CLAMP, MAD = 1 / 1440, 1e-12, 0.999999, 1.4826
DETREND_HALFWIDTH, DT_CAP, PERIODS, TOKENS, STRIDE = 10, 2.5, (1, 2, 4, 8), 64, 32
TYPES = ("in-track", "cross-track", "radial")
ORBIT_CLASSES = ("LEO", "MEO", "GEO", "IGSO", "HEO")
CLASS_FLOOR = {"LEO": 0.01, "MEO": 0.03, "GEO": 0.10, "IGSO": 0.10, "HEO": 0.05}
LEO_BELOW, GEO_FROM = 8378.0, 35000.0
OPERATING_POINT, SWEEP, CI_LEVEL = 1.0, (0.3, 1.0, 3.0), 0.95
ERA_QUANTILES, GUARD_DAYS, RATIOS = (0.70, 0.85), 7, (0.70, 0.15, 0.15)
SYNC_REV_PER_DAY = 86400 / 86164.0905
GEO_DRIFT_FLOOR, GEO_INCL_FLOOR, HEO_SMA_FLOOR, HEO_ECC_FLOOR, SELF_SIGMA = 0.005, 0.005, 1.0, 1e-4, 6.0
BIN_EDGES = tuple(i * 0.1 for i in range(11))
