"""Sun position, clear-sky irradiance and glare.

Small formulas are Columns; the longer models are DataFrame transforms that add
their intermediate terms as columns, so that no term is written out twice in
the generated code, and drop them again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import DEG, RAD, angle_between, clamp, col, rad

DAY_MS = 86400000

# Fixed values of the clear-sky and glare models.
SOLAR_CONSTANT_W_M2 = 1364.0
LUMINOUS_EFFICACY_LM_W = 93.0
ATMOSPHERE = {
    "ozone_cm": (0.30, 0.1, 0.8),
    "water_cm": (1.50, 0.1, 10.0),
    "aod380": (0.10, 0.001, 2.0),
    "aod500": (0.08, 0.001, 2.0),
    "asymmetry": (0.85, 0.0, 1.0),
    "albedo": (0.20, 0.0, 0.95),
}


def utc_date(ms) -> Column:
    """UTC calendar date of epoch milliseconds, whatever the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(ms) / DAY_MS).cast("int"))


def days_since_j2000(ms) -> Column:
    return col(ms) / F.lit(float(DAY_MS)) - F.lit(0.5) + F.lit(2440588.0) - F.lit(2451545.0)


def pressure_pa(elevation_m) -> Column:
    h = clamp(F.coalesce(col(elevation_m), F.lit(0.0)), -500.0, 9000.0)
    return 100.0 * F.pow((F.lit(44331.514) - h) / 11880.516, F.lit(1.0 / 0.1902632))


def extraterrestrial_w_m2(ms) -> Column:
    return SOLAR_CONSTANT_W_M2 * (1 + 0.033 * F.cos(F.lit(2 * math.pi) * F.dayofyear(utc_date(ms)) / 365.0))


def delta_t_seconds(ms) -> Column:
    year = F.year(utc_date(ms)) + (F.month(utc_date(ms)) - 0.5) / 12.0
    t = year - 2000.0
    return F.when(year.between(2005, 2050), 62.92 + 0.32217 * t + 0.005589 * t * t).otherwise(F.lit(69.0))


def relative_airmass(zenith_deg) -> Column:
    """NULL at or below the horizon."""
    z = col(zenith_deg)
    return F.when((z < 90) & (z >= 0), 1.0 / (F.cos(rad(z)) + 0.15 * F.pow(93.885 - z, F.lit(-1.253))))


def with_compact_sun(df: DataFrame, lat: str, lng: str, ms: str,
                     azimuth: str = "sun_azimuth", altitude: str = "sun_altitude") -> DataFrame:
    """Low-precision sun azimuth and altitude (degrees, no refraction)."""
    tilt = 23.4397 * RAD
    temp = ["_d", "_m", "_l", "_dec", "_ha"]
    out = df.withColumn("_d", days_since_j2000(ms))
    out = out.withColumn("_m", F.lit(RAD) * (357.5291 + 0.98560028 * F.col("_d")))
    out = out.withColumn("_l", F.col("_m") + F.lit(RAD) * (
        1.9148 * F.sin("_m") + 0.02 * F.sin(2 * F.col("_m")) + 0.0003 * F.sin(3 * F.col("_m")))
        + F.lit(102.9372 * RAD + math.pi))
    out = out.withColumn("_dec", F.asin(F.lit(math.sin(tilt)) * F.sin("_l")))
    out = out.withColumn("_ha", F.lit(RAD) * (280.16 + 360.9856235 * F.col("_d")) + rad(lng)
                         - F.atan2(F.sin("_l") * F.lit(math.cos(tilt)), F.cos("_l")))
    phi = rad(lat)
    out = out.withColumn(azimuth, (F.atan2(
        F.sin("_ha"), F.cos("_ha") * F.sin(phi) - F.tan("_dec") * F.cos(phi)) * DEG + 180.0) % F.lit(360.0))
    out = out.withColumn(altitude, F.asin(
        F.sin(phi) * F.sin("_dec") + F.cos(phi) * F.cos("_dec") * F.cos("_ha")) * DEG)
    return out.drop(*temp)


def with_day_times(df: DataFrame, day: str, lat: str, lng: str) -> DataFrame:
    """Sunrise, solar noon and sunset (epoch ms) of a UTC date.

    Coordinates are steadied to 0.01 degrees and times to whole minutes. Where
    the sun does not cross the horizon, sunrise and sunset fall back to 06:00
    and 19:30 and noon stays unrounded. Terms are added in the order of the SQL:
    a Julian date is exact to 40 microseconds only, enough to change a minute.
    """
    midnight = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS
    out = df.withColumn("_phi", rad(F.floor(col(lat) * 100 + 0.5) / 100.0))
    out = out.withColumn("_lw", -rad(F.floor(col(lng) * 100 + 0.5) / 100.0))
    out = out.withColumn("_mid", midnight.cast("long"))
    out = out.withColumn("_n", F.floor(days_since_j2000(F.col("_mid") + DAY_MS // 2) - 0.0009
                                       - F.col("_lw") / (2 * math.pi) + 0.5))
    out = out.withColumn("_ds", 0.0009 + F.col("_lw") / (2 * math.pi) + F.col("_n"))
    out = out.withColumn("_m", F.lit(RAD) * (357.5291 + 0.98560028 * F.col("_ds")))
    out = out.withColumn("_l", F.col("_m") + F.lit(RAD) * (
        1.9148 * F.sin("_m") + 0.02 * F.sin(2 * F.col("_m")) + 0.0003 * F.sin(3 * F.col("_m")))
        + F.lit(102.9372 * RAD) + F.lit(math.pi))
    out = out.withColumn("_dec", F.asin(F.lit(math.sin(23.4397 * RAD)) * F.sin("_l")))
    wobble = lambda jd: jd + 0.0053 * F.sin("_m") - 0.0069 * F.sin(2 * F.col("_l"))
    out = out.withColumn("_noon", wobble(F.lit(2451545.0) + F.col("_ds")))
    out = out.withColumn("_cosw", (F.lit(math.sin(-0.833 * RAD)) - F.sin("_phi") * F.sin("_dec"))
                         / (F.cos("_phi") * F.cos("_dec")))
    up = F.abs("_cosw") <= 1
    out = out.withColumn("_set", F.when(up, wobble(
        F.lit(2451545.0) + F.lit(0.0009) + (F.acos("_cosw") + F.col("_lw")) / (2 * math.pi) + F.col("_n"))))
    to_ms = lambda j: (j + 0.5 - 2440588.0) * float(DAY_MS)
    minute = lambda ms: (F.floor(ms / 60000.0 + 0.5) * 60000).cast("long")
    out = out.withColumn("sunrise_ms", F.when(up, minute(to_ms(2 * F.col("_noon") - F.col("_set"))))
                         .otherwise(F.col("_mid") + 6 * 3600000))
    out = out.withColumn("noon_ms", F.when(up, minute(to_ms(F.col("_noon"))))
                         .otherwise(F.floor(to_ms(F.col("_noon"))).cast("long")))
    out = out.withColumn("sunset_ms", F.when(up, minute(to_ms(F.col("_set"))))
                         .otherwise(F.col("_mid") + 39 * 1800000))
    return out.drop("_phi", "_lw", "_mid", "_n", "_ds", "_m", "_l", "_dec", "_noon", "_cosw", "_set")


def with_clear_sky(df: DataFrame, zenith: str | Column, ms: str, pressure: Column | None = None,
                   atmosphere: dict[str, str] | None = None) -> DataFrame:
    """Bird clear-sky dni, dhi, ghi and direct_horizontal in W/m2; 0 at night.

    ``atmosphere`` maps parameter names of ``ATMOSPHERE`` to columns; NULL takes
    the standard value and others are clamped to the accepted range.
    """
    chosen = atmosphere or {}

    def par(name: str) -> Column:
        default, low, high = ATMOSPHERE[name]
        if name not in chosen:
            return F.lit(default)
        return F.coalesce(clamp(chosen[name], low, high), F.lit(default))

    p = pressure_pa(F.lit(0.0)) if pressure is None else pressure
    before = set(df.columns)
    out = df.withColumn("_z", col(zenith))
    out = out.withColumn("_am", relative_airmass("_z"))
    out = out.withColumn("_amp", F.col("_am") * p / 101325.0)
    out = out.withColumn("_etr", extraterrestrial_w_m2(ms))
    out = out.withColumn("_cosz", F.greatest(F.lit(0.0), F.cos(rad("_z"))))
    out = out.withColumn("_xo", par("ozone_cm") * F.col("_am"))
    out = out.withColumn("_xw", par("water_cm") * F.col("_am"))
    out = out.withColumn("_tau", 0.27583 * par("aod380") + 0.35 * par("aod500"))
    a, x, w, tau = F.col("_amp"), F.col("_xo"), F.col("_xw"), F.col("_tau")
    power = lambda base, e: F.pow(base, F.lit(e))
    out = out.withColumn("_tr", F.exp(-0.0903 * power(a, 0.84) * (1 + a - power(a, 1.01))))
    out = out.withColumn("_to", 1 - 0.1611 * x * power(1 + 139.48 * x, -0.3034)
                         - 0.002715 * x / (1 + 0.044 * x + 0.0003 * x * x))
    out = out.withColumn("_tg", F.exp(-0.0127 * power(a, 0.26)))
    out = out.withColumn("_tw", 1 - 2.4959 * w / (power(1 + 79.034 * w, 0.6828) + 6.385 * w))
    out = out.withColumn("_ta", F.exp(-power(tau, 0.873) * (1 + tau - power(tau, 0.7088))
                                      * power(F.col("_am"), 0.9108)))
    out = out.withColumn("_taa", 1 - 0.1 * (1 - F.col("_am") + power(F.col("_am"), 1.06)) * (1 - F.col("_ta")))
    out = out.withColumn("_sc", 1 - F.col("_ta") / F.col("_taa"))
    out = out.withColumn("dni", F.coalesce(F.greatest(F.lit(0.0), 0.9662 * F.col("_etr") * F.col("_ta")
                         * F.col("_tw") * F.col("_tg") * F.col("_to") * F.col("_tr")), F.lit(0.0)))
    out = out.withColumn("direct_horizontal", F.col("dni") * F.coalesce(F.col("_cosz"), F.lit(0.0)))
    scattered = (F.col("_etr") * F.col("_cosz") * 0.79 * F.col("_to") * F.col("_tg") * F.col("_tw")
                 * F.col("_taa") * (0.5 * (1 - F.col("_tr")) + par("asymmetry") * F.col("_sc"))
                 / (1 - F.col("_am") + power(F.col("_am"), 1.02)))
    ground = 1 - par("albedo") * (0.0685 + (1 - par("asymmetry")) * F.col("_sc"))
    out = out.withColumn("ghi", F.coalesce(
        F.greatest(F.lit(0.0), (F.col("direct_horizontal") + scattered) / ground), F.lit(0.0)))
    out = out.withColumn("dhi", F.greatest(F.lit(0.0), F.col("ghi") - F.col("direct_horizontal")))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in before])


def sun_view_angle(heading, azimuth, altitude) -> Column:
    """Angle between driving direction and the sun; 180 when unknown."""
    cos_theta = F.cos(rad(altitude)) * F.cos(rad(angle_between(heading, azimuth)))
    return F.coalesce(F.acos(clamp(cos_theta, -1.0, 1.0)) * DEG, F.lit(180.0))


def glare_potential(theta, dni, altitude, occlusion=None) -> Column:
    """Disability glare mapped to 0..1. A NULL occlusion counts as none."""
    occ = F.lit(0.0) if occlusion is None else F.coalesce(clamp(occlusion, 0.0, 1.0), F.lit(0.0))
    eye_lux = col(dni) * LUMINOUS_EFFICACY_LM_W * F.greatest(F.lit(0.0), F.cos(rad(theta))) * (1 - occ)
    veil = 10.0 * eye_lux / F.pow(F.greatest(F.lit(1.0), col(theta)), 2)
    dark = (F.coalesce(col(dni), F.lit(0.0)) <= 0) | (occ >= 1) | (col(theta) >= 100) | (
        F.coalesce(col(altitude), F.lit(-90.0)) <= 0)
    return F.when(dark, F.lit(0.0)).otherwise(1 - F.exp(-veil / 1000.0))


def direct_exposure(direct_horizontal, occlusion=None) -> Column:
    occ = F.lit(0.0) if occlusion is None else F.coalesce(clamp(occlusion, 0.0, 1.0), F.lit(0.0))
    return clamp(F.coalesce(col(direct_horizontal), F.lit(0.0)) * (1 - occ) / 1000.0, 0.0, 1.5)


def shade_potential(heading, azimuth, altitude) -> Column:
    """Heuristic share of lateral shade, by height of the sun; 0.5 if unknown."""
    side = F.abs(F.sin(rad(angle_between(heading, azimuth))))
    alt = col(altitude)
    return (F.when(alt.isNull() | col(azimuth).isNull(), 0.5)
            .when(alt <= -6.0, 1.0).when(alt <= -0.833, 0.85)
            .when(alt < 25, 0.35 + side * 0.50)
            .when(alt < 55, 0.22 + side * 0.42)
            .otherwise(0.18 + side * 0.38))


def geometric_intensity(altitude) -> Column:
    """0..1 fallback where no irradiance model is wanted."""
    alt = F.coalesce(col(altitude), F.lit(0.0))
    return F.when(alt > 0, clamp(F.sin(rad(alt)), 0.0, 1.0)).otherwise(F.lit(0.0))


def geometric_exposure(intensity, occlusion=None) -> Column:
    occ = F.lit(0.0) if occlusion is None else F.coalesce(clamp(occlusion, 0.0, 1.0), F.lit(0.0))
    return clamp(F.coalesce(col(intensity), F.lit(0.0)), 0.0, 1.0) * (1 - occ)


def geometric_glare(heading, azimuth, altitude) -> Column:
    diff = angle_between(heading, azimuth)
    value = F.greatest(F.lit(0.0), F.cos(rad(diff)) * F.cos(rad(altitude)))
    return F.when((col(altitude) > 0) & (diff < 90), value).otherwise(F.lit(0.0))


def compass_label(azimuth) -> Column:
    az = F.floor(col(azimuth) + 0.5)
    label = F.lit("N")
    # Eight compass points, 45 degrees each.
    for i, name in enumerate(["NE", "E", "SE", "S", "SW", "W", "NW"]):
        low = 22.5 + 45 * i
        label = F.when((az >= low) & (az < low + 45), name).otherwise(label)
    return label


def local_to_utc_ms(year, month, day, hour, offset_hours) -> Column:
    """Local wall clock with a fixed UTC offset to epoch milliseconds."""
    days = F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date"))
    return (days.cast("long") * DAY_MS + (hour - offset_hours) * 3600000).cast("long")
