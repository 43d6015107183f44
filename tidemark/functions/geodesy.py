"""Geodesy as column expressions: WGS84 ellipsoid, local horizon, longitudes, satellite bands, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid, speed of light, band frequencies in Hz.
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
LIGHT = 299_792_458.0
GPS_BANDS = {"1": 1_575.42e6, "2": 1_227.60e6, "5": 1_176.45e6}
GALILEO_BANDS = {"1": 1_575.42e6, "5": 1_176.45e6, "6": 1_278.75e6, "7": 1_207.14e6, "8": 1_191.795e6}
_E2 = WGS84_F * (2 - WGS84_F)


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 8) -> Column:
    """Struct (lat, lon, height) in degrees and metres; the latitude by fixed-point rounds, the poles apart.

    Each round shrinks the error some 150-fold, so eight leave it below what a double holds.
    """
    p = F.hypot(x, y)
    start = F.atan2(z, p * (1 - _E2))

    def improve(lat: Column, _: Column) -> Column:
        n = WGS84_A / F.sqrt(1 - _E2 * F.pow(F.sin(lat), 2))
        return F.atan2(z + _E2 * n * F.sin(lat), p)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve)
    n = WGS84_A / F.sqrt(1 - _E2 * F.pow(F.sin(lat), 2))
    b = WGS84_A * (1 - WGS84_F)
    pole = p < 1e-9
    return F.struct(
        F.when(pole, F.signum(z) * 90.0).otherwise(F.degrees(lat)).alias("lat"), F.when(pole, 0.0).otherwise(F.degrees(F.atan2(y, x))).alias("lon"),
        F.when(pole, F.abs(z) - b).otherwise(p * F.cos(lat) + z * F.sin(lat) - WGS84_A * F.sqrt(1 - _E2 * F.pow(F.sin(lat), 2))).alias("height"), n.alias("prime_vertical"))


def geodetic_to_ecef(lat: Column, lon: Column, height: Column) -> Column:
    """Struct (x, y, z) in metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - _E2 * F.pow(F.sin(la), 2))
    return F.struct(((n + height) * F.cos(la) * F.cos(lo)).alias("x"), ((n + height) * F.cos(la) * F.sin(lo)).alias("y"), ((n * (1 - _E2) + height) * F.sin(la)).alias("z"))


def azimuth_elevation(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> Column:
    """Struct (azimuth in [0, 360), elevation) of a vector seen from a place in degrees."""
    la, lo = F.radians(lat), F.radians(lon)
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    up = F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz
    return F.struct(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)).alias("azimuth"), F.degrees(F.atan2(up, F.hypot(east, north))).alias("elevation"))


def pierce_point(lat: Column, lon: Column, azimuth: Column, elevation: Column, shell_km: float = 350.0, earth_km: float = 6371.0) -> Column:
    """Struct (lat, lon) where the line of sight meets a thin shell."""
    e, az, la = F.radians(elevation), F.radians(azimuth), F.radians(lat)
    psi = F.pi() / 2 - e - F.asin(earth_km / (earth_km + shell_km) * F.cos(e))
    out = F.asin(F.sin(la) * F.cos(psi) + F.cos(la) * F.sin(psi) * F.cos(az))
    shift = F.atan2(F.sin(psi) * F.sin(az), F.cos(psi) * F.cos(la) - F.sin(psi) * F.sin(la) * F.cos(az))
    return F.struct(F.degrees(out).alias("lat"), wrap_longitude(lon + F.degrees(shift)).alias("lon"))


def glonass_hz(band: Column, channel: Column) -> Column:
    """Frequency of a channel in band 1, 2 or 3; null for others."""
    return F.when(band == "1", (1602 + 0.5625 * channel) * 1e6).when(band == "2", (1246 + 0.4375 * channel) * 1e6).when(band == "3", F.lit(1202.025e6))


def band_hz(system: Column, band: Column, channel: Column) -> Column:
    """Carrier frequency by system letter and band digit."""
    out = F.when(system == "R", glonass_hz(band, channel))
    for letter, bands in (("G", GPS_BANDS), ("E", GALILEO_BANDS)):
        for digit, hz in bands.items():
            out = out.when((system == letter) & (band == digit), F.lit(hz))
    return out


def cycles_to_metres(cycles: Column, hz: Column) -> Column:
    return cycles * LIGHT / hz


def geometry_free_to_phase(metres: Column, hz_a: Column, hz_b: Column) -> Column:
    """Radians on the first carrier of a geometry-free change in metres."""
    return metres * (hz_b * hz_b / (hz_a * hz_a - hz_b * hz_b)) * 2 * F.pi() * hz_a / LIGHT


def mjd_to_timestamp(mjd: Column) -> Column:
    """Timestamp without zone of a modified Julian date, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(mjd * 86_400e6).cast("long") - F.lit(3_506_716_800_000_000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def day_of_year_date(year: Column, doy: Column) -> Column:
    """The date of a day of the year; null outside the year."""
    date = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))
    return F.when(F.year(date) == year, date)


def gps_week(date: Column) -> Column:
    """Weeks since 1980-01-06."""
    return F.floor(F.datediff(date, F.lit("1980-01-06").cast("date")) / 7)


def days_in_year(year: Column) -> Column:
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))


def window_start(micros: Column, width: int, origin: Column | int = 0) -> Column:
    """Start of the window of a time in integer units, counted from an origin."""
    o = origin if isinstance(origin, Column) else F.lit(origin)
    return F.floor((micros - o) / width) * width + o


def normalised_grid_longitude(lon: Column, first: float) -> Column:
    """The longitude plus the turns that put it at or after the grid's first one."""
    return F.pmod(lon - first, F.lit(360.0)) + first
