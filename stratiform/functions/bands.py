"""Band tables and the columns that look values up in them; indices of heat, chill and comfort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (bound, label) in order, the last label without a bound.
RAIN_HOUR = ((0.1, "Không mưa"), (0.5, "Mưa rất nhẹ"), (2.5, "Mưa nhẹ"), (7.5, "Mưa vừa"), (15.0, "Mưa to"), (None, "Mưa rất to"))
RAIN_DAY = ((1.0, "Không đáng kể"), (8.0, "Mưa nhẹ"), (16.0, "Mưa vừa"), (50.0, "Mưa to"), (100.0, "Mưa rất to"), (None, "Mưa đặc biệt to"))
CHANCE = ((20.0, "Rất thấp"), (40.0, "Thấp"), (60.0, "Trung bình"), (80.0, "Khá cao"), (None, "Cao"))
CLOUDS = ((25.0, "Ít mây"), (50.0, "Mây rải rác"), (75.0, "Nhiều mây"), (None, "U ám"))
TEMPERATURE = ((10.0, "Rét đậm"), (15.0, "Lạnh"), (20.0, "Mát"), (27.0, "Ấm dễ chịu"), (32.0, "Nóng"), (37.0, "Rất nóng"), (None, "Nắng nóng gay gắt"))
UV = ((2.0, "Thấp - An toàn"), (5.0, "Trung bình - Cần che nắng"), (7.0, "Cao - Hạn chế ra ngoài"), (10.0, "Rất cao - Không nên ra ngoài"), (None, "Cực cao - Nguy hiểm"))
UV_DAILY = ((3.0, "Thấp"), (6.0, "Trung bình"), (8.0, "Cao - Cần che nắng"), (11.0, "Rất cao - Hạn chế ra ngoài 10h-14h"), (None, "Cực cao - Nguy hiểm"))
DEW = ((10.0, "Khô ráo, dễ chịu"), (15.0, "Hơi khô, dễ chịu"), (18.0, "Bắt đầu ẩm"), (21.0, "Ẩm, oi bức"), (24.0, "Rất ẩm, khó chịu"), (None, "Nguy hiểm - Nồm ẩm"))
DEW_GROUP = ((10.0, "Rất khô"), (16.0, "Khô ráo"), (20.0, "Dễ chịu"), (24.0, "Oi bức"), (None, "Rất oi bức, khó chịu"))
PRESSURE = ((1000.0, "Áp thấp"), (1010.0, "Trung bình"), (1020.0, "Áp trung bình cao"), (1030.0, "Áp cao"), (None, "Áp rất cao"))
OCTANTS = ("Bắc", "Đông Bắc", "Đông", "Đông Nam", "Nam", "Tây Nam", "Tây", "Tây Bắc")
BEAUFORT = (0.5, 1.5, 3.3, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7)
UNKNOWN = "Không xác định"
HEAT_LEVELS = ((27.0, "An toàn"), (33.0, "Thận trọng"), (40.0, "Cảnh báo cao"), (52.0, "Nguy hiểm"), (None, "Cực nguy hiểm"))
CHILL_LEVELS = ((-20.0, "Cực nguy hiểm"), (-10.0, "Nguy hiểm"), (0.0, "Rất lạnh"), (None, "Lạnh"))
COMFORT_LEVELS = ((20.0, "Rất khó chịu"), (40.0, "Khó chịu"), (60.0, "Chấp nhận được"), (80.0, "Thoải mái"), (None, "Rất thoải mái"))


def banded(value: Column, table, closed: bool = False, missing: str | None = UNKNOWN) -> Column:
    """The label of the first bound above the value (`closed`: not below it); `missing` for null."""
    out = F.when(value.isNull(), F.lit(missing))
    for bound, label in table[:-1]:
        out = out.when(value <= bound if closed else value < bound, label)
    return out.otherwise(table[-1][1])


def band_sql(value: str, table, closed: bool = False, missing: str | None = UNKNOWN) -> str:
    cases = " ".join(f"WHEN {value} {'<=' if closed else '<'} {bound} THEN '{label}'" for bound, label in table[:-1])
    none = "NULL" if missing is None else f"'{missing}'"
    return f"CASE WHEN {value} IS NULL THEN {none} {cases} ELSE '{table[-1][1]}' END"


def octant(degrees: Column) -> Column:
    """One of eight directions; halves go to the even one."""
    return F.when(degrees.isNull(), UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, OCTANTS)), (F.pmod(F.bround(F.pmod(degrees, F.lit(360)) / 45), F.lit(8)) + 1).cast("int")))


def beaufort(speed: Column) -> Column:
    """0 to 12; 0 for null."""
    return sum((F.when(speed >= bound, 1).otherwise(0) for bound in BEAUFORT), F.lit(0))


def heat_index(temp: Column, humidity: Column) -> Column:
    """Rothfusz regression in degrees Celsius; null below 27."""
    t, h = temp * 9 / 5 + 32, humidity
    value = -42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 0.00683783 * t * t - 0.05481717 * h * h + 0.00122874 * t * t * h + 0.00085282 * t * h * h - 0.00000199 * t * t * h * h
    return F.when(temp >= 27, (value - 32) * 5 / 9)


def wind_chill(temp: Column, speed: Column) -> Column:
    """In degrees Celsius; null above 10 degrees or in light wind."""
    v = F.pow(speed * 3.6, F.lit(0.16))
    return F.when((temp <= 10) & (speed > 1.3), 13.12 + 0.6215 * temp - 11.37 * v + 0.3965 * temp * v)


def comfort(temp: Column, humidity: Column, speed: Column, uvi: Column, pop: Column) -> Column:
    """0 to 100: what temperature, humidity, wind, UV and rain chance take from 100; null without a temperature."""
    heat = F.when(temp < 10, (10 - temp) * 5).when(temp < 15, (15 - temp) * 4).when(temp < 22, (22 - temp) * 1.5).when(temp <= 28, 0.0).when(temp <= 32, (temp - 28) * 2).when(temp <= 35, (temp - 28) * 3).otherwise((temp - 28) * 5)
    damp = F.when(humidity > 90, (humidity - 70) * 0.8).when(humidity > 80, (humidity - 70) * 0.5).when(humidity > 70, (humidity - 70) * 0.3).otherwise(0.0)
    wind = F.when(speed > 15, (speed - 6) * 3).when(speed > 10, (speed - 6) * 2).when(speed > 6, speed - 6).otherwise(0.0)
    sun = F.when(uvi > 10, (uvi - 6) * 3).when(uvi > 8, (uvi - 6) * 2.5).when(uvi > 6, (uvi - 6) * 1.5).otherwise(0.0)
    rain = F.when(pop > 0.7, pop * 30).when(pop > 0.5, pop * 20).when(pop > 0.3, pop * 10).otherwise(0.0)
    return F.when(temp.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.round(100 - heat - damp - wind - sun - rain, 6)))))
