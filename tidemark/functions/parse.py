"""Column functions that read typed values from short texts; NULL where the text isn't one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Period names (fixed values).
PERIODS = {
    "1ST": 1, "2ND": 2, "3RD": 3, "4TH": 4, "1": 1, "2": 2, "3": 3, "4": 4,
    "Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "1Q": 1, "2Q": 2, "3Q": 3, "4Q": 4,
    "OT": 5, "OT1": 5, "1OT": 5, "2OT": 6, "OT2": 6, "3OT": 7, "OT3": 7,
    "1STQTR": 1, "2NDQTR": 2, "3RDQTR": 3, "4THQTR": 4, "P1": 1, "P2": 2, "P3": 3,
}
TENTHS = r"^([0-9]{1,2})\.([0-9])$"


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group as text, NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, pattern: str, group: int) -> Column:
    """A group as a whole number, NULL without a match."""
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _tenths(text: Column) -> Column:
    return F.when(text.rlike(TENTHS), _number(text, TENTHS, 1) + _number(text, TENTHS, 2) / 10.0)


def score(text: Column, most: int = 250) -> Column:
    t = F.trim(text)
    n = F.when(t.rlike("^[0-9]{1,3}$"), t.try_cast("int"))
    return F.when(n <= most, n)


def clock(text: Column, most_minutes: int = 20) -> Column:
    """Seconds of M:SS, S.t, or three or four bare digits."""
    t = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    pattern = F.when(t.rlike("^[0-9]{1,2}:[0-9]{2}$"), F.lit(True)).when(t.rlike("^[0-9]{3,4}$"), F.lit(True))
    minutes = _number(t, "^([0-9]{1,2}):?[0-9]{2}$", 1)
    seconds = _number(t, "([0-9]{2})$", 1)
    sexagesimal = F.when(pattern & (seconds < 60) & (minutes <= most_minutes), (minutes * 60 + seconds).cast("double"))
    return F.coalesce(_tenths(t), sexagesimal)


def shot_clock(text: Column, most: int = 40) -> Column:
    t = F.trim(text)
    whole = F.when(t.rlike("^[0-9]{1,2}$"), t.try_cast("int"))
    return F.coalesce(_tenths(t), F.when(whole <= most, whole.cast("double")))


def period(text: Column) -> Column:
    """Number of a period name; a mangled ordinal counts by its leading digit."""
    key = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    known = F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))
    first, rest = F.substring(key, 1, 1), F.substring(key, 2, 10)
    mangled = F.when(first.rlike("^[1-4]$") & (F.length(key) <= 3) & ~rest.rlike("^[0-9]+$"), first.try_cast("int"))
    fixed = F.when((F.length(key) == 3) & first.isin("I", "L"), F.lit(1)).when((F.length(key) == 3) & (first == "Z"), F.lit(2))
    return F.coalesce(F.try_element_at(known, key), mangled, fixed)


def inning(text: Column, most: int = 30) -> Column:
    """Half-innings: top 2n - 1, bottom 2n; between halves counts as bottom, no mark as top."""
    half = r"TOP|T|▲|△|↑|\^|BOTTOM|BOT|B|▼|↓|MIDDLE|MID|END"
    pattern = rf"^({half})?([0-9]{{1,2}})(?:ST|ND|RD|TH)?({half})?$"
    t = F.regexp_replace(F.upper(text), r"\s+", "")
    n = _part(t, pattern, 2).try_cast("int")
    mark = F.coalesce(_part(t, pattern, 1), _part(t, pattern, 3))
    top = mark.isNull() | mark.isin("TOP", "T", "▲", "△", "↑", "^")
    return F.when(n.between(1, most), F.when(top, 2 * n - 1).otherwise(2 * n))


def overtime_period(text: Column, regulation: int | Column = 3) -> Column:
    """Periods of a sport of three: SO is two past regulation, OT n past it."""
    key = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    ot = r"^([0-9]?)OT([0-9]?)$"
    n = F.coalesce(_part(key, ot, 1), _part(key, ot, 2), F.lit("1")).try_cast("int")
    plain = period(text)
    return F.when(key == "SO", regulation + 2).when(key.rlike(ot), regulation + n).otherwise(F.when(plain <= regulation, plain))


def zero_led(text: Column) -> Column:
    """':42' is read as '0:42'."""
    t = F.trim(text)
    return F.when(t.startswith(":"), F.concat(F.lit("0"), t)).otherwise(text)


def period_by(reader: Column, text: Column, regulation: Column) -> Column:
    """A period as its sport's reader has it: 'inning', 'overtime' (of a sport of ``regulation`` periods), else 'quarter'."""
    return F.when(reader == "inning", inning(text)).when(reader == "overtime", overtime_period(text, regulation)).otherwise(period(text))


def clock_by(led: Column, text: Column) -> Column:
    """A clock; where ``led``, one that begins with a colon has no minutes."""
    return clock(F.when(led, zero_led(text)).otherwise(text))


def note(text: Column) -> Column:
    """Text of a field without a reader: trimmed, NULL if empty."""
    return F.nullif(F.trim(text), F.lit(""))


def inning_label(half: Column) -> Column:
    """'Top 5' of half-inning 9, 'Bot 5' of 10."""
    side = F.when(half % 2 == 0, "Bot ").otherwise("Top ")
    return F.when(half.isNull(), "?").otherwise(F.concat(side, F.floor((half + 1) / 2).cast("string")))


def iso_clock(text: Column) -> Column:
    """Seconds of PT11M42.00S, m:s, or a number."""
    t = F.trim(text)
    iso = r"^PT(?:([0-9.]*)M)?(?:([0-9.]*)S)?$"
    of_iso = F.coalesce(_part(t, iso, 1).try_cast("double"), F.lit(0.0)) * 60 + F.coalesce(_part(t, iso, 2).try_cast("double"), F.lit(0.0))
    colon = r"^([0-9]+):([0-9.]+)$"
    of_colon = _part(t, colon, 1).try_cast("int") * 60 + _part(t, colon, 2).try_cast("double")
    return F.when(t.rlike(iso), of_iso).when(t.contains(":"), of_colon).otherwise(t.try_cast("double"))


def whole(text: Column) -> Column:
    return text.try_cast("int")


def field(name: Column, text: Column) -> Column:
    """The value of a named field as a number."""
    scores = name.isin("away_score", "home_score")
    return F.when(scores, score(text).cast("double")).when(name == "clock", clock(text)).when(name == "shot_clock", shot_clock(text)).when(name == "period", period(text).cast("double"))


def trusted(text: Column, conf: Column, visible: Column, least: float, value: Column) -> Column:
    """``value`` where the row is visible, read, and read surely enough (compared as FLOAT)."""
    return F.when(visible & (text != "") & (conf >= F.lit(least).cast("float")), value)


def elapsed(period_: Column, clock_: Column, regulation: int, seconds: float, extra: float) -> Column:
    """Game seconds played at a period's remaining clock; NULL where either is unknown."""
    done = F.least(period_ - 1, F.lit(regulation)) * seconds + F.greatest(period_ - 1 - regulation, F.lit(0)) * extra
    return F.when(clock_.isNotNull(), done + F.greatest(F.lit(0.0), F.when(period_ <= regulation, seconds).otherwise(extra) - clock_))


def period_label(period_: Column, regulation: int, prefix: str = "Q") -> Column:
    over = period_ - regulation
    return F.when(period_.isNull(), "?").when(over <= 0, F.concat(F.lit(prefix), period_.cast("string"))).when(over == 1, "OT").otherwise(F.concat(over.cast("string"), F.lit("OT")))


def clock_label(seconds: Column) -> Column:
    """9:40 from a minute on, else 45.3; empty where unknown."""
    m = F.floor(seconds / 60)
    return F.when(seconds.isNull(), "").when(seconds >= 60, F.format_string("%d:%02d", m, F.floor(seconds - m * 60))).otherwise(F.format_string("%.1f", seconds))


def time_label(seconds: Column) -> Column:
    """m:ss or h:mm:ss of an output position."""
    s = F.floor(seconds)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def same_code(a: Column, b: Column) -> Column:
    """Codes of one team in two spellings: equal, one the other's prefix, or the same first two letters."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    some = (x != "") & (y != "")
    alike = (x == y) | x.startswith(y) | y.startswith(x)
    return some & (alike | ((F.length(x) >= 2) & (F.length(y) >= 2) & (F.substring(x, 1, 2) == F.substring(y, 1, 2))))


def season(date: Column) -> Column:
    """January and February belong to the year before."""
    return F.year(date) - (F.month(date) <= 2).cast("int")


def roman(n: Column) -> Column:
    """Roman numerals below 90, from tens and ones."""
    tens = F.array(*map(F.lit, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX")))
    ones = F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    return F.when((n > 0) & (n < 90), F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, (n % 10).cast("int"))))


def initial_name(name: Column) -> Column:
    """'Karl-Anthony Towns' as 'K. Towns'; single names stay."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) < 2, F.trim(name)).otherwise(F.concat(F.substring(parts[0], 1, 1), F.lit(". "), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")))


def digits_fixed(text: Column) -> Column:
    """Letters read for digits beside digits, colons or dots."""
    zeros = F.regexp_replace(text, r"[Oo](?=[:.0-9])|(?<=[:.0-9])[Oo]", "0")
    return F.regexp_replace(zeros, r"[lI](?=[:.0-9])|(?<=[:.0-9])[lI]", "1")


def fused_parts(text: Column) -> Column:
    """A line read as one: struct of period text, clock and shot clock; NULL parts where absent."""
    t = digits_fixed(F.trim(text))
    line = r"^(.*?)\s*([0-9]{1,2}:[0-5][0-9]|(?<![0-9])[0-9]{1,2}\.[0-9])\s*([0-9]{1,2})?$"
    return F.struct(F.nullif(F.trim(F.regexp_extract(t, line, 1)), F.lit("")).alias("period"), _part(t, line, 2).alias("clock"), _part(t, line, 3).alias("shot"))


def clock_inside(text: Column) -> Column:
    """Seconds of the first clock anywhere in a text."""
    at = r"([0-9]{1,2}):([0-5][0-9])|(?<![0-9])([0-9]{1,2})\.([0-9])(?![0-9])"
    g = lambda k: _part(text, at, k).try_cast("int")
    return F.coalesce((g(1) * 60 + g(2)).cast("double"), g(3) + g(4) / 10.0)


def is_clock(text: Column) -> Column:
    return F.trim(text).rlike(r"^([0-9]{1,2}:[0-9]{2}|[0-9]{1,2}\.[0-9])$")


def is_label(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike("^[A-Z]{2,5}$") & period(t).isNull()


def file_name(text: Column, most: int = 70) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9 ._-]+", "")), 1, most)


def hashtag(text: Column) -> Column:
    t = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    return F.when(t != "", F.concat(F.lit("#"), t)).otherwise("")
