"""Date functions.  The zone is always an argument: nothing depends on the
session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from newsloom import settings
from newsloom.functions.bind import bind

# English day and month names used in feeds.
_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Classes of tokens, a letter each: what a token is, and what may stand after it.  The first that fits counts.
_NO_DIGIT, _NO_LETTER = r"(?!\d)", "(?![A-Za-z])"
_CLASSES = {
    "C": (r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?", _NO_DIGIT),               # clock
    "K": (r"\d{8}(?:T?\d{4}(?:\d{2})?)?", _NO_DIGIT),                        # date without separators, perhaps with clock
    "I": (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", _NO_DIGIT),                        # year first
    "J": (r"\d{4}[-/]\d{1,2}", r"(?![-/\d])"),                              # year and month
    "S": (r"\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{1,2}\.\d{1,2}\.\d{4}", _NO_DIGIT),  # year last
    "O": (r"\d{1,2}(?i:st|nd|rd|th)", _NO_LETTER),                           # ordinal: a day
    "Y": (r"\d{4}", _NO_DIGIT),
    "D": (r"\d{1,2}", _NO_DIGIT),                                            # day, hour or year
    "M": (r"(?i:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)", ""),
    "W": (r"(?i:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*)", ""),
    "A": (r"(?i:[ap]m)", _NO_LETTER),
    "Z": (r"[+-]\d{2}(?::?\d{2})?", _NO_DIGIT),                              # offset
    "T": ("T", r"(?=\d)"),
    "N": ("[A-Za-z]{1,5}", _NO_LETTER),                                      # name of a zone
}
_BEFORE = {"Z": r"(?<=[\d\sMm])"}
_FILLERS = r"(?i:of|at|on|the)(?![A-Za-z])|[\s,]+|(?<=\d)-(?=[A-Za-z])|(?<=[A-Za-z])-(?=\d)|(?<=[A-Za-z])\."
_TOKEN = "(?s)(?:{})|({}|.)".format(
    _FILLERS, "|".join(f"{_BEFORE.get(k, '')}(?:{what}){after}" for k, (what, after) in _CLASSES.items()))

# What may follow each other.  An hour alone is a time only with am or pm.
_TAIL = "(?:T?CA?|DA)?[ZN]?"
_GRAMMAR = (
    f"^(?:[IS]{_TAIL}|J|K[ZN]?|W?[DO]M[YD]{_TAIL}|W?M[DO]Y{_TAIL}|YM[DO]{_TAIL}|W?M[DO]C[ZN]?Y|MY)$"
)


# The two standard forms, with a month that is one and an hour under 24: read as they are.
_CLOCK = r"(?:[01]\d|2[0-3]):\d\d:\d\d"
_RFC_3339 = rf"^\d{{4}}-(?:0\d|1[0-2])-\d\dT{_CLOCK}(?:Z|[+-]\d\d:\d\d)\z"
_RFC_822 = rf"^(?:{'|'.join(_DAYS)}), \d\d (?:{'|'.join(_MONTHS)}) \d{{4}} {_CLOCK} (?:GMT|[+-]\d{{4}})\z"


def _rfc_822(t: Column) -> Column:
    """ISO text of a date in that form."""
    offset = F.when(F.endswith(t, F.lit("GMT")), F.lit("Z")).otherwise(
        F.concat(F.substring(t, 27, 3), F.lit(":"), F.substring(t, 30, 2)))
    month = F.lpad(((F.instr(F.lit("".join(_MONTHS)), F.substring(t, 9, 3)) + 2) / 3).cast("int").cast("string"), 2, "0")
    return F.concat(
        F.substring(t, 13, 4), F.lit("-"), month, F.lit("-"), F.substring(t, 6, 2), F.lit("T"), F.substring(t, 18, 8), offset)


def parse_date_text(text: Column, zone: str = settings.DEFAULT_TIMEZONE) -> Column:
    """Instant of one date text, NULL where its tokens do not make a date.

    A text is cut into tokens, each token gets a class, and the classes in
    their order must fit a small grammar; every field is then the token of its
    class.  Local times belong to `zone`, a month without a day means its first
    day, 24:00 is the end of its day, and a date that does not exist gives NULL.
    The standard forms of RSS and Atom mean the same without being cut.
    """
    def judged(t: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(1)), lambda x: x != "")
        return bind(tokens, lambda ts: bind(
            F.array_join(F.transform(ts, _class), ""),
            lambda shape: F.when(shape.rlike(_GRAMMAR), bind(_fields(ts, shape), lambda f: _canonical(f, zone))),
        ))

    return bind(F.trim(text), lambda t: (
        F.when(t.rlike(_RFC_822), _rfc_822(t)).when(t.rlike(_RFC_3339), t).otherwise(judged(t)).try_cast("timestamp")))


def _class(token: Column) -> Column:
    """The letter of a token; what stands around it was judged when the text was cut."""
    (first, (what, _)), *others = _CLASSES.items()
    found = F.when(token.rlike(f"^(?:{what})$"), first)
    for letter, (what, _) in others:
        found = found.when(token.rlike(f"^(?:{what})$"), letter)
    return found.otherwise("?")


def _fields(tokens: Column, shape: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction, am or pm, zone; '' or NULL where there is none."""
    def after(place: Column, by: int = 0) -> Column:
        return F.get(tokens, F.when(place > 0, place - 1 + by).otherwise(-1))

    def of(letter: str) -> Column:
        return after(F.instr(shape, letter))

    compact = of("K")
    # the second number beside a month is a year of two digits
    year = F.coalesce(of("Y"), after(F.instr(shape, "M"), 1))
    day = F.coalesce(F.regexp_extract(of("O"), r"^\d+", 0), of("D"), F.lit("1"))
    date = F.split(F.coalesce(
        of("I"), F.concat(of("J"), F.lit("-1")), F.regexp_replace(of("S"), r"^(\d+).(\d+).(\d+)$", "$3-$1-$2"),
        F.regexp_replace(compact, r"^(\d{4})(\d\d)(\d\d).*$", "$1-$2-$3"), F.concat_ws("-", year, of("M"), day),
    ), "[-/]")
    hour_alone = after(F.instr(shape, "DA"))
    clock = F.split(F.coalesce(
        of("C"), hour_alone, F.regexp_replace(compact, r"^\d{8}T?(\d\d)?(\d\d)?(\d\d)?$", "$1:$2:$3"), F.lit(""),
    ), "[:.,]")
    part = lambda i: F.coalesce(F.get(clock, i), F.lit(""))
    return F.array(
        *(F.get(date, i) for i in range(3)), *(part(i) for i in range(3)), F.substring(part(3), 1, 6),
        of("A"), F.coalesce(of("Z"), of("N")),
    )


def _int(c: Column) -> Column:
    """Number of a text of digits, else NULL; a failing try_cast would cost an exception per row."""
    return F.when(c.rlike(r"^\d+$"), c.cast("int"))


def _month_number(m: Column) -> Column:
    names = F.lit("".join(x.lower() for x in _MONTHS))
    by_name = F.floor((F.instr(names, F.lower(F.substring(m, 1, 3))) + 2) / 3)
    return F.coalesce(_int(m), by_name.cast("int"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _canonical(f: Column, zone: str) -> Column:
    """ISO text of the fields of one date."""
    written, month, day, hour, minute, second, fraction, half, tz = (F.get(f, i) for i in range(9))
    # two digits: 1969 to 2068
    year = F.when(
        F.length(written) == 2, F.concat(F.when(written < "69", F.lit("20")).otherwise(F.lit("19")), written)
    ).when(F.length(written) == 4, written)

    def date(first):
        # month first, unless that cannot be a month
        swap = first > 12
        m = F.when(swap, _int(day)).otherwise(first)
        d = F.when(swap, first).otherwise(_int(day))
        return F.concat(year, F.lit("-"), _two(m), F.lit("-"), _two(d))

    end_of_day = (hour == "24") & minute.isin("", "00") & second.isin("", "00")
    hours = F.when(end_of_day, 0).otherwise(F.coalesce(_int(hour), F.lit(0)))
    shift = F.when((F.lower(half) == "pm") & (hours < 12), 12).when((F.lower(half) == "am") & (hours == 12), -12).otherwise(0)
    offset = (
        F.when(F.upper(tz).isin("Z", "UTC", "GMT"), F.lit("Z"))
        .when(tz.rlike(r"^[+-]\d\d$"), F.concat(tz, F.lit(":00")))
        .when(tz.rlike(r"^[+-]"), F.regexp_replace(tz, r"^(...):?(..)$", "$1:$2"))
        .otherwise(F.lit(" " + zone))  # no zone, or a name that says nothing
    )
    written_day = bind(_month_number(month), date)
    local_day = F.when(end_of_day, F.date_add(written_day.try_cast("date"), 1).cast("string")).otherwise(written_day)
    return F.concat(
        local_day, F.lit("T"), _two(hours + shift), F.lit(":"), F.lpad(minute, 2, "0"),
        F.lit(":"), F.lpad(second, 2, "0"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
        offset,
    )


def parse_date(published: Column, updated: Column, created: Column,
               zone: str = settings.DEFAULT_TIMEZONE) -> Column:
    """First of the three date texts that can be read."""
    # one expression for the three texts keeps plans small
    dates = F.transform(F.array(published, updated, created), lambda t: parse_date_text(t, zone))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), 0)


def instant(as_of: dt.datetime | str | Column) -> Column:
    """The run time as a timestamp Column.  A text or datetime without zone is UTC."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(round(as_of.timestamp() * 1_000_000)).cast("bigint"))


def from_utc_wall(c: Column) -> Column:
    """Instant of a zone-less timestamp that is known to be UTC."""
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
    )


def _utc_wall(ts: Column) -> Column:
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def wall(ts: Column, zone: str) -> Column:
    """Clock time of an instant in a zone, as a zone-less timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc_wall(ts))


def _offset(ts: Column, zone: str, colon: str) -> Column:
    minutes = F.timestamp_diff("MINUTE", _utc_wall(ts), wall(ts, zone))
    size = F.abs(minutes)
    return F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(colon),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def _clock(local: Column) -> Column:
    """HH:mm:ss of a zone-less timestamp."""
    return F.substring(local.cast("string"), 12, 8)


def to_iso(ts: Column, zone: str = settings.DEFAULT_TIMEZONE) -> Column:
    """ISO-8601 text with offset; the fraction appears only when it is not zero."""
    local = wall(ts, zone)
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(
        F.substring(local.cast("string"), 1, 10), F.lit("T"), _clock(local), fraction, _offset(ts, zone, ":")
    )


def run_date(as_of, zone: str = settings.DEFAULT_TIMEZONE) -> Column:
    """Calendar date of the run in the zone, as text."""
    return F.substring(wall(instant(as_of), zone).cast("string"), 1, 10)


def _name(names: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), position)


def rss_date(ts: Column, as_of, zone: str = settings.DEFAULT_TIMEZONE) -> Column:
    """RFC-822 date; an undated item gets the run time."""
    when = F.coalesce(ts, instant(as_of))
    local = wall(when, zone)
    return F.concat(
        _name(_DAYS, F.weekday(local) + 1), F.lit(", "),
        F.lpad(F.day(local).cast("string"), 2, "0"), F.lit(" "), _name(_MONTHS, F.month(local)), F.lit(" "),
        F.lpad(F.year(local).cast("string"), 4, "0"), F.lit(" "), _clock(local), F.lit(" "), _offset(when, zone, ""),
    )


def display_time(ts: Column, zone: str = settings.DEFAULT_TIMEZONE) -> Column:
    """Day, short month, hour and minute for a reader; '' for an undated item."""
    local = wall(ts, zone)
    hour = F.hour(local)
    hour12 = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    text = F.concat(
        F.day(local).cast("string"), F.lit(" "), _name(_MONTHS, F.month(local)), F.lit(", "),
        F.lpad(hour12.cast("string"), 2, "0"), F.lit(":"), F.lpad(F.minute(local).cast("string"), 2, "0"),
        F.when(hour < 12, F.lit(" am")).otherwise(F.lit(" pm")),
    )
    return F.coalesce(text, F.lit(""))
