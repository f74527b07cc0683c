"""Timestamp normalisation (Column -> Column), all as Catalyst expressions.

slapd writes one of three line heads:

* debug:   ``<hex seconds>.<hex fraction> <thread> rest``
* syslog:  ``Mon dd HH:MM:SS rest`` (no year, no zone)
* rfc3339: ``2024-01-15T10:30:00.123Z rest`` (already readable)

``normalize_frame`` rewrites the first two into the third so that every later
extraction sees one shape. All arithmetic is on epoch seconds and
``TIMESTAMP_NTZ`` values, so the result does not depend on the session zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted format names.
LOG_FORMATS = ("auto", "debug", "syslog-utc", "syslog-local", "rfc3339")

# Line-head shapes (Java regex).
DEBUG_HEAD = r"^[0-9a-fA-F]+\.[0-9a-fA-F]{5,8}[ \t]+"
SYSLOG_HEAD = r"^[A-Za-z]{3}[ ]+[0-9]{1,2}[ ]+[0-9]{2}:[0-9]{2}:[0-9]{2}[ ]+"
RFC3339_STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z"

# English month abbreviations, January first.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Largest epoch second whose calendar year still has four digits (9999-12-31T23:59:59).
_MAX_EPOCH_SECONDS = 253402300799
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_text(seconds: Column) -> Column:
    """Epoch seconds (BIGINT) -> ``yyyy-MM-ddTHH:mm:ss`` (UTC).

    Built from the day number and the second of the day, so neither the
    session time zone nor its DST gaps can shift the text.
    """
    days = F.floor(seconds / F.lit(86400))
    sod = seconds - days * 86400
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")

    def two(x):
        return F.lpad(x.cast("int").cast("string"), 2, "0")

    return F.concat(date, F.lit("T"), two(F.floor(sod / 3600)), F.lit(":"),
                    two(F.floor((sod % 3600) / 60)), F.lit(":"), two(sod % 60))


def _ntz_seconds(ntz: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), ntz)


def _as_of_parts(as_of) -> tuple[int, int]:
    if as_of is None:
        as_of = _dt.datetime.now(_dt.timezone.utc)
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, _dt.datetime) and as_of.tzinfo is not None:
        as_of = as_of.astimezone(_dt.timezone.utc)
    return as_of.year, as_of.month


def ts_text(raw="raw") -> Column:
    """The first RFC3339 stamp in the normalised line, NULL when none."""
    return F.nullif(F.regexp_extract(_col(raw), RFC3339_STAMP, 0), F.lit(""))


def ts_from_text(stamp) -> Column:
    """Microsecond TIMESTAMP from a stamp; the fraction is cut or padded to six digits."""
    s = _col(stamp)
    head = F.substring(s, 1, 20)  # yyyy-MM-ddTHH:mm:ss.
    frac = F.regexp_extract(s, r"\.(\d+)Z$", 1)
    six = F.rpad(F.substring(frac, 1, 6), 6, "0")
    return F.try_to_timestamp(F.concat(head, six, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"))


def normalize_frame(df, fmt: str = "auto", as_of=None, tz: str | None = None,
                    value: str = "value", out: str = "raw"):
    """Add the line with its head as an RFC3339 UTC stamp, in staged projections that
    run each head regex once per line.

    ``auto`` tries the debug head first, then syslog (read as UTC), else leaves the
    line as is. A debug fraction keeps the writer's unit: five hex digits are
    microseconds (at least six digits), six to eight nanoseconds (at least nine);
    thread and remainder are re-joined by single spaces; seconds beyond year 9999
    leave the line unchanged. Syslog heads get the year from ``as_of`` ("now") and a
    nine-zero fraction; ``syslog-local`` needs ``tz``, the zone they were written in.

    Stage 1 extracts the debug and syslog heads (anchored, fail fast);
    stage 2 cuts their parts with plain string functions; stage 3 formats.
    Each stage's columns are read several times by the next, so Catalyst
    keeps the stages apart instead of re-inlining the regexes.
    """
    if fmt not in LOG_FORMATS:
        raise ValueError(f"unknown log format {fmt!r}; expected one of {LOG_FORMATS}")
    if fmt == "syslog-local" and not tz:
        raise ValueError("syslog-local needs tz, the IANA zone the stamps were written in")
    v = F.col(value)
    if fmt == "rfc3339":
        return df.withColumn(out, v)
    cols = df.columns
    want_debug = fmt in ("auto", "debug")
    want_syslog = fmt in ("auto", "syslog-utc", "syslog-local")
    s1 = []
    if want_debug:
        s1.append(F.regexp_extract(v, DEBUG_HEAD, 0).alias("_dh"))
    if want_syslog:
        s1.append(F.regexp_extract(v, SYSLOG_HEAD, 0).alias("_sh"))
    st = df.select("*", *s1)
    s2 = []
    if want_debug:
        dh = F.col("_dh")
        sec_hex = F.substring_index(dh, ".", 1)
        sig = F.lower(F.expr("trim(LEADING '0' FROM substring_index(_dh, '.', 1))"))
        # seconds up to 9999-12-31T23:59:59 (0x3afff4417f): compare equal-length hex as text
        fits = (F.length(sig) < 10) | ((F.length(sig) == 10) & (sig <= F.lit(format(_MAX_EPOCH_SECONDS, "x"))))
        s2 += [
            F.when((dh != "") & fits, F.conv(sec_hex, 16, 10).cast("bigint")).alias("_dsec"),
            F.translate(F.substring_index(dh, ".", -1), " \t", "").alias("_dfrac"),
            v.substr(F.length(dh) + 1, F.lit(1 << 30)).alias("_dafter"),
            dh,
        ]
    if want_syslog:
        sh = F.col("_sh")
        core = F.rtrim(sh)  # "Mon dd HH:MM:SS" with any run of blanks between the parts
        # Month abbreviations, "|"-delimited so only whole names match
        months = "|" + "|".join(MONTHS) + "|"
        pos = F.instr(F.lit(months), F.concat(F.lit("|"), F.lower(F.substring(core, 1, 3)), F.lit("|")))
        s2 += [
            F.when((sh != "") & (pos > 0), ((pos + 3) / 4).cast("int")).alias("_smon"),
            F.when(sh != "", F.trim(core.substr(F.lit(4), F.length(core) - 11))).try_cast("int").alias("_sday"),
            F.substring(core, -8, 8).alias("_shms"),
            v.substr(F.length(sh) + 1, F.lit(1 << 30)).alias("_srest"),
        ]
    st = st.select(*cols, *s2)
    s3 = []
    raw = v
    if want_syslog:
        year_now, month_now = _as_of_parts(as_of)
        mon, day, hms = F.col("_smon"), F.col("_sday"), F.col("_shms")
        secs_of_day = (F.substring(hms, 1, 2).try_cast("int") * 3600 + F.substring(hms, 4, 2).try_cast("int") * 60
                       + F.substring(hms, 7, 2).try_cast("int"))
        year = F.greatest(F.when(mon > month_now, year_now - 1).otherwise(year_now), F.lit(1970))
        seconds = (F.unix_date(F.make_date(year, mon, F.lit(1))).cast("bigint") * 86400
                   + (day - 1).cast("bigint") * 86400 + secs_of_day)
        if fmt == "syslog-local":
            wall = F.timestamp_add("SECOND", seconds, F.expr(_EPOCH_NTZ))
            seconds = _ntz_seconds(F.convert_timezone(F.lit(tz), F.lit("UTC"), wall))
        syslog_raw = F.concat(epoch_to_text(seconds), F.lit(".000000000Z "), F.col("_srest"))
        raw = F.when(mon.isNotNull(), syslog_raw).otherwise(raw)
    if want_debug:
        frac_hex = F.col("_dfrac")
        frac_dec = F.conv(frac_hex, 16, 10)
        width = F.when(F.length(frac_hex) <= 5, F.lit(6)).otherwise(F.lit(9))
        frac = F.lpad(frac_dec, F.greatest(width, F.length(frac_dec)), F.lit("0"))
        after = F.col("_dafter")
        thread = F.regexp_extract(after, "^[^ \t]*", 0)
        rest = F.regexp_replace(after.substr(F.length(thread) + 1, F.lit(1 << 30)), "^[ \t]+", "")
        debug_raw = F.concat(
            epoch_to_text(F.col("_dsec")), F.lit("."), frac, F.lit("Z"),
            F.when(thread != "", F.concat(F.lit(" "), thread)).otherwise(F.lit("")),
            F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(F.lit("")),
        )
        raw = F.when(F.col("_dsec").isNotNull(), debug_raw).otherwise(
            F.when(F.col("_dh") != "", v).otherwise(raw) if want_syslog else raw)
    s3.append(raw.alias(out))
    return st.select(*cols, *s3)
