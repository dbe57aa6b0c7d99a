"""Mixed timestamp strings to UTC instants through a persisted dictionary of distinct values.

The raw strings are reduced to distinct (raw, zone) entries, each entry is parsed once by JVM expressions,
the parsed entries are appended to a table in the shared folder, and rows get their instant by an equi-join.
An update parses only the entries the table lacks.

Defined results: null, blank, unparsable and impossible values give no instant; a local time without a host,
one that a clock shows twice (autumn) or never (spring), gives none; strings with an explicit offset, Z, UTC, GMT
or a Unix number need no host; repeated rows each get their instant; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.runtime import broadcast_if_small

# English month names as written in the logs.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MON = r"([A-Za-z]{3})[a-z]*"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2})"
# Each layout rewrites to year|month|day|hour|minute|second|fraction|am/pm|zone|date order (n: numeric, by host).
LAYOUTS = [
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[T ]{_TIME}\s?{_ZONE}?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)$", "$1|$2|$3|$4|$5|$6|||$7|"),
    (rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) {_MON} (\d{{4}}) {_TIME}\s?{_ZONE}?$", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    (rf"^[A-Z][a-z]{{2}} {_MON} +(\d{{1,2}}) {_TIME} (?:{_ZONE} )?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7|"),
    (rf"^{_MON} (\d{{1,2}}), (\d{{4}}) {_TIME}\s?([AaPp][Mm])?\s?{_ZONE}?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})[ T]{_TIME}\s?([AaPp][Mm])?\s?{_ZONE}?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|n"),
]
_NUMBER = r"^(\d{9,20})(?:\.(\d+))?$"
_ABSOLUTE = r"(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$|^\d{9,20}(?:\.\d+)?$|\b(?:UTC|GMT) \d{4}$"
_US = 1_000_000


def _clean(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _us(ts: Column) -> Column:
    return F.unix_micros(ts)


def _offset_us(local_utc: Column, tz: Column) -> Column:
    """Offset of the zone at a UTC instant, in microseconds."""
    return _us(F.from_utc_timestamp(local_utc, tz)) - _us(local_utc)


def _candidates(local: Column, tz: Column) -> Column:
    """All UTC instants (microseconds) at which a clock of the zone shows the local time: none, one or two."""
    year_ends = F.array(*[_offset_us(F.timestamp_micros(_us(local) + F.lit(d * 3600 * _US)), tz) for d in (-26, 26)])
    tries = F.array_distinct(F.transform(year_ends, lambda o: _us(local) - o))
    return F.filter(tries, lambda u: _us(F.from_utc_timestamp(F.timestamp_micros(u), tz)) == _us(local))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Add utc_us to rows of (raw, zone), where zone is 'tz_name|date_order|std_abbr|dst_abbr' or ''."""
    c = _clean(F.col("raw"))
    canon = F.lit(None).cast("string")
    for pattern, to in reversed(LAYOUTS):
        canon = F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_replace(c, pattern, to)).otherwise(canon)
    e = entries.withColumn("_c", c).withColumn("_p", F.split(canon, r"\|")).withColumn("_z", F.split("zone", r"\|"))
    # The session zone must not shift local clocks: all arithmetic runs on UTC-based microseconds.
    part = [F.try_element_at("_p", F.lit(i + 1)) for i in range(10)]
    zone = [F.try_element_at("_z", F.lit(i + 1)) for i in range(4)]
    tz, order, std, dst = [F.when(x != "", x) for x in zone]
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part[1], 1, 3)))
    a, b = _long(part[1]), _long(part[2])
    numeric, dmy = part[9] == "n", order == "dmy"
    month = F.when(named > 0, named).when(numeric & dmy, b).otherwise(a)
    day = F.when(numeric & dmy, a).otherwise(b)
    h12, ampm = _long(part[3]), F.lower(part[7])
    bad12 = (ampm != "") & ~h12.between(1, 12)
    hour = F.when(ampm == "pm", h12 % 12 + 12).when(ampm == "am", h12 % 12).otherwise(h12)
    second = F.coalesce(_long(part[5]), F.lit(0))
    ok = month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & _long(part[4]).between(0, 59) & second.between(0, 59) & ~F.coalesce(bad12, F.lit(False)) & (_long(part[0]) > 0)
    date = F.when(ok, F.concat_ws("-", F.lpad(part[0], 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))).try_cast("date")
    micros = F.rpad(F.substring(part[6], 1, 6), 6, "0").cast("long")
    local = F.unix_date(date).cast("long") * 86400 * _US + (hour * 3600 + _long(part[4]) * 60 + second) * _US + F.when(part[6] != "", micros).otherwise(F.lit(0))
    sign = F.when(F.substring(part[8], 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(part[8], r"[^0-9]", "")
    fixed = F.when(part[8].isin("Z", "UTC", "GMT"), F.lit(0)).when(digits != "", sign * (_long(F.substring(digits, 1, 2)) * 60 + _long(F.substring(digits, 3, 2))) * 60 * _US)
    e = (
        e.withColumn("_local", local).withColumn("_zone", part[8]).withColumn("_fixed", fixed)
        .withColumn("_tz", tz).withColumn("_std", std).withColumn("_dst", dst)
        .withColumn("_numeric", numeric).withColumn("_order", order)
    )
    local_ts = F.timestamp_micros("_local")
    halves = [_offset_us(F.timestamp_micros(F.unix_date(F.make_date(F.year(local_ts), F.lit(m), F.lit(15))).cast("long") * 86400 * _US), F.col("_tz")) for m in (1, 7)]
    named_offset = F.when(F.col("_zone") == F.col("_std"), F.least(*halves)).when(F.col("_zone") == F.col("_dst"), F.greatest(*halves))
    found = _candidates(local_ts, F.col("_tz"))
    number = F.regexp_extract("_c", _NUMBER, 1)
    n, f = _long(number), F.regexp_extract("_c", _NUMBER, 2)
    width = F.length(number)
    epoch = (
        F.when(width <= 11, n * _US + F.coalesce(_long(F.rpad(F.substring(f, 1, 6), 6, "0")), F.lit(0)))
        .when(width <= 14, n * 1000).when(width <= 17, n).when(width <= 20, F.floor(n / 1000).cast("long"))
    )
    # Nineteen digits exceed the exact range of doubles: cut the last three as text.
    epoch = F.when(width >= 18, _long(F.expr("substring(regexp_extract(_c, '^([0-9]+)', 1), 1, length(regexp_extract(_c, '^([0-9]+)', 1)) - 3)"))).otherwise(epoch)
    needs_order = F.col("_numeric") & F.col("_order").isNull()
    utc = (
        F.when(width > 0, epoch)
        .when(F.col("_local").isNull() | F.coalesce(needs_order, F.lit(False)), None)
        .when(F.col("_fixed").isNotNull(), F.col("_local") - F.col("_fixed"))
        .when(F.col("_tz").isNull(), None)
        .when(F.col("_zone") != "", F.col("_local") - named_offset)
        .when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))
    )
    return e.select("raw", "zone", utc.cast("long").alias("utc_us"))


def with_zone(rows: DataFrame, hosts: DataFrame, host: Column) -> DataFrame:
    """Add zone: the host's clock as 'tz_name|date_order|std_abbr|dst_abbr', '' without a known host or where the string is absolute."""
    z = hosts.where(F.col("host").isNotNull()).groupBy(F.col("host").alias("_host")).agg(
        F.min(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("tz_name", "date_order", "std_abbr", "dst_abbr")])).alias("_hz"))
    absolute = F.regexp_like(_clean(F.col("raw")), F.lit(_ABSOLUTE)) & ~F.regexp_like(_clean(F.col("raw")), F.lit(r"^\d{1,2}[/.-]"))
    return (
        rows.withColumn("_h", host).join(broadcast_if_small(z), F.col("_h") == F.col("_host"), "left")
        .withColumn("zone", F.when(absolute, F.lit("")).otherwise(F.coalesce("_hz", F.lit(""))))
        .drop("_h", "_host", "_hz")
    )


class TimestampDictionary:
    """Distinct (raw, zone) -> utc_us, kept as an append-only parquet table at path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.parts = spark, path, 0
        self._schema = "raw string, zone string, utc_us long"

    def entries(self) -> DataFrame:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(self.path)

    def update(self, rows: DataFrame) -> None:
        """Parse and append the entries of rows (raw, zone) that the table lacks; at least one file is written."""
        new = rows.where(F.col("raw").isNotNull()).select("raw", "zone").distinct()
        known = self.entries()
        if not known.isEmpty():
            new = new.join(known.select("raw", "zone"), ["raw", "zone"], "left_anti")
        parse_entries(new).write.mode("append").parquet(self.path)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows with utc_us added (null where the row determines none). A hot raw value is split by adaptive skew joins."""
        d = self.entries().where(F.col("utc_us").isNotNull())
        return rows.join(d, ["raw", "zone"], "left")
