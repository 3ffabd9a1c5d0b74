"""Column cleaning: codes, dates, booleans, numbers, identifiers and delimited lists.

Every function maps Column to Column with built-in expressions only, so all of
them stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters, null markers and month names of the raw files.
BLANKS = " \t\n\r\x0b\x0c"
NULL_CODES = ("", "NAN", "NONE", "NULL")
NULL_CODES_UPLOAD = ("", "NULL", "NONE", "NAN", "NA")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Two-digit years from here on are 19xx, smaller ones 20xx.
PIVOT = 69


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def pad_left(c: Column, width: int) -> Column:
    """Zero-pad to at least ``width``; longer values stay whole (``lpad`` alone would cut them)."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


# --- codes ---------------------------------------------------------------


def clean_code(c: Column, null_tokens: Sequence[str] = NULL_CODES) -> Column:
    """Trim, upper-case, drop dots; null markers become null."""
    code = F.replace(F.upper(strip(c)), F.lit("."), F.lit(""))
    return F.when(~code.isin(*null_tokens), code)


def clean_code_keep_dots(c: Column) -> Column:
    """Crosswalk variant: all whitespace removed, dots kept."""
    code = F.regexp_replace(F.upper(strip(c)), r"\s+", "")
    return F.when(~code.isin(*NULL_CODES), code)


def strip_float_suffix(c: Column) -> Column:
    """``'12.0'`` → ``'12'`` for codes that went through a float column."""
    return F.regexp_replace(strip(c), r"\.0$", "")


# --- dates ---------------------------------------------------------------


def iso_date(c: Column) -> Column:
    """Strict ``YYYY-MM-DD`` prefix to date, null on failure."""
    text = strip(c)
    return F.when(
        F.length(text) >= 10, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    )


def month_name_date(c: Column) -> Column:
    """``DD-Mon-YYYY`` or ``DD-Mon-YY`` (any case) to date; two-digit years above 50 are 19xx."""
    parts = F.split(strip(c), "-")
    day, month, year = (strip(F.get(parts, F.lit(i))) for i in range(3))
    month_number = F.try_element_at(
        F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")]), F.lower(month)
    )
    century = F.when(year.try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20"))
    full_year = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    text = F.concat_ws("-", full_year, month_number, pad_left(day, 2))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.when((F.size(parts) == 3) & month_number.isNotNull() & (year != ""), parsed)


def claim_date(c: Column) -> Column:
    """Upload rule: ISO text passes through, month-name dates are converted, anything else is null."""
    text = strip(c)
    iso_like = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & (F.length(text) >= 10)
    return F.when(F.upper(text).isin(*NULL_CODES_UPLOAD), F.lit(None).cast("date")).otherwise(
        F.when(iso_like, iso_date(text)).otherwise(month_name_date(text))
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date_words(text: Column) -> Column:
    """Lower-case text without its time of day, zone, weekday, ordinal endings and filler words."""
    words = F.lower(text)
    for pattern, put in (
        # A time with its half of day, fraction and zone; a date and a "t" may stand right before it.
        (r"(^|[\st])\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([ap]\.?m\.?)?\s*(z|utc|gmt)?\s*([+-]\d{2}:?\d{2})?(?=$|\s)", " "),
        (r"^(\d{8})[t ]?\d{4}(\d{2})?z?$", "$1"),
        (r"(?<=\d)(st|nd|rd|th)\b", ""),
        (r"\b(mon|tue(s)?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\b", " "),
        (r"\b(of|on|at|and|the)\b", " "),
    ):
        words = F.regexp_replace(words, pattern, put)
    return words


def _full_year(year: Column, pivot: int) -> Column:
    """Four digits of a year; other lengths than one, two or four give null."""
    short = F.lpad(year, 2, "0")
    century = F.when(short.try_cast("int") >= pivot, "19").otherwise("20")
    return F.when(F.length(year) <= 2, F.concat(century, short)).when((F.length(year) == 4) & (year != "0000"), year)


def _fields(words: Column, pivot: int) -> Column:
    """Runs of digits or letters in order; months by name become ``m1`` ... ``m12``, text with other signs has no field."""
    tokens = F.regexp_extract_all(words, F.lit(r"(\d+|\p{L}+)"), F.lit(1))
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"m{i}")])
    name = r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
    named = F.transform(tokens, lambda t: F.when(t.rlike(name), F.try_element_at(number, F.substring(t, 1, 3))).otherwise(t))
    run = F.get(tokens, F.lit(0))
    compact = F.when((F.size(tokens) == 1) & (F.length(run).isin(6, 8)), F.array(
        _full_year(F.substring(run, 1, F.length(run) - 4), pivot), F.substring(run, F.length(run) - 3, F.lit(2)), F.substring(run, F.length(run) - 1, F.lit(2))))
    return F.when(words.rlike(r"^[\p{L}\d\s,./;'-]*$"), F.coalesce(compact, named))


def _ordered(fields: Column) -> Column:
    """Year, month and day texts of the fields, in the order their kinds and sizes tell.

    A named month is the month; a field of four digits or above 31 is the year. What
    is left is month, then day; day first if the first one is above 12. Without
    such a year the last number is the year, or the first if the month is last.
    A missing day or month is the first.
    """
    def at(i: int) -> Column:
        return F.get(fields, F.lit(i))

    is_month = [F.coalesce(at(i).startswith("m"), F.lit(False)) for i in range(3)]
    is_year = [F.coalesce((F.length(at(i)) == 4) | (at(i).try_cast("int") > 31), F.lit(False)) & ~is_month[i] for i in range(3)]
    named = F.when(is_month[0], 0).when(is_month[1], 1).when(is_month[2], 2)
    year = (F.when(is_year[0], 0).when(is_year[1], 1).when(is_year[2], 2)
            .when(is_month[2], 0).when(F.size(fields) == 3, 2))
    month = F.regexp_replace(F.get(fields, named), "^m", "")
    rest = F.filter(fields, lambda t, i: (i != year) & (named.isNull() | (i != named)))
    first, second = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
    # Behind a leading year the order is month, day.
    swapped = (year != 0) & (first.try_cast("int") > 12) & second.isNotNull()
    one = F.lit("1")
    many = F.size(F.filter(fields, lambda t: t.startswith("m"))) > 1
    ordered = F.when(named.isNotNull(), F.array(F.get(fields, year), month, F.coalesce(first, one))).otherwise(
        F.array(F.get(fields, year), F.when(swapped, second).otherwise(F.coalesce(first, one)),
                F.when(swapped, first).otherwise(F.coalesce(second, one))))
    # Fewer than three fields need a year of four digits.
    enough = (F.size(fields) == 3) | ((F.size(fields) < 3) & F.exists(fields, lambda t: F.length(t) == 4) & year.isNotNull())
    return F.when(enough & year.isNotNull() & ~many, ordered)


def open_date(c: Column, pivot: int = PIVOT) -> Column:
    """Date of a text in any usual layout, by its fields; null where the fields make no date.

    Ambiguous day and month are read month first, as the established rule has it.
    Two-digit years from ``pivot`` on are 19xx.
    """
    def dated(parts: Column) -> Column:
        year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
        fits = (F.length(month) <= 2) & (F.length(day) <= 2)
        return F.when(fits, F.try_to_timestamp(F.concat(_full_year(year, pivot), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")),
                                               F.lit("yyyy-MM-dd")).cast("date"))

    return _let(_date_words(strip(c)), lambda words: _let(_fields(words, pivot), lambda fields: _let(_ordered(fields), dated)))


def mixed_date_text(c: Column) -> Column:
    """Eight digits or a date in any usual layout to ISO text; other text is kept as it is, null markers become null."""
    text = strip(c)
    eight_digits = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(
        ~text.isin(*NULL_CODES),
        F.when(text.rlike(r"^\d{8}$"), eight_digits).otherwise(F.coalesce(F.date_format(open_date(text), "yyyy-MM-dd"), text)),
    )


def is_bad_date(c: Column) -> Column:
    """True where a date is given but not parsable: the batch rule rejects such rows."""
    text = strip(c)
    given = c.isNotNull() & ~F.upper(text).isin(*NULL_CODES)
    return F.coalesce(given, F.lit(False)) & F.try_to_timestamp(
        F.substring(text, 1, 10), F.lit("yyyy-MM-dd")
    ).isNull()


def batch_date(c: Column) -> Column:
    text = strip(c)
    return F.when(
        ~F.upper(text).isin(*NULL_CODES),
        F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"),
    )


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def age_at(birth: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, birth) / 12).cast("int")


def in_years(c: Column, years: Iterable[int]) -> Column:
    """Year-set filter written as date ranges, so Parquet statistics can prune row groups."""
    ranges: list[list[int]] = []
    for year in sorted(set(years)):
        if ranges and ranges[-1][1] == year - 1:
            ranges[-1][1] = year
        else:
            ranges.append([year, year])
    condition = F.lit(False)
    for first, last in ranges:
        condition = condition | c.between(F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last}-12-31").cast("date"))
    return condition


def period_of(c: Column, periods) -> Column:
    """``historical`` / ``current`` / ``latest`` / ``other`` for an event date."""
    label = F.when(in_years(c, periods.historical), "historical").when(in_years(c, [periods.current]), "current")
    if periods.latest is not None and periods.latest != periods.current:
        label = label.when(in_years(c, [periods.latest]), "latest")
    return label.otherwise("other")


# --- booleans and numbers -------------------------------------------------


def parse_bool(c: Column, accept_y: bool = False) -> Column:
    accepted = ("true", "yes", "1", "y") if accept_y else ("true", "yes", "1")
    return F.coalesce(F.lower(strip(c)).isin(*accepted), F.lit(False))


def yes_no(c: Column) -> Column:
    text = F.lower(strip(c))
    return (
        F.when(text.isin("true", "yes", "1"), "Yes").when(text.isin("false", "no", "0"), "No").otherwise("")
    )


def to_number(c: Column) -> Column:
    """Numeric value, null where the text is none."""
    return c.try_cast("double")


def parse_float(c: Column, default: float = 0.0) -> Column:
    number = to_number(strip(c))
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(number)


def parse_int(c: Column, default: int = 0) -> Column:
    return parse_float(c, float(default)).cast("bigint")


def hcc_order(hcc: Column) -> Column:
    """Numeric order of categories; values that are no plain integer sort as 999."""
    return F.when(hcc.rlike(r"^\d+$"), hcc.try_cast("int")).otherwise(F.lit(999))


def fixed_decimals(c: Column, digits: int) -> Column:
    """Fixed-decimal text; ties follow the exact binary value (``format_string`` would round them up)."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part * 100.0 / total).otherwise(F.lit(0.0))


# --- identifiers and lists -------------------------------------------------


def numbered_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), pad_left(number, width))


def slot_event_id(source: Column, claim_id: Column, slot: Column) -> Column:
    """``{source}_{claim}_{P|slot}``; slot 0 is the principal diagnosis."""
    return F.concat_ws("_", source, claim_id, F.when(slot == 0, "P").otherwise(slot.cast("string")))


def suspect_key(bene_id: Column, hcc: Column, gap_type: Column) -> Column:
    return F.concat_ws("-", F.lit("SUS"), strip(bene_id), strip(hcc), F.upper(strip(gap_type)))


def split_pipes(c: Column) -> Column:
    items = F.transform(F.split(c, r"\|"), strip)
    return F.filter(items, lambda x: x != "")


def as_collection(c: Column) -> Column:
    """JSON list or pipe-delimited text to an array; a JSON value that is no list gives an empty array."""
    text = strip(c)
    is_json = F.try_parse_json(text).isNotNull()
    json_list = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    parsed = F.when(text.startswith("["), json_list).otherwise(F.array().cast("array<string>"))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(is_json, parsed).otherwise(split_pipes(text))
