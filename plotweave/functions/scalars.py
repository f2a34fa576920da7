"""Scalar library: dates, rounding, units, colours, transparency, text and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000


def julian_day(ts: Column) -> Column:
    """Gregorian Julian day number of a timestamp's date, as a long."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) + 2_440_588).cast("long")


def julian_date(ts: Column) -> Column:
    """Day number plus the part of the day since midnight."""
    ms = (F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.second(ts) * 1000).cast("double")
    return julian_day(ts).cast("double") + ms / DAY_MS


FIRST_DAY, LAST_DAY = 1_721_426.0, 5_373_484.0


def date_of_julian(value: Column) -> Column:
    """The timestamp of a Julian date; null outside the calendar's domain."""
    days = F.floor(value) - 2_440_588
    seconds = F.rint((value - F.floor(value)) * 86_400)
    return F.when(value.between(FIRST_DAY, LAST_DAY), F.timestamp_seconds(days * 86_400 + seconds))


def elapsed(days: Column) -> Column:
    """Milliseconds of a duration in days."""
    return F.rint(days * DAY_MS).cast("long")


def rounded_to(value: Column, step: float) -> Column:
    """``value`` to a multiple of ``step``, ties to even; a step of 0 rounds nothing."""
    return F.rint(value / step) * step if step else value


def quantised(value: Column, step: float) -> Column:
    """Whole steps, ties to even."""
    if step <= 0:
        raise ValueError("the step must be positive")
    return F.rint(value / step).cast("long")


def dms(degrees: Column) -> Column:
    """Degrees, minutes and seconds, without the parts that are zero at the end."""
    total = F.rint(F.abs(degrees) * 3600).cast("long")
    d, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    sign = F.when((degrees < 0) & (total > 0), "-").otherwise("")
    text = lambda c: c.cast("long").cast("string")
    return F.concat(sign, text(d), F.lit("°"), F.when((m > 0) | (s > 0), F.concat(text(m), F.lit("'"))).otherwise(""), F.when(s > 0, F.concat(text(s), F.lit('"'))).otherwise(""))


def fraction(value: Column, places: int) -> Column:
    """Whole part and fraction of denominator 2**places, in lowest terms, as ``1 1/4``."""
    den = 1 << places
    n = F.rint(F.abs(value) * den).cast("long")
    whole, num = F.floor(n / den).cast("long"), n % den
    step = F.greatest(F.lit(1).cast("long"), *[F.when(num % (1 << k) == 0, F.lit(1 << k)).otherwise(F.lit(1)).cast("long") for k in range(1, places + 1)])
    part = F.concat(F.floor(num / step).cast("string"), F.lit("/"), F.floor(F.lit(den) / step).cast("string"))
    sign = F.when((value < 0) & (n > 0), "-").otherwise("")
    return F.concat(sign, F.when(num == 0, whole.cast("string")).when(whole == 0, part).otherwise(F.concat(whole.cast("string"), F.lit(" "), part)))


def architectural(inches: Column, places: int) -> Column:
    """Feet and inches with a fraction, as ``1'-2 1/2"``."""
    feet = F.floor(F.abs(inches) / 12)
    sign = F.when(inches < 0, "-").otherwise("")
    return F.concat(sign, feet.cast("string"), F.lit("'-"), fraction(F.abs(inches) - feet * 12, places), F.lit('"'))


def zero_mask(places: int, leading: bool, trailing: bool) -> str:
    """Number mask with optional digits where zeros are suppressed at either end."""
    head = "#" if leading else "0"
    return head + ("." + ("#" if trailing else "0") * places if places else "")


def decimal_text(value: Column, places: int, leading: bool = False, trailing: bool = False) -> Column:
    """A decimal with ``places`` digits; zeros at either end go where that is asked for."""
    text = F.format_string(f"%.{places}f", F.bround(value.cast("decimal(28,10)"), places).cast("double"))
    if trailing and places:
        text = F.regexp_replace(text, r"\.?0+$", "")
    if leading:
        text = F.regexp_replace(text, r"^(-?)0(?=\.)", "$1")
    return text


def gradians(radians: Column, places: int = 2) -> Column:
    return F.concat(decimal_text(radians * 200 / 3.141592653589793, places), F.lit("g"))


def pixel_size(value: Column, unit: Column) -> Column:
    """Pixels at 96 an inch of inches, millimetres or bare numbers; other units have none."""
    return F.when(unit == "in", value * 96).when(unit == "mm", value * 96 / 25.4).when(unit == "", value)


def true_colour(r: Column, g: Column, b: Column) -> Column:
    """Red, green and blue packed into 24 bits."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def channels(packed: Column) -> list[Column]:
    return [F.shiftright(packed, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0)]


def alpha_of_transparency(value: Column) -> Column:
    """Packed alpha of a transparency: -1 is by layer, 100 by block, and 0 to 90 per cent."""
    part = F.floor((100 - value) / 100.0 * 255).cast("int")
    return F.when(value == -1, F.lit(0)).when(value == 100, F.lit(1 << 24)).otherwise(F.lit(2 << 24) + part)


def transparency_of_alpha(packed: Column) -> Column:
    low = packed.bitwiseAND(F.lit(255))
    kind = F.shiftright(packed, 24)
    return F.when(kind == 0, F.lit(-1)).when(kind == 1, F.lit(100)).otherwise((100 - F.rint(low * 100 / 255.0)).cast("int"))


def sanitised(name: Column, empty: str = "SYM", longest: int = 80) -> Column:
    """A block name: blanks and illegal characters become one underscore, none at the ends, at most ``longest`` long."""
    out = F.regexp_replace(name, r"[\s<>/\\\":;?*|=`,、]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    return F.when(out == "", F.lit(empty)).otherwise(F.substring(out, 1, longest))


def masked(message: Column) -> Column:
    """A message with each run of digits as one sign."""
    return F.regexp_replace(message, r"\d+", "#")


def plain_lines(text: Column) -> Column:
    """Lines of marked-up text, which break at line ends and at the mark for a paragraph."""
    return F.split(text, r"\r\n|\r|\n|\\P")


_MARKS = r"\\\\[{}]|\\[\\{}]|\\[AcCfFhHp][^;]*;|\\[Pn]|\\|[{}]|[^\\{}]+"


def plain_text(text: Column) -> Column:
    """Marked-up text without its marks, read from left to right.

    An escaped backslash or brace is that character; paragraph marks become line ends; marks with an argument go up to
    their semicolon, as do braces; of any other escape the backslash alone goes. A backslash at the very end stays.
    """
    def read(t: Column) -> Column:
        plain = F.when(t.isin("{", "}", "\\"), "").when(t.isin("\\P", "\\n"), "\n").when(t.rlike(r"^\\[\\{}]"), F.substring(t, 2, 2))
        return plain.when(t.startswith("\\"), "").otherwise(t)

    tokens = F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0))
    return F.concat(F.array_join(F.transform(tokens, read), ""), F.when(F.try_element_at(tokens, F.lit(-1)) == "\\", "\\").otherwise(""))


def letter_signature(text: Column) -> Column:
    """The only distinct letter of a text, upper-cased; null if there are none or several."""
    letters = F.array_distinct(F.filter(F.split(F.upper(text), ""), lambda c: c.rlike("^[A-Z]$")))
    return F.when(F.size(letters) == 1, F.element_at(letters, 1))


def text_width(text: Column, height: Column) -> Column:
    """Estimated width of text: eight tenths of the height for each character of its longest line."""
    return height * 0.8 * F.array_max(F.transform(plain_lines(text), F.length))


def has_han(text: Column) -> Column:
    return text.rlike("[一-鿿]")


#: Red, green and blue of the first indexed colours: fixed values of the format.
BASE_COLOURS = ((0, 0, 0), (255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255), (255, 255, 255))


def approximate_index(r: Column, g: Column, b: Column) -> Column:
    """The first colour whose channels sum to that of the given one or to two more at least, else 0.

    This isn't the nearest colour. White ends the search, as no sum is larger.
    """
    total = r + g + b
    tests = [F.when((total == sum(c)) | (total - sum(c) < -1), F.lit(k)) for k, c in enumerate(BASE_COLOURS)]
    return F.coalesce(*tests, F.lit(0))


def measured(kind: Column, dx: Column, dy: Column, turn_deg: Column, dz: Column | None = None) -> Column:
    """Measurement of a dimension between two points that are (dx, dy, dz) apart.

    Aligned, radius and diameter take the distance, linear its part along the dimension's direction, and ordinate the
    part across the axis that it doesn't measure: ordinate_x across the turned y axis, ordinate_y across the turned x axis.
    """
    c, s = F.cos(F.radians(turn_deg)), F.sin(F.radians(turn_deg))
    along = F.abs(dx * c + dy * s)
    across = F.abs(dy * c - dx * s)
    distance = F.sqrt(dx * dx + dy * dy + (dz * dz if dz is not None else 0))
    return F.when(kind.isin("linear", "ordinate_x"), along).when(kind == "ordinate_y", across).otherwise(distance)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The angle of two vectors in degrees; 180 where one has no length."""
    size = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))
    return F.when(size == 0, 180.0).otherwise(F.degrees(F.acos(cosine)))


def scientific(value: Column, places: int) -> Column:
    """A number as ``1.25E+03``."""
    return F.format_string(f"%.{places}E", value.cast("double"))


def radian_text(radians: Column, places: int = 2) -> Column:
    return F.concat(decimal_text(radians, places), F.lit("r"))


def engineering(inches: Column, places: int) -> Column:
    """Feet and decimal inches, as ``1'-2.50"``."""
    feet = F.floor(F.abs(inches) / 12)
    return F.concat(F.when(inches < 0, "-").otherwise(""), feet.cast("string"), F.lit("'-"), decimal_text(F.abs(inches) - feet * 12, places), F.lit('"'))


def paper_unit(unit: Column) -> Column:
    """Drawing unit of a paper unit: inches and millimetres; all others have none."""
    return F.when(unit.isin("Inches", "Millimeters"), unit).otherwise("Unitless")


#: Lengths in millimetres of the line weights by index: fixed values of the format, in hundredths.
LINE_WEIGHTS = (0, 5, 9, 13, 15, 18, 20, 25, 30, 35, 40, 50, 53, 60, 70, 80, 90, 100, 106, 120, 140, 158, 200, 211)


def line_weight_index(weight: Column) -> Column:
    """Index of a line weight in hundredths of a millimetre, null for others."""
    at = F.array_position(F.array(*map(F.lit, LINE_WEIGHTS)), weight.cast("int"))
    return F.when(at > 0, (at - 1).cast("int"))


def angle_mod_pi(angle: Column) -> Column:
    """An undirected angle in [0, pi)."""
    return F.pmod(angle, F.lit(3.141592653589793))


def repaired(text: Column) -> Column:
    """Text that was read as Latin-1 though it is UTF-8; what doesn't decode stays as it is."""
    raw = F.encode(F.when(text.rlike("^[\\x00-\\xff]*$"), text), "ISO-8859-1")
    return F.when(F.is_valid_utf8(F.decode(raw, "ISO-8859-1")) & F.try_validate_utf8(raw.cast("string")).isNotNull(), raw.cast("string")).otherwise(text)


def unit_scale(paper: Column, drawing: Column) -> Column:
    """Scale of an annotation: paper units over drawing units, null for 0."""
    return F.when(drawing != 0, paper / drawing)


def overrides(codes: Column) -> Column:
    """Map of style overrides: the records between braces as pairs of code and value, null if one is left over."""
    inner = F.slice(codes, 2, F.size(codes) - 2)
    n = F.size(inner)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda k: F.struct(F.element_at(inner, 2 * k + 1).alias("key"), F.element_at(inner, 2 * k + 2).alias("value")))
    return F.when((F.element_at(codes, 1) == "{") & (F.element_at(codes, -1) == "}") & (n >= 2) & (n % 2 == 0), F.map_from_entries(pairs))
