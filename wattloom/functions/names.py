"""Names, identifiers and file paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that the data itself uses.
PRODUCTS = {"res": "resstock", "com": "comstock"}
WEATHERS = ("tmy3", "amy2018", "amy2012")
VERSIONS = ("3", "2", "1.1", "1")
YEARS = ("2021", "2022", "2023", "2024", "2025")
FILE_TYPES = (
    "hpxml", "schedule", "metadata", "load_curve_15min", "load_curve_hourly", "load_curve_daily", "load_curve_monthly",
    "load_curve_annual", "trip_schedules", "weather",
)

# States and the District by census division.
CENSUS_DIVISIONS = {
    1: ("CT", "ME", "MA", "NH", "RI", "VT"),
    2: ("NJ", "NY", "PA"),
    3: ("IL", "IN", "MI", "OH", "WI"),
    4: ("IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    5: ("DE", "DC", "FL", "GA", "MD", "NC", "SC", "VA", "WV"),
    6: ("AL", "KY", "MS", "TN"),
    7: ("AR", "LA", "OK", "TX"),
    8: ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY"),
    9: ("AK", "CA", "HI", "OR", "WA"),
}
# The states that data sets have, with their full names.
STATE_NAMES = {
    "AL": "Alabama", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii",
    "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
STATES = tuple(sorted(STATE_NAMES))

LAKE_PATH = r"([^/]+)/([^/]+)/state=([^/]+)/upgrade=(\d+)/([^/]+)$"


def quoted(name: str) -> str:
    """A column name in backticks; names here have dots in them."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def pad_left(c: Column, width: int) -> Column:
    """Zeros before shorter text; longer text stays whole."""
    c = c.cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def upgrade_number(c: Column) -> Column:
    """'04' and '4' alike as a number; null for anything else."""
    return F.when(F.trim(c.cast("string")).rlike(r"^\d+$"), F.trim(c.cast("string")).cast("int"))


def is_canonical_upgrade(c: Column) -> Column:
    return c.rlike(r"^(0|[1-9]\d*)$")


def upgrade_word(c: Column) -> Column:
    """'baseline' for 0, else 'upgradeNN'."""
    return F.when(c == 0, F.lit("baseline")).otherwise(F.concat(F.lit("upgrade"), pad_left(c, 2)))


def state_code(c: Column) -> Column:
    """A state's code from its code or full name, in any case, '%20' for spaces; null if there is none."""
    name = F.lower(F.trim(F.regexp_replace(c, "%20", " ")))
    table = F.create_map(*[F.lit(x) for code, full in STATE_NAMES.items() for x in (full.lower(), code)])
    code = F.upper(name)
    return F.when(code.isin(*STATES), code).otherwise(F.get(F.array(table[name]), F.lit(0)))


def census_division(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, states in CENSUS_DIVISIONS.items() for s in states for x in (s, n)])
    return table[c]


def puma_suffix(c: Column) -> Column:
    """The last five characters."""
    return F.right(c, F.lit(5))


def release_key(product: Column, year: Column, weather: Column, version: Column) -> Column:
    short = F.when(product.isin("resstock", "res"), "res").when(product.isin("comstock", "com"), "com")
    return F.concat_ws("_", short, year, weather, version)


def path_part(path: Column, part: str) -> Column:
    """release, file_type, state, upgrade (int) or file of a lake path; null if it is no such path."""
    k = ("release", "file_type", "state", "upgrade", "file").index(part) + 1
    found = F.nullif(F.regexp_extract(path, LAKE_PATH, k), F.lit(""))
    return found.cast("int") if part == "upgrade" else found


def lake_path(release: Column, file_type: Column, state: Column, upgrade: Column, file: Column) -> Column:
    return F.concat_ws("/", release, file_type, F.concat(F.lit("state="), state), F.concat(F.lit("upgrade="), pad_left(upgrade, 2)), file)


def building_of_file(file: Column) -> Column:
    """The building id before the first dash of a curve's file name."""
    return F.nullif(F.regexp_extract(file, r"^(\d+)-", 1), F.lit("")).cast("long")


def words(c: Column) -> Column:
    """The parts between runs of spaces, without empty ones."""
    return F.filter(F.split(F.trim(c), " +"), lambda w: w != "")


def is_s3_path(c: Column) -> Column:
    return c.rlike("^s3[an]?://[^/]+")


def as_json(*columns: str) -> Column:
    """The named columns as one JSON object."""
    return F.to_json(F.struct(*[col(c) for c in columns]))


def trimmed_lower(c: Column) -> Column:
    return F.lower(F.trim(c))


def trimmed_upper(c: Column) -> Column:
    return F.upper(F.trim(c))


def is_known(c: Column, known) -> Column:
    """Whether a name is one of the known ones (products, weathers, versions, years, file types or states)."""
    return F.coalesce(c.isin(*known), F.lit(False))


def s3_path(url: Column) -> Column:
    """An s3a path for a bucket's https address; other text stays."""
    return F.regexp_replace(url, r"^https://([^./]+)\.s3(?:[.-][a-z0-9-]+)?\.amazonaws\.com/", "s3a://$1/")
