"""Scalar derivations as column expressions; null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Termination, default-termination and change-order action codes.
TERMINATIONS, DEFAULT_TERMINATIONS, CHANGE_ORDERS = ("E", "F", "X"), ("E", "X"), ("A", "D")
HORIZONS = (12, 24, 36)
#: Names that stand for many recipients at once.
PLACEHOLDER = r"(?i)\b(MISCELLANEOUS|MULTIPLE|UNDISCLOSED|REDACTED|VARIOUS)\b"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def fiscal_year(d: Column) -> Column:
    return (F.year(d) + (F.month(d) >= 10).cast("int")).cast("int")


def clean_mod(mod: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(mod, F.lit(""))), '^"+|"+$', "")


def is_base_mod(mod: Column) -> Column:
    """Letters and then zeros only; null is no base modification."""
    return F.upper(clean_mod(mod)).rlike("^[A-Z]*0+$")


def mod_sequence(mod: Column) -> Column:
    """The digits at the end, -1 when there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(clean_mod(mod), r"(\d+)\s*$", 1), F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))


def is_aggregate_recipient(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(PLACEHOLDER)


def close(a: Column, b: Column, rel: float = 0.01, absolute: float = 1.0) -> Column:
    """Equal within the greater of an absolute and a relative tolerance; false for null."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def normalised_solicitation(s: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(s), "[^A-Z0-9]", ""), F.lit(""))


def looks_like_a_solicitation(s: Column) -> Column:
    t = F.trim(s)
    return F.coalesce(t.rlike("[A-Za-z]") & t.rlike("[0-9]") & (F.length(t) >= 8), F.lit(False))


def agency_of_key(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"_([^_]+)$", 1), F.lit(""))


def offer_band(n: Column) -> Column:
    return (
        F.when(n == 2, "2").when(n == 3, "3").when(n.between(4, 5), "4-5").when(n.between(6, 10), "6-10").when(n.between(11, 20), "11-20").when(n >= 21, "21+")
    )


def split_of(fy: Column) -> Column:
    """Train to 2017, validation 2018 and 2019, test 2020 to 2022; later and earlier years have none."""
    return F.when(fy.between(2010, 2017), "train").when(fy.between(2018, 2019), "val").when(fy.between(2020, 2022), "test")


def bin_index(p: Column, bins: int) -> Column:
    """Fixed-width bin of a share, robust to the last bits; 1 belongs to the last bin."""
    return F.when(p.isNotNull(), F.greatest(F.lit(0), F.least(F.floor(F.round(p * bins, 9)), F.lit(bins - 1))).cast("int"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(p, F.lit(1 - eps)))
    return F.log(q / (1 - q))


def shrink(num: Column, den: Column, prior: Column, k: float) -> Column:
    return (num + k * F.coalesce(prior, F.lit(0.0))) / (den + k)


def months_between_linear(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier) / 30.4375


def interval_months(earlier: Column, later: Column) -> Column:
    return 12 * (F.year(later) - F.year(earlier)) + F.month(later) - F.month(earlier)


def scale_for_year(year: Column) -> Column:
    return F.when(year.between(2013, 2021), "five").when(year.isNotNull(), "three")


def rank_in_scale(rating: Column, scale: Column) -> Column:
    """Green is 0; a rating that the scale doesn't have is null."""
    five = F.when(rating == "G", 0).when(rating == "AG", 1).when(rating == "A", 2).when(rating == "AR", 3).when(rating == "R", 4)
    three = F.when(rating == "G", 0).when(rating == "A", 1).when(rating == "R", 2)
    return F.when(scale == "five", five).when(scale == "three", three)


def normalised_rank(rating: Column, scale: Column) -> Column:
    return rank_in_scale(rating, scale) / F.when(scale == "five", F.lit(4.0)).otherwise(F.lit(2.0))


#: The six-point outcome scale and its abbreviations.
SIX_POINTS = ("highly unsatisfactory", "unsatisfactory", "moderately unsatisfactory", "moderately satisfactory", "satisfactory", "highly satisfactory")
SIX_SHORT = ("hu", "u", "mu", "ms", "s", "hs")


def six_point(value: Column, abbreviations: bool = False) -> Column:
    text = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    out = F.lit(None).cast("int")
    for i, name in enumerate(SIX_POINTS, 1):
        out = F.when(text == name, F.lit(i)).otherwise(out)
    if abbreviations:
        for i, name in enumerate(SIX_SHORT, 1):
            out = F.when(text == name, F.lit(i)).otherwise(out)
    return out


def label_at_least(points: Column, minimum: int) -> Column:
    return F.when(points.isNotNull(), (points >= minimum).cast("double"))


def days_fractional(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def value_change_ratio(reg, reg_net, reg_vat, sign, sign_net, sign_vat) -> Column:
    """Net by net where both are known, else gross by gross unless the VAT flags differ; zero counts as unknown."""
    usable = lambda x: F.nullif(x, F.lit(0.0))
    net = F.try_divide(usable(reg_net), usable(sign_net))
    gross = F.when(F.coalesce(reg_vat == sign_vat, F.lit(True)), F.try_divide(usable(reg), usable(sign)))
    return F.coalesce(net, gross)


#: What common words turn into in scanned texts.
SCAN_MARKERS = ("Ia", "ofthe", "tbe", "tbat", "arid", "aud", "conunitment", "developmnent", "projeet", "fmancial", "fmancing", "J3ank", "WorId", "Baak")


def noise_scores(text: Column, least: int = 500) -> Column:
    """struct(markers, singles): marks of bad scanning per thousand words of letters, and the share of words that are
    one letter other than a and i; both null below ``least`` words."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1))
    n = F.size(words)
    tokens = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    marks = F.size(F.filter(tokens, lambda w: w.isin(*SCAN_MARKERS)))
    single = F.size(F.filter(words, lambda w: (F.length(w) == 1) & ~F.lower(w).isin("a", "i")))
    enough = n >= least
    return F.struct(F.when(enough, 1000.0 * marks / n).alias("markers"), F.when(enough, single / n).alias("singles"))


def is_competed(code: Column, offers: Column) -> Column:
    """Fully competed (codes A and D) with two offers or more; false for nulls."""
    return F.coalesce(code.isin("A", "D") & (offers.cast("double") >= 2), F.lit(False))


#: The chance of no material problem that a rating stands for, by scale.
IMPLIED_OK = {"five": {"G": 0.90, "AG": 0.75, "A": 0.50, "AR": 0.25, "R": 0.10}, "three": {"G": 0.85, "A": 0.50, "R": 0.15}}


def implied_adverse(rating: Column, scale: Column) -> Column:
    """The chance of trouble that a rating implies on its scale; null for a rating that the scale doesn't have."""
    out = F.lit(None).cast("double")
    for name, table in IMPLIED_OK.items():
        for value, p in table.items():
            out = F.when((scale == name) & (rating == value), F.lit(1 - p)).otherwise(out)
    return out


#: Report categories by their lower-case spellings.
CATEGORIES = {
    "information and communications technology (ict)": "ICT", "ict": "ICT", "government transformation and service delivery": "Government Transformation and Service Delivery",
    "infrastructure and construction": "Infrastructure and Construction", "military capability": "Military Capability",
}
#: Departments that are linked as one although they are reported apart.
LINKED_DEPARTMENTS = {"BEIS/DBT": "BEIS lineage", "DECC/DESNZ": "BEIS lineage"}


def renamed(value: Column, names: dict[str, str], key: Column | None = None) -> Column:
    """The name that a table has for a value (looked up by ``key``), else the value itself."""
    found = F.lit(None).cast("string")
    for old, new in names.items():
        found = F.when((value if key is None else key) == old, F.lit(new)).otherwise(found)
    return F.coalesce(found, value)


def canonical_category(value: Column) -> Column:
    """A report category in its usual spelling; null for blanks."""
    key = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.when(~key.isin("", "nan", "none"), renamed(F.trim(value), CATEGORIES, key))


def linking_group(department: Column) -> Column:
    return renamed(department, LINKED_DEPARTMENTS)
