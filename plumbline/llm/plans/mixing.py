"""Problem 9: mixing sources to target weights."""

from ...session import table
from ..mixing import mix, mix_report


def p9_mix(spark, sf_dir):
    rows, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return rows


def p9_shares(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares_ten_million(spark, sf_dir):
    """The same for a fixed size, at which small sources can't meet their targets on small data."""
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens=10_000_000)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_ten_million": p9_shares_ten_million}
SQL = {}
