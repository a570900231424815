"""Display formats as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions.odds import american_to_decimal

#: Display names of roof codes.
ROOFS = (
    ("DOME", "Dome"),
    ("OUTDOOR", "Outdoor"),
    ("RETRACTABLE_OPEN", "Retractable (open)"),
    ("RETRACTABLE_CLOSED", "Retractable (closed)"),
)
MISSING = "—"


def plain_number(x: Column) -> Column:
    """Shortest decimal form: no trailing zeros, no sign for positive numbers."""
    text = F.format_string("%.4f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def format_odds(a: Column, style: str = "AMERICAN") -> Column:
    if style == "DECIMAL":
        return F.format_string("%.2f", american_to_decimal(a))
    return F.when(a > 0, F.concat(F.lit("+"), a.cast("string"))).otherwise(a.cast("string"))


def format_line(line: Column) -> Column:
    signed = F.when(line > 0, F.concat(F.lit("+"), plain_number(line))).otherwise(plain_number(line))
    return F.when(line.isNull(), MISSING).when(line == 0, "PK").otherwise(signed)


def format_market_line(market: Column, line: Column) -> Column:
    """Totals carry no sign."""
    return F.when(line.isNull(), MISSING).when(market == "TOTAL", plain_number(line)).otherwise(format_line(line))


def format_percent(p: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", p * 100)


def format_signed_percent(p: Column, decimals: int = 1) -> Column:
    return F.concat(F.when(p >= 0, "+").otherwise(""), format_percent(p, decimals))


def format_money(x: Column) -> Column:
    amount = F.concat(F.lit("$"), F.format_number(F.abs(x), 2))
    return F.when(x < 0, F.concat(F.lit("-"), amount)).otherwise(amount)


def format_signed_money(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("−"), F.lit("$"), F.format_number(F.abs(x), 2))


def format_number(x: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f", x.cast("double"))


def format_signed(x: Column, decimals: int = 1) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), format_number(x, decimals))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 12th, 13th, 21st."""
    teens = (n % 100).between(11, 13)
    suffix = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def roof_label(roof: Column) -> Column:
    return reduce(lambda out, r: out.when(roof == r[0], r[1]), ROOFS[1:], F.when(roof == ROOFS[0][0], ROOFS[0][1])).otherwise(roof)


def game_label(away: Column, home: Column, game_id: Column) -> Column:
    return F.coalesce(F.concat(away, F.lit(" @ "), home), game_id.cast("string"))


def long_game_label(away: Column, home: Column, game_id: Column) -> Column:
    """Of full team names; the id of an unknown game."""
    return F.coalesce(F.concat(away, F.lit(" at "), home), game_id.cast("string"))


def model_label(name: Column, version: Column, model_id: Column) -> Column:
    """Name and version; the id of an unregistered model, a dash without one."""
    return F.coalesce(F.concat(name, F.lit(" "), version), model_id.cast("string"), F.lit(MISSING))


def pick_label(market: Column, selection: Column, team: Column, line: Column) -> Column:
    side = F.when(selection == "OVER", "Over").otherwise("Under")
    return (
        F.when(market == "MONEYLINE", F.concat(team, F.lit(" to win")))
        .when(market == "SPREAD", F.concat(team, F.lit(" "), format_market_line(market, line)))
        .otherwise(F.concat(side, F.lit(" "), plain_number(line)))
    )


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", "Strong pick").when(confidence == "MEDIUM", "Solid pick").otherwise("Modest edge")


def string_seed(s: Column) -> Column:
    """31 * h + character over the string in 32-bit arithmetic, absolute value."""
    step = lambda h, c: ((h * 31 + F.ascii(c).cast("long") + 2**31) % 2**32 + 2**32) % 2**32 - 2**31
    return F.abs(F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), step))


def record_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id from what identifies the record."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 16))
