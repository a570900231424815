"""Recommendation rules: reasons are collected in a fixed order, then the status is decided.

Flags are boolean columns given by name in a dict; a missing flag has its harmless value.
Texts of reasons are fixed values, as they are what a user reads.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.operators.staking import RiskControls

#: Checks that must hold, and the reason if one fails.
CHECKS = (
    ("quarterback_resolved", "Starting quarterback identity unresolved"),
    ("injury_feed_available", "Critical injury feed missing"),
    ("market_price_fresh", "Market price stale"),
    ("manual_price_confirmed", "Manual price not confirmed"),
    ("kickoff_consistent", "Kickoff time conflict"),
    ("venue_consistent", "Venue conflict"),
    ("weather_available", "Weather unavailable for outdoor game"),
    ("model_approved", "Model version not approved"),
    ("prediction_timestamp", "Prediction timestamp missing"),
    ("feature_snapshot", "Feature snapshot missing"),
    ("provider_healthy", "Critical provider failure"),
)
#: Signals to watch.
WATCH = (
    ("better_price", "Selection would qualify at a better price"),
    ("injury_uncertain", "Injury uncertainty remains material"),
    ("weather_uncertain", "Weather uncertainty remains material"),
    ("near_threshold", "Line is close to the target threshold"),
    ("moving", "Market moving toward an acceptable price"),
    ("awaiting_update", "Required official update expected"),
)
INELIGIBLE = "Application mode not eligible for bet recommendations"
AWAITING_MANUAL = "Qualifies on consensus pricing — awaiting recent manually confirmed bet365 price"


def _reasons(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), r) for c, r in pairs)))


def incomplete_reasons(checks: Mapping[str, Column], completeness: Column, controls: RiskControls) -> Column:
    failed = [(~F.coalesce(checks[name], F.lit(False)), reason) for name, reason in CHECKS if name in checks]
    text = F.format_string("Data-completeness score %.2f below minimum %.2f", completeness, F.lit(controls.min_completeness))
    return _reasons(*failed, (completeness < controls.min_completeness, text))


def pass_reasons(ev: Column, edge: Column, std: Column, flags: Mapping[str, Column], controls: RiskControls) -> tuple[Column, Column]:
    """Reasons to pass, and whether all of them concern price or threshold only (soft)."""
    flag = lambda name: F.coalesce(flags.get(name, F.lit(False)), F.lit(False))
    below = F.format_string("Edge %.1f%% below required threshold %.1f%% (demo threshold)", edge * 100, F.lit(controls.min_edge * 100))
    hard = {
        "invalidated": (flag("invalidated"), "Recommendation invalidated by newer information"),
        "uncertain": (std > controls.max_uncertainty, "Uncertainty too high"),
        "exposure": (flag("exposure_exceeded"), "Portfolio exposure would exceed a limit"),
        "aligned": (flag("aligned"), "Model and market are effectively aligned"),
        "disagree": (flag("components_disagree"), "Model components materially disagree"),
    }
    reasons = _reasons(
        hard["invalidated"],
        (ev <= 0, "Expected value is not positive"),
        (edge < controls.min_edge, below),
        hard["uncertain"],
        (flag("price_too_bad"), "Price worse than maximum acceptable price"),
        hard["exposure"],
        hard["aligned"],
        hard["disagree"],
    )
    return reasons, F.size(_reasons(*hard.values())) == 0


def bet_reasons(controls: RiskControls) -> Column:
    texts = (
        "All critical data complete",
        "Manual price recently confirmed",
        "Model approved",
        f"Edge exceeds demo threshold {controls.min_edge * 100:.1f}%",
        "Expected value positive after conservative adjustments",
        "Uncertainty acceptable",
        "Portfolio exposure within limits",
    )
    return F.array(*map(F.lit, texts))


def decide(
    checks: Mapping[str, Column], completeness: Column, ev: Column, edge: Column, std: Column,
    flags: Mapping[str, Column], watch: Mapping[str, Column], controls: RiskControls, eligible: Column | bool = True,
) -> Column:
    """struct<status, reasons>: incomplete data first, then passes (watched if soft), mode, watch, bet."""
    incomplete = incomplete_reasons(checks, completeness, controls)
    passes, soft = pass_reasons(ev, edge, std, flags, controls)
    watched = _reasons(*((watch[name], reason) for name, reason in WATCH if name in watch))
    eligible = eligible if isinstance(eligible, Column) else F.lit(eligible)
    any_of = lambda reasons: F.size(reasons) > 0
    decision = lambda status, reasons: F.struct(F.lit(status).alias("status"), reasons.alias("reasons"))
    return (
        F.when(any_of(incomplete), decision("DATA INCOMPLETE", incomplete))
        .when(any_of(passes) & soft & any_of(watched), decision("WATCH", F.concat(watched, passes)))
        .when(any_of(passes), decision("PASS", passes))
        .when(~eligible, decision("WATCH", F.concat(F.array(F.lit(INELIGIBLE)), watched)))
        .when(any_of(watched), decision("WATCH", watched))
        .otherwise(decision("BET", bet_reasons(controls)))
    )


def downgrade_without_manual_price(decision: Column, manual_fresh: Column) -> Column:
    """A bet needs a recently confirmed manual price; without one it is watched."""
    stale = (decision["status"] == "BET") & ~F.coalesce(manual_fresh, F.lit(False))
    watched = F.struct(F.lit("WATCH").alias("status"), F.concat(F.array(F.lit(AWAITING_MANUAL)), decision["reasons"]).alias("reasons"))
    return F.when(stale, watched).otherwise(decision)


def pass_below_minimum(decision: Column, stake: Column, minimum: float = 1.0) -> Column:
    """A bet whose stake is below the minimum is passed, with a reason that names the bound."""
    small = (decision["status"] == "BET") & (stake["amount"] < minimum)
    text = F.format_string(
        f"Remaining risk-limit room ($%.2f) is below the ${minimum:.2f} minimum viable stake — %s is nearly exhausted", stake["amount"], stake["bound"]
    )
    passed = F.struct(F.lit("PASS").alias("status"), F.concat(F.array(text), decision["reasons"]).alias("reasons"))
    return F.when(F.coalesce(small, F.lit(False)), passed).otherwise(decision)
