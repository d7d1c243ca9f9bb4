"""Alert records, messages, fan-out to channels and history, from screened frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.roads import steady

# Channels, and the longest short message and area name.
CHANNELS = ("SMS", "WHATSAPP", "WEB_PUSH", "EMAIL")
SMS_LENGTH, AREA_LENGTH = 160, 24
LINK = "http://localhost:8000"


def records(frames: DataFrame, area: str, status: str = "Exercise", base: str = "2026-08-21 06:00:00") -> DataFrame:
    """One alert record a screened frame: id, times, severity, headline and the box of its wet cells as a polygon.

    The status 'Actual' is refused: these alerts come from simulations.
    """
    if status == "Actual":
        raise ValueError("alerts of simulated frames cannot have the status 'Actual'")
    start = F.lit(base).cast("timestamp_ntz")
    valid = start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("lead_minutes"))
    corner = lambda r, c: F.concat_ws(",", F.col(r).cast("string"), F.col(c).cast("string"))
    ring = F.concat_ws(" ", corner("min_r", "min_c"), corner("min_r", "max_c"), corner("max_r", "max_c"), corner("max_r", "min_c"), corner("min_r", "min_c"))
    headline = F.concat_ws(" ", F.col("event"), F.lit("for"), F.lit(area), F.lit("- depth"), F.format_string("%.2f m", steady(F.col("max_depth_m"), 2)))
    return frames.select(
        F.concat_ws("-", F.lit("FLOOD"), "scenario_id", F.lpad(F.col("lead_minutes").cast("string"), 3, "0")).alias("alert_id"), "scenario_id", "lead_minutes", F.lit(status).alias("status"), "severity", "urgency", "certainty",
        "color_band", headline.alias("headline"), valid.alias("valid_from"), (valid + F.expr("INTERVAL 2 HOURS")).alias("expires"), ring.alias("polygon"), F.lit(area).alias("area"), "max_depth_m",
        F.concat(F.lit("Water up to "), F.format_string("%.2f m", steady(F.col("max_depth_m"), 2)), F.lit(" in the area.")).alias("description"), F.lit("Avoid waterlogged roads.").alias("instruction"),
    )


def dispatched(alerts: DataFrame, channels: tuple[str, ...] = CHANNELS, link: str = LINK, issuer: str = "Flood early warning") -> DataFrame:
    """Every alert on every channel, with its message, the message's digest and a receipt id. Nothing is sent.

    The short message holds status, severity, area, depth and a link in 160 characters; the rich one headline, summary, advice, link and issuer.
    """
    short = F.substring(F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.upper("severity"), F.lit(" FLOOD: "), F.substring("area", 1, AREA_LENGTH), F.lit(". Depth ~"), F.format_string("%.2f", steady(F.col("max_depth_m"), 2)), F.lit(f"m. Avoid blocked roads. Detour: {link}")), 1, SMS_LENGTH)
    badge = F.when(F.col("severity").isin("Extreme", "Severe"), "[CRITICAL ALERT]").otherwise("[FLOOD ADVISORY]")
    rich = F.concat(badge, F.lit(" *[EXERCISE] "), "headline", F.lit("*\n\n*Summary:* "), "description", F.lit("\n\n*Action Advice:* "), "instruction", F.lit(f"\n\n*Live Dynamic Route:* {link}\n_Issued by {issuer}_"))
    each = alerts.withColumn("channel", F.explode(F.array(*map(F.lit, channels)))).withColumn("message", F.when(F.col("channel") == "SMS", short).otherwise(rich))
    digest = F.sha2("message", 256)
    return each.select("alert_id", "channel", "message", digest.alias("digest"), F.concat(F.lit("rcpt-"), F.substring(F.sha2(F.concat_ws(":", "alert_id", "channel", digest), 256), 1, 12)).alias("receipt_id"))


def history(alerts: DataFrame, most: int) -> DataFrame:
    """The newest alerts (a top-k report); of equal times, by id."""
    return alerts.orderBy(F.desc("valid_from"), "alert_id").limit(most)


def syndicated(alerts: DataFrame) -> DataFrame:
    """An Atom entry for each alert, with its polygon as a GeoRSS element; markup in texts is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    stamp = F.date_format(F.col("valid_from"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(F.lit("<entry><id>"), "alert_id", F.lit("</id><title>"), safe("headline"), F.lit("</title><updated>"), stamp, F.lit("</updated><georss:polygon>"), F.replace(F.col("polygon"), F.lit(","), F.lit(" ")), F.lit("</georss:polygon></entry>"))
    return alerts.select("alert_id", entry.alias("entry"))
