"""Cash gifts and received regular-giving income."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.functions import text
from givetide.operators.history import descriptor, rolling_sms_appeals

CASH_GIFT = 1


def _cash_appeals(w) -> DataFrame:
    """Appeal key -> identifier, campaign of each appeal sharing it, and rolling SMS flag."""
    rolling = rolling_sms_appeals(w.package).select(text.fold(F.col("rolling_sms_appeal")).alias("_rolling")).distinct()
    shared = w.appeal.select(
        text.fold(F.col("appeal_identifier")).alias("_k"), F.col("campaign_description").alias("_campaign")
    )
    return (
        w.appeal.select("appeal_id", "appeal_identifier")
        .join(shared, text.fold(F.col("appeal_identifier")) == F.col("_k"))
        .join(rolling, F.col("_k") == F.col("_rolling"), "left")
        .select("appeal_id", "appeal_identifier", "_campaign", F.col("_rolling").isNotNull().alias("rolling_sms"))
    )


def _appeal_attributes(w, category: str, name: str) -> DataFrame:
    def build() -> DataFrame:
        return (
            w.appeal_attribute.filter(text.same(F.col("attribute_category"), category))
            .join(w.appeal.select("appeal_id"), "appeal_id")
            .select("appeal_id", F.col("attribute_description").alias(name))
        )

    return w.dimension(f"appeal_{name}", build)


def cash_gift_facts(w) -> DataFrame:
    """Cash gifts with team descriptor, product, audience and gift code.

    Product and audience are attributes of the gift's appeal. An audience stored on the
    gift itself overrides the appeal's, but is read only where the appeal has one.
    """
    products = _appeal_attributes(w, "Product", "product")
    audiences = _appeal_attributes(w, "Target Audience", "_appeal_audience")
    with_audience = audiences.select("appeal_id").distinct().withColumn("_has_audience", F.lit(True))
    overrides = w.gift_attribute.filter(
        text.same(F.col("attribute_category"), "Target Audience") & F.col("attribute_description").isNotNull()
    ).select(F.col("gift_id").alias("_override_gift"), F.col("attribute_description").alias("_override"))

    days = w.calendar.select(F.col("date_key").alias("gift_date_key"), "month")
    codes = w.gift_code.select(F.col("gift_code_id").alias("_code"), F.col("gift_code_description").alias("gift_code"))
    gifts = w.gift.filter(F.col("gift_type_id") == CASH_GIFT).select(
        "gift_id", "constituent_key", "gift_date_key", "amount", "appeal_id", "team_id", "gift_code_id"
    )
    # The joins that move gifts come first, while these hold nothing but numbers.
    return (
        gifts.join(with_audience, "appeal_id", "left")
        .join(overrides, F.col("_has_audience") & (F.col("gift_id") == F.col("_override_gift")), "left")
        .join(w.constituent.select("constituent_key", "constituent_id"), "constituent_key")
        .join(days, "gift_date_key")
        .join(w.team.select("team_id", "team"), "team_id")
        .join(w.dimension("cash_appeals", lambda: _cash_appeals(w)), "appeal_id")
        .join(codes, (F.col("gift_code_id") > -1) & (F.col("gift_code_id") == F.col("_code")), "left")
        .join(products, "appeal_id", "left")
        .join(audiences, "appeal_id", "left")
        .select(
            "constituent_id",
            "gift_id",
            "month",
            "amount",
            "appeal_identifier",
            "rolling_sms",
            "gift_code",
            "product",
            F.coalesce("_override", "_appeal_audience").alias("audience"),
            descriptor(F.col("team"), F.col("_campaign")).alias("descriptor"),
        )
    )
