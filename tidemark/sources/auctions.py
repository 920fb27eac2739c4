"""A deterministic auction stream (persons, auctions, bids) in closed form, from ``spark.range``.

Row i (from 1) is a formula of i, so any part of the stream can be made anywhere, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_700_000_000_000
#: Fixed values of the stream.
CHANNELS = ["web", "apple", "google", "facebook", "baidu"]
STATES = ["or", "id", "ca", "wa", "ny", "tx"]


def _pick(values: list[str], i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _time(i, plus: int = 0):
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i + BASE_MS + plus).cast("decimal(24,6)") / 1000)


def bids(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    i = F.col("i")
    auction, channel = (i - 1) % 10_000 + 1, _pick(CHANNELS, i)
    url = F.concat(F.lit("https://example.com/dir"), (auction % 11).cast("string"), F.lit("/item/"), i.cast("string"), F.lit("?q=1"), F.when(channel == "web", F.concat(F.lit("&channel_id="), (i % 97).cast("string"))).otherwise(""))
    return spark.range(first, first + n).select(F.col("id").alias("i")).select(auction.alias("auction"), (i + 10_000).alias("bidder"), (i % 50_000 + 1_000).alias("price"), channel.alias("channel"), url.alias("url"), _time(i).alias("date_time"), F.lit("").alias("extra"))


def auctions(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    i, s = F.col("i"), F.col("i").cast("string")
    initial = i % 25_000 + 5_000
    return spark.range(first, first + n).select(F.col("id").alias("i")).select(i.alias("id"), F.concat(F.lit("item_"), s).alias("item_name"), F.concat(F.lit("auction_description_"), s).alias("description"), initial.alias("initial_bid"), (initial + 500).alias("reserve"), (i + 50_000).alias("seller"), ((i - 1) % 10 + 1).alias("category"), _time(i, 86_400_000).alias("expires"), _time(i).alias("date_time"), F.lit("").alias("extra"))


def persons(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    i, s = F.col("i"), F.col("i").cast("string")
    return spark.range(first, first + n).select(F.col("id").alias("i")).select((i + 50_000).alias("id"), F.concat(F.lit("person_"), s).alias("name"), F.concat(F.lit("person_"), s, F.lit("@example.com")).alias("email_address"), F.concat(F.lit("0000-0000-0000-"), F.lpad(s, 4, "0")).alias("credit_card"), F.concat(F.lit("city_"), (i % 101).cast("string")).alias("city"), _pick(STATES, i).alias("state"), _time(i).alias("date_time"), F.lit("").alias("extra"))
