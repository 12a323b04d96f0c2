"""A waiting list with referrals: joining is idempotent by e-mail, counts are by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE_CHARS = 10


def code_of(email: Column, salt: str) -> Column:
    """A referral code; the salt keeps it from being guessed from the address."""
    return F.substring(F.sha2(F.concat(F.lit(salt), email), 256), 1, CODE_CHARS)


def referrals(members: DataFrame) -> DataFrame:
    """ref_code, referrals: how many came by each code."""
    return members.where("referred_by is not null").groupBy(F.col("referred_by").alias("ref_code")).agg(F.count("*").alias("referrals"))


def status(members: DataFrame, codes: DataFrame) -> DataFrame:
    """The codes with their referrals, 0 for unknown ones."""
    return codes.join(referrals(members), "ref_code", "left").withColumn("referrals", F.coalesce("referrals", F.lit(0)))


def joined(members: DataFrame, requests: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """The members after the requests, and an answer for each request: seq, ref_code, referrals, error.

    ``members``: name, email, profession, ref_code, referred_by. ``requests``: seq, name, email, profession, ref. Of requests with one
    address the first joins; a referral by a code that no member has counts as none; name and address are required.
    """
    r = requests.select("seq", F.trim("name").alias("name"), F.lower(F.trim("email")).alias("email"), F.nullif(F.trim("profession"), F.lit("")).alias("profession"), "ref")
    fine = (F.coalesce(F.length("name"), F.lit(0)) > 0) & (F.coalesce(F.length("email"), F.lit(0)) > 0)
    known = members.select(F.lower("email").alias("email"), F.col("ref_code").alias("own_code"))
    first = F.row_number().over(Window.partitionBy("email").orderBy("seq")) == 1
    new = r.where(fine).join(known, "email", "left_anti").withColumn("_first", first).where("_first").drop("_first")
    codes = members.select(F.col("ref_code").alias("ref"), F.col("ref_code").alias("referred_by")).distinct()
    new = new.join(codes, "ref", "left").select("name", "email", "profession", code_of(F.col("email"), salt).alias("ref_code"), "referred_by")
    after = members.select(*new.columns).unionByName(new)
    codes = after.select(F.lower("email").alias("email"), "ref_code")
    answers = r.withColumn("error", F.when(~fine, "name and email are required")).join(codes, "email", "left")
    answers = status(after, answers.select("seq", "error", F.when(F.col("error").isNull(), F.col("ref_code")).alias("ref_code")))
    return after, answers.select("seq", "ref_code", F.when(F.col("error").isNull(), F.col("referrals")).alias("referrals"), "error")
