"""Post cleaning, lexicon scoring and daily sentiment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, to_double
from ..functions.text import clean_post
from .ranking import exact_median
from ..session import small_table

# Domain words and their polarity.
DOMAIN_LEXICON = {
    "bullish": 2.4, "moon": 2.1, "mooning": 2.2, "breakout": 1.6, "pump": 1.0,
    "hodl": 1.2, "buythedip": 1.7, "ath": 1.3, "adoption": 1.5, "undervalued": 1.4,
    "bearish": -2.4, "dump": -1.8, "crash": -2.5, "rug": -2.8, "rugpull": -3.0,
    "rekt": -2.2, "liquidated": -2.0, "selloff": -2.1, "overvalued": -1.4, "scam": -2.7,
    "fomo": -0.3, "fud": -1.7,
}
#: Words that turn a polarity round; so does any word that ends in n't.
NEGATIONS = ("no", "not", "never", "none", "nor", "neither", "nobody", "nothing", "nowhere", "cannot", "cant", "dont", "isnt", "wont", "without", "rarely", "seldom", "despite")
#: Degree words: what they add to the size of a polarity.
MORE, LESS = 0.293, -0.293
DEGREES = {
    w: size
    for size, words in (
        (MORE, "very really extremely absolutely completely totally highly hugely incredibly especially particularly so most more deeply truly utterly"),
        (LESS, "slightly somewhat barely hardly almost partly less little marginally occasionally scarcely kinda sorta"),
    )
    for w in words.split()
}
NORMALISER = 15.0
POSITIVE_CUT, NEGATIVE_CUT = 0.05, -0.05
COUNTERS = ("like_count", "retweet_count", "reply_count", "quote_count")
WORD_BREAK = r"[^\p{L}\p{N}']+"


def with_clean_text(posts: DataFrame, text: str = "text") -> DataFrame:
    return posts.withColumn("clean_text", clean_post(text))


def compound(posts: DataFrame, post_id: str, lexicon: Mapping[str, float] | None = None, text: str = "clean_text") -> DataFrame:
    """Normalised lexicon polarity per post; ``post_id`` names one post each, a post without hits or id scores zero.

    The words of the whole text meet the lexicon, whose size Spark knows; only hits leave the map side, summed per post.
    The sums then join the posts, so a caller that no longer selects the text does not shuffle it.
    """
    words = dict(DOMAIN_LEXICON if lexicon is None else lexicon)
    table = small_table(posts.sparkSession, list(words.items()), "word string, polarity double")
    tokens = posts.select(F.col(post_id), F.explode(F.split(F.lower(F.col(text)), WORD_BREAK)).alias("word"))
    total = tokens.join(table, "word").groupBy(post_id).agg(F.sum("polarity").alias("__s"))
    return posts.join(total, post_id, "left").withColumn("compound", _normalised(F.coalesce("__s", F.lit(0.0)))).drop("__s")


# How much a rule counts.
TURN, CAPITALS = -0.74, 0.733
#: A modifier one, two or three words before the hit.
FADING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
STRIP = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _capital(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def rule_compound(
    posts: DataFrame, post_id: str, lexicon: Mapping[str, float] | None = None, text: str = "clean_text",
    negations: Sequence[str] = NEGATIONS, degrees: Mapping[str, float] = DEGREES,
) -> DataFrame:
    """Polarity per post by rules over the words around each hit; ``post_id`` names one post each.

    A word takes its three predecessors along when the text is exploded, so hits meet the lexicon with all they need and no
    text is shuffled.  Degree words before a hit add to its size (the less the farther), a negation turns it round, a hit in
    capitals within a text that is not all capitals counts more, and what stands before the first ``but`` counts less than
    what comes after.  Exclamation and question marks add to the sum.  A post without hits or id scores zero.
    """
    words = dict(DOMAIN_LEXICON if lexicon is None else lexicon)
    table = small_table(posts.sparkSession, list(words.items()), "word string, polarity double")
    degree = F.create_map(*[F.lit(v) for pair in degrees.items() for v in pair]) if degrees else F.create_map().cast("map<string,double>")
    turning = F.array(*[F.lit(w) for w in negations]).cast("array<string>")
    c = F.col
    split = F.transform(F.split(c(text), " "), lambda w: F.regexp_replace(w, STRIP, ""))
    marked = posts.select(F.col(post_id).alias("__id"), split.alias("__w")).withColumns(
        {"__but": F.array_position(F.transform("__w", F.lower), "but") - 1, "__caps": F.size(F.filter("__w", _capital))}
    )
    mixed = (c("__caps") > 0) & (c("__caps") < F.size("__w"))
    token = lambda w, i: F.struct(
        F.lower(w).alias("word"), _capital(w).alias("loud"), i.alias("at"), F.array(*[F.when(i >= k, F.get("__w", i - k)) for k in (1, 2, 3)]).alias("before")
    )
    tokens = marked.select("__id", "__but", mixed.alias("mixed"), F.explode(F.transform("__w", token)).alias("t")).select("__id", "__but", "mixed", "t.*")
    hits = tokens.join(table, "word")
    value = c("polarity") + F.when(c("loud") & c("mixed"), F.signum("polarity") * CAPITALS).otherwise(0.0)
    for k, fade in enumerate(FADING):
        near = F.get("before", F.lit(k))
        low = F.lower(near)
        size = F.coalesce(F.element_at(degree, low), F.lit(0.0))
        size += F.when((size != 0.0) & _capital(near) & c("mixed"), F.signum(size) * CAPITALS).otherwise(0.0)
        # an absent word modifies nothing
        value = value + F.coalesce(F.when(value < 0, -size).otherwise(size), F.lit(0.0)) * fade
        value = F.when(F.array_contains(turning, low) | low.endswith("n't"), value * TURN).otherwise(value)
    value = value * F.when(c("at") < c("__but"), BEFORE_BUT).when((c("at") > c("__but")) & (c("__but") >= 0), AFTER_BUT).otherwise(1.0)
    total = hits.groupBy("__id").agg(F.sum(value).alias("__s"))
    marks = lambda m: F.length(text) - F.length(F.replace(c(text), F.lit(m), F.lit("")))
    asks = marks("?")
    stress = F.least(marks("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + F.when(asks > 3, MANY_QUESTIONS).when(asks > 1, asks * QUESTION).otherwise(0.0)
    kept = posts.join(total, posts[post_id] == total["__id"], "left").drop("__id")
    return kept.withColumn("compound", F.coalesce(_normalised(c("__s") + F.signum("__s") * stress), F.lit(0.0))).drop("__s")


def _normalised(s: Column) -> Column:
    return s / F.sqrt(s * s + NORMALISER)


def with_engagement(posts: DataFrame, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Sum of the counters (missing ones count 0) and the log weight."""
    total = F.lit(0.0)
    for c in counters:
        total = total + (F.coalesce(to_double(c), F.lit(0.0)) if c in posts.columns else F.lit(0.0))
    df = posts.withColumn("engagement", total)
    return df.withColumn("sentiment_weight", F.lit(1.0) + F.log1p("engagement"))


def daily_sentiment(scored: DataFrame, date: str = "date") -> DataFrame:
    """Counts, exact median, shares and weighted mean per day."""
    c = F.col("compound")
    base = scored.groupBy(date).agg(
        F.count(F.lit(1)).alias("x_post_count"),
        F.avg(c).alias("x_sentiment_mean"),
        F.stddev_samp(c).alias("x_sentiment_std"),
        F.avg((c >= POSITIVE_CUT).cast("double")).alias("x_positive_share"),
        F.avg((c <= NEGATIVE_CUT).cast("double")).alias("x_negative_share"),
        F.sum("engagement").alias("x_engagement"),
        F.try_divide(F.sum(c * F.col("sentiment_weight")), F.sum("sentiment_weight")).alias("x_sentiment_weighted"),
    )
    return base.join(exact_median(scored, [date], "compound", "x_sentiment_median"), date, "left")
