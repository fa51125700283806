"""Mixing sources to target weights.

A time-varying curriculum: each source has a weight schedule over training time. Its integral is the source's
cumulative token demand; inverting it gives each text, by its place in the source's cumulative tokens, a training
position; texts are then range-sorted by position.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind split text.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts into which each source is cut for running sums.
BUCKETS = 1024
#: How strongly weights change over time: 0 keeps them constant; below 1, so that no weight reaches 0.
TILT = 0.5


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds ``tokens`` to ``rows``; a null text has 0. ``tokenizer`` is a rank file that every worker can read."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.Series([0 if t is None else len(encode(t)) for t in b], dtype="int64")

    # not deterministic for the optimiser, so that a filter on the count does not count a second time
    return rows.withColumn("tokens", count.asNondeterministic()(F.col(text)))


def source_name(col) -> F.Column:
    """One spelling of a source's name: lower case, trimmed, words joined by hyphens."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_]+", "-")


def mix_targets(targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats): one row each, shares as fractions.

    A mix whose shares sum to more than 1.5 is stated in per cent. Repeated spellings of a source add up their
    shares and keep the smallest cap. Null or negative shares count as 0. A null cap means no cap; caps below 1 exclude the source.
    """
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    one = (
        targets.where("mix_name is not null and source is not null").select("mix_name", "source", "target_share", "max_repeats").distinct()
        .groupBy("mix_name", source_name(F.col("source")).alias("source")).agg(F.sum(share).alias("s"), F.min("max_repeats").alias("max_repeats"))
    )
    total = F.sum("s").over(Window.partitionBy("mix_name"))
    return one.select("mix_name", "source", (F.col("s") / F.when(total > 1.5, 100.0).otherwise(1.0)).alias("target_share"), "max_repeats")


def text_supply(docs: DataFrame, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, doc, tokens, before): distinct texts with the tokens of their source that come before them.

    Copies of a text count once, under the copy with the lowest key that names a source. Texts without tokens or
    source are left out. The order within a source is by a hash of the key. Running sums are taken in
    ``BUCKETS`` parts of each source, so a source that holds much of the corpus is spread over as many groups.
    """
    sized = count_tokens(docs.select(F.col(key).alias("doc"), source_name(F.col(source)).alias("source"), F.col(text).alias("_text")).where("_text is not null and source is not null and source != ''"), "_text", tokenizer)
    hashed = sized.select("doc", "source", "tokens", F.unhex(F.md5("_text")).alias("_h")).where("tokens > 0")
    # written once: each text is read and counted once, whatever reads the sizes afterwards
    texts = materialize(hashed.groupBy("_h").agg(F.min_by(F.struct("doc", "source", "tokens"), "doc").alias("_t")).select("_t.*"), "sizes")
    place = F.shiftrightunsigned(F.xxhash64("doc"), 1)
    texts = texts.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 53).cast("int"))
    w = Window.partitionBy("source", "_part").orderBy("_place", "doc")
    inside = texts.withColumn("_sum", F.sum("tokens").over(w)).withColumn("_last", F.sum("tokens").over(Window.partitionBy("source", "_part")))
    parts = texts.groupBy("source", "_part").agg(F.sum("tokens").alias("_n"))
    ahead = parts.select("source", "_part", (F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return inside.join(ahead, ["source", "_part"]).select("source", "doc", "tokens", (F.col("_ahead") + F.col("_sum") - F.col("tokens")).alias("before"))


def plan_mix(supply: DataFrame, targets: DataFrame, total_tokens: int | None = None, tilt: float = TILT) -> DataFrame:
    """What each mix takes of each source: (mix_name, source, target_share, max_repeats, supply, texts, longest, total, demand, slope).

    Without ``total_tokens`` a mix is as large as the caps let all its sources reach their shares; a mix without caps
    is as large as its sources. With it, sources stop at their cap. Shares of sources that have no texts go to the others in proportion.
    Weights change over time by ``tilt``: sources of short texts come more at the beginning, those of long texts
    at the end, so that all weights sum to 1 at any time.
    """
    have = supply.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("texts"), F.max("tokens").alias("longest"))
    known = targets.join(have, "source", "left")
    usable = F.col("supply").isNotNull() & (F.col("target_share") > 0) & (F.coalesce("max_repeats", F.lit(1)) >= 1)
    mix = Window.partitionBy("mix_name")
    shares = known.withColumn("_use", F.when(usable, F.col("target_share")).otherwise(0.0)).withColumn("_share", F.col("_use") / F.nullif(F.sum("_use").over(mix), F.lit(0.0)))
    most = F.col("supply") * F.col("max_repeats")
    total = F.lit(float(total_tokens)) if total_tokens else F.coalesce(F.min(F.when(F.col("_use") > 0, most / F.col("_share"))).over(mix), F.sum(F.when(F.col("_use") > 0, F.col("supply"))).over(mix))
    sized = shares.withColumn("total", total.cast("double")).withColumn("demand", F.coalesce(F.least(F.col("_share") * F.col("total"), most.cast("double")), F.lit(0.0)))
    by_length = Window.partitionBy("mix_name").orderBy(F.col("supply") / F.col("texts"), "source")
    middle = F.sum("_share").over(by_length.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_share") / 2
    return sized.withColumn("slope", F.coalesce(F.lit(float(tilt)) * (2 * middle - 1), F.lit(0.0))).drop("_use", "_share")


def mix_texts(supply: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, source, doc, copy, tokens, position), range-sorted by mix and position.

    ``copy`` counts a text's uses from 0. A use belongs to the mix if its middle lies within the source's demand.
    position is the training time in tokens at which the source's cumulative demand reaches the text.
    """
    taken = plan.where("demand > 0").select("mix_name", "source", "supply", "total", "demand", "slope", "max_repeats")
    # one row per mix and source; sources are joined by name, and a large source spreads by the adaptive skew join
    used = supply.join(taken, "source").where((F.col("before") + F.col("tokens") / 2) <= F.col("demand"))
    fits = F.floor((F.col("demand") - F.col("before") - F.col("tokens") / 2) / F.col("supply"))
    last = F.least(fits, F.coalesce(F.col("max_repeats").cast("long"), fits + 1) - 1)
    uses = used.where(last >= 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    x = F.least((F.col("copy") * F.col("supply") + F.col("before") + F.col("tokens") / 2) / F.col("demand"), F.lit(1.0))
    a = F.col("slope")
    # demand up to time t is t + a (t^2 - t), in parts of the whole
    t = F.when(F.abs(a) < 1e-9, x).otherwise((-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a))
    return uses.select("mix_name", "source", "doc", F.col("copy").cast("int").alias("copy"), "tokens", (t * F.col("total")).alias("position")).orderBy("mix_name", "position", "source", "doc", "copy")


def mix_checks(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, capped, reached, repeated) for every target: what must hold of any mix.

    capped: no text is used more often than allowed. reached: the source has the tokens that the plan asks of it, give or take
    its longest text. repeated: a text is used again only after all texts of its source have been used as often.
    """
    per_doc = mixed.groupBy("mix_name", "source", "doc").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    got = per_doc.groupBy("mix_name", "source").agg(F.sum("t").alias("t"), F.max("n").alias("most"), F.min("n").alias("least"), F.count(F.lit(1)).alias("docs"))
    rows = plan.join(got, ["mix_name", "source"], "left")
    none = F.col("t").isNull()
    return rows.select(
        "mix_name", "source", "target_share", (none | F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))).alias("capped"),
        (F.abs(F.coalesce("t", F.lit(0)) - F.col("demand")) <= F.coalesce("longest", F.lit(0))).alias("reached"),
        (none | (F.col("most") - F.when(F.col("docs") < F.col("texts"), F.lit(0)).otherwise(F.col("least")) <= 1)).alias("repeated"),
    )


def mix_shares(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, texts, uses, most_uses) for every target."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc").alias("texts"), F.count(F.lit(1)).alias("uses"), (F.max("copy") + 1).alias("most_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = plan.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", *[zero(c) for c in ("tokens", "texts", "uses", "most_uses")])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
