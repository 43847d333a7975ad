"""Problem 9: mix sources to target shares of tokens, without sorting.

A document's place in its source is a 64-bit hash of its id. Tokens are summed by source and the first bits of the hash;
running sums over these few buckets find the bucket in which a source's budget ends, and only that bucket is divided
again by the next bits, three times in all. What remains is one threshold a source, and a filter. Budgets nest: a
greater budget keeps all that a smaller one holds.

A source with a budget of r times its size gives each document floor(r) times, and those under the threshold once more;
r is at most max_repeats. The total against which shares are measured is the token size of all documents. Sources
without a target are left out; a target without documents is reported with nothing. Null sources and null texts have no
target and no tokens. Repeated ids fall on one side together; of repeated target rows the first by share holds; extra
columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import Memo, map_rows

#: Ranks of a public byte-level tokenizer and its pattern of pieces: the place is a parameter.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash that each of the rounds divides by.
BITS, ROUNDS = 12, 3


def token_counts(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens, place): pieces are counted once and remembered, as a text's tokens are its pieces'."""

    def make():  # noqa: ANN202
        import regex
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        pieces = regex.compile(pattern)
        known = Memo(lambda piece: len(encoding.encode_ordinary(piece)), 400_000)

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for key, source, text, place in rows:
                yield key, source, sum(map(known.__getitem__, pieces.findall(text))) if text else 0, place

        return step

    number = pa.int64()
    chosen = docs.select("doc_id", "source", "text", F.xxhash64(F.col("doc_id")).alias("place"))
    return map_rows(chosen, make, "doc_id bigint, source string, tokens bigint, place bigint", [("doc_id", number), ("source", pa.string()), ("tokens", number), ("place", number)])


def _settled(df: DataFrame) -> DataFrame:
    """A table with a row a target as rows of its own, so that later rounds do not compute it again; targets are few by definition."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def budgets(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: source, target_share, max_repeats, source_tokens, total_tokens, budget, whole (copies of all), part (tokens of the rest)."""
    first = Window.partitionBy("source").orderBy(F.desc("target_share"), "max_repeats")
    own = targets.where("source is not null").withColumn("k", F.row_number().over(first)).where("k = 1").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1.0)).alias("max_repeats"))
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = sums.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("total_tokens"))
    joined = own.join(sums, "source", "left").join(total).fillna({"source_tokens": 0})
    repeats = F.when(F.col("source_tokens") > 0, F.least(F.col("target_share") * F.col("total_tokens") / F.col("source_tokens"), F.col("max_repeats"))).otherwise(F.lit(0.0))
    return joined.withColumn("repeats", F.greatest(repeats, F.lit(0.0))).withColumn("whole", F.floor("repeats")).withColumn("part", (F.col("repeats") - F.col("whole")) * F.col("source_tokens"))


def thresholds(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, edge): documents with an unsigned place below ``edge`` get one copy more; a place is compared by its top bits."""
    # Places as unsigned: the sign bit is turned over and the order of signed numbers is that of the hash.
    state = _settled(wanted.select("source", "part", F.lit(0).cast("bigint").alias("prefix")))
    docs = counted.select("source", "tokens", "place")
    for k in range(1, ROUNDS + 1):
        shift = 64 - k * BITS
        bucket = F.shiftrightunsigned("place", shift)
        inside = docs.join(F.broadcast(state), "source").where(F.shiftrightunsigned("place", shift + BITS) == F.col("prefix")) if k > 1 else docs.join(F.broadcast(state), "source")
        sums = inside.groupBy("source", "part", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** BITS rows a source
        ran = sums.withColumn("upto", F.sum("n").over(run))
        # All buckets that fit are in; the next one is divided further with what is left.
        fits = ran.groupBy("source", "part").agg(F.max(F.when(F.col("upto") <= F.col("part"), F.col("upto"))).alias("held"), F.min(F.when(F.col("upto") > F.col("part"), F.col("bucket"))).alias("next"))
        now = fits.select("source", F.coalesce("held", F.lit(0)).alias("held"), "next")
        state = _settled(state.join(now, "source", "left").select("source", (F.col("part") - F.coalesce("held", F.lit(0))).alias("part"), F.coalesce("next", F.shiftleft(F.col("prefix"), BITS) + (1 << BITS)).alias("prefix")))
    return state.select("source", F.col("prefix").alias("edge"))


def mix(docs: DataFrame, targets: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document in the mix."""
    from siftline.session import checkpoint

    counted = checkpoint(token_counts(docs, ranks))
    wanted = _settled(budgets(counted, targets))
    edges = thresholds(counted, wanted)
    plan = wanted.select("source", "whole").join(edges, "source", "left")
    top = F.shiftrightunsigned("place", 64 - ROUNDS * BITS)
    copies = F.col("whole") + F.when(top < F.col("edge"), 1).otherwise(0)
    return counted.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def shares(docs: DataFrame, targets: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The report: target and actual share and average repeats of each target."""
    from siftline.session import checkpoint

    counted = checkpoint(token_counts(docs, ranks))
    wanted = _settled(budgets(counted, targets))
    edges = thresholds(counted, wanted)
    top = F.shiftrightunsigned("place", 64 - ROUNDS * BITS)
    plan = wanted.select("source", "whole").join(edges, "source", "left")
    got = counted.join(F.broadcast(plan), "source").groupBy("source").agg(F.sum(F.col("tokens") * (F.col("whole") + F.when(top < F.col("edge"), 1).otherwise(0))).alias("mixed_tokens"))
    return (
        wanted.join(got, "source", "left").fillna({"mixed_tokens": 0})
        .select("source", "target_share", "max_repeats", "source_tokens", "mixed_tokens", F.round(F.col("mixed_tokens") / F.col("total_tokens"), 6).alias("actual_share"), F.round(F.when(F.col("source_tokens") > 0, F.col("mixed_tokens") / F.col("source_tokens")), 6).alias("average_repeats"))
    )
