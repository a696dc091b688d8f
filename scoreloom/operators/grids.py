"""Row generators: experiment grids, prompts, samples and training corpora from hashed seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.seeds import derive_seed, pick, uniform
from scoreloom.operators.ordinals import numbered


def prompts(questions: DataFrame, formats: DataFrame, crossed: bool) -> DataFrame:
    """(index, question_index, format_index, text): question i gets format i mod F, or all formats."""
    f = F.broadcast(formats.select(F.col("index").alias("format_index"), F.col("text").alias("format")))  # a handful of formats
    n = formats.count()
    q = questions.select(F.col("index").alias("question_index"), F.col("text").alias("question"))
    if crossed:
        out = q.join(f).withColumn("index", F.col("question_index") * n + F.col("format_index"))
    else:
        out = q.withColumn("format_index", F.pmod("question_index", F.lit(n))).join(f, "format_index").withColumn("index", F.col("question_index"))
    return out.select("index", "question_index", "format_index", F.replace(F.col("format"), F.lit("{question}"), F.col("question")).alias("text"))


def expand_samples(rows: DataFrame, samples: int, per_call: int, master: str, *key: str) -> DataFrame:
    """Each prompt in ``samples`` samples, in groups of ``per_call`` with a seed each."""
    out = rows.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    out = out.withColumn("group_index", F.floor(F.col("sample_index") / per_call).cast("int"))
    return out.withColumn("group_seed", derive_seed(master, *[F.col(k) for k in key], F.col("group_index")))


def even_draw(pool: DataFrame, item: str, total: int, seed: str) -> DataFrame:
    """``total`` draws from a pool so that the counts of any two items differ by one at most.

    Every item is drawn total // n times; the rest goes to the items with the
    smallest hashes, found by a top-k rather than a sort of the pool.
    """
    n = pool.count()
    each, rest = divmod(total, n) if n else (0, 0)
    keyed = pool.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")), 256))
    lucky = keyed.orderBy("_h").limit(rest).select(item, F.lit(1).alias("more"))
    return keyed.drop("_h").join(lucky, item, "left").withColumn("times", (F.lit(each) + F.coalesce("more", F.lit(0))).cast("long")).drop("more")


def shard(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """Add ``shard``: the row's ordinal modulo n."""
    return numbered(rows, order, "shard").withColumn("shard", F.pmod("shard", F.lit(n)).cast("int"))


def shard_spec(spec: str) -> tuple[int, int]:
    """(index, count) of ``i/n``; anything else, no shards, or an index beyond them is an error."""
    parts = spec.split("/")
    if len(parts) != 2 or not all(p.strip().isdigit() for p in parts):
        raise ValueError(f"a shard is written i/n, not {spec!r}")
    index, count = map(int, parts)
    if count < 1 or index >= count:
        raise ValueError(f"there is no shard {index} of {count}")
    return index, count


def select_shard(rows: DataFrame, order: list[Column | str], spec: str) -> DataFrame:
    """The rows of one round-robin shard ``i/n`` of a grid."""
    index, count = shard_spec(spec)
    return shard(rows, order, count).where(F.col("shard") == index).drop("shard")


def fake_completion(density: Column, claim: Column, words: list[str], *key: Column) -> Column:
    """A deterministic stand-in for a model: the claim with a chance of ``density``, else eight words."""
    chosen = [F.get(F.lit(words), pick(F.lit(len(words)), *key, F.lit(i))) for i in range(8)]
    return F.when(uniform(*key, F.lit("claim")) < density, claim).otherwise(F.concat_ws(" ", *chosen))
