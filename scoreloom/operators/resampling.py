"""Bootstrap intervals and permutation tests with counter-based random streams.

Every draw is a hash of (stream, replicate, slots), so results do not depend
on partitions, and a lost task draws the same again. Replicates are rows, so
they spread over the cluster; what is resampled is one nested array per group
(hits and samples of probes of seeds), whose size is that of an experiment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Draws of the bootstrap, of the permutation tests and of the interval reports.
RESAMPLES, PERMUTATIONS, INTERVAL_RESAMPLES = 10_000, 10_000, 4_000


def draw(n: Column, *key: Column | str) -> Column:
    """A place 0 .. n - 1 from a hash of the key."""
    return F.pmod(F.xxhash64(*key), n).cast("int")


def nested(rows: DataFrame, hit: str, *by: str) -> DataFrame:
    """``seeds``: per group an array of seeds, each an array of probes in order of their ids; a probe is its hits ``h`` of ``n``."""
    probes = rows.groupBy(*by, "seed", "probe").agg(F.count_if(F.col(hit).cast("boolean")).cast("int").alias("h"), F.count(F.lit(1)).cast("int").alias("n"))
    per = probes.groupBy(*by, "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("probe", "h", "n"))), lambda x: F.struct(x["h"], x["n"])).alias("probes"))
    return per.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "probes"))), lambda x: x["probes"]).alias("seeds"))


def total(probes: Column) -> Column:
    """Hits and samples of an array of probes, summed."""
    return F.aggregate(probes, F.struct(F.lit(0).alias("h"), F.lit(0).alias("n")), lambda a, x: F.struct((a["h"] + x["h"]).alias("h"), (a["n"] + x["n"]).alias("n")))


def rate_of(probes: Column) -> Column:
    """The pooled rate of an array of probes."""
    return F.get(F.transform(F.array(total(probes)), lambda t: t["h"] / t["n"]), F.lit(0))


def middle(values: Column) -> Column:
    """The interpolated median of an array."""
    return F.get(F.transform(F.array(F.array_sort(values)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2), F.lit(0))


#: Parts that the replicates of a group are dealt in.
PARTS = 64


def replicates(groups: DataFrame, n: int) -> DataFrame:
    """Each group ``n`` times, numbered from 1. A group is sent PARTS times at most; the rest is made where it is used."""
    groups = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, n) - 1))))
    dealt = groups.repartition("_part", F.xxhash64(*groups.columns))
    numbers = F.sequence(F.col("_part") + 1, F.lit(n), F.lit(min(PARTS, n)))
    return dealt.withColumn("replicate", F.explode(numbers)).drop("_part")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(key: int, purpose: int, counters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places 0 .. n - 1 from hashes of counters; ``n`` is broadcast."""
    base = _mix(np.array([(key + purpose * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64))
    u = _mix(_mix(counters.astype(np.uint64)) ^ base) >> np.uint64(11)
    return (u * 2.0**-53 * n).astype(np.int64)


def _resampled(seeds: list, key: int, numbers: np.ndarray, draw_seeds: bool) -> np.ndarray:
    """Rates of drawn probes, of the one seed or of drawn seeds, for each replicate: an array (replicate, seed slot).

    ``seeds``: lists of probes (h, n). A seed's probes are drawn with
    replacement, as many as it has, and each drawn probe's samples anew.
    """
    width = max(len(s) for s in seeds)
    h, n = (np.array([[p[k] for p in s] + [0] * (width - len(s)) for s in seeds], np.int64) for k in ("h", "n"))
    size, most = np.array([len(s) for s in seeds]), max(1, int(n.max()))
    slots = np.arange(len(seeds))
    at = numbers[:, None] * len(seeds) + slots
    own = _places(key, 1, at, np.array(len(seeds))) if draw_seeds else np.broadcast_to(slots, at.shape)
    at = at[:, :, None] * width + np.arange(width)
    probe = _places(key, 2, at, size[own][:, :, None])
    used = np.arange(width) < size[own][:, :, None]
    hh, nn = h[own[:, :, None], probe] * used, n[own[:, :, None], probe] * used
    at = at[..., None] * most + np.arange(most)
    # samples of a probe differ in nothing but being hits, so a drawn place below h is a hit
    hit = (_places(key, 3, at, nn[..., None]) < hh[..., None]) & (np.arange(most) < nn[..., None])
    return hit.sum(axis=(2, 3)) / nn.sum(axis=2)


def bootstrap(groups: DataFrame, values: str, n: int, stream: str, *by: str) -> DataFrame:
    """(by, replicate, value) for ``n`` two-level bootstrap replicates of each group.

    ``values``: ``seeds``, for the median of the rates of drawn seeds, or
    ``probes``, for the pooled rate of drawn probes. Draws are hashes of
    (stream, by, replicate, slots). Replicates are dealt in PARTS parts and
    drawn in Arrow batches; memory is bounded by a few replicates.
    """
    median = values == "seeds"
    parts = min(PARTS, n)
    rows = groups.select(*by, values, F.xxhash64(F.lit(stream), *by).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    rows = rows.repartition("_part", "_key")
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField("replicate", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                given = batch.column(len(by))[i].as_py()
                seeds = given if median else [given]
                key, part = batch.column(len(by) + 1)[i].as_py(), batch.column(len(by) + 2)[i].as_py()
                cells = max(1, len(seeds) * max(len(s) for s in seeds) * max(p["n"] for s in seeds for p in s))
                numbers = np.arange(part + 1, n + 1, parts)
                for lo in range(0, len(numbers), max(1, 2_000_000 // cells)):
                    own = numbers[lo : lo + max(1, 2_000_000 // cells)]
                    rates = _resampled(seeds, key, own, median)
                    out = np.median(rates, axis=1) if median else rates[:, 0]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(own), batch.schema.field(c).type) for c in range(len(by))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own, pa.int32()), pa.array(out, pa.float64())], names=[*by, "replicate", "value"])

    return rows.mapInArrow(run, schema)


def percentile_bounds(draws: DataFrame, value: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """lo and hi at the ranks max(0, int(a/2 n) - 1) and min(n - 1, int((1 - a/2) n)) of the sorted draws."""
    s = draws.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("s"))
    n = F.size("s")
    lo = F.greatest(F.lit(0), F.floor(F.lit(alpha / 2) * n) - 1).cast("int")
    hi = F.least(n - 1, F.floor(F.lit(1 - alpha / 2) * n)).cast("int")
    return s.select(*by, F.get("s", lo).alias("lo"), F.get("s", hi).alias("hi"), n.cast("long").alias("resamples"))


def median_interval(groups: DataFrame, by: list[str], n: int, stream: str) -> DataFrame:
    """Point, bounds, spread, modes and shape flag of the median over seeds; two-level bootstrap."""
    rates = F.transform("seeds", rate_of)
    point = groups.select(*by, rates.alias("observed")).withColumns({"point": middle(F.col("observed")), "seeds": F.size("observed").cast("long"), "low": F.array_min("observed"), "high": F.array_max("observed")})
    draws = bootstrap(groups, "seeds", n, stream, *by).withColumnRenamed("value", "m")
    modes = draws.join(point.select(*by, ((F.col("low") + F.col("high")) / 2).alias("mid")), by).groupBy(*by).agg(F.count_if(F.col("m") < F.col("mid")).alias("below"), F.count_if(F.col("m") >= F.col("mid")).alias("above"))
    out = point.join(percentile_bounds(draws, "m", *by), by).join(modes, by)
    return out.select(*by, "point", "lo", "hi", "seeds", (F.col("high") - F.col("low")).alias("spread"), "below", "above", (F.col("seeds") >= 5).alias("distributional"), "resamples")


def permutation_counts(samples: DataFrame, n: int, stream: str, *by: str) -> DataFrame:
    """Monte-Carlo permutation tests of the difference of medians: (by, observed, two_sided, one_sided) counts of n.

    ``samples``: a row with arrays a and b for each test. A replicate orders
    the pool by the SHA-256 of (stream, by, replicate, place) and takes the
    first |a|, so each test has a stream of its own.
    """
    pool = samples.withColumns({"pool": F.concat("a", "b"), "observed": middle(F.col("a")) - middle(F.col("b"))})
    rows = replicates(pool, n)
    keyed = F.transform("pool", lambda x, i: F.struct(F.sha2(F.concat_ws("|", F.lit(stream), *[F.col(c).cast("string") for c in by], F.col("replicate"), i), 256).alias("k"), x.alias("x")))
    rows = rows.withColumn("o", F.transform(F.array_sort(keyed), lambda r: r["x"]))
    k = F.size("a")
    diff = middle(F.slice("o", F.lit(1), k)) - middle(F.slice("o", k + 1, F.size("o") - k))
    return rows.select(*by, "observed", diff.alias("d")).groupBy(*by, "observed").agg(F.count_if(F.abs("d") >= F.abs("observed") - 1e-12).alias("two_sided"), F.count_if(F.col("d") >= F.col("observed") - 1e-12).alias("one_sided"))


def ordered_tests(tests: DataFrame, n: int, stream: str, place: str = "place", size: str = "size") -> DataFrame:
    """(tests' columns, status, observed, two_sided, one_sided): permutation tests in order, with one random stream for all.

    ``tests``: a row for each registered test with its place, the values it was
    registered for (``size``) and arrays a and b, null while it is pending. A
    test's counters begin where those of the tests before it end: ``n`` times
    their registered sizes, whether they are done or pending. So a test's draws
    stay as they are when another's data arrive, go or change. Values beyond
    the registered size are an error. The registered tests are a handful and
    are numbered in one task.
    """
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = tests.withColumn("_from", F.coalesce(F.sum(F.col(size).cast("long") * n).over(before), F.lit(0)))
    have = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.size("a") > 0) & (F.size("b") > 0)
    rows = rows.withColumn("status", F.when(have, "done").otherwise("pending"))
    pool = rows.where("status = 'done'").withColumns({"pool": F.concat("a", "b"), "observed": middle(F.col("a")) - middle(F.col("b"))})
    fits = F.when(F.size("pool") <= F.col(size), F.col("pool")).otherwise(F.raise_error(F.lit("more values than the test was registered for")).cast(dict(pool.dtypes)["pool"]))
    drawn = replicates(pool.select(place, size, "_from", "a", fits.alias("pool"), "observed"), n)
    counter = F.col("_from") + (F.col("replicate") - 1) * F.col(size)
    keyed = F.transform("pool", lambda x, i: F.struct(F.sha2(F.concat_ws("|", F.lit(stream), counter + i), 256).alias("k"), x.alias("x")))
    drawn = drawn.withColumn("o", F.transform(F.array_sort(keyed), lambda r: r["x"]))
    k = F.size("a")
    d = middle(F.slice("o", F.lit(1), k)) - middle(F.slice("o", k + 1, F.size("o") - k))
    counts = drawn.select(place, "observed", d.alias("d")).groupBy(place, "observed").agg(F.count_if(F.abs("d") >= F.abs("observed") - 1e-12).alias("two_sided"), F.count_if(F.col("d") >= F.col("observed") - 1e-12).alias("one_sided"))
    return rows.drop("_from").join(counts, place, "left")


def stratified_permutation(values: DataFrame, n: int, stream: str) -> DataFrame:
    """(observed, two_sided, one_sided): the difference of medians of a and b over all strata, labels permuted within them.

    ``values``: stratum, is_a, v, and i, which tells a stratum's values apart
    and orders them before each draw. A replicate orders a stratum's values by
    the SHA-256 of (stream, replicate, stratum, i) and takes the first as a's,
    as many as it has. The values are one row: those of an experiment's cells.
    """
    per = values.groupBy("stratum").agg(F.count_if("is_a").cast("int").alias("na"), F.array_sort(F.collect_list(F.struct("i", "is_a", "v"))).alias("v"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("stratum", "na", "v"))).alias("strata"))
    side = lambda a: F.flatten(F.transform("strata", lambda s: F.transform(F.filter(s["v"], lambda r: r["is_a"] == a), lambda r: r["v"])))
    one = one.where((F.size(side(True)) > 0) & (F.size(side(False)) > 0)).withColumn("observed", middle(side(True)) - middle(side(False)))

    def drawn(s: Column) -> Column:
        keyed = F.transform(s["v"], lambda r: F.struct(F.sha2(F.concat_ws("|", F.lit(stream), F.col("replicate"), s["stratum"], r["i"]), 256).alias("k"), r["v"].alias("v")))
        return F.struct(s["na"].alias("na"), F.transform(F.array_sort(keyed), lambda r: r["v"]).alias("v"))

    rows = replicates(one, n).withColumn("p", F.transform("strata", drawn))
    a = F.flatten(F.transform("p", lambda s: F.slice(s["v"], F.lit(1), s["na"])))
    b = F.flatten(F.transform("p", lambda s: F.slice(s["v"], s["na"] + 1, F.size(s["v"]) - s["na"])))
    d = rows.select("observed", (middle(a) - middle(b)).alias("d"))
    return d.groupBy("observed").agg(F.count_if(F.abs("d") >= F.abs("observed") - 1e-12).alias("two_sided"), F.count_if(F.col("d") >= F.col("observed") - 1e-12).alias("one_sided"))


def _median_places(n: int) -> tuple[int, int]:
    return (n - 1) // 2, n // 2


def split_counts(pool: list[float], na: int, first: int, observed: float) -> tuple[int, int]:
    """Of the splits in which exactly ``first`` values of b lie before a's lower median: those as far apart as observed, and those as far above.

    ``pool`` rises. Which places of it the medians have fixes how many values
    of a and b lie before, between and behind them, so a choice of the (two or
    four) places stands for a product of binomials of splits. ``first`` and the
    place of a's upper median are given or run; for b's medians the values
    before are summed by falling places. Equal values have places of their own,
    in any order.
    """
    n = len(pool)
    nb = n - na
    (la, ha), (lb, hb) = _median_places(na), _median_places(nb)
    lower_a = la + first
    two = one = 0
    for second in [first] if la == ha else range(first, nb + 1):
        upper_a = ha + second
        a = (pool[lower_a] + pool[upper_a]) / 2
        for before_b in range(na + 1):
            lower_b = lb + before_b
            for after_b in [before_b] if lb == hb else range(before_b, na + 1):
                upper_b = hb + after_b
                # the path of a's and b's values passes these points: (place, of a before it, of b before it, whether it is of a)
                steps = sorted({(lower_a, la, first, 1), (upper_a, ha, second, 1), (lower_b, before_b, lb, 0), (upper_b, after_b, hb, 0)})
                ways, x, y = 1, 0, 0
                for _, u, v, of_a in steps:
                    if u < x or v < y:
                        ways = 0
                        break
                    ways *= math.comb(u - x + v - y, u - x)
                    x, y = u + of_a, v + 1 - of_a
                if not ways:
                    continue
                ways *= math.comb(n - x - y, na - x)
                d = a - (pool[lower_b] + pool[upper_b]) / 2
                two += ways * (abs(d) >= abs(observed) - 1e-12)
                one += ways * (d >= observed - 1e-12)
    return two, one


def exact_permutation(samples: DataFrame, *by: str) -> DataFrame:
    """(by, observed, splits, two_sided, one_sided, p_two_sided, p_one_sided): exact tests of the difference of medians over all splits.

    Splits are counted, not enumerated, by which order statistics become the
    medians: polynomial in the number of values, without a limit on it. The
    places of a's lower median are dealt over the cluster. The counts are
    decimals, null from 10**38 on; the p-values are there for all sizes.
    """
    rows = samples.where((F.size("a") > 0) & (F.size("b") > 0)).select(*by, F.array_sort(F.concat(F.transform("a", lambda x: x.cast("double")), F.transform("b", lambda x: x.cast("double")))).alias("pool"), F.size("a").alias("na"), (middle(F.col("a")) - middle(F.col("b"))).alias("observed"))
    dealt = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.size("pool") - F.col("na")))).repartition("first", *by)
    kinds = [rows.schema[c] for c in by]
    schema = T.StructType([*kinds, T.StructField("observed", T.DoubleType()), T.StructField("two", T.StringType()), T.StructField("one", T.StringType()), T.StructField("all", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(by)
            pool, na, observed, first = (batch.column(k + i).to_pylist() for i in range(4))
            counts = [split_counts(p, m, f, o) for p, m, o, f in zip(pool, na, observed, first)]
            every = [math.comb(len(p), m) for p, m in zip(pool, na)]
            texts = [pa.array([str(c) for c in own]) for own in ([x[0] for x in counts], [x[1] for x in counts], every)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], batch.column(k + 2), *texts], names=schema.names)

    parts = dealt.mapInArrow(run, schema)
    # shares of all splits, so that counts beyond a decimal's digits still give p-values
    big = F.length("all") > 38
    whole = lambda c: F.when(~big, F.expr(f"try_cast(`{c}` AS decimal(38,0))"))
    share = lambda c: F.col(c).cast("double") / F.col("all").cast("double")
    out = parts.groupBy(*by, "observed").agg(F.max(whole("all")).alias("splits"), F.sum(whole("two")).alias("two_sided"), F.sum(whole("one")).alias("one_sided"), F.sum(share("two")).alias("p_two_sided"), F.sum(share("one")).alias("p_one_sided"))
    return out


def sign_test(pairs: DataFrame, a: str, b: str, tests: int = 1) -> DataFrame:
    """(wins, losses, p): exact one-sided sign test of a > b; ties are left out; p is multiplied by ``tests``."""
    counts = pairs.agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) < F.col(b)).alias("losses"))
    n = F.col("wins") + F.col("losses")

    def tail(n: Column, wins: Column) -> Column:
        # choose(n, k) / 2^n for k = 0 .. n by the ratio of neighbours
        first = F.struct(F.pow(F.lit(0.5), n).alias("c"), F.lit(0.0).alias("p"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] + F.when(k >= wins, s["c"]).otherwise(0.0)
            return F.struct((s["c"] * (n - k) / (k + 1)).alias("c"), p.alias("p"))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), n), first, step, lambda s: s["p"])

    p = F.when(n == 0, 1.0).otherwise(tail(n, F.col("wins")))
    return counts.withColumn("p", p).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * tests))
