"""Every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators import discretize as D
from sigseg.operators import estimators as T
from sigseg.operators import hmm as H
from sigseg.operators import multichannel as M
from sigseg.operators import profiles as P
from sigseg.operators import regions as R
from sigseg.operators import scoring as C
from sigseg.operators import selection as L
from sigseg.operators import signal as S
from sigseg.operators import wavelet as W
from sigseg.operators.em import Iterations, SmallChange, baum_welch, random_discrete
from sigseg.plans import recursions as rec
from sigseg.plans import views as V
from sigseg.sources import folders
from sigseg.sources import readers as I
from sigseg.sources import segments as G
from sigseg.sources import writers as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def also(name: str, known: str) -> None:
    """Register a query and its SQL under a second name."""
    QUERIES[name], ORACLE_SQL[name] = QUERIES[known], ORACLE_SQL[known]


def r6(c: str, name: str | None = None):
    """A column to six decimals, without negative zero."""
    return (F.round(F.col(c), 6) + 0.0).alias(name or c)


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


SIG, MC, PEAKS, IV = V.SQL["sig"], V.SQL["mc"], V.SQL["peaks"], V.SQL["intervals"]

# ---- signals ----


@query(with_(IV, "cut AS (SELECT chrom, start, \"end\", score, unnest(generate_series(start // 3600, (\"end\" - 1) // 3600)) AS bin FROM iv WHERE start < \"end\")") + 'SELECT chrom, bin, round(sum(score * (least("end", (bin + 1) * 3600) - greatest(start, bin * 3600))) / 3600, 6) AS value FROM cut GROUP BY ALL')
def sig_rasterize(spark, sf):
    return S.rasterize(V.intervals(spark, sf), 3600).select("chrom", "bin", r6("value"))


@query(with_(IV, "cut AS (SELECT chrom, start, \"end\", score, unnest(generate_series(start // 3600, (\"end\" - 1) // 3600)) AS bin FROM iv WHERE start < \"end\")") + 'SELECT chrom, bin, max_by(score, {\'a\': start, \'b\': "end", \'c\': score}) AS value FROM cut GROUP BY ALL')
def sig_rasterize_assign(spark, sf):
    return S.rasterize(V.intervals(spark, sf), 3600, "assign")


@query(with_(SIG) + "SELECT chrom, bin // 7 AS bin, round(sum(value), 6) AS value FROM sig WHERE bin < 714 GROUP BY ALL")
def sig_resample_sum(spark, sf):
    return S.resample(V.sig_hour(spark, sf), 7).select("chrom", "bin", r6("value"))


@query(with_(SIG) + "SELECT chrom, bin // 24 AS bin, round(sum(value) / 24, 6) AS value FROM sig GROUP BY ALL")
def sig_resample_mean(spark, sf):
    return S.resample(V.sig_hour(spark, sf), 24, "mean").select("chrom", "bin", r6("value"))


@query(with_(SIG) + "SELECT chrom, bin, round(ln(1 + value), 6) AS value FROM sig")
def sig_log1p(spark, sf):
    return V.sig_hour(spark, sf).select("chrom", "bin", F.round(F.log1p("value"), 6).alias("value"))


@query(with_(MC) + "SELECT chrom, bin, track::BIGINT AS track, round(ln(1 + value) - avg(ln(1 + value)) OVER (PARTITION BY chrom, bin), 6) + 0.0 AS value FROM mc")
def sig_log_diff(spark, sf):
    return S.log_diff(V.mc_hour(spark, sf)).select("chrom", "bin", "track", r6("value"))


@query(with_(MC) + "SELECT chrom, bin, sum(value) FILTER (track = 0) AS t0, sum(value) FILTER (track = 1) AS t1, sum(value) FILTER (track = 2) AS t2, sum(value) FILTER (track = 3) AS t3 FROM mc GROUP BY ALL")
def sig_stack_tracks(spark, sf):
    wide = S.stack(V.mc_hour(spark, sf), [0, 1, 2, 3])
    return wide.select("chrom", "bin", *[F.col(str(i)).alias(f"t{i}") for i in range(4)])


@query(with_(MC) + "SELECT chrom, bin, round(sum(value) / 4, 6) AS value FROM mc GROUP BY ALL")
def sig_sample_mean(spark, sf):
    return S.sample_mean(V.mc_hour(spark, sf), 4).select("chrom", "bin", r6("value"))


RUNS = """marked AS (SELECT *, bin - row_number() OVER (PARTITION BY chrom, state ORDER BY bin) AS island FROM seg),
regions AS (SELECT chrom, min(bin) AS start, count(*) AS length, state, row_number() OVER (PARTITION BY chrom ORDER BY min(bin)) - 1 AS region FROM marked GROUP BY chrom, state, island)"""


@query(with_(SIG, "seg AS (SELECT chrom, bin, 1 AS state FROM sig WHERE value >= 40)", RUNS) + "SELECT chrom, start, length FROM regions WHERE length > 3")
def sig_mappable_runs(spark, sf):
    return S.mappable_runs(V.sig_hour(spark, sf), 40.0, 3)


@query(with_(SIG) + "SELECT chrom, bin, value FROM sig WHERE chrom IN ('click', 'view') AND value > 0")
def sig_chrom_select(spark, sf):
    return V.sig_hour(spark, sf).filter(F.col("chrom").isin("click", "view") & (F.col("value") > 0)).select("chrom", "bin", "value")


@query("SELECT event_type AS chrom, max(event_id) // 20 AS bins FROM events GROUP BY ALL")
def sig_sizes(spark, sf):
    e = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("chrom")).agg(F.max("event_id").alias("size"))
    return S.sizes_in_bins(e, 20)


# ---- symbols ----

X = "x AS (SELECT chrom, bin, ln(1 + value) AS x FROM sig)"
T3 = "t AS (SELECT quantile_cont(x, [0.6, 0.75, 0.9]) AS t FROM x)"
SYM = "sym AS (SELECT chrom, bin, ((round(x, 9) > round(t[1], 9))::INT + (round(x, 9) > round(t[2], 9))::INT + (round(x, 9) > round(t[3], 9))::INT) AS x FROM x, t)"


def symbols(spark, sf) -> DataFrame:
    """chrom, bin, obs: percentile symbols of the hourly signal."""
    x = V.sig_hour(spark, sf).select("chrom", "bin", F.log1p("value").alias("x"))
    return x.select("chrom", "bin", D.above(F.col("x"), D.percentiles(x, "x", [60, 75, 90])).alias("obs"))


@query(with_(SIG, X, T3, SYM) + "SELECT chrom, bin, x AS symbol FROM sym")
def disc_percentile(spark, sf):
    return symbols(spark, sf).withColumnRenamed("obs", "symbol")


MULTI = "mt AS (SELECT track, quantile_cont(value, [0, 0.6, 0.75, 0.9]) AS t FROM mc GROUP BY track)"
MSYM = "ms AS (SELECT chrom, bin, mc.track, (round(value, 9) > round(t[1], 9))::INT + (round(value, 9) > round(t[2], 9))::INT + (round(value, 9) > round(t[3], 9))::INT + (round(value, 9) > round(t[4], 9))::INT AS symbol FROM mc JOIN mt ON mc.track = mt.track)"


def track_symbols(spark, sf) -> DataFrame:
    """chrom, bin, s0..s3: symbols 0 to 4 of each track by its own percentiles."""
    wide = S.stack(V.mc_hour(spark, sf), [0, 1, 2, 3])
    wide = wide.select("chrom", "bin", *[F.col(str(i)).alias(f"t{i}") for i in range(4)])
    cuts = D.fit_features(wide, [f"t{i}" for i in range(4)], [0.0, 60.0, 75.0, 90.0])
    return wide.select("chrom", "bin", *[D.first_not_below(F.col(f"t{i}"), cuts[i]).alias(f"s{i}") for i in range(4)])


@query(with_(MC, MULTI, MSYM) + "SELECT chrom, bin, max(symbol) FILTER (track = 0) AS s0, max(symbol) FILTER (track = 1) AS s1, max(symbol) FILTER (track = 2) AS s2, max(symbol) FILTER (track = 3) AS s3 FROM ms GROUP BY ALL")
def disc_multidim(spark, sf):
    return track_symbols(spark, sf)


PACKED = "pk AS (SELECT chrom, bin, sum(symbol * power(8, track)::BIGINT)::BIGINT AS packed FROM ms GROUP BY ALL)"


@query(with_(MC, MULTI, MSYM, PACKED) + "SELECT chrom, bin, packed FROM pk")
def disc_pack(spark, sf):
    return track_symbols(spark, sf).select("chrom", "bin", D.pack([F.col(f"s{i}") for i in range(4)], [5] * 4).alias("packed"))


@query(with_(MC, MULTI, MSYM, PACKED) + "SELECT chrom, bin, (packed & 7)::INT AS s0, ((packed >> 3) & 7)::INT AS s1, ((packed >> 6) & 7)::INT AS s2, ((packed >> 9) & 7)::INT AS s3 FROM pk")
def disc_unpack(spark, sf):
    packed = disc_pack(spark, sf)
    return packed.select("chrom", "bin", *[c.alias(f"s{i}") for i, c in enumerate(D.unpack(F.col("packed"), [5] * 4))])


@query(with_(SIG, X, "h AS (SELECT min(x) AS low, (max(x) - min(x)) / 20 AS w FROM x)", "b AS (SELECT least(floor((x - low) / w), 19)::BIGINT AS b, count(*) AS n FROM x, h GROUP BY 1)", "top AS (SELECT b FROM b WHERE b > 0 ORDER BY n DESC, b LIMIT 3)") + "SELECT row_number() OVER (ORDER BY b)::INT AS k, round(low + w * b, 6) AS threshold FROM top, h")
def disc_hist_auto(spark, sf):
    x = V.sig_hour(spark, sf).select(F.log1p("value").alias("x"))
    cuts = D.histogram_thresholds(x, "x")
    return spark.createDataFrame([(i + 1, round(c, 6)) for i, c in enumerate(cuts)], "k int, threshold double")


@query(with_(SIG) + "SELECT chrom, bin, (value > 0 AND exp(-value / 120.0) / 120.0 < 0.002 * 0.8)::INT AS symbol FROM sig")
def disc_noise_exp(spark, sf):
    return V.sig_hour(spark, sf).select("chrom", "bin", D.noise_symbol(F.col("value"), 120.0, 0.2, 0.002).alias("symbol"))


@query(with_(SIG, X) + "SELECT chrom, bin, (0.6 * exp(-((x - 5.2) ** 2) / 0.5) / 0.5 > 0.4 * exp(-((x - 4.0) ** 2) / 2) / 1.0)::INT AS symbol FROM x")
def disc_gmix(spark, sf):
    return V.sig_hour(spark, sf).select("chrom", "bin", D.mixture_symbol(F.col("value"), [4.0, 5.2], [1.0, 0.5], [0.6, 0.4]).alias("symbol"))


@query(with_(SIG, "q AS (SELECT quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM sig)", "i AS (SELECT unnest(generate_series(1, 10)) AS i)", "best AS (SELECT q[i] AS t FROM i, q ORDER BY round(q[i + 1] - q[i], 9) DESC, i LIMIT 1)") + "SELECT chrom, bin, (round(value, 9) > round(t, 9))::INT AS symbol FROM sig, best")
def disc_empirical(spark, sf):
    v = V.sig_hour(spark, sf)
    return v.select("chrom", "bin", D.above(F.col("value"), [D.jump_threshold(v, "value")]).alias("symbol"))


def _erf(z: str) -> str:
    """The error function by its series of positive terms; beyond 6 it is 1."""
    return f"(CASE WHEN abs({z}) > 6 THEN sign({z}) WHEN {z} = 0 THEN 0 ELSE sign({z}) * list_sum([exp((2 * n + 1) * ln(abs({z})) - ({z}) ** 2 - lgamma(n + 1.5)) for n in range(150)]) END)"


def _halves(name: str, rows: str) -> str:
    """CTEs name0 to name20: a hard split of x in two, round by round; u, d and w are means, deviations and the upper share."""
    ctes = [f"{name}0 AS (SELECT min(x) AS u0, max(x) AS u1, 0.0 AS d0, 0.0 AS d1, 0.5 AS w FROM {rows})"]
    for i in range(20):
        ctes.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT coalesce(avg(x) FILTER (NOT up), any_value(u0)) AS u0, coalesce(avg(x) FILTER (up), any_value(u1)) AS u1, coalesce(stddev_pop(x) FILTER (NOT up), 0) AS d0, coalesce(stddev_pop(x) FILTER (up), 0) AS d1, avg(up::INT) AS w
  FROM (SELECT x, u0, u1, abs(x - u1) < abs(x - u0) AS up FROM {rows}, {name}{i}))""")
    return ",\n".join(ctes)


def ks_sql(n: str, rows: str) -> str:
    """CTEs of the six hypotheses on ``rows`` (value): nks (hypothesis, distance), nbest (chosen), and the fits np, nh20 and nz20."""
    steps = "[" + ", ".join(f"{i / 1000}" for i in range(1, 1000)) + "]"
    side = lambda h, s: f"0.5 * (1 + {_erf(f'((lx - {h}.u{s}) / (greatest({h}.d{s}, 1e-6) * sqrt(2)))')})"
    gauss = lambda h: f"((1 - {h}.w) * {side(h, 0)} + {h}.w * {side(h, 1)})"
    exponential = "(1 - exp(-c / mean))"
    poisson = "list_sum([exp(k * ln(mean) - mean - lgamma(k + 1)) for k in range(0, floor(c)::BIGINT + 1)])"
    held = {"poisson_zero": ("a", poisson), "exponential_zero": ("a", exponential), "poisson": ("b", poisson), "exponential": ("b", exponential), "gaussian_2": ("a", gauss("h")), "gaussian_2_zero": ("a", gauss("z"))}
    each = [f"SELECT '{kind}' AS hypothesis, max(abs({'zeros + (1 - zeros) * ' if kind.endswith('zero') else ''}{cdf} - step)) AS distance FROM {n}c{part} c, {n}p, {n}h20 h, {n}z20 z" for kind, (part, cdf) in held.items()]
    cuts = [f"{n}c{part} AS (SELECT c, ln(1 + c) AS lx, step FROM (SELECT unnest(quantile_cont(value, {steps})) AS c, unnest({steps}) AS step FROM {rows}{where}))" for part, where in (("a", ""), ("b", " WHERE value > 0"))]
    return ",\n".join([
        f"{n}a AS (SELECT ln(1 + value) AS x FROM {rows})", f"{n}b AS (SELECT ln(1 + value) AS x FROM {rows} WHERE value > 0)",
        f"{n}p AS (SELECT avg(value) FILTER (value > 0) AS mean, avg((value = 0)::INT) AS zeros FROM {rows})",
        _halves(f"{n}h", f"{n}a"), _halves(f"{n}z", f"{n}b"), *cuts,
        f"{n}ks AS MATERIALIZED ({' UNION ALL '.join(each)})",
        f"{n}best AS MATERIALIZED (SELECT CASE WHEN distance < 0.15 THEN hypothesis ELSE 'empirical' END AS chosen FROM {n}ks ORDER BY distance, hypothesis LIMIT 1)",
    ])


@query(with_(SIG, ks_sql("k", "sig")) + "SELECT hypothesis, round(distance, 6) AS distance, chosen FROM kks, kbest")
def disc_ks_select(spark, sf):
    with folders.held(V.sig_hour(spark, sf).select("value"), "values") as v:  # some fifty aggregates read it
        distances = D.ks_distances(v, "value")
    rows = [(k, round(float(d), 6)) for k, d in sorted(distances.items())]
    return spark.createDataFrame(rows, "hypothesis string, distance double").withColumn("chosen", F.lit(D.nearest(distances)))


NAIVE = "nt AS (SELECT quantile_cont(x, 0.7) AS t FROM x), seg AS (SELECT chrom, bin, (round(x, 9) > round(t, 9))::INT AS state FROM x, nt)"


def naive(spark, sf) -> DataFrame:
    x = V.sig_hour(spark, sf).select("chrom", "bin", F.log1p("value").alias("x"))
    return x.select("chrom", "bin", D.above(F.col("x"), D.percentiles(x, "x", [70])).alias("state"))


@query(with_(SIG, X, NAIVE) + "SELECT chrom, bin, state FROM seg")
def disc_naive_baseline(spark, sf):
    return naive(spark, sf)


# ---- hidden Markov models ----

N0, N1 = (4.5, 0.9), (5.6, 0.6)
NORMAL = H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, E.Normal([N0[0], N1[0]], [N0[1], N1[1]]), H.DEFAULT_END)
MIX = E.Mixture([[0.7, 0.3], [1.0, 0.0]], [[4.5, 2.0], [5.6, 1.0]], [[0.9, 1.5], [0.6, 1.0]])
MULTI_TABLE = [[[0.5, 0.2, 0.1, 0.1, 0.1]] * 4, [[0.1, 0.1, 0.2, 0.3, 0.3]] * 4]


def pdf(x: str, m, s) -> str:
    return f"exp(-(({x} - {m}) ** 2) / (2 * {s} * {s})) / ({s} * sqrt(2 * pi()))"


def floored(e: str) -> str:
    return f"greatest({e}, 2.220446049250313e-16)"


START, TRANS, END = tuple(H.DEFAULT_START), tuple(map(tuple, H.DEFAULT_TRANSITION)), tuple(H.DEFAULT_END)
TABLE = "[" + ", ".join(map(str, H.DEFAULT_TABLE[0])) + "]", "[" + ", ".join(map(str, H.DEFAULT_TABLE[1])) + "]"
OBS_D = f"obs AS MATERIALIZED (SELECT chrom, bin, {TABLE[0]}[x + 1]::DOUBLE AS e0, {TABLE[1]}[x + 1]::DOUBLE AS e1 FROM sym)"
OBS_N = f"obs AS MATERIALIZED (SELECT chrom, bin, {floored(pdf('x', *N0))} AS e0, {floored(pdf('x', *N1))} AS e1 FROM x)"
DISCRETE = (SIG, X, T3, SYM, OBS_D)


def levels(spark, sf) -> DataFrame:
    return V.sig_hour(spark, sf).select("chrom", "bin", F.log1p("value").alias("obs"))


def packed_symbols(spark, sf, chunk: int = 128) -> DataFrame:
    return H.pack(symbols(spark, sf), chunk=chunk)


@query(with_(SIG, X, OBS_N) + "SELECT chrom, bin, round(e0, 6) AS p0, round(e1, 6) AS p1 FROM obs")
def hmm_emission_normal(spark, sf):
    a, b = NORMAL.emission.columns(F.col("obs"))
    return levels(spark, sf).select("chrom", "bin", F.round(a, 6).alias("p0"), F.round(b, 6).alias("p1"))


@query(with_(SIG, X) + f"SELECT chrom, bin, round({floored('0.7 * ' + pdf('x', 4.5, 0.9) + ' + 0.3 * ' + pdf('x', 2.0, 1.5))}, 6) AS p0, round({floored(pdf('x', 5.6, 0.6))}, 6) AS p1 FROM x")
def hmm_emission_mixture(spark, sf):
    a, b = MIX.columns(F.col("obs"))
    return levels(spark, sf).select("chrom", "bin", F.round(a, 6).alias("p0"), F.round(b, 6).alias("p1"))


OBS_M = "obs AS MATERIALIZED (SELECT chrom, bin, product([0.5, 0.2, 0.1, 0.1, 0.1][symbol + 1])::DOUBLE AS e0, product([0.1, 0.1, 0.2, 0.3, 0.3][symbol + 1])::DOUBLE AS e1 FROM ms GROUP BY ALL)"
MULTINOMIAL = H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, E.Multinomial(MULTI_TABLE), H.DEFAULT_END)


def track_vectors(spark, sf) -> DataFrame:
    return track_symbols(spark, sf).select("chrom", "bin", F.array(*[f"s{i}" for i in range(4)]).alias("obs"))


@query(with_(MC, MULTI, MSYM, OBS_M) + "SELECT chrom, bin, round(e0, 6) AS p0, round(e1, 6) AS p1 FROM obs")
def hmm_emission_multinomial(spark, sf):
    a, b = MULTINOMIAL.emission.columns(F.col("obs"))
    return track_vectors(spark, sf).select("chrom", "bin", F.round(a, 6).alias("p0"), F.round(b, 6).alias("p1"))


@query(with_(MC, "w AS (SELECT chrom, bin, ln(1 + sum(value) FILTER (track = 0)) AS x, ln(1 + sum(value) FILTER (track = 1)) AS y FROM mc GROUP BY ALL)") + f"SELECT chrom, bin, round({floored('exp(-0.5 * (2 * (x - 3) ** 2 - (x - 3) * (y - 2) + (y - 2) ** 2) / 1.75) / (2 * pi() * sqrt(1.75))')}, 6) AS p FROM w")
def hmm_emission_mvn2(spark, sf):
    wide = S.stack(V.mc_hour(spark, sf), [0, 1])
    x = F.array(F.log1p("0"), F.log1p("1"))
    (p,) = E.MultivariateNormal([[3.0, 2.0]], [[[1.0, 0.5], [0.5, 2.0]]]).columns(x)
    return wide.select("chrom", "bin", F.round(p, 6).alias("p"))


FWD = rec.forward("obs", "f", START, TRANS)
BWD = rec.backward("obs", "f", "b", TRANS)


@query(with_(*DISCRETE, FWD, recursive=True) + "SELECT chrom, round(l, 6) AS loglik FROM f WHERE bin = 719")
def hmm_forward_loglik(spark, sf):
    return H.log_likelihood(packed_symbols(spark, sf), H.default_discrete()).select("chrom", r6("loglik"))


@query(ORACLE_SQL["hmm_forward_loglik"])
def hmm_forward_fold(spark, sf):
    return H.fold_log_likelihood(packed_symbols(spark, sf, 4096), H.default_discrete()).select("chrom", r6("loglik"))


def gammas(df: DataFrame) -> DataFrame:
    return df.select("chrom", "bin", F.round(F.col("gamma")[1], 6).alias("p"))


@query(with_(*DISCRETE, FWD, BWD, recursive=True) + "SELECT f.chrom, f.bin, round(a1 * b1 / (a0 * b0 + a1 * b1), 6) AS p FROM f JOIN b ON f.chrom = b.chrom AND f.bin = b.bin")
def hmm_posterior_full(spark, sf):
    return gammas(H.posterior(packed_symbols(spark, sf), H.default_discrete()))


@query(ORACLE_SQL["hmm_posterior_full"])
def hmm_posterior_log(spark, sf):
    return gammas(H.posterior_log(packed_symbols(spark, sf), H.default_discrete()))


LAG = "(CASE WHEN n.bin IS NULL THEN 1 ELSE 0.99 * n.e0 + 0.01 * n.e1 END)", "(CASE WHEN n.bin IS NULL THEN 1 ELSE 0.1 * n.e0 + 0.9 * n.e1 END)"


@query(with_(*DISCRETE, FWD, recursive=True) + f"SELECT f.chrom, f.bin, round(a1 * {LAG[1]} / (a0 * {LAG[0]} + a1 * {LAG[1]}), 6) AS p FROM f LEFT JOIN obs n ON n.chrom = f.chrom AND n.bin = f.bin + 1")
def hmm_posterior_lag1(spark, sf):
    return gammas(H.posterior(packed_symbols(spark, sf), H.default_discrete(), "lag1"))


@query(with_(*DISCRETE, FWD, recursive=True) + "SELECT chrom, bin, round(a1, 6) AS p FROM f")
def hmm_posterior_filter(spark, sf):
    return gammas(H.posterior(packed_symbols(spark, sf), H.default_discrete(), "filter"))


@query(with_(SIG, X, OBS_N, FWD, BWD, recursive=True) + "SELECT f.chrom, f.bin, round(a1 * b1 / (a0 * b0 + a1 * b1), 6) AS p FROM f JOIN b ON f.chrom = b.chrom AND f.bin = b.bin")
def hmm_posterior_normal(spark, sf):
    return gammas(H.posterior(H.pack(levels(spark, sf), chunk=100), NORMAL))


VIT = rec.viterbi("obs", START, TRANS, END)


@query(with_(*DISCRETE, VIT, recursive=True) + "SELECT chrom, bin, state FROM path")
def hmm_viterbi_discrete(spark, sf):
    return H.viterbi(packed_symbols(spark, sf, 4096), H.default_discrete())


@query(ORACLE_SQL["hmm_viterbi_discrete"])
def hmm_viterbi_chunked(spark, sf):
    return H.viterbi(packed_symbols(spark, sf, 64), H.default_discrete())


@query(with_(SIG, X, OBS_N, VIT, recursive=True) + "SELECT chrom, bin, state FROM path")
def hmm_viterbi_normal(spark, sf):
    return H.viterbi(H.pack(levels(spark, sf), chunk=128), NORMAL)


@query(with_(MC, MULTI, MSYM, OBS_M, VIT, recursive=True) + "SELECT chrom, bin, state FROM path")
def hmm_viterbi_multinomial(spark, sf):
    return H.viterbi(H.pack(track_vectors(spark, sf), chunk=128), MULTINOMIAL)


# ---- regions ----

SEG = (*DISCRETE, VIT, "seg AS (SELECT chrom, bin, state FROM path)", RUNS)


def segmentation(spark, sf) -> DataFrame:
    return H.viterbi(packed_symbols(spark, sf), H.default_discrete())


@query(with_(*SEG, recursive=True) + "SELECT chrom, region, start, length, state FROM regions")
def reg_runs(spark, sf):
    return H.viterbi_runs(packed_symbols(spark, sf), H.default_discrete()).withColumn("region", F.col("region").cast("long"))


@query(with_(*SEG, recursive=True) + "SELECT chrom, start, length FROM regions WHERE state = 1")
def reg_start_len(spark, sf):
    return H.viterbi_runs(packed_symbols(spark, sf, 64), H.default_discrete()).filter("state = 1").select("chrom", "start", "length")


NAIVE_SEG = (SIG, X, NAIVE, RUNS)
IN_REGION = "JOIN regions r ON r.chrom = s.chrom AND s.bin >= r.start AND s.bin < r.start + r.length"


def naive_regions(spark, sf) -> DataFrame:
    return S.runs(naive(spark, sf)).withColumn("region", F.col("region").cast("long"))


@query(with_(*NAIVE_SEG) + f"SELECT s.chrom, region, round(sum(value) / any_value(length), 6) AS value FROM sig s {IN_REGION} GROUP BY ALL")
def reg_avg_signal(spark, sf):
    return R.average_signal(naive_regions(spark, sf), V.sig_hour(spark, sf)).select("chrom", "region", r6("value"))


MC_ONLY = MC.replace("sizes AS (SELECT DISTINCT event_type AS chrom FROM events), ", "")


@query(with_(*NAIVE_SEG, MC_ONLY) + f"SELECT s.chrom, region, track::BIGINT AS track, round(sum(s.value) / any_value(length), 6) AS value FROM mc s {IN_REGION} GROUP BY ALL")
def reg_markers(spark, sf):
    return P.marker_profile(naive_regions(spark, sf), V.mc_hour(spark, sf)).select("chrom", "region", "track", r6("value"))


@query(with_(*NAIVE_SEG, PEAKS) + """SELECT chrom, region, EXISTS (SELECT 1 FROM peaks p WHERE p.chrom = r.chrom
  AND (p.start + p."end") / 2 > r.start * 3600 - r.length * 3600 * 0.05 AND (p.start + p."end") / 2 < r.start * 3600 + r.length * 3600 * 0.05) AS has_peak FROM regions r""")
def reg_boundary_peak(spark, sf):
    return R.near_boundary(naive_regions(spark, sf), V.peaks(spark, sf), 3600)


@query(with_(*NAIVE_SEG) + "SELECT state, count(*) AS n, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, max(length) AS max, min(length) AS min FROM regions GROUP BY state")
def reg_length_stats(spark, sf):
    return R.length_stats(naive_regions(spark, sf)).select("state", "n", r6("mean"), r6("std"), "max", "min")


@query(with_(*NAIVE_SEG) + "SELECT state, floor((round(log10(length * 3600), 9) - 2.5) / 0.03)::BIGINT AS slot, count(*) AS n FROM regions WHERE round(log10(length * 3600), 9) >= 2.5 AND round(log10(length * 3600), 9) < 6.2 GROUP BY ALL")
def reg_length_hist(spark, sf):
    return R.length_histogram(naive_regions(spark, sf), 3600)


# ---- training ----

EM_D = [f"e{s}{m}" for s in range(2) for m in range(4)]
EM_D_SQL = rec.em(
    lambda x, m: f"CASE {x} WHEN 0 THEN {m}.e00 WHEN 1 THEN {m}.e01 WHEN 2 THEN {m}.e02 ELSE {m}.e03 END AS e0, CASE {x} WHEN 0 THEN {m}.e10 WHEN 1 THEN {m}.e11 WHEN 2 THEN {m}.e12 ELSE {m}.e13 END AS e1",
    "train", 3, START, TRANS, (EM_D, [str(v) for row in H.DEFAULT_TABLE for v in row]),
    [f"coalesce(sum(g{s}) FILTER (x = {m}), 0) / sum(g{s})" for s in range(2) for m in range(4)],
)
MODEL_OUT = "SELECT round(p0, 6) AS p0, round(a00, 6) AS a00, round(a11, 6) AS a11"


def model_row(spark, fit, names: list[str], values: list[float]) -> DataFrame:
    m = fit.model
    row = [m.start[0], m.transition[0][0], m.transition[1][1], *values, fit.likelihoods[-1]]
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in row)], ", ".join(f"{n} double" for n in ["p0", "a00", "a11", *names, "loglik"]))


def _em_discrete(spark, obs: DataFrame, first: H.HmmModel | None = None, smoothing: str = "full") -> DataFrame:
    fit = baum_welch(H.pack(obs, chunk=256), first or H.default_discrete(), Iterations(3), smoothing=smoothing)
    return model_row(spark, fit, EM_D, [v for row in fit.model.emission.table for v in row])


EM_D_OUT = MODEL_OUT + "".join(f", round({c}, 6) AS {c}" for c in EM_D) + ", (SELECT round(sum(l), 6) FROM f2 WHERE bin = 719) AS loglik FROM m3"


@query(with_(SIG, X, T3, SYM, "train AS (SELECT chrom, bin, x FROM sym WHERE chrom = 'click')", EM_D_SQL, recursive=True) + EM_D_OUT)
def em_discrete_3it(spark, sf):
    return _em_discrete(spark, symbols(spark, sf).filter("chrom = 'click'"))


@query(with_(SIG, X, T3, SYM, "train AS (SELECT chrom, bin, x FROM sym)", EM_D_SQL, recursive=True) + EM_D_OUT)
def em_log_3it(spark, sf):
    """Training in log space, all chromosomes at once."""
    return _em_discrete(spark, symbols(spark, sf), smoothing="log")


RANDOM = random_discrete(2, 4, 7)
EM_R_SQL = rec.em(
    lambda x, m: f"CASE {x} WHEN 0 THEN {m}.e00 WHEN 1 THEN {m}.e01 WHEN 2 THEN {m}.e02 ELSE {m}.e03 END AS e0, CASE {x} WHEN 0 THEN {m}.e10 WHEN 1 THEN {m}.e11 WHEN 2 THEN {m}.e12 ELSE {m}.e13 END AS e1",
    "train", 3, tuple(RANDOM.start), tuple(map(tuple, RANDOM.transition)), (EM_D, [str(v) for row in RANDOM.emission.table for v in row]),
    [f"coalesce(sum(g{s}) FILTER (x = {m}), 0) / sum(g{s})" for s in range(2) for m in range(4)],
)


@query(with_(SIG, X, T3, SYM, "train AS (SELECT chrom, bin, x FROM sym)", EM_R_SQL, recursive=True) + EM_D_OUT)
def em_log_random(spark, sf):
    """Training in log space from a random start."""
    return _em_discrete(spark, symbols(spark, sf), RANDOM, "log")


@query(with_(SIG, X, T3, SYM, "train AS (SELECT chrom, bin, x FROM sym)", EM_D_SQL, recursive=True) + EM_D_OUT)
def em_multiseq_discrete(spark, sf):
    return _em_discrete(spark, symbols(spark, sf))


EM_N = ["u0", "u1", "d0", "d1"]
EM_N_SQL = rec.em(
    lambda x, m: f"{floored(pdf(x, m + '.u0', m + '.d0'))} AS e0, {floored(pdf(x, m + '.u1', m + '.d1'))} AS e1",
    "train", 3, START, TRANS, (EM_N, [N0[0], N1[0], N0[1], N1[1]]),
    ["sum(g0 * x) / sum(g0)", "sum(g1 * x) / sum(g1)", "greatest(sqrt(sum(g0 * (x - m.u0) ** 2) / sum(g0)), 0.5)", "greatest(sqrt(sum(g1 * (x - m.u1) ** 2) / sum(g1)), 0.5)"],
)


@query(with_(SIG, X, "train AS (SELECT chrom, bin, x FROM x)", EM_N_SQL, recursive=True) + MODEL_OUT + "".join(f", round({c}, 6) AS {c}" for c in EM_N) + ", (SELECT round(sum(l), 6) FROM f2 WHERE bin = 719) AS loglik FROM m3")
def em_normal_3it(spark, sf):
    fit = baum_welch(H.pack(levels(spark, sf), chunk=256), NORMAL, Iterations(3))
    return model_row(spark, fit, EM_N, [*fit.model.emission.means, *fit.model.emission.deviations])


EM_M = [f"e{s}_{f}_{m}" for s in range(2) for f in range(4) for m in range(5)]
EM_M_SQL = rec.em(
    lambda x, m: ", ".join(f"{floored(' * '.join(f'(CASE {x}[{f + 1}] ' + ' '.join(f'WHEN {k} THEN {m}.e{s}_{f}_{k}' for k in range(5)) + ' END)' for f in range(4)))} AS e{s}" for s in range(2)),
    "train", 3, START, TRANS, (EM_M, [str(v) for t in MULTI_TABLE for row in t for v in row]),
    [f"coalesce(sum(g{s}) FILTER (x[{f + 1}] = {m}), 0) / sum(g{s})" for s in range(2) for f in range(4) for m in range(5)],
)


@query(with_(MC, MULTI, MSYM, "train AS (SELECT chrom, bin, list(symbol ORDER BY track) AS x FROM ms GROUP BY ALL)", EM_M_SQL, recursive=True)
    + " UNION ALL ".join(f"SELECT {s} AS state, {f} AS feature, {m} AS symbol, round(e{s}_{f}_{m}, 6) AS p FROM m3" for s in range(2) for f in range(4) for m in range(5)))
def em_multinomial(spark, sf):
    fit = baum_welch(H.pack(track_vectors(spark, sf), chunk=256), MULTINOMIAL, Iterations(3))
    rows = [(s, f, m, round(float(p), 6)) for s, t in enumerate(fit.model.emission.table) for f, row in enumerate(t) for m, p in enumerate(row)]
    return spark.createDataFrame(rows, "state int, feature int, symbol int, p double")


MIX_FIRST = [[0.5, 0.5], [0.5, 0.5]], [[2.0, 4.5], [5.0, 6.0]], [[1.0, 1.0], [0.6, 0.6]]
EM_X = [f"{n}{s}{c}" for n in "wud" for s in range(2) for c in range(2)]


def _part(x: str, s: int, c: int, m: str) -> str:
    return f"{m}.w{s}{c} * {pdf(x, f'{m}.u{s}{c}', f'{m}.d{s}{c}')}"


def _share(s: int, c: int) -> str:
    return f"g{s} * {_part('x', s, c, 'm')} / {floored(_part('x', s, 0, 'm') + ' + ' + _part('x', s, 1, 'm'))}"


EM_X_SQL = rec.em(
    lambda x, m: ", ".join(f"{floored(_part(x, s, 0, m) + ' + ' + _part(x, s, 1, m))} AS e{s}" for s in range(2)),
    "train", 3, START, TRANS, (EM_X, [str(v) for part in MIX_FIRST for row in part for v in row]),
    [f"sum({_share(s, c)}) / (sum({_share(s, 0)}) + sum({_share(s, 1)}))" for s in range(2) for c in range(2)]
    + [f"sum({_share(s, c)} * x) / sum({_share(s, c)})" for s in range(2) for c in range(2)]
    + [f"greatest(sqrt(sum({_share(s, c)} * (x - m.u{s}{c}) ** 2) / sum({_share(s, c)})), 0.5)" for s in range(2) for c in range(2)],
)


@query(with_(SIG, X, "train AS (SELECT chrom, bin, x FROM x)", EM_X_SQL, recursive=True)
    + " UNION ALL ".join(f"SELECT {s} AS state, {c} AS component, round(w{s}{c}, 6) AS weight, round(u{s}{c}, 6) AS mean, round(d{s}{c}, 6) AS deviation FROM m3" for s in range(2) for c in range(2)))
def em_mixture(spark, sf):
    first = H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, E.Mixture(*MIX_FIRST))
    fit = baum_welch(H.pack(levels(spark, sf), chunk=256), first, Iterations(3))
    e = fit.model.emission
    rows = [(s, c, *(round(float(v[s][c]), 6) for v in (e.weights, e.means, e.deviations))) for s in range(2) for c in range(2)]
    return spark.createDataFrame(rows, "state int, component int, weight double, mean double, deviation double")


@query()
def em_gaussian_mvn(spark, sf):
    fit = M.fit_segmenter(vectors(spark, sf), 2, dims=4, chunk=1024).fit
    rows = [(s, i, float(v)) for s, m in enumerate(fit.model.emission.means) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "state int, dim int, mean double")


def em_discrete_sql(rounds: int, least: float = 0.0, sym: str = "train") -> str:
    """Baum-Welch of the default discrete model on ``sym``."""
    tables = [", ".join(f"CASE {{x}} WHEN 0 THEN {{m}}.e{s}0 WHEN 1 THEN {{m}}.e{s}1 WHEN 2 THEN {{m}}.e{s}2 ELSE {{m}}.e{s}3 END AS e{s}" for s in range(2))]
    model_of = [f"coalesce(sum(g{s}) FILTER (x = {m}), 0) / sum(g{s})" for s in range(2) for m in range(4)]
    return rec.em(lambda x, m: tables[0].format(x=x, m=m), sym, rounds, START, TRANS, (EM_D, [str(v) for row in H.DEFAULT_TABLE for v in row]), model_of, least)


ALL_SYM = "train AS (SELECT chrom, bin, x FROM sym)"


@query(with_(SIG, X, T3, SYM, ALL_SYM, em_discrete_sql(2, 0.95), recursive=True) + "SELECT 0 AS state, round(a00, 6) AS stay FROM m2 UNION ALL SELECT 1, round(a11, 6) FROM m2")
def em_min_alpha(spark, sf):
    fit = baum_welch(packed_symbols(spark, sf, 256), H.default_discrete(), Iterations(2), min_alpha=0.95)
    return spark.createDataFrame([(i, round(float(row[i]), 6)) for i, row in enumerate(fit.model.transition)], "state int, stay double")


@query(with_(SIG, X, T3, SYM, ALL_SYM, em_discrete_sql(2), recursive=True) + "SELECT round(avg(g0), 6) AS z0, round(avg(g1), 6) AS z1 FROM g1 WHERE bin = 719")
def em_end_weights(spark, sf):
    fit = baum_welch(packed_symbols(spark, sf, 256), H.default_discrete(), Iterations(2), learn_end=True)
    return spark.createDataFrame([tuple(round(float(z), 6) for z in fit.model.end)], "z0 double, z1 double")


@query(with_(SIG, X, T3, SYM, ALL_SYM, em_discrete_sql(2), recursive=True) + "SELECT round(least(a00, 0.97), 6) AS a00, round(1 - least(a00, 0.97), 6) AS a01 FROM m2")
def em_constraint(spark, sf):
    def capped(m: H.HmmModel) -> H.HmmModel:
        stay = min(m.transition[0][0], 0.97)
        return H.HmmModel(m.start, [[stay, 1 - stay], m.transition[1]], m.emission, m.end)

    free = baum_welch(packed_symbols(spark, sf, 256), H.default_discrete(), Iterations(1)).model
    fit = baum_welch(packed_symbols(spark, sf, 256), free, Iterations(1), constraint=capped)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in fit.model.transition[0])], "a00 double, a01 double")


#: Rounds at most, and the log-likelihood before each: training stops behind the third change in a row below 50.
CALM_ROUNDS = 20
CALM = "li AS (" + " UNION ALL ".join(f"SELECT {i} AS round, sum(l) AS l FROM f{i} WHERE bin = 719" for i in range(CALM_ROUNDS)) + """),
ch AS (SELECT round, l, abs(l - lag(l) OVER (ORDER BY round)) < 50 AS calm FROM li),
stops AS (SELECT coalesce(min(round), 99) AS stop FROM (SELECT round, calm AND lag(calm) OVER (ORDER BY round) AND lag(calm, 2) OVER (ORDER BY round) AS still FROM ch) WHERE still)"""


@query(with_(SIG, X, T3, SYM, ALL_SYM, em_discrete_sql(CALM_ROUNDS), CALM, recursive=True) + "SELECT round::INT AS round, round(l, 6) AS loglik FROM ch, stops WHERE round <= stop")
def em_diff_condition(spark, sf):
    stop = SmallChange(50.0, CALM_ROUNDS)
    baum_welch(packed_symbols(spark, sf, 256), H.default_discrete(), stop)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(stop.likelihoods)], "round int, loglik double")


# ---- scores ----

STATES = "st AS (SELECT chrom, bin, track AS sample, (value > 40)::INT AS state FROM mc)"


def sample_states(spark, sf) -> DataFrame:
    return V.mc_hour(spark, sf).select("chrom", "bin", F.col("track").alias("sample"), (F.col("value") > 40).cast("int").alias("state"))


@query(with_(MC, STATES, "d AS (SELECT chrom, bin, (avg(state) >= 0.8)::INT AS truth FROM st GROUP BY ALL HAVING avg(state) <= 0.2 OR avg(state) >= 0.8)") + "SELECT sample::BIGINT AS sample, round(avg((st.state = d.truth)::INT), 6) AS score FROM st JOIN d ON st.chrom = d.chrom AND st.bin = d.bin GROUP BY ALL")
def score_consistency(spark, sf):
    return C.consistency(sample_states(spark, sf)).select("sample", r6("score"))


@query(with_(SIG, MC_ONLY, X, NAIVE) + "SELECT track::BIGINT AS track, round(avg(value) FILTER (state = 1) / avg(value) FILTER (state = 0), 6) AS score FROM mc JOIN seg ON mc.chrom = seg.chrom AND mc.bin = seg.bin GROUP BY ALL")
def score_enrichment(spark, sf):
    return C.enrichment(naive(spark, sf), V.mc_hour(spark, sf)).select("track", r6("score"))


@query(with_(*NAIVE_SEG, PEAKS, """pk AS (SELECT chrom, id, (start + "end") / 2 AS pos, lead((start + "end") / 2) OVER (PARTITION BY chrom ORDER BY (start + "end") / 2, id) - (start + "end") / 2 AS gap FROM peaks)""",
    "near AS (SELECT pk.chrom, id, pos, gap, arg_min(r.start * 3600, {'d': abs(pos - r.start * 3600), 's': -r.start}) AS start, arg_min(r.length * 3600, {'d': abs(pos - r.start * 3600), 's': -r.start}) AS length FROM pk JOIN regions r ON r.chrom = pk.chrom GROUP BY ALL)",
    "kept AS (SELECT * FROM near WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY chrom, start ORDER BY abs(pos - start), id) = 1)") + "SELECT chrom, round(avg((abs(ln(length / gap)) < 0.5)::INT), 6) AS score FROM kept GROUP BY chrom")
def score_nearest(spark, sf):
    scaled = naive_regions(spark, sf).select("chrom", (F.col("start") * 3600).alias("start"), (F.col("length") * 3600).alias("length"))
    gaps = C.peak_gaps(V.peaks(spark, sf))
    return C.gap_agreement(R.nearest_start(gaps.drop("gap"), scaled), gaps, 0.5).select("chrom", r6("score"))


GENES = 'gn AS (SELECT id AS gene, chrom, start, "end" FROM iv)'


def genes(spark, sf) -> DataFrame:
    """Every interval stands for a gene."""
    return V.intervals(spark, sf).select(F.col("id").alias("gene"), "chrom", "start", "end")


@query(with_(*NAIVE_SEG, IV, GENES) + 'SELECT g.chrom, count(DISTINCT gene) AS n FROM gn g JOIN regions r ON g.chrom = r.chrom AND r.start > 0 AND g.start < r.start * 3600 AND r.start * 3600 < g."end" GROUP BY ALL')
def score_gene_breaks(spark, sf):
    boundaries = naive_regions(spark, sf).filter("start > 0").select("chrom", (F.col("start") * 3600).alias("pos"))
    return R.broken_genes(boundaries, genes(spark, sf))


also("score_gene_breaks_whole", "score_gene_breaks")


@query(with_(*NAIVE_SEG, IV, GENES, "opening AS (SELECT chrom, state AS opening FROM regions WHERE start = 0)", "perms AS (SELECT unnest(generate_series(0, 19)) AS perm)",
    "drawn AS (SELECT perm, r.chrom, r.state, r.length, 2 * (row_number() OVER (PARTITION BY perm, r.chrom, r.state ORDER BY md5('1|' || perm || '|' || r.chrom || '|' || r.start)) - 1) + (r.state <> opening)::INT AS turn FROM regions r JOIN opening o ON o.chrom = r.chrom, perms)",
    "placed AS (SELECT perm, chrom, turn, sum(length) OVER (PARTITION BY perm, chrom ORDER BY turn) * 3600 AS pos, max(turn) OVER (PARTITION BY perm, chrom) AS last FROM drawn)",
    "points AS (SELECT perm, chrom, pos FROM placed WHERE turn < last UNION ALL SELECT -1, chrom, start * 3600 FROM regions WHERE start > 0)",
    'hit AS (SELECT p.chrom, perm, count(DISTINCT gene) AS n FROM points p JOIN gn g ON g.chrom = p.chrom AND g.start < pos AND pos < g."end" GROUP BY ALL)',
    "seen AS (SELECT c.chrom, coalesce(max(n), 0) AS observed FROM (SELECT DISTINCT chrom FROM regions) c LEFT JOIN hit h ON h.chrom = c.chrom AND perm = -1 GROUP BY ALL)") + "SELECT s.chrom, observed, round((SELECT count(*) FROM hit h WHERE h.chrom = s.chrom AND perm >= 0 AND h.n > observed) / 20, 6) AS score FROM seen s")
def score_gene_perm(spark, sf):
    return C.permutation_test(naive_regions(spark, sf), genes(spark, sf), 20, 3600, bucket=1 << 13).select("chrom", "observed", r6("score"))


#: Permutations of the reference.
PERMUTATIONS = 500


@query()
def score_gene_perm_whole(spark, sf):
    return C.permutation_test(naive_regions(spark, sf), genes(spark, sf), PERMUTATIONS, 3600, bucket=1 << 13).select("chrom", "observed", r6("score"))


# ---- profiles ----

@query(with_(*NAIVE_SEG, "k AS (SELECT unnest(generate_series(0, 99)) AS k)", "ip AS (SELECT chrom, region, k, start + floor(k * length / 100)::BIGINT AS b0, start + least(floor(k * length / 100)::BIGINT + 1, length - 1) AS b1, k * length / 100 - floor(k * length / 100) AS d FROM regions, k)") + "SELECT a.chrom, region, k::INT AS k, round(s0.value + d * (s1.value - s0.value), 6) AS value FROM ip a JOIN sig s0 ON s0.chrom = a.chrom AND s0.bin = b0 JOIN sig s1 ON s1.chrom = a.chrom AND s1.bin = b1")
def prof_interp(spark, sf):
    return P.interpolated(naive_regions(spark, sf), V.sig_hour(spark, sf), 100).select("chrom", "region", "k", r6("value"))


FLANK = 'fl AS (SELECT r.chrom, region, o."offset", s.value FROM regions r, (SELECT unnest(generate_series(-5, 4)) AS "offset") o, sig s WHERE r.start >= 5 AND r.start + 4 <= 719 AND s.chrom = r.chrom AND s.bin = r.start + o."offset")'


@query(with_(*NAIVE_SEG, FLANK) + 'SELECT chrom, region, "offset"::INT AS "offset", value FROM fl')
def prof_flanks(spark, sf):
    return P.flanks(naive_regions(spark, sf), V.sig_hour(spark, sf), 5)


@query(with_(*NAIVE_SEG, FLANK, 'per AS (SELECT chrom, "offset", avg(value) AS m, count(*) AS w FROM fl GROUP BY ALL)') + 'SELECT "offset"::INT AS "offset", round(sum(m * w) / sum(w), 6) AS value FROM per GROUP BY ALL')
def prof_weighted(spark, sf):
    return P.weighted_mean(prof_flanks(spark, sf), "offset").select("offset", r6("value"))


PROFILES = """ends AS (SELECT chrom, max(bin) AS top FROM mc GROUP BY chrom), want AS (
  SELECT r.chrom, 'left' AS part, p AS position, start - 500 + p AS b0, start - 500 + p AS b1, 0.0 AS d FROM regions r, (SELECT unnest(generate_series(0, 499)) AS p) WHERE state = 1 AND start >= 500
  UNION ALL SELECT r.chrom, 'right', p, start + length + p, start + length + p, 0.0 FROM regions r JOIN ends e ON e.chrom = r.chrom, (SELECT unnest(generate_series(0, 499)) AS p) WHERE state = 1 AND start + length + 499 <= top
  UNION ALL SELECT r.chrom, 'inside', p, start + (p * length) // 100, start + least((p * length) // 100 + 1, length - 1), p * length / 100 - (p * length) // 100 FROM regions r, (SELECT unnest(generate_series(0, 99)) AS p) WHERE state = 1
), got AS (
  SELECT w.chrom, part, position, a.track, avg(a.value + d * (b.value - a.value)) AS m, count(*) AS n FROM want w
  JOIN mc a ON a.chrom = w.chrom AND a.bin = b0 JOIN mc b ON b.chrom = w.chrom AND b.bin = b1 AND b.track = a.track GROUP BY ALL)"""


@query(with_(*NAIVE_SEG, MC_ONLY, PROFILES) + "SELECT track::BIGINT AS track, part, position::INT AS position, round(sum(m * n) / sum(n), 6) AS value, sum(n)::BIGINT AS regions FROM got GROUP BY ALL")
def prof_tracks(spark, sf):
    """All four tracks at once around and inside open regions: 500 bins on both sides, 100 points."""
    opened = naive_regions(spark, sf).filter("state = 1")
    found = P.boundary_profiles(opened, V.mc_hour(spark, sf), [0, 1, 2, 3], 500, 100)
    return found.select(F.col("track").cast("long").alias("track"), "part", "position", r6("value"), "regions")


# ---- many channels ----

def vectors(spark, sf) -> DataFrame:
    """V6: chrom, bin, x."""
    e = V.table(spark, sf, "embeddings")
    return e.select(F.lit("e").alias("chrom"), F.col("vec_id").alias("bin"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def pair_vectors(spark, sf) -> DataFrame:
    return S.stack(V.mc_hour(spark, sf), [0, 1]).select("chrom", "bin", F.array("0", "1").alias("x"))


COV = "cv AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM (SELECT chrom, bin, sum(value) FILTER (track = 0) AS x, sum(value) FILTER (track = 1) AS y FROM mc GROUP BY ALL))"


@query(with_(MC, COV, "ev AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM cv)") + "SELECT 0 AS k, round(l1 / (l1 + l2), 6) AS energy FROM ev UNION ALL SELECT 1, round(l2 / (l1 + l2), 6) FROM ev")
def mc_pca2(spark, sf):
    pca = M.fit_pca(pair_vectors(spark, sf), 2)
    return spark.createDataFrame([(i, round(float(e), 6)) for i, e in enumerate(pca.energy)], "k int, energy double")


@query()
def mc_pca_energy(spark, sf):
    pca = M.fit_pca(vectors(spark, sf), min_energy=0.5)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(pca.energy)], "k int, energy double")


PAIRS = "pr AS (SELECT chrom, bin, sum(value) FILTER (track = 0) AS x, sum(value) FILTER (track = 1) AS y FROM mc GROUP BY ALL)"
AXES = """ax AS (SELECT mx, my, k, b / n AS vx, (l - a) / n AS vy FROM (SELECT *, sqrt(b * b + (l - a) ** 2) AS n FROM (SELECT *, (a + c) / 2 + (1 - 2 * k) * sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM cv, (SELECT unnest([0, 1]) AS k))))"""


@query(with_(MC, COV, AXES, PAIRS) + "SELECT chrom, bin, k::INT AS component, round(((x - mx) * vx + (y - my) * vy) * sign(CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END), 4) + 0.0 AS value FROM pr, ax")
def mc_pca_project(spark, sf):
    data = pair_vectors(spark, sf)
    pca = M.fit_pca(data, 2)
    return data.select("chrom", "bin", F.posexplode(pca.transform(F.col("x"))).alias("component", "value")).withColumn("value", F.round("value", 4) + 0.0)


@query(with_(MC, PAIRS) + "SELECT chrom, bin, round(x, 4) AS x, round(y, 4) AS y FROM pr")
def mc_pca_recover(spark, sf):
    data = pair_vectors(spark, sf)
    pca = M.fit_pca(data, 2)
    back = data.select("chrom", "bin", pca.recover(pca.transform(F.col("x"))).alias("b"))
    return back.select("chrom", "bin", (F.round(F.col("b")[0], 4) + 0.0).alias("x"), (F.round(F.col("b")[1], 4) + 0.0).alias("y"))


@query()
def mc_soft_kmeans(spark, sf):
    means, _, weights = M.soft_clusters(vectors(spark, sf), 3, 5)
    return spark.createDataFrame([(i, float(w), float(sum(v * v for v in m))) for i, (m, w) in enumerate(zip(means, weights, strict=True))], "cluster int, weight double, norm2 double")


@query()
def mc_state_selection(spark, sf):
    """As many clusters of the embeddings' first components as two halves of them agree on."""
    data = vectors(spark, sf)
    pca = M.fit_pca(data, 4)
    found = M.select_states(data.select("chrom", "bin", pca.transform(F.col("x")).alias("x")))
    share = found.weights / found.weights.sum()
    return spark.createDataFrame([(i, round(float(w), 6), round(float(m @ m), 6)) for i, (w, m) in enumerate(zip(share, found.means, strict=True))], "cluster int, weight double, norm2 double")


@query()
def mc_gmm_hmm(spark, sf):
    data = vectors(spark, sf)
    made = M.fit_segmenter(data, 2, dims=3, rounds=2, chunk=1024)
    return H.viterbi(made.pack(data, 1024), made.fit.model)


# ---- wavelets and trees ----


def whole(spark, sf) -> DataFrame:
    return V.sig_hour(spark, sf).select("chrom", "bin", "value")


def on_grid(spark, sf, rows: DataFrame, width: int = 1) -> DataFrame:
    """``rows`` without the bins of ``width`` hours that only pad the signal."""
    return rows.join(S.grid(V.sizes(spark, sf)).select("chrom", F.expr(f"bin div {width}").alias("bin")), ["chrom", "bin"], "left_semi")


def _pyramid_sql() -> str:
    """Ten levels over the zero-padded signal of 720 bins."""
    parts = ["l0 AS (SELECT g.chrom, g.idx, coalesce(s.value, 0.0)::DOUBLE AS approx, 0.0 AS detail FROM (SELECT chrom, unnest(generate_series(0, 1023)) AS idx FROM sizes) g LEFT JOIN sig s ON s.chrom = g.chrom AND s.bin = g.idx)"]
    for i in range(1, 11):
        parts.append(f"l{i} AS (SELECT chrom, idx // 2 AS idx, avg(approx) AS approx, sum(CASE WHEN idx % 2 = 1 THEN approx ELSE -approx END) / 2 AS detail FROM l{i - 1} GROUP BY chrom, idx // 2)")
    return ",\n".join(parts)


@query(with_(SIG, _pyramid_sql()) + " UNION ALL ".join(f"SELECT chrom, {i} AS level, idx, round(approx + 1e-9, 6) + 0.0 AS approx, round(detail + 1e-9, 6) + 0.0 AS detail FROM l{i}" for i in range(1, 11)))
def wav_dwt(spark, sf):
    # halves of six decimals are common in a pyramid; the shift rounds them alike in both engines
    shifted = W.dwt(whole(spark, sf)).withColumns({c: F.col(c) + 1e-9 for c in ("approx", "detail")})
    return shifted.select("chrom", "level", "idx", r6("approx"), r6("detail"))


@query(with_(SIG) + "SELECT chrom, bin, round(value, 6) AS value FROM sig")
def wav_idwt(spark, sf):
    return on_grid(spark, sf, W.idwt(W.dwt(whole(spark, sf)))).select("chrom", "bin", r6("value"))


WIDE = ", ".join(f"({t}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for t, (lo, hi) in enumerate(zip(*W.FOUR, strict=True)))


@query(with_(SIG, f"taps(t, l, h) AS (VALUES {WIDE})", "padded AS (SELECT chrom, bin, value FROM sig UNION ALL SELECT chrom, unnest(generate_series(720, 1023)), 0.0 FROM sizes)")
    + "SELECT chrom, ((bin - t + 1024) % 1024) // 2 AS idx, round(sum(value * l), 6) AS approx, round(sum(value * h), 6) AS detail FROM padded, taps WHERE (bin - t + 1024) % 2 = 0 GROUP BY ALL")
def wav_dwt_four(spark, sf):
    """One level of the four-tap pair."""
    return W.dwt(whole(spark, sf), W.FOUR, 1).select("chrom", "idx", r6("approx"), r6("detail"))


@query(ORACLE_SQL["wav_idwt"])
def wav_idwt_four(spark, sf):
    """All levels of the four-tap pair, there and back."""
    return on_grid(spark, sf, W.idwt(W.dwt(whole(spark, sf), W.FOUR), W.FOUR)).select("chrom", "bin", r6("value"))


also("wav_dwt_whole", "wav_dwt")
also("wav_idwt_whole", "wav_idwt")

TREE = W.TreeModel([0.8, 0.2], [[0.6, 0.4], [0.2, 0.8]], [0.0, 1.0], [20.0, 80.0])


TOP = 10
TREE_POST, TREE_BEST = rec.tree_posterior(TOP, TREE), rec.tree_viterbi(TOP, TREE)
NODES = range(1, TOP + 1)


@query(with_(SIG, _pyramid_sql(), TREE_POST) + " UNION ALL ".join(f"SELECT chrom, {i} AS level, idx, round(g1, 6) AS p FROM g{i}" for i in NODES))
def hmt_posterior(spark, sf):
    return W.tree_posterior(W.dwt(whole(spark, sf)), TREE).select("chrom", "level", "idx", F.round(F.col("gamma")[1], 6).alias("p"))


@query(with_(SIG, _pyramid_sql(), TREE_BEST) + " UNION ALL ".join(f"SELECT chrom, {i} AS level, idx, state FROM w{i}" for i in NODES))
def hmt_viterbi(spark, sf):
    return W.tree_viterbi(W.dwt(whole(spark, sf)), TREE)


ALL_NODES = "an AS (" + " UNION ALL ".join(f"SELECT g0, g1, detail AS x FROM g{i} JOIN l{i} USING (chrom, idx)" for i in NODES) + ")"


@query(with_(SIG, _pyramid_sql(), TREE_POST, ALL_NODES) + " UNION ALL ".join(
    f"SELECT {s} AS state, round((SELECT avg(g{s}) FROM g{TOP}), 6) AS root, round(sum(g{s} * x) / sum(g{s}), 6) AS mean, round(greatest(sqrt(sum(g{s} * (x - {TREE.means[s]}) ** 2) / sum(g{s})), 0.1), 6) AS deviation FROM an" for s in range(2)))
def hmt_fit(spark, sf):
    m = W.tree_fit(W.dwt(whole(spark, sf)), TREE, 1)
    return spark.createDataFrame([(i, *(round(float(v[i]), 6) for v in (m.root, m.means, m.deviations))) for i in range(2)], "state int, root double, mean double, deviation double")


@query(with_(SIG, _pyramid_sql(), TREE_POST, rec.inverse(TOP, "l.detail * g.g1")) + "SELECT chrom, idx AS bin, round(approx, 6) + 0.0 AS value FROM r0 WHERE idx < 720")
def wav_denoise(spark, sf):
    return on_grid(spark, sf, W.denoise(whole(spark, sf), TREE)).select("chrom", "bin", r6("value"))


@query(with_(SIG, _pyramid_sql(), TREE_BEST) + "SELECT chrom, idx AS bin, state FROM w3 WHERE idx < 90")
def hmt_level_seg(spark, sf):
    states = W.tree_viterbi(W.dwt(whole(spark, sf)), TREE).filter("level = 3").select("chrom", F.col("idx").alias("bin"), "state")
    return on_grid(spark, sf, states, 8).select("chrom", "bin", "state")


#: The same tree, but for wider details on the coarse levels.
LEVEL_TREE = W.TreeModel(TREE.root, TREE.transition, TREE.means, TREE.deviations, {9: ([0.0, 2.0], [40.0, 120.0]), 10: ([0.0, 2.0], [40.0, 120.0])})


@query(with_(SIG, _pyramid_sql(), rec.tree_posterior(TOP, LEVEL_TREE)) + " UNION ALL ".join(f"SELECT chrom, {i} AS level, idx, round(g1, 6) AS p FROM g{i}" for i in range(1, TOP + 1)))
def hmt_level_emission(spark, sf):
    return W.tree_posterior(W.dwt(whole(spark, sf)), LEVEL_TREE).select("chrom", "level", "idx", F.round(F.col("gamma")[1], 6).alias("p"))


@query(with_(SIG, MC_ONLY, _pyramid_sql(), TREE_BEST) + " UNION ALL ".join(
    f"SELECT {i} AS level, track::BIGINT AS track, round(avg(value) FILTER (state = 1) / avg(value) FILTER (state = 0), 6) AS score FROM mc JOIN w{i} ON mc.chrom = w{i}.chrom AND mc.bin // {1 << i} = w{i}.idx GROUP BY ALL" for i in range(1, 9)))
def score_hmt(spark, sf):
    """Enrichment of each track in the open nodes of eight levels of the tree."""
    states = W.tree_viterbi(W.dwt(whole(spark, sf)), TREE).filter("level <= 8").select("chrom", "level", "idx", "state")
    tracks = V.mc_hour(spark, sf).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("idx", F.expr("shiftright(bin, level)"))
    both = tracks.join(states, ["chrom", "level", "idx"])
    signal, seg = both.select("chrom", "bin", "level", "track", "value"), both.select("chrom", "bin", "level", "state")
    keyed = lambda df, *more: df.select(F.concat_ws("|", "chrom", "level").alias("chrom"), "bin", "level", *more)
    once = keyed(seg, "state").select("chrom", "bin", "state").distinct()
    return C.enrichment(once, keyed(signal, "track", "value"), ("level", "track")).select("level", "track", r6("score"))


# ---- model selection ----

def _trial(spark, sf, **grid) -> L.Trial:
    """Cells trained on the sums of all tracks, which decode the four tracks."""
    samples = V.mc_hour(spark, sf).select(F.col("track").cast("string").alias("sample"), "chrom", "bin", "value")
    return L.train_grid(V.sig_hour(spark, sf), samples, chunk=1024, **grid)


@query()
def sel_grid(spark, sf):
    """Four resolutions, two families and seven floors, five rounds each: likelihood, and how consistent and enriched the segmentations are."""
    scorers = [L.ConsistencyScorer(), L.EnrichmentScorer(V.mc_hour(spark, sf)), L.LikelihoodScorer("samples")]
    found = L.score_grid(_trial(spark, sf), scorers)
    return found.select("factor", "family", "floor", *[r6(c) for c in ("loglik", "consistency", "enrichment", "loglik_samples")])


@query()
def sel_evaluate(spark, sf):
    """All scorers on one cell of each family."""
    scorers = [L.ConsistencyScorer(), L.EnrichmentScorer(V.mc_hour(spark, sf)), L.LikelihoodScorer(), L.NearestScorer(V.peaks(spark, sf), 3600, 0.5), L.GenesScorer(_genes(spark, sf), 3600, 20)]
    found = L.score_grid(_trial(spark, sf, factors=(1,), floors=(0.9,)), scorers)
    return found.select("family", "floor", *[r6(c) for c in ("loglik", "consistency", "enrichment", "loglik_training", "nearest", "genes")])


def _genes(spark, sf) -> DataFrame:
    return V.intervals(spark, sf).select(F.col("id").alias("gene"), "chrom", "start", "end")


@query()
def sel_regions(spark, sf):
    """Ten and a hundred parts of one chromosome, judged by another."""
    sym = symbols(spark, sf)
    each = [L.training_regions(sym, "click", "view", parts, 5, 1024).select(F.lit(parts).alias("parts"), "part", r6("loglik"), "best") for parts in (10, 100)]
    return each[0].unionByName(each[1])


LEAVES = [0.1**i for i in range(1, 6)]


def _sweep_sql() -> str:
    """Two rounds of training from each of the 25 first transitions."""
    cells = []
    for p in LEAVES:
        for q in LEAVES:
            tables = ", ".join(f"CASE {{x}} WHEN 0 THEN {{m}}.e{s}0 WHEN 1 THEN {{m}}.e{s}1 WHEN 2 THEN {{m}}.e{s}2 ELSE {{m}}.e{s}3 END AS e{s}" for s in range(2))
            model_of = [f"coalesce(sum(g{s}) FILTER (x = {m}), 0) / sum(g{s})" for s in range(2) for m in range(4)]
            trained = rec.em(lambda x, m: tables.format(x=x, m=m), "sym", 2, START, ((1 - q, q), (p, 1 - p)), (EM_D, [str(v) for row in H.DEFAULT_TABLE for v in row]), model_of)  # noqa: B023
            cells.append(f"SELECT * FROM (WITH RECURSIVE {trained} SELECT {p} AS leave_open, {q} AS leave_closed, (SELECT round(sum(l), 4) FROM f1 WHERE bin = 719) AS loglik)")
    return with_(SIG, X, T3, SYM.replace("sym AS (", "sym AS MATERIALIZED (")) + " UNION ALL ".join(cells)


@query(_sweep_sql())
def sel_prior_sweep(spark, sf):
    rows = [(p, q, round(float(v), 4)) for p, q, v in L.prior_sweep(packed_symbols(spark, sf, 1024), LEAVES, LEAVES, 2)]
    return spark.createDataFrame(rows, "leave_open double, leave_closed double, loglik double")


@query("SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, source LIMIT 1")
def sel_top_cell(spark, sf):
    return C.most_common(V.table(spark, sf, "documents"), "source")


# ---- sinks and metadata ----

@query(with_(SIG, "seg AS (SELECT chrom, bin, round(value, 3) AS state FROM sig)", RUNS) + 'SELECT chrom, start * 3600 AS start, (start + length) * 3600 AS "end", state AS score FROM regions')
def io_bedgraph_rows(spark, sf):
    return O.bedgraph_rows(V.sig_hour(spark, sf), 3600)


@query(with_(*NAIVE_SEG) + """SELECT chrom, start * 3600 AS start, (start + length) * 3600 AS "end", state::VARCHAR AS name, 0 AS score, '.' AS strand, start * 3600 AS thick_start, (start + length) * 3600 AS thick_end,
  CASE state WHEN 0 THEN '128,128,128' ELSE '0,128,0' END AS color FROM regions""")
def io_bed9_rows(spark, sf):
    return O.bed9_rows(naive(spark, sf), 3600)


@query("SELECT 'e' || event_id AS file, event_type AS type, user_id::VARCHAR AS user FROM events")
def sig_meta_map(spark, sf):
    e = V.table(spark, sf, "events")
    lines = e.select(F.concat(F.lit("e"), "event_id", F.lit("\ttype="), "event_type", F.lit("; user="), "user_id", F.lit(";")).alias("value"))
    return I.wide_metadata(I.parse_metadata(lines), ["type", "user"])


# ---- fitted alphabets and words ----


@query(with_(SIG) + "SELECT chrom, bin, (value > 0 AND exp(floor(value) * ln(120.0) - 120.0 - lgamma(floor(value) + 1)) < 0.002 * 0.8)::INT AS symbol FROM sig")
def disc_noise_poisson(spark, sf):
    return V.sig_hour(spark, sf).select("chrom", "bin", D.poisson_symbol(F.col("value"), 120.0, 0.2, 0.002).alias("symbol"))


@query(with_(MC, "fit AS (SELECT track, avg(value) FILTER (value > 0) AS mean, avg((value = 0)::INT) AS bias FROM mc GROUP BY track)")
    + "SELECT chrom, bin, mc.track::INT AS track, (value > 0 AND exp(-value / mean) / mean < 0.002 * (1 - bias))::INT AS symbol FROM mc JOIN fit ON fit.track = mc.track")
def disc_fit_exponential(spark, sf):
    wide = S.stack(V.mc_hour(spark, sf), [0, 1, 2, 3])
    cells = F.array(*[D.fits(wide, str(i), kinds=("exponential_zero",))["exponential_zero"].symbol(F.col(str(i))) for i in range(4)])
    return wide.select("chrom", "bin", F.posexplode(cells).alias("track", "symbol"))


def _fitted_sql(n: str, rows: str) -> str:
    """CTE ns (chrom, bin, symbol): ``rows`` (chrom, bin, value) by the alphabet of the nearest hypothesis."""
    density = lambda h, s, w: f"(1 - {w}) * {pdf('ln(1 + value)', f'{h}.u{s}', f'greatest({h}.d{s}, 1e-6)')}"
    upper = lambda h: f"{density(h, 1, f'{h}.w')} > {density(h, 0, f'(1 - {h}.w)')}"
    noise = {"exponential": "exp(-value / mean) / mean", "poisson": "exp(floor(value) * ln(mean) - mean - lgamma(floor(value) + 1))"}
    tests = [f"WHEN '{kind}{zero}' THEN value > 0 AND {p} < 0.002 * (1 - {bias})" for kind, p in noise.items() for zero, bias in (("", "0"), ("_zero", "zeros"))]
    tests += [f"WHEN 'gaussian_2' THEN {upper('h')}", f"WHEN 'gaussian_2_zero' THEN value > 0 AND {upper('z')}"]
    deciles = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    return f"""{n}q AS (SELECT quantile_cont(value, {deciles}) AS q FROM {rows}),
{n}j AS (SELECT q[i] AS jump FROM {n}q, (SELECT unnest(generate_series(1, 10)) AS i) ORDER BY round(q[i + 1] - q[i], 9) DESC, i LIMIT 1),
{n}s AS (SELECT chrom, bin, (CASE chosen {' '.join(tests)} ELSE round(value, 9) > round(jump, 9) END)::INT AS symbol FROM {rows}, {n}p, {n}h20 h, {n}z20 z, {n}best, {n}j)"""


TRACK_ROWS = ",\n".join(f"t{i} AS MATERIALIZED (SELECT chrom, bin, value FROM mc WHERE track = {i})" for i in range(4))


@query(with_(MC, TRACK_ROWS, *[f"{ks_sql(f'k{i}', f't{i}')},\n{_fitted_sql(f'k{i}', f't{i}')}" for i in range(4)])
    + "SELECT chrom, bin, " + ", ".join(f"k{i}s.symbol AS s{i}" for i in range(4)) + ", (" + " + ".join(f"{1 << i} * k{i}s.symbol" for i in range(4)) + ")::BIGINT AS packed FROM k0s JOIN k1s USING (chrom, bin) JOIN k2s USING (chrom, bin) JOIN k3s USING (chrom, bin)")
def disc_fit_alphabets(spark, sf):
    """The nearest distribution of each track, applied, and all tracks in one word."""
    wide = S.stack(V.mc_hour(spark, sf), [0, 1, 2, 3])
    wide = wide.select("chrom", "bin", *[F.col(str(i)).alias(f"t{i}") for i in range(4)])
    fitted = D.fit_alphabets(wide, [f"t{i}" for i in range(4)])
    symbols_ = [a.symbol(F.col(f"t{i}")) for i, a in enumerate(fitted)]
    return wide.select("chrom", "bin", *[s.alias(f"s{i}") for i, s in enumerate(symbols_)], D.pack(symbols_, [2] * 4).alias("packed"))


CHANNEL_SYM = """ct AS (SELECT quantile_cont(ln(1 + value), [0.6, 0.75, 0.9]) AS t FROM mc),
cs AS (SELECT chrom, bin, track, (round(ln(1 + value), 9) >= round(t[1], 9))::INT + (round(ln(1 + value), 9) >= round(t[2], 9))::INT + (round(ln(1 + value), 9) >= round(t[3], 9))::INT AS symbol FROM mc, ct)"""


def channels(spark, sf) -> DataFrame:
    """chrom, bin, x: the four tracks."""
    return S.stack(V.mc_hour(spark, sf), [0, 1, 2, 3]).select("chrom", "bin", F.array("0", "1", "2", "3").alias("x"))


@query(with_(MC, CHANNEL_SYM) + "SELECT chrom, bin, track::INT AS channel, symbol FROM cs")
def disc_channel_symbols(spark, sf):
    data = channels(spark, sf)
    symbols_, _ = D.channel_symbols(data)
    return data.select("chrom", "bin", F.posexplode(symbols_).alias("channel", "symbol"))


@query(with_(MC, CHANNEL_SYM) + "SELECT chrom, bin, sum(power(2, symbol * 4 + track))::BIGINT AS word FROM cs GROUP BY ALL")
def disc_words(spark, sf):
    data = channels(spark, sf)
    symbols_, cuts = D.channel_symbols(data)
    return data.select("chrom", "bin", D.one_hot_word(symbols_, 4, len(cuts) + 1).alias("word"))


def _mvn2(m: tuple, c: tuple) -> str:
    """Density of (x, y) with covariance ((a, b), (b, d))."""
    (a, b), (_, d) = c
    det = a * d - b * b
    return f"exp(-0.5 * ({d} * (x - {m[0]}) ** 2 - 2 * {b} * (x - {m[0]}) * (y - {m[1]}) + {a} * (y - {m[1]}) ** 2) / {det}) / (2 * pi() * sqrt({det}))"


MVN_PARTS = ((3.0, 2.0), ((1.0, 0.5), (0.5, 2.0))), ((1.0, 1.0), ((0.5, 0.0), (0.0, 0.5)))


@query(with_(MC, PAIRS.replace("sum(value) FILTER (track = 0) AS x, sum(value) FILTER (track = 1) AS y", "ln(1 + sum(value) FILTER (track = 0)) AS x, ln(1 + sum(value) FILTER (track = 1)) AS y"))
    + f"SELECT chrom, bin, round({floored('0.7 * ' + _mvn2(*MVN_PARTS[0]) + ' + 0.3 * ' + _mvn2(*MVN_PARTS[1]))}, 6) AS p FROM pr")
def hmm_emission_mvn_mixture(spark, sf):
    wide = S.stack(V.mc_hour(spark, sf), [0, 1])
    (p,) = E.MultivariateMixture([[0.7, 0.3]], [[list(m) for m, _ in MVN_PARTS]], [[[list(r) for r in c] for _, c in MVN_PARTS]]).columns(F.array(F.log1p("0"), F.log1p("1")))
    return wide.select("chrom", "bin", F.round(p, 6).alias("p"))


def _pair(x: str, m: str, s: str) -> str:
    """Density of the list x of two under the state or component s of the model m."""
    det, dx, dy = f"({m}.vx{s} * {m}.vy{s} - {m}.vxy{s} ** 2)", f"({x}[1] - {m}.mx{s})", f"({x}[2] - {m}.my{s})"
    return f"exp(-0.5 * ({m}.vy{s} * {dx} ** 2 - 2 * {m}.vxy{s} * {dx} * {dy} + {m}.vx{s} * {dy} ** 2) / {det}) / (2 * pi() * sqrt({det}))"


def _pair_step(weight: dict[str, str]) -> list[str]:
    """SQL of the next means and covariances; weight: each point's by state or component."""
    moment = lambda s, e: f"sum({weight[s]} * {e}) / sum({weight[s]})"
    dx, dy = (lambda s: f"(x[1] - m.mx{s})"), (lambda s: f"(x[2] - m.my{s})")
    return [
        *[moment(s, "x[1]") for s in weight], *[moment(s, "x[2]") for s in weight],
        *[f"greatest({moment(s, f'{dx(s)} ** 2')}, 0.5)" for s in weight], *[moment(s, f"{dx(s)} * {dy(s)}") for s in weight], *[f"greatest({moment(s, f'{dy(s)} ** 2')}, 0.5)" for s in weight],
    ]


def _pair_names(of: list[str]) -> list[str]:
    return [f"{n}{s}" for n in ("mx", "my", "vx", "vxy", "vy") for s in of]


def _pair_values(means: list, covariances: list) -> list[str]:
    c = covariances
    return [str(v) for v in ([m[0] for m in means] + [m[1] for m in means] + [x[0][0] for x in c] + [x[0][1] for x in c] + [x[1][1] for x in c])]


LOG_PAIRS = "train AS MATERIALIZED (SELECT chrom, bin, [ln(1 + coalesce(sum(value) FILTER (track = 0), 0)), ln(1 + coalesce(sum(value) FILTER (track = 1), 0))] AS x FROM mc GROUP BY ALL)"
GAUSS2 = E.MultivariateNormal([[0.5, 0.5], [3.5, 3.0]], [[[1.0, 0.2], [0.2, 1.0]], [[2.0, -0.5], [-0.5, 2.0]]])
GAUSS2_NAMES, GAUSS2_VALUES = _pair_names(["0", "1"]), _pair_values(GAUSS2.means, GAUSS2.covariances)
GAUSS2_OF = lambda x, m: ", ".join(f"{floored(_pair(x, m, s))} AS e{s}" for s in "01")
MIX2 = E.MultivariateMixture([[0.6, 0.4], [0.5, 0.5]], [[[0.0, 0.0], [1.0, 1.0]], [[4.0, 1.0], [1.0, 4.0]]], [[[[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.3], [0.3, 1.0]]], [[[2.0, 0.5], [0.5, 1.0]], [[1.0, 0.5], [0.5, 2.0]]]])
PARTS = ["00", "01", "10", "11"]
MIX2_NAMES = [*_pair_names(PARTS), *[f"w{p}" for p in PARTS]]
MIX2_VALUES = [*_pair_values([m for row in MIX2.means for m in row], [c for row in MIX2.covariances for c in row]), *[str(w) for row in MIX2.weights for w in row]]


def _weighted(x: str, m: str, p: str) -> str:
    return f"{m}.w{p} * {_pair(x, m, p)}"


def MIX2_OF(x: str, m: str) -> str:
    return ", ".join(f"{floored(_weighted(x, m, s + '0') + ' + ' + _weighted(x, m, s + '1'))} AS e{s}" for s in "01")


def first_of(names: list[str], values: list[str], of) -> str:
    """CTE obs: densities of ``train`` under a model before any training."""
    model = ", ".join(f"{v}::DOUBLE AS {n}" for n, v in zip(names, values, strict=True))
    return f"first AS (SELECT {model}), obs AS MATERIALIZED (SELECT s.chrom, s.bin, {of('s.x', 'm')} FROM train s, first m)"


def log_pairs(spark, sf) -> DataFrame:
    """chrom, bin, obs: ln(1 + value) of the first two tracks."""
    return S.stack(V.mc_hour(spark, sf), [0, 1]).select("chrom", "bin", F.array(F.log1p("0"), F.log1p("1")).alias("obs"))


def pair_rows(spark, emission: E.MultivariateNormal, last: float) -> DataFrame:
    rows = [(s, *(round(float(v), 6) for v in (*m, c[0][0], c[0][1], c[1][1], last))) for s, (m, c) in enumerate(zip(emission.means, emission.covariances, strict=True))]
    return spark.createDataFrame(rows, "state int, mx double, my double, vx double, vxy double, vy double, loglik double")


@query(with_(MC, LOG_PAIRS, rec.em(GAUSS2_OF, "train", 3, START, TRANS, (GAUSS2_NAMES, GAUSS2_VALUES), _pair_step({"0": "g0", "1": "g1"})), recursive=True)
    + " UNION ALL ".join(f"SELECT {s} AS state, " + ", ".join(f"round({n}{s}, 6) AS {n}" for n in ("mx", "my", "vx", "vxy", "vy")) + ", (SELECT round(sum(l), 6) FROM f2 WHERE bin = 719) AS loglik FROM m3" for s in range(2)))
def em_gaussian_pairs(spark, sf):
    """Training of two-dimensional Gaussians with full covariances on two tracks of all chromosomes."""
    fit = baum_welch(H.pack(log_pairs(spark, sf), chunk=256), H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, GAUSS2), Iterations(3))
    return pair_rows(spark, fit.model.emission, fit.likelihoods[-1])


def _pair_share(p: str) -> str:
    return f"(g{p[0]} * {_weighted('x', 'm', p)} / {floored(_weighted('x', 'm', p[0] + '0') + ' + ' + _weighted('x', 'm', p[0] + '1'))})"


MIX2_STEP = [*_pair_step({p: _pair_share(p) for p in PARTS}), *[f"sum({_pair_share(p)}) / (sum({_pair_share(p[0] + '0')}) + sum({_pair_share(p[0] + '1')}))" for p in PARTS]]


@query(with_(MC, LOG_PAIRS, rec.em(MIX2_OF, "train", 3, START, TRANS, (MIX2_NAMES, MIX2_VALUES), MIX2_STEP), recursive=True)
    + " UNION ALL ".join(f"SELECT {p[0]} AS state, {p[1]} AS component, " + ", ".join(f"round({n}{p}, 6) AS {c}" for n, c in (("w", "weight"), ("mx", "mx"), ("my", "my"), ("vx", "vx"), ("vxy", "vxy"), ("vy", "vy"))) + " FROM m3" for p in PARTS))
def em_mixture_pairs(spark, sf):
    """Training of mixtures of two-dimensional Gaussians, two components a state."""
    e = baum_welch(H.pack(log_pairs(spark, sf), chunk=256), H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, MIX2), Iterations(3)).model.emission
    rows = []
    for s in range(2):
        for c in range(2):
            m, v = e.means[s][c], e.covariances[s][c]
            rows.append((s, c, *(round(float(x), 6) for x in (e.weights[s][c], *m, v[0][0], v[0][1], v[1][1]))))
    return spark.createDataFrame(rows, "state int, component int, weight double, mx double, my double, vx double, vxy double, vy double")


@query(with_(MC, LOG_PAIRS, first_of(GAUSS2_NAMES, GAUSS2_VALUES, GAUSS2_OF), VIT, recursive=True) + "SELECT chrom, bin, state FROM path")
def hmm_viterbi_pairs(spark, sf):
    """Best path under two-dimensional Gaussians."""
    return H.viterbi(H.pack(log_pairs(spark, sf), chunk=128), H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, GAUSS2, H.DEFAULT_END))


@query(with_(MC, LOG_PAIRS, first_of(MIX2_NAMES, MIX2_VALUES, MIX2_OF), VIT, recursive=True) + "SELECT chrom, bin, state FROM path")
def hmm_viterbi_mixture_pairs(spark, sf):
    """Best path under mixtures of two-dimensional Gaussians."""
    return H.viterbi(H.pack(log_pairs(spark, sf), chunk=128), H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, MIX2, H.DEFAULT_END))


# ---- estimators ----

TRAINED = "obs AS MATERIALIZED (SELECT s.chrom, s.bin, CASE s.x WHEN 0 THEN m.e00 WHEN 1 THEN m.e01 WHEN 2 THEN m.e02 ELSE m.e03 END AS e0, CASE s.x WHEN 0 THEN m.e10 WHEN 1 THEN m.e11 WHEN 2 THEN m.e12 ELSE m.e13 END AS e1, m.p0, m.p1, m.a00, m.a01, m.a10, m.a11 FROM sym s, m2 m)"
TRAINED_VIT = rec.viterbi("obs", ("p0", "p1"), (("o.a00", "o.a01"), ("o.a10", "o.a11")), END)


@query(with_(SIG, X, T3, SYM, "train AS (SELECT chrom, bin, x FROM sym WHERE chrom = 'click')", em_discrete_sql(2), TRAINED, TRAINED_VIT, recursive=True) + "SELECT chrom, bin, state FROM path")
def est_fit_classify(spark, sf):
    """A discrete strategy trained on one chromosome, saved, loaded, and applied to all."""
    signal, root = V.sig_hour(spark, sf), folders.scratch_folder(spark, "models")
    made = T.Segmenter(T.DiscreteStrategy())
    made.fit(signal, Iterations(2), ["click"])
    made.save(spark, root)
    return T.Segmenter.load(spark, root, made.name).classify(signal)


SPLIT = """mr AS (SELECT chrom, start, length FROM regions WHERE length > 1),
sx AS (SELECT s.chrom || ':' || start AS chrom, bin - start AS bin, ln(1 + value) AS x FROM sig s JOIN mr ON mr.chrom = s.chrom AND s.bin >= start AND s.bin < start + length),
st AS (SELECT quantile_cont(x, [0.6, 0.75, 0.9]) AS t FROM sx),
train AS (SELECT chrom, bin, (round(x, 9) > round(t[1], 9))::INT + (round(x, 9) > round(t[2], 9))::INT + (round(x, 9) > round(t[3], 9))::INT AS x FROM sx, st)"""


@query(with_(SIG, "seg AS (SELECT chrom, bin, 1 AS state FROM sig WHERE value >= 5)", RUNS, SPLIT, em_discrete_sql(2), recursive=True) + MODEL_OUT + "".join(f", round({c}, 6) AS {c}" for c in EM_D) + " FROM m2")
def est_mappable_runs(spark, sf):
    """Training on the runs of a mask, each a sequence of its own."""
    signal = V.sig_hour(spark, sf)
    fit = T.Segmenter(T.DiscreteStrategy()).fit_mappable(signal.select("chrom", "bin", "value"), signal, Iterations(2), 5.0, 1)
    return model_row(spark, fit, EM_D, [v for row in fit.model.emission.table for v in row]).drop("loglik")


CS_NAMES = [f"e{s}_{f}_{m}" for s in range(2) for f in range(4) for m in range(4)]
CS_VALUES = [str(v) for row in ((0.4, 0.3, 0.2, 0.1), (0.1, 0.2, 0.3, 0.4)) for _ in range(4) for v in row]


def CS_OF(x: str, m: str) -> str:
    one = lambda s, f: f"(CASE {x}[{f + 1}] " + " ".join(f"WHEN {k} THEN {m}.e{s}_{f}_{k}" for k in range(4)) + " END)"
    return ", ".join(f"{floored(' * '.join(one(s, f) for f in range(4)))} AS e{s}" for s in range(2))


CS_STEP = [f"coalesce(sum(g{s}) FILTER (x[{f + 1}] = {m}), 0) / sum(g{s})" for s in range(2) for f in range(4) for m in range(4)]
CS_OBS = f"obs AS MATERIALIZED (SELECT s.chrom, s.bin, {CS_OF('s.x', 'm')}, m.p0, m.p1, m.a00, m.a01, m.a10, m.a11 FROM train s, m2 m)"
CS_PATH = rec.viterbi("obs", ("p0", "p1"), (("o.a00", "o.a01"), ("o.a10", "o.a11")), END, 359)


@query(with_(MC, "mc2 AS (SELECT chrom, bin // 2 AS bin, track, sum(value) AS value FROM mc GROUP BY ALL)", CHANNEL_SYM.replace("FROM mc", "FROM mc2"), "train AS MATERIALIZED (SELECT chrom, bin, list(symbol ORDER BY track) AS x FROM cs GROUP BY ALL)",
    rec.em(CS_OF, "train", 2, START, TRANS, (CS_NAMES, CS_VALUES), CS_STEP), CS_OBS, CS_PATH, recursive=True) + "SELECT chrom, bin, state FROM path")
def est_channel_symbols(spark, sf):
    """Symbols of four tracks in bins of two hours, a model of independent symbols trained on them, and its best path."""
    made = T.Segmenter(T.ChannelSymbolsStrategy(4), 2)
    made.fit(channels(spark, sf), Iterations(2))
    return made.classify(channels(spark, sf))


@query()
def est_channels(spark, sf):
    made = T.Segmenter(T.ChannelsStrategy(2, dims=2))
    made.fit(channels(spark, sf), Iterations(2), ["click", "view"])
    return made.classify(channels(spark, sf))


# ---- features, files and checks ----


@query(with_(*NAIVE_SEG) + f"SELECT s.chrom, region, any_value(s2.state) AS state, any_value(r_length) * 3600 AS length, round(any_value(total) / any_value(r_length), 6) AS average_signal, round(max(top), 6) AS largest_signal FROM (SELECT s.chrom, r.region, r.state, r.length AS r_length, sum(value) AS total, max(value) AS top FROM sig s {IN_REGION} GROUP BY ALL) s JOIN (SELECT chrom, region AS rr, state FROM regions) s2 ON s2.chrom = s.chrom AND s2.rr = s.region GROUP BY ALL")
def reg_features(spark, sf):
    return R.feature_matrix(naive_regions(spark, sf), V.sig_hour(spark, sf), [0, 2, 3, 4], 3600).withColumns({c: F.round(c, 6) + 0.0 for c in ("average_signal", "largest_signal")})


@query(with_(MC) + "SELECT 'c' || (track % 2) AS cell, chrom, bin, round(sum(value) / 2, 6) AS value FROM mc GROUP BY ALL")
def sig_cell_mean(spark, sf):
    """Means of the samples of each cell type."""
    samples = V.mc_hour(spark, sf).withColumn("cell", F.concat(F.lit("c"), F.col("track") % 2))
    return S.sample_mean(samples, 2, ("cell", "chrom", "bin")).select("cell", "chrom", "bin", r6("value"))


@query("""SELECT source AS chrom, (dense_rank() OVER (ORDER BY source) + 26)::INT AS chrom_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
UNION ALL SELECT 'chr' || s_nationkey, s_nationkey::INT FROM (SELECT DISTINCT s_nationkey FROM supplier) UNION ALL SELECT 'chrX', 25 UNION ALL SELECT 'chrY', 24 UNION ALL SELECT 'chrM', 26""")
def sig_chrom_ids(spark, sf):
    odd = V.table(spark, sf, "documents").select(F.col("source").alias("chrom")).filter("chrom is not null")
    numbered = V.table(spark, sf, "supplier").select(F.concat(F.lit("chr"), "s_nationkey").alias("chrom"))
    fixed = spark.createDataFrame([("chrX",), ("chrY",), ("chrM",)], "chrom string")
    return I.chrom_ids(odd.unionByName(numbered).unionByName(fixed).distinct())


RASTER = "cut AS (SELECT chrom, start, \"end\", score, unnest(generate_series(start // 3600, (\"end\" - 1) // 3600)) AS bin FROM iv WHERE start < \"end\")"


@query(with_(IV, RASTER) + 'SELECT chrom, bin, round(sum(score * (least("end", (bin + 1) * 3600) - greatest(start, bin * 3600))) / 3600, 6) AS value FROM cut WHERE chrom IN (\'click\', \'view\') GROUP BY ALL')
def io_bedgraph_store(spark, sf):
    """Intervals through bedGraph files, bins and the store, two chromosomes read back."""
    folder = folders.scratch_folder(spark, "bedgraph")
    O.write_tsv(V.intervals(spark, sf).filter("start < end").select("chrom", "start", "end", "score"), f"{folder}/text")
    I.load_mappability(spark, f"{folder}/text", f"{folder}/store", 3600)
    return I.load_signal(spark, f"{folder}/store", ["click", "view"], lambda df: df.select("chrom", "bin", r6("value")))


@query("SELECT event_type AS chrom, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 3600 AS bin, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def io_wig_store(spark, sf):
    """Events through variableStep wig files."""
    folder = folders.scratch_folder(spark, "wig")
    O.write_wig(V.intervals(spark, sf).select("chrom", "start", "score"), folder, 60)
    return I.wig_bins(I.read_wig(spark, folder), 3600).select("chrom", "bin", r6("value"))


@query(with_(SIG, "seg AS (SELECT chrom, bin, round(value, 3) AS state FROM sig WHERE value <> 0)", RUNS) + 'SELECT chrom, start * 3600 AS start, (start + length) * 3600 AS "end", state AS score FROM regions')
def io_wig_bedgraph(spark, sf):
    """The hourly signal as wig files, converted to bedGraph text, read again."""
    folder = folders.scratch_folder(spark, "convert")
    steps = V.sig_hour(spark, sf).filter("value <> 0").select("chrom", (F.col("bin") * 3600).alias("start"), F.round("value", 3).alias("score"))
    O.write_wig(steps, f"{folder}/wig/all.wig", 3600)
    merged = I.merge_steps(I.read_wig(spark, f"{folder}/wig/all.wig"))
    O.write_tsv(merged.select("chrom", "start", "end", "score"), f"{folder}/bedgraph")
    return I.read_bedgraph(spark, f"{folder}/bedgraph")


@query(with_(*NAIVE_SEG) + "SELECT chrom, region, start * 3600 AS start, length * 3600 AS length, state FROM regions WHERE chrom IN ('click', 'view')")
def io_segment_store(spark, sf):
    """Regions of all chromosomes stored by cell type and model, those of two read back."""
    folder = folders.scratch_folder(spark, "segments")
    G.save_segmentation(naive_regions(spark, sf), folder, "hourly", "naive", 3600)
    return G.load_segmentation(spark, folder, "hourly", "naive", ["click", "view"])


@query(with_(PEAKS) + 'SELECT chrom, start, "end", score AS p_value FROM peaks')
def io_broad_peaks(spark, sf):
    folder, dot = folders.scratch_folder(spark, "peaks"), F.lit(".")
    O.write_tsv(V.peaks(spark, sf).select("chrom", "start", "end", dot.alias("n"), F.lit(0).alias("s"), dot.alias("d"), F.lit(1.5).alias("g"), "score", F.lit(-1).alias("q")), folder)
    return I.read_broad_peaks(spark, folder)


@query(with_(IV) + 'SELECT \'g\' || id AS gene, chrom, CASE id % 2 WHEN 0 THEN 1 ELSE -1 END AS strand, start, "end" FROM iv')
def io_genes(spark, sf):
    folder = folders.scratch_folder(spark, "genes")
    sign = F.when(F.col("id") % 2 == 0, "+").otherwise("-")
    rows = V.intervals(spark, sf).select(F.concat(F.lit("g"), "id").alias("g"), "chrom", sign.alias("sign"), "start", "end", F.col("start").alias("cs"), F.col("end").alias("ce"), F.lit(1).alias("n"), F.lit("1,").alias("a"), F.lit("2,").alias("b"), F.lit("p").alias("p"), F.lit("x").alias("x"))
    O.write_tsv(rows, folder)
    return I.read_genes(spark, folder).select("gene", "chrom", "strand", "start", "end")


@query("SELECT event_type AS chrom, max(event_id)::BIGINT AS size FROM events GROUP BY ALL")
def io_sizes(spark, sf):
    folder = folders.scratch_folder(spark, "sizes")
    rows = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("chrom")).agg(F.max("event_id").alias("size"))
    O.write_tsv(rows, folder, ("chrom",))
    return I.read_sizes(spark, folder)


@query("SELECT event_type AS chrom, max(h) + 1 AS bins, count(*) AS rows, (count(*) - count(DISTINCT h))::BIGINT AS duplicates, (max(h) + 1 - count(DISTINCT h))::BIGINT AS gaps, count(DISTINCT h) = count(*) AND count(DISTINCT h) = max(h) + 1 AND min(h) = 0 AS fine FROM (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS h FROM events) GROUP BY ALL")
def io_check_store(spark, sf):
    """Whether the raw events would do as a store: they do not, where hours repeat or lack."""
    raw = V.table(spark, sf, "events").select(F.col("event_type").alias("chrom"), V.since("HOUR").alias("bin"), "value")
    return I.check_store(raw).select("chrom", "bins", "rows", "duplicates", "gaps", "fine")


@query("SELECT 'f' || event_id || '.bw' AS position, event_type AS type, (user_id % 3)::VARCHAR AS lab FROM events")
def io_composite_tracks(spark, sf):
    """Members of a composite track; the groups are read back from their stanzas."""
    e = V.table(spark, sf, "events")
    meta = e.select(F.concat(F.lit("f"), "event_id", F.lit(".bw")).alias("file"), F.col("event_type").alias("type"), (F.col("user_id") % 3).alias("lab"))
    got = O.composite_tracks(meta, "all", "All tracks", ["type", "lab"]).filter("position <> ''")
    return got.select("position", F.regexp_extract("stanza", r"type=(\S+)", 1).alias("type"), F.regexp_extract("stanza", r"lab=(\S+)", 1).alias("lab"))
