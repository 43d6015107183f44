"""Queries of correlation grids, linear models, group tests and bootstraps on a daily master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models, segments

from .registry import query, rounded, table

_MASTER = """master as (select o.day, year(o.day)::int as y, price, n_orders, qty, disc, tax, sin(2 * pi() * dayofyear(o.day) / 365.25) as s1, cos(2 * pi() * dayofyear(o.day) / 365.25) as c1,
 case when dayofyear(o.day) % 5 = 0 then 'storm' when dayofyear(o.day) % 5 < 3 then 'quiet' else 'active' end as class
 from (select o_orderdate::date as day, avg(o_totalprice) as price, count(*)::double as n_orders from orders group by all) o
 join (select l_shipdate::date as day, avg(l_quantity) as qty, avg(l_discount) as disc, avg(l_tax) as tax from lineitem group by all) l on o.day = l.day)"""
XS = ["n_orders", "qty", "disc", "s1", "c1"]


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n_orders"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    angle, part = 2 * F.pi() * F.dayofyear("day") / 365.25, F.dayofyear("day") % 5
    klass = F.when(part == 0, "storm").when(part < 3, "quiet").otherwise("active")
    return orders.join(lines, "day").withColumns({"y": F.year("day"), "s1": F.sin(angle), "c1": F.cos(angle), "class": klass})


# p values in SQL are Simpson sums of the densities over 2,000 steps.
_SIMPSON = "list_sum(list_transform(range(0, 2001), lambda k: (case when k = 0 or k = 2000 then 1 when k % 2 = 1 then 4 else 2 end) * {f}))"


def t_p_sql(t: str, df: str) -> str:
    angle = f"atan(abs({t}) / sqrt({df}))"
    area = _SIMPSON.format(f=f"pow(cos({angle} * k / 2000), ({df}) - 1)")
    return f"greatest(0.0, 1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {angle} / 6000 * {area})"


def normal_p_sql(z: str) -> str:
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {z} / 6000 * {_SIMPSON.format(f=f'exp(-pow({z} * k / 2000, 2) / 2)')})"


def _r_sql(a: str, b: str) -> str:
    return f"case when count(*) >= 4 then covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) end"


def _p_of_r(r: str) -> str:
    return t_p_sql(f"({r} * sqrt((n - 2) / greatest(1e-300, 1 - {r} * {r})))", "n - 2")


_OUT, _PRED = ["price", "qty"], ["n_orders", "disc", "tax"]
_LONG = "long as (" + " union all ".join(f"select class, '{o}' as outcome, '{p}' as predictor, {o} as y, {p} as x from master" for o in _OUT for p in _PRED) + ")"


@query(f"""with {_MASTER}, {_LONG}, k as (select *, rank() over (partition by outcome, predictor order by x) + (count(*) over (partition by outcome, predictor, x) - 1) / 2.0 as rx,
 rank() over (partition by outcome, predictor order by y) + (count(*) over (partition by outcome, predictor, y) - 1) / 2.0 as ry from long),
 s as (select outcome, predictor, count(*) as n, {_r_sql('x', 'y')} as r, {_r_sql('rx', 'ry')} as rho from k group by all)
 select outcome, predictor, n, round(r, 6) as pearson_r, round({_p_of_r('r')}, 6) as pearson_p, round(rho, 6) as spearman_rho, round({_p_of_r('rho')}, 6) as spearman_p from s""")
def correlation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.correlation_table(models.grid_pairs(master(spark, sf_dir), _OUT, _PRED, []), ["outcome", "predictor"]))


@query(f"""with {_MASTER}, {_LONG}, s as (select class, outcome, predictor, count(*) as n, {_r_sql('x', 'y')} as r from long group by all)
 select class, outcome, predictor, n, round(r, 6) as pearson_r from s order by abs(round(r, 6)) desc, n desc, class, outcome, predictor limit 12""")
def strongest_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = models.grid_pairs(master(spark, sf_dir), _OUT, _PRED, ["class"])
    found = rounded(models.correlation_table(pairs, ["class", "outcome", "predictor"]).select("class", "outcome", "predictor", "n", "pearson_r"))
    return found.orderBy(F.desc(F.abs("pearson_r")), F.desc("n"), "class", "outcome", "predictor").limit(12)


def fit_sql(name: str, y: str, xs: list[str], least: int) -> str:
    """CTEs of a weighted fit of the rows of ``{name}_rows`` (columns and w), by sweeping the matrix of centred sums."""
    cols, size = [*xs, y], len(xs) + 1
    pairs = [(a, b) for a in range(size) for b in range(size)]
    sums = ", ".join([f"sum(w * {c}) as f{k}" for k, c in enumerate(cols)] + [f"sum(w * {cols[a]} * {cols[b]}) as s{a}_{b}" for a, b in pairs])
    out = [f"{name}_s as (select count(*) as n, sum(w) as total, {sums} from {name}_rows having count(*) >= {max(least, size + 2)})"]
    out.append(f"{name}_g0 as (" + " union all ".join(f"select {a} as i, {b} as j, s{a}_{b} - f{a} * f{b} / total as v from {name}_s" for a, b in pairs) + ")")
    for k in range(size - 1):
        g = f"{name}_g{k}"
        out.append(f"""{name}_g{k + 1} as (select a.i, a.j, case when a.i = {k} and a.j = {k} then 1 / d.v when a.i = {k} then a.v / d.v when a.j = {k} then -a.v / d.v else a.v - r.v * c.v / d.v end as v
 from {g} a join {g} d on d.i = {k} and d.j = {k} join {g} r on r.i = a.i and r.j = {k} join {g} c on c.i = {k} and c.j = a.j)""")
    g, last = f"{name}_g{size - 1}", size - 1
    out.append(f"{name}_m as (" + " union all ".join(f"select {k} as i, f{k} / total as m from {name}_s" for k in range(size)) + ")")
    out.append(f"{name}_e as (select n, total, (select v from {g} where i = {last} and j = {last}) as sse, (select v from {name}_g0 where i = {last} and j = {last}) as sst from {name}_s)")
    term = "case i " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(xs)) + " end"
    out.append(f"""{name}_c as (select {term} as term, (select v from {g} b where b.i = q.i and b.j = {last}) as coefficient, v as inv from {g} q where i = j and i < {last}
 union all select 'intercept', (select m from {name}_m where i = {last}) - (select sum(b.v * m.m) from {g} b join {name}_m m on m.i = b.i where b.j = {last} and b.i < {last}),
 (select 1 / total from {name}_s) + (select sum(a.m * b.m * q.v) from {g} q join {name}_m a on a.i = q.i join {name}_m b on b.i = q.j where q.i < {last} and q.j < {last}))""")
    out.append(f"""{name} as (select n, 1 - sse / nullif(sst, 0) as r2, sqrt(sse / total) as rmse, term, coefficient, sqrt(sse / (n - {size}) * inv) as std_error from {name}_c, {name}_e)""")
    return ", ".join(out)


def _model_select(name: str, label: str) -> str:
    t = "coefficient / nullif(std_error, 0)"
    return f"""select '{label}' as model, n, round(r2, 6) as r2, round(rmse, 4) as rmse, term, round(coefficient, 3) as coefficient, round(std_error, 3) as std_error, round({t}, 4) as t_stat,
 round({t_p_sql(t, f'n - {len(XS) + 1}')}, 6) as p_value from {name}"""


def _shown(found: DataFrame, label: str) -> DataFrame:
    digits = {"r2": 6, "rmse": 4, "coefficient": 3, "std_error": 3, "t_stat": 4, "p_value": 6}
    return found.select(F.lit(label).alias("model"), *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in found.columns])


_ROWS = "{n}_rows as (select *, {w} as w from master)"
_EQUAL = "(select count(*) from master) / (select count(distinct y) from master)::double / count(*) over (partition by y)"


@query(f"with {_MASTER}, {_ROWS.format(n='a', w='1.0')}, {fit_sql('a', 'price', XS, 8)} {_model_select('a', 'price')}")
def ols_five_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(models.linear_model(master(spark, sf_dir), "price", XS, []), "price")


@query(f"with {_MASTER}, {_ROWS.format(n='a', w=_EQUAL)}, {fit_sql('a', 'price', XS, 12)} {_model_select('a', 'equal years')}")
def wls_equal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = models.equal_weights(master(spark, sf_dir), "y", "w")
    return _shown(models.linear_model(weighted, "price", XS, [], weight="w", least=models.LEAST_WEIGHTED), "equal years")


@query(f"""with {_MASTER}, {_ROWS.format(n='a', w='1.0')}, {fit_sql('a', 'price', XS, 8)}, {_ROWS.format(n='b', w=_EQUAL)}, {fit_sql('b', 'price', XS, 12)}
 select a.term, round(a.coefficient, 3) as ols, round(b.coefficient, 3) as wls, round(b.coefficient - a.coefficient, 3) as difference, sign(round(a.coefficient, 3)) = sign(round(b.coefficient, 3)) as same_sign from a join b on a.term = b.term""")
def ols_against_wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = master(spark, sf_dir)
    one = models.linear_model(days, "price", XS, []).select("term", F.col("coefficient").alias("a"))
    two = models.linear_model(models.equal_weights(days, "y", "w"), "price", XS, [], weight="w", least=models.LEAST_WEIGHTED).select("term", F.col("coefficient").alias("b"))
    a, b = F.round("a", 3), F.round("b", 3)
    return one.join(two, "term").select("term", a.alias("ols"), b.alias("wls"), F.round(F.col("b") - F.col("a"), 3).alias("difference"), (F.signum(a) == F.signum(b)).alias("same_sign"))


_BETA = lambda x: f"(select coefficient from a where term = '{x}')"
_FITTED = " + ".join([_BETA("intercept")] + [f"{_BETA(x)} * {x}" for x in XS])


@query(f"""with {_MASTER}, {_ROWS.format(n='a', w='1.0')}, {fit_sql('a', 'price', XS, 8)}, f as (select day, y, price, {_FITTED} as fitted from master)
 select y, count(*) as n, round(avg(fitted), 3) as fitted, round(avg(price - fitted), 3) as residual, round(sqrt(avg(pow(price - fitted, 2))), 3) as spread from f group by all""")
def model_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.with_residuals(master(spark, sf_dir), "price", XS, [])
    res = F.col("price_residual")
    return rounded(found.groupBy("y").agg(F.count("*").alias("n"), F.avg("price_fitted").alias("fitted"), F.avg(res).alias("residual"), F.sqrt(F.avg(res * res)).alias("spread")), 3)


@query(f"""with {_MASTER}, v as (select class as g, price as v from master where class in ('storm', 'quiet')), k as (select *, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk from v),
 t as (select coalesce(sum(pow(c, 3) - c), 0) as tied from (select count(*) as c from v group by v)),
 s as (select count(*) filter (where g = 'storm') as na, count(*) filter (where g = 'quiet') as nb, avg(v) filter (where g = 'storm') as ma, avg(v) filter (where g = 'quiet') as mb, var_samp(v) filter (where g = 'storm') as va, var_samp(v) filter (where g = 'quiet') as vb,
 sum(rk) filter (where g = 'storm') as r1 from k),
 u as (select *, (ma - mb) / sqrt(va / na + vb / nb) as t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) as df, r1 - na * (na + 1) / 2.0 as u from s),
 z as (select *, greatest(0, abs(u - na * nb / 2.0) - 0.5) / sqrt(na * nb / 12.0 * ((na + nb + 1) - tied / ((na + nb) * (na + nb - 1.0)))) as z from u, t)
 select na, nb, round(ma, 3) as ma, round(mb, 3) as mb, round(t, 6) as t, round(df, 4) as df, round({t_p_sql('t', 'df')}, 6) as welch_p, round(u, 2) as u, round({normal_p_sql('z')}, 6) as mannwhitney_p from z""")
def group_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.group_tests(master(spark, sf_dir), "price", "class", "storm", "quiet")
    digits = {"ma": 3, "mb": 3, "t": 6, "df": 4, "welch_p": 6, "u": 2, "mannwhitney_p": 6}
    return found.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in found.columns])


_METRICS = ["price", "qty", "disc"]
_CONTRASTS = _MASTER + ", w as (" + " union all ".join(
    f"""select y as year, '{m}' as metric, count({m}) filter (where class = 'storm') as storm_n, count({m}) filter (where class = 'quiet') as quiet_n, avg({m}) filter (where class = 'storm') - avg({m}) filter (where class = 'quiet') as mean_difference,
 median({m}) filter (where class = 'storm') - median({m}) filter (where class = 'quiet') as median_difference from master group by y having storm_n >= 1 and quiet_n >= 1""" for m in _METRICS) + ")"


@query(f"with {_CONTRASTS} select year, metric, storm_n, quiet_n, round(mean_difference, 5) as mean_difference, round(median_difference, 5) as median_difference from w")
def yearly_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.yearly_contrasts(master(spark, sf_dir), "y", "class", _METRICS), 5)


_SIGN_P = "case when n_positive + n_negative = 0 then null when n_positive = n_negative then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(n_positive, n_negative) + 1), lambda i: exp(lgamma(n_positive + n_negative + 1.0) - lgamma(i + 1.0) - lgamma(n_positive + n_negative - i + 1.0) - (n_positive + n_negative) * ln(2))))) end"


@query(f"""with {_CONTRASTS}, s as (select metric, count(distinct year) as n_years, string_agg(year::varchar, ',' order by year) as years, avg(mean_difference) as mean_of_means, median(mean_difference) as median_of_means, avg(median_difference) as mean_of_medians,
 median(median_difference) as median_of_medians, count(*) filter (where mean_difference > 0) as n_positive, count(*) filter (where mean_difference < 0) as n_negative from w group by all)
 select metric, n_years, years, round(mean_of_means, 5) as mean_of_means, round(median_of_means, 5) as median_of_means, round(mean_of_medians, 5) as mean_of_medians, round(median_of_medians, 5) as median_of_medians, n_positive, n_negative, round({_SIGN_P}, 5) as sign_p from s""")
def contrast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.contrast_summary(models.yearly_contrasts(master(spark, sf_dir), "y", "class", _METRICS)), 5)


# --- bootstraps -----------------------------------------------------------------------------------

SEED = 20_260_822
_DRAW = "('0x' || substr(md5(rep::varchar || '/' || {slot} || '/" + str(SEED) + "'), 1, 15))::bigint % {n}"
_SUMS = "sum({w} 1.0) as n, sum({w} x) as sx, sum({w} y) as sy, sum({w} x * x) as sxx, sum({w} x * y) as sxy"
_SLOPE = "case when sum(n) >= 8 and count(*) >= 2 and sum(sxx / n) - sum(sx / n) * sum(sx / n) / count(*) > 0 then (sum(sxy / n) - sum(sx / n) * sum(sy / n) / count(*)) / (sum(sxx / n) - sum(sx / n) * sum(sx / n) / count(*)) end as slope"
_YEARS = list(range(1995, 2002))
_PAIRS = "pairs as (select day as date, year(day) as year, n_orders as x, price as y from master)"


def _cluster_sql(keys: str, reps: int) -> str:
    k = keys and keys + ", "
    return f"""by_year as (select {k}year, {_SUMS.format(w='')} from pairs group by all), names as (select year, row_number() over (order by year) - 1 as idx, count(*) over () as n_names from (select distinct year from by_year)),
 drawn as (select rep, slot, i.year from (select unnest(range(0, {reps})) as rep) a, (select unnest(range(0, (select count(*) from names))) as slot) b join names i on i.idx = {_DRAW.format(slot="slot::varchar", n="i.n_names")}),
 c_slopes as (select {k}rep, {_SLOPE} from drawn join by_year using (year) group by all)"""


def _block_sql(keys: str, reps: int) -> str:
    k = keys and keys + ", "
    years = ", ".join(map(str, _YEARS))
    return f"""b_years as (select y as year, (make_date(y + 1, 1, 1) - make_date(y, 1, 1))::bigint as days from (select unnest([{years}])::bigint as y)),
 b_slots as (select rep, year, days, slot, {_DRAW.format(slot="year::varchar || '-' || slot::varchar", n="days")} as start from (select unnest(range(0, {reps})) as rep) a, (select year, days, unnest(range(0, (days + 6) // 7)) as slot from b_years) b),
 b_days as (select rep, year, (make_date(year, 1, 1) + ((start + k) % days)::int)::date as date from b_slots, (select unnest(range(0, 7)) as k) where slot * 7 + k < days),
 b_moments as (select {k}rep, b.year, {_SUMS.format(w='')} from b_days b join pairs p on p.date = b.date group by all), b_slopes as (select {k}rep, {_SLOPE} from b_moments group by all)"""


_INTERVAL = "count(*) as reps, count(slope) as valid, round(quantile_cont(slope, 0.025), 3) as low, round(quantile_cont(slope, 0.975), 3) as high"


def _single_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master(spark, sf_dir).select(F.col("day").alias("date"), F.year("day").alias("year"), F.col("n_orders").alias("x"), F.col("price").alias("y"))


def _interval(slopes: DataFrame) -> DataFrame:
    return slopes.agg(F.count("*").alias("reps"), F.count("slope").alias("valid"), F.round(F.percentile("slope", 0.025), 3).alias("low"), F.round(F.percentile("slope", 0.975), 3).alias("high"))


@query(f"with {_MASTER}, {_PAIRS}, {_cluster_sql('', 1000)} select {_INTERVAL} from c_slopes")
def year_cluster_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(models.cluster_slopes(models.year_moments(_single_pairs(spark, sf_dir), ["year"]), [], "year", 1000, SEED))


@query(f"with {_MASTER}, {_PAIRS}, {_block_sql('', 1000)} select {_INTERVAL} from b_slopes")
def moving_block_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(models.block_slopes(_single_pairs(spark, sf_dir), [], "date", _YEARS, 1000, SEED))


_GRID_OUT, _GRID_PRED, _LAGS, _REPS = ["price"], ["n_orders", "qty"], [0, 1, 2], 100
_GRID_PAIRS = "pairs as (" + " union all ".join(
    f"select a.day as date, year(a.day) as year, '{o}' as outcome, '{p}' as predictor, {n} as lag, b.{p} as x, a.{o} as y from master a join master b on b.day = a.day - {n}" for o in _GRID_OUT for p in _GRID_PRED for n in _LAGS) + ")"
_KEYS = "outcome, predictor, lag"
_TESTS = f"""{_MASTER}, {_GRID_PAIRS}, {_cluster_sql(_KEYS, _REPS)}, {_block_sql(_KEYS, _REPS)}, k as (select *, rank() over (partition by {_KEYS} order by x) + (count(*) over (partition by {_KEYS}, x) - 1) / 2.0 as rx,
 rank() over (partition by {_KEYS} order by y) + (count(*) over (partition by {_KEYS}, y) - 1) / 2.0 as ry from pairs),
 r as (select {_KEYS}, count(*) as n, {_r_sql('x', 'y').replace('>= 4', '>= 8')} as r, {_r_sql('rx', 'ry').replace('>= 4', '>= 8')} as rho from k group by all), e as (select {_KEYS}, {_SLOPE} from by_year group by all),
 ci as (select {_KEYS}, quantile_cont(slope, 0.025) as c_low, quantile_cont(slope, 0.975) as c_high from c_slopes group by all), bi as (select {_KEYS}, quantile_cont(slope, 0.025) as b_low, quantile_cont(slope, 0.975) as b_high from b_slopes group by all),
 tests as (select {_KEYS}, n, r, rho, slope, c_low, c_high, b_low, b_high, case when c_low > 0 and b_low > 0 then 1 when c_high < 0 and b_high < 0 then -1 else 0 end as sign from r join e using ({_KEYS}) left join ci using ({_KEYS}) left join bi using ({_KEYS}))"""
_SHOWN = "outcome, predictor, lag, n, round(r, 5) as pearson_r, round(rho, 5) as spearman_rho, round(slope, 3) as slope, round(c_low, 3) as cluster_low, round(c_high, 3) as cluster_high, round(b_low, 3) as block_low, round(b_high, 3) as block_high, sign <> 0 as robust, sign"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.lagged_tests(master(spark, sf_dir), "day", _GRID_OUT, _GRID_PRED, _LAGS, _YEARS, _REPS, SEED)


def _shown_tests(found: DataFrame) -> DataFrame:
    digits = {"pearson_r": 5, "spearman_rho": 5, "slope": 3, "cluster_low": 3, "cluster_high": 3, "block_low": 3, "block_high": 3}
    return found.select("outcome", "predictor", "lag", "n", *[F.round(c, d).alias(c) for c, d in digits.items()], "robust", "sign")


@query(f"with {_TESTS} select {_SHOWN} from tests")
def lagged_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_tests(_tests(spark, sf_dir))


@query(f"with {_TESTS} select {_SHOWN} from tests qualify row_number() over (partition by outcome, predictor order by sign <> 0 desc, abs(rho) desc, abs(slope) desc, lag) = 1")
def best_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_tests(models.best_lags(_tests(spark, sf_dir)))


@query(f"""with {_MASTER}, w as (select *, {_EQUAL} as w from master), m as (select sum(w * price) / sum(w) as mean from w)
 select y, count(*) as n, round(sum(w), 6) as weight, round(sum(w * price) / sum(w), 4) as mean, round(sum(w * pow(price - (select mean from m), 2)), 2) as sse, round(sqrt(sum(w * pow(price - (select mean from m), 2)) / sum(w)), 4) as rmse from w group by all""")
def weighted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of mean one by year; weighted mean, squared error and root mean square against the overall mean."""
    days = models.equal_weights(master(spark, sf_dir), "y", "w")
    overall = days.agg((F.sum(F.expr("w * price")) / F.sum("w")).alias("mean"))
    joined = days.join(F.broadcast(overall)).withColumn("e", F.expr("w * power(price - mean, 2)"))
    found = joined.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"), F.round(F.sum(F.expr("w * price")) / F.sum("w"), 4).alias("mean"), F.round(F.sum("e"), 2).alias("sse"), F.round(F.sqrt(F.sum("e") / F.sum("w")), 4).alias("rmse"))
    return found


@query(f"""with {_MASTER}, r as (select *, case when not isfinite(qty) or not isfinite(price) then 1 else 0 end as bad from master)
 select y, class, count(*) as n, round(avg(price), 4) as mean_price, round(median(price), 4) as median_price, round(avg(qty), 6) as mean_qty, round(median(qty), 6) as median_qty from r where bad = 0 group by all""")
def yearly_class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.keep_one(master(spark, sf_dir), ["day"], [F.col("y")]).groupBy("y", "class").agg(
        F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean_price"), F.round(F.percentile("price", 0.5), 4).alias("median_price"), F.round(F.avg("qty"), 6).alias("mean_qty"), F.round(F.percentile("qty", 0.5), 6).alias("median_qty"))
    return found
