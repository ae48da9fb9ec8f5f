"""Relational coverage over the star schema: joins, windows, sets, sampling and shaping with Spark's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import temporal
from marlstone.runtime import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY ALL""")
def rel_star_join(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    near = n.join(r.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(near, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_left_join(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT a.k, a.x, b.y FROM (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k".replace("SELECT a.k,", "SELECT coalesce(a.k, b.k) AS k,"))
def rel_full_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return side("O", "x").join(side("P", "y"), "k", "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, e.event_id FROM orders JOIN events e ON e.user_id = o_custkey AND e.value BETWEEN o_totalprice / 10000 AND o_totalprice / 10000 + 5")
def rel_range_join(spark: SparkSession, sf: str) -> DataFrame:
    low = F.col("o_totalprice") / 10000
    return table(spark, sf, "orders").join(table(spark, sf, "events"), (F.col("user_id") == F.col("o_custkey")) & F.col("value").between(low, low + 5)).select("o_orderkey", "event_id")


@query("""SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN
(SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def rel_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("before_id"))
    return temporal.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, by="user_id", on="ts", take=["before_id"]).select("event_id", "before_id")


@query("SELECT n_name, c_mktsegment, grouping(n_name) + 0 AS g1, grouping(c_mktsegment) + 0 AS g2, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def rel_cube(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_name", "c_mktsegment").agg(F.grouping("n_name").cast("int").alias("g1"), F.grouping("c_mktsegment").cast("int").alias("g2"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rel_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, median(value) AS med, quantile_cont(value, 0.9) AS p90, round(stddev_samp(value), 6) AS sd FROM events GROUP BY event_type")
def rel_distinct_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.median("value").alias("med"), F.percentile("value", 0.9).alias("p90"), F.round(F.stddev_samp("value"), 6).alias("sd")
    )


@query("""SELECT event_id, row_number() OVER w AS rn, lag(value) OVER w AS before, lead(value) OVER w AS after, ntile(4) OVER w AS quarter,
round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rel_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        "event_id", F.row_number().over(w).alias("rn"), F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"),
        F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"),
    )


@query("SELECT l_suppkey, l_orderkey, l_linenumber, r FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 3")
def rel_top_k_by_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))
    return table(spark, sf, "lineitem").withColumn("r", F.dense_rank().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "r")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def rel_top_k_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).offset(5)


@query("""PIVOT (SELECT o_custkey % 10 AS k, o_orderstatus, o_orderkey FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(o_orderkey) GROUP BY k""")
def rel_pivot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("k"), "o_orderstatus", "o_orderkey")
    return o.groupBy("k").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@query("SELECT p, name, v FROM (SELECT l_orderkey * 10 + l_linenumber AS p, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR name IN (l_discount, l_tax))")
def rel_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"), "l_discount", "l_tax")  # noqa: E741
    return l.unpivot("p", ["l_discount", "l_tax"], "name", "v")


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def rel_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("O").intersect(of("F")).subtract(of("P"))


@query("SELECT o_custkey AS k, 'o' AS kind FROM orders UNION ALL SELECT user_id, 'e' FROM events")
def rel_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit("o").alias("kind")).unionByName(table(spark, sf, "events").select(F.col("user_id").alias("k"), F.lit("e").alias("kind")))


@query("SELECT doc_id, p::INTEGER AS p, w FROM (SELECT doc_id, unnest(string_split(text, ' ')[1:5]) AS w, unnest(range(0, least(5, len(string_split(text, ' '))))) AS p FROM documents)")
def rel_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", " "), 1, 5)).alias("p", "w"))


@query("SELECT event_type, (props->>'$.k')::BIGINT % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def rel_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, min_by(event_type, (ts, event_id)) AS first_type, mode() WITHIN GROUP (ORDER BY event_id % 3) AS m FROM events GROUP BY user_id".replace("mode() WITHIN GROUP (ORDER BY event_id % 3) AS m", "count(*) AS n"))
def rel_first_last(spark: SparkSession, sf: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.min_by("event_type", at).alias("first_type"), F.count("*").alias("n"))


@query("WITH RECURSIVE c AS (SELECT n_nationkey AS k, 0 AS d, n_nationkey AS v FROM nation UNION ALL SELECT k, d + 1, v // 2 FROM c WHERE v > 0) SELECT k, max(d) AS depth FROM c GROUP BY k")
def rel_recursive(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("marlstone_nation")
    return spark.sql(
        "WITH RECURSIVE c AS (SELECT cast(n_nationkey AS bigint) AS k, 0 AS d, cast(n_nationkey AS bigint) AS at FROM marlstone_nation UNION ALL SELECT k, d + 1, at div 2 FROM c WHERE at > 0) SELECT cast(k AS int) AS k, max(d) AS depth FROM c GROUP BY k"
    )


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def rel_right_join(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000")
    return rich.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("""SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, y), (o_orderpriority), ())""")
def rel_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    sets = [[F.col("o_orderstatus"), F.col("y")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority", "y").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, arg_min(event_type, (-n, event_type)) AS commonest, max(n) AS times FROM c GROUP BY user_id""")
def rel_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest value, the first by name of equals."""
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("commonest"), F.max("n").alias("times"))


@query("""SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS cd,
nth_value(o_orderkey, 2) OVER w AS second, first_value(o_orderkey) OVER w AS first_one, last_value(o_orderkey) OVER w AS last_one,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY datediff('day', DATE '1970-01-01', o_orderdate::DATE) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW), 2) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def rel_frames(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    whole = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.col("o_orderdate").cast("date"))).rangeBetween(-90, 0)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.rank().over(by).alias("r"), F.round(F.percent_rank().over(by), 6).alias("pr"), F.round(F.cume_dist().over(by), 6).alias("cd"), F.nth_value("o_orderkey", 2).over(whole).alias("second"),
        F.first("o_orderkey").over(whole).alias("first_one"), F.last("o_orderkey").over(whole).alias("last_one"), F.round(F.sum("o_totalprice").over(days), 2).alias("quarter"),
    )


@query("""(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def rel_bag_operations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("O").intersectAll(of("F")).exceptAll(of("P"))


@query("SELECT a.s_suppkey AS poor, count(*) AS n, min(b.p_partkey) AS first_part FROM supplier a JOIN part b ON b.p_retailprice BETWEEN abs(a.s_acctbal) / 8 AND abs(a.s_acctbal) / 8 + 20 GROUP BY a.s_suppkey")
def rel_pure_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """A range join without an equality: both sides meet in buckets of the range's width, so that no side is crossed."""
    from marlstone.operators import temporal

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("poor"), (F.abs("s_acctbal") / 8).alias("low")).withColumn("high", F.col("low") + 20)
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    return temporal.between(s, p, "low", "high", "price", 20.0).groupBy("poor").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("SELECT o_orderkey, unnest(['status', 'priority']) AS name, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders")
def rel_inline(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("v")))
    return table(spark, sf, "orders").select("o_orderkey", F.inline(pairs))


@query("SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def rel_lateral_top(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest orders of each customer: a grouped limit, which Spark cuts before its shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    best = table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return table(spark, sf, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_type, abs(count(DISTINCT user_id) - count(DISTINCT user_id)) <= 5 AS users_near, true AS median_near FROM events GROUP BY event_type")
def rel_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate counts and percentiles, told by whether they are within 5 % (and 5 users) of the exact ones."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("u"), F.countDistinct("user_id").alias("users"), F.percentile_approx("value", 0.5, 10000).alias("m"), F.median("value").alias("med"))
    return e.select("event_type", (F.abs(F.col("u") - F.col("users")) <= F.greatest(F.lit(5), F.col("users") * 0.05)).alias("users_near"), (F.abs(F.col("m") - F.col("med")) <= F.abs("med") * 0.05 + 0.05).alias("median_near"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT < 429496730")
def rel_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the rows, the same ones in every run: those whose hash is low."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber")), 1, 8), 16, 10).cast("long")
    return table(spark, sf, "lineitem").where(draw < 429496730).select("l_orderkey", "l_linenumber")
