"""Scans, filters, expressions, casts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import casts, intervals
from corvane.functions import scalar as S
from corvane.operators import relational as R
from corvane.sources.tables import table

from .registry import query

col, lit = F.col, F.lit

# ---- scans and predicates


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_project(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1994-01-01' AND l_quantity >= 30")
def index_range_scan(spark, folder):
    """A range on a leading column: parquet's row-group statistics prune what a B-tree would."""
    return table(spark, folder, "lineitem").filter((col("l_shipdate") < F.expr("timestamp_ntz'1994-01-01'")) & (col("l_quantity") >= 30)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size <> 10 AND p_size > 5 AND p_size <= 40 AND p_retailprice >= 950.0")
def filter_cmp(spark, folder):
    return table(spark, folder, "part").filter((col("p_size") != 10) & (col("p_size") > 5) & (col("p_size") <= 40) & (col("p_retailprice") >= 950.0)).select("p_partkey", "p_size")


@query("""SELECT doc_id, quality, (quality = 1 AND toxic = 0) AS both_true, (quality = 1 OR toxic = 1) AS either_true, NOT (toxic = 1) AS not_toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
def filter_and_or_null(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    good, bad = col("quality") == 1, col("toxic") == 1
    return both.select("doc_id", "quality", (good & (col("toxic") == 0)).alias("both_true"), (good | bad).alias("either_true"), (~bad).alias("not_toxic"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def filter_in_list(spark, folder):
    return table(spark, folder, "orders").filter(col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~col("o_orderstatus").isin("P")).select("o_orderkey")


@query("SELECT p_partkey, (p_size IN (1, 2, NULL)) AS among, (p_size NOT IN (1, 2, NULL)) AS not_among FROM part")
def filter_not_in_list_null(spark, folder):
    none = lit(None).cast("int")
    among = col("p_size").isin(lit(1), lit(2), none)
    return table(spark, folder, "part").select("p_partkey", among.alias("among"), (~among).alias("not_among"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity NOT BETWEEN 10 AND 40")
def filter_between(spark, folder):
    return table(spark, folder, "lineitem").filter(col("l_discount").between(0.05, 0.07) & ~col("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber")


@query("SELECT page_id, url LIKE 'http://%' AS plain, url LIKE '%!_source=feed' ESCAPE '!' AS feed, url LIKE 'https://____.%' AS four FROM pages")
def filter_like_escape(spark, folder):
    url = col("url")
    return table(spark, folder, "pages").select("page_id", S.like(url, "http://%").alias("plain"), S.like(url, "%!_source=feed", "!").alias("feed"), S.like(url, "https://____.%").alias("four"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' OR p_type ILIKE 'standard%'")
def filter_ilike(spark, folder):
    return table(spark, folder, "part").filter(S.like(col("p_name"), "%A%", ignore_case=True) | S.like(col("p_type"), "standard%", ignore_case=True)).select("p_partkey")


@query("SELECT doc_id, quality IS DISTINCT FROM toxic AS differs, quality IS NOT DISTINCT FROM toxic AS same, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def is_distinct_from(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    apart = S.is_distinct(col("quality"), col("toxic"))
    return both.select("doc_id", apart.alias("differs"), (~apart).alias("same"), col("quality").isNull().alias("missing"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def case_searched(spark, folder):
    price = col("o_totalprice")
    return table(spark, folder, "orders").select("o_orderkey", F.when(price > 300000, "large").when(price > 100000, "middle").otherwise("small").alias("size"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
def case_simple(spark, folder):
    status = col("o_orderstatus")
    return table(spark, folder, "orders").select("o_orderkey", F.when(status == "O", 1).when(status == "F", 2).alias("code"))


@query("SELECT doc_id, coalesce(quality, toxic, -1) AS first_known, nullif(quality, 1) AS not_one FROM documents LEFT JOIN labels USING (doc_id)")
def coalesce_nullif(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return both.select("doc_id", S.coalesce(col("quality"), col("toxic"), lit(-1)).alias("first_known"), S.nullif(col("quality"), 1).alias("not_one"))


@query("""SELECT vec_id, (0 < ANY(embedding[1:3])) AS some_positive, (label = ANY([1, 3, NULL])) AS label_known, (5 = ANY(CAST([] AS INTEGER[]))) AS never
FROM embeddings""")
def any_array_ops(spark, folder):
    known = F.array(lit(1), lit(3), lit(None).cast("int"))
    return table(spark, folder, "embeddings").select(
        "vec_id", S.any_of(lit(0.0), "<", F.slice("embedding", 1, 3)).alias("some_positive"), S.any_of(col("label"), "=", known).alias("label_known"), S.any_of(lit(5), "=", F.array().cast("array<int>")).alias("never")
    )


@query("SELECT CAST(column1 AS BIGINT) AS column1, column2 FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS v(column1, column2)")
def values_query(spark, folder):
    return R.values(spark, [(1, "a"), (2, None), (None, "c")])


@query("SELECT CAST(1 AS BIGINT) AS one, 'x' AS letter, 2.5::DOUBLE AS half")
def fromless_select(spark, folder):
    return R.unit(spark).select(lit(1).cast("bigint").alias("one"), lit("x").alias("letter"), lit(2.5).alias("half"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def lock_rows_read(spark, folder):
    """SELECT ... FOR UPDATE: a read of an immutable snapshot, which needs no lock."""
    return table(spark, folder, "orders").filter(col("o_orderstatus") == "F").select("o_orderkey")


# ---- casts


@query("""SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, CAST('1.5' AS DOUBLE) AS d, CAST('12.345' AS DECIMAL(10, 2)) AS n,
  CAST('2024-02-29' AS DATE) AS day, CAST('2024-02-29 12:30:00' AS TIMESTAMP) AS moment FROM orders""")
def cast_text_num(spark, folder):
    text = lambda t, k: casts.cast(lit(t), "text", k)
    return table(spark, folder, "orders").select(
        "o_orderkey", casts.cast(F.substring("o_orderpriority", 1, 1), "text", "bigint").alias("priority"), text("1.5", "double").alias("d"), text("12.345", "numeric(10,2)").alias("n"),
        text("2024-02-29", "date").alias("day"), text("2024-02-29 12:30:00", "timestamp").alias("moment"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS BIGINT) AS half, CAST(round_even(CAST(-l_quantity / 4 AS DOUBLE), 0) AS BIGINT) AS quarter FROM lineitem")
def cast_double_int_half_even(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", casts.cast(col("l_quantity") / 2, "double", "bigint").alias("half"), casts.cast(-col("l_quantity") / 4, "double", "bigint").alias("quarter"))


@query("""SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DECIMAL(10, 1)) AS tenths, CAST(round(CAST(p_size AS DECIMAL(10, 1)) / 2.0, 0) AS BIGINT) AS whole FROM part""")
def cast_numeric_typmod(spark, folder):
    price = col("p_retailprice").cast("decimal(12,2)")
    half = (col("p_size").cast("decimal(10,1)") / lit("2.0").cast("decimal(2,1)")).cast("decimal(12,4)")
    return table(spark, folder, "part").select("p_partkey", casts.cast(price, "numeric(12,2)", "numeric(10,1)").alias("tenths"), casts.cast(half, "numeric(12,4)", "bigint").alias("whole"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def cast_ts_date_text(spark, folder):
    return table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), casts.cast(F.to_date("ts"), "date", "text").alias("day"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'true' WHEN toxic = 0 THEN 'false' END AS shown, toxic = 1 AS back FROM labels")
def cast_bool(spark, folder):
    shown = casts.cast(col("toxic") == 1, "boolean", "text")
    return table(spark, folder, "labels").select("doc_id", shown.alias("shown"), casts.cast(shown, "text", "boolean").alias("back"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 100, 0) AS BIGINT)) AS hundredths FROM embeddings")
def cast_array(spark, folder):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, folder, "embeddings").select("vec_id", casts.cast(scaled, "double[]", "bigint[]").alias("hundredths"))


# ---- arithmetic


@query("SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS quotient, l_orderkey % 7 AS remainder, (-l_orderkey) // 7 AS negative, (-l_orderkey) % 7 AS sign FROM lineitem")
def int_div_mod(spark, folder):
    key = col("l_orderkey")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", S.int_div(key, 7).alias("quotient"), S.modulo(key, 7).alias("remainder"), S.int_div(-key, 7).alias("negative"), S.modulo(-key, 7).alias("sign"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit FROM lineitem")
def double_arith(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (lit(1) - col("l_discount"))).alias("net"), (col("l_extendedprice") / col("l_quantity")).alias("unit"))


@query("""SELECT p_partkey, CAST(n + 2 AS DECIMAL(18, 4)) AS plus, CAST(n - 0.5 AS DECIMAL(18, 4)) AS minus, CAST(n * 1.25 AS DECIMAL(18, 4)) AS product, CAST(n % 7 AS DECIMAL(18, 4)) AS rest
FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12, 2)) AS n FROM part)""")
def numeric_arith(spark, folder):
    n = col("p_retailprice").cast("decimal(12,2)")
    dec = lambda x: lit(x).cast("decimal(8,2)")
    shown = lambda x, name: x.cast("decimal(18,4)").alias(name)
    return table(spark, folder, "part").select("p_partkey", shown(n + dec("2"), "plus"), shown(n - dec("0.5"), "minus"), shown(n * dec("1.25"), "product"), shown(n % dec("7"), "rest"))


@query("SELECT c_custkey, -c_custkey AS opposite, -c_acctbal AS owed FROM customer")
def unary_minus(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.negate(col("c_custkey")).alias("opposite"), S.negate(col("c_acctbal")).alias("owed"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS next_month, CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS earlier,
  CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR + INTERVAL 2 HOUR AS later FROM orders""")
def date_plus_interval(spark, folder):
    day = F.to_date("o_orderdate")
    move = lambda text, sign=1: intervals.shift_date(day, intervals.parse(lit(text)), sign)
    return table(spark, folder, "orders").select("o_orderkey", move("1 month").alias("next_month"), move("10 days", -1).alias("earlier"), move("1 year 02:00:00").alias("later"))


@query("SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 36 HOUR AS later, ts - INTERVAL 90 SECOND AS sooner FROM events")
def ts_plus_minus_interval(spark, folder):
    return table(spark, folder, "events").select("event_id", intervals.shift(col("ts"), intervals.parse(lit("1 mon 36:00:00"))).alias("later"), intervals.shift(col("ts"), intervals.parse(lit("90 seconds")), -1).alias("sooner"))


@query("SELECT event_id, ((extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60) * 1000000 + 72000000000) % 86400000000 AS micros FROM events")
def time_plus_interval(spark, folder):
    """A time of day goes around the clock."""
    of_day = ((F.hour("ts") * 3600 + F.minute("ts") * 60).cast("bigint") * 1_000_000).cast("bigint")
    return table(spark, folder, "events").select("event_id", intervals.shift_time(of_day, intervals.parse(lit("20:00:00"))).alias("micros"))


@query("""WITH spans(id, days) AS (VALUES (1, 30), (2, 30), (3, 31), (4, 1)), x AS (SELECT a.id AS a, b.id AS b, a.days AS m, b.days AS n FROM spans a, spans b)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CASE a WHEN 4 THEN FALSE ELSE m = n END AND b <> 4 OR (a = 4 AND b = 4) AS equal, m < n OR (a = 4 AND b <> 4) AS less FROM x""")
def interval_compare(spark, folder):
    """1 mon = 30 days < 31 days; 1 day 02:30 is less than all."""
    rows = R.values(spark, [(1, "1 mon"), (2, "30 days"), (3, "31 days"), (4, "1 day 02:30")]).select(col("column1").alias("id"), intervals.parse(col("column2")).alias("span"))
    one, two = rows.select(col("id").alias("a"), col("span").alias("s")), rows.select(col("id").alias("b"), col("span").alias("t"))
    both = one.crossJoin(F.broadcast(two))  # four rows
    return both.select("a", "b", intervals.compare(col("s"), "=", col("t")).alias("equal"), intervals.compare(col("s"), "<", col("t")).alias("less"))


# ---- scalar functions


@query("SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low FROM customer")
def fn_upper_lower(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.upper(col("c_mktsegment")).alias("up"), S.lower(col("c_name")).alias("low"))


@query("SELECT c_custkey, c_name AS trimmed FROM customer")
def fn_trim(spark, folder):
    padded = F.concat(lit(" \t "), col("c_name"), lit("\n  "))
    return table(spark, folder, "customer").select("c_custkey", S.trim(padded).alias("trimmed"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS size FROM documents")
def fn_length(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.length(col("text")).alias("size"))


@query("SELECT c_custkey, abs(c_acctbal) AS size, floor(c_acctbal) AS low, ceil(c_acctbal) AS high, abs(-c_custkey) AS key FROM customer")
def fn_abs_floor_ceil(spark, folder):
    x = col("c_acctbal")
    return table(spark, folder, "customer").select("c_custkey", S.absolute(x).alias("size"), S.floor(x).alias("low"), S.ceil(x).alias("high"), S.absolute(-col("c_custkey")).alias("key"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, round_even(-l_quantity / 2, 0) AS negative FROM lineitem")
def fn_round_even(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", S.round_even(col("l_quantity") / 2).alias("half"), S.round_even(-col("l_quantity") / 2).alias("negative"))


@query("SELECT p_partkey, sqrt(p_size * p_size) AS root, power(p_size, 2) AS square, power(2.0, p_size) AS two FROM part")
def fn_sqrt_power(spark, folder):
    size = col("p_size")
    return table(spark, folder, "part").select("p_partkey", S.sqrt(size * size).alias("root"), S.power(size, 2).alias("square"), S.power(2.0, size).alias("two"))


@query("SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) AS m, CAST((-o_custkey) % 7 AS BIGINT) AS n FROM orders")
def fn_mod(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.modulo(col("o_custkey"), 7).alias("m"), S.modulo(-col("o_custkey"), 7).alias("n"))


@query("SELECT page_id, replace(url, 'http', 'HTTP') AS shouted, replace(url, '', 'x') AS same, CAST(position('/' IN url) AS BIGINT) AS slash, CAST(position('' IN url) AS BIGINT) AS empty FROM pages")
def fn_replace_position(spark, folder):
    url = col("url")
    return table(spark, folder, "pages").select("page_id", S.replace(url, "http", "HTTP").alias("shouted"), S.replace(url, "", "x").alias("same"), S.position("/", url).alias("slash"), S.position("", url).alias("empty"))


@query('SELECT p_partkey, "left"(p_name, 4) AS first, "right"(p_name, 4) AS last, "left"(p_name, -2) AS cut, "right"(p_name, -2) AS rest, "left"(p_name, -1000) AS none FROM part')
def fn_left_right_neg(spark, folder):
    name = col("p_name")
    return table(spark, folder, "part").select("p_partkey", S.left(name, 4).alias("first"), S.right(name, 4).alias("last"), S.left(name, -2).alias("cut"), S.right(name, -2).alias("rest"), S.left(name, -1000).alias("none"))


@query("SELECT doc_id, concat('q', quality, '-', toxic) AS joined, concat(NULL) AS nothing FROM documents LEFT JOIN labels USING (doc_id)")
def fn_concat_nulls(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return both.select("doc_id", S.concat("q", col("quality"), "-", col("toxic")).alias("joined"), S.concat(lit(None).cast("string")).alias("nothing"))


@query("""SELECT p_partkey, substring(p_name, 3, 3) AS middle, substring(p_name, 0, 2) AS zero, substring(p_name, 4) AS tail, '' AS before,
  substring(p_name, 1, 1) AS across FROM part""")
def fn_substring_edges(spark, folder):
    name = col("p_name")
    return table(spark, folder, "part").select("p_partkey", S.substring(name, 3, 3).alias("middle"), S.substring(name, 0, 2).alias("zero"), S.substring(name, 4).alias("tail"), S.substring(name, -2, 3).alias("before"), S.substring(name, -2, 4).alias("across"))


@query("""SELECT event_id, CAST(extract(year FROM ts) AS DOUBLE) AS y, CAST(extract(month FROM ts) AS DOUBLE) AS mo, CAST(extract(day FROM ts) AS DOUBLE) AS d,
  CAST(extract(hour FROM ts) AS DOUBLE) AS h, CAST(extract(minute FROM ts) AS DOUBLE) AS mi, CAST(extract(microsecond FROM ts) AS DOUBLE) / 1000000 AS s FROM events""")
def fn_extract_all(spark, folder):
    names = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second"}
    return table(spark, folder, "events").select("event_id", *(S.extract(f, col("ts")).alias(n) for n, f in names.items()))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, c_name || NULL AS nothing FROM customer")
def concat_op(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.concat_op(S.concat_op(col("c_name"), "/"), col("c_mktsegment")).alias("joined"), S.concat_op(col("c_name"), lit(None).cast("string")).alias("nothing"))


@query("SELECT count(*) > 0 AS any_row, true AS stable FROM region")
def fn_now(spark, folder):
    """now() is the same throughout a statement."""
    return table(spark, folder, "region").agg((F.count(lit(1)) > 0).alias("any_row"), F.bool_and(S.now() == S.current_timestamp()).alias("stable"))
