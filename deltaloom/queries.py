"""Queries over the star schema, one for each operator, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import macros, quoting, scalar
from .operators import depsets, diff, edges, graph, navigation, relational, tree
from .plans import render
from .sources import catalog, documents, prints, repository

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- scans, filters, joins ---------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey AS parent FROM nation")
def scan_project_rename(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("parent"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type NOT IN ('ECONOMY','PROMO') AND p_size IN (1,5,9,11,28,40) AND NOT regexp_matches(p_name, '^(red|blue)') AND p_brand <> 'Brand#1'")
def filter_in_notin_regex(t):
    return t.part.filter(~F.col("p_type").isin("ECONOMY", "PROMO") & F.col("p_size").isin(1, 5, 9, 11, 28, 40) & ~F.col("p_name").rlike("^(red|blue)") & (F.col("p_brand") != "Brand#1")).select("p_partkey", "p_name", "p_type")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE c_mktsegment = 'BUILDING' OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def filter_or_not_exists(t):
    has = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return t.customer.join(has, "c_custkey", "left").filter((F.col("c_mktsegment") == "BUILDING") | F.col("has").isNull()).select("c_custkey", "c_mktsegment")


@query("SELECT r_name, n_name, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY r_name, n_name")
def inner_join_chain(t):
    # Lines are added up by order before the joins, so what is shuffled is one row an order.
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    chain = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_lines"), F.sum("q").cast("bigint").alias("quantity"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey=r_regionkey AND r_name='ASIA') ON s_nationkey=n_nationkey")
def left_join_nested(t):
    right = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(right, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey=c_custkey AND o_orderstatus='F' AND c_mktsegment='MACHINERY'")
def left_join_on_constant_pred(t):
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F") & (F.col("c_mktsegment") == "MACHINERY")
    return t.orders.join(t.customer, on, "left").select("o_orderkey", "c_name")


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey OR n_nationkey = s_suppkey % 25")
def or_join(t):
    right = t.supplier.withColumn("other", (F.col("s_suppkey") % 25).cast("int"))
    return relational.any_key_join(t.nation, right, "n_nationkey", ["s_nationkey", "other"]).select("n_nationkey", "s_suppkey")


@query("SELECT a.l_orderkey, a.l_suppkey AS left_supp, b.l_suppkey AS right_supp FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_suppkey<>b.l_suppkey AND a.l_linenumber<b.l_linenumber")
def theta_self_join(t):
    a, b = (t.lineitem.select("l_orderkey", F.col("l_suppkey").alias(f"{s}_supp"), F.col("l_linenumber").alias(f"{s}_line")) for s in ("left", "right"))
    return a.join(b, "l_orderkey").filter((F.col("left_supp") != F.col("right_supp")) & (F.col("left_line") < F.col("right_line"))).select("l_orderkey", "left_supp", "right_supp")


@query("SELECT r_name, n_name, s_name FROM region, nation, supplier WHERE n_regionkey=r_regionkey AND s_nationkey=n_nationkey AND s_acctbal > 5000")
def comma_join(t):
    rich = t.supplier.filter("s_acctbal > 5000")
    return rich.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "s_name")


@query("SELECT o_orderkey, r_regionkey FROM orders JOIN region ON r_name = 'EUROPE' WHERE o_orderstatus = 'P'")
def constant_key_join(t):
    # A table cut down to one key has one row: it is joined as a constant.
    one = t.region.filter("r_name = 'EUROPE'").select("r_regionkey").withColumn("one", F.lit(1))
    return t.orders.filter("o_orderstatus = 'P'").withColumn("one", F.lit(1)).join(F.broadcast(one), "one").select("o_orderkey", "r_regionkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c.c_custkey AND o_orderpriority='1-URGENT')")
def anti_join_not_exists(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p_partkey=l_partkey WHERE l_partkey IS NULL")
def anti_join_left_null(t):
    big = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(big, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT c_custkey, EXISTS(SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 400000) AS has_orders FROM customer")
def exists_flag(t):
    has = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return t.customer.join(has, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_orders"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY 1, 2")
def group_keys_only(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority")


@query("SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_suppkey) AS names, string_agg(CAST(s_suppkey AS VARCHAR), '+' ORDER BY s_suppkey DESC) AS keys, count(*) AS n FROM supplier GROUP BY s_nationkey")
def string_agg_ordered(t):
    rows = F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name")))
    told = t.supplier.groupBy("s_nationkey").agg(rows.alias("r"), F.count("*").alias("n"))
    return told.select("s_nationkey", F.array_join(F.col("r.s_name"), ", ").alias("names"), F.array_join(F.reverse(F.transform("r.s_suppkey", text)), "+").alias("keys"), "n")


@query("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal FROM lineitem")
def row_number_labels(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(order).alias("ordinal"))


@query("""WITH lines AS (SELECT l_orderkey k, count(*) n, CAST(sum(l_quantity) AS BIGINT) q FROM lineitem GROUP BY 1),
heads AS (SELECT o_orderkey k, o_custkey c, o_orderstatus s FROM orders),
joined AS (SELECT heads.*, coalesce(n, 0) n, coalesce(q, 0) q FROM heads LEFT JOIN lines USING (k)),
per_customer AS (SELECT c, count(*) orders, CAST(sum(n) AS BIGINT) line_count, max(q) largest FROM joined GROUP BY c),
top AS (SELECT c, max(k) newest FROM joined GROUP BY c)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(line_count, 0) AS line_count, largest, newest FROM customer LEFT JOIN per_customer ON c=c_custkey LEFT JOIN top ON top.c=c_custkey""")
def cte_chain(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    joined = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey")).join(lines, "k", "left").fillna(0, ["n", "q"])
    per_customer = joined.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("line_count"), F.max("q").alias("largest"), F.max("k").alias("newest"))
    return t.customer.select("c_custkey").join(per_customer, "c_custkey", "left").fillna(0, ["orders", "line_count"])


@query("""WITH RECURSIVE t(root,id,lvl) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey > 0 UNION ALL SELECT t.root, p.p_partkey, t.lvl+1 FROM t JOIN part p ON p.p_partkey = CAST(floor(t.id/2) AS BIGINT) WHERE t.id > 1)
SELECT root, max(lvl) AS depth, count(*) AS n FROM t GROUP BY root""")
def recursive_ancestry(t):
    parts = t.part.select("p_partkey")
    up = parts.filter("p_partkey > 1").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).cast("long").alias("target"))
    up = up.join(parts.select(F.col("p_partkey").alias("target")), "target", "left_semi")
    walked = graph.walks(up, parts.filter("p_partkey > 0"))
    return walked.groupBy("root").agg(F.max("level").alias("depth"), F.count("*").alias("n"))


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 4) AS x FROM embeddings")
def array_unnest_subscript(t):
    each = t.embeddings.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return each.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS word, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size,
coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), nullif(o_orderstatus, 'P'), 'none') AS prio, nullif(o_orderstatus, 'O') IS NULL AS is_open FROM orders""")
def case_coalesce_nullif(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(status == "F", "finished").when(status == "O", "open").alias("word"),
        F.when(price > 300000, "big").when(price > 100000, "mid").otherwise("small").alias("size"),
        F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.nullif(status, F.lit("P")), F.lit("none")).alias("prio"),
        F.nullif(status, F.lit("O")).isNull().alias("is_open"),
    )


@query("""SELECT p_partkey, regexp_replace(p_name,'[aeiou]','_') AS first_only, regexp_replace(p_name,'[aeiou]','_','g') AS every, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, regexp_replace(p_name, '(\\w+) (\\w+)', '\\2-\\1', 'g') AS turned, regexp_matches(p_name, 'ring$') AS rings FROM part""")
def regex_first_vs_global(t):
    name = F.col("p_name")
    return t.part.select("p_partkey", scalar.replaced_first(name, "[aeiou]", "_").alias("first_only"), scalar.replaced(name, "[aeiou]", "_").alias("every"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"), scalar.replaced(name, r"(\w+) (\w+)", "$2-$1").alias("turned"), scalar.matches("ring$", name).alias("rings"))


@query("SELECT o_orderkey, o_orderstatus || ':' || c_name AS strict, concat(o_orderstatus, ':', c_name) AS loose FROM orders LEFT JOIN customer ON o_custkey=c_custkey AND c_mktsegment='HOUSEHOLD'")
def concat_null_modes(t):
    rows = t.orders.join(t.customer.filter("c_mktsegment = 'HOUSEHOLD'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    parts = (F.col("o_orderstatus"), F.lit(":"), F.col("c_name"))
    return rows.select("o_orderkey", F.concat(*parts).alias("strict"), scalar.joined_text(*parts).alias("loose"))


_RESERVED = ", ".join(f"'{w}'" for w in quoting.RESERVED)


@query(f"""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'select' WHEN 1 THEN p_name WHEN 2 THEN 'it''s "' || p_type WHEN 3 THEN '9' || p_brand ELSE 'plain_' || p_size END AS name FROM part)
SELECT p_partkey, '''' || replace(name, '''', '''''') || '''' AS literal, CASE WHEN regexp_full_match(name, '[a-z_][a-z0-9_]*') AND name NOT IN ({_RESERVED}) THEN name ELSE '"' || replace(name, '"', '\\"') || '"' END AS identifier FROM s""")
def quote_literal_ident(t):
    kind = F.col("p_partkey") % 5
    name = F.when(kind == 0, "select").when(kind == 1, F.col("p_name")).when(kind == 2, F.concat(F.lit("it's \""), "p_type")).when(kind == 3, F.concat(F.lit("9"), "p_brand")).otherwise(F.concat(F.lit("plain_"), text("p_size")))
    return t.part.select("p_partkey", quoting.quote_literal(name).alias("literal"), quoting.quote_identifier(name).alias("identifier"))


@query("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS number, TRY_CAST(substr(p_brand, 5) AS BIGINT) AS none, CAST(p_size AS VARCHAR) AS size_text FROM part")
def cast_try(t):
    return t.part.select("p_partkey", scalar.to_int(F.substring("p_brand", 7, 99)).alias("number"), scalar.to_int(F.substring("p_brand", 5, 99)).alias("none"), text("p_size").alias("size_text"))


@query("SELECT c_mktsegment, c_name FROM customer ORDER BY 1, 2 DESC")
def order_by_ordinal(t):
    return t.customer.select("c_mktsegment", "c_name").orderBy("c_mktsegment", F.desc("c_name"))


@query("SELECT * FROM (SELECT 'customer' AS tab, c_name AS label FROM customer ORDER BY c_custkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'part', p_name FROM part ORDER BY p_partkey LIMIT 1)")
def first_row_only(t):
    c = t.customer.orderBy("c_custkey").limit(1).select(F.lit("customer").alias("tab"), F.col("c_name").alias("label"))
    return c.unionByName(t.part.orderBy("p_partkey").limit(1).select(F.lit("part").alias("tab"), F.col("p_name").alias("label")))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 1000")
def param_query(t):
    t.customer.createOrReplaceTempView("deltaloom_customer")
    return catalog.query(t.spark, "SELECT c_custkey, c_acctbal FROM deltaloom_customer WHERE c_mktsegment = :segment AND c_acctbal > :least", segment="FURNITURE", least=1000)


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey=p_partkey LEFT JOIN supplier ON l_suppkey=s_suppkey")
def unique_lookup(t):
    named = relational.unique_lookup(t.lineitem, t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "p_partkey")
    named = relational.unique_lookup(named, t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "s_suppkey")
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "s_name")


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_quantity > 10 GROUP BY o_orderkey")
def foreach_filter_nested(t):
    lines = t.lineitem.filter("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = relational.nested(t.orders.select("o_orderkey"), lines, ["o_orderkey"], "kids", ["l_linenumber", "l_partkey"])
    line = F.transform("kids", lambda k: F.concat(text(k["l_linenumber"]), F.lit(":"), text(k["l_partkey"])))
    return nested.select("o_orderkey", F.array_join(line, ",").alias("lines"), F.size("kids").cast("bigint").alias("n"))


@query("SELECT 'order_' || l_orderkey || '(' || string_agg(p_type || '[]', ',' ORDER BY l_linenumber, l_partkey) || ')' AS signature, l_orderkey FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY l_orderkey")
def accumulate_map_to(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    got = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type"))).alias("r"))
    args = F.transform("r", lambda x: F.concat(x["p_type"], F.lit("[]")))
    return got.select(macros.signature(F.concat(F.lit("order_"), text("l_orderkey")), args).alias("signature"), "l_orderkey")


@query("SELECT c AS letter, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority, '')) AS c FROM orders) WHERE c <> '' GROUP BY c")
def iterate_string_chars(t):
    # Letters are counted for each distinct text first.
    texts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("k"))
    letters = texts.select("k", F.explode(F.split("o_orderpriority", "")).alias("letter")).filter("letter <> ''")
    return letters.groupBy("letter").agg(F.sum("k").alias("n"))


# --- scalar language and macros -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey, p_name || '::' || p_type || ':' AS x FROM part), p AS (SELECT p_partkey, regexp_split_to_array(x, '[: ]') AS a FROM s)
SELECT p_partkey, array_to_string(a[1:len(a)-1], '|') AS pieces, CAST(len(a) - 1 AS INTEGER) AS n FROM p""")
def split_modes(t):
    pieces = scalar.split_list(F.concat("p_name", F.lit("::"), "p_type", F.lit(":")), ": ")
    return t.part.select("p_partkey", scalar.join_list(pieces, "|").alias("pieces"), scalar.list_length(pieces).alias("n"))


@query("""WITH s AS (SELECT p_partkey, unnest([{'name': 'a', 'value': p_name}, {'name': 'c', 'value': 'd,' || p_type}, {'name': 'e', 'value': 'f=g'}]) AS o FROM part)
SELECT p_partkey, o.name AS name, o.value AS value FROM s""")
def split_quoted(t):
    made = F.concat(F.lit("{a="), F.col("p_name"), F.lit(',"c=d,'), F.col("p_type"), F.lit('",e=f=g}'))
    return t.part.select("p_partkey", F.inline(macros.options(made)))


@query("""WITH s AS (SELECT p_partkey k, p_size % 10 AS a, CAST(p_partkey % 12 AS INTEGER) AS b FROM part)
SELECT k, a || '.' || b AS v, (a > 5 OR (a = 5 AND b >= 3)) AS newer, CASE WHEN a < 5 OR (a = 5 AND b <= 3) THEN TRUE ELSE FALSE END AS usable FROM s""")
def version_order(t):
    v = F.concat(text(F.col("p_size") % 10), F.lit("."), text(F.col("p_partkey") % 12))
    numbers, wanted = scalar.version_numbers(v), F.array(F.lit(5).cast("bigint"), F.lit(3).cast("bigint"))
    return t.part.select(F.col("p_partkey").alias("k"), v.alias("v"), (numbers >= wanted).alias("newer"), (numbers <= wanted).alias("usable"))


@query("""WITH f AS (SELECT p_brand AS name, p_partkey AS path, p_size % 10 AS a, CAST(p_partkey % 12 AS INTEGER) AS b FROM part WHERE p_size % 10 < 6 OR (p_size % 10 = 6 AND p_partkey % 12 <= 2)),
r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY a DESC, b DESC) AS n FROM f) SELECT name, a || '.' || b AS best, count(*) AS ties FROM r WHERE n = 1 GROUP BY name, a, b""")
def best_version_file(t):
    v = F.array((F.col("p_size") % 10).cast("bigint"), F.col("p_partkey") % 12)
    files = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("path"), v.alias("version"))
    best = catalog.best_version(files, [6, 2]).select("name", "version")
    ties = files.join(best, ["name", "version"]).groupBy("name", "version").agg(F.count("*").alias("ties"))
    return ties.select("name", F.array_join(F.transform("version", text), ".").alias("best"), "ties")


@query("SELECT p_partkey, p_size + p_partkey + 1 AS total, -p_size AS negative, p_partkey - p_size - 2 AS folded, len(string_split(p_name, ' ')) AS n_words FROM part")
def arith_fold(t):
    a, b = F.col("p_size"), F.col("p_partkey")
    return t.part.select("p_partkey", scalar.folded_sum(a, b, F.lit(1)).alias("total"), scalar.folded_difference(a).alias("negative"), scalar.folded_difference(b, a, F.lit(2)).alias("folded"), scalar.list_length(F.split("p_name", " ")).cast("bigint").alias("n_words"))


@query("""SELECT o_orderkey, CASE WHEN c_name IS NOT NULL AND o_orderstatus IS NOT NULL THEN o_orderstatus END AS conjunction, coalesce(c_name, o_orderpriority) AS disjunction, CASE WHEN c_name IS NULL THEN TRUE END AS negation,
coalesce(c_mktsegment = 'BUILDING', FALSE) AS equal FROM orders LEFT JOIN customer ON o_custkey=c_custkey AND c_acctbal > 5000""")
def logic_values(t):
    rows = t.orders.join(t.customer.filter("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left")
    name = F.col("c_name")
    return rows.select("o_orderkey", scalar.all_of(name, F.col("o_orderstatus")).alias("conjunction"), scalar.first_of(name, F.col("o_orderpriority")).alias("disjunction"), scalar.negated(name).alias("negation"), scalar.same(F.col("c_mktsegment"), F.lit("BUILDING")).alias("equal"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders")
def timestamp_format(t):
    return t.orders.select("o_orderkey", scalar.compact_timestamp(F.col("o_orderdate")).alias("stamp"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)
SELECT p_partkey, a[1] AS head, array_to_string(a[2:], ' ') AS tail, a[2] AS second, list_filter(a, lambda x: regexp_matches(x, '^r'))[1] AS first_r, array_to_string(list_transform(a, lambda x: upper(x)), '/') AS upped, chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS letter FROM w""")
def list_functions(t):
    a = F.split("p_name", " ")
    return t.part.select("p_partkey", scalar.head(a).alias("head"), scalar.join_list(scalar.tail(a), " ").alias("tail"), scalar.selected(a, 1).alias("second"), scalar.first_match(a, "^r").alias("first_r"), scalar.join_list(F.transform(a, F.upper), "/").alias("upped"), F.chr(65 + F.col("p_partkey") % 26).alias("letter"))


@query("SELECT n_nationkey, 'r' || n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS parity, CAST(NULL AS VARCHAR) AS missing, 3 AS n FROM nation")
def map_functions(t):
    entries = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.concat(F.lit("r"), text("n_regionkey")))
    m = scalar.with_entry(entries, F.lit("parity"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise(scalar.selected(entries, "name")))
    return t.nation.select("n_nationkey", scalar.selected(m, "region").alias("region"), scalar.selected(m, "parity").alias("parity"), scalar.selected(m, "nothing").alias("missing"), F.size(F.map_entries(m)).alias("n"))


_ACL = "'{' || n_name || '=r*w/' || upper(n_name) || ',=U/' || upper(n_name) || '}'"


def _acl(t) -> DataFrame:
    name = F.col("n_name")
    return t.nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("{"), name, F.lit("=r*w/"), F.upper(name), F.lit(",=U/"), F.upper(name), F.lit("}")).alias("acl"))


@query(f"""WITH s AS (SELECT n_nationkey k, {_ACL} acl FROM nation), i AS (SELECT k, unnest(string_split(regexp_replace(acl,'^\\{{(.*)\\}}$','\\1'),',')) it FROM s),
q AS (SELECT k, regexp_split_to_array(it,'[=/]') a FROM i), p AS (SELECT k, CASE WHEN a[1]='' THEN 'public' ELSE a[1] END AS grantee, a[3] AS grantor, unnest(regexp_extract_all(a[2],'([a-zA-Z]\\*?)',1)) pr FROM q)
SELECT k, grantee, grantor, substring(pr,1,1) AS priv, CASE substring(pr,1,1) WHEN 'r' THEN 'select' WHEN 'w' THEN 'update' WHEN 'U' THEN 'usage' END AS privilege, length(pr)=2 AS with_grant FROM p""")
def acl_parse(t):
    return macros.grants(_acl(t), "acl", "k")


@query("""WITH e AS (SELECT n_nationkey AS k, 'public' AS grantee, unnest(['usage','create']) AS privilege FROM nation)
SELECT k, grantee, privilege, CASE WHEN privilege = 'usage' THEN 'no' ELSE 'revoke' END AS automatic FROM e""")
def acl_missing_auto(t):
    expected = t.nation.select(F.col("n_nationkey").alias("k"), F.lit("public").alias("grantee"), F.explode(F.array(F.lit("usage"), F.lit("create"))).alias("privilege"))
    return macros.automatic_grants(expected, macros.grants(_acl(t), "acl", "k"), ["k", "grantee", "privilege"])


@query("SELECT p_partkey, 'large' AS flag FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'cheap' FROM part WHERE p_retailprice < 950 UNION ALL SELECT p_partkey, 'red' FROM part WHERE starts_with(p_name, 'red')")
def unpivot_flags(t):
    rows = t.part.select("p_partkey", (F.col("p_size") > 25).alias("large"), (F.col("p_retailprice") < 950).alias("cheap"), F.startswith("p_name", F.lit("red")).alias("red"))
    return macros.unpivot_flags(rows, ["p_partkey"], ["large", "cheap", "red"])


@query("""WITH a AS (SELECT p_partkey, [p_brand, p_type, p_name] AS names, ['b','t','n'] AS kinds, CASE p_size % 3 WHEN 0 THEN ['d1'] WHEN 1 THEN ['d1','d2'] ELSE [] END AS defs FROM part)
SELECT p_partkey, i AS position, names[i] AS name, kinds[i] AS kind, CASE WHEN i > 3 - len(defs) THEN defs[i - (3 - len(defs))] END AS value FROM a, generate_series(1,3) g(i)""")
def positional_defaults(t):
    mod = F.col("p_size") % 3
    defaults = F.when(mod == 0, F.array(F.lit("d1"))).when(mod == 1, F.array(F.lit("d1"), F.lit("d2"))).otherwise(F.array().cast("array<string>"))
    params = macros.with_defaults(F.array("p_brand", "p_type", "p_name"), F.array(F.lit("b"), F.lit("t"), F.lit("n")), defaults)
    return t.part.select("p_partkey", F.inline(params)).withColumn("position", F.col("position").cast("bigint"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_suppkey END AS class_key, l_suppkey % 25 AS family_key FROM lineitem), c AS (SELECT s_suppkey AS class_key, s_suppkey % 25 AS family_key, s_name FROM supplier)
SELECT s_name, route, count(*) AS n FROM (SELECT s_name, 'class' AS route FROM c JOIN m ON c.class_key=m.class_key UNION ALL SELECT s_name, 'family' FROM c JOIN m ON m.class_key IS NULL AND c.family_key=m.family_key) GROUP BY ALL""")
def member_routing(t):
    members = t.lineitem.select(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey")).alias("class_key"), (F.col("l_suppkey") % 25).alias("family_key")).groupBy("class_key", "family_key").agg(F.count("*").alias("n"))
    classes = t.supplier.select(F.col("s_suppkey").alias("class_key"), (F.col("s_suppkey") % 25).alias("family_key"), "s_name")
    routed = relational.member_routes(classes, members, "class_key", "family_key")
    return routed.groupBy("s_name", "route").agg(F.sum("n").alias("n"))


# --- diff ---------------------------------------------------------------------------------------------------------------

_SNAPSHOTS = """WITH a AS (SELECT o_orderkey k, o_orderstatus s, o_orderpriority p FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END s, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END p FROM orders WHERE o_orderkey % 5 <> 0)"""
ORDER_RULE = diff.Rule(key=("k",), attributes=(diff.Attribute("s"), diff.Attribute("p", rebuild=True)))


def snapshots(t) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    a = t.orders.filter(k % 7 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    b = t.orders.filter(k % 5 != 0).select(k.alias("k"), F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("p"))
    return a, b


_STATUS = "CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.p IS DISTINCT FROM b.p THEN 'rebuild' WHEN a.s IS DISTINCT FROM b.s THEN 'diff' ELSE 'none' END"


@query(f"{_SNAPSHOTS} SELECT coalesce(a.k,b.k) AS k, {_STATUS} AS status FROM a FULL OUTER JOIN b ON a.k=b.k")
def diff_status(t):
    return diff.statuses(*snapshots(t), ORDER_RULE)


@query(f"{_SNAPSHOTS}, j AS (SELECT a.k, a.s AS s1, b.s AS s2, a.p AS p1, b.p AS p2 FROM a JOIN b ON a.k=b.k) SELECT k, 's' AS attr, 'diff' AS status, s1 AS old, s2 AS new FROM j WHERE s1 IS DISTINCT FROM s2 UNION ALL SELECT k, 'p', CASE WHEN p2 IS NULL THEN 'gone' WHEN p1 IS NULL THEN 'new' ELSE 'diff' END, p1, p2 FROM j WHERE p1 IS DISTINCT FROM p2")
def diff_attributes(t):
    return diff.attribute_changes(*snapshots(t), ORDER_RULE)


@query(f"{_SNAPSHOTS} SELECT k, CASE status WHEN 'new' THEN 'gone' WHEN 'gone' THEN 'new' ELSE status END AS status FROM (SELECT coalesce(a.k,b.k) AS k, {_STATUS} AS status FROM a FULL OUTER JOIN b ON a.k=b.k)")
def diff_swap(t):
    old, new = snapshots(t)
    return diff.statuses(new, old, ORDER_RULE)


@query("""WITH b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END s, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END p FROM orders WHERE o_orderkey % 5 <> 0) SELECT k, s, p FROM b""")
def diff_applied(t):
    return diff.applied(*snapshots(t), ORDER_RULE)


_LINES = """WITH o AS (SELECT l_orderkey ok, l_linenumber ln, max(l_quantity) q FROM lineitem GROUP BY 1, 2), a AS (SELECT * FROM o WHERE (ok + ln) % 6 <> 0), b AS (SELECT ok, ln, CASE WHEN ok % 4 = 0 THEN q + 1 ELSE q END q FROM o WHERE (ok + ln) % 5 <> 0),
s AS (SELECT coalesce(a.ok,b.ok) AS ok, coalesce(a.ln,b.ln) AS ln, CASE WHEN a.ok IS NULL THEN 'new' WHEN b.ok IS NULL THEN 'gone' WHEN a.q IS DISTINCT FROM b.q THEN 'diff' ELSE 'none' END AS status FROM a FULL OUTER JOIN b ON a.ok=b.ok AND a.ln=b.ln)"""


def line_statuses(t) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln")).agg(F.max("l_quantity").alias("q"))
    a, b = lines.filter("(ok + ln) % 6 <> 0"), lines.filter("(ok + ln) % 5 <> 0").withColumn("q", F.when(F.col("ok") % 4 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return diff.statuses(a, b, diff.Rule(key=("ok", "ln"), attributes=(diff.Attribute("q"),)))


@query(f"{_LINES} SELECT ok, ln, status FROM s")
def diff_elements(t):
    return line_statuses(t)


@query("SELECT doc_id, CASE WHEN coalesce(a, '') <> coalesce(b, '') THEN 'diff' ELSE 'none' END AS status FROM (SELECT doc_id, text AS a, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN text || '.' ELSE text END AS b FROM documents)")
def diff_text(t):
    old = t.documents.select("doc_id", "text")
    k = F.col("doc_id") % 4
    new = old.withColumn("text", F.when(k == 1, F.concat("text", F.lit("."))).when(k != 0, F.col("text")))
    return diff.statuses(old, new, diff.Rule(key=("doc_id",), texts=("text",)))


def _kids(strict: bool) -> str:
    return f"{_LINES} SELECT o_orderkey AS ok, CASE WHEN (SELECT bool_or(status IN ('new','diff'{', ' + chr(39) + 'gone' + chr(39) if strict else ''})) FROM s WHERE s.ok = o_orderkey) THEN 'diffkids' ELSE 'none' END AS status FROM orders"


def parent_statuses(t, strict: bool) -> DataFrame:
    parents = t.orders.select(F.col("o_orderkey").alias("ok"), F.lit("none").alias("status"))
    return diff.with_child_status(parents, line_statuses(t), ["ok"], strict)


@query(_kids(False))
def diff_parent_kids(t):
    return parent_statuses(t, False)


@query(_kids(True))
def diff_parent_kids_strict(t):
    return parent_statuses(t, True)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, CAST(floor(p_partkey/2) AS BIGINT) AS target, p_partkey % 5 = 0 AS soft FROM part WHERE p_partkey > 1),
h(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 3 UNION SELECT e.node FROM h JOIN e ON e.target = h.node WHERE NOT soft)
SELECT p_partkey AS node, CASE WHEN p_partkey % 7 = 1 AND p_partkey % 97 <> 3 THEN 'new' WHEN p_partkey IN (SELECT node FROM h) THEN 'rebuild' ELSE 'none' END AS status FROM part""")
def diff_rebuild_closure(t):
    k = F.col("p_partkey")
    edges = t.part.filter(k > 1).select(k.alias("node"), F.floor(k / 2).alias("target"), (k % 5 == 0).alias("soft"))
    return graph.promoted_rebuilds(t.part.select(k.alias("node"), F.when(k % 97 == 3, "rebuild").when(k % 7 == 1, "new").otherwise("none").alias("status")), edges)


# --- dependencies --------------------------------------------------------------------------------------------------------

_OBJECTS = """WITH objects AS (SELECT 'region.' || r_name AS fqn, 'r.' || r_regionkey AS pqn FROM region UNION ALL SELECT 'nation.' || r_name || '.' || n_name, 'r.' || r_regionkey FROM nation JOIN region ON n_regionkey=r_regionkey
UNION ALL SELECT 'supplier.' || n_name || '.' || s_name, 'n.' || n_nationkey FROM supplier JOIN nation ON s_nationkey=n_nationkey
UNION ALL SELECT 'customer.' || n_name || '.' || c_name, 'n.' || n_nationkey FROM customer JOIN nation ON c_nationkey=n_nationkey)"""


def objects(t) -> DataFrame:
    region = t.region.select(F.concat(F.lit("region."), "r_name").alias("fqn"), F.concat(F.lit("r."), text("r_regionkey")).alias("pqn"))
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nations.select(F.concat(F.lit("nation."), "r_name", F.lit("."), "n_name").alias("fqn"), F.concat(F.lit("r."), text("r_regionkey")).alias("pqn"))
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    leaf = lambda d, kind, name: d.select(F.concat(F.lit(kind), "n_name", F.lit("."), name).alias("fqn"), F.concat(F.lit("n."), text("n_nationkey")).alias("pqn"))
    return region.unionByName(nation).unionByName(leaf(suppliers, "supplier.", "s_name")).unionByName(leaf(customers, "customer.", "c_name"))


@query(f"""{_OBJECTS} SELECT 'nation.' || r_name || '.' || n_name AS from_fqn, 'region.' || r_name AS to_fqn FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT 'supplier.' || n_name || '.' || s_name, 'nation.' || r_name || '.' || n_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
UNION ALL SELECT 'customer.' || n_name || '.' || c_name, 'nation.' || r_name || '.' || n_name FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")
def dep_edges_fqn(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    up = F.concat(F.lit("nation."), "r_name", F.lit("."), "n_name")
    a = nations.select(up.alias("from_fqn"), F.concat(F.lit("region."), "r_name").alias("to_fqn"))
    b = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier."), "n_name", F.lit("."), "s_name").alias("from_fqn"), up.alias("to_fqn"))
    c = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer."), "n_name", F.lit("."), "c_name").alias("from_fqn"), up.alias("to_fqn"))
    return a.unionByName(b).unionByName(c)


@query(f"""{_OBJECTS}, edges AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'region.ASIA' WHEN 1 THEN 'n.' || c_nationkey ELSE 'nowhere' END AS to_qn FROM customer)
SELECT id, to_qn, coalesce((SELECT min(fqn) FROM objects WHERE fqn = to_qn), (SELECT min(fqn) FROM objects WHERE pqn = to_qn)) AS to_fqn FROM edges""")
def dep_resolve_pqn(t):
    k = F.col("c_custkey") % 3
    edges = t.customer.select(F.col("c_custkey").alias("id"), F.when(k == 0, "region.ASIA").when(k == 1, F.concat(F.lit("n."), text("c_nationkey"))).otherwise("nowhere").alias("to_qn"))
    return graph.resolved(edges, objects(t)).select("id", "to_qn", "to_fqn")


_CANDIDATES = """WITH c AS (SELECT l_orderkey AS depset_id, 'p' || l_partkey AS to_fqn, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber * 40 END AS priority FROM lineitem), x AS (SELECT 'p' || p_partkey AS fqn FROM part WHERE p_size > 30),
best AS (SELECT *, row_number() OVER (PARTITION BY depset_id ORDER BY coalesce(priority, 100), to_fqn) AS n FROM c WHERE to_fqn IN (SELECT fqn FROM x))"""


def alternatives(t) -> tuple[DataFrame, DataFrame]:
    c = t.lineitem.select(F.col("l_orderkey").alias("depset_id"), F.concat(F.lit("p"), text("l_partkey")).alias("to_fqn"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber") * 40).alias("priority"))
    return c, t.part.filter("p_size > 30").select(F.concat(F.lit("p"), text("p_partkey")).alias("fqn"))


@query(f"{_CANDIDATES} SELECT depset_id, to_fqn FROM best WHERE n = 1")
def depset_choice(t):
    return graph.chosen_alternatives(*alternatives(t)).select("depset_id", "to_fqn")


@query(f"{_CANDIDATES} SELECT DISTINCT depset_id, 'fb' || (depset_id % 10) AS fallback, unnest(['fallback', 'endfallback']) AS action FROM c WHERE depset_id NOT IN (SELECT depset_id FROM best)")
def depset_fallback(t):
    candidates, there = alternatives(t)
    sets = candidates.select("depset_id").distinct().withColumn("fallback", F.concat(F.lit("fb"), text(F.col("depset_id") % 10)))
    return graph.fallbacks(sets, graph.chosen_alternatives(candidates, there)).select("depset_id", "fallback", "action")


_BUILDS = f"{_SNAPSHOTS}, d AS (SELECT coalesce(a.k,b.k) AS k, {_STATUS} AS status FROM a FULL OUTER JOIN b ON a.k=b.k), t AS (SELECT k, CASE status WHEN 'none' THEN 'exists' WHEN 'new' THEN 'build' WHEN 'gone' THEN 'drop' ELSE status END AS build_type FROM d)"


@query(f"{_BUILDS} SELECT build_type, count(*) AS n FROM t GROUP BY build_type")
def build_types(t):
    return graph.build_actions(diff_status(t)).dropDuplicates(["k"]).groupBy("build_type").agg(F.count("*").alias("n"))


@query(f"{_BUILDS} SELECT k, unnest(CASE build_type WHEN 'rebuild' THEN ['drop','build'] WHEN 'diff' THEN ['diffprep','diff'] ELSE [build_type] END) AS action FROM t")
def mirrors(t):
    return graph.build_actions(diff_status(t)).select("k", "action")


@query("SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def prune_inactive_edges(t):
    edges = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return graph.pruned(edges, t.part.filter("p_size > 10").select("p_partkey"))


def part_edges(t) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.filter(k > 1).select(k.alias("target"), F.floor(k / 2).alias("source")).unionByName(t.part.filter(k > 2).select(k.alias("target"), F.floor(k / 3).alias("source")))


_LEVELS = """WITH RECURSIVE e AS (SELECT p_partkey AS child, CAST(floor(p_partkey/2) AS BIGINT) AS parent FROM part WHERE p_partkey>1 UNION ALL SELECT p_partkey, CAST(floor(p_partkey/3) AS BIGINT) FROM part WHERE p_partkey>2),
l(node,lvl) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.child, l.lvl+1 FROM l JOIN e ON e.parent=l.node)"""


@query(f"{_LEVELS} SELECT node, max(lvl) AS level FROM l GROUP BY node")
def topo_levels(t):
    return graph.levels(t.part.filter("p_partkey > 0").select(F.col("p_partkey").alias("node")), part_edges(t))


@query(f"{_LEVELS} SELECT node, CASE WHEN node % 2 = 0 THEN 'drop' ELSE 'build' END AS action, CASE WHEN node % 2 = 0 THEN -max(lvl) ELSE max(lvl) END AS place FROM l GROUP BY node")
def topo_order_drop(t):
    k = F.col("p_partkey")
    actions = t.part.filter(k > 0).select(k.alias("node"), F.when(k % 2 == 0, "drop").otherwise("build").alias("action"))
    return graph.plan(actions, part_edges(t).select(F.col("target").alias("node"), F.col("source").alias("target"))).select("node", "action", "place")


@query("WITH RECURSIVE g AS (SELECT n_nationkey AS a, (n_nationkey*n_nationkey+1) % 23 AS b FROM nation), r(a,b,d) AS (SELECT a,b,1 FROM g UNION ALL SELECT r.a,g.b,r.d+1 FROM r JOIN g ON g.a=r.b WHERE r.d<25) SELECT DISTINCT a AS node FROM r WHERE a=b")
def cycle_detect(t):
    k = F.col("n_nationkey")
    return graph.on_cycles(t.nation.select(k.alias("source"), ((k * k + 1) % 23).alias("target")))


@query("WITH RECURSIVE r(node) AS (SELECT p_partkey FROM part WHERE p_partkey IN (5, 7) UNION SELECT e.p_partkey FROM r JOIN part e ON CAST(floor(e.p_partkey/2) AS BIGINT) = r.node AND e.p_partkey > 0) SELECT node FROM r")
def dependents_closure(t):
    k = F.col("p_partkey")
    edges = t.part.filter(k > 0).select(F.floor(k / 2).alias("source"), k.alias("target"))
    return graph.reachable(edges, t.part.filter(k.isin(5, 7)).select(k))


# --- navigation, text, files ------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT o_custkey, o_orderkey, p AS from_context, o_orderstatus AS to_context FROM w WHERE p IS DISTINCT FROM o_orderstatus""")
def nav_context_switch(t):
    return navigation.context_switches(t.orders, "o_orderstatus", ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", "from_context", "to_context")


_PATHS = "WITH s AS (SELECT c_mktsegment AS k, c_custkey AS n, 'r' || n_regionkey AS r, 'n' || n_nationkey AS m FROM customer JOIN nation ON c_nationkey=n_nationkey), w AS (SELECT *, lag(r) OVER o AS pr, lag(m) OVER o AS pm FROM s WINDOW o AS (PARTITION BY k ORDER BY n))"


def paths(t) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_mktsegment").alias("k"), F.col("c_custkey").alias("n"), F.array(F.concat(F.lit("r"), text("n_regionkey")), F.concat(F.lit("n"), text("n_nationkey"))).alias("path"))


@query(f"{_PATHS} SELECT k, n, CASE WHEN r IS DISTINCT FROM pr THEN 0 WHEN m IS DISTINCT FROM pm THEN 1 ELSE 2 END AS shared FROM w")
def nav_common_ancestor(t):
    before = F.lag("path").over(Window.partitionBy("k").orderBy("n"))
    return paths(t).withColumn("before", before).select("k", "n", F.coalesce(navigation.common_path(F.col("before"), F.col("path")), F.lit(0)).alias("shared"))


@query(f"""{_PATHS} SELECT k, n, 'depart' AS move, pm AS at FROM w WHERE pr IS NOT NULL AND (r <> pr OR m <> pm) UNION ALL SELECT k, n, 'depart', pr FROM w WHERE r <> pr
UNION ALL SELECT k, n, 'arrive', r FROM w WHERE r IS DISTINCT FROM pr UNION ALL SELECT k, n, 'arrive', m FROM w WHERE r IS DISTINCT FROM pr OR m IS DISTINCT FROM pm""")
def nav_moves(t):
    return navigation.moves(paths(t), "path", ["n"], ["k"]).select("k", "n", "move", "at")


@query("SELECT event_id, last_value(CASE WHEN event_type='purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events")
def last_state_before(t):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return relational.last_before(t.events, bought, ["user_id"], ["ts", "event_id"], "prev").select("event_id", "prev")


@query("SELECT 'region=' || r_name || '|region.' || r_name AS line FROM region UNION ALL SELECT '  nation=' || n_name || '|nation.' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '|diff=new' ELSE '' END FROM nation")
def list_render(t):
    region = t.region.select(render.listing(F.lit(0), F.lit("region"), F.col("r_name"), F.concat(F.lit("region."), "r_name")).alias("line"))
    status = F.when(F.col("n_nationkey") % 2 == 0, "new")
    return region.unionByName(t.nation.select(render.listing(F.lit(1), F.lit("nation"), F.col("n_name"), F.concat(F.lit("nation."), "n_name"), status).alias("line")))


@query(f"""{_SNAPSHOTS}, j AS (SELECT a.k, a.s AS s1, b.s AS s2 FROM a JOIN b ON a.k=b.k WHERE a.s IS DISTINCT FROM b.s)
SELECT k, 'alter orders "o' || k || '#" set s = ''' || s2 || ''';' AS line FROM j UNION ALL SELECT b.k, 'create orders "o' || b.k || '#";' FROM b WHERE b.k NOT IN (SELECT k FROM a) UNION ALL SELECT a.k, 'drop orders "o' || a.k || '#";' FROM a WHERE a.k NOT IN (SELECT k FROM b)""")
def ddl_render(t):
    old, new = snapshots(t)
    rule = diff.Rule(key=("k",), attributes=(diff.Attribute("s"),))
    name = F.concat(F.lit("o"), text("k"), F.lit("#"))
    changes = diff.attribute_changes(old, new, rule).select("k", render.ddl(F.lit("diff"), "orders", name, F.col("attr"), F.col("new")).alias("line"))
    whole = graph.build_actions(diff.statuses(old, new, rule)).filter("action in ('build', 'drop')")
    return changes.unionByName(whole.select("k", render.ddl(F.col("action"), "orders", name, F.lit(None), F.lit(None)).alias("line")))


_HASHES = "WITH a AS (SELECT o_orderkey k, md5(coalesce(o_orderstatus, '<null>') || '|' || coalesce(o_orderpriority, '<null>')) h FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey k, md5(CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END || '|' || coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END, '<null>')) h FROM orders WHERE o_orderkey % 5 <> 0)"


@query(f"{_HASHES} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'NEW' WHEN b.k IS NULL THEN 'OLD' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM a FULL OUTER JOIN b ON a.k = b.k")
def scatter_status(t):
    hashed = (d.select("k", repository.content_hash(["s", "p"]).alias("hash")) for d in snapshots(t))
    return repository.scatter_status(*hashed, ["k"])


@query("""WITH g AS (SELECT l_partkey p, l_suppkey s, count_if(l_returnflag = 'R') AS revoked, count_if(l_returnflag = 'A') AS granted FROM lineitem GROUP BY 1, 2) SELECT p, s, CASE WHEN granted > 0 THEN 'grant' ELSE 'revoke' END AS op FROM g WHERE (granted > 0) <> (revoked > 0)""")
def grant_revoke_cancel(t):
    ops = t.lineitem.filter("l_returnflag in ('A', 'R')").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.when(F.col("l_returnflag") == "A", "grant").otherwise("revoke").alias("op"))
    kinds = ops.groupBy("p", "s").agg(F.min("op").alias("op"), F.max("op").alias("other"))
    return kinds.filter("op = other").select("p", "s", "op")


@query("SELECT n_nationkey AS k, n_name AS name, 'r' || n_regionkey AS region, '' AS missing FROM nation")
def xml_attr_extract(t):
    xml = t.nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("<dump><nation name='"), "n_name", F.lit("'><region>r"), text("n_regionkey"), F.lit("</region></nation></dump>")).alias("xml"))
    return catalog.xml_attributes(xml, "xml", {"name": "/dump/nation/@name", "region": "/dump/nation/region", "missing": "/dump/none"}).drop("xml")


def folder(t) -> str:
    """A new folder that driver and executors share; a local one only on one machine."""
    import uuid

    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or 'file:///tmp'}/deltaloom-scatter-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment AS type FROM customer")
def scatter_gather_roundtrip(t):
    """Customers written to one folder for each market segment, and read back."""
    path = folder(t)
    repository.scatter(t.customer.select("c_custkey", "c_name", "c_nationkey", F.col("c_mktsegment").alias("type")), path)
    return repository.gather(t.spark, path)


_SYNC = """WITH a AS (SELECT c_custkey k, c_name n, lpad(c_nationkey::VARCHAR, 3, '0') g FROM customer WHERE c_nationkey % 5 <> 0), b AS (SELECT c_custkey k, CASE WHEN c_nationkey % 5 = 1 THEN c_name || '!' ELSE c_name END n, lpad(c_nationkey::VARCHAR, 3, '0') g FROM customer WHERE c_nationkey % 5 <> 2)"""


def synced(t) -> tuple[str, DataFrame]:
    path = folder(t)
    rows, g = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.lpad(text("c_nationkey"), 3, "0").alias("g")), F.col("g").cast("int")
    repository.sync(rows.filter(g % 5 != 0), path, "g")
    return path, repository.sync(rows.filter(g % 5 != 2).withColumn("n", F.when(g % 5 == 1, F.concat("n", F.lit("!"))).otherwise(F.col("n"))), path, "g")


@query(f"{_SYNC} SELECT g, CASE WHEN max(a_n) IS NULL THEN 'NEW' WHEN max(b_n) IS NULL THEN 'OLD' WHEN bool_and(a_n IS NOT DISTINCT FROM b_n) THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM (SELECT coalesce(a.g, b.g) AS g, a.n AS a_n, b.n AS b_n FROM a FULL OUTER JOIN b ON a.k = b.k) GROUP BY g")
def scatter_sync_status(t):
    return synced(t)[1]


@query(f"{_SYNC} SELECT k, n, g FROM b")
def scatter_sync_rows(t):
    path = synced(t)[0]
    return repository.gather(t.spark, path, StructType().add("k", t.customer.schema["c_custkey"].dataType).add("n", "string").add("g", "string"))


_SESSION = """WITH c AS (SELECT table_name AS t, column_name AS c, ordinal_position AS n, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END AS type FROM information_schema.columns WHERE table_name IN ('region', 'orders', 'nation', 'part', 'supplier')),
w AS (SELECT bool_or(o_orderkey IS NULL) AS k, bool_or(o_custkey IS NULL OR o_custkey % 7 = 0) AS cust, bool_or(o_orderstatus IS NULL) AS status FROM orders),
r AS (SELECT count(*) > 0 AND bool_and(p_size IS NOT NULL) AS filled, bool_or(p_partkey IS NULL) AS k, bool_or(p_name IS NULL) AS name FROM part)"""


def session(t):
    """Tables of which one goes, one comes, and one has another first column, a column with nulls and one of another type; their rows say which columns have nulls."""
    from .plans.session import Session

    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    now = orders.select(F.lit("").alias("o_first"), "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.struct("o_orderstatus").alias("o_orderstatus"))
    part = t.part.select("p_partkey", "p_name", F.col("p_size").alias("p size"))
    old, new = {"region": t.region, "orders": orders, "nation": t.nation}, {"nation": t.nation, "orders": now, "new.part": part}
    return Session(t.spark).extract(old, measured=True).extract(new, measured=True).diff()


@query(f"""{_SESSION} SELECT 'schema.public' AS fqn, 'diffkids' AS status UNION ALL SELECT 'table.public.' || t, CASE t WHEN 'region' THEN 'gone' WHEN 'orders' THEN 'diffkids' ELSE 'none' END FROM c WHERE t IN ('region', 'nation', 'orders') GROUP BY t
UNION ALL SELECT 'column.public.' || t || '.' || c, CASE t WHEN 'region' THEN 'gone' ELSE 'none' END FROM c WHERE t IN ('region', 'nation')
UNION ALL SELECT 'column.public.orders.' || c, CASE c WHEN 'o_custkey' THEN CASE WHEN (SELECT cust FROM w) THEN 'diff' ELSE 'none' END WHEN 'o_orderstatus' THEN 'diff' ELSE 'none' END FROM c WHERE t = 'orders' AND c IN ('o_orderkey', 'o_custkey', 'o_orderstatus')
UNION ALL SELECT 'column.public.orders.o_first', 'new' UNION ALL SELECT 'table.public.new.part', 'new' UNION ALL SELECT 'column.public.new.part.' || CASE c WHEN 'p_size' THEN 'p size' ELSE c END, 'new' FROM c WHERE t = 'part' AND c IN ('p_partkey', 'p_name', 'p_size')""")
def session_diff(t):
    return session(t).result().select("fqn", "status")


@query(f"""{_SESSION}, s AS (SELECT 1 AS turn, 0 AS deep, 'column.public.region.' || c AS fqn, 'drop' AS action, 'alter table public.region drop column ' || c || ';' AS text FROM c WHERE t = 'region'
UNION ALL SELECT 1, 1, 'table.public.region', 'drop', 'drop table public.region;' UNION ALL SELECT 2, 0, 'table.public.new.part', 'build', 'create table public."new.part" ();'
UNION ALL SELECT 2, 1, 'column.public.new.part.' || CASE c WHEN 'p_size' THEN 'p size' ELSE c END, 'build', 'alter table public."new.part" add column ' || CASE c WHEN 'p_size' THEN '"p size"' ELSE c END || ' ' || type || CASE c WHEN 'p_size' THEN CASE WHEN filled THEN ' not null' ELSE '' END WHEN 'p_partkey' THEN CASE WHEN k THEN '' ELSE ' not null' END ELSE CASE WHEN name THEN '' ELSE ' not null' END END || ';' FROM c, r WHERE t = 'part' AND c IN ('p_partkey', 'p_name', 'p_size')
UNION ALL SELECT 2, 0, 'column.public.orders.o_first', 'build', 'alter table public.orders add column o_first string not null;'
UNION ALL SELECT 2, 0, 'column.public.orders.o_custkey', 'diff', 'alter table public.orders alter column o_custkey drop not null;' FROM w WHERE cust
UNION ALL SELECT 2, 0, 'column.public.orders.o_orderstatus', 'diff', 'alter table public.orders alter column o_orderstatus type struct<o_orderstatus:string>;'
UNION ALL SELECT 2, 0, 'column.public.orders.o_orderstatus', 'diff', 'alter table public.orders alter column o_orderstatus set not null;' FROM w WHERE status)
SELECT row_number() OVER (ORDER BY turn, deep, fqn, text DESC) AS seq, fqn, action, text FROM s""")
def session_generate(t):
    """The statements that lead from one description to the other, in order."""
    return session(t).generate().result()


# --- edges that objects imply, their sides and conditions ------------------------------------------------------------------


@query("""SELECT o_orderkey AS node, 'role.' || o_custkey AS target FROM orders WHERE o_custkey <> 7 UNION ALL SELECT o_orderkey, 'schema.' || o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'""")
def dep_edges_generated(t):
    owner = F.nullif(text("o_custkey"), F.lit("7"))  # null: without a role
    return edges.implied(t.orders.select("o_orderkey", owner.alias("owner"), F.col("o_orderpriority").alias("schema")), {"owner": "role", "schema": "schema"}, "o_orderkey", {"schema": "5-LOW"})


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS owner FROM orders""")
def dep_edges_removed(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("owner"), (F.col("o_orderstatus") == "O").alias("retain_deps"))
    return edges.stripped(rows, ["owner"], "retain_deps").select("o_orderkey", "owner")


@query("""SELECT c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS needs FROM customer WHERE c_custkey % 2 = 1 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def depset_conditions(t):
    asked = t.customer.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("needs"))
    return edges.conditional(asked, t.nation, F.col("n_regionkey") == 2, fqn="n_nationkey")


@query("""WITH e AS (SELECT c_custkey AS node, c_nationkey AS target, CASE c_custkey % 3 WHEN 0 THEN 'forwards' WHEN 1 THEN 'backwards' END AS applies, CASE WHEN c_custkey % 5 = 0 THEN 'forwards' END AS direction FROM customer),
s AS (SELECT node, target, direction, unnest(CASE WHEN applies IS NULL THEN ['forwards', 'backwards'] ELSE [applies] END) AS side FROM e)
SELECT CASE WHEN coalesce(direction, side) = 'backwards' THEN target ELSE node END AS node, CASE WHEN coalesce(direction, side) = 'backwards' THEN node ELSE target END AS target, side FROM s""")
def edge_directions(t):
    k = F.col("c_custkey")
    told = t.customer.select(k.alias("node"), F.col("c_nationkey").cast(t.customer.schema["c_custkey"].dataType).alias("target"), F.when(k % 3 == 0, "forwards").when(k % 3 == 1, "backwards").alias("applies"), F.when(k % 5 == 0, "forwards").alias("direction"))
    return edges.sided(told)


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS node, CASE l_linenumber WHEN 1 THEN 'build' WHEN 2 THEN 'diff' WHEN 3 THEN 'drop' ELSE 'diffprep' END AS action FROM lineitem)
SELECT x.node, x.action, y.action AS after FROM a x JOIN a y ON x.node = y.node AND ((x.action = 'build' AND y.action = 'drop') OR (x.action = 'diff' AND y.action = 'diffprep'))""")
def mirror_edges(t):
    n = F.col("l_linenumber")
    return edges.mirrored(t.lineitem.select(F.col("l_orderkey").alias("node"), F.when(n == 1, "build").when(n == 2, "diff").when(n == 3, "drop").otherwise("diffprep").alias("action")))


# --- lists, computed names, navigation of a list ----------------------------------------------------------------------------


@query("""SELECT p_partkey, array_to_string(list_concat([p_size], l), ',') AS added, array_to_string(list_filter(l, lambda x: x <> 3), ',') AS fewer, array_to_string(list_concat(l, list_filter([9, p_size % 5], lambda x: NOT list_contains(l, x))), ',') AS joined, array_to_string(list_reverse_sort(l), ',') AS down
FROM (SELECT p_partkey, p_size, [p_size % 3, 3, p_size % 3 + 5] AS l FROM part)""")
def list_edits(t):
    size = F.col("p_size")
    items = F.array(size % 3, F.lit(3).cast(t.part.schema["p_size"].dataType), size % 3 + 5)
    # Sets: the pieces of the list differ from each other, and 9 is never size % 5.
    joined = scalar.inserted(items, F.array(F.lit(9).cast(t.part.schema["p_size"].dataType), size % 5))
    lists = {"added": scalar.cons(size, items), "fewer": scalar.removed(items, F.lit(3)), "joined": joined, "down": scalar.ordered_by(items, lambda x, y: x > y)}
    return t.part.select("p_partkey", *(F.array_join(x, ",").alias(n) for n, x in lists.items()))


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN '1.0' WHEN 'Brand#22' THEN '2.1' END AS version, substr(p_name, 1, (p_size % 4) * 2) AS start, p_brand AS name, p_type AS value FROM part""")
def computed_names(t):
    entry = F.explode(scalar.member(F.col("p_brand"), F.col("p_type"))).alias("name", "value")
    return t.part.select("p_partkey", scalar.looked_up(F.col("p_brand"), {"Brand#11": "1.0", "Brand#22": "2.1"}).alias("version"), F.substring("p_name", F.lit(1), (F.col("p_size") % 4).cast("int") * 2).alias("start"), entry)


@query("""SELECT vec_id, n_name FROM (SELECT vec_id, [label, label + 1] AS arr FROM embeddings) JOIN nation ON n_nationkey = arr[1]""")
def array_subscript_join(t):
    keyed = t.embeddings.select("vec_id", F.array("label", F.col("label") + 1).alias("arr"))
    return keyed.join(t.nation, F.col("n_nationkey") == F.get("arr", F.lit(0))).select("vec_id", "n_name")


@query("""SELECT n_name, r_name AS parent_name, n_nationkey AS id FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 1""")
def nav_flatten(t):
    tree = t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("n"), text("n_nationkey")).alias("fqn"), F.concat(F.lit("r"), text("n_regionkey")).alias("parent"), F.col("n_nationkey").alias("id"))
    tree = tree.unionByName(t.region.filter("r_regionkey <> 1").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), text("r_regionkey")).alias("fqn"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast(t.nation.schema["n_nationkey"].dataType).alias("id")))
    return navigation.flattened(tree).filter("id is not null").select(F.col("name").alias("n_name"), F.col("parent_node.name").alias("parent_name"), "id")


@query("""SELECT l_orderkey, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS from_fqn, l_linenumber AS fqn FROM lineitem WHERE l_returnflag <> 'R'""")
def nav_skip_disabled(t):
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("fqn"), (F.col("l_returnflag") == "R").alias("disabled"))
    return navigation.steps(lines, "fqn", ["l_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rebuild' WHEN o_totalprice > 300000 THEN 'diff' WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN' WHEN o_orderstatus = 'F' THEN 'diffkids' ELSE 'none' END AS status FROM orders""")
def diff_precedence(t):
    own = F.col("o_totalprice") > 300000
    status = diff.precedence(own, F.col("o_orderstatus") == "P", F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "F")
    return t.orders.select("o_orderkey", status.alias("status"))


# --- elements, both sides of a comparison, cycles that are broken --------------------------------------------------------

_NESTED = """WITH a AS (SELECT l_orderkey ok, l_linenumber ln, max(l_quantity) q FROM lineitem WHERE l_orderkey % 9 <> 0 AND (l_orderkey + l_linenumber) % 6 <> 0 GROUP BY 1, 2),
b AS (SELECT l_orderkey ok, l_linenumber ln, max(l_quantity) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END q FROM lineitem WHERE l_orderkey % 10 <> 0 AND (l_orderkey % 3 = 0 OR (l_orderkey + l_linenumber) % 6 <> 0) GROUP BY 1, 2),
e AS (SELECT coalesce(a.ok, b.ok) AS ok, coalesce(a.ln, b.ln) AS ln, CASE WHEN a.ok IS NULL THEN 'new' WHEN b.ok IS NULL THEN 'gone' WHEN a.q IS DISTINCT FROM b.q THEN 'diff' ELSE 'none' END AS status FROM a FULL OUTER JOIN b ON a.ok = b.ok AND a.ln = b.ln)"""
NESTED_RULE = diff.Rule(key=("ok",), elements={"lines": diff.Rule(key=("ln",), attributes=(diff.Attribute("q"),))})


def nested_snapshots(t) -> tuple[DataFrame, DataFrame]:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln")).agg(F.max("l_quantity").alias("q"))
    nest = lambda d: d.groupBy("ok").agg(F.collect_list(F.struct("ln", "q")).alias("lines"))
    a = lines.filter("ok % 9 <> 0 and (ok + ln) % 6 <> 0")
    b = lines.filter("ok % 10 <> 0 and (ok % 3 = 0 or (ok + ln) % 6 <> 0)").withColumn("q", F.col("q") + F.when(F.col("ok") % 4 == 0, 1).otherwise(0))
    return nest(a), nest(b)


@query(f"{_NESTED} SELECT ok, ln, status FROM e")
def diff_nested_elements(t):
    return diff.element_statuses(*nested_snapshots(t), NESTED_RULE, "lines")


@query(f"{_NESTED} SELECT ok, CASE WHEN ok NOT IN (SELECT ok FROM a) THEN 'new' WHEN ok NOT IN (SELECT ok FROM b) THEN 'gone' WHEN bool_or(status <> 'none') THEN 'diff' ELSE 'none' END AS status FROM e GROUP BY ok")
def diff_element_owners(t):
    return diff.tree_statuses(*nested_snapshots(t), NESTED_RULE)


@query("""SELECT o_orderkey AS node, o_custkey AS target, 'backwards' AS applies FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'forwards' FROM orders WHERE o_orderkey % 5 <> 0""")
def diff_dependency_merge(t):
    edge, k = t.orders.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("target")), F.col("node")
    return diff.both_sides(edge.filter(k % 7 != 0), edge.filter(k % 5 != 0))


@query(f"{_SNAPSHOTS} SELECT a.k, 's' AS attr, 'status.' || a.s || '.' || b.s AS target FROM a JOIN b ON a.k = b.k WHERE a.s <> b.s UNION ALL SELECT a.k, 'p', 'priority.' || b.p FROM a JOIN b ON a.k = b.k WHERE a.p IS DISTINCT FROM b.p AND b.p IS NOT NULL")
def diff_change_edges(t):
    return diff.change_edges(*snapshots(t), ORDER_RULE, {"s": "status.{old.s}.{new.s}", "p": "priority.{new.p}"})


@query("""SELECT 'a' || s_suppkey AS node, 'b' || s_suppkey AS target, CAST(NULL AS BIGINT) AS depset_id FROM supplier WHERE s_suppkey % 3 <> 1
UNION ALL SELECT 'a' || s_suppkey, 'base' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'b' || s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'a' ELSE 'c' END || s_suppkey, CAST(s_suppkey AS BIGINT) FROM supplier""")
def cycle_broken(t):
    """a needs b; b needs a, or else c where s_suppkey % 3 = 0; c alone where it is 2; where it is 1 a view's base stands in for b."""
    k = F.col("s_suppkey")
    of = lambda letter: F.concat(F.lit(letter), text("s_suppkey"))
    edge = t.supplier.select(of("a").alias("node"), of("b").alias("target"))
    choices = F.when(k % 3 == 0, F.array(of("a"), of("c"))).when(k % 3 == 1, F.array(of("a"))).otherwise(F.array(of("c")))
    options = t.supplier.select(k.cast("bigint").alias("depset_id"), of("b").alias("node"), F.posexplode(choices).alias("priority", "target"))
    breakers = t.supplier.filter(k % 3 == 1).select(of("b").alias("node"), of("base").alias("breaker"))
    return graph.without_cycles(edge, options, breakers)


@query("""SELECT n_nationkey AS k, 'create table geo.' || t || ' ();' AS line FROM (SELECT n_nationkey, 't' || n_nationkey AS t FROM nation) UNION ALL SELECT k, 'alter table geo.t' || k || ' add column "Name" text not null;' FROM (SELECT n_nationkey AS k FROM nation)
UNION ALL SELECT n_nationkey, 'create unique index i' || n_nationkey || ' on geo.t' || n_nationkey || ' (a, b);' FROM nation UNION ALL SELECT n_nationkey, 'revoke select on geo.t' || n_nationkey || ' from r' || n_regionkey || ';' FROM nation
UNION ALL SELECT n_nationkey, 'comment on table geo.t' || n_nationkey || ' is ' || chr(39) || n_name || chr(39) || ';' FROM nation""")
def ddl_statements(t):
    k = text("n_nationkey")
    named = lambda letter: F.concat(F.lit(letter), k)
    one = lambda action, kind, name, **attrs: F.struct(F.lit(action).alias("action"), F.lit(kind).alias("kind"), name.alias("name"), F.create_map(*(x for key, v in attrs.items() for x in (F.lit(key), v))).alias("attrs"))
    rows = F.array(
        one("build", "table", named("t"), none=F.lit("")),
        one("build", "column", F.lit("Name"), type=F.lit("text"), nullable=F.lit("false")),
        one("build", "index", named("i"), columns=F.lit("a, b"), unique=F.lit("true")),
        one("drop", "grant", F.lit(""), privilege=F.lit("select"), to=F.concat(F.lit("r"), text("n_regionkey"))),
        one("build", "comment", F.lit(""), comment=F.col("n_name")),
    )
    each = t.nation.select(F.col("n_nationkey").alias("k"), named("t").alias("table"), F.inline(rows))
    return each.select("k", render.statement(F.col("action"), F.col("kind"), F.lit("geo"), F.col("name"), F.col("table"), F.col("attrs")).alias("line"))


_RARER = {0: "matview", 1: "operator", 2: "extension", 3: "text_search_configuration_map", 4: "range", 5: "event_trigger"}


@query("""WITH o AS (SELECT p_partkey AS k, 'o' || p_partkey AS n, p_size AS s, replace(p_name, chr(39), chr(39) || chr(39)) AS c, p_partkey % 6 AS kind, CASE WHEN p_partkey % 5 < 2 THEN 'build' WHEN p_partkey % 5 < 4 THEN 'diff' ELSE 'drop' END AS a FROM part),
t AS (SELECT *, CASE kind WHEN 0 THEN 'materialized view geo.' || n WHEN 1 THEN 'operator geo.+ (' || CASE WHEN s % 3 = 0 THEN 'none' ELSE 'int' END || ', int)' WHEN 2 THEN 'extension ' || n WHEN 4 THEN 'type geo.' || n WHEN 5 THEN 'event trigger ' || n END AS it FROM o),
lines AS (SELECT k, 0 AS place, CASE kind WHEN 0 THEN 'create ' || it || ' as select ' || s || ';' WHEN 1 THEN 'create operator geo.+ (procedure = f' || s || CASE WHEN s % 3 = 0 THEN '' ELSE ', leftarg = int' END || ', rightarg = int);' WHEN 2 THEN 'create ' || it || ' version ' || chr(39) || s || chr(39) || ';' WHEN 3 THEN 'alter text search configuration geo.conf add mapping for ' || n || ' with d' || s || ';' WHEN 4 THEN 'create ' || it || ' as range (subtype = t' || s || ');' ELSE 'create ' || it || ' on e' || s || ' execute procedure f();' END AS line FROM t WHERE a = 'build'
UNION ALL SELECT k, 0, CASE WHEN kind = 3 THEN 'alter text search configuration geo.conf drop mapping for ' || n || ';' ELSE 'drop ' || it || ';' END FROM t WHERE a = 'drop'
UNION ALL SELECT k, 0, CASE kind WHEN 2 THEN 'alter ' || it || ' update to ' || chr(39) || s || chr(39) || ';' WHEN 3 THEN 'alter text search configuration geo.conf alter mapping for ' || n || ' with d' || s || ';' ELSE 'alter ' || it || ' disable;' END FROM t WHERE a = 'diff' AND kind IN (2, 3, 5)
UNION ALL SELECT k, 1, 'alter ' || it || ' disable;' FROM t WHERE a = 'build' AND kind = 5
UNION ALL SELECT k, 2, 'comment on ' || it || ' is ' || chr(39) || c || chr(39) || ';' FROM t WHERE kind <> 3 AND (a = 'build' OR a = 'diff' AND s % 2 = 0))
SELECT k, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS part, line FROM lines""")
def ddl_rarer_kinds(t):
    size, k = text("p_size"), F.col("p_partkey")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in _RARER.items() for x in pair)), (k % 6).cast("int"))
    attrs = {"query": F.concat(F.lit("select "), size), "function": F.when(kind == "operator", F.concat(F.lit("f"), size)).otherwise("f"), "left": F.when(F.col("p_size") % 3 != 0, "int"), "right": F.lit("int"), "dictionaries": F.concat(F.lit("d"), size), "subtype": F.concat(F.lit("t"), size), "event": F.concat(F.lit("e"), size), "version": size, "enabled": F.lit("false"), "comment": F.col("p_name")}
    made = lambda attrs: F.create_map(*(x for a, v in attrs.items() for x in (F.lit(a), v)))
    old = made(attrs | {"version": text("p_partkey"), "dictionaries": F.lit("d"), "enabled": F.lit("true"), "comment": F.when(F.col("p_size") % 2 != 0, F.col("p_name"))})
    # The versions differ in any case: an extension of size k would not change.
    old = F.map_zip_with(old, made(attrs), lambda a, x, y: F.when((a == "version") & (x == y), F.concat(x, F.lit("+"))).otherwise(x))
    action = F.when(k % 5 < 2, "build").when(k % 5 < 4, "diff").otherwise("drop")
    rows = t.part.select(k.alias("k"), action.alias("action"), kind.alias("type"), F.lit("geo").alias("schema"), F.when(kind == "operator", "+").otherwise(F.concat(F.lit("o"), text("p_partkey"))).alias("name"), F.lit("conf").alias("relation"), made(attrs).alias("attrs"), old.alias("old_attrs"))
    return render.statements(rows, ["k"]).select("k", "part", F.col("text").alias("line"))


# --- fallbacks, prints, numbers and inherited children -------------------------------------------------------------------------


@query(f"""{_PATHS.replace("lag(m) OVER o AS pm", "lag(m) OVER o AS pm, lag(n) OVER o AS pn")} SELECT k, n, 'depart' AS move, pm AS at FROM w WHERE pr IS NOT NULL AND (r <> pr OR m <> pm) AND pn % 3 <> 0 UNION ALL SELECT k, n, 'depart', pr FROM w WHERE r <> pr
UNION ALL SELECT k, n, 'arrive', r FROM w WHERE r IS DISTINCT FROM pr UNION ALL SELECT k, n, 'arrive', m FROM w WHERE (r IS DISTINCT FROM pr OR m IS DISTINCT FROM pm) AND n % 3 <> 1""")
def nav_moves_of_actions(t):
    n = F.col("n")
    steps = paths(t).withColumn("action", F.when(n % 3 == 0, "drop").when(n % 3 == 1, "build").otherwise("diff"))
    return navigation.moves(steps, "path", ["n"], ["k"], "action").select("k", "n", "move", "at")


@query("SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS disabled FROM orders")
def print_filter(t):
    prints = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("condition"))
    return navigation.without_prints(t.orders.select("o_orderkey"), prints, "o_orderkey")


@query("SELECT o_orderkey, index FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS index FROM orders) WHERE o_orderstatus = 'F'")
def index_before_filter(t):
    return relational.numbered(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).filter("o_orderstatus = 'F'").select("o_orderkey", "index")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 3")
def row_by_number(t):
    return relational.numbered(t.orders, ["o_custkey"], ["o_orderkey"], "n").filter("n = 3").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, r_regionkey FROM customer LEFT JOIN region ON r_name = 'EUROPE' AND c_nationkey < 10")
def constant_key_left_join(t):
    named = t.region.filter("r_name = 'EUROPE'").select("r_regionkey", F.lit(True).alias("one"))
    return t.customer.withColumn("one", F.col("c_nationkey") < 10).join(named, "one", "left").select("c_custkey", "r_regionkey")


@query("SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'), '') AS inherited FROM customer")
def nested_inherited(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_orderstatus") == "O").alias("inherited"))
    out = relational.nested_where(t.customer.select("c_custkey"), orders, "inherited", ["c_custkey"], "items", ["o_orderkey"])
    return out.select("c_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("inherited"))


@query("""WITH u AS (SELECT DISTINCT l_orderkey::VARCHAR AS node, l_suppkey::VARCHAR AS f, CASE WHEN l_returnflag = 'N' THEN 'build' ELSE 'drop' END AS side FROM lineitem WHERE l_linenumber = 1)
SELECT node, 'fallback.' || side || '.' || f AS target FROM u UNION ALL SELECT 'endfallback.' || side || '.' || f, node FROM u
UNION ALL SELECT 'fallback.build.' || f, 'endfallback.drop.' || f FROM u GROUP BY f HAVING count(DISTINCT side) = 2""")
def fallback_edges(t):
    side = F.when(F.col("l_returnflag") == "N", "build").otherwise("drop")
    return graph.fallback_edges(t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("node"), text("l_suppkey").alias("fallback"), side.alias("side")))


# --- trees: matching level by level, rebuilds, whole objects, inherited columns ----------------------------------------------

TREE_RULES = {"region": diff.Rule(key=("name",)), "customer": diff.Rule(key=("name",), attributes=(diff.Attribute("balance"), diff.Attribute("segment", rebuild=True))), "order": diff.Rule(key=("name",), attributes=(diff.Attribute("status"),), texts=("note",))}


def trees(t) -> tuple[DataFrame, DataFrame]:
    """Regions, nations (whose type has no rule), customers and orders. New: nations renamed, customers moved, changed or left out, orders changed or left out."""
    attrs = lambda **named: F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))).alias("attrs")
    ident = lambda letter, c: F.concat(F.lit(letter), text(c))
    node = lambda d, id_, parent, kind, a: d.select(id_.alias("id"), parent.alias("parent"), F.lit(kind).alias("type"), a)
    no = F.lit(None).cast("string")
    region = node(t.region, ident("r", "r_regionkey"), no, "region", attrs(name=F.col("r_name")))
    nation = lambda name: node(t.nation, ident("n", "n_nationkey"), ident("r", "n_regionkey"), "nation", attrs(fqn=name))
    customer = lambda d, of, balance, segment: node(d, ident("c", "c_custkey"), ident("n", of), "customer", attrs(name=F.col("c_name"), balance=balance, segment=segment))
    order = lambda d, status: node(d, ident("o", "o_orderkey"), ident("c", "o_custkey"), "order", attrs(name=text("o_orderkey"), status=status))
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    old = region.unionByName(nation(F.col("n_name"))).unionByName(customer(t.customer, "c_nationkey", text(F.floor("c_acctbal")), F.col("c_mktsegment"))).unionByName(order(t.orders.filter(k % 8 != 7), F.col("o_orderstatus")))
    left = t.customer.filter(c % 10 != 4)
    new = customer(left, F.when(c % 11 == 5, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")), text(F.floor("c_acctbal") + F.when(c % 9 == 1, 1).otherwise(0)), F.when(c % 7 == 2, "other").otherwise(F.col("c_mktsegment")))
    orders = t.orders.filter(k % 9 != 1).join(left, F.col("o_custkey") == c, "left_semi")
    new = region.unionByName(nation(F.when(F.col("n_nationkey") % 8 == 3, F.concat("n_name", F.lit("*"))).otherwise(F.col("n_name")))).unionByName(new)
    return old, new.unionByName(order(orders, F.when(k % 6 == 2, "X").otherwise(F.col("o_orderstatus"))))


_TREE = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_nationkey % 8 <> 3 AS same_n, c_custkey % 10 <> 4 AS stays, c_custkey % 11 = 5 AS moves FROM customer),
o AS (SELECT o_orderkey AS k, c.k AS c, o_orderkey % 8 <> 7 AS was, o_orderkey % 9 <> 1 AND c.stays AS is_, c.stays AND c.same_n AND NOT c.moves AS same_c, o_orderkey % 6 = 2 AND o_orderstatus <> 'X' AS other FROM orders JOIN c ON o_custkey = c.k),
os AS (SELECT k, c, same_c, CASE WHEN same_c AND was AND is_ THEN CASE WHEN other THEN 'diff' ELSE 'none' END END AS both_, was, is_ FROM o),
kids AS (SELECT c, bool_or(both_ = 'diff' OR (is_ AND NOT was)) AS kids FROM os GROUP BY c),
cs AS (SELECT c.*, stays AND same_n AND NOT moves AS both_, CASE WHEN c_custkey % 7 = 2 AND c_mktsegment <> 'other' THEN 'rebuild' WHEN c_custkey % 9 = 1 THEN 'diff' WHEN kids THEN 'diffkids' ELSE 'none' END AS status FROM c JOIN customer ON c_custkey = k LEFT JOIN kids ON kids.c = k),
t AS (SELECT 'new:r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, 'diffkids' AS status FROM region
UNION ALL SELECT 'new:n' || n_nationkey, 'new:r' || n_regionkey, CASE WHEN n_nationkey % 8 = 3 THEN 'new' ELSE 'UNKNOWN' END FROM nation UNION ALL SELECT 'old:n' || n_nationkey, 'new:r' || n_regionkey, 'gone' FROM nation WHERE n_nationkey % 8 = 3
UNION ALL SELECT 'new:c' || k, 'new:n' || CASE WHEN moves THEN (n + 1) % 25 ELSE n END, CASE WHEN both_ THEN status ELSE 'new' END FROM cs WHERE stays
UNION ALL SELECT 'old:c' || k, CASE WHEN same_n THEN 'new:n' ELSE 'old:n' END || n, 'gone' FROM cs WHERE NOT both_
UNION ALL SELECT 'new:o' || k, 'new:c' || c, coalesce(both_, 'new') FROM os WHERE is_
UNION ALL SELECT 'old:o' || os.k, CASE WHEN same_c THEN 'new:c' ELSE 'old:c' END || c, 'gone' FROM os WHERE was AND both_ IS NULL)"""


@query(f"{_TREE} SELECT node, parent, status FROM t")
def diff_tree_statuses(t):
    return tree.statuses(*trees(t), TREE_RULES).select("node", "parent", "status")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 3 THEN 'rebuild' WHEN p_partkey % 7 = 1 THEN 'new' WHEN p_partkey % 6 = 5 THEN 'diff' ELSE 'none' END AS status FROM part),
e AS (SELECT k AS node, CASE WHEN k % 50 = 0 THEN k + 1 ELSE CAST(floor(k / 2) AS BIGINT) END AS target FROM p WHERE k > 1 AND k % 5 <> 1 UNION SELECT k, k - 1 FROM p WHERE k % 11 = 0 UNION SELECT k, k * 2 FROM p WHERE k % 13 = 0),
h(node) AS (SELECT k FROM p WHERE status = 'rebuild' UNION SELECT e.node FROM h JOIN e ON e.target = h.node),
s AS (SELECT k, CASE WHEN k IN (SELECT node FROM h) AND status <> 'new' THEN 'rebuild' ELSE status END AS status, k IN (SELECT node FROM h) AND status NOT IN ('new', 'rebuild') AS fresh FROM p),
u(node) AS (SELECT a.k FROM s JOIN s a ON a.k = CAST(floor(s.k / 4) AS BIGINT) WHERE s.fresh AND a.status = 'none' UNION SELECT a.k FROM u JOIN s a ON a.k = CAST(floor(u.node / 4) AS BIGINT) WHERE a.status = 'none')
SELECT k AS node, CASE WHEN status = 'none' AND k IN (SELECT node FROM u) THEN 'diffkids' ELSE status END AS status FROM s""")
def diff_rebuild_parents(t):
    """Parts need k/2 (some of them k + 1, some of them 2k, so that there are cycles), follow k - 1 and lie under k/4."""
    k = F.col("p_partkey")
    status = F.when(k % 97 == 3, "rebuild").when(k % 7 == 1, "new").when(k % 6 == 5, "diff").otherwise("none")
    nodes = t.part.select(k.alias("node"), F.floor(k / 4).alias("parent"), status.alias("status"), F.when(k % 11 == 0, k - 1).alias("follow"))
    need = t.part.filter(k > 1).select(k.alias("node"), F.when(k % 50 == 0, k + 1).otherwise(F.floor(k / 2)).alias("target"), (k % 5 == 1).alias("soft"))
    return tree.promoted(nodes, need.unionByName(t.part.filter(k % 13 == 0).select(k.alias("node"), (k * 2).alias("target"), F.lit(None).cast("boolean").alias("soft")))).select("node", "status")


@query("""WITH l AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN k % 10 = 0 THEN 'OLD' WHEN k % 10 = 9 THEN 'NEW' WHEN k % 4 = 1 AND n > 1 THEN 'MODIFIED' WHEN k % 4 = 3 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status FROM l""")
def tree_equality(t):
    """Orders with their lines as whole objects: attributes in another order change nothing, lines in another order and one other quantity do."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"))
    no, k = F.lit(None).cast("string"), F.col("k")
    order = lambda d: d.select("k").distinct().select(F.concat(F.lit("o"), text("k")).alias("id"), no.alias("parent"), F.lit("order").alias("type"), F.create_map(F.lit("k"), text("k")).alias("attrs"), F.lit(0).alias("place"), no.alias("text"), "k")
    line = lambda d, attrs, place, said: d.select(F.concat(text("k"), F.lit("."), text("n")).alias("id"), F.concat(F.lit("o"), text("k")).alias("parent"), F.lit("line").alias("type"), attrs.alias("attrs"), place.alias("place"), said.alias("text"), F.lit(None).cast("bigint").alias("k"))
    was, now = lines.filter(k % 10 != 9), lines.filter(k % 10 != 0)
    old = order(was).unionByName(line(was, F.create_map(F.lit("n"), text("n"), F.lit("q"), text("q")), F.col("n"), F.lit("said")))
    other = F.when((k % 4 == 3) & (F.col("n") == F.min("n").over(Window.partitionBy("k"))), F.col("q") + 1).otherwise(F.col("q"))
    new = order(now).unionByName(line(now, F.create_map(F.lit("q"), text(other), F.lit("n"), text("n")), F.when(k % 4 == 1, -F.col("n")).otherwise(F.col("n") * 10), F.lit(" said\n")))
    return tree.equal_subtrees(old, new, ["k"])


@query("""WITH s AS (SELECT s_suppkey AS k, ['none', 'diff', 'gone', 'new'][s_suppkey % 4 + 1] AS status FROM supplier), c AS (SELECT k, unnest([1, 2, 3]) AS i FROM s),
cs AS (SELECT k, i, ['none', 'gone', 'diff'][(k + i) % 3 + 1] AS status, (k + i) % 5 = 0 AS is_local FROM c),
e AS (SELECT k, i, (k * 3 + j) % 90 AS f, (k + j) % 3 <> 0 AS was, (k + j) % 3 <> 1 AS is_ FROM c, (SELECT unnest([0, 1]) AS j) WHERE k % 2 = 0),
l AS (SELECT e.k, e.i, string_agg(f || ':' || CASE WHEN NOT is_ THEN 'disinherit' WHEN NOT was THEN 'inherit' ELSE '' END || ':' || coalesce(CASE WHEN cs.status = 'gone' AND s.status = 'gone' THEN 'none' ELSE cs.status END, '?'), ',' ORDER BY f) AS inherits
  FROM e LEFT JOIN s ON s.k = f LEFT JOIN cs ON cs.k = f AND cs.i = e.i GROUP BY 1, 2)
SELECT cs.k AS "table", 'c' || cs.i AS "column", cs.status, s.status AS parent_status, CASE WHEN is_local THEN '' ELSE coalesce(inherits, '') END AS inherits FROM cs JOIN s ON s.k = cs.k LEFT JOIN l ON l.k = cs.k AND l.i = cs.i""")
def diff_enriched(t):
    k, i, j = F.col("table"), F.col("i"), F.col("j")
    kind = t.supplier.schema["s_suppkey"].dataType
    tables = t.supplier.select(F.col("s_suppkey").alias("table")).withColumn("status", F.get(F.array(*map(F.lit, ("none", "diff", "gone", "new"))), (k % 4).cast("int")))
    each = tables.select("table", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i"))
    columns = each.select("table", F.concat(F.lit("c"), text("i")).alias("column"), F.get(F.array(*map(F.lit, ("none", "gone", "diff"))), ((k + i) % 3).cast("int")).alias("status"), ((k + i) % 5 == 0).alias("is_local"))
    heirs = each.filter(k % 2 == 0).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select("table", F.concat(F.lit("c"), text("i")).alias("column"), ((k * 3 + j) % 90).cast(kind).alias("from_table"), ((k + j) % 3).alias("third"))
    out = tree.inherited(columns, tables, heirs.filter("third <> 0").drop("third"), heirs.filter("third <> 1").drop("third"))
    said = lambda x: F.concat(text(x["from_table"]), F.lit(":"), F.coalesce(x["change"], F.lit("")), F.lit(":"), F.coalesce(x["column_status"], F.lit("?")))
    return out.select("table", "column", "status", "parent_status", F.array_join(F.transform("inherits", said), ",").alias("inherits"))


# --- sets of dependencies: nested, with shared fallbacks, chosen with a search back; mirrors that travel; plans without silent nodes -----


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2), o AS (SELECT DISTINCT k FROM l), h AS (SELECT 'c' || r_regionkey AS c FROM region WHERE r_regionkey < 3),
d AS (SELECT k, 'p' || p AS name, CASE WHEN n > 2 AND k % 2 = 1 THEN 'forwards' END AS own, CASE WHEN n > 2 THEN 60 WHEN n = 1 THEN 100 ELSE 50 END AS a, CASE WHEN n > 2 THEN 10 ELSE n END AS b, CASE WHEN n > 2 THEN 200 - 10 * n ELSE 0 END AS c, n,
  (k % 5 <> 0 OR 'c' || (k % 4) IN (SELECT c FROM h)) AND (n <= 2 OR ('c' || (k % 4) IN (SELECT c FROM h) AND 'c' || (n % 4) IN (SELECT c FROM h))) AS holds FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b, c, n, name) AS i FROM d WHERE holds AND name IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 30))
SELECT k AS node, 's' || k AS depset_id, name, coalesce(own, CASE k % 3 WHEN 0 THEN 'forwards' WHEN 1 THEN 'backwards' END) AS applies FROM r WHERE i = 1
UNION ALL SELECT k, NULL, 'order' || k, CASE k % 3 WHEN 0 THEN 'forwards' WHEN 1 THEN 'backwards' END FROM o""")
def depset_nested(t):
    """Each order has a group around a set of its first lines and, in its middle, a set of the others, with conditions on all three levels."""
    k, n = F.col("k"), F.col("n")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("p"))
    no = F.lit(None).cast("string")
    of = lambda letter: F.concat(F.lit(letter), text("k"))
    held = lambda x: F.concat(F.lit("c"), text(x % 4))

    def part(d, id_, parent, kind, place, fqn=no, pqn=no, applies=no, condition=no, priority=F.lit(None)):
        return d.select(id_.alias("id"), parent.alias("parent"), k.alias("node"), F.lit(kind).alias("kind"), place.cast("int").alias("place"), fqn.alias("fqn"), pqn.alias("pqn"), applies.alias("applies"), no.alias("direction"), condition.alias("condition"), priority.cast("int").alias("priority"))

    orders = lines.select("k").distinct()
    parts = [
        part(orders, of("g"), no, "dependencies", F.lit(0), applies=F.when(k % 3 == 0, "forwards").when(k % 3 == 1, "Backwards")),
        part(orders, of("s"), of("g"), "set", F.lit(1), condition=F.when(k % 5 == 0, held(k))),
        part(orders, of("o"), of("g"), "dependency", F.lit(2), fqn=of("order")),
        part(orders, of("t"), of("s"), "set", F.lit(10), applies=F.when(k % 2 == 1, "forwards"), condition=held(k), priority=F.lit(60)),
        part(lines.filter("n <= 2"), F.concat(text("k"), F.lit("."), text("n")), of("s"), "dependency", n, fqn=F.concat(F.lit("p"), text("p")), priority=F.when(n > 1, 50)),
        part(lines.filter("n > 2"), F.concat(text("k"), F.lit("."), text("n")), of("t"), "dependency", n, pqn=F.concat(F.lit("p"), text("p")), condition=held(n), priority=200 - 10 * n),
    ]
    all_ = parts[0]
    for more in parts[1:]:
        all_ = all_.unionByName(more)
    options = depsets.flattened(all_)
    return depsets.chosen(options, t.part.filter("p_size > 30").select(F.concat(F.lit("p"), text("p_partkey")).alias("name")), t.region.filter("r_regionkey < 3").select(F.concat(F.lit("c"), text("r_regionkey")).alias("condition"))).select("node", "depset_id", "name", "applies")


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS id, o_custkey AS g, o_orderkey % 2 AS side, 'f' || o_custkey || '.' AS f, CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE o_orderkey % 3 * 70 END AS pr FROM orders),
x AS (SELECT *, f || (id % 4) AS name, f || (id * 7 % 5) || 'x' AS fallback, row_number() OVER (PARTITION BY g, side ORDER BY pr, id) AS n FROM s),
r(g, side, n, id, made, used, own) AS (SELECT g, side, 1, id, [fallback], fallback, TRUE FROM x WHERE n = 1
  UNION ALL SELECT r.g, r.side, x.n, x.id, CASE WHEN len(list_filter(made, lambda m: starts_with(m, name) OR m = fallback)) > 0 THEN made ELSE list_append(made, fallback) END,
    coalesce(list_filter(made, lambda m: starts_with(m, name) OR m = fallback)[1], fallback), len(list_filter(made, lambda m: starts_with(m, name) OR m = fallback)) = 0
  FROM r JOIN x ON x.g = r.g AND x.side = r.side AND x.n = r.n + 1)
SELECT id AS depset_id, used AS fallback, own FROM r""")
def fallback_shared(t):
    """A customer's orders as sets on two sides, each of which may use the fallbacks made before it."""
    k, f = F.col("o_orderkey"), F.concat(F.lit("f"), text("o_custkey"), F.lit("."))
    sets = t.orders.select(k.alias("depset_id"), F.concat(text("o_custkey"), F.when(k % 2 == 0, "build").otherwise("drop")).alias("side"), F.when(k % 3 != 0, k % 3 * 70).alias("priority"), F.array(F.concat(f, text(k % 4))).alias("names"), F.concat(f, text(k * 7 % 5), F.lit("x")).alias("fallback"))
    return depsets.shared_fallbacks(sets)


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier)
SELECT 'a' || k AS node, CASE WHEN m IN (1, 3) THEN 'd' ELSE 'b' END || k AS target, k * 2 AS depset_id FROM s WHERE m <> 2 UNION ALL SELECT 'a' || k, 'base' || k, k * 2 FROM s WHERE m = 2
UNION ALL SELECT 'b' || k, CASE WHEN m = 0 THEN 'e' WHEN m IN (1, 3) THEN 'a' ELSE 'f' END || k, k * 2 + 1 FROM s UNION ALL SELECT 'f' || k, 'a' || k, NULL FROM s UNION ALL SELECT 'd' || k, 'a' || k, NULL FROM s WHERE m IN (0, 2)""")
def cycle_backtracked(t):
    """a needs b or d, b needs a or else e (f where that leads back to a). Taking d first would end in a's cycle with d, which nothing breaks: b's choice moves on, or is taken back for a's."""
    k = F.col("s_suppkey").cast("bigint")
    of = lambda letter: F.concat(F.lit(letter), text("s_suppkey"))
    fixed = t.supplier.select(of("f").alias("node"), of("a").alias("target")).unionByName(t.supplier.filter(k % 4 % 2 == 0).select(of("d").alias("node"), of("a").alias("target")))
    first = t.supplier.select((k * 2).alias("depset_id"), of("a").alias("node"), F.posexplode(F.when(k % 4 == 2, F.array(of("b"))).otherwise(F.array(of("b"), of("d")))).alias("priority", "target"))
    second = t.supplier.select((k * 2 + 1).alias("depset_id"), of("b").alias("node"), F.posexplode(F.when(k % 4 == 0, F.array(of("a"), of("e"))).otherwise(F.array(of("a"), of("f")))).alias("priority", "target"))
    breakers = t.supplier.filter(k % 4 == 2).select(of("b").alias("node"), of("base").alias("breaker"))
    return depsets.acyclic_choice(fixed, first.unionByName(second), breakers)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, CAST(floor(p_partkey / 3) AS BIGINT) AS target FROM part WHERE p_partkey >= 3 AND p_partkey % 5 <> 0),
r(f, node) AS (SELECT node, target FROM e UNION SELECT f, e.target FROM r JOIN e ON e.node = r.node)
SELECT node, CASE node % 4 WHEN 1 THEN 'diff' ELSE 'build' END AS action, f AS after_node, CASE f % 4 WHEN 0 THEN 'drop' ELSE 'diffprep' END AS after_action FROM r WHERE f % 4 IN (0, 1) AND node % 4 IN (0, 1, 2) AND node IN (SELECT p_partkey FROM part)""")
def mirrors_propagated(t):
    k = F.col("p_partkey")
    does = F.when(k % 4 == 0, F.array(F.lit("drop"), F.lit("build"))).when(k % 4 == 1, F.array(F.lit("diffprep"), F.lit("diff"))).when(k % 4 == 2, F.array(F.lit("build"))).otherwise(F.array(F.lit("exists")))
    heirs = t.part.filter(k >= 3).select(k.alias("node"), F.floor(k / 3).alias("target"), (k % 5 != 0).alias("propagate"))
    return depsets.propagated_mirrors(t.part.select(k.alias("node"), F.explode(does).alias("action")), heirs)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey % 7 IN (0, 3) AS silent FROM part),
e AS (SELECT k AS node, CAST(floor(k / 2) AS BIGINT) AS target FROM p WHERE k > 1 UNION SELECT k, CAST(floor(k / 3) AS BIGINT) FROM p WHERE k > 2 UNION SELECT CAST(floor(k / 2) AS BIGINT), k FROM p WHERE k % 14 = 3 AND k > 3),
n AS (SELECT e.node, e.target, s.silent AS from_silent, x.silent AS to_silent FROM e JOIN p s ON s.k = node JOIN p x ON x.k = target WHERE NOT (node % 14 = 3 AND node > 3)),
w(u, x, silent) AS (SELECT node, target, to_silent FROM n WHERE NOT from_silent UNION SELECT u, n.target, n.to_silent FROM w JOIN n ON n.node = w.x WHERE w.silent),
l(node, lvl) AS (SELECT k, 0 FROM p WHERE NOT silent UNION SELECT w.u, l.lvl + 1 FROM l JOIN w ON w.x = l.node AND NOT w.silent AND w.u <> w.x)
SELECT node, CASE WHEN node % 2 = 0 THEN 'drop' ELSE 'build' END AS action, max(lvl) AS level, CASE WHEN node % 2 = 0 THEN -max(lvl) ELSE max(lvl) END AS place FROM l GROUP BY node""")
def plan_contracted(t):
    """The order of parts without those that print nothing, some of which stand on cycles."""
    k = F.col("p_partkey")
    actions = t.part.select(k.alias("node"), F.when(k % 2 == 0, "drop").otherwise("build").alias("action"))
    needs = part_edges(t).select(F.col("target").alias("node"), F.col("source").alias("target")).unionByName(t.part.filter((k % 14 == 3) & (k > 3)).select(F.floor(k / 2).alias("node"), k.alias("target")))
    known = t.part.select(k.alias("target"))
    needs = graph.met(graph.met(needs, known, "target", "left_semi"), known.withColumnRenamed("target", "node"), "node", "left_semi").select("node", "target")
    return depsets.plan_of_printed(actions, needs, t.part.filter((k % 7).isin(0, 3)).select(k))


# --- XML documents, printed scripts, values of mixed kinds -----------------------------------------------------------------

ORDER_XML = "_key BIGINT, status STRING, lines STRUCT<line: ARRAY<STRUCT<_n: INT, _part: BIGINT, _VALUE: STRING>>>"


def order_texts(t) -> DataFrame:
    """(k, c, xml): each order as an element with its lines."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "p", "q"))), lambda x: F.concat(F.lit("<line n='"), text(x["n"]), F.lit("' part='"), text(x["p"]), F.lit("'>"), text(F.floor(x["q"])), F.lit("</line>"))), "")
    nested = lines.groupBy("k").agg(each.alias("lines"))
    whole = F.concat(F.lit("<order key='"), text("o_orderkey"), F.lit("'><status>"), "o_orderstatus", F.lit("</status>"), F.coalesce(F.concat(F.lit("<lines>"), "lines", F.lit("</lines>")), F.lit("")), F.lit("</order>"))
    return t.orders.join(nested, F.col("o_orderkey") == F.col("k"), "left").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), whole.alias("xml"))


_XML_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS p, CAST(floor(max(l_quantity)) AS VARCHAR) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2"


@query(f"WITH l AS ({_XML_LINES}) SELECT o_orderkey AS k, o_orderstatus AS status, n, p, CAST(CAST(q AS DOUBLE) AS BIGINT) AS q FROM orders LEFT JOIN l ON k = o_orderkey")
def xml_nested(t):
    """Orders told as XML and read again with a nested schema."""
    found = documents.parsed(order_texts(t), "xml", ORDER_XML)
    return found.select("k", F.col("document.status").alias("status"), F.explode_outer("document.lines.line").alias("x")).select("k", "status", F.col("x._n").alias("n"), F.col("x._part").alias("p"), F.col("x._VALUE").cast("bigint").alias("q"))


@query(f"""WITH l AS ({_XML_LINES}), n AS (SELECT o_orderkey AS k, o_orderkey || '/order' AS id, CAST(NULL AS VARCHAR) AS parent, 'order' AS type, 'key=' || o_orderkey AS attrs, CAST(NULL AS VARCHAR) AS text FROM orders
UNION ALL SELECT o_orderkey, o_orderkey || '/order/status0', o_orderkey || '/order', 'status', '', o_orderstatus FROM orders UNION ALL SELECT k, k || '/order/lines0', k || '/order', 'lines', '', NULL FROM l GROUP BY k
UNION ALL SELECT k, k || '/order/lines0/line' || (row_number() OVER (PARTITION BY k ORDER BY n) - 1), k || '/order/lines0', 'line', 'n=' || n || ',part=' || p, CAST(CAST(CAST(q AS DOUBLE) AS BIGINT) AS VARCHAR) FROM l)
SELECT id, parent, type, attrs, text FROM n""")
def xml_nodes(t):
    """The same documents as the rows of a tree."""
    rows = documents.nodes(documents.parsed(order_texts(t), "xml", ORDER_XML), "k", "document", "order")
    return rows.select("id", "parent", "type", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attrs"), "text")


@query("WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 AS f, o_orderstatus AS status FROM orders) SELECT k, status, 'db' || f AS dbname FROM o")
def xml_files(t):
    """Orders written as ten XML files, each with a header, and read back by several tasks with the header of their file."""
    path, k = folder(t), F.col("k")
    rows = order_texts(t).withColumn("f", F.col("c") % 10)
    ends = rows.select("f").distinct()
    frame = lambda turn, line: ends.select("f", F.lit(turn).alias("turn"), F.lit(None).cast("bigint").alias("k"), line.alias("xml"))
    head = F.concat(F.lit("<dump><header dbname='db"), text("f"), F.lit("' version='1.2'/>"))
    whole = rows.select("f", F.lit(1).alias("turn"), k.cast("bigint").alias("k"), "xml").unionByName(frame(0, head)).unionByName(frame(2, F.lit("</dump>")))
    whole.repartition("f").sortWithinPartitions("f", "turn", "k").select("f", F.col("xml").alias("value")).write.partitionBy("f").text(path)
    orders = documents.read(t.spark, path, "order", "_key BIGINT, status STRING")
    headers = documents.read(t.spark, path, "header", "_dbname STRING, _version STRING")
    return documents.with_header(orders, headers).select(F.col("_key").alias("k"), "status", F.col("header._dbname").alias("dbname"))


@query("""WITH l AS (SELECT 1 AS turn, 0 AS n, '-- orders of ' || (SELECT count(*) FROM customer) || ' customers' AS text UNION ALL SELECT 1, 1, '-- kept'
UNION ALL SELECT 2, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey), 'insert ' || o_orderkey || ';' FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 3, 0, '-- end')
SELECT row_number() OVER (ORDER BY turn, n) AS line, text FROM l""")
def print_sink(t):
    """Statements written twice as ordered text files of some thousand lines, the second time with the first one's header kept, and read back."""
    path = folder(t)
    said = t.orders.withColumn("text", F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("insert "), text("o_orderkey"), F.lit(";"))))
    prints.write(said.limit(10), path, [F.col("o_orderkey")], header=["-- kept"])
    head = prints.filled(["orders of $n$ customers", "=>"], {"n": str(t.customer.count())}, prints.header_of(t.spark, path))
    prints.write(said, path, [F.desc("o_orderpriority"), F.col("o_orderkey")], header=head, footer=["-- end"], rows_per_file=2000)
    return prints.lines(t.spark, path)


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 10 AS a, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE p_partkey % 12 END AS b, chr(CAST(97 + p_partkey % 3 AS INTEGER)) AS c FROM part)
SELECT k, CASE WHEN k % 13 = 0 THEN NULL ELSE a || '.' || coalesce(CASE WHEN b < 10 THEN '0' ELSE '' END || b, c) END AS v, dense_rank() OVER (ORDER BY k % 13 <> 0, CASE WHEN k % 13 <> 0 THEN a END, CASE WHEN k % 13 <> 0 THEN b IS NULL END, CASE WHEN k % 13 <> 0 THEN b END, CASE WHEN k % 13 <> 0 AND b IS NULL THEN c END) AS place,
  CASE WHEN k % 13 = 0 THEN NULL WHEN b IS NULL THEN c ELSE b::VARCHAR END AS last FROM p""")
def mixed_order(t):
    """Versions of numbers and letters in one order, null first."""
    k = F.col("p_partkey")
    last = F.when(k % 6 == 5, F.get(F.array(*map(F.lit, "abc")), (k % 3).cast("int"))).otherwise(F.lpad(text(k % 12), 2, "0"))
    v = F.when(k % 13 != 0, F.concat(text(F.col("p_size") % 10), F.lit("."), last))
    key = scalar.list_key(F.split("v", r"\."))
    # Places of the distinct versions, of which there are few, joined to the parts.
    parts = t.part.select(k.alias("k"), v.alias("v"))
    places = parts.select("v").distinct().select(F.col("v").alias("of"), F.dense_rank().over(Window.orderBy(key)).alias("place"))
    return parts.join(places, F.col("v").eqNullSafe(F.col("of"))).select("k", "v", "place", scalar.int_or_text(F.get(F.split("v", r"\."), F.lit(1))).alias("last"))


# --- null privilege lists, quoted values, sides of names, listings with flags ------------------------------------------------


@query("""WITH a AS (SELECT c_custkey AS k, 'u' || c_nationkey AS o, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE 'x' END AS acl FROM customer WHERE c_custkey % 7 <> 3)
SELECT k, o AS grantee, o AS grantor, unnest(['r', 'w']) AS priv, unnest([FALSE, TRUE]) AS with_grant FROM a WHERE acl IS NULL UNION ALL SELECT k, 'public', o, 'U', FALSE FROM a WHERE acl IS NULL UNION ALL SELECT k, 'g', o, 'X', TRUE FROM a WHERE acl = 'x'""")
def acl_null_lists(t):
    """Privileges of lists of which some are null (the usual ones of the owner and of all hold) and some empty (nobody has any)."""
    k = F.col("c_custkey")
    owner = F.concat(F.lit("u"), text("c_nationkey"))
    lists = t.customer.filter(k % 7 != 3).select(k.alias("k"), owner.alias("o"), F.when(k % 4 == 1, "{}").when(k % 4 > 1, F.concat(F.lit("{g=X*/"), owner, F.lit("}"))).alias("acl"))
    return macros.grants(lists, "acl", "k", owner="o", own="rw*", public="U").select("k", "grantee", "grantor", "priv", "with_grant")


@query("SELECT p_partkey AS k, p_name AS name, p_type || ',' || p_brand AS kind, CAST(NULL AS VARCHAR) AS missing FROM part")
def key_values_quoted(t):
    told = macros.key_values(F.concat(F.lit("name="), "p_name", F.lit(',kind="'), "p_type", F.lit(","), "p_brand", F.lit('",')))
    return t.part.select(F.col("p_partkey").alias("k"), told.alias("m")).select("k", *(F.try_element_at("m", F.lit(n)).alias(n) for n in ("name", "kind", "missing")))


@query("""WITH o AS (SELECT 'part.' || p_partkey AS fqn, 'kind.' || (p_partkey % 50) AS pqn, CASE WHEN p_partkey % 3 = 0 THEN 'drop' ELSE 'build' END AS side FROM part),
e AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'part.' || s_suppkey WHEN 1 THEN 'kind.' || (s_suppkey % 60) ELSE 'nothing' END AS to_qn, CASE WHEN s_suppkey % 2 = 0 THEN 'drop' ELSE 'build' END AS side FROM supplier)
SELECT k, to_qn, side, coalesce((SELECT min(fqn) FROM o WHERE fqn = to_qn), (SELECT min(fqn) FROM o WHERE pqn = to_qn AND o.side = e.side), (SELECT min(fqn) FROM o WHERE pqn = to_qn)) AS to_fqn FROM e""")
def dep_resolve_side(t):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    named = t.part.select(F.concat(F.lit("part."), text(p)).alias("fqn"), F.concat(F.lit("kind."), text(p % 50)).alias("pqn"), F.when(p % 3 == 0, "drop").otherwise("build").alias("side"))
    asked = F.when(s % 3 == 0, F.concat(F.lit("part."), text(s))).when(s % 3 == 1, F.concat(F.lit("kind."), text(s % 60))).otherwise("nothing")
    return graph.resolved_on_side(t.supplier.select(s.alias("k"), asked.alias("to_qn"), F.when(s % 2 == 0, "drop").otherwise("build").alias("side")), named).select("k", "to_qn", "side", "to_fqn")


@query("""WITH o AS (SELECT s_suppkey AS k, 'u' || s_nationkey AS u, 's' || (s_suppkey % 10) AS s, s_suppkey % 4 = 0 AS said FROM supplier WHERE s_suppkey % 9 <> 0),
g AS (SELECT DISTINCT 'grant.s' || (c_custkey % 10) || '.' || CASE WHEN c_custkey % 3 = 0 THEN 'create' ELSE 'usage' END || ':' || CASE WHEN c_custkey % 110 = 7 THEN 'public' ELSE 'u' || c_nationkey END AS fqn FROM customer WHERE c_custkey % 4 = 3 UNION SELECT 'privilege.role.u' || n_nationkey || '.superuser' FROM nation WHERE n_nationkey % 6 = 0),
x AS (SELECT k, u, s, unnest([{'a': 'forwards', 'r': 'create', 'c': FALSE}, {'a': 'backwards', 'r': 'usage', 'c': FALSE}, {'a': 'forwards', 'r': 'usage', 'c': TRUE}]) AS n, said FROM o),
y AS (SELECT k, n.a AS applies, n.r AS r, 'grant.' || s || '.' || n.r || ':' AS b, u, 'privilege.role.' || u || '.superuser' AS f FROM x WHERE said OR NOT n.c)
SELECT k AS node, applies, CASE WHEN b || u IN (SELECT fqn FROM g) THEN b || u WHEN b || 'public' IN (SELECT fqn FROM g) THEN b || 'public' ELSE f END AS to_fqn, b || u NOT IN (SELECT fqn FROM g) AND b || 'public' NOT IN (SELECT fqn FROM g) AND f NOT IN (SELECT fqn FROM g) AS by_fallback FROM y""")
def depset_usage(t):
    """What owners must be allowed to do in their objects' schemas: by a grant that exists, or by a fallback that sets share."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    kinds = t.supplier.filter(k % 9 != 0).select(k.alias("fqn"), F.concat(F.lit("u"), text("s_nationkey")).alias("owner"), F.concat(F.lit("s"), text(k % 10)).alias("schema"), F.when(k % 4 == 0, "said").alias("comment"))
    given = F.concat(F.lit("grant.s"), text(c % 10), F.lit("."), F.when(c % 3 == 0, "create").otherwise("usage"), F.lit(":"), F.when(c % 110 == 7, "public").otherwise(F.concat(F.lit("u"), text("c_nationkey"))))
    there = t.customer.filter(c % 4 == 3).select(given.alias("fqn")).unionByName(t.nation.filter("n_nationkey % 6 = 0").select(F.concat(F.lit("privilege.role.u"), text("n_nationkey"), F.lit(".superuser")).alias("fqn")))
    sets = edges.usage_sets(kinds, comment="comment")
    found = graph.chosen_alternatives(sets, there)
    unmet = sets.join(found.select("depset_id"), "depset_id", "left_anti").groupBy("depset_id", "node", "applies", "fallback").agg(F.sort_array(F.collect_set("to_fqn")).alias("names"))
    by = depsets.shared_fallbacks(unmet.select("depset_id", F.col("applies").alias("side"), F.lit(None).cast("int").alias("priority"), "names", "fallback"))
    made = unmet.drop("fallback").join(by, "depset_id").select("node", "applies", F.col("fallback").alias("to_fqn"), F.lit(True).alias("by_fallback"))
    return found.select("node", "applies", "to_fqn", F.lit(False).alias("by_fallback")).unionByName(made)


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
x AS (SELECT o_custkey AS c, k, n, q, s, k % 9 <> 0 AS o_was, k % 10 <> 0 AS o_is, (k + n) % 6 <> 0 AS l_was, (k + n) % 7 <> 0 AS l_is, k % 4 = 0 AS other FROM l JOIN orders ON o_orderkey = k),
e AS (SELECT c, k, n, CASE WHEN NOT (o_was AND l_was) THEN 'new' WHEN NOT (o_is AND l_is) THEN 'gone' WHEN other THEN 'diff' ELSE 'none' END AS status FROM x WHERE (o_was AND l_was) OR (o_is AND l_is)),
o AS (SELECT c, k, bool_or(o_was AND l_was) AS was, bool_or(o_is AND l_is) AS is_ FROM x GROUP BY 1, 2 HAVING was OR is_),
os AS (SELECT o.c, o.k, CASE WHEN NOT was THEN 'new' WHEN NOT is_ THEN 'gone' WHEN (SELECT bool_or(status <> 'none') FROM e WHERE e.k = o.k) THEN 'diff' ELSE 'none' END AS status FROM o),
cs AS (SELECT c, bool_or(was) AS was, bool_or(is_) AS is_ FROM o GROUP BY c)
SELECT c, '' AS path, '' AS element, CASE WHEN NOT was THEN 'new' WHEN NOT is_ THEN 'gone' WHEN (SELECT bool_or(status <> 'none') FROM os WHERE os.c = cs.c) THEN 'diff' ELSE 'none' END AS status FROM cs
UNION ALL SELECT c, 'orders', k::VARCHAR, status FROM os UNION ALL SELECT c, 'orders.lines', k || '/' || n, status FROM e""")
def diff_deep_elements(t):
    """Customers with their orders with their lines, as elements within elements."""
    k, n = F.col("k"), F.col("n")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"))
    lines = lines.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "k")
    nest = lambda d: d.groupBy("c", "k").agg(F.collect_list(F.struct("n", "q")).alias("lines")).groupBy("c").agg(F.collect_list(F.struct("k", "lines")).alias("orders"))
    old = nest(lines.filter((k % 9 != 0) & ((k + n) % 6 != 0)))
    new = nest(lines.filter((k % 10 != 0) & ((k + n) % 7 != 0)).withColumn("q", F.col("q") + F.when(k % 4 == 0, 1).otherwise(0)))
    rule = diff.Rule(key=("c",), elements={"orders": diff.Rule(key=("k",), elements={"lines": diff.Rule(key=("n",), attributes=(diff.Attribute("q"),))})})
    return diff.deep_statuses(old, new, rule).select("c", "path", F.array_join("element", "/").alias("element"), "status")


# --- rules that rebuild, headers, contexts, listings of files, lateral functions ---------------------------------------------


@query(f"{_SNAPSHOTS} SELECT coalesce(a.k,b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.s IS DISTINCT FROM b.s THEN 'rebuild' ELSE 'none' END AS status FROM a FULL OUTER JOIN b ON a.k=b.k")
def diff_rule_rebuild(t):
    return diff.statuses(*snapshots(t), diff.Rule(key=("k",), attributes=(diff.Attribute("s"),), rebuild=True))


@query("SELECT 'db' || (SELECT count(*) FROM orders) AS dbname, (SELECT max(o_orderdate) FROM orders) AS time, 'x' || (SELECT count(*) FROM customer) AS dbname2, (SELECT min(o_orderdate) FROM orders) AS time2")
def diff_header(t):
    new = t.orders.agg(F.concat(F.lit("db"), text(F.count("*"))).alias("dbname"), F.max("o_orderdate").alias("time"))
    old = t.orders.agg(F.concat(F.lit("x"), text(F.lit(t.customer.count()))).alias("dbname"), F.min("o_orderdate").alias("time"))
    return diff.merged_header(old, new)


@query("SELECT o_orderkey AS node, o_orderstatus AS context, 'backwards' AS applies FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, 'forwards' FROM orders WHERE o_orderkey % 5 <> 0")
def diff_context_merge(t):
    k = F.col("o_orderkey")
    told = lambda keep, value: t.orders.filter(keep).select(k.alias("node"), value.alias("context"))
    return diff.both_sides(told(k % 7 != 0, F.col("o_orderstatus")), told(k % 5 != 0, F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))))


@query(f"{_BUILDS}, x AS (SELECT unnest(CASE build_type WHEN 'rebuild' THEN ['drop','build'] WHEN 'diff' THEN ['diffprep','diff'] ELSE [build_type] END) AS action, build_type FROM t) SELECT CASE build_type WHEN 'rebuild' THEN action ELSE build_type END AS build_type, action, count(*) AS n FROM x GROUP BY 1, 2")
def build_relabelled(t):
    return graph.finalised(graph.build_actions(diff_status(t))).groupBy("build_type", "action").agg(F.count("*").alias("n"))


_CONTEXTS = """WITH w AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS t, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders),
m AS (SELECT c, k, 'depart' AS move, f AS context_of FROM w WHERE f IS DISTINCT FROM t AND f <> 'O' UNION ALL SELECT c, k, 'arrive', t FROM w WHERE f IS DISTINCT FROM t AND t <> 'O')"""


def context_moves(t) -> DataFrame:
    return navigation.context_moves(t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), "o_orderstatus"), "o_orderstatus", ["k"], ["c"], "O")


@query(f"{_CONTEXTS} SELECT c, k, move, context_of FROM m")
def nav_context_moves(t):
    return context_moves(t).select("c", "k", "move", "context_of")


@query(rf"""{_CONTEXTS} SELECT c, k, CASE move WHEN 'arrive' THEN 'set session authorization ' || chr(39) || context_of || chr(39) || ';' ELSE 'reset session authorization;' END AS line FROM m
UNION ALL SELECT -1, n_nationkey, '\connect ' || lower(n_name) FROM nation WHERE regexp_matches(n_name, '^[A-Za-z][A-Za-z0-9_]*$') AND n_nationkey % 2 = 0""")
def nav_texts(t):
    owners = context_moves(t).select("c", "k", render.navigation(F.col("move"), F.lit("owner"), F.col("context_of")).alias("line"))
    nations = t.nation.filter(F.col("n_name").rlike("^[A-Za-z][A-Za-z0-9_]*$")).select(F.lit(-1).cast(t.orders.schema["o_custkey"].dataType).alias("c"), F.col("n_nationkey").cast(t.orders.schema["o_orderkey"].dataType).alias("k"), render.navigation(F.when(F.col("n_nationkey") % 2 == 0, "arrive").otherwise("depart"), F.lit("database"), F.lower("n_name")).alias("line"))
    return owners.unionByName(nations.filter("line is not null"))


@query("SELECT c_mktsegment AS folder, TRUE AS filled FROM customer GROUP BY 1")
def file_listing(t):
    """The folders of customers by segment, found by a listing of files of one pattern."""
    path = folder(t)
    repository.scatter(t.customer.select("c_custkey", F.col("c_mktsegment").alias("type")), path)
    found = repository.listing(t.spark, path, "*.parquet")
    return found.groupBy(F.regexp_extract("path", "/type=([^/]*)/", 1).alias("folder")).agg((F.sum("length") > 0).alias("filled"))


@query("SELECT p_brand, p_type, count(*) > 1 AS several, string_agg(p_name, '|' ORDER BY p_partkey) AS texts FROM part GROUP BY 1, 2")
def overload_groups(t):
    return macros.overloads(t.part, ["p_brand", "p_type"], "p_name", ["p_partkey"]).withColumn("texts", F.array_join("texts", "|"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey AND r_name <> 'ASIA' AND c_acctbal > n_nationkey * 100 AND (r_name <> 'EUROPE' OR n_nationkey % 2 = 0)")
def left_join_compound(t):
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    on = (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("r_name") != "ASIA") & (F.col("c_acctbal") > F.col("n_nationkey") * 100) & ((F.col("r_name") != "EUROPE") | (F.col("n_nationkey") % 2 == 0))
    return t.customer.join(both, on, "left").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey, x.n FROM orders, LATERAL (SELECT unnest(range(CAST(0 AS BIGINT), o_orderkey % 4)) AS n) x")
def lateral_function(t):
    """A table function of each row's value in FROM."""
    up = F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey").outer() % 4 - 1)
    return t.orders.filter(F.col("o_orderkey") % 4 > 0).lateralJoin(t.spark.tvf.explode(up)).select("o_orderkey", F.col("col").alias("n"))


@query("SELECT p_partkey, e.k AS key, e.v AS value, 3 AS n FROM (SELECT p_partkey, unnest([{'k': 'brand', 'v': p_brand}, {'k': 'name', 'v': p_name}, {'k': 'type', 'v': p_type}]) AS e FROM part)")
def map_each(t):
    """Entries of a map one by one, and their number."""
    told = t.part.select("p_partkey", F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("m"))
    return told.select("p_partkey", F.size("m").alias("n"), F.explode("m").alias("key", "value"))


@query("""WITH a AS (SELECT o_custkey % 50 AS g, o_orderkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT g, k, CASE WHEN g % 7 = 3 AND k % 11 = 5 THEN 'X' ELSE s END AS s FROM a UNION ALL SELECT g, k, s FROM a WHERE g % 10 = 4 AND k % 2 = 0),
d AS (SELECT * FROM (SELECT g, k, s FROM a EXCEPT ALL SELECT g, k, s FROM b) UNION ALL SELECT * FROM (SELECT g, k, s FROM b EXCEPT ALL SELECT g, k, s FROM a))
SELECT g, count(*) AS rows, g NOT IN (SELECT g FROM d) AS same FROM a GROUP BY g""")
def snapshot_compare(t):
    """Groups of rows of two snapshots, in whatever order, compared by one hash a group."""
    g, k = F.col("g"), F.col("k")
    a = t.orders.select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = a.withColumn("s", F.when((g % 7 == 3) & (k % 11 == 5), "X").otherwise(F.col("s"))).unionByName(a.filter((g % 10 == 4) & (k % 2 == 0)))
    was, now = repository.snapshot_hashes(a, ["g"]), repository.snapshot_hashes(b, ["g"]).select("g", F.col("hash").alias("other"))
    return was.join(now, "g").select("g", "rows", (F.col("hash") == F.col("other")).alias("same"))


@query(_CANDIDATES.split("best AS")[0].rstrip().rstrip(",") + " SELECT depset_id, count(*) AS options, count_if(to_fqn IN (SELECT fqn FROM x)) AS selectable FROM c GROUP BY depset_id")
def depset_selectable(t):
    candidates, there = alternatives(t)
    return depsets.selectable(candidates.select("depset_id", F.col("to_fqn").alias("name")), there)
