"""Record queries: what SQL over user tables must be able to say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalode.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _money(c):
    """Sums of doubles depend on their order; cents do not."""
    return F.round(c * 100).cast("long")


@_add("rec_filter_project", "SELECT o_orderkey, o_totalprice * 2 AS double_price, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'")
def _filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000) & (F.col("o_orderpriority") != "5-LOW"))
    return o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("double_price"), F.col("o_orderpriority").alias("priority"))


@_add("rec_or_in_between", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') OR p_size BETWEEN 10 AND 12")
def _or(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#2") | F.col("p_size").between(10, 12)).select("p_partkey", "p_brand")


@_add("rec_join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def _inner(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@_add("rec_join_left", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _left(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")


@_add("rec_join_right_full", "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _full(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "full").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@_add("rec_join_two_ends", "SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey WHERE l_quantity > 45")
def _ends(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return line.join(p, line["l_partkey"] == p["p_partkey"], "left").join(s, line["l_suppkey"] == s["s_suppkey"], "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@_add("rec_join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def _semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 250000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@_add("rec_join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@_add("rec_join_composite", "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def _composite(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "next_role")


@_add(
    "rec_group",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum_cents, min(l_discount) AS min_discount, max(l_tax) AS max_tax
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def _group(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(_money(F.col("l_extendedprice"))).alias("sum_cents"), F.min("l_discount").alias("min_discount"), F.max("l_tax").alias("max_tax"))


@_add("rec_aggregates", "SELECT coalesce(sum(n_chars), 0)::BIGINT AS total, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean, count(DISTINCT lang) AS langs FROM documents WHERE source = 'src1'")
def _aggregates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source = 'src1'")
    return d.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 6).alias("mean"), F.countDistinct("lang").alias("langs"))


@_add("rec_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@_add("rec_group_concat", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def _concat(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@_add("rec_distinct", "SELECT DISTINCT lang, source FROM documents")
def _distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@_add("rec_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@_add("rec_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 30")
def _offset(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(30).limit(10)


@_add("rec_truncated_list", "SELECT count(*) AS listed, (SELECT count(*) FROM supplier) > 10 AS truncated FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10)")
def _truncated(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").limit(11)  # one more than is shown
    return s.agg(F.least(F.count("*"), F.lit(10)).alias("listed"), (F.count("*") > 10).alias("truncated"))


@_add("rec_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def _case(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "F", "done").when(s == "O", "open").otherwise("other").alias("state"))


@_add("rec_is_null", "SELECT count(*) AS without_label FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def _null(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").filter(F.col("quality").isNull()).agg(F.count("*").alias("without_label"))


@_add("rec_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_type LIKE 'ECO%'")
def _like(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%RING%") | F.col("p_type").like("ECO%")).select("p_partkey", "p_name")


@_add("rec_scalars", "SELECT doc_id, length(text) AS chars, strlen(text) AS n_bytes, lower(substr(text, 1, 12)) AS head, upper(hex(encode(substr(text, 1, 4)))) AS head_hex, lang || ':' || source AS tag FROM documents")
def _scalars(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("n_bytes"), F.lower(F.substring("text", 1, 12)).alias("head"), F.hex(F.substring("text", 1, 4)).alias("head_hex"), F.concat_ws(":", "lang", "source").alias("tag"))


@_add("rec_json_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'error'")
def _json(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_add("rec_scalar_subquery", "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def _subquery(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    zero = F.lit(0)
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("c", zero).alias("customers"), F.coalesce("s", zero).alias("suppliers"))


def _quality(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The labels, and a row for every document to put into them."""
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return old, table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 10).cast(old.schema["quality"].dataType).alias("quality"))


@_add("rec_upsert", "SELECT doc_id, (n_chars % 10)::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _upsert(spark, sf_dir):
    old, new = _quality(spark, sf_dir)
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


@_add("rec_insert_ignore", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, (n_chars % 10)::INTEGER FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _ignore(spark, sf_dir):
    old, new = _quality(spark, sf_dir)
    return old.unionByName(new.join(old.select("doc_id"), "doc_id", "left_anti"))


@_add("rec_sequence", "SELECT n_nationkey, (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_nationkey) AS created_order FROM nation")
def _sequence(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    top = table(spark, sf_dir, "region").agg(F.max("r_regionkey").alias("top"))
    return n.crossJoin(F.broadcast(top)).select("n_nationkey", (F.col("top") + F.row_number().over(Window.orderBy("n_nationkey"))).cast("long").alias("created_order"))  # 25 nations


for _name, _op in (("union", "union"), ("intersect", "intersect"), ("except", "subtract")):

    def _set(spark, sf_dir, op=_op):
        c, s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
        out = getattr(c, op)(s)
        return out.distinct() if op == "union" else out

    QUERIES[f"rec_{_name}"] = _set
    SQL[f"rec_{_name}"] = f"SELECT c_custkey AS k FROM customer {_name.upper()} SELECT s_suppkey FROM supplier"


@_add("rec_window_rank", "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3")
def _rank(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")


@_add("rec_window_running", "SELECT o_custkey, o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS running FROM orders")
def _running(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(_money(F.col("o_totalprice"))).over(w).alias("running"))


@_add("rec_catalog", "SELECT column_name AS name FROM information_schema.columns WHERE table_name = 'lineitem'")
def _catalog(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in table(spark, sf_dir, "lineitem").columns], "name string")


@_add("rec_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def _point(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_orderstatus")


@_add("rec_range_overlap", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 5 > 20 AND l_quantity < 22")
def _overlap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity + 5 > 20 AND l_quantity < 22").select("l_orderkey", "l_linenumber")


@_add("rec_sql_params", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def _params(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("strata_customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM strata_customer WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "BUILDING", "least": 5000})


@_add("rec_fts_match", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'idiot') AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the')")
def _fts(spark, sf_dir):
    """Documents with all query words, through an inverted index (word, doc_id)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("word"))
    hits = d.filter(F.col("word").isin("idiot", "the")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return hits.filter("n = 2").select("doc_id")


@_add("rec_regex_dates", "SELECT event_id, year(ts) AS y, month(ts) AS m, date_trunc('hour', ts)::TIMESTAMP AS h, round(abs(value), 2) AS v FROM events WHERE regexp_matches(event_type, '^(error|click)$') AND value <> 0")
def _dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").rlike("^(error|click)$") & (F.col("value") != 0))
    return e.select("event_id", F.year("ts").cast("long").alias("y"), F.month("ts").cast("long").alias("m"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), F.round(F.abs("value"), 2).alias("v"))


@_add("rec_filtered_counts", "SELECT event_type, count(*) FILTER (value > 5) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _filtered(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 5).alias("high"), F.countDistinct("user_id").alias("users"))


@_add("rec_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def _rollup(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("customers"))


@_add("rec_theta_join", "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey")
def _theta(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("b.s_acctbal") > F.col("a.s_acctbal"))).groupBy(F.col("a.s_suppkey").alias("s_suppkey")).agg(F.count("*").alias("richer"))


@_add("rec_generated_column", "SELECT doc_id, length(text) AS text_len, length(text) * 2 + 1 AS odd FROM documents")
def _generated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text_len", F.length("text").cast("long"))
    return d.select("doc_id", "text_len", (F.col("text_len") * 2 + 1).alias("odd"))
