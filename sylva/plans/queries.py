"""Registered queries of the tree engine, each with its SQL.

Documents are built from the star schema inside each query (an order with its lines, a nation with its customers and suppliers) or
are the raw pages; the SQL computes the same answer without trees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions import uri as U
from ..operators import axes, select
from ..sources.documents import shred, state_of, store
from . import xpath as X
from . import xpath_plan as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(form: str, *values) -> Column:
    """A text with a value for each %, "null" for none; compiled, which format_string is not."""
    parts = form.split("%")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null")), F.lit(p))])


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: an order element with a lineitem for each line, in the order of line numbers."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        _filled('<lineitem n="%" flag="%"><qty>%</qty><part>%</part><supp>%</supp></lineitem>', "l_linenumber", "l_returnflag", F.col("l_quantity").cast("long"), "l_partkey", "l_suppkey").alias("x"),
    )
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "x"))).getField("x"), "").alias("b"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    joined = orders.join(body, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.concat(_filled('<order key="%" status="%">', "o_orderkey", "o_orderstatus"), F.coalesce("b", F.lit("")), F.lit("</order>")).alias("text"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' nodes, parsed once and stored, as axes join them with themselves; as long as the tables stay the same, all queries share them."""
    return store(shred(order_docs(spark, sf_dir)), ("orders", *state_of(spark, *(f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem")))))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation: nation > group(segment) > customer(key, segment) with the balance as text."""
    c = table(spark, sf_dir, "customer")
    one = F.format_string('<customer key="%d"><bal>%d</bal></customer>', "c_custkey", F.floor("c_acctbal").cast("long"))
    groups = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("x")))), lambda v: v["x"]), "").alias("b"))
    groups = groups.select("c_nationkey", "c_mktsegment", F.format_string('<group name="%s">%s</group>', "c_mktsegment", "b").alias("g"))
    body = groups.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "g"))), lambda v: v["g"]), "").alias("b"))
    joined = table(spark, sf_dir, "nation").join(body, F.col("n_nationkey") == F.col("c_nationkey"), "left").repartition(32, "n_nationkey")  # few large documents, each a task's work
    return shred(joined.select(F.col("n_nationkey").alias("doc_id"), F.concat(F.format_string('<nation key="%d" name="%s">', "n_nationkey", "n_name"), F.coalesce("b", F.lit("")), F.lit("</nation>")).alias("text")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(table(spark, sf_dir, "pages"), text="html", doc_id="page_id", parse_html=True, warnings=False)


# pages


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n FROM pages WHERE len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) > 0")
def html_links(spark, sf_dir):
    found = select.attr_value0(select.multi(pages(spark, sf_dir), select.is_kind("element") & select.has_name("a")), "href")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_hrefs(spark, sf_dir):
    return select.attr_value0(select.multi(pages(spark, sf_dir), select.has_name("a")), "href", "href").select("doc_id", "href")


@query("SELECT page_id AS doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def html_lang(spark, sf_dir):
    return select.attr_value0(pages(spark, sf_dir).where(select.has_name("html")), "lang", "lang").select("doc_id", "lang")


@query("SELECT t.name, sum(len(regexp_extract_all(html, '<' || t.name || '[ >]')))::BIGINT AS n FROM pages, (SELECT unnest(['a','li','ul','nav','article','h1','footer','title','p','b','br']) AS name) t GROUP BY t.name")
def html_tag_counts(spark, sf_dir):
    names = ["a", "li", "ul", "nav", "article", "h1", "footer", "title", "p", "b", "br"]
    return pages(spark, sf_dir).where(select.is_kind("element") & F.col("name").isin(names)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id AS doc_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">')) FROM pages) GROUP BY page_id")
def html_list_links(spark, sf_dir):
    return P.compile(pages(spark, sf_dir), "//nav/ul/li/a/@href").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def uri_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.protocol(u).alias("protocol"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x/y.html' AS a, regexp_replace(url, '#.*$', '') || '#z' AS b, regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || 'q.html' AS c FROM pages")
def uri_expand(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.expand(F.lit("/x/y.html"), u).alias("a"), U.expand(F.lit("#z"), u).alias("b"), U.expand(F.lit("q.html"), u).alias("c"))


# axes, on orders: the number of (context, node) pairs by document

_LINES = "SELECT o_orderkey AS doc_id, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


def _axis_count(name: str, context: str, test: str):
    def run(spark, sf_dir):
        nodes = orders(spark, sf_dir)
        found = axes.axis(nodes.where(context), nodes, name, F.expr(test), positions=False)
        return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

    return run


for _name, _ctx, _test, _sql in (
    ("child", "name = 'order'", "kind = 'element'", "k"),
    ("parent", "name = 'lineitem'", "name = 'order'", "k"),
    ("descendant", "name = 'order'", "kind = 'element'", "k * 4"),
    ("descendant-or-self", "name = 'order'", "kind = 'element'", "k * 4 + 1"),
    ("ancestor", "name = 'qty'", "kind = 'element'", "k * 2"),
    ("ancestor-or-self", "name = 'qty'", "kind = 'element'", "k * 3"),
    ("following-sibling", "name = 'lineitem'", "name = 'lineitem'", "k * (k - 1) // 2"),
    ("preceding-sibling", "name = 'lineitem'", "name = 'lineitem'", "k * (k - 1) // 2"),
    ("following", "name = 'qty'", "name = 'part'", "k * (k + 1) // 2"),
    ("preceding", "name = 'part'", "name = 'qty'", "k * (k + 1) // 2"),
    ("self", "name = 'qty'", "name = 'qty'", "k"),
    ("attribute", "name = 'lineitem'", "kind = 'attr'", "k * 2"),
    ("descendant-or-following", "name = 'qty'", "name = 'qty'", "k * (k - 1) // 2"),
    ("rev-descendant-or-self", "name = 'lineitem'", "kind = 'element'", "k * 4"),
):
    query(f"SELECT doc_id, {_sql} AS n FROM ({_LINES}) WHERE {_sql} > 0", "axis_" + _name.replace("-", "_"))(_axis_count(_name, _ctx, _test))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next FROM lineitem QUALIFY next IS NOT NULL")
def move_right(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    own = nodes.where("name = 'lineitem'").withColumn("c_ctx", F.col("attrs")["n"].cast("int"))
    return axes.move(own, nodes, "right").select("doc_id", F.col("c_ctx").alias("n"), F.col("attrs")["n"].cast("int").alias("next"))


# XPath by joins and windows


def _path_values(path: str, as_: str = "n"):
    def run(spark, sf_dir):
        return P.compile(shred(order_docs(spark, sf_dir)), path).select("doc_id", F.col("value").cast("int").alias(as_))

    return run


for _name, _path, _sql in (
    ("position", "/order/lineitem[1]/@n", "SELECT l_orderkey AS doc_id, min(l_linenumber) AS n FROM lineitem GROUP BY 1"),
    ("last", "/order/lineitem[last()]/@n", "SELECT l_orderkey AS doc_id, max(l_linenumber) AS n FROM lineitem GROUP BY 1"),
    ("range", "/order/lineitem[position() > 1 and position() < 4]/@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) BETWEEN 2 AND 3"),
    ("pred_num", "//lineitem[qty > 25]/@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_quantity > 25"),
    ("pred_attr", "//lineitem[@flag = 'R']/@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'"),
    ("not", "//lineitem[not(@flag = 'R')]/@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R'"),
    ("or", "//lineitem[@flag = 'R' or qty < 5]/@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' OR l_quantity < 5"),
    ("pred_chain", "/order/lineitem[@flag = 'N'][1]/@n", "SELECT l_orderkey AS doc_id, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1"),
    ("nodeset_eq", "//lineitem[qty = part]/@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_quantity = l_partkey"),
    ("count_pred", "/order[count(lineitem) > 3]/@key", "SELECT l_orderkey AS doc_id, l_orderkey::INT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 3"),
    ("sibling", "//lineitem[following-sibling::lineitem[@flag = 'R']]/@n", "SELECT a.l_orderkey AS doc_id, a.l_linenumber AS n FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND (b.l_linenumber, printf('%s\"><qty>%d</qty><part>%d<', b.l_returnflag, b.l_quantity::BIGINT, b.l_partkey)) > (a.l_linenumber, printf('%s\"><qty>%d</qty><part>%d<', a.l_returnflag, a.l_quantity::BIGINT, a.l_partkey)) AND b.l_returnflag = 'R')"),
    ("parent_step", "//qty[. > 45]/../@n", "SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_quantity > 45"),
):
    query(_sql, f"xpath_{_name}")(_path_values(_path))


@query(f"SELECT doc_id, k AS n FROM ({_LINES})")
def xpath_count(spark, sf_dir):
    return P.count(shred(order_docs(spark, sf_dir)), "//lineitem")


@query("SELECT o_orderkey AS doc_id, coalesce(sum(l_quantity), 'NaN'::DOUBLE) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def xpath_sum(spark, sf_dir):
    return P.sum_(orders(spark, sf_dir), "//lineitem/qty")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
def xpath_union(spark, sf_dir):
    return P.compile(shred(order_docs(spark, sf_dir)), "//lineitem[@flag = 'R']/@n | //lineitem[qty > 40]/@n").select("doc_id", F.col("value").cast("int").alias("n")).distinct()


@query("SELECT n_nationkey AS doc_id, 'Customers: ' || count(c_custkey) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def xpath_value(spark, sf_dir):
    return X.xpath(nations(spark, sf_dir), "concat('Customers: ', count(//customer))").select(F.col("doc_id").cast("int"), "value")


@query("SELECT n_nationkey AS doc_id, c_custkey AS key FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE floor(c_acctbal) > 9000")
def xpath_tree(spark, sf_dir):
    return X.xpath(nations(spark, sf_dir), "//customer[bal > 9000]/@key").select(F.col("doc_id").cast("int"), F.col("value").cast("long").alias("key"))


# selection


@query("SELECT DISTINCT c_nationkey AS doc_id, c_mktsegment AS name FROM customer")
def select_deep(spark, sf_dir):
    return select.deep(nations(spark, sf_dir), F.col("name").isin("group", "customer")).select(F.col("doc_id").cast("int"), F.col("attrs")["name"].alias("name"))


@query("SELECT c_nationkey AS doc_id, count(*) AS n FROM customer GROUP BY 1")
def select_deepest(spark, sf_dir):
    return select.deepest(nations(spark, sf_dir), F.col("name").isin("nation", "group", "customer")).where("name = 'customer'").groupBy(F.col("doc_id").cast("int").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS doc_id, count(*) + count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def select_multi(spark, sf_dir):
    return select.multi(nations(spark, sf_dir), F.col("name").isin("group", "customer")).groupBy(F.col("doc_id").cast("int").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1")
def select_deep_below(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    return select.deep_below(nodes.where("level = 0"), nodes, F.col("name").isin("lineitem", "qty")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_returnflag = 'R'")
def select_having_child(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    return select.having_child(nodes.where("name = 'order'"), nodes, (F.col("name") == "lineitem") & (F.col("attrs")["flag"] == "R")).select("doc_id")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem WHERE l_quantity > 40")
def semi_containing(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    big = nodes.where("kind = 'text' and cast(value as int) > 40")
    qty = axes.axis(big, nodes, "parent", F.col("name") == "qty", positions=False)
    items = axes.axis(qty.select(*nodes.columns), nodes, "parent", positions=False)
    return select.containing(nodes.where("name = 'lineitem'"), items).select("doc_id", F.col("attrs")["n"].cast("int").alias("n"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_not_containing(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    hit = nodes.where("name = 'lineitem' and attrs['flag'] = 'R'").select("doc_id", F.col("parent_id").alias("node_id"))
    return select.not_containing(nodes.where("name = 'order'"), hit).select("doc_id")


@query("SELECT o_orderkey AS doc_id, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_returnflag = 'R')")
def or_else(spark, sf_dir):
    items = orders(spark, sf_dir).where("name = 'lineitem'").select("doc_id", F.col("attrs")["n"].cast("int").alias("n"), F.col("attrs")["flag"].alias("f"))
    return select.or_else(items.where("f = 'R'"), items.where("f = 'A'"), ["doc_id"]).select("doc_id", "n")


@query("SELECT o_orderkey AS doc_id, coalesce(l_linenumber, -1) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'")
def with_default(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    found = nodes.where("name = 'lineitem' and attrs['flag'] = 'R'").select("doc_id", F.col("attrs")["n"].cast("int").alias("n"))
    return select.with_default(nodes.where("name = 'order'"), found, ["doc_id"], "n", -1)


@query("SELECT l_orderkey AS doc_id, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def single_first(spark, sf_dir):
    nodes = orders(spark, sf_dir).where("name = 'lineitem' and attrs['flag'] = 'R'")
    return select.single(nodes, ["doc_id"], ["pre"]).select("doc_id", F.col("attrs")["n"].cast("int").alias("n"))


@query("SELECT o_orderkey AS doc_id, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def list_collect(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    items = nodes.where("name = 'lineitem'").select("doc_id", "pre", F.col("attrs")["n"].alias("v"))
    return select.list_a(nodes.where("name = 'order'").select("doc_id"), items, ["doc_id"], "pre", "v").select("doc_id", F.array_join("items", ",").alias("items"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) <= 2")
def list_sort_take(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    text = axes.string_value(nodes.where("name = 'qty'"), nodes, "q").join(nodes.select("doc_id", "node_id", "parent_id"), ["doc_id", "node_id"])
    items = nodes.where("name = 'lineitem'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("attrs")["n"].cast("int").alias("n")).join(text.select("doc_id", "parent_id", "q"), ["doc_id", "parent_id"])
    return select.take_n(items, ["doc_id"], [F.col("q").cast("int").desc(), F.col("n")], 2).select("doc_id", "n")


@query("SELECT c_nationkey AS doc_id, 6 AS depth, 2 + count(DISTINCT c_mktsegment) + 3 * count(*) AS card FROM customer GROUP BY 1")
def tree_stats(spark, sf_dir):
    return select.tree_stats(nations(spark, sf_dir)).select(F.col("doc_id").cast("int"), "depth", "card").where("card > 2")


@query("SELECT o_orderkey AS doc_id, CASE WHEN bool_or(coalesce(l_returnflag, '') = 'R') THEN 'returned' WHEN count(l_orderkey) > 0 THEN 'kept' ELSE 'empty' END AS what FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def choice(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    items = nodes.where("name = 'lineitem'")
    say = lambda s: lambda df: df.withColumn("what", F.lit(s))
    top = nodes.where("name = 'order'").select("doc_id")
    return select.choice(top, [(items.where("attrs['flag'] = 'R'"), say("returned")), (items, say("kept")), (top, say("empty"))], ["doc_id"])


@query("SELECT l_orderkey AS doc_id, sum(CASE WHEN l_returnflag <> 'R' THEN 7 ELSE 0 END)::BIGINT + 2 AS n FROM lineitem GROUP BY 1")
def remove_subtrees(spark, sf_dir):
    left = select.remove(orders(spark, sf_dir), (F.col("name") == "lineitem") & (F.col("attrs")["flag"] == "R"))
    return left.where("level = 0").select("doc_id", (F.col("size") + 1).alias("n")).join(orders(spark, sf_dir).where("name = 'lineitem'").select("doc_id").distinct(), "doc_id", "left_semi")


# XPath functions as columns

_FN = {
    "substring_before": (lambda s: S.substring_before(s, F.lit(" ")), "CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END"),
    "substring_after": (lambda s: S.substring_after(s, F.lit(" ")), "CASE WHEN contains(p_name, ' ') THEN substring(p_name, strpos(p_name, ' ') + 1) ELSE '' END"),
    "substring": (lambda s: S.substring(s, F.lit(2.4), F.lit(3.1)), "substring(p_name, 2, 3)"),
    "starts_with": (lambda s: S.starts_with(s, F.lit("p")), "starts_with(p_name, 'p')"),
    "contains": (lambda s: S.contains(s, F.lit("1")), "contains(p_name, '1')"),
    "string_length": (lambda s: S.string_length(s).cast("long"), "length(p_name)"),
    "normalize_space": (lambda s: S.normalize_space(F.concat(F.lit("  "), s, F.lit(" \n x "))), "trim(regexp_replace('  ' || p_name || chr(32) || chr(10) || ' x ', '[ \\t\\r\\n]+', ' ', 'g'))"),
    "translate": (lambda s: S.translate(s, "ab", "ba"), "replace(replace(p_name, 'a', 'b'), 'b', 'a')"),
    "concat": (lambda s: F.concat(s, F.lit("-"), s), "p_name || '-' || p_name"),
    "escape": (lambda s: S.escape_attr(F.concat(F.lit("<&'"), s)), "'&lt;&amp;&apos;' || p_name"),
}
for _name, (_f, _sql) in _FN.items():
    query(f"SELECT p_partkey, {_sql} AS v FROM part", f"fn_{_name}")(lambda spark, sf_dir, f=_f: table(spark, sf_dir, "part").select("p_partkey", f(F.col("p_name")).alias("v")))

_NUM = {
    "round": (S.round_, "floor(c_acctbal + 0.5)::DOUBLE"),
    "floor": (S.floor, "floor(c_acctbal)::DOUBLE"),
    "ceiling": (S.ceiling, "ceil(c_acctbal)::DOUBLE"),
    "mod": (lambda x: S.mod(S.floor(x), F.lit(7.0)) + 0.0, "(floor(c_acctbal) - 7 * trunc(floor(c_acctbal) / 7))::DOUBLE + 0.0"),
    "div": (lambda x: S.divide(x, F.lit(4.0)), "c_acctbal / 4.0"),
    "number": (lambda x: S.number(S.floor(x).cast("long").cast("string")), "floor(c_acctbal)::DOUBLE"),
    "string": (lambda x: S.string_of_number(S.floor(x)), "floor(c_acctbal)::BIGINT::VARCHAR"),
    "boolean": (lambda x: S.boolean_of_number(S.mod(S.floor(x), F.lit(2.0))), "floor(c_acctbal)::BIGINT % 2 <> 0"),
}
for _name, (_f, _sql) in _NUM.items():
    query(f"SELECT c_custkey, {_sql} AS v FROM customer", f"fn_{_name}")(lambda spark, sf_dir, f=_f: table(spark, sf_dir, "customer").select("c_custkey", f(F.col("c_acctbal")).alias("v")))


# regular expressions

from ..functions import datatypes as D  # noqa: E402
from ..functions import regex as R  # noqa: E402
from ..model import Node  # noqa: E402
from ..operators import codec as K  # noqa: E402
from ..operators import dtd as DTD  # noqa: E402
from ..operators import edit, rdf, rng, xsd, xslt  # noqa: E402
from ..sources import cache  # noqa: E402
from ..sources.documents import errors, rewrite, serialize, status  # noqa: E402


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z]+ [a-z0-9 ]*') AS v FROM part")
def regex_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.match_col(F.col("p_name"), "[a-z]+ [a-z0-9 ]*").alias("v"))


@query("SELECT p_partkey, regexp_full_match(p_name, '.*a.*') AND NOT regexp_full_match(p_name, '.*1.*') AS v FROM part")
def regex_difference(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.match_col(F.col("p_name"), r".*a.*{\}.*1.*").alias("v"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name || ' ' || p_type, '[a-zA-Z]+'), ',') AS v FROM part")
def regex_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.tokenize_col(F.concat_ws(" ", "p_name", "p_type"), "[a-zA-Z]+"), ",").alias("v"))


@query("SELECT p_partkey, regexp_replace(p_name, '[0-9]+', '#', 'g') AS v FROM part")
def regex_sed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.sed_col(F.col("p_name"), "[0-9]+", lambda t: "#").alias("v"))


@query("SELECT p_partkey, regexp_extract(p_name, '^[a-z]*') AS token, substring(p_name, length(regexp_extract(p_name, '^[a-z]*')) + 1) AS rest FROM part")
def regex_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.split_col(F.col("p_name"), "[a-z]*").alias("x")).select("p_partkey", "x.*")


@query("SELECT doc_id, n::INT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(line, '^The .*\\.$')")
def regex_grep(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.grep_col(F.col("text"), r"^The .*\.$")).alias("x"))
    return found.select("doc_id", "x.n")


@query("SELECT p_partkey, regexp_extract(p_brand, '^([A-Za-z]+)#', 1) AS word, regexp_extract(p_brand, '#([0-9]+)$', 1) AS num FROM part")
def regex_subex(spark, sf_dir):
    m = R.subex_col(F.col("p_brand"), "({w}[A-Za-z]+)#({n}[0-9]+)")
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.coalesce(F.try_element_at("m", F.lit("w")), F.lit("")).alias("word"), F.coalesce(F.try_element_at("m", F.lit("n")), F.lit("")).alias("num"))


# datatypes

_TYPED = {
    "byte": ("customer", "c_custkey", "floor(c_acctbal)::BIGINT::VARCHAR", lambda: D.check_col(F.floor("c_acctbal").cast("string"), "byte"), "floor(c_acctbal) BETWEEN -128 AND 127"),
    "decimal": ("customer", "c_custkey", "", lambda: D.check_col(F.format_string("%.2f", "c_acctbal"), "decimal", minInclusive=0, fractionDigits=1), "c_acctbal >= 0 AND printf('%.2f', c_acctbal) LIKE '%0'"),
    "pattern": ("part", "p_partkey", "", lambda: D.check_col(F.col("p_brand"), "string", pattern="Brand#[1-3][0-9]"), "regexp_full_match(p_brand, 'Brand#[1-3][0-9]')"),
    "enum": ("customer", "c_custkey", "", lambda: D.check_col(F.col("c_mktsegment"), "token", enumeration=["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "length": ("part", "p_partkey", "", lambda: D.check_col(F.col("p_name"), "token", maxLength=12), "length(p_name) <= 12"),
    "date": ("orders", "o_orderkey", "", lambda: D.check_col(F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.dayofmonth("o_orderdate") + 3).cast("string"), 2, "0")), "date"), "try_cast(strftime(o_orderdate, '%Y-%m-') || lpad((day(o_orderdate) + 3)::VARCHAR, 2, '0') AS DATE) IS NOT NULL"),
}
for _name, (_t, _k, _, _f, _sql) in _TYPED.items():
    query(f"SELECT {_k}, {_sql} AS ok FROM {_t}", f"xsd_{_name}")(lambda spark, sf_dir, t=_t, k=_k, f=_f: table(spark, sf_dir, t).select(k, f().alias("ok")))


# validation of documents


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def dtd_required(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    bare = nodes.withColumn("attrs", F.when(F.col("attrs")["flag"] == "N", F.map_filter("attrs", lambda k, v: k != "flag")).otherwise(F.col("attrs")))
    return DTD.missing_attributes(bare, "lineitem", "flag").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dtd_unique_id(spark, sf_dir):
    return DTD.duplicate_ids(orders(spark, sf_dir), "flag")


@query("SELECT o_orderkey AS doc_id, o_orderstatus AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = o_orderstatus)")
def dtd_idref(spark, sf_dir):
    return DTD.dangling_refs(orders(spark, sf_dir), "status", "flag")


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1")
def dtd_default(spark, sf_dir):
    new = DTD.add_defaults(orders(spark, sf_dir), "qty", {"unit": "piece"})
    return new.where("attrs['unit'] = 'piece'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def dtd_content(spark, sf_dir):
    model = "(" + ",".join(["lineitem?"] * 5) + ")"
    return DTD.content_errors(orders(spark, sf_dir), {"order": model, "lineitem": "(qty,part,supp)"}).select("doc_id")


@query("SELECT n_nationkey AS doc_id, coalesce(max(floor(c_acctbal)), 0) <= 9900 AS ok FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def validate_schema(spark, sf_dir):
    schema = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="nation"><xs:complexType><xs:sequence>
      <xs:element name="group" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="customer" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="bal" type="bal"/></xs:sequence>
      <xs:attribute name="key" type="xs:nonNegativeInteger" use="required"/></xs:complexType></xs:element></xs:sequence><xs:attribute name="name" type="xs:token"/></xs:complexType></xs:element></xs:sequence>
      <xs:attribute name="key" type="xs:int"/><xs:attribute name="name" type="xs:string"/></xs:complexType></xs:element>
      <xs:simpleType name="bal"><xs:restriction base="xs:integer"><xs:maxInclusive value="9900"/></xs:restriction></xs:simpleType></xs:schema>"""
    return xsd.validate_xsd(nations(spark, sf_dir), schema).select(F.col("doc_id").cast("int"), "ok")


@query("SELECT n_nationkey AS doc_id, coalesce(max(floor(c_acctbal)), 0) <= 9900 AS ok FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def validate_patterns(spark, sf_dir):
    schema = """<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><start><element name="nation"><attribute name="key"/><attribute name="name"/><zeroOrMore><ref name="g"/></zeroOrMore></element></start>
      <define name="g"><element name="group"><attribute name="name"/><oneOrMore><element name="customer"><attribute name="key"><data type="nonNegativeInteger"/></attribute><element name="bal"><data type="integer"><param name="maxInclusive">9900</param></data></element></element></oneOrMore></element></define></grammar>"""
    return rng.validate_rng(nations(spark, sf_dir), schema).select(F.col("doc_id").cast("int"), "ok")


@query("SELECT page_id AS doc_id, 0 AS level FROM pages")
def document_status(spark, sf_dir):
    return status(pages(spark, sf_dir))


@query("SELECT page_id AS doc_id, 3 AS level FROM pages")
def parse_errors(spark, sf_dir):
    return errors(shred(table(spark, sf_dir, "pages"), text="html", doc_id="page_id")).select("doc_id", "level")


# transformation


@query("SELECT n_nationkey AS doc_id, '<list>' || coalesce(string_agg('<c>' || c_custkey || '</c>', '' ORDER BY floor(c_acctbal) DESC, c_mktsegment, c_custkey), '') || '</list>' AS text FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def xsl_sort_number(spark, sf_dir):
    sheet = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template match="/"><list><xsl:for-each select="//customer"><xsl:sort select="bal" data-type="number" order="descending"/><c><xsl:value-of select="@key"/></c></xsl:for-each></list></xsl:template></xsl:stylesheet>"""
    found = xslt.transform_to_text(nations(spark, sf_dir), sheet)
    return found.where("text <> '<list/>'").select(F.col("doc_id").cast("int"), "text")


@query("SELECT n_nationkey AS doc_id, string_agg(name || ':' || n || ';', '' ORDER BY name) AS text FROM (SELECT n_nationkey, c_mktsegment AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def xsl_templates(spark, sf_dir):
    sheet = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template match="nation"><xsl:apply-templates select="group"><xsl:sort select="@name"/></xsl:apply-templates></xsl:template><xsl:template match="group"><xsl:value-of select="concat(@name, ':', count(customer), ';')"/></xsl:template></xsl:stylesheet>"""
    found = xslt.transform_to_text(nations(spark, sf_dir), sheet)
    return found.where("text <> ''").select(F.col("doc_id").cast("int"), "text")


@query("SELECT l_orderkey AS doc_id, sum(l_quantity)::BIGINT AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def rewrite_top_down(spark, sf_dir):
    from ..operators import arrows as A

    f = A.process_top_down(A.when(A.none, A.has_attr_value("flag", lambda v: v == "R")))
    new = store(rewrite(shred(order_docs(spark, sf_dir)), f.run))
    text = axes.string_value(new.where("name = 'qty'"), new)
    return text.groupBy("doc_id").agg(F.sum(F.col("string_value").cast("long")).alias("q"))


@query("SELECT o_orderkey AS doc_id, '<order key=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\"' || CASE WHEN count(l_orderkey) = 0 THEN '/>' ELSE '>' END AS head, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def serialize_roundtrip(spark, sf_dir):
    text = serialize(orders(spark, sf_dir), xml_pi=False)
    return text.select("doc_id", F.regexp_extract("text", "^(<[^>]*>)", 1).alias("head"), F.size(F.regexp_extract_all("text", F.lit("<lineitem "), F.lit(0))).cast("long").alias("n"))


@query("SELECT o_orderkey AS doc_id, 'urn:' || o_orderstatus AS ns, count(l_orderkey) + 1 AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def namespaces(spark, sf_dir):
    def declare(t: Node) -> list[Node]:
        top = t.children[0]
        top.attrs["xmlns"] = "urn:" + top.attrs["status"]
        return [edit.propagate_namespaces(t)]

    new = rewrite(shred(order_docs(spark, sf_dir)), declare)
    return new.where("kind = 'element' and local in ('order', 'lineitem')").groupBy("doc_id", F.col("ns_uri").alias("ns")).agg(F.count(F.lit(1)).alias("n"))


# codecs

_NATION = K.elem("nation", K.record(n_nationkey=K.attr("key", K.integer()), n_name=K.elem("name", K.text0()), n_regionkey=K.elem("region", K.integer())))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def pickle_roundtrip(spark, sf_dir):
    xml = table(spark, sf_dir, "nation").select(K.encode_col(F.struct("n_nationkey", "n_name", "n_regionkey"), _NATION).alias("x"))
    return xml.select(K.decode_col(F.col("x"), _NATION, "n_nationkey long, n_name string, n_regionkey long").alias("v")).select("v.n_nationkey", "v.n_name", "v.n_regionkey")


@query("SELECT count(*) AS n, count(*) AS bad FROM nation")
def pickle_errors(spark, sf_dir):
    bad = table(spark, sf_dir, "nation").select(F.concat(F.lit("<nation key='x'><name>"), "n_name", F.lit("</name></nation>")).alias("x"))
    got = bad.select(K.decode_col(F.col("x"), _NATION, "n_nationkey long, n_name string, n_regionkey long").alias("v"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count("v.error").alias("bad"))


# triples


def nation_triples(spark, sf_dir):
    one = F.format_string(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/"><rdf:Description rdf:about="http://n/%d"><x:name>%s</x:name><x:in rdf:resource="http://r/%d"/></rdf:Description></rdf:RDF>', "n_nationkey", "n_name", "n_regionkey"
    )
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), one.alias("text"))
    return rdf.triples(shred(docs, check_namespaces=True))


@query("SELECT 'http://n/' || n_nationkey AS s, 'http://x/name' AS p, n_name AS o, 'literal' AS o_kind FROM nation UNION ALL SELECT 'http://n/' || n_nationkey, 'http://x/in', 'http://r/' || n_regionkey, 'uri' FROM nation")
def rdf_triples(spark, sf_dir):
    return nation_triples(spark, sf_dir).select("s", "p", "o", "o_kind")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
def sparql_select(spark, sf_dir):
    return rdf.select(nation_triples(spark, sf_dir), "PREFIX x: <http://x/> SELECT ?name WHERE { ?n x:in <http://r/1> ; x:name ?name }")


@query("SELECT 'n' AS var, 'http://n/' || n_nationkey AS value FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'n', 'http://n/' || n_nationkey FROM nation UNION ALL SELECT 'name', n_name FROM nation")
def sparql_bindings(spark, sf_dir):
    return rdf.bindings(nation_triples(spark, sf_dir), "PREFIX x: <http://x/> SELECT ?n ?name WHERE { ?n x:in <http://r/1> ; x:name ?name }")


# the rest


@query("SELECT page_id, sha1(url) AS key, substring(sha1(url), 1, 2) || '/' || substring(sha1(url), 3) AS path FROM pages")
def cache_sha1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cache.key(F.col("url")).alias("key"), cache.path_of(F.col("url")).alias("path"))


@query("SELECT doc_id, replace(replace(text, chr(10), '|'), ' ', '_') AS v FROM documents")
def normalize_newlines(spark, sf_dir):
    made = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("_")), F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(S.normalize_newlines(made), F.lit("\n"), F.lit("|")).alias("v"))


@query("SELECT conv_id AS doc_id, string_agg(role, '>' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY 1")
def ordered_siblings(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    one = F.concat(F.lit('<turn role="'), S.escape_attr(F.col("role")), F.lit('">'), S.escape_text(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")), F.lit("</turn>"))
    body = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", one.alias("x")))), lambda v: v["x"]), "").alias("b"))
    nodes = shred(body.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("<conv>"), "b", F.lit("</conv>")).alias("text")))
    items = nodes.where("name = 'turn'").select("doc_id", "sib", F.col("attrs")["role"].alias("role"))
    return select.list_a(nodes.where("level = 0").select("doc_id"), items, ["doc_id"], "sib", "role").select("doc_id", F.array_join("items", ">").alias("roles"))
