"""A query for each operator of the engine over the test tables, and the SQL that it must agree with.

Graphs are drawn from whole tables: trade between nations, chains of a customer's orders, suppliers of parts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .language import SPLIT, Agg, Const, Filter, Let, Program, Relation, Var, agg, count, cpp, sum
from .plans.rewrites import resolve_consts

a, b, c, d, e, k, n, o, p, q, r, s, t, u, v, w, x, y, z = map(Var, "abcdeknopqrstuvwxyz")
_ = Var("_")

NATION = Relation("Nation", 2)  # nation, region
NATION_NAME = Relation("NationName", 2, (int, str))
CUSTOMER = Relation("Customer", 3, (int, int, str))  # customer, nation, segment
SUPPLIER = Relation("Supplier", 2)  # supplier, nation
PART = Relation("Part", 3, (int, str, int))  # part, brand, size
ORDERS = Relation("Orders", 3, (int, int, str))  # order, customer, status
LINE = Relation("Line", 4)  # order, part, supplier, number
SUPPLIES = Relation("Supplies", 2)  # supplier, part
PRICE = Relation("Price", 2, (int, float))  # order, total price
TRADE = Relation("Trade", 2)  # seller's nation, buyer's nation, of more lines than the average pair
NEXT = Relation("Next", 2)  # an order and the customer's next one
HUB = Relation("Hub", 2)  # customers in a row, and seven hubs that all of them are tied to
EVENT = Relation("Event", 2, (int, str))  # user, event type

_FACTS: dict[str, tuple[Relation, str, tuple[str, ...]]] = {
    "Nation": (NATION, "nation", ("n_nationkey", "n_regionkey")),
    "NationName": (NATION_NAME, "nation", ("n_nationkey", "n_name")),
    "Customer": (CUSTOMER, "customer", ("c_custkey", "c_nationkey", "c_mktsegment")),
    "Supplier": (SUPPLIER, "supplier", ("s_suppkey", "s_nationkey")),
    "Part": (PART, "part", ("p_partkey", "p_brand", "p_size")),
    "Orders": (ORDERS, "orders", ("o_orderkey", "o_custkey", "o_orderstatus")),
    "Line": (LINE, "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    "Supplies": (SUPPLIES, "lineitem", ("l_suppkey", "l_partkey")),
    "Price": (PRICE, "orders", ("o_orderkey", "o_totalprice")),
    "Event": (EVENT, "events", ("user_id", "event_type")),
}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b): nations whose suppliers and customers have more lines in common than the average pair of nations."""
    lines, orders = _table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), _table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    seller, buyer = _table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a")), _table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    by_party = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("l_suppkey", "o_custkey").count()
    pairs = by_party.join(seller, by_party.l_suppkey == seller.s_suppkey).join(buyer, by_party.o_custkey == buyer.c_custkey).groupBy("a", "b").agg(F.sum("count").alias("n"))
    mean = pairs.agg(F.avg("n").alias("mean"))
    return pairs.join(F.broadcast(mean), F.col("n") > F.col("mean")).select("a", "b")


def chains(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(order).alias("b")).where("b is not null")


def hubs(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b): each customer and the next one, and, both ways, each customer and one of seven hubs."""
    c, own = _table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey")
    pairs = F.array(F.struct(own.alias("a"), (own + 1).alias("b")), F.struct(own.alias("a"), (own % 7).alias("b")), F.struct((own % 7).alias("a"), own.alias("b")))
    return c.select(F.explode(pairs).alias("e")).select("e.a", "e.b")


def engine(spark: SparkSession, sf: str, program: Program) -> Engine:
    """An engine with the facts that the program mentions."""
    out = Engine(spark)
    for rel in program.relations:
        if rel.name in _FACTS:
            relation, table, columns = _FACTS[rel.name]
            out.bind(relation, _table(spark, sf, table), *columns)
        elif rel.name == "Trade":
            out.bind(TRADE, trade(spark, sf))
        elif rel.name == "Hub":
            out.bind(HUB, hubs(spark, sf))
        elif rel.name == "Next":
            out.bind(NEXT, chains(spark, sf))
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TRADE = """heavy AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
trade AS (SELECT a, b FROM heavy WHERE n > (SELECT avg(n) FROM heavy)),
"""
_NEXT = """links AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
nexts AS (SELECT a, b FROM links WHERE b IS NOT NULL),
"""


_HUB = "hub AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer UNION SELECT c_custkey, c_custkey % 7 FROM customer UNION SELECT c_custkey % 7, c_custkey FROM customer)"


def query(name: str, rules: list, head: Relation, columns: str, sql: str | None, **options) -> None:
    """Registers the relation that rules derive, under these column names."""
    program = Program(rules)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return engine(spark, sf, program).run(program, **options).named(head.name, *columns.split())

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {_TRADE}{_NEXT} out AS ({sql}) SELECT * FROM out" if "trade" in sql or "nexts" in sql else sql


def counted(name: str, rules: list, sql: str) -> None:
    """Registers the counts of rules that are only counted, as (rule, n)."""
    program = Program(rules)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = engine(spark, sf, program).run(program).counts
        return spark.createDataFrame(sorted(found.items()), "rule string, n bigint")

    QUERIES[name], ORACLES[name] = run, f"WITH RECURSIVE {_TRADE}{_NEXT} out AS ({sql}) SELECT * FROM out"


def _rel(name: str, arity: int, types=None, **more) -> Relation:
    return Relation(name, arity, types, **more)


# scans, projections, constants, expressions

R1, R2, R3 = _rel("Out", 1), _rel("Out", 2), _rel("Out", 3)
S2 = _rel("Out", 2, (int, str))
query("scan_project", [S2(x, n) <= NATION_NAME(x, n)], S2, "nation name", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation, n_name AS name FROM nation")
query("body_constant", [R1(x) <= NATION(x, Const(1))], R1, "nation", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_regionkey = 1")
query("head_constant", [R2(x, Const(7)) <= NATION(x, _)], R2, "nation seven", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation, CAST(7 AS BIGINT) AS seven FROM nation")
query("let_arith", [R2(x, y) <= NATION(x, r) & Let("y", "x * 10 + r / 2 - r % 3", ("x", "r"))], R2, "nation code", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_nationkey * 10 + n_regionkey // 2 - n_regionkey % 3 AS BIGINT) AS code FROM nation")
query("computed_term", [R2(x, cpp("x * x + r")) <= NATION(x, r)], R2, "nation code", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_nationkey * n_nationkey + n_regionkey AS BIGINT) AS code FROM nation")
query("filter_cmp", [R2(o, c) <= ORDERS(o, c, _) & Filter(("o", "c"), "return (o * 10 + c) > (c * 100);")], R2, "ord cust", "SELECT DISTINCT o_orderkey AS ord, o_custkey AS cust FROM orders WHERE o_orderkey * 10 + o_custkey > o_custkey * 100")
query("filter_logic", [R1(x) <= PART(x, _, s) & Filter(("x", "s"), "return s > 10 && x % 3 == 0 || !(s != 5);")], R1, "part", "SELECT DISTINCT p_partkey AS part FROM part WHERE (p_size > 10 AND p_partkey % 3 = 0) OR p_size = 5")
query("filter_bits", [R2(x, y) <= PART(x, _, s) & Let("y", "(s << 2 | x & 3) ^ 1", ("s", "x")) & Filter(("y",), "y >= 20 ? 1 : 0")], R2, "part code", "SELECT DISTINCT p_partkey AS part, xor((CAST(p_size AS BIGINT) << 2) | (p_partkey & 3), 1) AS code FROM part WHERE xor((CAST(p_size AS BIGINT) << 2) | (p_partkey & 3), 1) >= 20")
query("filter_function", [R1(x) <= PRICE(x, y) & Filter(("y",), lambda y: F.floor(y) % 2 == 0)], R1, "ord", "SELECT DISTINCT o_orderkey AS ord FROM orders WHERE floor(o_totalprice) % 2 = 0")
query("wildcard", [R1(c) <= ORDERS(_, c, _)], R1, "cust", "SELECT DISTINCT o_custkey AS cust FROM orders")
query("repeated_var", [R1(x) <= TRADE(x, x)], R1, "nation", "SELECT DISTINCT CAST(a AS BIGINT) AS nation FROM trade WHERE a = b")
query("head_repeat", [R2(x, x) <= TRADE(x, _)], R2, "a b", "SELECT DISTINCT CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) AS b FROM trade")
query("permute", [R2(y, x) <= TRADE(x, y)], R2, "a b", "SELECT DISTINCT CAST(b AS BIGINT) AS a, CAST(a AS BIGINT) AS b FROM trade")

# joins

query("join_2way", [S2(o, s) <= ORDERS(o, c, _) & CUSTOMER(c, _, s)], S2, "ord segment", "SELECT DISTINCT o_orderkey AS ord, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
query("join_3way", [R2(n, p) <= CUSTOMER(c, n, _) & ORDERS(o, c, _) & LINE(o, p, _, _)], R2, "nation part", "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation, l_partkey AS part FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
query("join_star", [R3(r, s, z) <= LINE(o, p, u, _) & PART(p, _, z) & SUPPLIER(u, s) & ORDERS(o, c, _) & CUSTOMER(c, n, _) & NATION(n, r)], R3, "region seller size", "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS region, CAST(s_nationkey AS BIGINT) AS seller, CAST(p_size AS BIGINT) AS size FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
query("self_join", [R2(x, y) <= SUPPLIER(x, n) & SUPPLIER(y, n) & Filter(("x", "y"), "x < y")], R2, "a b", "SELECT DISTINCT l.s_suppkey AS a, r.s_suppkey AS b FROM supplier l JOIN supplier r USING (s_nationkey) WHERE l.s_suppkey < r.s_suppkey")
query("theta_filter", [R2(x, y) <= TRADE(x, z) & TRADE(z, y) & Filter(("x", "y"), "x != y")], R2, "a b", "SELECT DISTINCT CAST(l.a AS BIGINT) AS a, CAST(r.b AS BIGINT) AS b FROM trade l JOIN trade r ON l.b = r.a WHERE l.a <> r.b")
query("cross_product", [R2(x, r) <= NATION(x, _) & NATION(_, r)], R2, "nation region", "SELECT DISTINCT CAST(l.n_nationkey AS BIGINT) AS nation, CAST(r.n_regionkey AS BIGINT) AS region FROM nation l, nation r")
query("triangle", [R3(x, y, z) <= TRADE(x, y) & TRADE(y, z) & TRADE(z, x)], R3, "a b c", "SELECT DISTINCT CAST(l.a AS BIGINT) AS a, CAST(m.a AS BIGINT) AS b, CAST(r.a AS BIGINT) AS c FROM trade l JOIN trade m ON l.b = m.a JOIN trade r ON m.b = r.a AND r.b = l.a")
query("labeled_triangle", [R3(x, y, z) <= TRADE(x, y) & TRADE(y, z) & TRADE(z, x) & NATION(x, r) & NATION(y, r) & NATION(z, r)], R3, "a b c", "SELECT DISTINCT CAST(l.a AS BIGINT) AS a, CAST(m.a AS BIGINT) AS b, CAST(r.a AS BIGINT) AS c FROM trade l JOIN trade m ON l.b = m.a JOIN trade r ON m.b = r.a AND r.b = l.a JOIN nation x ON x.n_nationkey = l.a JOIN nation y ON y.n_nationkey = m.a JOIN nation z ON z.n_nationkey = r.a WHERE x.n_regionkey = y.n_regionkey AND y.n_regionkey = z.n_regionkey")
query("triangle_skewed", [R3(x, y, z) <= HUB(x, y) & HUB(y, z) & HUB(z, x)], R3, "a b c", f"WITH {_HUB} SELECT DISTINCT l.a, m.a AS b, r.a AS c FROM hub l JOIN hub m ON l.b = m.a JOIN hub r ON m.b = r.a AND r.b = l.a")
query("diamond_skewed", [R2(x, w) <= HUB(x, y) & HUB(x, z) & HUB(y, z) & HUB(y, w) & HUB(z, w) & Filter(("x", "w"), "x < w")], R2, "a b", f"WITH {_HUB} SELECT DISTINCT p.a, s.b FROM hub p JOIN hub q ON p.a = q.a JOIN hub r ON r.a = p.b AND r.b = q.b JOIN hub s ON s.a = p.b JOIN hub t ON t.a = q.b AND t.b = s.b WHERE p.a < s.b")
query("two_hop", [R3(x, y, z) <= NEXT(x, y) & NEXT(y, z) & Filter(("x", "z"), "x != z")], R3, "a b c", "SELECT DISTINCT l.a, l.b, r.b AS c FROM nexts l JOIN nexts r ON l.b = r.a WHERE l.a <> r.b")
query("semi_join", [R1(x) <= CUSTOMER(x, _, _) & ORDERS(_, x, _)], R1, "cust", "SELECT c_custkey AS cust FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
query("anti_join", [R2(x, y) <= TRADE(x, y) & ~TRADE(y, x)], R2, "a b", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM trade t WHERE NOT EXISTS (SELECT 1 FROM trade u WHERE u.a = t.b AND u.b = t.a)")
query("anti_wildcard", [R1(x) <= PART(x, _, _) & ~LINE(_, x, _, _)], R1, "part", "SELECT p_partkey AS part FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
query("anti_wildcard_some", [R2(x, y) <= SUPPLIER(x, _) & PART(y, _, Const(1)) & ~LINE(_, y, x, _)], R2, "supp part", "SELECT s_suppkey AS supp, p_partkey AS part FROM supplier, part WHERE p_size = 1 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey)")
query("anti_ground_both", [R2(x, Const(0)) <= NATION(x, _) & ~NATION(Const(0), Const(99)), R2(x, Const(1)) <= NATION(x, _) & ~NATION(Const(3), Const(1)), R2(x, Const(2)) <= NATION(x, _) & ~NATION(Const(3), Const(3))], R2, "nation rule", "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(rule AS BIGINT) AS rule FROM nation, (VALUES (0, 0, 99), (1, 3, 1), (2, 3, 3)) AS f(rule, a, b) WHERE NOT EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey = f.a AND m.n_regionkey = f.b)")
query("anti_const", [R1(c) <= CUSTOMER(c, _, _) & ~ORDERS(_, c, Const("P"))], R1, "cust", "SELECT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
query("anti_ground", [R1(x) <= NATION(x, _) & ~NATION(Const(0), Const(99))], R1, "nation", "SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0 AND n_regionkey = 99)")
query("anti_multi", [R1(x) <= NATION(x, r) & ~TRADE(x, x) & ~SUPPLIER(x, r)], R1, "nation", "SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM trade WHERE a = n_nationkey AND b = n_nationkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = n_nationkey AND s_nationkey = n_regionkey)")

# sets and heads

query("union_rules", [R1(x) <= CUSTOMER(x, Const(3), _), R1(x) <= SUPPLIER(x, _)], R1, "party", "SELECT c_custkey AS party FROM customer WHERE c_nationkey = 3 UNION SELECT s_suppkey FROM supplier")
query("set_difference", [R1(x) <= CUSTOMER(x, _, _) & ~SUPPLIER(x, _)], R1, "party", "SELECT c_custkey AS party FROM customer EXCEPT SELECT s_suppkey FROM supplier")
query("intersection", [R2(x, n) <= CUSTOMER(x, n, _) & SUPPLIER(x, n)], R2, "party nation", "SELECT c_custkey AS party, CAST(c_nationkey AS BIGINT) AS nation FROM customer INTERSECT SELECT s_suppkey, s_nationkey FROM supplier")
BOTH, SELLS, BUYS = _rel("Both", 2), _rel("Sells", 1), _rel("Buys", 1)
query("multi_head", [(SELLS(x) | BUYS(y) | BOTH(x, y)) <= TRADE(x, y) & Filter(("x", "y"), "x < y"), R2(x, y) <= BOTH(x, y) & SELLS(x) & BUYS(y) & BUYS(x)], R2, "a b", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM trade t WHERE a < b AND EXISTS (SELECT 1 FROM trade u WHERE u.a < u.b AND u.b = t.a)")

# aggregates

F2 = _rel("Out", 2, (int, float))
B2 = _rel("Out", 2, (int, bool))
query("agg_count", [R2(c, n) <= CUSTOMER(c, _, _) & count("n", ORDERS(o, c, _))], R2, "cust orders", "SELECT c_custkey AS cust, count(DISTINCT o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
query("agg_sum", [R2(u, t) <= SUPPLIER(u, _) & sum("t", SUPPLIES(u, p))], R2, "supp total", "SELECT s_suppkey AS supp, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS total FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON s_suppkey = l_suppkey GROUP BY 1")
query("agg_min", [R2(u, t) <= SUPPLIER(u, _) & agg("t", "min", SUPPLIES(u, p))], R2, "supp least", "SELECT l_suppkey AS supp, min(l_partkey) AS least FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
query("agg_max", [R2(u, t) <= SUPPLIER(u, _) & agg("t", "max", SUPPLIES(u, p))], R2, "supp most", "SELECT l_suppkey AS supp, max(l_partkey) AS most FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
query("agg_exists", [B2(p, t) <= PART(p, _, _) & agg("t", "exists", SUPPLIES(u, p))], B2, "part supplied", "SELECT p_partkey AS part, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AS supplied FROM part")
query("agg_empty_group", [R3(x, n, t) <= NATION(x, r) & count("n", SUPPLIER(x, r)) & sum("t", SUPPLIER(x, r))], R3, "nation n total", "SELECT CAST(n_nationkey AS BIGINT) AS nation, (SELECT count(*) FROM supplier WHERE s_suppkey = n_nationkey AND s_nationkey = n_regionkey) AS n, CAST((SELECT coalesce(sum(s_nationkey), 0) FROM supplier WHERE s_suppkey = n_nationkey AND s_nationkey = n_regionkey) AS BIGINT) AS total FROM nation")
query("agg_global", [R1(n) <= count("n", TRADE(x, y))], R1, "n", "SELECT count(*) AS n FROM trade")
query("agg_custom", [R2(u, t) <= SUPPLIER(u, _) & Agg("t", "agg", SUPPLIES(u, p), custom=lambda value: F.sum(value * value))], R2, "supp squares", "SELECT l_suppkey AS supp, CAST(sum(l_partkey * l_partkey) AS BIGINT) AS squares FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
R4 = _rel("Out", 4)
counted("count_only_2hop", [(R4(x, y, z, r) <= TRADE(x, y) & TRADE(y, z) & NATION(z, r) & Filter(("x", "z"), "x != z")).named("TwoHop").with_count()], "SELECT 'TwoHop' AS rule, count(*) AS n FROM trade l JOIN trade m ON l.b = m.a JOIN nation ON n_nationkey = m.b WHERE l.a <> m.b")
counted("count_only_triangle", [(R3(x, y, z) <= TRADE(x, y) & TRADE(y, z) & TRADE(x, z)).named("Triangle").with_count()], "SELECT 'Triangle' AS rule, count(*) AS n FROM trade l JOIN trade m ON l.b = m.a JOIN trade r ON r.a = l.a AND r.b = m.b")
counted("count_only_star", [(R4(c, o, p, u) <= ORDERS(o, c, _) & LINE(o, p, u, _) & SUPPLIER(u, n) & CUSTOMER(c, n, _)).named("Local").with_count()], "SELECT 'Local' AS rule, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey")
counted("count_only_neg2hop", [(R3(x, y, z) <= TRADE(x, y) & TRADE(y, z) & ~TRADE(x, z) & Filter(("x", "z"), "x != z")).named("Open").with_count()], "SELECT 'Open' AS rule, count(*) AS n FROM trade l JOIN trade m ON l.b = m.a WHERE l.a <> m.b AND NOT EXISTS (SELECT 1 FROM trade r WHERE r.a = l.a AND r.b = m.b)")
HAS_ORDER, HAS_SUPPLY = _rel("HasOrder", 1), _rel("HasSupply", 1)
CASE1, CASE2, CASE3, CASE4 = _rel("Case1", 3), _rel("Case2", 2), _rel("Case3", 2), _rel("Case4", 1)
counted(
    "optional_4case",
    [
        HAS_ORDER(c) <= ORDERS(_, c, _), HAS_SUPPLY(u) <= SUPPLIES(u, _),
        (CASE1(c, o, p) <= CUSTOMER(c, _, _) & ORDERS(o, c, _) & SUPPLIES(c, p)).named("Both").with_count(),
        (CASE2(c, o) <= CUSTOMER(c, _, _) & ORDERS(o, c, _) & ~HAS_SUPPLY(c)).named("OrderOnly").with_count(),
        (CASE3(c, p) <= CUSTOMER(c, _, _) & SUPPLIES(c, p) & ~HAS_ORDER(c)).named("SupplyOnly").with_count(),
        (CASE4(c) <= CUSTOMER(c, _, _) & ~HAS_ORDER(c) & ~HAS_SUPPLY(c)).named("Neither").with_count(),
    ],
    """SELECT CASE WHEN o_orderkey IS NULL AND l_partkey IS NULL THEN 'Neither' WHEN o_orderkey IS NULL THEN 'SupplyOnly' WHEN l_partkey IS NULL THEN 'OrderOnly' ELSE 'Both' END AS rule, count(*) AS n
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = c_custkey GROUP BY 1
       UNION ALL SELECT k.rule, 0 FROM (VALUES ('Neither'), ('SupplyOnly'), ('OrderOnly'), ('Both')) AS k(rule) WHERE k.rule NOT IN (SELECT CASE WHEN o_orderkey IS NULL AND l_partkey IS NULL THEN 'Neither' WHEN o_orderkey IS NULL THEN 'SupplyOnly' WHEN l_partkey IS NULL THEN 'OrderOnly' ELSE 'Both' END FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = c_custkey)""",
)

# recursion

PATH, REACH, SG, EVEN, ODD = _rel("Path", 2), _rel("Reach", 1), _rel("SameGeneration", 2), _rel("Even", 2), _rel("Odd", 2)
_CLOSURE = "WITH RECURSIVE p(a, b) AS (SELECT a, b FROM {0} UNION SELECT p.a, e.b FROM p JOIN {0} e ON p.b = e.a) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM p"
query("tc_linear", [PATH(x, y) <= TRADE(x, y), PATH(x, z) <= PATH(x, y) & TRADE(y, z)], PATH, "a b", _CLOSURE.format("trade"))
query("tc_chains", [PATH(x, y) <= NEXT(x, y), PATH(x, z) <= PATH(x, y) & NEXT(y, z)], PATH, "a b", _CLOSURE.format("nexts"))
query("tc_nonlinear", [PATH(x, y) <= NEXT(x, y), PATH(x, z) <= PATH(x, y) & PATH(y, z)], PATH, "a b", _CLOSURE.format("nexts"))
query("reachability", [REACH(x) <= NATION(x, Const(0)) & TRADE(x, x), REACH(y) <= REACH(x) & TRADE(x, y)], REACH, "nation", "WITH RECURSIVE p(a) AS (SELECT a FROM trade JOIN nation ON a = n_nationkey WHERE a = b AND n_regionkey = 0 UNION SELECT b FROM p JOIN trade USING (a)) SELECT CAST(a AS BIGINT) AS nation FROM p")
query("same_generation", [SG(x, y) <= TRADE(p, x) & TRADE(p, y) & Filter(("x", "y"), "x != y"), SG(x, y) <= TRADE(p, x) & SG(p, q) & TRADE(q, y)], SG, "a b", "WITH RECURSIVE g(a, b) AS (SELECT l.b, r.b FROM trade l JOIN trade r ON l.a = r.a WHERE l.b <> r.b UNION SELECT l.b, r.b FROM g JOIN trade l ON l.a = g.a JOIN trade r ON r.a = g.b) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM g")
query("mutual_recursion", [ODD(x, y) <= NEXT(x, y), EVEN(x, z) <= ODD(x, y) & NEXT(y, z), ODD(x, z) <= EVEN(x, y) & NEXT(y, z)], EVEN, "a b", "WITH RECURSIVE p(k, a, b) AS (SELECT 1, a, b FROM nexts UNION SELECT 1 - k, p.a, e.b FROM p JOIN nexts e ON p.b = e.a) SELECT a, b FROM p WHERE k = 0")
query("max_iter_2", [PATH(x, y) <= NEXT(x, y), PATH(x, z) <= PATH(x, y) & NEXT(y, z)], PATH, "a b", "WITH RECURSIVE p(a, b, n) AS (SELECT a, b, 0 FROM nexts UNION SELECT p.a, e.b, n + 1 FROM p JOIN nexts e ON p.b = e.a WHERE n < 2) SELECT DISTINCT a, b FROM p", max_iterations=2)
query("neg_over_recursion", [REACH(y) <= NATION(x, Const(0)) & TRADE(x, y), REACH(y) <= REACH(x) & NATION(x, r) & TRADE(x, y) & NATION(y, r), R1(x) <= NATION(x, _) & ~REACH(x)], R1, "nation", "WITH RECURSIVE p(a) AS (SELECT b FROM trade JOIN nation ON a = n_nationkey WHERE n_regionkey = 0 UNION SELECT t.b FROM p JOIN trade t USING (a) JOIN nation x ON x.n_nationkey = t.a JOIN nation y ON y.n_nationkey = t.b WHERE x.n_regionkey = y.n_regionkey) SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_nationkey NOT IN (SELECT a FROM p)")
OPEN = _rel("Closed", 1)
query("recursion_with_lower_neg", [OPEN(o) <= ORDERS(o, _, Const("F")), PATH(x, y) <= NEXT(x, y) & ~OPEN(x), PATH(x, z) <= PATH(x, y) & NEXT(y, z) & ~OPEN(y)], PATH, "a b", "WITH RECURSIVE f AS (SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'), p(a, b) AS (SELECT a, b FROM nexts WHERE a NOT IN (SELECT o FROM f) UNION SELECT p.a, e.b FROM p JOIN nexts e ON p.b = e.a WHERE e.a NOT IN (SELECT o FROM f)) SELECT a, b FROM p")
POINTS, ADDRESS, ASSIGN, LOAD, STORE = _rel("PointsTo", 2), _rel("AddressOf", 2), _rel("Assign", 2), _rel("Load", 2), _rel("Store", 2)
_MEMORY = [ADDRESS(x, y) <= SUPPLIER(x, y), ASSIGN(x, y) <= TRADE(x, y) & Filter(("x", "y"), "x < y"), LOAD(x, y) <= TRADE(x, y) & Filter(("x", "y"), "x > y"), STORE(x, y) <= TRADE(x, y) & NATION(x, r) & NATION(y, r)]
_MEMORY_SQL = "address AS (SELECT DISTINCT s_suppkey AS a, s_nationkey AS b FROM supplier), assigned AS (SELECT a, b FROM trade WHERE a < b), loaded AS (SELECT a, b FROM trade WHERE a > b), stored AS (SELECT t.a, t.b FROM trade t JOIN nation x ON x.n_nationkey = t.a JOIN nation y ON y.n_nationkey = t.b WHERE x.n_regionkey = y.n_regionkey)"
query(
    "points_to",
    [*_MEMORY, POINTS(y, x) <= ADDRESS(y, x), POINTS(y, x) <= POINTS(z, x) & ASSIGN(y, z), POINTS(y, w) <= POINTS(x, z) & LOAD(y, x) & POINTS(z, w), POINTS(z, w) <= POINTS(y, z) & STORE(y, x) & POINTS(x, w)],
    POINTS, "a b",
    f"""WITH RECURSIVE {_MEMORY_SQL}, p(a, b) AS (SELECT a, b FROM address UNION (
        SELECT s.a, p.b FROM p JOIN assigned s ON s.b = p.a
        UNION SELECT l.a, g.b FROM p f JOIN loaded l ON l.b = f.a JOIN recurring.p g ON g.a = f.b
        UNION SELECT l.a, g.b FROM recurring.p f JOIN loaded l ON l.b = f.a JOIN p g ON g.a = f.b
        UNION SELECT f.b, g.b FROM p f JOIN stored s ON s.a = f.a JOIN recurring.p g ON g.a = s.b
        UNION SELECT f.b, g.b FROM recurring.p f JOIN stored s ON s.a = f.a JOIN p g ON g.a = s.b))
        SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM p""",
)
DEREF, FLOW, MALIAS, VALIAS = _rel("Deref", 2), _rel("ValueFlow", 2), _rel("MemoryAlias", 2), _rel("ValueAlias", 2)
query(
    "cspa",
    [
        ASSIGN(x, y) <= TRADE(x, y) & NATION(x, r) & NATION(y, r), DEREF(x, y) <= SUPPLIER(x, y),
        FLOW(y, x) <= ASSIGN(y, x), FLOW(x, x) <= ASSIGN(x, _), FLOW(x, x) <= ASSIGN(_, x), MALIAS(x, x) <= ASSIGN(_, x), MALIAS(x, x) <= ASSIGN(x, _),
        FLOW(x, y) <= FLOW(x, z) & FLOW(z, y), FLOW(x, y) <= ASSIGN(x, z) & MALIAS(z, y),
        VALIAS(x, y) <= FLOW(z, x) & FLOW(z, y), VALIAS(x, y) <= FLOW(z, x) & MALIAS(z, w) & FLOW(w, y), MALIAS(x, w) <= DEREF(y, x) & VALIAS(y, z) & DEREF(z, w),
    ],
    MALIAS, "a b",
    """WITH RECURSIVE assigned AS (SELECT t.a, t.b FROM trade t JOIN nation x ON x.n_nationkey = t.a JOIN nation y ON y.n_nationkey = t.b WHERE x.n_regionkey = y.n_regionkey), deref AS (SELECT DISTINCT s_suppkey AS a, s_nationkey AS b FROM supplier),
       m(k, a, b) AS (SELECT 'f', a, b FROM assigned UNION SELECT 'f', a, a FROM assigned UNION SELECT 'f', b, b FROM assigned UNION SELECT 'm', b, b FROM assigned UNION SELECT 'm', a, a FROM assigned UNION (
         SELECT 'f', l.a, r.b FROM recurring.m l JOIN recurring.m r ON l.b = r.a WHERE l.k = 'f' AND r.k = 'f' AND EXISTS (SELECT 1 FROM m)
         UNION SELECT 'f', s.a, m.b FROM assigned s JOIN m ON s.b = m.a WHERE m.k = 'm'
         UNION SELECT 'v', l.b, r.b FROM recurring.m l JOIN recurring.m r ON l.a = r.a WHERE l.k = 'f' AND r.k = 'f' AND EXISTS (SELECT 1 FROM m)
         UNION SELECT 'v', l.b, r.b FROM recurring.m l JOIN recurring.m c ON l.a = c.a JOIN recurring.m r ON c.b = r.a WHERE l.k = 'f' AND c.k = 'm' AND r.k = 'f' AND EXISTS (SELECT 1 FROM m)
         UNION SELECT 'm', d.b, g.b FROM deref d JOIN m ON d.a = m.a JOIN deref g ON m.b = g.a WHERE m.k = 'v'))
       SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM m WHERE k = 'm'""",
)
OUT_P, OUT_Q = _rel("OutP", 2), _rel("OutQ", 3)
query(
    "galen",
    [
        OUT_P(x, z) <= TRADE(x, z) & NATION(x, r) & NATION(z, r), OUT_Q(x, r, y) <= TRADE(x, y) & NATION(x, r) & Filter(("x", "y"), "x > y"),
        OUT_P(x, z) <= OUT_P(x, y) & OUT_P(y, z), OUT_Q(x, r, z) <= OUT_P(x, y) & OUT_Q(y, r, z), OUT_P(x, z) <= OUT_P(y, w) & NATION(w, r) & OUT_Q(x, r, y) & TRADE(w, z),
    ],
    OUT_P, "a b",
    """WITH RECURSIVE near AS (SELECT t.a, t.b FROM trade t JOIN nation x ON x.n_nationkey = t.a JOIN nation y ON y.n_nationkey = t.b WHERE x.n_regionkey = y.n_regionkey),
       m(k, a, r, b) AS (SELECT 'p', a, 0, b FROM near UNION SELECT 'q', a, n_regionkey, b FROM trade JOIN nation ON a = n_nationkey WHERE a > b UNION (
         SELECT 'p', x.a, 0, y.b FROM recurring.m x JOIN recurring.m y ON x.b = y.a WHERE x.k = 'p' AND y.k = 'p' AND EXISTS (SELECT 1 FROM m)
         UNION SELECT 'q', x.a, y.r, y.b FROM recurring.m x JOIN recurring.m y ON x.b = y.a WHERE x.k = 'p' AND y.k = 'q' AND EXISTS (SELECT 1 FROM m)
         UNION SELECT 'p', y.a, 0, t.b FROM recurring.m x JOIN nation ON n_nationkey = x.b JOIN recurring.m y ON y.b = x.a AND y.r = n_regionkey JOIN trade t ON t.a = x.b WHERE x.k = 'p' AND y.k = 'q' AND EXISTS (SELECT 1 FROM m)))
       SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM m WHERE k = 'p'""",
)
CALLS, REACHED, DISPATCH = _rel("Calls", 2), _rel("Reached", 1), _rel("Dispatch", 2)
query(
    "call_graph",
    [REACHED(x) <= NATION(x, Const(2)), DISPATCH(x, y) <= TRADE(x, y) & Filter(("x", "y"), "x % 5 < y % 5"), (REACHED(y) | CALLS(x, y)) <= REACHED(x) & DISPATCH(x, y)],
    CALLS, "a b",
    "WITH RECURSIVE p(a) AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT t.b FROM p JOIN trade t USING (a) WHERE t.a % 5 < t.b % 5) SELECT CAST(t.a AS BIGINT) AS a, CAST(t.b AS BIGINT) AS b FROM p JOIN trade t USING (a) WHERE t.a % 5 < t.b % 5",
)

# rewrites and hints leave results as they are

_SPLIT_SQL = "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS seller, o_custkey AS cust FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size > 40"
query("split_rule", [R2(n, c) <= LINE(o, p, u, _) & PART(p, _, z) & Filter(("z",), "z > 40") & SPLIT & SUPPLIER(u, n) & ORDERS(o, c, _)], R2, "seller cust", _SPLIT_SQL)
query("semi_join_rewrite", [(R2(n, c) <= LINE(o, p, u, _) & PART(p, _, z) & Filter(("z",), "z > 40") & SUPPLIER(u, n) & ORDERS(o, c, _)).with_semi_join()], R2, "seller cust", _SPLIT_SQL)
query("semi_join_of_three", [(R2(n, c) <= LINE(o, p, u, _) & ORDERS(o, c, Const("F")) & SUPPLIER(u, n) & SUPPLIES(u, p) & PART(p, _, Const(7))).with_semi_join()], R2, "seller cust", "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS seller, o_custkey AS cust FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size = 7 AND o_orderstatus = 'F'")
query("plan_hints", [(R2(n, c) <= LINE(o, p, u, _) & PART(p, _, z) & Filter(("z",), "z > 40") & SUPPLIER(u, n) & ORDERS(o, c, _)).with_plan(clause_order=(1, 0, 3, 4), dedup_hash=True, block_group=True)], R2, "seller cust", _SPLIT_SQL)
query("balanced_hint", [(R2(n, c) <= LINE(o, p, u, _) & PART(p, _, z) & Filter(("z",), "z > 40") & SUPPLIER(u, n) & ORDERS(o, c, _)).with_plan(balanced_root=("p",), balanced_sources=("Line",))], R2, "seller cust", _SPLIT_SQL)
query("var_order_hint", [(R2(n, c) <= LINE(o, p, u, _) & PART(p, _, z) & Filter(("z",), "z > 40") & SUPPLIER(u, n) & ORDERS(o, c, _)).with_plan(var_order=("u", "n", "p"))], R2, "seller cust", _SPLIT_SQL)


def _dataset_const(spark: SparkSession, sf: str) -> DataFrame:
    program = Program([R1(x) <= NATION(x, Const("AMERICA")) & Filter(("x",), "x != FIRST_NATION")])
    program = resolve_consts(program, {"AMERICA": 1, "FIRST_NATION": 1})
    return engine(spark, sf, program).run(program).named("Out", "nation")


QUERIES["dataset_const"] = _dataset_const
ORACLES["dataset_const"] = "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1"


def _delimited(sep: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Facts written as delimited text and read back by a program."""
        path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/quarrylog-{name}-{uuid.uuid4().hex}"
        _table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").select(F.concat_ws(sep, *("p_partkey", "p_brand", "p_size", "p_retailprice")).alias("value")).write.mode("overwrite").text(path)
        rel = _rel("PartFile", 3, (int, str, int), input_file="")
        program = Program([S2(x, y) <= rel(x, y, z) & Filter(("z",), "z >= 10 && z < 30")])
        return Engine(spark).load(rel, path).run(program).named("Out", "part", "brand")

    return run


for _sep, _name in (("\t", "facts_tab"), (",", "facts_comma"), ("   ", "facts_spaces")):
    QUERIES[_name] = _delimited(_sep, _name)
    ORACLES[_name] = "SELECT DISTINCT p_partkey AS part, p_brand AS brand FROM part WHERE p_size >= 10 AND p_size < 30"


def _prefix_range(spark: SparkSession, sf: str) -> DataFrame:
    program = Program([R2(x, y) <= SUPPLIES(x, y)])
    return engine(spark, sf, program).run(program).matching("Out", 7).toDF("supp", "part")


QUERIES["prefix_range"], ORACLES["prefix_range"] = _prefix_range, "SELECT DISTINCT l_suppkey AS supp, l_partkey AS part FROM lineitem WHERE l_suppkey = 7"


def _membership(spark: SparkSession, sf: str) -> DataFrame:
    program = Program([R2(x, y) <= NATION(x, y)])
    found = engine(spark, sf, program).run(program)
    return spark.createDataFrame([(p, found.contains("Out", *p)) for p in ((0, 0), (0, 99))], "pair struct<a:bigint,b:bigint>, there boolean").select("pair.a", "pair.b", "there")


QUERIES["membership"], ORACLES["membership"] = _membership, "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = a AND n_regionkey = b) AS there FROM (VALUES (0, 0), (0, 99)) AS v(a, b)"

# annotations


def annotated(name: str, ring: str, annotation: Callable[[], F.Column], sql: str, rounded: bool = False) -> None:
    supplies, parts, out = _rel("Supplies", 2, semiring=ring), _rel("Part", 2, semiring=ring), _rel("Out", 1, semiring=ring)
    program = Program([out(u) <= supplies(u, p) & parts(p, z) & Filter(("z",), "z < 10")])

    def run(spark: SparkSession, sf: str) -> DataFrame:
        lines, part = _table(spark, sf, "lineitem").withColumn("x", F.col("l_quantity")), _table(spark, sf, "part").withColumn("x", F.col("p_size"))
        made = Engine(spark).bind(supplies, lines, "l_suppkey", "l_partkey", annotation=annotation()).bind(parts, part, "p_partkey", "p_size", annotation=annotation())
        prov = F.round("prov", 6) if rounded else F.col("prov")
        return made.run(program).named("Out", "supp", "prov").select("supp", prov.alias("prov"))

    QUERIES[name], ORACLES[name] = run, sql


annotated("prov_bag", "NaturalBag", lambda: F.col("x").cast("long"), "SELECT l_suppkey AS supp, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS prov FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1")
annotated("prov_bool", "BooleanSR", lambda: F.col("x") > 5, "SELECT supp, bool_or(held AND p_size > 5) AS prov FROM (SELECT l_suppkey AS supp, l_partkey, bool_or(l_quantity > 5) AS held FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1")
annotated("prov_prob", "ProbIndep", lambda: F.col("x") / 1e4, "SELECT supp, round(1 - exp(sum(ln(1 - held * p_size / 1e4))), 6) AS prov FROM (SELECT l_suppkey AS supp, l_partkey, 1 - exp(sum(ln(1 - l_quantity / 1e4))) AS held FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1", rounded=True)
annotated("prov_latest_id", "EnhancedIDSR", lambda: F.col("x").cast("long"), "SELECT supp, max(greatest(held, CAST(p_size AS BIGINT))) AS prov FROM (SELECT l_suppkey AS supp, l_partkey, max(CAST(l_quantity AS BIGINT)) AS held FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
