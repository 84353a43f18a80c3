"""Registered tree queries and their oracle SQL.

Every query goes over its whole tables. Where an operator takes two or three trees, a table's rows are dealt to them by
blocks of a thousand keys, with blocks that several trees share; together they hold the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import awset
from ..functions.encoding import level_of
from ..operators import combine, pages, replicas
from ..operators import entries as reads
from ..operators.spec import TreeSpec
from ..operators.tree import MerkleTree
from ..sources.stores import SnapshotStore
from ..sources.tables import written
from ..streaming import gossip
from .oracle import tree, with_tree

ORDERS = TreeSpec(("o_orderkey",))
VALUES = TreeSpec(("o_orderkey",), ("o_custkey",), "max")
EVENTS = TreeSpec(("event_id",))
CUSTOMERS = TreeSpec(("c_custkey",))
#: A tree's share of the orders, by block of a thousand keys.
A, B = "(o_orderkey div 1000) % 3 <> 2", "(o_orderkey div 1000) % 3 <> 0"
A_SQL, B_SQL = A.replace(" div ", " // "), B.replace(" div ", " // ")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, where: str = "true", spec: TreeSpec = ORDERS) -> DataFrame:
    return reads.build(read(spark, sf_dir, "orders").where(where), spec)


def two(spark: SparkSession, sf_dir: str, spec: TreeSpec = ORDERS) -> DataFrame:
    """Trees a and b in one frame."""
    a, b = (orders(spark, sf_dir, w, spec).withColumn("tree", F.lit(n)) for n, w in (("a", A), ("b", B)))
    return a.unionByName(b)


ALL_SQL = "SELECT 0 AS tree, o_orderkey AS key, true AS value FROM orders"
TWO_SQL = f"SELECT 'a' AS tree, o_orderkey AS key, true AS value FROM orders WHERE {A_SQL} UNION ALL SELECT 'b', o_orderkey, true FROM orders WHERE {B_SQL}"


# Levels and puts.
@query("mst_level", f"WITH {tree('t', ALL_SQL)} SELECT key, level FROM t_e")
def mst_level(spark, sf_dir):
    return orders(spark, sf_dir).select("key", level_of(F.col("key").cast("string")).alias("level"))


@query("mst_level_hist", f"WITH {tree('t', ALL_SQL)} SELECT level, count(*) AS n FROM t_e GROUP BY level")
def mst_level_hist(spark, sf_dir):
    return mst_level(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query("mst_put_set", "SELECT DISTINCT l_orderkey AS key, true AS value FROM lineitem")
def mst_put_set(spark, sf_dir):
    return reads.build(read(spark, sf_dir, "lineitem"), TreeSpec(("l_orderkey",)))


@query("mst_put_max", "SELECT l_orderkey AS key, max(l_partkey) AS value FROM lineitem GROUP BY 1")
def mst_put_max(spark, sf_dir):
    return reads.build(read(spark, sf_dir, "lineitem"), TreeSpec(("l_orderkey",), ("l_partkey",), "max"))


@query("mst_put_min", "SELECT l_orderkey AS key, min(l_partkey) AS value FROM lineitem GROUP BY 1")
def mst_put_min(spark, sf_dir):
    return reads.build(read(spark, sf_dir, "lineitem"), TreeSpec(("l_orderkey",), ("l_partkey",), "min"))


@query("mst_put_lww", "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def mst_put_lww(spark, sf_dir):
    found = reads.build(read(spark, sf_dir, "events"), TreeSpec(("user_id",), ("ts", "event_id", "event_type"), "lww"))
    return found.select("key", F.col("value.event_type").alias("value"))


@query("mst_put_set_union", "SELECT user_id AS key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS value FROM events GROUP BY 1")
def mst_put_set_union(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("types", F.array("event_type"))
    return reads.build(rows, TreeSpec(("user_id",), ("types",), "set_union")).select("key", F.array_join("value", ",").alias("value"))


@query("mst_put_counter", "SELECT user_id AS key, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type, max(event_id) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def mst_put_counter(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("n")).withColumn("seen", F.create_map("event_type", "n"))
    found = reads.build(rows, TreeSpec(("user_id",), ("seen",), "counter_max"))
    return found.select("key", F.aggregate(F.map_values("value"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total"))


@query("mst_put_batch", "SELECT o_orderkey AS key, max(o_custkey) AS value FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def mst_put_batch(spark, sf_dir):
    batch = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey key", "l_partkey value")
    return reads.put(orders(spark, sf_dir, spec=VALUES), batch, VALUES)


@query("mst_composite", "SELECT l_orderkey AS o, l_linenumber AS l, max(l_partkey) AS value FROM lineitem GROUP BY 1, 2")
def mst_composite(spark, sf_dir):
    found = reads.build(read(spark, sf_dir, "lineitem"), TreeSpec(("l_orderkey", "l_linenumber"), ("l_partkey",), "max"))
    return found.select(F.col("key.l_orderkey").alias("o"), F.col("key.l_linenumber").alias("l"), "value")


# Reads.
@query("mst_get", "SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey = 1234")
def mst_get(spark, sf_dir):
    return reads.get(orders(spark, sf_dir, spec=VALUES), 1234)


@query("mst_multiget", "SELECT k AS key, coalesce(o_custkey, -1) AS value FROM (SELECT DISTINCT l_partkey * 10 AS k FROM lineitem) LEFT JOIN orders ON o_orderkey = k")
def mst_multiget(spark, sf_dir):
    wanted = read(spark, sf_dir, "lineitem").selectExpr("l_partkey * 10 key").distinct()
    return reads.multi_get(orders(spark, sf_dir, spec=VALUES), wanted).select("key", F.coalesce("value", F.lit(-1)).alias("value"))


@query("mst_first", "SELECT o_orderkey AS key, o_custkey AS value FROM orders ORDER BY 1 LIMIT 1")
def mst_first(spark, sf_dir):
    return reads.first(orders(spark, sf_dir, spec=VALUES))


@query("mst_last", "SELECT o_orderkey AS key, o_custkey AS value FROM orders ORDER BY 1 DESC LIMIT 1")
def mst_last(spark, sf_dir):
    return reads.last(orders(spark, sf_dir, spec=VALUES))


@query("mst_last_n", "SELECT o_orderkey AS key, o_custkey AS value FROM orders ORDER BY 1 DESC LIMIT 100")
def mst_last_n(spark, sf_dir):
    return reads.last_n(orders(spark, sf_dir, spec=VALUES), 100)


@query("mst_last_n_bound", "SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey < 777 ORDER BY 1 DESC LIMIT 100")
def mst_last_n_bound(spark, sf_dir):
    return reads.last_n(orders(spark, sf_dir, spec=VALUES), 100, 777)


@query("mst_to_list", "SELECT row_number() OVER (ORDER BY c_custkey) AS pos, c_custkey AS key, c_nationkey AS value FROM customer")
def mst_to_list(spark, sf_dir):
    return reads.positions(reads.build(read(spark, sf_dir, "customer"), TreeSpec(("c_custkey",), ("c_nationkey",), "max")))


@query("mst_keys", "SELECT c_custkey AS key FROM customer")
def mst_keys(spark, sf_dir):
    return reads.keys(reads.build(read(spark, sf_dir, "customer"), CUSTOMERS))


@query("mst_range", "SELECT c_custkey AS key, true AS value FROM customer WHERE c_custkey BETWEEN 50 AND 120")
def mst_range(spark, sf_dir):
    return reads.key_range(reads.build(read(spark, sf_dir, "customer"), CUSTOMERS), 50, 120)


@query("mst_fold_sum", "SELECT sum(o_custkey)::BIGINT AS total, count(*) AS n, max(o_orderkey) AS last_key FROM orders")
def mst_fold_sum(spark, sf_dir):
    return reads.fold(orders(spark, sf_dir, spec=VALUES), F.sum("value").alias("total"), F.count("*").alias("n"), F.max("key").alias("last_key"))


@query("mst_fold_limit", "SELECT string_agg(o_orderkey::VARCHAR || ':' || o_custkey::VARCHAR, ',' ORDER BY o_orderkey) AS result FROM (SELECT * FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50)")
def mst_fold_limit(spark, sf_dir):
    step = lambda acc, e: F.concat(acc, F.when(acc != "", ",").otherwise(""), e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))
    return reads.fold_ordered(orders(spark, sf_dir, spec=VALUES), F.lit(""), step, first=100, limit=50)


@query("mst_fold_match", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_custkey < 50 AND o_orderkey <= 9000")
def mst_fold_match(spark, sf_dir):
    return reads.fold(orders(spark, sf_dir, spec=VALUES), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), match="value < 50", stop=9000)


@query("mst_fold_keys_only", "SELECT sum(o_orderkey)::BIGINT AS total FROM orders")
def mst_fold_keys_only(spark, sf_dir):
    return reads.fold(orders(spark, sf_dir, spec=VALUES), F.sum("key").alias("total"), keys_only=True)


@query("mst_foreach_count", "SELECT count(*) AS n FROM orders")
def mst_foreach_count(spark, sf_dir):
    n = reads.foreach(orders(spark, sf_dir), lambda row: None, ordered=False)
    return spark.createDataFrame([(n,)], "n long")


# Two and more trees.
@query("mst_merge_set", "SELECT o_orderkey AS key, true AS value FROM orders")
def mst_merge_set(spark, sf_dir):
    return combine.merge(ORDERS, orders(spark, sf_dir, A), orders(spark, sf_dir, B))


CHANGED = "CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END"


def changed(spark, sf_dir, where: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where(where).selectExpr("o_orderkey", f"{CHANGED} o_custkey")
    return reads.build(rows, VALUES)


@query("mst_merge_max", f"SELECT key, max(value) AS value FROM (SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE {A_SQL} UNION ALL SELECT o_orderkey, {CHANGED} FROM orders WHERE {B_SQL}) GROUP BY key")
def mst_merge_max(spark, sf_dir):
    return combine.merge(VALUES, orders(spark, sf_dir, A, VALUES), changed(spark, sf_dir, B))


@query("mst_merge_3way", "SELECT key, max(value) AS value FROM (SELECT o_orderkey AS key, o_custkey AS value FROM orders UNION ALL SELECT l_orderkey, l_partkey FROM lineitem UNION ALL SELECT c_custkey, c_custkey FROM customer) GROUP BY key")
def mst_merge_3way(spark, sf_dir):
    lines = reads.build(read(spark, sf_dir, "lineitem"), TreeSpec(("l_orderkey",), ("l_partkey",), "max"))
    customers = reads.build(read(spark, sf_dir, "customer").withColumn("v", F.col("c_custkey")), TreeSpec(("c_custkey",), ("v",), "max"))
    return combine.merge(VALUES, orders(spark, sf_dir, spec=VALUES), lines, customers)


def diff_sql(a: str, b: str, value_a: str = "true", value_b: str = "true") -> str:
    return f"SELECT o_orderkey AS key, {value_a} AS value FROM orders x WHERE {a} AND NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey AS k, {value_b} AS v FROM orders WHERE {b}) y WHERE y.k = x.o_orderkey AND y.v IS NOT DISTINCT FROM {value_a})"


@query("mst_diff_ab", diff_sql(A_SQL, B_SQL))
def mst_diff_ab(spark, sf_dir):
    return combine.diff(orders(spark, sf_dir, A), orders(spark, sf_dir, B))


@query("mst_diff_ba", diff_sql(B_SQL, A_SQL))
def mst_diff_ba(spark, sf_dir):
    return combine.diff(orders(spark, sf_dir, B), orders(spark, sf_dir, A))


@query("mst_diff_value", diff_sql(A_SQL, "true", "o_custkey", CHANGED))
def mst_diff_value(spark, sf_dir):
    return combine.diff(orders(spark, sf_dir, A, VALUES), changed(spark, sf_dir, "true"))


@query("mst_diff_pruned", diff_sql(A_SQL, B_SQL))
def mst_diff_pruned(spark, sf_dir):
    built = written(pages.pages(two(spark, sf_dir)), "two")
    return combine.diff_pages(built.where("tree = 'a'"), built.where("tree = 'b'"))


@query("mst_merge_pruned", "SELECT o_orderkey AS key, true AS value FROM orders")
def mst_merge_pruned(spark, sf_dir):
    built = written(pages.pages(two(spark, sf_dir)), "two")
    return combine.merge_pages(ORDERS, built.where("tree = 'a'"), built.where("tree = 'b'"))


@query("mst_intersect", f"SELECT o_orderkey AS key, true AS value FROM orders WHERE {A_SQL} AND {B_SQL}")
def mst_intersect(spark, sf_dir):
    return combine.intersect(orders(spark, sf_dir, A), orders(spark, sf_dir, B))


# Pages.
@query("mst_pages", with_tree(ALL_SQL, "SELECT level, prev::VARCHAR AS before_key, nxt::VARCHAR AS after_key, first_key, last_key, n_entries FROM t_pages"))
def mst_pages(spark, sf_dir):
    found = pages.outline(orders(spark, sf_dir)).drop("tree")
    return found.withColumns({c: F.col(c).cast("string") for c in ("before_key", "after_key")})


@query("mst_fold_pages", with_tree(ALL_SQL, "SELECT row_number() OVER (ORDER BY first_key) AS pos, level, first_key, n_entries FROM t_pages"))
def mst_fold_pages(spark, sf_dir):
    walk = pages.outline(orders(spark, sf_dir)).select(F.col("first_key").alias("key"), F.struct("level", "n_entries").alias("value"))
    return reads.positions(walk).select("pos", "value.level", F.col("key").alias("first_key"), "value.n_entries")


@query("mst_parents", with_tree(ALL_SQL, "SELECT c.hash AS child, p.hash AS parent, CASE WHEN c.low_of IS NOT NULL THEN 'low' WHEN c.after_key IS NOT NULL THEN 'after' ELSE 'root' END AS slot FROM t_pages c LEFT JOIN (SELECT s.key, g.hash FROM t_s s JOIN t_pages g ON g.level = s.level AND g.prev IS NOT DISTINCT FROM s.prev) p ON p.key = coalesce(c.low_of, c.after_key)"))
def mst_parents(spark, sf_dir):
    return pages.parents(pages.pages(orders(spark, sf_dir)))


@query("mst_refs", with_tree(ALL_SQL, "SELECT hash AS parent, low AS child, 0 AS pos FROM t_pages WHERE low IS NOT NULL UNION ALL SELECT hash, child, pos::INT FROM (SELECT hash, unnest(nexts) AS child, generate_subscripts(nexts, 1) AS pos FROM t_pages) WHERE child IS NOT NULL"))
def mst_refs(spark, sf_dir):
    return pages.refs(pages.pages(orders(spark, sf_dir)))


@query("mst_page_hash", with_tree("SELECT 0 AS tree, o_orderkey AS key, o_custkey AS value FROM orders", "SELECT hash, level, low, first_key, n_entries FROM t_pages"))
def mst_page_hash(spark, sf_dir):
    return pages.pages(orders(spark, sf_dir, spec=VALUES)).select("hash", "level", "low", "first_key", F.size("entries").cast("bigint").alias("n_entries"))


@query("mst_root", with_tree(ALL_SQL, "SELECT root FROM t_roots"))
def mst_root(spark, sf_dir):
    return pages.tree_roots(orders(spark, sf_dir)).select("root")


DEPTH = """, d AS (
    WITH RECURSIVE walk AS (
        SELECT hash, 0 AS depth FROM t_pages WHERE low_of IS NULL AND after_key IS NULL
        UNION ALL
        SELECT c.child, w.depth + 1 FROM walk w JOIN (SELECT hash AS parent, low AS child FROM t_pages WHERE low IS NOT NULL UNION ALL SELECT hash, unnest(nexts) FROM t_pages) c ON c.parent = w.hash WHERE c.child IS NOT NULL
    ) SELECT * FROM walk
)"""


@query("mst_dump", f"WITH {tree('t', 'SELECT 0 AS tree, n_nationkey AS key, n_name AS value FROM nation')}{DEPTH} SELECT first_key, depth, repeat('  ', depth) || substr(t_pages.hash, 1, 8) || ' (' || level::VARCHAR || '): ' || listing AS line FROM t_pages JOIN d ON d.hash = t_pages.hash")
def mst_dump(spark, sf_dir):
    return pages.dump(pages.pages(reads.build(read(spark, sf_dir, "nation"), TreeSpec(("n_nationkey",), ("n_name",), "max"))))


# Stores.
def stored(spark, sf_dir) -> tuple[SnapshotStore, DataFrame, dict[str, str]]:
    """A store with the pages of both trees, these pages, and their roots."""
    built = written(pages.pages(two(spark, sf_dir)), "two")
    store = SnapshotStore(spark)
    store.put(built)
    return store, built, {r.tree: r.root for r in pages.roots(built).collect()}


@query("mst_has", with_tree(TWO_SQL, "SELECT DISTINCT a.hash FROM t_pages a JOIN t_pages b ON a.hash = b.hash AND a.tree = 'a' AND b.tree = 'b'"))
def mst_has(spark, sf_dir):
    built = written(pages.pages(two(spark, sf_dir)), "two")
    store = SnapshotStore(spark)
    store.put(built.where("tree = 'b'"))
    return store.has(built.where("tree = 'a'"))


@query("mst_missing_set", with_tree(ALL_SQL, "SELECT hash FROM t_pages WHERE level = 0"))
def mst_missing_set(spark, sf_dir):
    built = written(pages.pages(orders(spark, sf_dir)), "built")
    store = SnapshotStore(spark)
    store.put(built.where("level > 0"))  # a replica that has fetched all but the lowest pages
    return store.missing_set(pages.roots(built).first().root)


@query("mst_copy", with_tree(TWO_SQL, "SELECT DISTINCT hash, level FROM t_pages"))
def mst_copy(spark, sf_dir):
    _, built, roots = stored(spark, sf_dir)
    one, other = SnapshotStore(spark), SnapshotStore(spark)
    one.put(built.where("tree = 'a'"))
    other.put(built.where("tree = 'b'"))
    other.copy(one, roots["a"])
    return other.list().select("hash", "level")


@query("mst_list_root", with_tree(TWO_SQL, "SELECT hash, level FROM t_pages WHERE tree = 'a'"))
def mst_list_root(spark, sf_dir):
    store, _, roots = stored(spark, sf_dir)
    return store.list_root(roots["a"]).select("hash", "level")


# Versions: three commits, each of the events so far.
VERSIONS_SQL = "SELECT v AS tree, event_id AS key, true AS value FROM events, (VALUES (1), (2), (3)) AS n(v) WHERE event_id % 3 < v"


def versions(spark, sf_dir) -> tuple[SnapshotStore, list[str]]:
    """A store after three commits, and the roots of them."""
    rows = reads.build(read(spark, sf_dir, "events"), EVENTS)
    grown = rows.withColumn("tree", F.explode(F.sequence(F.expr("cast(key % 3 + 1 as int)"), F.lit(3))))
    built = written(pages.pages(grown), "versions")
    roots = {r.tree: r.root for r in pages.roots(built).collect()}
    store = SnapshotStore(spark)
    for v in (1, 2, 3):
        now = built.where(F.col("tree") == v)
        with store.transaction():
            store.put(now)
            store.set_root(roots[v])
            if v > 1:
                store.free(built.where(F.col("tree") == v - 1).select("hash").join(now.select("hash"), "hash", "left_anti"))
    return store, [roots[v] for v in (1, 2, 3)]


@query("mst_snapshot_read", "SELECT v AS version, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events, (VALUES (1), (2), (3)) AS x(v) WHERE event_id % 3 < v GROUP BY v")
def mst_snapshot_read(spark, sf_dir):
    store, roots = versions(spark, sf_dir)
    found = [store.entries(r).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")) for v, r in enumerate(roots, 1)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("mst_gc_epoch", with_tree(VERSIONS_SQL, "SELECT DISTINCT hash FROM t_pages WHERE tree > 1"))
def mst_gc_epoch(spark, sf_dir):
    store, _ = versions(spark, sf_dir)
    store.gc(epoch=2)
    return store.list().select("hash")


@query("mst_gc_keep", with_tree(VERSIONS_SQL, "SELECT DISTINCT hash FROM t_pages WHERE tree <> 2"))
def mst_gc_keep(spark, sf_dir):
    store, roots = versions(spark, sf_dir)
    store.gc(keep=[roots[0], roots[2]])
    return store.list().select("hash")


@query("mst_is_referenced", with_tree(VERSIONS_SQL, "SELECT hash, max(tree) > 1 AS referenced FROM t_pages GROUP BY hash"))
def mst_is_referenced(spark, sf_dir):
    return versions(spark, sf_dir)[0].is_referenced_at(3)


# Replicas.
REPLICAS = "if(o_orderkey % 10 = 0, array(0, 1, 2), array(cast(o_orderkey % 3 as int)))"
REPLICAS_SQL = "SELECT r, o_orderkey FROM orders, (VALUES (0), (1), (2)) AS x(r) WHERE o_orderkey % 10 = 0 OR o_orderkey % 3 = r"


def dealt(spark, sf_dir) -> DataFrame:
    """Orders on three replicas, a tenth of them on all."""
    return read(spark, sf_dir, "orders").select(F.expr(f"explode({REPLICAS})").alias("replica"), F.col("o_orderkey").alias("key"), F.lit(True).alias("value"))


@query("grove_converged_roots", with_tree(ALL_SQL, "SELECT r AS replica, root, (SELECT count(*) FROM orders) AS n_entries FROM t_roots, (VALUES (0), (1), (2)) AS x(r)"))
def grove_converged_roots(spark, sf_dir):
    whole = written(replicas.converged(dealt(spark, sf_dir)), "converged")
    return replicas.replica_roots(whole).join(whole.groupBy("replica").agg(F.count("*").alias("n_entries")), "replica")


ROUNDS_SQL = f"""SELECT 10 + r AS tree, o_orderkey AS key, true AS value FROM ({REPLICAS_SQL})
UNION ALL SELECT DISTINCT 20 + x.t, o_orderkey, true FROM ({REPLICAS_SQL}) q, (VALUES (0), (1), (2)) AS x(t) WHERE q.r = x.t OR q.r = (x.t + 1) % 3
UNION ALL SELECT DISTINCT 30 + x.t, o_orderkey, true FROM ({REPLICAS_SQL}) q, (VALUES (0), (1), (2)) AS x(t)"""


@query("grove_rounds", with_tree(ROUNDS_SQL, "SELECT (r.tree // 10 - 1)::INT AS round, (r.tree % 10)::INT AS replica, n AS n_entries, root FROM t_roots r JOIN (SELECT tree, count(*) AS n FROM t_e GROUP BY tree) c ON c.tree = r.tree"))
def grove_rounds(spark, sf_dir):
    return replicas.anti_entropy(dealt(spark, sf_dir))[1]


CUSTOMERS_SQL = "SELECT 0 AS tree, c_custkey AS key, true AS value FROM customer"
GROUP_SQL = with_tree(CUSTOMERS_SQL, "SELECT 'p' || r AS replica, (SELECT count(*) FROM customer) AS n_entries, root FROM t_roots, (VALUES (1), (2), (3)) AS x(r)")


def group(spark, spec: TreeSpec = CUSTOMERS) -> tuple[replicas.LocalNetwork, list[replicas.Replica]]:
    network = replicas.LocalNetwork()
    members = [replicas.Replica(spark, f"p{i}", network.port(f"p{i}"), spec) for i in (1, 2, 3)]
    for m in members:
        network.join(m)
    return network, members


def state(spark, members: list[replicas.Replica]) -> DataFrame:
    return spark.createDataFrame([(m.node_id, m.tree.entries().count(), m.root()) for m in members], "replica string, n_entries long, root string")


@query("grove_online", GROUP_SQL)
def grove_online(spark, sf_dir):
    """Two replicas put a half each, and gossip carries the pairs."""
    network, members = group(spark)
    rows = read(spark, sf_dir, "customer")
    for m, where in zip(members, ("c_custkey % 2 = 0", "c_custkey % 2 = 1"), strict=False):
        m.put(rows.where(where))
        network.run()
    return state(spark, members)


@query("grove_anti_entropy", GROUP_SQL)
def grove_anti_entropy(spark, sf_dir):
    """One replica is full; the others join late and are triggered."""
    network, members = group(spark)
    members[0].put(read(spark, sf_dir, "customer"), broadcast=False)
    for peer in ("p2", "p3"):
        members[0].trigger(peer)
    network.run()
    return state(spark, members)


@query("grove_bidirectional", GROUP_SQL)
def grove_bidirectional(spark, sf_dir):
    """An empty replica triggers a full one, which then brings the third."""
    network, members = group(spark)
    members[1].put(read(spark, sf_dir, "customer"), broadcast=False)
    members[0].trigger("p2")
    network.run()
    members[1].trigger("p3")
    network.run()
    return state(spark, members)


@query("grove_awset", "SELECT user_id AS key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS elements, count(DISTINCT event_id % 3)::INT AS actors FROM events GROUP BY 1")
def grove_awset(spark, sf_dir):
    """Each user's event types as an add-wins set, with three replicas as actors."""
    rows = read(spark, sf_dir, "events").withColumn("actor", (F.col("event_id") % 3).cast("string"))
    # What one actor adds to a key has consecutive counts; only the last dot of an element stays.
    dots = rows.groupBy("user_id", "actor", "event_type").agg(F.max("event_id").alias("ctr"))
    local = dots.groupBy("user_id", "actor").agg(F.struct(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("elem"), F.col("actor").alias("actor"), F.col("ctr").alias("ctr")))).alias("dots"), F.array(F.struct(F.first("actor").alias("actor"), F.max("ctr").alias("ctr"))).alias("ctx")).alias("set"))
    merged = reads.build(local, TreeSpec(("user_id",), ("set",), "awset"))
    return merged.select("key", F.array_join(awset.elements(F.col("value")), ",").alias("elements"), F.size("value.ctx").alias("actors"))


UNION_SQL = "SELECT 0 AS tree, user_id AS key, list_sort(list(DISTINCT event_type)) AS value FROM events GROUP BY user_id"
UNION_TEXT = "'[' || list_reduce(list_transform(value, lambda x: '\"' || x || '\"'), lambda a, b: a || ',' || b) || ']'"
COUNTER_SQL = "SELECT 0 AS tree, user_id AS key, list({'k': event_type, 'n': n} ORDER BY event_type) AS value FROM (SELECT user_id, event_type, max(event_id) AS n FROM events GROUP BY ALL) GROUP BY user_id"
COUNTER_TEXT = "'[' || list_reduce(list_transform(value, lambda x: '{\"key\":\"' || x.k || '\",\"value\":' || x.n || '}'), lambda a, b: a || ',' || b) || ']'"
PAIR_SQL = "SELECT 'p' || r AS replica, (SELECT count(*) FROM t_e) AS n_entries, root FROM t_roots, (VALUES (1), (2)) AS x(r)"


def exchanged(spark, parts: list[DataFrame], spec: TreeSpec) -> DataFrame:
    """Two replicas with a part each, after the first has triggered the second."""
    network, members = group(spark, spec)
    network.members.pop("p3")
    for m, part in zip(members, parts, strict=False):
        m.put(part, broadcast=False)
    members[0].trigger("p2")
    network.run()
    return state(spark, members[:2])


@query("grove_set_union", with_tree(UNION_SQL, PAIR_SQL, value_text=UNION_TEXT))
def grove_set_union(spark, sf_dir):
    """Array values travel as pages and are merged."""
    rows = read(spark, sf_dir, "events").withColumn("types", F.array("event_type"))
    return exchanged(spark, [rows.where(f"event_id % 2 = {i}") for i in (0, 1)], TreeSpec(("user_id",), ("types",), "set_union"))


@query("grove_counter", with_tree(COUNTER_SQL, PAIR_SQL, value_text=COUNTER_TEXT))
def grove_counter(spark, sf_dir):
    """Map values travel as pages and are merged; a root doesn't depend on the order within a map."""
    rows = read(spark, sf_dir, "events").withColumn("seen", F.create_map("event_type", "event_id"))
    return exchanged(spark, [rows.where(f"event_id % 2 = {i}") for i in (0, 1)], TreeSpec(("user_id",), ("seen",), "counter_max"))


DOWN = TreeSpec(("o_orderkey",), ("o_custkey",), "max", sort_key="-key")


@query("mst_sort_key", "SELECT string_agg(key::VARCHAR || ':' || value::VARCHAR, ',' ORDER BY key DESC) AS result FROM (SELECT o_orderkey AS key, max(o_custkey) AS value FROM orders WHERE o_orderkey BETWEEN 40 AND 90 GROUP BY 1)")
def mst_sort_key(spark, sf_dir):
    """An ordered fold in a configured order, from 90 down to 40."""
    step = lambda acc, e: F.concat(acc, F.when(acc != "", ",").otherwise(""), e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))
    return reads.fold_ordered(orders(spark, sf_dir, spec=DOWN), F.lit(""), step, first=90, stop=40, spec=DOWN)


@query("mst_tree_get", "SELECT what, o_orderkey AS key, o_custkey AS value FROM orders JOIN (VALUES ('get', 1234, 1234), ('range', 50, 120)) AS x(what, lo, hi) ON o_orderkey BETWEEN lo AND hi UNION ALL SELECT 'first', min(o_orderkey), arg_min(o_custkey, o_orderkey) FROM orders UNION ALL SELECT 'last', max(o_orderkey), arg_max(o_custkey, o_orderkey) FROM orders")
def mst_tree_get(spark, sf_dir):
    """Reads through a tree's pages."""
    held = MerkleTree(spark, VALUES)
    held.put(read(spark, sf_dir, "orders"))
    found = {"get": held.get(1234), "range": held.range(50, 120), "first": held.first(), "last": held.last()}
    parts = [df.select(F.lit(name).alias("what"), "key", "value") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query("grove_stream_spread", "SELECT r AS replica, user_id AS key, max(event_id) AS value FROM events, (VALUES (0), (1), (2)) AS x(r) GROUP BY 1, 2")
def grove_stream_spread(spark, sf_dir):
    """What is put at one replica reaches all."""
    table = read(spark, sf_dir, "events")
    events = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    puts = events.selectExpr("cast(event_id % 3 as int) replica", "user_id key", "event_id value")
    return gossip.final_state(gossip.spread(puts, [0, 1, 2]), "max")


@query("grove_stream", "SELECT (event_id % 3)::INT AS replica, user_id AS key, max(event_id) AS value FROM events GROUP BY 1, 2")
def grove_stream(spark, sf_dir):
    table = read(spark, sf_dir, "events")
    events = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    return gossip.final_state(events.selectExpr("cast(event_id % 3 as int) replica", "user_id key", "event_id value"), "max")
