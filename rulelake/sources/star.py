"""The relations of a rulebase derived from the star schema, so that every operator runs at the tables' scale.

Rules are suppliers and queries are customers. Types: part <: kind (brand and size) <: brand. Of items of 40 or more, a
supplier inserts the parts of first and second lines (flag N), retracts those of first lines (R) and reads the kinds of first
lines (A); customers read kinds of the second lines of their orders (A). By their keys a fifth of suppliers insert nothing, a
third retract nothing, a quarter read nothing, and an eleventh make only parts of sizes that nobody reads, so that every
kind of rule occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def kind() -> Column:
        return F.concat(F.lit("kind:"), "p_brand", F.lit("/"), F.col("p_size").cast("string"))

    def usage(self) -> DataFrame:
        """prod, role, type; one scan of line items for suppliers, one for customers."""
        part = self.table("part").select("p_partkey", "p_size", self.kind().alias("kind"))
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag").filter("l_quantity >= 40").join(part, F.col("l_partkey") == F.col("p_partkey"))
        flag, line, key = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_suppkey")
        makes = (key % 11 != 0) | (F.col("p_size") > 45)
        reads = F.col("p_size") <= 45
        role = F.when((flag == "N") & (line <= 2) & (key % 5 != 1) & makes, "insert").when((flag == "R") & (line == 1) & (key % 3 != 0) & makes, "retract").when((flag == "A") & (line == 1) & (key % 4 != 2) & reads, "consume")
        kind = F.when(role == "consume", F.col("kind")).otherwise(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))
        rules = items.select(F.concat(F.lit("rule/"), F.col("l_suppkey").cast("string")).alias("prod"), role.alias("role"), kind.alias("type")).filter("role is not null")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        reads = items.filter((line == 2) & (flag == "A") & reads).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        queries = reads.select(F.concat(F.lit("query/"), F.col("o_custkey").cast("string")).alias("prod"), F.lit("consume").alias("role"), F.col("kind").alias("type"))
        return rules.unionByName(queries).distinct()

    def ancestors(self) -> DataFrame:
        part = self.table("part")
        pair = lambda a, b: F.struct(a.alias("type"), b.alias("ancestor"))
        p, k, b = F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), self.kind(), F.concat(F.lit("brand:"), F.col("p_brand"))
        return part.select(F.explode(F.array(pair(p, k), pair(p, b), pair(k, b))).alias("e")).select("e.*").distinct()

    def types(self) -> DataFrame:
        a = self.ancestors()
        return a.select("type").unionByName(a.select(F.col("ancestor").alias("type"))).distinct()

    def productions(self) -> DataFrame:
        s = self.table("supplier").select(F.concat(F.lit("rule/"), F.col("s_suppkey").cast("string")).alias("prod"), F.lit("rule").alias("kind"))
        return s.unionByName(self.table("customer").select(F.concat(F.lit("query/"), F.col("c_custkey").cast("string")).alias("prod"), F.lit("query").alias("kind")))

    def entries(self) -> DataFrame:
        """Layer entries: users are rules, event types keys, events layers; an error is a tombstone."""
        e = self.table("events")
        return e.select(F.concat(F.lit("rule/"), F.col("user_id").cast("string")).alias("rule"), F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")).alias("key"), F.col("event_id").alias("pos"), F.concat(F.lit("layer-"), (F.col("event_id") % 7).cast("string")).alias("layer"), F.floor(F.col("value") / 10).cast("long").cast("string").alias("value"), (F.col("event_type") == "error").alias("tombstone"))

    def names(self) -> tuple[DataFrame, DataFrame]:
        """What the namespaces r0 to r4 know of parts: P<key> is imported everywhere, but defined in r1 (even keys: as the kind; every
        tenth: as nothing); lib is an alias of shared, which defines P<key> as the kind."""
        p, kind = self.table("part"), self.kind()
        key = F.col("p_partkey")
        row = lambda ns, kind, value: F.struct(F.lit(ns).alias("ns"), F.concat(F.lit("P"), key.cast("string")).alias("symbol"), F.lit(kind).alias("kind"), value.alias("resolved"))
        part = F.concat(F.lit("part:"), key.cast("string"))
        rows = F.array(*[row(f"r{i}", "import", part) for i in range(5)], row("shared", "define", kind), F.when(key % 2 == 0, row("r1", "define", F.when(key % 10 != 0, kind))))
        aliases = self.spark.createDataFrame([(f"r{i}", "lib", "shared") for i in range(5)], "ns string, alias string, target string")
        return p.select(F.explode(F.array_compact(rows)).alias("b")).select("b.*"), aliases

    def calls(self) -> DataFrame:
        """Parts as functions in groups of 50: each calls the next one and the seventh next, so that walks are long and meet again."""
        p = F.col("p_partkey")
        name = lambda c: F.concat(F.lit("f"), F.lpad(c.cast("string"), 9, "0"))
        steps = F.filter(F.array(F.lit(1), F.lit(7)), lambda k: p % 50 + k < 50)
        return self.table("part").select(name(p).alias("caller"), F.explode(F.transform(steps, lambda k: name(p + k))).alias("callee"))

    def sites(self) -> DataFrame:
        """Callsites: users are rules, whole values ids, event_id % 7 the layer. Lower layers know the source, all but sign-ups conclude."""
        e = self.table("events")
        pos, kind = F.col("event_id") % 7, F.col("event_type")
        pairs = F.array(F.struct(F.lit("source-str").alias("k"), F.when(pos < 2, F.col("props")).alias("v")), F.struct(F.lit("status").alias("k"), F.when(kind == "purchase", "full").when(kind == "error", "none").when(kind != "signup", "partial").alias("v")), F.struct(F.lit("resolved-types").alias("k"), F.when(kind != "signup", F.concat(F.lit('["'), kind, F.lit('"]'))).alias("v")))
        fields = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
        dim = F.when(F.col("event_id") % 2 == 0, "insert").otherwise("retract")
        return e.select(F.concat(F.lit("rule/"), F.col("user_id").cast("string")).alias("rule"), dim.alias("dim"), pos.cast("int").alias("layer_pos"), F.concat(F.lit("layer-"), pos.cast("string")).alias("layer"), F.col("event_id").alias("idx"), F.floor("value").cast("long").cast("string").alias("callsite_id"), fields.alias("fields"))


#: The same relations for DuckDB.
CTE = """
items AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS n, l_returnflag AS f, p_size, 'kind:' || p_brand || '/' || p_size AS kind, l_suppkey % 11 <> 0 OR p_size > 45 AS makes FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40),
usage AS (
  SELECT DISTINCT 'rule/' || l_suppkey AS prod, CASE WHEN f = 'N' THEN 'insert' WHEN f = 'R' THEN 'retract' ELSE 'consume' END AS role, CASE WHEN f = 'A' THEN kind ELSE 'part:' || l_partkey END AS type
  FROM items WHERE (f = 'N' AND n <= 2 AND l_suppkey % 5 <> 1 AND makes) OR (f = 'R' AND n = 1 AND l_suppkey % 3 <> 0 AND makes) OR (f = 'A' AND n = 1 AND l_suppkey % 4 <> 2 AND p_size <= 45)
  UNION SELECT 'query/' || o_custkey, 'consume', kind FROM items JOIN orders ON l_orderkey = o_orderkey WHERE n = 2 AND f = 'A' AND p_size <= 45),
ancestors AS (SELECT 'part:' || p_partkey AS type, 'kind:' || p_brand || '/' || p_size AS ancestor FROM part UNION SELECT 'part:' || p_partkey, 'brand:' || p_brand FROM part UNION SELECT 'kind:' || p_brand || '/' || p_size, 'brand:' || p_brand FROM part),
types AS (SELECT type FROM ancestors UNION SELECT ancestor FROM ancestors),
up AS (SELECT type, type AS up FROM types UNION SELECT type, ancestor FROM ancestors),
productions AS (SELECT 'rule/' || s_suppkey AS prod, 'rule' AS kind FROM supplier UNION ALL SELECT 'query/' || c_custkey, 'query' FROM customer),
matches AS (SELECT m.prod AS producer, c.prod AS consumer, m.type AS ptype, c.type AS ctype, CASE WHEN m.r THEN 'retract' ELSE 'insert' END AS via FROM (SELECT prod, type, bool_or(role = 'retract') AS r FROM usage WHERE role <> 'consume' GROUP BY ALL) m JOIN up USING (type) JOIN (SELECT DISTINCT prod, type FROM usage WHERE role = 'consume') c ON c.type = up.up WHERE m.prod <> c.prod),
edges AS (SELECT DISTINCT producer, consumer FROM matches),
entries AS (SELECT 'rule/' || user_id AS rule, CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS key, event_id AS pos, 'layer-' || (event_id % 7) AS layer, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value, event_type = 'error' AS tombstone FROM events),
raw_sites AS (SELECT 'rule/' || user_id AS rule, CASE WHEN event_id % 2 = 0 THEN 'insert' ELSE 'retract' END AS dim, event_id % 7 AS pos, 'layer-' || (event_id % 7) AS layer, (event_id % 7) * 1000000000 + event_id AS k, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS callsite_id, props, event_type AS t FROM events),
sites AS (SELECT rule, dim, callsite_id, min(k) AS first, arg_max(props, k) FILTER (WHERE pos < 2) AS source, arg_max(CASE t WHEN 'purchase' THEN 'full' WHEN 'error' THEN 'none' ELSE 'partial' END, k) FILTER (WHERE t <> 'signup') AS status, arg_max(t, k) FILTER (WHERE t <> 'signup') AS type, coalesce(arg_max(layer, k) FILTER (WHERE t <> 'signup'), arg_min(layer, k)) AS from_layer FROM raw_sites GROUP BY ALL),
calls AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS caller, 'f' || lpad((p_partkey + s)::VARCHAR, 9, '0') AS callee FROM part, (VALUES (1), (7)) v(s) WHERE p_partkey % 50 + s < 50),
live AS (SELECT * FROM entries e WHERE NOT tombstone AND pos > coalesce((SELECT max(pos) FROM entries t WHERE t.rule = e.rule AND t.key = e.key AND t.tombstone), -1))
"""
