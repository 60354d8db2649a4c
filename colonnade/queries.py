"""One query per operator over the test tables, each through the engine's own functions, with its SQL."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ColonnadeError, Conflict, StorageError
from .operators import aggregate as A
from .operators import constraints as K
from .operators import mutate as M
from .operators import query as Q
from .operators import stats as S
from .operators import vector_search as V
from .operators.join import inner_join
from .plans.expression import Compare
from .plans.predicate import where
from .sources import datasource, files, parts
from .sources.document import from_frame, to_frame
from .sources.inplace import DocumentFile
from .store import Table, apply_json
from .streaming import append_stream
from .types import kind_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_NL = (
    "(SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag='R' THEN NULL ELSE l_quantity END AS q, "
    "CASE WHEN l_linestatus='O' THEN NULL ELSE l_returnflag END AS f FROM lineitem) NL"
)
_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], z.v), 6)"
_DISTANCE = "round(list_distance(e.embedding::DOUBLE[], z.v), 6)"
_VECTORS = "embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {}) z"


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nullable_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with nulls put in: q on returned lines, f on open ones."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"), F.when(F.col("l_linestatus") != "O", F.col("l_returnflag")).alias("f"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that executors share: below ``spark.checkpoint.dir``; a temporary one only where a local run sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="colonnade-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def document_path(spark: SparkSession, name: str) -> str:
    """A path for a document file, which the driver reads and writes: in the shared folder where that is a mounted one."""
    folder = re.sub("^file:(//)?", "", scratch(spark, "documents"))
    if "://" in folder:
        folder = tempfile.mkdtemp(prefix="colonnade-")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"


def stored(df: DataFrame, rules: K.Constraints | None = None, *indexes: tuple[str, str]) -> Table:
    """A new table with the rows of ``df`` in two inserts, so in several files, and its indexes."""
    spark, kinds = df.sparkSession, [(f.name, kind_of(f.dataType)) for f in df.schema]
    t = Table.create(spark, scratch(spark, "table"), kinds, rules)
    wide = df.select(*[F.col(f.name).cast(t.schema[f.name].dataType) for f in df.schema])
    half = F.pmod(F.xxhash64(df.columns[0]), F.lit(2)) == 0
    t.append(wide.where(half))
    t.append(wide.where(~half))
    for column, kind in indexes:
        t.create_layout(column, kind)
    return t


def narrow(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns in the types of the test tables."""
    return df.select(*[F.col(f.name).cast(like.schema[f.name].dataType) if f.name in like.columns else F.col(f.name) for f in df.schema])


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, to search with."""
    return [float(x) for x in Q.query(table(spark, sf_dir, "embeddings"), f"vec_id = {vec_id}", ["embedding"]).first()[0]]


@_query("SELECT * FROM customer")
def scan_all(spark, sf):
    return Q.query(table(spark, sf, "customer"))


@_query("SELECT c_name FROM customer")
def scan_column(spark, sf):
    return Q.project(table(spark, sf, "customer"), ["c_name"])


@_query("SELECT count(*) AS row_count FROM lineitem")
def info_row_count(spark, sf):
    return Q.info(table(spark, sf, "lineitem"))


@_query("SELECT c_custkey, c_name FROM customer")
def project_cols(spark, sf):
    return Q.query(table(spark, sf, "customer"), columns=["c_custkey", "c_name"])


@_query("SELECT l_orderkey, l_tax FROM lineitem")
def project_pruned(spark, sf):
    return Q.query(table(spark, sf, "lineitem"), columns=["l_orderkey", "l_tax"])


def _filter(name: str, source: str, text: str, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = nullable_lineitem(spark, sf) if source == "NL" else table(spark, sf, source)
        return Q.query(df, text, columns)

    run.__name__ = name
    _query(sql)(run)


_filter("filter_eq_string", "customer", "c_mktsegment = 'BUILDING'", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_filter("filter_eq_int", "customer", "c_nationkey = 7", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
_filter("filter_is_null", "NL", "q = null", ["l_orderkey", "l_linenumber"], f"SELECT l_orderkey, l_linenumber FROM {_NL} WHERE q IS NULL")
_filter("filter_neq_keeps_null", "NL", "f != 'A'", ["l_orderkey", "f"], f"SELECT l_orderkey, f FROM {_NL} WHERE (f = 'A') IS NOT TRUE")
_filter("filter_gt", "NL", "q > 45", ["l_orderkey", "q"], f"SELECT l_orderkey, q FROM {_NL} WHERE q > 45")
_filter("filter_gte", "NL", "q >= 45", ["l_orderkey", "q"], f"SELECT l_orderkey, q FROM {_NL} WHERE q >= 45")
_filter("filter_lt", "NL", "q < 5", ["l_orderkey", "q"], f"SELECT l_orderkey, q FROM {_NL} WHERE q < 5")
_filter("filter_lte", "NL", "q <= 5", ["l_orderkey", "q"], f"SELECT l_orderkey, q FROM {_NL} WHERE q <= 5")
_filter("filter_and", "lineitem", "l_quantity > 45 AND l_returnflag = 'R'", ["l_orderkey"], "SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
_filter("filter_or", "lineitem", "l_quantity > 49 OR l_discount < 0.01", ["l_orderkey"], "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 OR l_discount < 0.01")
_filter("filter_not", "NL", "NOT q > 25", ["l_orderkey", "q"], f"SELECT l_orderkey, q FROM {_NL} WHERE (q > 25) IS NOT TRUE")
_filter("filter_nested", "NL", "(q >= 30 OR f = 'N') AND NOT q > 40", ["l_orderkey"], f"SELECT l_orderkey FROM {_NL} WHERE ((q >= 30 OR f = 'N') AND (q > 40) IS NOT TRUE)")
_filter("filter_string_range", "customer", "c_name >= 'Customer#000001000'", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_name >= 'Customer#000001000'")
_filter("filter_date_range", "orders", "o_orderdate >= '1997-01-01T00:00:00Z' AND o_orderdate < '1998-01-01T00:00:00Z'", ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
_filter("where_text_complex", "orders", "(o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT'", ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT'")
_filter("index_eq_lookup", "orders", "o_orderkey = 100", [], "SELECT * FROM orders WHERE o_orderkey = 100")
_filter("index_range_lookup", "orders", "o_orderkey >= 100 AND o_orderkey < 200", [], "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")


@_query("SELECT c_custkey FROM (SELECT c_custkey, c_acctbal > 0 AS pos FROM customer) t WHERE pos = true")
def filter_bool(spark, sf):
    return Q.query(table(spark, sf, "customer").withColumn("pos", F.col("c_acctbal") > 0), "pos = true", ["c_custkey"])


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_ordered(spark, sf):
    return Q.query(table(spark, sf, "orders"), columns=["o_orderkey", "o_totalprice"], limit=10, order=["o_orderkey"])


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 25")
def query_pipeline(spark, sf):
    return Q.query(table(spark, sf, "orders"), "o_totalprice > 100000", ["o_orderkey", "o_orderstatus"], 25, ["o_orderkey"])


@_query("SELECT c.c_custkey AS left_c_custkey, o.o_orderkey AS right_o_orderkey FROM customer c JOIN orders o ON c.c_custkey IS NOT DISTINCT FROM o.o_custkey")
def join_inner(spark, sf):
    return inner_join(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey").select("left_c_custkey", "right_o_orderkey")


@_query("SELECT n.n_nationkey AS left_n_nationkey, n.n_name AS left_n_name, n.n_regionkey AS left_n_regionkey, r.r_regionkey AS right_r_regionkey, r.r_name AS right_r_name FROM nation n JOIN region r ON n.n_regionkey IS NOT DISTINCT FROM r.r_regionkey")
def join_prefixed_columns(spark, sf):
    return inner_join(table(spark, sf, "nation"), table(spark, sf, "region"), "n_regionkey", "r_regionkey")


@_query("SELECT n.n_nationkey AS left_n_nationkey FROM nation n JOIN (SELECT r_regionkey + 1000 AS k FROM region) r ON n.n_regionkey IS NOT DISTINCT FROM r.k")
def join_no_match(spark, sf):
    far = table(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("k"))
    return inner_join(table(spark, sf, "nation"), far, "n_regionkey", "k").select("left_n_nationkey")


@_query("SELECT s.s_suppkey AS left_s_suppkey, l.l_orderkey AS right_l_orderkey FROM supplier s JOIN lineitem l ON s.s_suppkey IS NOT DISTINCT FROM l.l_suppkey")
def join_one_to_many(spark, sf):
    return inner_join(table(spark, sf, "supplier"), table(spark, sf, "lineitem"), "s_suppkey", "l_suppkey").select("left_s_suppkey", "right_l_orderkey")


@_query("SELECT a.r_regionkey AS left_r_regionkey, b.r_regionkey AS right_r_regionkey FROM (SELECT r_regionkey, nullif(r_regionkey, 2) AS k FROM region) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(spark, sf):
    keyed = table(spark, sf, "region").select("r_regionkey", F.nullif(F.col("r_regionkey"), F.lit(2)).alias("k"))
    return inner_join(keyed, keyed, "k", "k").select("left_r_regionkey", "right_r_regionkey")


def _aggregate(name: str, source: str, column: str, functions: list[str], names: list[str], sql: str, condition: str | None = None, digits: dict[str, int] | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = nullable_lineitem(spark, sf) if source == "NL" else table(spark, sf, source)
        out = A.aggregate(df, column, functions, condition, names)
        return out.withColumns({n: F.round(n, d) for n, d in (digits or {}).items()})

    run.__name__ = name
    _query(sql)(run)


_aggregate("agg_count", "lineitem", "l_quantity", ["count"], ["cnt"], "SELECT count(l_quantity) AS cnt FROM lineitem")
_aggregate("agg_count_nulls", "NL", "q", ["count"], ["cnt"], f"SELECT count(q) AS cnt FROM {_NL}")
_aggregate("agg_sum", "lineitem", "l_extendedprice", ["sum"], ["s"], "SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS s FROM lineitem", digits={"s": 2})
_aggregate("agg_sum_empty", "lineitem", "l_quantity", ["sum"], ["s"], "SELECT coalesce(sum(l_quantity), 0.0) AS s FROM lineitem WHERE l_quantity > 1000", "l_quantity > 1000")
_aggregate("agg_avg", "lineitem", "l_discount", ["avg"], ["a"], "SELECT round(coalesce(avg(l_discount), 0.0), 6) AS a FROM lineitem", digits={"a": 6})
_aggregate("agg_avg_empty", "lineitem", "l_quantity", ["avg"], ["a"], "SELECT coalesce(avg(l_quantity), 0.0) AS a FROM lineitem WHERE l_quantity > 1000", "l_quantity > 1000")
_aggregate("agg_min_num", "NL", "q", ["min"], ["m"], f"SELECT min(q) AS m FROM {_NL}")
_aggregate("agg_min_string", "customer", "c_name", ["min"], ["m"], "SELECT min(c_name) AS m FROM customer")
_aggregate("agg_max_num", "NL", "q", ["max"], ["m"], f"SELECT max(q) AS m FROM {_NL}")
_aggregate("agg_max_date", "lineitem", "l_shipdate", ["max"], ["m"], "SELECT max(l_shipdate) AS m FROM lineitem")
_aggregate("agg_multi", "NL", "q", ["count", "sum", "avg", "min", "max"], ["cnt", "s", "a", "mn", "mx"], f"SELECT count(q) AS cnt, round(coalesce(sum(q), 0.0), 2) AS s, round(coalesce(avg(q), 0.0), 6) AS a, min(q) AS mn, max(q) AS mx FROM {_NL}", digits={"s": 2, "a": 6})
_aggregate("agg_filtered", "lineitem", "l_tax", ["count", "sum"], ["cnt", "s"], "SELECT count(l_tax) AS cnt, round(sum(l_tax), 4) AS s FROM lineitem WHERE l_returnflag = 'A' AND l_quantity <= 10", "l_returnflag = 'A' AND l_quantity <= 10", {"s": 4})


@_query(f"SELECT e.vec_id, {_COSINE} AS similarity FROM {_VECTORS.format(0)}")
def vec_cosine_all(spark, sf):
    return V.score(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf, 0), "cosine", 6).select("vec_id", "similarity")


@_query(f"SELECT e.vec_id, {_DISTANCE} AS distance FROM {_VECTORS.format(0)}")
def vec_euclid_all(spark, sf):
    return V.score(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf, 0), "euclidean", 6).select("vec_id", "distance")


@_query(f"SELECT e.vec_id, {_COSINE} AS similarity FROM {_VECTORS.format(0)} ORDER BY similarity DESC, e.vec_id LIMIT 5")
def vec_topk_cosine(spark, sf):
    return V.search(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf, 0), 5, "cosine", ["vec_id"], ["vec_id"], 6)


@_query(f"SELECT e.vec_id, {_DISTANCE} AS distance FROM {_VECTORS.format(0)} ORDER BY distance, e.vec_id LIMIT 5")
def vec_topk_euclid(spark, sf):
    return V.search(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf, 0), 5, "euclidean", ["vec_id"], ["vec_id"], 6)


@_query(f"SELECT e.label, {_COSINE} AS similarity FROM {_VECTORS.format(3)} ORDER BY similarity DESC, e.vec_id LIMIT 10")
def vec_search_select(spark, sf):
    return V.search(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf, 3), 10, "cosine", ["label"], ["vec_id"], 6)


@_query(f"SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], z.v), 6) AS similarity FROM {_VECTORS.format(7)} ORDER BY similarity DESC, e.vec_id LIMIT 10")
def vec_index_all_cells(spark, sf):
    """The saved index with all of its cells probed, which is exact."""
    df, folder = table(spark, sf, "embeddings"), scratch(spark, "cells")
    V.CellIndex.fit(df, "embedding").save(df, folder)
    index, cells = V.CellIndex.load(spark, folder)
    return index.search(cells, query_vector(spark, sf, 7), 10, probes=len(index.centres), order=["vec_id"], digits=6).select("vec_id", "similarity")


@_query(None)
def vec_ann(spark, sf):
    """Approximate search through a saved index: only the probed cells are read."""
    df, folder = table(spark, sf, "embeddings"), scratch(spark, "cells")
    V.CellIndex.fit(df, "embedding").save(df, folder)
    index, cells = V.CellIndex.load(spark, folder)
    return index.search(cells, query_vector(spark, sf, 0), 10, order=["vec_id"], digits=6).select("vec_id", "similarity")


@_query(f"SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], z.v)::FLOAT, 5) AS similarity FROM {_VECTORS.format(5)} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], z.v) DESC, e.vec_id LIMIT 5")
def vec_topk_f32(spark, sf):
    found = V.top_k_f32(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf, 5), 5, ["vec_id"])
    return found.select("vec_id", F.round("similarity", 5).cast("float").alias("similarity"))


@_query("SELECT vec_id FROM embeddings WHERE embedding = (SELECT embedding FROM embeddings WHERE vec_id = 11)")
def filter_array(spark, sf):
    """Equality of a whole array."""
    e = Compare("embedding", "=", query_vector(spark, sf, 11))
    return Q.query(table(spark, sf, "embeddings"), e, ["vec_id"])


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_fallback(spark, sf):
    """An unquoted value, which only the fallback of the filter language takes."""
    return Q.query(table(spark, sf, "customer"), "c_mktsegment=BUILDING", ["c_custkey"])


@_query("SELECT c_custkey FROM customer WHERE c_nationkey > 3 AND c_nationkey <= 7")
def filter_fractional_bound(spark, sf):
    """Literals of another number type: fractional bounds on an int column; a string literal equals no int."""
    return Q.query(table(spark, sf, "customer"), "c_nationkey > 3.5 AND c_nationkey < 7.25 AND NOT c_nationkey = '5'", ["c_custkey"])


@_query("SELECT s.s_suppkey AS left_s_suppkey, p.p_size AS right_p_size FROM supplier s JOIN part p ON s.s_nationkey::VARCHAR = p.p_size::VARCHAR")
def join_cross_type(spark, sf):
    """Keys of different types, compared as text on request."""
    parts = table(spark, sf, "part").withColumn("size_text", F.col("p_size").cast("string"))
    suppliers = table(spark, sf, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double"))
    return inner_join(suppliers, parts, "s_nationkey", "size_text", as_text=True).select("left_s_suppkey", "right_p_size")


_NULL_TEXT = "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN 'null' ELSE n_name END AS k FROM nation"


@_query(f"SELECT a.n_nationkey AS left_n_nationkey, b.n_nationkey AS right_n_nationkey FROM ({_NULL_TEXT}) a JOIN ({_NULL_TEXT}) b ON coalesce(a.k, 'null') = coalesce(b.k, 'null')")
def join_null_as_text(spark, sf):
    k = F.when(F.col("n_regionkey") != 1, F.when(F.col("n_regionkey") == 2, F.lit("null")).otherwise(F.col("n_name")))
    keyed = table(spark, sf, "nation").select("n_nationkey", k.alias("k"))
    return inner_join(keyed, keyed, "k", "k", null_as_text=True).select("left_n_nationkey", "right_n_nationkey")


@_query("SELECT vec_id AS left_vec_id FROM embeddings WHERE false")
def join_array_keys(spark, sf):
    """Arrays are no keys: they match nothing."""
    df = table(spark, sf, "embeddings")
    return inner_join(df, df, "embedding", "embedding").select("left_vec_id")


@_query("SELECT * FROM orders WHERE o_orderkey = 100")
def table_hash_lookup(spark, sf):
    """An equality on a table whose files carry bloom filters of the column."""
    df = table(spark, sf, "orders")
    return narrow(stored(df, K.Constraints("o_orderkey"), ("o_orderkey", "hash")).query("o_orderkey = 100"), df)


@_query("SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000")
def table_sorted_lookup(spark, sf):
    """A range on a table whose files are sorted by the column, and are checked to be."""
    df = table(spark, sf, "orders")
    t = stored(df, K.Constraints("o_orderkey"), ("o_totalprice", "sorted"))
    t.check()
    return narrow(t.query("o_totalprice >= 100000 AND o_totalprice < 120000"), df)


@_query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def table_dropped_index(spark, sf):
    """Rows do not depend on indexes, created and dropped."""
    df = table(spark, sf, "part")
    t = stored(df, None, ("p_brand", "hash"), ("p_size", "sorted"))
    t.drop_layout("p_brand")
    return narrow(t.query(), df)


@_query("SELECT * FROM supplier UNION ALL SELECT 900001, 'Supplier new', 3, 1.5 UNION ALL SELECT 900002, 'Supplier new', 7, -2.0")
def table_insert_batch(spark, sf):
    """JSON rows and a default, inserted at once; a batch with a broken key leaves nothing."""
    df = table(spark, sf, "supplier")
    t = stored(df, K.Constraints("s_suppkey", not_null=["s_name"], defaults={"s_name": "Supplier new"}))
    t.insert([{"s_suppkey": 900001, "s_nationkey": 3, "s_acctbal": 1.5}, {"s_suppkey": 900002, "s_nationkey": 7, "s_acctbal": -2}])
    for bad in ([{"s_suppkey": 900003, "s_nationkey": 1, "s_acctbal": 0.0}, {"s_suppkey": 900001, "s_nationkey": 1, "s_acctbal": 0.0}], [{"s_suppkey": 1}], [{"s_suppkey": "x", "s_nationkey": 1, "s_acctbal": 0.0}]):
        try:
            t.insert(bad)
        except ColonnadeError:
            continue
        raise AssertionError("a broken batch was taken")
    return narrow(t.query(), df)


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT o_totalprice > 200000")
def table_delete(spark, sf):
    t = stored(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), None, ("o_totalprice", "sorted"))
    t.delete("o_totalprice > 200000")
    return t.query()


@_query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def table_update(spark, sf):
    t = stored(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), K.Constraints("o_orderkey"))
    t.update("o_orderpriority = '1-URGENT'", {"o_orderstatus": "U"})
    return t.query()


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 99999999, 1.25, 'F'")
def table_transaction(spark, sf):
    """Operations that count together; their filters see the table as it was read."""
    t = stored(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), K.Constraints("o_orderkey"))
    apply_json(t, [{"op": "insert", "row": {"o_orderkey": 99999999, "o_totalprice": 1.25, "o_orderstatus": "F"}}, {"op": "delete", "where": "o_orderstatus = 'P'"}, {"op": "update", "where": "o_orderstatus = 'F'", "set": {"o_totalprice": 0.0}}])
    gone = t.transaction()
    gone.delete("o_orderkey > 0")
    gone.rollback()
    gone.commit()
    return t.query()


@_query("SELECT true AS refused, count(*) AS row_count FROM nation WHERE n_nationkey <> 3")
def table_conflict(spark, sf):
    """Of two transactions on one version the later is refused; one that asks for no check is not."""
    t = stored(table(spark, sf, "nation"))
    late = Table.open(spark, t.root).transaction()
    late.delete("n_nationkey = 4")
    t.delete("n_nationkey = 3")
    try:
        late.commit()
        refused = False
    except Conflict:
        refused = True
    now = Table.open(spark, t.root)
    return Q.info(now.df).select(F.lit(refused).alias("refused"), "row_count")


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0 ORDER BY c_custkey")
def table_compacted(spark, sf):
    """After deletes, compaction leaves the same rows in fewer files."""
    t = stored(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), K.Constraints("c_custkey"))
    t.delete("c_acctbal < 0")
    t.compact(1)
    t.check()
    return Table.open(spark, t.root).query()


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name, NULL::VARCHAR AS note FROM region UNION ALL SELECT 77, 'FAR', 'added'")
def table_add_column_then_insert(spark, sf):
    t = stored(table(spark, sf, "region"))
    t.add_column("note", "string")
    t.insert([{"r_regionkey": 77, "r_name": "FAR", "note": "added"}])
    return t.query()


@_query("SELECT count(*) AS row_count, count(DISTINCT l_returnflag) AS kinds, false AS valid_after_write FROM lineitem WHERE l_quantity <= 40")
def table_analyze(spark, sf):
    """Statistics are stored with a version, and no longer valid after a write."""
    t = stored(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"))
    t.delete("l_quantity > 40")
    found = t.analyze()["l_returnflag"]
    t.delete("l_quantity < 0")
    t.update("l_quantity = 1", {"l_returnflag": "R"})
    return spark.createDataFrame([(found["row_count"], found["distinct_count"], t.version.stats["l_returnflag"]["valid"])], "row_count long, kinds long, valid_after_write boolean")


@_query("SELECT 'primary key' AS broken UNION ALL SELECT 'unique' UNION ALL SELECT 'not null' UNION ALL SELECT 'two rows, one key'")
def table_update_violations(spark, sf):
    """Updates that would break a constraint are refused."""
    t = stored(table(spark, sf, "nation"), K.Constraints("n_nationkey", unique=["n_name"], not_null=["n_regionkey"]))
    taken, broken = t.query("n_nationkey = 5", ["n_name"]).first()[0], []
    for name, condition, values in (("primary key", "n_nationkey = 3", {"n_nationkey": 4}), ("unique", "n_nationkey = 3", {"n_name": taken}), ("not null", "n_nationkey = 3", {"n_regionkey": None}), ("two rows, one key", "n_nationkey > 3", {"n_nationkey": 99})):
        try:
            t.update(condition, values)
        except ColonnadeError:
            broken.append((name,))
    return spark.createDataFrame(broken, "broken string")


def _document(form: str) -> None:
    """The whole table through a document file of a form and back; names, types, nulls and times stay."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
        path = document_path(spark, "orders")
        parts.save_frame(df, path, [(f.name, kind_of(f.dataType)) for f in df.schema], form, K.Constraints("o_orderkey"))
        return narrow(parts.load_frame(spark, path), df)

    run.__name__ = f"document_{form}"
    _query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")(run)


for _form in ("json", "binary", "compressed"):
    _document(_form)


@_query("SELECT o_orderkey, o_orderdate FROM orders")
def document_columns(spark, sf):
    """Two of a binary document's columns; the others are stepped over."""
    df = table(spark, sf, "orders")
    path = document_path(spark, "orders")
    parts.save_frame(df, path, [(f.name, kind_of(f.dataType)) for f in df.schema])
    return parts.load_frame(spark, path, {"o_orderkey", "o_orderdate"})


@_query("SELECT * FROM orders")
def document_roundtrip(spark, sf):
    """Written and overwritten as document files by Spark, and read back."""
    datasource.register(spark)
    df, path = table(spark, sf, "orders"), document_path(spark, "folder")
    for _ in range(2):
        df.repartition(3).write.format("colonnade").option("form", "binary").mode("overwrite").save(path)
    return narrow(spark.read.format("colonnade").load(path), df)


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, CASE WHEN r_regionkey = 1 THEN 'west' ELSE r_name END AS r_name, NULL::DOUBLE AS area FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 50, 'new', NULL")
def document_log(spark, sf):
    """A document with a log beside it: what was committed is applied, in order, and nothing else."""
    df = table(spark, sf, "region")
    path = document_path(spark, "region")
    files.save(from_frame(df, [(f.name, kind_of(f.dataType)) for f in df.schema], K.Constraints("r_regionkey")), path)
    files.append_log(path, [
        {"op": "insert", "row": {"r_regionkey": 50, "r_name": "new"}}, {"op": "txn_begin", "txn_id": "a"}, {"op": "delete", "filter": "r_regionkey = 0", "pk_values": [0]}, {"op": "txn_commit", "txn_id": "a"},
        {"op": "update", "filter": "r_regionkey = 1", "pk_values": [1], "values": {"r_name": "west"}}, {"op": "add_column", "name": "area", "col_type": "float"}, {"op": "txn_begin", "txn_id": "b"}, {"op": "delete", "filter": "r_regionkey = 2", "pk_values": [2]},
    ])
    return to_frame(spark, files.load(path))


@_query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'ATLANTIS', 9")
def document_in_place(spark, sf):
    """A document file changed where it lies, through its log, and read again; its extensions stay."""
    df = table(spark, sf, "nation")
    path = document_path(spark, "nation")
    files.save(from_frame(df, [(f.name, kind_of(f.dataType)) for f in df.schema], K.Constraints("n_nationkey"), extensions={"kept": [1]}), path, "json")
    held = DocumentFile(spark, path)
    held.insert([{"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 9}])
    held.delete("n_regionkey = 2")
    held.compact()
    again = DocumentFile(spark, path)
    if again.doc.extensions != {"kept": [1]} or os.path.exists(files.log_path(path)):
        raise StorageError("extensions or the log differ")
    return again.query()


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def stream_append(spark, sf):
    """A filtered stream into a table, twice from one checkpoint: nothing is inserted again."""
    t = Table.create(spark, scratch(spark, "table"), [("c_custkey", "int"), ("c_acctbal", "float")], K.Constraints("c_custkey"))
    source = scratch(spark, "stream")
    table(spark, sf, "customer").select("c_custkey", "c_acctbal").repartition(3).write.parquet(source)
    checkpoint = scratch(spark, "checkpoint")
    for _ in range(2):
        stream = where(spark.readStream.schema("c_custkey long, c_acctbal double").parquet(source), "c_acctbal > 5000")
        append_stream(stream, t.root, checkpoint).awaitTermination()
    return Table.open(spark, t.root).query()


@_query(f"SELECT count(*) AS row_count, count(*) - count(q) AS null_count, count(DISTINCT q) AS distinct_count, min(q) AS min_v, max(q) AS max_v FROM {_NL}")
def stats_analyze(spark, sf):
    return S.analyze_column(nullable_lineitem(spark, sf), "q")


@_query(f"SELECT l_orderkey, l_linenumber, q FROM {_NL} WHERE (q > 25) IS NOT TRUE")
def delete_result(spark, sf):
    return Q.project(M.delete(nullable_lineitem(spark, sf), "q > 25"), ["l_orderkey", "l_linenumber", "q"])


@_query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_result(spark, sf):
    return Q.project(M.update(table(spark, sf, "orders"), "o_totalprice > 100000", {"o_orderstatus": "X"}), ["o_orderkey", "o_orderstatus"])


@_query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99::INTEGER, 'NOWHERE'")
def insert_result(spark, sf):
    return M.insert(table(spark, sf, "region"), [{"r_regionkey": 99, "r_name": "NOWHERE"}], K.Constraints("r_regionkey"))


@_query("SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region")
def add_column_result(spark, sf):
    return M.add_column(table(spark, sf, "region"), "note", "string")


@_query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 98::INTEGER, 'UNKNOWN'")
def default_fill(spark, sf):
    return M.insert(table(spark, sf, "region"), [{"r_regionkey": 98}], K.Constraints("r_regionkey", defaults={"r_name": "UNKNOWN"}))


@_query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def pk_violations(spark, sf):
    return K.duplicates(table(spark, sf, "lineitem"), "l_orderkey")


@_query(f"SELECT f AS k, count(*) AS n FROM {_NL} WHERE f IS NOT NULL GROUP BY f HAVING count(*) > 1")
def unique_violations(spark, sf):
    return K.duplicates(nullable_lineitem(spark, sf), "f")


@_query(f"SELECT l_orderkey, l_linenumber FROM {_NL} WHERE q IS NULL")
def not_null_violations(spark, sf):
    return Q.project(K.nulls(nullable_lineitem(spark, sf), "q"), ["l_orderkey", "l_linenumber"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Filter text, compiled and pushed to the scan."""
    return where(table(spark, sf, "lineitem"), "l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_quantity", "l_extendedprice")
