"""All queries of the core by name, and the SQL they are held against.

Every query reads its whole tables. Searches take as queries the rows whose id is divisible by
20, against all rows. Rows that were delivered twice count once.
"""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vector as V
from vecloom.operators import embeddings as E
from vecloom.operators import exact, reorder
from vecloom.operators.ids import concatenated, numbered, shard_of
from vecloom.operators.index import Index, IndexBuilder, neighbour_invariants
from vecloom.operators.layered import BuildConfig
from vecloom.session import ensure_checkpoint_dir, table
from vecloom.streaming.growing import GrowingIndex

EVERY = 20
MULTIPLIER = 15.0
SHARDS = 7
CONFIG = BuildConfig(layer_multiplier=MULTIPLIER, num_neighbors=20, max_search=50)


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _floats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vectors_f32").where("vec is not null").groupBy("id").agg(F.max("vec").alias("vec"))


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vectors_i8").where("vec is not null").groupBy("id").agg(F.max("vec").alias("vec"))


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dict").where("vec is not null").groupBy("word_id").agg(F.max("vec").alias("vec"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").where("word is not null").groupBy("word_id").agg(F.max("word").alias("word"))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "terms").groupBy("id").agg(F.max("term_ids").alias("term_ids"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "element_lines").groupBy("line_id").agg(F.max("value").alias("value"))


def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % EVERY == 0)


def _long(df: DataFrame, value: str, digits: int | None = None, key: str = "id") -> DataFrame:
    out = df.select(key, F.posexplode("vec").alias("pos", value))
    return out.withColumn(value, F.round(value, digits)) if digits is not None else out


def _ranked(result: DataFrame) -> DataFrame:
    return result.withColumn("dist", F.round("dist", 6))


_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_ELEMENTS = "elements AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
_FLOATS = "floats AS (SELECT id, max(vec) AS raw, max(vec)::DOUBLE[] AS vec FROM vectors_f32 WHERE vec IS NOT NULL GROUP BY id)"
_BYTES = "bytes AS (SELECT id, max(vec)::DOUBLE[] AS vec FROM vectors_i8 WHERE vec IS NOT NULL GROUP BY id)"
_DICT = "d AS (SELECT word_id, max(vec)::DOUBLE[] AS vec FROM dict WHERE vec IS NOT NULL GROUP BY word_id)"
_WORDS = "w AS (SELECT word_id, max(word) AS word FROM word_list WHERE word IS NOT NULL GROUP BY word_id)"
_TERMS = "t AS (SELECT id, max(term_ids) AS term_ids FROM terms GROUP BY id)"
_LINES = "l AS (SELECT line_id, max(value) AS value FROM element_lines GROUP BY line_id)"


def _norm_sql(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


def _cos_sql(a: str, b: str) -> str:
    return f"greatest(0.0, 1 - coalesce(list_dot_product({a}, {b}) / nullif({_norm_sql(a)} * {_norm_sql(b)}, 0), 0))"


def _knn_sql(source: str, k: int = 10) -> str:
    return f"""ranked AS (
  SELECT q.id AS query_id, e.id, round({_cos_sql('q.vec', 'e.vec')}, 9) AS d,
         row_number() OVER (PARTITION BY q.id ORDER BY round({_cos_sql('q.vec', 'e.vec')}, 9), e.id) AS rank
  FROM {source} q JOIN {source} e ON true WHERE q.id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS dist FROM ranked WHERE rank <= {k}"""


# --- scalar functions -------------------------------------------------------------------


@_query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def vec_dims(spark, sf):
    return _elements(spark, sf).select("id", V.dimension(F.col("vec")).alias("dim"))


@_query(f"WITH {_FLOATS} SELECT id, round({_norm_sql('vec')}, 6) AS norm FROM floats")
def vec_norms(spark, sf):
    return _floats(spark, sf).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"))


@_query(f"""WITH {_FLOATS} SELECT id, CAST(unnest(range(len(vec))) AS INTEGER) AS pos,
  round(unnest(list_transform(vec, lambda x: CASE WHEN {_norm_sql('vec')} > 0 THEN x / {_norm_sql('vec')} ELSE x END)), 6) AS value FROM floats""")
def normalize_long(spark, sf):
    return _long(_floats(spark, sf).withColumn("vec", V.normalize(F.col("vec"))), "value", 6)


@_query(f"""WITH {_FLOATS}, top AS (SELECT id, raw, list_max(list_transform(raw, lambda x: abs(x))) AS m FROM floats)
SELECT id, CAST(unnest(range(len(raw))) AS INTEGER) AS pos,
  unnest(list_transform(raw, lambda x: CASE WHEN m > 0 THEN CAST(trunc(CAST(CAST(x * 127::FLOAT AS FLOAT) / m AS FLOAT)) AS TINYINT) ELSE 0::TINYINT END)) AS value FROM top""")
def quantize_long(spark, sf):
    return _long(_floats(spark, sf).withColumn("vec", V.quantize(F.col("vec"))), "value")


@_query(f"WITH {_FLOATS} SELECT id, round(list_max(list_transform(raw, lambda x: abs(x)))::DOUBLE, 6) AS scale FROM floats")
def quantization_scale(spark, sf):
    return _floats(spark, sf).select("id", F.round(V.max_abs(F.col("vec")).cast("double"), 6).alias("scale"))


def _next(df: DataFrame) -> DataFrame:
    b = df.select((F.col("id") - 1).alias("before"), F.col("id").alias("next_id"), F.col("vec").alias("next_vec"))
    return df.join(b, F.col("id") == F.col("before"))


@_query(f"WITH {_ELEMENTS} SELECT a.id, b.id AS next_id, round(greatest(0, 1 - list_dot_product(a.vec, b.vec)), 6) AS dist FROM elements a JOIN elements b ON b.id = a.id + 1")
def angular_pairs(spark, sf):
    return _next(_elements(spark, sf)).select("id", "next_id", F.round(V.angular(F.col("vec"), F.col("next_vec")), 6).alias("dist"))


@_query(f"WITH {_BYTES} SELECT a.id, b.id AS next_id, round({_cos_sql('a.vec', 'b.vec')}, 6) AS dist FROM bytes a JOIN bytes b ON b.id = a.id + 1")
def angular_int_pairs(spark, sf):
    return _next(_bytes(spark, sf)).select("id", "next_id", F.round(V.angular_int(F.col("vec"), F.col("next_vec")), 6).alias("dist"))


@_query(f"WITH {_FLOATS} SELECT a.id, b.id AS next_id, round({_cos_sql('a.vec', 'b.vec')}, 6) AS dist FROM floats a JOIN floats b ON b.id = a.id + 1")
def reference_pairs(spark, sf):
    return _next(_floats(spark, sf)).select("id", "next_id", F.round(V.angular_any(F.col("vec"), F.col("next_vec")), 6).alias("dist"))


@_query(f"""WITH {_FLOATS} SELECT a.id, b.id AS next_id,
  round(CASE WHEN {_norm_sql('a.vec')} > 0 AND {_norm_sql('b.vec')} > 0 THEN {_cos_sql('a.vec', 'b.vec')} ELSE 1 END, 6) AS dist FROM floats a JOIN floats b ON b.id = a.id + 1""")
def distance_by_type(spark, sf):
    return _next(_floats(spark, sf)).select("id", "next_id", F.round(V.distance("angular", F.col("vec"), F.col("next_vec")), 6).alias("dist"))


@_query(f"WITH {_FLOATS} SELECT id, 1.0::DOUBLE AS dist FROM floats WHERE {_norm_sql('vec')} = 0")
def zero_vector_dist(spark, sf):
    return _floats(spark, sf).where(V.norm(F.col("vec")) == 0).select("id", V.angular_any(F.col("vec"), F.col("vec")).alias("dist"))


@_query(f"WITH {_FLOATS} SELECT f.id, round({_cos_sql('f.vec', 'b.vec')}, 6) AS dist FROM floats f JOIN (SELECT id, max(vec)::DOUBLE[] AS vec FROM vectors_i8 WHERE vec IS NOT NULL GROUP BY id) b ON b.id = f.id")
def quantization_error(spark, sf):
    q = _bytes(spark, sf).select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    return _floats(spark, sf).join(q, F.col("id") == F.col("qid")).select("id", F.round(V.angular_any(F.col("vec"), F.col("q")), 6).alias("dist"))


@_query(f"WITH {_ELEMENTS} SELECT e.id, round({_cos_sql('z.vec', 'e.vec')}, 6) AS dist FROM elements e JOIN elements z ON z.id = 0")
def dists_to_first(spark, sf):
    e = _elements(spark, sf)
    first = e.where("id = 0 and vec is not null").select(F.col("vec").alias("first"))
    return e.where("id is not null and vec is not null").crossJoin(F.broadcast(first)).select("id", F.round(V.angular_any(F.col("first"), F.col("vec")), 6).alias("dist"))


@_query(f"WITH {_FLOATS} SELECT id FROM floats WHERE {_norm_sql('vec')} > 0")
def indexable_elements(spark, sf):
    return _floats(spark, sf).where(V.indexable(F.col("vec"))).select("id")


# --- exact neighbours -------------------------------------------------------------------


@_query(f"WITH {_ELEMENTS}, {_knn_sql('elements')}")
def exact_knn_top10(spark, sf):
    e = _elements(spark, sf)
    return _ranked(exact.knn(_asked(e), e, 10))


@_query(f"WITH {_FLOATS}, {_knn_sql('floats')}")
def exact_knn_vectors_top10(spark, sf):
    e = _floats(spark, sf)
    return _ranked(exact.knn(_asked(e), e, 10))


@_query(f"WITH {_BYTES}, {_knn_sql('bytes')}")
def exact_knn_i8_top10(spark, sf):
    e = _bytes(spark, sf)
    return _ranked(exact.knn(_asked(e), e, 10))


@_query("""WITH labelled AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings),
ranked AS (SELECT q.id AS query_id, e.id, %s AS d, row_number() OVER (PARTITION BY q.id ORDER BY %s, e.id) AS rank
  FROM labelled q JOIN labelled e ON q.label = e.label WHERE q.id %% 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS dist FROM ranked WHERE rank <= 5""" % (_cos_sql("q.vec", "e.vec"), _cos_sql("q.vec", "e.vec")))
def knn_within_label(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("payload"), "label")
    return _ranked(exact.knn_by(_asked(e).withColumnRenamed("id", "query_id"), e, 5, V.angular_any, "label"))


def _edges(spark, sf, k: int = 20, whole: bool = False) -> DataFrame:
    """Edges of the nodes that the SQL asks for, or of the whole graph."""
    e = _elements(spark, sf)
    return exact.edges_of(exact.knn(e if whole else _asked(e), e, k, exclude_self=True))


_EDGES = f"""{_ELEMENTS}, r AS (
  SELECT q.id AS node, e.id AS nbr, round({_cos_sql('q.vec', 'e.vec')}, 9) AS dist,
         row_number() OVER (PARTITION BY q.id ORDER BY round({_cos_sql('q.vec', 'e.vec')}, 9), e.id) AS rank
  FROM elements q JOIN elements e ON q.id <> e.id WHERE q.id % {EVERY} = 0),
edges AS (SELECT node, nbr, dist FROM r WHERE rank <= 20),
sym AS (SELECT DISTINCT node, nbr FROM (SELECT node, nbr FROM edges UNION ALL SELECT nbr, node FROM edges))"""


@_query(f"WITH {_EDGES} SELECT node, nbr FROM sym")
def knn_graph_symmetric(spark, sf, whole: bool = False):
    return exact.symmetrized(_edges(spark, sf, whole=whole)).select("node", "nbr")


@_query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM sym GROUP BY node")
def knn_graph_degrees(spark, sf, whole: bool = False):
    return exact.symmetrized(_edges(spark, sf, whole=whole)).groupBy("node").agg(F.count("*").alias("degree"))


def _candidates(spark, sf, k: int = 50, whole: bool = False) -> DataFrame:
    e = _elements(spark, sf).select(F.col("id").alias("eid"), F.col("vec").cast("array<double>").alias("v"))
    edges = _edges(spark, sf, k, whole).join(e, F.col("nbr") == F.col("eid"))
    return edges.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("dist").alias("d"), F.col("nbr").alias("id"), "v"))).alias("cand"))


@_query(f"""WITH {_EDGES.replace('rank <= 20', 'rank <= 50')},
cand AS (SELECT node, list({{d: dist, id: nbr, v: x.vec}} ORDER BY dist, nbr) AS c FROM edges JOIN elements x ON x.id = nbr GROUP BY node),
kept AS (SELECT node, list_reduce(list_transform(c, lambda x: [x]), lambda acc, y:
  CASE WHEN len(acc) < 10 AND len(list_filter(acc, lambda n: y[1].d > {_cos_sql('n.v', 'y[1].v')})) = 0 THEN list_concat(acc, y) ELSE acc END) AS s FROM cand)
SELECT node, unnest(list_transform(s, lambda x: x.id)) AS id, CAST(unnest(range(len(s))) AS INTEGER) AS pos FROM kept""")
def select_neighbors_10(spark, sf, whole: bool = False):
    kept = _candidates(spark, sf, whole=whole).select("node", exact.select_neighbors(F.col("cand"), 10).alias("s"))
    return kept.select("node", F.posexplode("s").alias("pos", "e")).select("node", F.col("e.id").alias("id"), "pos")


@_query(f"""WITH {_EDGES} SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY nbr) - 1 AS INTEGER) AS pos,
  nbr - coalesce(lag(nbr) OVER (PARTITION BY node ORDER BY nbr), 0) AS delta FROM edges""")
def neighbors_delta_long(spark, sf, whole: bool = False):
    lists = exact.capped(_edges(spark, sf, whole=whole), 20)
    return lists.select("node", F.posexplode(V.delta_encode(F.col("neighbors"))).alias("pos", "delta"))


@_query(f"WITH {_EDGES} SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY nbr) - 1 AS INTEGER) AS pos, nbr FROM edges")
def neighbors_roundtrip(spark, sf, whole: bool = False):
    lists = exact.capped(_edges(spark, sf, whole=whole), 20)
    return lists.select("node", F.posexplode(V.delta_decode(V.delta_encode(F.col("neighbors")))).alias("pos", "nbr"))


@_query(f"WITH {_EDGES} SELECT node, nbr FROM edges WHERE nbr % 2 = 0")
def neighbors_filtered(spark, sf, whole: bool = False):
    lists = exact.capped(_edges(spark, sf, whole=whole), 20)
    return lists.select("node", F.explode(F.filter("neighbors", lambda x: x % 2 == 0)).alias("nbr"))


# --- layers, ids, orders ----------------------------------------------------------------

_COUNTS = "counts AS (SELECT 'embeddings' AS tab, count(*) AS n FROM embeddings UNION ALL SELECT 'terms', count(DISTINCT id) FROM terms UNION ALL SELECT 'vectors_f32', count(DISTINCT id) FROM vectors_f32)"
_LAYERS = f"""{_COUNTS},
sized AS (SELECT tab, n, layer, CAST(least(ceil(n / pow({MULTIPLIER}, floor(ln(n) / ln({MULTIPLIER})) - layer)), n) AS BIGINT) AS size FROM counts, range(0, 40) r(layer)),
layers AS (SELECT tab, CAST(layer AS INTEGER) AS layer, size FROM sized s WHERE layer <= (SELECT min(layer) FROM sized z WHERE z.tab = s.tab AND z.size = z.n))"""


@_query(f"WITH {_LAYERS} SELECT * FROM layers")
def layer_sizes(spark, sf):
    counts = {
        "embeddings": table(spark, sf, "embeddings").count(),
        "terms": table(spark, sf, "terms").select("id").distinct().count(),
        "vectors_f32": table(spark, sf, "vectors_f32").select("id").distinct().count(),
    }
    return spark.createDataFrame([(t, k, s) for t, n in counts.items() for k, s in enumerate(V.layer_sizes(n, MULTIPLIER))], "tab string, layer int, size long")


@_query(f"WITH {_LAYERS} SELECT vec_id AS id, (SELECT min(layer) FROM layers WHERE tab = 'embeddings' AND vec_id < size) AS band FROM embeddings")
def layer_members(spark, sf):
    e = _elements(spark, sf)
    return reorder.layer_bands(e, V.layer_sizes(e.count(), MULTIPLIER)).select("id", "band")


_PERM = f"""{_LAYERS}, perm AS (
  SELECT row_number() OVER (ORDER BY (SELECT min(layer) FROM layers WHERE tab = 'embeddings' AND vec_id < size), label, vec_id) - 1 AS new_id, vec_id AS old_id FROM embeddings)"""


def _perm(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"))
    return reorder.order_by_keys(e, V.layer_sizes(e.count(), MULTIPLIER))


@_query(f"WITH {_PERM} SELECT new_id, old_id FROM perm")
def reorder_by_keys(spark, sf):
    return _perm(spark, sf)


@_query(f"WITH {_PERM} SELECT old_id AS new_id, new_id AS old_id FROM perm")
def reverse_mapping(spark, sf):
    return reorder.reverse_mapping(_perm(spark, sf))


@_query(f"WITH {_PERM} SELECT p.new_id AS id, CAST(unnest(range(len(e.embedding))) AS INTEGER) AS pos, round(unnest(e.embedding)::DOUBLE, 6) AS value FROM perm p JOIN embeddings e ON e.vec_id = p.old_id")
def permute_vectors(spark, sf):
    moved = reorder.permuted(_elements(spark, sf), _perm(spark, sf))
    return _long(moved.withColumn("vec", F.col("vec").cast("array<double>")), "value", 6)


@_query(f"WITH {_EDGES}, {_PERM} SELECT a.new_id AS node, b.new_id AS nbr FROM edges JOIN perm a ON a.old_id = node JOIN perm b ON b.old_id = nbr")
def reordered_neighbors(spark, sf, whole: bool = False):
    lists = exact.capped(_edges(spark, sf, whole=whole), 20)
    return reorder.reordered_graph(lists, _perm(spark, sf)).select("node", F.explode("neighbors").alias("nbr"))


def _of_whole_graph(query):
    """The query over the graph of all nodes, each with edges of its own: all pairs, too slow for SQL."""

    def run(spark, sf):
        return query(spark, sf, whole=True)

    run.__name__ = f"{query.__name__}_whole"
    return run


for _part in (knn_graph_symmetric, knn_graph_degrees, select_neighbors_10, neighbors_delta_long, neighbors_roundtrip, neighbors_filtered, reordered_neighbors):
    _query()(_of_whole_graph(_part))


@_query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT CAST(vec_id // CAST(ceil(n / {SHARDS}) AS BIGINT) AS INTEGER) AS shard, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n FROM embeddings, n GROUP BY 1""")
def shard_ranges(spark, sf):
    e = _elements(spark, sf)
    parts = shard_of(e, "id", e.count(), SHARDS)
    return parts.groupBy("shard").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


@_query(f"""WITH {_FLOATS}, s AS (SELECT count(*) AS n FROM embeddings), f AS (SELECT count(*) AS m FROM floats)
SELECT old_id, new_id FROM (SELECT id AS old_id, (SELECT n FROM s) + row_number() OVER (ORDER BY id) - 1 AS new_id FROM floats)
WHERE new_id < (SELECT n FROM s) + (SELECT m FROM f) // 2""")
def insert_ids_capped(spark, sf):
    rows = _floats(spark, sf)
    start, m = table(spark, sf, "embeddings").count(), rows.count()
    new = numbered(rows.select(F.col("id").alias("old_id")), "new_id", start, "old_id")
    return new.where(F.col("new_id") < start + m // 2).select("old_id", "new_id")


@_query("""WITH w AS (SELECT max(vec_id) + 1 AS s FROM embeddings)
SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings UNION ALL SELECT vec_id + (SELECT s FROM w), CAST(len(embedding) AS INTEGER) FROM embeddings""")
def concatenated_elements(spark, sf):
    e = _elements(spark, sf)
    return concatenated(e, e).select("id", F.size("vec").alias("dim"))


# --- words and sums of embeddings -------------------------------------------------------

_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TEXT = "string_split(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$'), ':')[-1]"


@_query(r"""WITH tok AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM tok WHERE word <> '' GROUP BY word)
SELECT CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS INTEGER) AS word_id, word, n FROM c QUALIFY word_id < (SELECT count(*) FROM embeddings)""")
def word_dict(spark, sf):
    return E.frequent_words(table(spark, sf, "documents"), "text", table(spark, sf, "embeddings").count())


@_query(f"WITH {_WORDS} SELECT word, max(word_id) AS word_id FROM w GROUP BY word")
def word_ids(spark, sf):
    return E.word_dictionary(_words(spark, sf))


@_query(f"WITH {_WORDS} SELECT word_id, CAST(to_json(word) AS VARCHAR) AS line FROM w")
def word_lines(spark, sf):
    return _words(spark, sf).select("word_id", T.json_line(F.col("word")).alias("line"))


@_query(f"WITH {_LINES} SELECT line_id, {_TEXT} AS text FROM l")
def text_after_colon(spark, sf):
    return _lines(spark, sf).select("line_id", T.after_last_colon(T.json_text(F.col("value"))).alias("text"))


@_query(f"""WITH {_LINES}, {_WORDS}, ids AS (SELECT word, max(word_id) AS word_id FROM w GROUP BY word),
s AS (SELECT line_id, list_filter(string_split_regex({_TEXT}, '{_SPACE}'), lambda x: x <> '') AS ws FROM l),
p AS (SELECT line_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM s)
SELECT line_id AS id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY place) - 1 AS INTEGER) AS pos, word_id FROM p JOIN ids USING (word)""")
def parse_elements(spark, sf):
    parsed = E.parse_elements(_lines(spark, sf), "line_id", "value", E.word_dictionary(_words(spark, sf)))
    return parsed.select("id", F.posexplode("term_ids").alias("pos", "word_id"))


@_query(f"""WITH {_TERMS}, {_WORDS}, p AS (SELECT id, unnest(term_ids) AS term, unnest(range(len(term_ids))) AS pos FROM t),
s AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS text FROM p JOIN w ON w.word_id = term GROUP BY id)
SELECT t.id, coalesce(text, '') AS text FROM t LEFT JOIN s ON s.id = t.id""")
def element_words(spark, sf):
    return E.element_words(_terms(spark, sf), _words(spark, sf))


_SUMS = f"""{_TERMS}, {_DICT}, p AS (SELECT id, unnest(term_ids) AS term FROM t),
x AS (SELECT id, unnest(range(len(vec))) AS pos, unnest(vec) AS v FROM p JOIN d ON d.word_id = term),
g AS (SELECT id, pos, sum(v) AS value FROM x GROUP BY id, pos),
dim AS (SELECT max(len(vec)) AS n FROM d),
z AS (SELECT id, unnest(range(n)) AS pos FROM t, dim),
sums AS (SELECT z.id, z.pos, coalesce(value, 0.0) AS value FROM z LEFT JOIN g ON g.id = z.id AND g.pos = z.pos)"""


def _dim(spark: SparkSession, sf: str) -> int:
    """The length of the longest vector of the dictionary; where all rows agree, no row is moved."""
    least, most = table(spark, sf, "dict").where("vec is not null").agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    return (most if least == most else _dictionary(spark, sf).agg(F.max(F.size("vec"))).first()[0]) or 0


def _sums(spark, sf) -> DataFrame:
    return E.sum_embeddings(_terms(spark, sf), _dictionary(spark, sf), _dim(spark, sf))


@_query(f"WITH {_SUMS} SELECT id, CAST(pos AS INTEGER) AS pos, round(value, 5) AS value FROM sums")
def sum_embedding_long(spark, sf):
    return _long(_sums(spark, sf), "value", 5).withColumn("value", F.col("value") + 0.0)


@_query(f"WITH {_SUMS}, e AS (SELECT id, list(value ORDER BY pos) AS vec FROM sums GROUP BY id), {_knn_sql('e')}")
def sum_embedding_knn(spark, sf):
    terms, sums = _terms(spark, sf), E.summing(_dictionary(spark, sf), _dim(spark, sf))
    return _ranked(exact.knn(sums(_asked(terms)), sums(terms), 10))


@_query(f"""WITH {_TERMS}, {_DICT}, p AS (SELECT id, unnest(term_ids) AS term, unnest(range(len(term_ids))) AS pos FROM t),
r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round({_norm_sql('vec')}, 9) DESC, pos DESC) - 1 AS k FROM p JOIN d ON d.word_id = term)
SELECT t.id, CAST(q.k AS INTEGER) AS pos, coalesce(r.term, 0) AS term FROM t JOIN range(8) q(k) ON true LEFT JOIN r ON r.id = t.id AND r.k = q.k""")
def embedding_norm_keys(spark, sf):
    norms = _dictionary(spark, sf).select("word_id", F.round(V.norm(F.col("vec")), 9).alias("norm"))
    keys = reorder.norm_keys(_terms(spark, sf), norms)
    return keys.select("id", F.posexplode("key").alias("pos", "term"))


@_query(f"""WITH {_SUMS}, v AS (SELECT id, list(value ORDER BY pos) AS vec FROM sums GROUP BY id),
f AS (SELECT id, list_transform(vec, lambda x: CAST(CASE WHEN {_norm_sql('vec')} > 0 THEN x / {_norm_sql('vec')} ELSE x END AS FLOAT)) AS raw FROM v),
top AS (SELECT id, raw, list_max(list_transform(raw, lambda x: abs(x))) AS m FROM f)
SELECT id, CAST(unnest(range(len(raw))) AS INTEGER) AS pos,
  unnest(list_transform(raw, lambda x: CASE WHEN m > 0 THEN CAST(trunc(CAST(CAST(x * 127::FLOAT AS FLOAT) / m AS FLOAT)) AS TINYINT) ELSE 0::TINYINT END)) AS value FROM top""")
def quantized_sum_long(spark, sf):
    return _long(E.quantized_sums(_terms(spark, sf), _dictionary(spark, sf), _dim(spark, sf)), "value")


# --- the layered index ------------------------------------------------------------------


def _index(spark, sf) -> Index:
    return IndexBuilder(_elements(spark, sf), CONFIG).build()


@_query(f"WITH {_ELEMENTS}, {_knn_sql('elements')}")
def ann_full_beam(spark, sf):
    """With a beam as wide as the index nothing is pruned: the exact result, if the graph is connected."""
    index = _index(spark, sf)
    return _ranked(index.search(_asked(_elements(spark, sf)), max_search=index.num_elements(), k=10, query_id="id"))


@_query(f"WITH {_LAYERS} SELECT layer, size AS nodes, 0::BIGINT AS loops, 0::BIGINT AS over_degree, 0::BIGINT AS dangling FROM layers WHERE tab = 'embeddings'")
def layered_build_stats(spark, sf):
    return neighbour_invariants(_index(spark, sf)).drop("edges")


@_query("SELECT true AS ok")
def ann_recall_ok(spark, sf):
    """Whether the first of the found neighbours is the exact one for more than 95 in 100 queries (no independent check)."""
    e = _elements(spark, sf)
    queries = _asked(e)
    found = _index(spark, sf).search(queries, max_search=50, k=1, query_id="id").select("query_id", F.col("id").alias("found"))
    right = exact.knn(queries, e, 1).select(F.col("query_id").alias("q"), "id")
    both = right.join(found, F.col("q") == F.col("query_id"), "left")
    return both.agg((F.coalesce(F.avg((F.col("found") == F.col("id")).cast("double")), F.lit(1.0)) > 0.95).alias("ok"))


@_query()
def ann_search_vectors(spark, sf):
    """Approximate neighbours over the larger table of vectors, in shards."""
    e = _floats(spark, sf).where(V.indexable(F.col("vec")))
    return _ranked(IndexBuilder(e, CONFIG).build().search(_asked(e), max_search=50, k=10, query_id="id"))


@_query("SELECT 1 AS version, CAST((count(*) + 1) // 2 AS BIGINT) AS elements FROM embeddings UNION ALL SELECT 2, count(*) FROM embeddings")
def growing_index(spark, sf):
    """Two batches inserted into a growing index; its size after each."""
    e = _elements(spark, sf)
    n = e.count()
    g = GrowingIndex(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/growing-{uuid.uuid4().hex}", n, CONFIG)
    rows = []
    for k, part in enumerate((e.where("id % 2 = 0"), e.where("id % 2 = 1"))):
        g.insert_batch(part, k)
        rows.append((g.state()["version"], len(g)))
    return spark.createDataFrame(rows, "version int, elements long")


@cache
def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
