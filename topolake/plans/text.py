"""Text and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.operators import contexts as C
from topolake.operators import generate as G
from topolake.operators import kernel as K
from topolake.operators import names as N
from topolake.operators import provenance as P
from topolake.operators import replies as R
from topolake.operators import text as X
from topolake.operators import topology as T
from topolake.sources.graphs import graphs, load, load_dim, sql_with

from .topology import _BOTH, _FK, _UFK, _dist

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(sql_with() + """, l AS (SELECT dataset, 0 AS part, 'TABLE ' || name AS line FROM nodes UNION ALL SELECT DISTINCT dataset, CASE edge_type WHEN 'fk_to' THEN 1 ELSE 2 END,
  CASE edge_type WHEN 'fk_to' THEN src || ' FK_TO ' || dst ELSE dst || ' DERIVED_FROM ' || src END FROM edges) SELECT dataset, string_agg(line, chr(10) ORDER BY part, line) AS text FROM l GROUP BY 1""")
def t1_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.schema_text(*load(spark, sf_dir))


@query(sql_with(_FK) + """, l AS (SELECT DISTINCT dataset, src AS name, 'references ' || dst AS line FROM fk UNION SELECT DISTINCT dataset, dst, 'referenced by ' || src FROM fk)
SELECT n.dataset, n.name, n.name || ': ' || coalesce((SELECT string_agg(line, '; ' ORDER BY line) FROM l WHERE l.dataset = n.dataset AND l.name = n.name), 'isolated') AS text FROM nodes n""")
def t2_table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunks(*load(spark, sf_dir))


@query("""WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
q AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1),
s AS (SELECT q.label AS q, e.vec_id AS id, round(list_sum(list_transform(list_zip(q.v, e.embedding), lambda z: z[1] * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(q.v, lambda a: a * a))) / sqrt(list_sum(list_transform(e.embedding, lambda a: a::DOUBLE * a::DOUBLE))), 6) AS similarity FROM q, embeddings e)
SELECT q, CAST(r AS INTEGER) AS position, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS r FROM s) WHERE r <= 15""")
def t3_t4_j21_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen rows nearest to each label's centroid: as many queries as there are labels."""
    e = _t(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = mean.groupBy(F.col("label").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    return X.nearest(centre, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 15)


@query(sql_with(_FK) + """, k AS (SELECT dataset, name, row_number() OVER (PARTITION BY dataset ORDER BY name) AS r FROM nodes), c AS (SELECT dataset, string_agg(name, ',' ORDER BY name) AS chunks FROM k WHERE r <= 15 GROUP BY 1)
SELECT c.dataset, chunks || '|' || coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT e.src || '>' || e.dst AS x FROM edges e WHERE e.dataset = c.dataset AND e.edge_type = 'derived_from')), '') AS context FROM c""")
def t5_retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some chunks and all derivations of the dataset."""
    from pyspark.sql import Window

    nodes, edges = load(spark, sf_dir)
    few = nodes.withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy("name"))).where("r <= 15").groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("chunks"))
    lineage = K.directed(edges, "derived_from").groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "src", "dst"))), ",").alias("all"))
    return few.join(lineage, "dataset", "left").select("dataset", F.concat("chunks", F.lit("|"), F.coalesce("all", F.lit(""))).alias("context"))


_QUESTIONS = [
    (1, "How do lineitem and customer join?"), (2, "Which orders reach region through nation?"), (3, "What derives from pages?"), (4, "Is customer_address not customer?"), (5, "Nothing here"),
]
_QV = "q(id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _QUESTIONS) + ")"
_HIT = """hit AS (SELECT DISTINCT q.id, n.name FROM (SELECT id, unnest(string_split_regex(text, '[^A-Za-z0-9_.]+')) AS w FROM q) q JOIN nodes n ON n.dataset = 'star' AND n.name = q.w)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_QUESTIONS, "id int, text string")


def _star_names() -> list[str]:
    return [n for d, _, n in graphs()[0] if d == "star"]


@query(sql_with(_QV, _HIT) + "SELECT q.id, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM hit h WHERE h.id = q.id), '') AS tables FROM q")
def j16_longest_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mentions(_questions(spark, sf_dir), _star_names()).select("id", F.array_join(F.array_sort("mentioned"), ",").alias("tables"))


@query(sql_with(_QV) + "SELECT q.id, n.name FROM q JOIN nodes n ON n.dataset = 'star' AND contains(lower(q.text), lower(n.name))")
def j17_contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir)[0].where("dataset = 'star'").select("name")
    return _questions(spark, sf_dir).join(F.broadcast(names), F.contains(F.lower("text"), F.lower("name"))).select("id", "name")


@query(sql_with(_FK, _UFK, _dist("ufk", 3), _QV, _HIT) + """, near AS (SELECT DISTINCT h.id, d.t AS name FROM hit h JOIN dist d ON d.dataset = 'star' AND d.s = h.name AND d.d <= 3)
SELECT n.id, string_agg(n.name, ',' ORDER BY n.name) AS tables, (SELECT string_agg(DISTINCT f.src || '>' || f.dst, ',' ORDER BY f.src || '>' || f.dst) FROM fk f WHERE f.dataset = 'star' AND f.src IN (SELECT name FROM near m WHERE m.id = n.id) AND f.dst IN (SELECT name FROM near m WHERE m.id = n.id)) AS edges FROM near n GROUP BY n.id""")
def t6_graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables within three hops of the mentioned ones, and the references among them."""
    edges = load(spark, sf_dir)[1].where("dataset = 'star'")
    hit = X.mentions(_questions(spark, sf_dir), _star_names()).select("id", F.explode("mentioned").alias("seed"))
    walk = K.reach(K.undirected(edges, "fk_to"), hit.select(F.lit("star").alias("dataset"), "seed").distinct(), max_depth=3)
    near = hit.join(walk.select("seed", F.col("node").alias("name")), "seed").select("id", "name").distinct()
    fk = K.directed(edges, "fk_to").select("src", "dst")
    among = near.withColumnRenamed("name", "src").join(fk, "src").join(near.withColumnRenamed("name", "dst"), ["id", "dst"]).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "src", "dst"))), ",").alias("edges"))
    return near.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tables")).join(among, "id", "left")


@query("""SELECT r_name AS silo, 'silo ' || r_name || ': ' || count(*) || ' nations, first ' || min(n_name) AS context FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def t7_value_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("silo")).agg(F.concat(F.lit("silo "), F.first("r_name"), F.lit(": "), F.count("*").cast("string"), F.lit(" nations, first "), F.min("n_name")).alias("context"))


def _words_vector(text: str):
    """64 counts of hashed words: stands where a model's embedding of the text would be an input column."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(64)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))


@query(None)
def t5_question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's nearest chunks of the star, and all its derivations."""
    nodes, edges = (t.where("dataset = 'star'") for t in load(spark, sf_dir))
    chunks = C.chunk_texts(nodes, edges).withColumn("vec", _words_vector("text"))
    return C.retrieved(_questions(spark, sf_dir).withColumn("vec", _words_vector("text")), chunks, edges)


@query(None)
def t6_question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, features, touching edges and paths around the tables that each question mentions."""
    return C.surroundings(_questions(spark, sf_dir), *(t.where("dataset = 'star'") for t in load(spark, sf_dir)))


_VALUE_QUESTIONS = [
    (1, "Which rows feed row_3 of mart_delivery_performance?"), (2, "How many rows has dim_supplier, and what does mart_supplier_scorecard take from it?"), (3, "Which silos are isolated?"),
]


@query(None)
def t7_question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silos, lineage chains, samples and row lineage of the layered schema; raw tables have no generator, so no sample."""
    nodes, edges = (t.where("dataset = 'sales'") for t in load(spark, sf_dir))
    dim = load_dim(spark, sf_dir).join(nodes.select("name", F.col("node_id").alias("place")), "name")
    edges = P.layered_rows(edges.where("edge_type = 'derived_from'"), dim)
    # Sizes of a catalogue's tables.
    sizes = {r["name"]: (r["kind"], r["rows"]) for r in G.row_counts(dim).collect()}
    makes = {
        "staging": lambda n: G.staging_rows(spark, n, G.RANGES["raw"][0]), "dim": lambda n: G.dimension_rows(spark, n), "fact": lambda n: G.fact_rows(spark, n, {}), "mart": lambda n: G.mart_rows(spark, n),
    }
    three = {k: make(3) for k, make in makes.items()}
    texts = {k: [r[0] for r in df.orderBy(df.columns[0]).select(F.to_json(F.struct("*"))).collect()] for k, df in three.items()}
    samples = spark.createDataFrame([(name, n, texts.get(kind, [])) for name, (kind, n) in sizes.items()], "table string, n_rows long, rows array<string>")
    questions = spark.createDataFrame(_VALUE_QUESTIONS, "id int, text string")
    return C.values(questions, dim, edges, samples)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'The answer is ' || o_custkey || '.' WHEN 1 THEN 'Path of ' || o_orderpriority ELSE CASE WHEN o_totalprice > 150000 THEN 'They are connected.' ELSE 'They are not connected.' END END AS evidence FROM orders""")
def t8_evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.format_string("The answer is %d.", "o_custkey")).when(k % 3 == 1, F.concat(F.lit("Path of "), "o_orderpriority")).otherwise(F.when(F.col("o_totalprice") > 150000, "They are connected.").otherwise("They are not connected."))
    return _t(spark, sf_dir, "orders").select(k.alias("id"), text.alias("evidence"))


_COLUMNS = [("dbo", "DimTime", "SK_TimeID", "int", None, "NO", 1), ("dbo", "DimTime", "TimeValue", "varchar", "20", "NO", 2), ("dbo", "Industry", "IN_ID", "char", "2", "NO", 1), ("dbo", "Industry", "IN_NAME", "varchar", "50", "YES", 2)]


@query("""SELECT 'DimTime' AS name, 'CREATE TABLE DimTime (SK_TimeID int NOT NULL, TimeValue varchar(20) NOT NULL)' AS ddl UNION ALL SELECT 'Industry', 'CREATE TABLE Industry (IN_ID char(2) NOT NULL, IN_NAME varchar(50))'""")
def t9_ddl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_COLUMNS, "schema string, name string, column string, type string, length string, nullable string, ordinal int")
    size = F.when(F.col("length").try_cast("int") > 0, F.concat(F.lit("("), "length", F.lit(")"))).otherwise("")
    column = F.concat("column", F.lit(" "), "type", size, F.when(F.col("nullable") == "NO", " NOT NULL").otherwise(""))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", column.alias("c")))), lambda x: x["c"]), ", ")
    return rows.groupBy("name").agg(F.concat(F.lit("CREATE TABLE "), F.first("name"), F.lit(" ("), held, F.lit(")")).alias("ddl"))


_REPLIES = [
    (1, '{"answer": 5}', '{"answer": 5}'), (2, 'Sure:\n```json\n{"answer": "yes"}\n```', '{"answer": "yes"}'), (3, 'so {"a": {"b": 1}} or {"c": 2}', '{"a": {"b": 1}}'),
    (4, '{"answer_list": ["x", "y", "z', '{"answer_list": ["x", "y"]}'), (5, "<think>{\"answer\": 1}</think>The answer is 7.", '{"answer": "7"}'), (6, "no idea", '{"answer": "no idea"}'),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, _, w in _REPLIES) + ") v(id, parsed)")
def t10_json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t, _ in _REPLIES], "id int, text string").select("id", X.recovered("text").alias("parsed"))


@query("SELECT * FROM (VALUES (1, 'x:row_2,y'), (2, 'b,a')) v(id, answer)")
def t11_typed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, '{"answer_list": ["y", {"table": "x", "row": 2}]}', "list"), (2, '{"answer_list": ["b", "a"]}', "ordered_list")], "id int, parsed string, answer_type string")
    return rows.select("id", F.array_join(X.typed_answer(F.col("parsed"), F.col("answer_type"))["list"], ",").alias("answer"))


_MAP = """m AS (SELECT dataset, name AS original, 'Table_' || chr(CAST(65 + i % 26 AS INTEGER)) || CASE WHEN i >= 26 THEN (i // 26)::VARCHAR ELSE '' END AS obfuscated FROM
  (SELECT dataset, name, row_number() OVER (PARTITION BY dataset ORDER BY md5(name || ':42'), name) - 1 AS i FROM nodes))"""


@query(sql_with(_MAP) + "SELECT * FROM m")
def t12_obfuscation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.obfuscation(load(spark, sf_dir)[0])


@query(sql_with(_MAP) + """SELECT 1 AS id, 'How do ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'lineitem') || ' and ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'customer') || ' join?' AS text
  UNION ALL SELECT 2, 'Which ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'orders') || ' reach ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'region') || ' through ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'nation') || '?'
  UNION ALL SELECT 3, 'What derives from ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'pages') || '?'
  UNION ALL SELECT 4, 'Is customer_address not ' || (SELECT obfuscated FROM m WHERE dataset = 'star' AND original = 'customer') || '?' UNION ALL SELECT 5, 'Nothing here'""")
def t13_obfuscate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The mapping of one schema: its table names, a catalogue.
    rows = X.obfuscation(load(spark, sf_dir)[0].where("dataset = 'star'")).collect()
    return X.obfuscate(_questions(spark, sf_dir), {r["original"]: r["obfuscated"] for r in rows})


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON len(b.text) >= 5 AND contains(d.text, b.text)")
def t14_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text whole."""
    return X.leakage(_t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "benchmark"))


@query("SELECT vec_id, CAST(64 + 2 AS INTEGER) AS width, label AS tail FROM embeddings")
def t15_re_embed_keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New embeddings before the old structural tail."""
    df = _t(spark, sf_dir, "embeddings").withColumn("old", F.concat("embedding", F.array(F.col("label").cast("float"), F.lit(1.0).cast("float"))))
    fresh = F.concat(F.transform("embedding", lambda x: -x), F.slice("old", 65, 2))
    return df.select("vec_id", F.size(fresh).alias("width"), F.get(fresh, 64).cast("int").alias("tail"))


@query("SELECT 1 AS id, 'no table named' AS flags UNION ALL SELECT 2, '' UNION ALL SELECT 3, 'too many answers,not a question'")
def t16_solvability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "How many silos?", "integer", 1), (2, "What feeds dim_patient?", "list", 3), (3, "List all of raw_lab", "list", 80)], "id int, text string, answer_type string, n_answers int")
    return X.solvable(rows).select("id", F.array_join("flags", ",").alias("flags"))


@query(sql_with(_BOTH, _dist("both_", 14)) + "SELECT dataset, CAST(max(d) AS INTEGER) AS diameter FROM dist GROUP BY dataset")
def t6_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hop_counts(*load(spark, sf_dir)).groupBy("dataset").agg(F.max("hops").alias("diameter"))


# Every document with the customer and the part of its number put before and after its text; names of three tables and words of one.
_NAMED = "named AS (SELECT doc_id, concat_ws(' ', c_name, text, p_name) AS text FROM documents LEFT JOIN customer ON c_custkey = doc_id LEFT JOIN part ON p_partkey = doc_id)"
_NAMES = "known AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, customer, part = (_t(spark, sf_dir, n) for n in ("documents", "customer", "part"))
    both = docs.join(customer.select(F.col("c_custkey").alias("doc_id"), "c_name"), "doc_id", "left").join(part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id", "left")
    return both.select("doc_id", F.concat_ws(" ", "c_name", "text", "p_name").alias("text"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_name").distinct()
    out = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(_t(spark, sf_dir, "supplier").select("s_name"))
    return out.union(part).union(part.select(F.explode(F.split("p_name", " ")))).distinct()


@query(f"WITH {_NAMED}, {_NAMES} SELECT doc_id, name FROM named JOIN known ON contains(lower(text), lower(name))")
def j17_names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a customer, supplier or part, or word of a part's, that a document contains."""
    return N.contained(_named(spark, sf_dir), _names(spark, sf_dir), id="doc_id").select(F.col("id").alias("doc_id"), "name")


@query(f"""WITH RECURSIVE {_NAMED}, {_NAMES}, hit AS (SELECT doc_id, lower(text) AS low, name FROM named JOIN known ON contains(lower(text), lower(name))),
spot AS (SELECT doc_id, low, name, CAST(strpos(low, lower(name)) AS BIGINT) AS p FROM hit
  UNION ALL SELECT doc_id, low, name, p + strpos(substr(low, p + 1), lower(name)) FROM spot WHERE strpos(substr(low, p + 1), lower(name)) > 0),
one AS (SELECT doc_id, p - 1 AS s, p - 1 + length(name) AS e, name FROM spot),
free AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", name FROM free WHERE e > before""")
def j16_names_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the names stand, the longest first; here places lie within one another or apart, so the SQL keeps the outermost."""
    return N.places(_named(spark, sf_dir), _names(spark, sf_dir), id="doc_id").withColumnRenamed("id", "doc_id")


@query("""WITH n AS (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part), m AS (SELECT name, 'N_' || left(md5(name), 12) AS new FROM n),
d AS (SELECT doc_id, text, c_name, p_name FROM documents LEFT JOIN customer ON c_custkey = doc_id LEFT JOIN part ON p_partkey = doc_id)
SELECT doc_id, md5(concat_ws(' ', a.new, text, b.new)) AS text_md5 FROM d LEFT JOIN m a ON a.name = c_name LEFT JOIN m b ON b.name = p_name""")
def t13_names_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with names of customers and parts replaced by made ones; the SQL puts the made ones in from the start."""
    names = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("original")).union(_t(spark, sf_dir, "part").select("p_name")).distinct()
    new = N.replaced(_named(spark, sf_dir), names.withColumn("obfuscated", F.concat(F.lit("N_"), F.substring(F.md5("original"), 1, 12))), id="doc_id")
    return new.select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 8 AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN f IN (3, 4) THEN NULL WHEN f = 1 THEN 'integer' WHEN f = 5 THEN 'boolean' WHEN f = 6 THEN 'null' ELSE 'string' END AS kind,
  CASE f WHEN 0 THEN text WHEN 1 THEN CAST(conv_id AS VARCHAR) WHEN 2 THEN role WHEN 5 THEN CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END WHEN 7 THEN left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 300) END AS answer,
  CASE f WHEN 3 THEN array_to_string(list_sort(['conversations:row_' || turn, role]), ',') WHEN 4 THEN role END AS listed
FROM c WHERE f IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL""")
def d15_t10_t11_variant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a reply in one of eight forms: an object, fenced, stated after thoughts, braced in prose, cut short, true or false, null, and as it is."""
    c = _t(spark, sf_dir, "conversations").withColumn("f", (F.col("conv_id") + F.col("turn")) % 8).where("f IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL")
    said = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    listed = F.concat(F.lit('{"answer_list": ['), F.concat(F.lit('"'), "role", F.lit('", ')), said(table=F.lit("conversations"), row=F.col("turn")), F.lit("]}"))
    forms = [
        said(answer=F.col("text")), F.concat(F.lit("Sure:\n```json\n"), said(answer=F.col("conv_id")), F.lit("\n```")), F.concat(F.lit('<think>{"answer": 1}</think>The answer is '), "role", F.lit(".")),
        F.concat(F.lit("so "), listed, F.lit(" or {}")), F.concat(F.lit('{"answer_list": ["'), "role", F.lit('", "x')), said(answer=F.col("turn") % 2 == 0), F.lit('{"answer": null}'), F.col("text"),
    ]
    reply = F.when(F.col("f") == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        reply = reply.when(F.col("f") == i, form)
    read = c.withColumn("v", R.recovered(reply)).withColumn("t", R.typed(F.col("v"), F.lit("list")))
    return read.select("conv_id", "turn", F.col("t.kind").alias("kind"), F.col("t.text").alias("answer"), F.array_join("t.list", ",").alias("listed"))
