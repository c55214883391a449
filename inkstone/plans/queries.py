"""The registered queries over the driver's tables, each beside the SQL that says the same.

Orders (with their customer) stand for parent records, line items (with their part) for their entries, suppliers
for batches, and events for the change log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import relational as rel
from inkstone.operators.search import SearchQuery, after, gated, ordered, page, search
from inkstone.plans.docs import build_docs, postings
from inkstone.schema import FIELDS, WEIGHTS
from inkstone.sources.log import fold_payloads, parsed

_NORM = r"regexp_replace(lower({}), '[\s\p{{Z}}\p{{P}}\p{{S}}]', '', 'g')"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parents(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("code"), F.col("c_mktsegment").alias("source"),
        F.col("o_orderstatus").alias("paperSize"), F.lit("").alias("note"), F.col("o_orderdate").cast("date").cast("string").alias("createdAt"),
    )


def children(spark: SparkSession, d: str) -> DataFrame:
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey, "left").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("rubbingId"),
        F.col("p_type").alias("position"), F.col("p_name").alias("type"),
        F.when(F.col("l_linestatus") == "F", "repaired").otherwise("pending").alias("status"), F.lit("").alias("repairNote"),
        F.col("l_shipdate").cast("date").cast("string").alias("createdAt"), F.col("l_suppkey").cast("string").alias("batchId"),
    )


def batches(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("open").alias("status"), F.lit("").alias("note"),
        F.lit("2000-01-01").alias("createdAt"),
    )


def docs(spark: SparkSession, d: str) -> DataFrame:
    return build_docs(parents(spark, d), children(spark, d), batches(spark, d))


_DOCS = """docs AS (
  SELECT 'rubbing' AS kind, o_orderkey::VARCHAR AS id, o_orderpriority AS code, coalesce(c_mktsegment, '') AS source, '' AS damageType,
         '' AS name, o_orderstatus AS other, o_orderdate::DATE::VARCHAR AS createdAt
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'damage', l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR, coalesce(o_orderpriority, ''), coalesce(c_mktsegment, ''),
         coalesce(p_name, ''), coalesce(p_type, ''), CASE WHEN l_linestatus = 'F' THEN 'repaired' ELSE 'pending' END, l_shipdate::DATE::VARCHAR
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'batch', s_suppkey::VARCHAR, s_suppkey::VARCHAR, '', '', s_name, 'open', '2000-01-01' FROM supplier)"""
_FUZZY = """CASE WHEN {n} = '{q}' THEN {w} + 20 WHEN contains({n}, '{q}') THEN {w} + 8
  WHEN len(list_filter(flatten(list_transform([{a}, {b}, {c}], lambda z: list_transform(range(1, greatest(len({n}) - z + 2, 1)), lambda i: substr({n}, i, z)))),
       lambda p: levenshtein(p, '{q}') <= 1)) > 0 THEN {w} - 10 END"""


def _score_sql(field: str, q: str) -> str:
    n = f"CASE WHEN {field} <> '' THEN {_NORM.format(field)} END"
    return _FUZZY.format(n=f"({n})", q=q, w=WEIGHTS[field] * 10, a=max(2, len(q) - 1), b=len(q), c=len(q) + 1)


def _gate_sql(fields: list[str], grams: list[list[str]]) -> str:
    """ASCII queries only: a gram is a whole run of letters and digits."""
    one = lambda f, g: f"list_contains(regexp_extract_all({_NORM.format(f)}, '[a-z0-9]+'), '{g}')"
    return " AND ".join("(" + " OR ".join(one(f, g) for f in fields for g in gs) + ")" for gs in grams) or "true"


_HIT = ["kind", "id", "code", "createdAt", "score"]
_COMBINED = {"code": "1-URGENT", "source": "BUILDING", "kind": "damages,rubbings", "dateFrom": "1995-01-01", "dateTo": "1997-12-31"}


def _combined(spark: SparkSession, d: str) -> DataFrame:
    return search(docs(spark, d), SearchQuery.from_params(_COMBINED)).select(*_HIT)


_COMBINED_SQL = f"""hits AS (SELECT kind, id, code, createdAt,
    CASE WHEN {_NORM.format("code")} = '1urgent' THEN 120 ELSE 108 END + CASE WHEN {_NORM.format("source")} = 'building' THEN 80 ELSE 68 END AS score
  FROM docs WHERE kind IN ('damage', 'rubbing') AND createdAt >= '1995-01-01' AND createdAt <= '1997-12-31'
  AND {_gate_sql(["code"], [["1urgent"]])} AND {_gate_sql(["source"], [["building"]])})"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Top 100 of a combined search."""
    return ordered(_combined(spark, d)).limit(100)


def _cursor() -> dict:
    return {"s": 200, "t": "1996-06-01", "c": "1-URGENT", "i": "5", "k": "damage"}


def _normalize(spark: SparkSession, d: str) -> DataFrame:
    one = _t(spark, d, "customer").select(F.lit("c").alias("of"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("x"))
    two = _t(spark, d, "documents").select(F.lit("d").alias("of"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    return one.unionByName(two).select("of", "id", X.norm(spark, F.col("x")).alias("norm"))


def _tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "documents").select("doc_id", X.tokens(X.norm(spark, F.col("text"))).alias("g"))
    return t.select("doc_id", F.size("g").cast("long").alias("n_tokens"), F.array_join(F.array_sort("g"), " ").alias("tokens"))


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    q = "blueanvel"
    n = X.norm(spark, F.col("p_name"))
    p = _t(spark, d, "part").select("p_partkey", n.alias("n")).withColumn("piece", F.when(F.col("n").contains(q), q).otherwise(X.window(F.col("n"), q)))
    return p.where("piece IS NOT NULL").select("p_partkey", "piece", F.levenshtein("piece", F.lit(q)).cast("long").alias("distance"))


def _field_exact(spark: SparkSession, d: str) -> DataFrame:
    return search(docs(spark, d), SearchQuery(source="building")).select(*_HIT)


def _free(spark: SparkSession, d: str) -> DataFrame:
    out = search(docs(spark, d), SearchQuery(q="pending"))
    return out.select(*_HIT, F.col("matchedReasons")[0]["match"].alias("match"))


def _gate(spark: SparkSession, d: str) -> DataFrame:
    return gated(docs(spark, d), "1urgent").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return postings(docs(spark, d)).groupBy("gram", "field").agg(F.count(F.lit(1)).alias("n_docs"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return search(docs(spark, d), SearchQuery(dateFrom="1996-01-01", dateTo="1996-06-30")).select("kind", "id", "createdAt")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return search(docs(spark, d), SearchQuery(kind="批次, RUBBINGS, unknown")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _keyset(spark: SparkSession, d: str) -> DataFrame:
    hits = _combined(spark, d)
    before = hits.agg(F.count_if(~after(_cursor()))).scalar()
    return page(hits, 20, _cursor()).withColumn("page_index", F.floor(before / 20).cast("long") + 1)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return rel.parent_counts(parents(spark, d), children(spark, d)).select("id", "damageCount", "pendingDamages")


def _batch_enrich(spark: SparkSession, d: str) -> DataFrame:
    li = children(spark, d)
    ids = li.withColumn("o", F.col("id")).groupBy("batchId").agg(F.array_sort(F.collect_set("id")).alias("damageIds"))
    b = batches(spark, d).join(ids, F.col("id") == F.col("batchId"), "left").select("id", "name", "damageIds")
    return rel.enrich_batches(b, li.drop("batchId")).select(
        "id", F.col("total").cast("long").alias("total"), F.col("repaired").cast("long").alias("repaired"), F.col("pending").cast("long").alias("pending")
    )


def _filter(spark: SparkSession, d: str) -> DataFrame:
    return rel.filter_children(children(spark, d), "repaired").select("id", "type", "createdAt")


def _refs(which: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return which(parents(spark, d).select("id"), children(spark, d).select(F.col("rubbingId").alias("id")))

    return run


def _override(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.lit("none").alias("note"))
    over = _t(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("at"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("note"),
    )
    return rel.first_override(rows, over, "p_partkey", "at", ["note"])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")


_DELETED = "event_type = 'error'"


def _fold(spark: SparkSession, d: str) -> DataFrame:
    return rel.fold(_events(spark, d), ["user_id"], ["event_id"], F.expr(_DELETED))


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    return rel.as_of(_events(spark, d), ["user_id"], "event_id", 5000, F.expr(_DELETED))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return rel.intervals(_events(spark, d), ["user_id"], "event_id").select("user_id", "valid_from", "valid_to", "event_type")


def _prune(spark: SparkSession, d: str) -> DataFrame:
    return rel.prune(_intervals(spark, d), 8000)


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return rel.cascade_keys(children(spark, d), parents(spark, d).where("code = '1-URGENT'"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n")
    out = n(parents(spark, d), "rubbings").unionByName(n(children(spark, d), "damages")).unionByName(n(batches(spark, d), "batches"))
    return out.unionByName(_events(spark, d).agg(F.max("event_id").cast("long").alias("n")).select(F.lit("seq").alias("what"), "n"))


def _build(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("kind", "id", *FIELDS, "createdAt")


def _t2s(spark: SparkSession, d: str) -> DataFrame:
    words = ["蟲蛀孔與撕裂", "舊紙張發黴", "裝幀損傷", "墓誌銘拓本", "乾隆後漢"]
    return spark.createDataFrame(list(enumerate(words)), "id long, w string").select("id", X.t2s(spark, F.col("w")).alias("s"))


# Fixed values of the made-up archive: written forms, each beside its normal form.
_MARKS = [("ＴＰ－", "tp"), ("Tp ", "tp"), ("①／", "1"), ("（碑）", "碑")]
_REIGNS = [("漢", "汉"), ("清", "清"), ("乾隆", "乾隆"), ("嶽", "岳"), ("鶏", "鸡")]
_DAMAGES = [("蟲蛀孔", "虫蛀孔"), ("虫蛀　孔", "虫蛀孔"), ("撕裂", "撕裂"), ("黴變", "霉变"), ("水渍", "水渍"), ("折痕斷裂", "折痕断裂")]


def _cjk_docs(spark: SparkSession, d: str) -> DataFrame:
    """A doc for each line item whose values are written forms chosen by its keys."""
    li = _t(spark, d, "lineitem")
    of = lambda values, k: F.element_at(F.array(*[F.lit(a) for a, _ in values]), (F.col(k) % len(values) + 1).cast("int"))
    code = F.concat(of(_MARKS, "l_suppkey"), of(_REIGNS, "l_partkey"), F.lpad((F.col("l_orderkey") % 50).cast("string"), 3, "0"))
    empty = F.lit("")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("damage").alias("kind"), code.alias("code"), of(_DAMAGES, "l_orderkey").alias("damageType"),
        empty.alias("source"), empty.alias("name"), empty.alias("other"), F.col("l_shipdate").cast("date").cast("string").alias("createdAt"),
    )


def _list(values: list[tuple[str, str]], which: int) -> str:
    return "[" + ", ".join(f"'{v[which]}'" for v in values) + "]"


_CJK_SQL = f"""cjk AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_shipdate::DATE::VARCHAR AS createdAt,
    ({_list(_MARKS, 0)})[l_suppkey % {len(_MARKS)} + 1] || ({_list(_REIGNS, 0)})[l_partkey % {len(_REIGNS)} + 1] || lpad((l_orderkey % 50)::VARCHAR, 3, '0') AS code,
    ({_list(_MARKS, 1)})[l_suppkey % {len(_MARKS)} + 1] AS mark, ({_list(_REIGNS, 1)})[l_partkey % {len(_REIGNS)} + 1] AS reign, lpad((l_orderkey % 50)::VARCHAR, 3, '0') AS num,
    ({_list(_DAMAGES, 1)})[l_orderkey % {len(_DAMAGES)} + 1] AS damage FROM lineitem)"""


def _cjk_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = _cjk_docs(spark, d)
    return rows.select("id", X.norm(spark, F.col("code")).alias("code"), X.norm(spark, F.col("damageType")).alias("damage"))


def _cjk_tokens(spark: SparkSession, d: str) -> DataFrame:
    both = X.norm(spark, F.concat("code", F.lit(" "), "damageType"))
    return _cjk_docs(spark, d).select("id", F.array_join(F.array_sort(X.tokens(both)), " ").alias("tokens"))


_CJK_TOKENS_SQL = f"""WITH {_CJK_SQL}, n AS (SELECT row_number() OVER () AS rid, id, mark || reign || num || damage AS n FROM cjk),
r AS (SELECT rid, id, unnest(regexp_extract_all(n, '[a-z0-9]+|[\\x{{4E00}}-\\x{{9FFF}}]+')) AS r FROM n),
g AS (SELECT rid, id, CASE WHEN regexp_matches(r, '^[a-z0-9]') THEN [r]
  ELSE list_concat(string_split(r, ''), list_transform(range(1, greatest(len(r), 1)), lambda i: substr(r, i, 2))) END AS g FROM r)
SELECT id, array_to_string(list_sort(list_distinct(flatten(list(g)))), ' ') AS tokens FROM g GROUP BY rid, id"""


def _reasons(params: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = search(_cjk_docs(spark, d), SearchQuery.from_params(params))
        return hits.select("id", "code", "createdAt", "score", F.explode("matchedReasons").alias("r")).select("id", "code", "createdAt", "score", "r.*")

    return run


_TYPO_SQL = f"""WITH {_CJK_SQL} SELECT id, code, createdAt, 70 AS score, '病害类型' AS field, '蟲柱孔' AS query, 'fuzzy' AS match, 1 AS distance,
  '关键词近似命中病害类型（与「虫蛀孔」相差 1 字，已按错一个字容错）' AS detail FROM cjk WHERE damage = '虫蛀孔'"""
_MIXED_SQL = f"""WITH {_CJK_SQL}, h AS (SELECT *, CASE WHEN mark || reign = 'tp汉' THEN 108 ELSE 90 END AS c FROM cjk
  WHERE mark || reign || num LIKE '%tp汉%' AND damage = '霉变')
SELECT id, code, createdAt, 208 AS score, unnest(['编号', '病害类型']) AS field, unnest(['ＴＰ漢', '黴變']) AS query, 'exact' AS match, 0 AS distance,
  unnest(['命中编号', '命中病害类型']) AS detail FROM h"""


def _change_rows(spark: SparkSession, d: str) -> DataFrame:
    """An upsert of one field for each event, a delete for each error."""
    field = F.concat(F.lit('{"id":"'), F.col("user_id").cast("string"), F.lit('","'), F.col("event_type"), F.lit('":'), F.col("event_id").cast("string"), F.lit("}"))
    return _t(spark, d, "events").select(
        F.lit("rubbing").alias("kind"), F.col("user_id").cast("string").alias("id"), field.alias("payload"), F.lit(None).cast("long").alias("first_seq"),
        F.lit(None).cast("int").alias("first_sub"), F.col("event_id").alias("seq"), F.lit(0).alias("sub"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"),
    )


_EVENT_FIELDS = ("view", "purchase", "signup", "click")


def _merge(spark: SparkSession, d: str) -> DataFrame:
    rows = fold_payloads(_change_rows(spark, d))
    return rows.select("id", "first_seq", *[F.get_json_object("payload", f"$.{f}").cast("long").alias(f"last_{f}") for f in _EVENT_FIELDS])


_MERGE_SQL = f"""WITH e AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS dead FROM events)
SELECT user_id::VARCHAR AS id, min(event_id) AS first_seq, {", ".join(f"max(event_id) FILTER (event_type = '{f}') AS last_{f}" for f in _EVENT_FIELDS)}
FROM e WHERE event_type <> 'error' AND (dead IS NULL OR event_id > dead) GROUP BY user_id"""


def _wal(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of all events, every 97th torn: what can be read of each."""
    rows = _change_rows(spark, d)
    line = F.to_json(F.struct("seq", "sub", "kind", "action", "id", F.when(F.col("action") == "upsert", F.col("payload")).alias("payload")))
    torn = F.when(F.col("seq") % 97 == 0, line.substr(F.lit(1), F.length(line) - 3)).otherwise(line)
    out = parsed(rows.select(torn.alias("value"))).select("good", "seq", "kind", "action", "id")
    return out.groupBy("good", "kind", "action").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


_WAL_SQL = """SELECT event_id % 97 <> 0 AS good, CASE WHEN event_id % 97 <> 0 THEN 'rubbing' END AS kind,
  CASE WHEN event_id % 97 <> 0 THEN CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END END AS action, count(*) AS n,
  max(CASE WHEN event_id % 97 <> 0 THEN event_id END) AS last_seq FROM events GROUP BY ALL"""
_FUZZY_PARTS = f"""WITH p AS (SELECT p_partkey, {_NORM.format("p_name")} AS n FROM part), w AS (SELECT p_partkey, n, CASE WHEN contains(n, 'blueanvel') THEN 'blueanvel'
  ELSE list_filter(flatten(list_transform([8, 9, 10], lambda z: list_transform(range(1, greatest(len(n) - z + 2, 1)), lambda i: substr(n, i, z)))),
    lambda x: levenshtein(x, 'blueanvel') <= 1)[1] END AS piece FROM p)
SELECT p_partkey, piece, levenshtein(piece, 'blueanvel')::BIGINT AS distance FROM w WHERE piece IS NOT NULL"""
_EV = "SELECT event_id, user_id, event_type, value FROM events"
#: name: (query, SQL or None)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "normalize_text": (_normalize, f"SELECT 'c' AS of, c_custkey::BIGINT AS id, {_NORM.format('c_name')} AS norm FROM customer UNION ALL SELECT 'd', doc_id, {_NORM.format('coalesce(text, chr(32))')} FROM documents"),
    "tokenize_docs": (_tokenize, f"SELECT doc_id, len(g)::BIGINT AS n_tokens, array_to_string(list_sort(g), ' ') AS tokens FROM (SELECT doc_id, list_distinct(regexp_extract_all({_NORM.format('text')}, '[a-z0-9]+')) AS g FROM documents)"),
    "t2s_translate": (_t2s, "SELECT * FROM (VALUES (0::BIGINT, '虫蛀孔与撕裂'), (1, '旧纸张发霉'), (2, '装帧损伤'), (3, '墓志铭拓本'), (4, '乾隆后汉')) AS t(id, s)"),
    "build_docs_union": (_build, f"WITH {_DOCS} SELECT kind, id, code, damageType, source, name, other, createdAt FROM docs"),
    "field_exact_search": (_field_exact, f"WITH {_DOCS} SELECT kind, id, code, createdAt, CASE WHEN {_NORM.format('source')} = 'building' THEN 80 ELSE 68 END AS score FROM docs WHERE {_gate_sql(['source'], [['building']])}"),
    "fuzzy_search": (_fuzzy, _FUZZY_PARTS),
    "free_text_best_field": (_free, f"WITH {_DOCS}, s AS (SELECT *, greatest({', '.join(_score_sql(f, 'pending') for f in FIELDS)}) AS score FROM docs WHERE {_gate_sql(list(FIELDS), [['pending']])}) SELECT kind, id, code, createdAt, score, 'exact' AS match FROM s WHERE score IS NOT NULL"),
    "gram_gate": (_gate, f"WITH {_DOCS} SELECT kind, count(*) AS n FROM docs WHERE {_gate_sql(list(FIELDS), [['1urgent']])} GROUP BY kind"),
    "postings_build": (_postings, f"WITH {_DOCS}, f AS (SELECT kind || ':' || id AS key, unnest(['code', 'damageType', 'source', 'name', 'other']) AS field, unnest([code, damageType, source, name, other]) AS raw FROM docs), g AS (SELECT DISTINCT unnest(regexp_extract_all({_NORM.format('raw')}, '[a-z0-9]+')) AS gram, field, key FROM f WHERE raw <> '') SELECT gram, field, count(*) AS n_docs FROM g GROUP BY ALL"),
    "date_range_filter": (_dates, f"WITH {_DOCS} SELECT kind, id, createdAt FROM docs WHERE createdAt BETWEEN '1996-01-01' AND '1996-06-30'"),
    "kind_filter": (_kinds, f"WITH {_DOCS} SELECT kind, count(*) AS n FROM docs WHERE kind IN ('batch', 'rubbing') GROUP BY kind"),
    "combined_search_topk": (flagship, f"WITH {_DOCS}, {_COMBINED_SQL} SELECT * FROM hits ORDER BY score DESC, createdAt, code, id, kind LIMIT 100"),
    "keyset_page": (_keyset, f"WITH {_DOCS}, {_COMBINED_SQL}, a AS (SELECT *, score < 200 OR (score = 200 AND (createdAt, code, id, kind) > ('1996-06-01', '1-URGENT', '5', 'damage')) AS behind FROM hits) SELECT kind, id, code, createdAt, score, (SELECT count(*) FROM a WHERE NOT behind) // 20 + 1 AS page_index FROM a WHERE behind ORDER BY score DESC, createdAt, code, id, kind LIMIT 21"),
    "parent_child_counts": (_counts, "SELECT o_orderkey::VARCHAR AS id, count(l_orderkey) AS damageCount, count(l_orderkey) FILTER (l_linestatus <> 'F') AS pendingDamages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "batch_enrich": (_batch_enrich, "WITH c AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_suppkey, l_linestatus = 'F' AS r FROM lineitem), m AS (SELECT DISTINCT l_suppkey, id FROM c) SELECT s_suppkey::VARCHAR AS id, count(c.id) AS total, count(*) FILTER (c.r) AS repaired, count(c.id) - count(*) FILTER (c.r) AS pending FROM supplier LEFT JOIN m ON m.l_suppkey = s_suppkey LEFT JOIN c ON c.id = m.id GROUP BY s_suppkey"),
    "filter_status_type": (_filter, "SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, p_name AS type, l_shipdate::DATE::VARCHAR AS createdAt FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F'"),
    "missing_refs": (_refs(rel.missing_ids), "SELECT o_orderkey::VARCHAR AS id FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "existing_refs": (_refs(rel.existing_ids), "SELECT o_orderkey::VARCHAR AS id FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "first_override_join": (_override, "WITH f AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS note FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1) SELECT p_partkey, coalesce(nullif(f.note, ''), 'none') AS note FROM part LEFT JOIN f ON l_partkey = p_partkey"),
    "log_fold_latest": (_fold, f"SELECT * FROM ({_EV} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"),
    "cjk_normalize": (_cjk_norm, f"WITH {_CJK_SQL} SELECT id, mark || reign || num AS code, damage FROM cjk"),
    "cjk_tokens": (_cjk_tokens, _CJK_TOKENS_SQL),
    "cjk_typo_reasons": (_reasons({"q": "蟲柱孔"}), _TYPO_SQL),
    "cjk_field_reasons": (_reasons({"code": "ＴＰ漢", "type": "黴變"}), _MIXED_SQL),
    "log_merge_upsert": (_merge, _MERGE_SQL),
    "wal_recover": (_wal, _WAL_SQL),
    "as_of_state": (_as_of, f"SELECT * FROM ({_EV} WHERE event_id <= 5000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"),
    "version_intervals": (_intervals, "SELECT user_id, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to, event_type FROM events"),
    "history_prune": (_prune, "SELECT * FROM (SELECT user_id, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to, event_type FROM events) WHERE valid_to IS NULL OR valid_to >= 8000"),
    "cascade_keys": (_cascade, "SELECT DISTINCT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'"),
    "index_status": (_status, "SELECT 'rubbings' AS what, count(*) AS n FROM orders UNION ALL SELECT 'damages', count(*) FROM lineitem UNION ALL SELECT 'batches', count(*) FROM supplier UNION ALL SELECT 'seq', max(event_id) FROM events"),
}
