"""Queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions import text as X
from ..functions.jsnum import number_text
from ..operators import edit, grid, lookup, packetfilter, setops, summarize
from ..sinks import delimited as writer
from ..sources.files import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_ORDER_SEARCH = "lower(o_orderkey::VARCHAR) LIKE '%urgent%' OR lower(o_custkey::VARCHAR) LIKE '%urgent%' OR lower(o_orderstatus) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%urgent%'"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, pos FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
           row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE {_ORDER_SEARCH}) WHERE pos BETWEEN 201 AND 300""")
def search_page_orders(spark, sf_dir):
    """Any-cell search, then the third page."""
    found = grid.search(table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS), "URGENT")
    return grid.numbered_page(found, 3, [F.col("o_orderkey")])


def _mixed(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("e1"))).when(k % 2 == 0, F.col("p_size").cast("string")).when(k % 11 == 0, F.concat(F.lit("0x"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v"))


_MIXED_SQL = """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN ' ' || p_size || 'e1' WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR
                  WHEN p_partkey % 11 = 0 THEN '0x' || p_size ELSE p_brand END AS v FROM part),
     b AS (SELECT *, CASE WHEN regexp_matches(trim(v), '^[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?)$') THEN try_cast(trim(v) AS DOUBLE)
                  WHEN regexp_matches(v, '^0x[0-9]+$') THEN list_sum(list_transform(string_split(substr(v, 3), ''), lambda c, i: c::INT * pow(16, length(v) - 2 - i)))::DOUBLE END AS n, lower(trim(v)) AS s FROM a),
     c AS (SELECT *, CASE WHEN s = '' THEN 2 WHEN n IS NOT NULL THEN 0 ELSE 1 END AS k FROM b)
     SELECT p_partkey, v, row_number() OVER (ORDER BY {order}) AS pos FROM c"""


def _positions(df: DataFrame, direction: str) -> DataFrame:
    keys = grid.sort_parts(F.col("v"), df.schema["v"].dataType, direction)
    return grid.positions(df, [*keys, grid.Key(F.col("p_partkey"))], "pos", scratch(df.sparkSession, "positions"))


@query(_MIXED_SQL.replace("{order}", "k, n, s, p_partkey"))
def mixed_sort_asc(spark, sf_dir):
    """O01 ascending: numbers, texts, empty cells."""
    return _positions(_mixed(spark, sf_dir), "asc")


@query(_MIXED_SQL.replace("{order}", "k DESC, n DESC NULLS LAST, s DESC, p_partkey"))
def mixed_sort_desc(spark, sf_dir):
    """O01 descending: empty cells first."""
    return _positions(_mixed(spark, sf_dir), "desc")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, pos FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey DESC) AS pos, count(*) OVER () AS n FROM orders)
          WHERE pos > (ceil(n * 0.7 / 100) - 1) * 100 AND pos <= ceil(n * 0.7 / 100) * 100""")
def deep_page(spark, sf_dir):
    """A page at seven tenths of the table, of which only the range around it is sorted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    order = [grid.Key(F.col("o_orderpriority"), True), grid.Key(F.col("o_totalprice")), grid.Key(F.col("o_orderkey"), True)]
    return grid.deep_page(orders, -(-orders.count() * 7 // 1000), order, sorted_rows=1000)


@query("""SELECT p_partkey, v, pos FROM (SELECT *, row_number() OVER (ORDER BY k, n, s, p_partkey) AS pos, count(*) OVER () AS total FROM ({inner})) WHERE pos > (ceil(total / 100) - 1) * 100""".replace("{inner}", _MIXED_SQL[: _MIXED_SQL.rindex("SELECT p_partkey, v, row_number()")] + "SELECT * FROM c"))
def last_page(spark, sf_dir):
    """A number after the last page is clamped to it, in the mixed order."""
    mixed = _mixed(spark, sf_dir)
    return grid.deep_page(mixed, 10**9, [*grid.sort_parts(F.col("v"), mixed.schema["v"].dataType, "asc"), grid.Key(F.col("p_partkey"))], sorted_rows=300)


@query("""SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC NULLS FIRST, p_partkey) AS pos FROM part""")
def typed_sort(spark, sf_dir):
    """A numeric column is ordered as such."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    keys = grid.sort_keys(F.col("p_size"), df.schema["p_size"].dataType, "desc")
    return grid.positions(df, [*keys, F.col("p_partkey").asc()], "pos", scratch(spark, "positions"))


@query("""SELECT event_id, row_number() OVER (ORDER BY CASE WHEN v IS NULL THEN 1 ELSE 0 END, v, event_id) AS pos FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)""")
def excel_sort(spark, sf_dir):
    """A workbook's order, in which NaN is an empty cell."""
    k = F.col("event_id")
    df = table(spark, sf_dir, "events").select(k, F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None)).otherwise(F.col("value")).alias("v"))
    keys = grid.sort_keys(F.col("v"), df.schema["v"].dataType, "asc", excel=True)
    return grid.positions(df, [*keys, k.asc()], "pos", scratch(spark, "positions")).select("event_id", "pos")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'er#000000001') OR contains(lower(c_mktsegment), 'er#000000001')""")
def report_search(spark, sf_dir):
    """trimmed search."""
    return grid.search_report(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "  ER#000000001 ").select("c_custkey", "c_name")


@query("""SELECT event_id, ts FROM events WHERE contains(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'T10:') OR contains(event_id::VARCHAR, 'T10:')""")
def timestamp_search(spark, sf_dir):
    """times are searched as ISO text with milliseconds."""
    return grid.search(table(spark, sf_dir, "events").select("event_id", "ts"), "T10:")


@query("""SELECT event_type, count(*) AS n, min(event_id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank FROM events GROUP BY event_type""")
def type_counts(spark, sf_dir):
    """Counts by type, ties by first appearance."""
    return summarize.type_counts(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS rank FROM part GROUP BY p_type ORDER BY n DESC, first_seen LIMIT 5""")
def top_types(spark, sf_dir):
    """The five most frequent types."""
    return summarize.type_counts(table(spark, sf_dir, "part"), "p_type", "p_partkey", top=5)


@query("SELECT count(DISTINCT p_type) AS n_distinct FROM part")
def distinct_types(spark, sf_dir):
    """A05."""
    return summarize.distinct_count(table(spark, sf_dir, "part"), "p_type")


@query("SELECT count(*) AS total_rows, 5::BIGINT AS total_columns FROM customer")
def grid_counts(spark, sf_dir):
    """A01."""
    return summarize.row_and_column_counts(table(spark, sf_dir, "customer"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_number, i - 1 AS physical_line, md5(line) AS h FROM (SELECT doc_id,
          unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''""")
def line_log(spark, sf_dir):
    """Lines numbered without the blank ones. Numbers are made inside each document's
    array, so that nothing is shuffled."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.cast("long").alias("physical_line"))), lambda x: F.trim(x["line"]) != "")
    numbered = docs.select("doc_id", F.posexplode(lines).alias("at", "x"))
    return numbered.select("doc_id", (F.col("at") + 1).cast("long").alias("line_number"), "x.physical_line", F.md5(F.col("x.line").cast("binary")).alias("h"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT d, doc_id, length(line) - length(replace(line, d, '')) AS n FROM l, (SELECT unnest([',', ';', chr(9), '|']) AS d))
          SELECT doc_id, d AS delimiter, sum((n > 0)::INT)::BIGINT * 100 + sum(n)::BIGINT AS score FROM c GROUP BY doc_id, d""")
def delimiter_scores(spark, sf_dir):
    """The score of each candidate delimiter, counted inside each document's array."""
    docs = table(spark, sf_dir, "documents")
    lines = F.col("lines")
    score = lambda d: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))) + F.when(F.contains(x, F.lit(d)), 100).otherwise(0))
    # one split is shared by the four
    docs = docs.select("doc_id", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") > 0)
    return docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(d).alias("delimiter"), score(d).alias("score")) for d in (",", ";", "\t", "|")])))


@query("""SELECT event_id, concat_ws(',', event_id::VARCHAR, event_type, CASE WHEN regexp_matches(props, '[,"\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END) AS line FROM events""")
def csv_rows(spark, sf_dir):
    """Quoted only where needed."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", writer.delimited_line(events, ["event_id", "event_type", "props"]).alias("line"))


@query("SELECT r_regionkey, r_regionkey || chr(9) || r_name AS line FROM region")
def tsv_rows(spark, sf_dir):
    """Cells joined by tabs as they are."""
    region = table(spark, sf_dir, "region")
    return region.select("r_regionkey", writer.plain_line(region, ["r_regionkey", "r_name"], "\t").alias("line"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def json_rows(spark, sf_dir):
    """Rows as JSON."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_nav(spark, sf_dir):
    """A path into JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?s)<p\\b[^>]*>'))::BIGINT AS paragraphs, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages""")
def tag_extract(spark, sf_dir):
    """Elements by pattern."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?s)<p\b[^>]*>"), F.lit(0))).cast("long").alias("paragraphs"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"))


@query("""WITH n AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id * 64 // n AS bucket, max(abs(value)) AS peak FROM events, n GROUP BY 1""")
def bucket_peaks(spark, sf_dir):
    """Peaks of 64 buckets."""
    events = table(spark, sf_dir, "events")
    frames = events.agg(F.max("event_id") + 1).first()[0]
    return summarize.bucket_peaks(events, "event_id", F.col("value"), frames, 64)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))


@query("""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(*) > 1""")
def duplicate_lines(spark, sf_dir):
    """Lines that occur more than once."""
    return summarize.repeated_values(_lines(spark, sf_dir), "line")


@query("""WITH c AS (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line) SELECT sum(n)::BIGINT AS total, count(*) AS "distinct", sum(n - 1)::BIGINT AS duplicates FROM c""")
def duplicate_summary(spark, sf_dir):
    """Totals."""
    return summarize.duplicate_summary(_lines(spark, sf_dir), "line")


@query("""SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents""")
def base64_text(spark, sf_dir):
    """X05."""
    return table(spark, sf_dir, "documents").select("doc_id", X.to_base64(F.col("text")).alias("b64"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def base64_round_trip(spark, sf_dir):
    """X05 and back."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.from_base64(X.to_base64(F.col("text"))).cast("binary")).alias("h"))


@query("""SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large, count(*) FILTER (value IS NULL) AS missing, coalesce(max(event_id), 0) AS last_id FROM events""")
def conditional_counts(spark, sf_dir):
    """A02, A06, A08."""
    return summarize.conditional_counts(table(spark, sf_dir, "events"), {"clicks": F.col("event_type") == "click", "large": F.col("value") > 50, "missing": F.col("value").isNull()}, last_id=F.coalesce(F.max("event_id"), F.lit(0)))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def row_range(spark, sf_dir):
    """Rows of an index range; the range reaches the scan."""
    return grid.row_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, 1100, "o_orderkey")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_left(spark, sf_dir):
    """J01, J02."""
    return lookup.attach(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def lookup_anti(spark, sf_dir):
    """J02, J06."""
    return lookup.unmatched(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def lookup_semi(spark, sf_dir):
    """Rows with a partner."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_lookup(spark, sf_dir):
    """Of several values the last."""
    return lookup.last_wins(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT e.event_id, b.bucket FROM events e JOIN (SELECT i AS bucket, i * 10.0 AS lo, (i + 1) * 10.0 AS hi FROM range(20) t(i)) b ON e.value >= b.lo AND e.value < b.hi")
def interval_lookup(spark, sf_dir):
    """The interval that holds a value."""
    buckets = spark.range(20).select(F.col("id").alias("bucket"), (F.col("id") * 10.0).alias("lo"), ((F.col("id") + 1) * 10.0).alias("hi"))
    return lookup.interval_lookup(table(spark, sf_dir, "events").select("event_id", "value"), "value", buckets, "lo", "hi", 10.0).select("event_id", "bucket")


_HOSTS = "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"


@query(f"SELECT page_id, host, suffix FROM ({_HOSTS}) p, (SELECT unnest(['example.com', 'example.net', 'example.org', 'blog.thn.example.com', 'com']) AS suffix) s WHERE host = suffix OR ends_with(host, '.' || suffix)")
def theta_suffix_join(spark, sf_dir):
    """Names that end in a given one, as an equal join over each name's endings."""
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    suffixes = spark.createDataFrame([(s,) for s in ("example.com", "example.net", "example.org", "blog.thn.example.com", "com")], "suffix string")
    return lookup.suffix_join(hosts, "host", suffixes, "suffix").select("page_id", "host", "suffix")


def _versions(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    old = part.select(k.alias("number"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.col("p_brand").alias("kind"))
    new = part.filter("p_partkey % 10 <> 0").select(
        F.when(k % 11 == 0, k + 100000).otherwise(k).alias("number"), F.when(k % 7 == 0, F.concat(F.lit("g"), k.cast("string"))).otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("name"), F.when(k % 13 == 0, "other").otherwise(F.col("p_brand")).alias("kind")
    )
    return old, new


@query("""WITH o AS (SELECT p_partkey AS number, 'f' || p_partkey AS name, p_brand AS kind FROM part),
          n AS (SELECT CASE WHEN number % 11 = 0 THEN number + 100000 ELSE number END AS number, CASE WHEN number % 7 = 0 THEN 'g' || number ELSE name END AS name, CASE WHEN number % 13 = 0 THEN 'other' ELSE kind END AS kind FROM o WHERE number % 10 <> 0)
          SELECT number, name, 'removed' AS change, 'breaking' AS severity, NULL::VARCHAR AS detail FROM o WHERE name NOT IN (SELECT name FROM n) AND number NOT IN (SELECT number FROM n)
          UNION ALL SELECT o.number, o.name, 'renumbered', 'breaking', n.number::VARCHAR FROM o JOIN n USING (name) WHERE n.number <> o.number
          UNION ALL SELECT o.number, o.name, 'renamed', 'breaking', n.name FROM o JOIN n USING (number) WHERE n.name <> o.name
          UNION ALL SELECT o.number, o.name, 'retyped', 'risk', n.kind FROM o JOIN n USING (number) WHERE n.name = o.name AND n.kind <> o.kind""")
def schema_diff(spark, sf_dir):
    """Changes between two versions of a schema."""
    return lookup.schema_diff(*_versions(table(spark, sf_dir, "part")), "number", "name", "kind")


@query("SELECT c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def union_sources(spark, sf_dir):
    """U01."""
    return setops.union_sources({"customer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))})


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, sf_dir):
    """U03."""
    return setops.append(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))).distinct()


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def ordered_distinct(spark, sf_dir):
    """Values by first appearance."""
    return setops.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT key, min(event_id) AS first_row FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def key_union(spark, sf_dir):
    """Keys of all objects by first appearance."""
    return setops.key_union(table(spark, sf_dir, "events").select("event_id", F.json_object_keys("props").alias("keys")), "keys", "event_id").select("key", F.col("first.row").alias("first_row"))


@query("SELECT label, count(*) AS n, min(embedding[1]) AS min_x, max(embedding[1]) AS max_x, min(embedding[2]) AS min_y, max(embedding[2]) AS max_y FROM embeddings GROUP BY label")
def bbox(spark, sf_dir):
    """Boxes by label."""
    return summarize.bounding_boxes(table(spark, sf_dir, "embeddings"), ["label"], x=F.col("embedding")[0], y=F.col("embedding")[1])


@query("SELECT count(*) AS n, min(embedding[1]) AS min_x, max(embedding[1]) AS max_x FROM embeddings")
def merged_boxes(spark, sf_dir):
    """Boxes of batches, merged."""
    parts = summarize.bounding_boxes(table(spark, sf_dir, "embeddings").withColumn("batch", F.col("vec_id") % 7), ["batch"], x=F.col("embedding")[0])
    return summarize.merge_boxes(parts, [], ["x"])


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations""")
def carry_forward(spark, sf_dir):
    """The value that was current last."""
    df = summarize.carry_forward(table(spark, sf_dir, "conversations"), F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn", "last_user_turn")
    return df.select("conv_id", "turn", "last_user_turn")


@query("""SELECT conv_id, turn, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes_so_far FROM conversations""")
def running_bytes(spark, sf_dir):
    """Bytes so far, in each conversation."""
    return summarize.running_bytes(table(spark, sf_dir, "conversations"), "text", "turn", ["conv_id"]).select("conv_id", "turn", "bytes_so_far")


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM documents""")
def escape_xml(spark, sf_dir):
    """X07."""
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_xml(F.col("text")).alias("xml"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&apos;', ''''), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS t FROM pages""")
def decode_xml(spark, sf_dir):
    """X07 the other way, the ampersand last."""
    return table(spark, sf_dir, "pages").select("page_id", X.decode_xml(F.col("html")).alias("t"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN t ELSE 'node_' || t END AS tag FROM (SELECT p_partkey, regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_size || ' ' || p_type END, '[^a-zA-Z0-9_.-]', '_', 'g') AS t FROM part)""")
def xml_tags(spark, sf_dir):
    """X08."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", F.col("p_size").cast("string"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.xml_tag(raw).alias("tag"))


@query("""SELECT p_partkey, k AS series, v AS value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR k IN (size, price))""")
def unpivot_series(spark, sf_dir):
    """A row for each numeric column."""
    return summarize.unpivot(table(spark, sf_dir, "part"), ["p_partkey"], {"size": F.col("p_size"), "price": F.col("p_retailprice")})


@query("""SELECT user_id, event_type, event_id, previous FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS previous FROM events) WHERE previous IS NOT NULL""")
def dup_key_lag(spark, sf_dir):
    """A10: keys that were taken before."""
    return summarize.shared_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "event_id").select("user_id", "event_type", "event_id", "previous")


@query("""SELECT event_id, event_type, occurrence FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS occurrence FROM events) WHERE occurrence > 1""")
def later_occurrences(spark, sf_dir):
    """Second and later holders of a key."""
    return summarize.duplicates(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "event_type", "occurrence")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS total, max(n) AS n FROM c GROUP BY user_id)
          SELECT user_id, min(event_type) AS event_type, n, any_value(total)::BIGINT AS total FROM t JOIN c USING (user_id, n) WHERE n >= total * 0.25 GROUP BY user_id, n""")
def dominant_type(spark, sf_dir):
    """A mode that reaches a share."""
    return summarize.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", 0.25).select("user_id", "event_type", "n", "total")


def _packets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    host = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7"))
    return e.select("event_id", F.when(F.col("event_type") == "click", "TCP").otherwise("UDP").alias("Protocol"), F.concat(host, F.lit(":"), (F.col("event_id") % 100 + 400).cast("string")).alias("Source"), F.when(F.col("event_id") % 3 == 0, "aa:bb:cc:00:11:22").otherwise("8.8.8.8:53").alias("Destination"), F.col("event_type").alias("Info"))


@query("""SELECT event_id, regexp_extract(s, '^(.+):(\\d+)$', 1) AS host, regexp_extract(s, '^(.+):(\\d+)$', 2) AS port FROM (SELECT event_id, '10.0.' || user_id % 256 || '.7:' || (event_id % 100 + 400) AS s FROM events)""")
def endpoint_split(spark, sf_dir):
    """host and port."""
    p = _packets(spark, sf_dir)
    return p.select("event_id", packetfilter.host_of(F.col("Source")).alias("host"), packetfilter.port_of(F.col("Source")).alias("port"))


@query("""SELECT event_id FROM events WHERE contains((event_id % 100 + 400)::VARCHAR, '44') OR (event_id % 3 <> 0 AND contains('53', '44'))""")
def packet_filter_port(spark, sf_dir):
    """port, substring match, any endpoint."""
    return packetfilter.filter_packets(_packets(spark, sf_dir), "port == 44").select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def packet_filter_negated(spark, sf_dir):
    """!= is the negation of ==."""
    return packetfilter.filter_packets(_packets(spark, sf_dir), "proto != tcp").select("event_id")


@query("SELECT event_id FROM events WHERE contains('10.0.' || user_id % 256 || '.7:' || (event_id % 100 + 400), '.13.') OR contains(event_id::VARCHAR, '.13.')")
def packet_filter_text(spark, sf_dir):
    """what is no filter is searched for."""
    return packetfilter.filter_packets(_packets(spark, sf_dir), " .13. ").select("event_id")


@query("""SELECT CASE WHEN n_nationkey >= 10 THEN n_nationkey + 1 ELSE n_nationkey END::INTEGER AS n_nationkey, n_name FROM nation UNION ALL SELECT 10, ''""")
def edit_insert_row(spark, sf_dir):
    """E01."""
    return edit.insert_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", 10)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)")
def edit_delete_row(spark, sf_dir):
    """The last row."""
    return edit.delete_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("""SELECT n_nationkey, '' AS "Column3", n_name FROM nation""")
def edit_insert_column(spark, sf_dir):
    """E03."""
    return edit.insert_column(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 1)


@query("SELECT n_nationkey FROM nation")
def edit_delete_column(spark, sf_dir):
    """E04."""
    return edit.delete_column(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS label FROM nation")
def edit_cell(spark, sf_dir):
    """E05."""
    return edit.rename_column(edit.update_cell(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", 3, "n_name", "changed"), "n_name", "label")


@query("""SELECT (n_nationkey - (n_nationkey > 2)::INT - (n_nationkey > 5)::INT)::INTEGER AS n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (2, 5)""")
def edit_delete_lines(spark, sf_dir):
    """Several lines, one of them absent."""
    return edit.delete_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", [5, 2, 999])


@query("""SELECT CASE WHEN n_nationkey = 2 THEN 6 WHEN n_nationkey BETWEEN 3 AND 6 THEN n_nationkey - 1 ELSE n_nationkey END::INTEGER AS n_nationkey, n_name FROM nation""")
def edit_move_line(spark, sf_dir):
    """E09."""
    return edit.move_line(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", 2, 6)


@query("""SELECT p_partkey, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS shown FROM (SELECT p_partkey, p_size / 4.0 AS v FROM part)""")
def number_texts(spark, sf_dir):
    """Numbers as short text."""
    return table(spark, sf_dir, "part").select("p_partkey", number_text(F.col("p_size") / F.lit(4.0)).alias("shown"))


@query("SELECT n_nationkey, '0x' || upper(to_hex(n_nationkey * 1000)) AS id FROM nation")
def hex_ids(spark, sf_dir):
    """X18, P03."""
    return table(spark, sf_dir, "nation").select("n_nationkey", X.hex_id(F.col("n_nationkey").cast("long") * 1000).alias("id"))


@query("SELECT c_custkey, regexp_replace(c_name || '/x', '[<>:/|?*]', '_', 'g') AS f FROM customer")
def file_names(spark, sf_dir):
    """X14."""
    return table(spark, sf_dir, "customer").select("c_custkey", X.safe_file_name(F.concat("c_name", F.lit("/x"))).alias("f"))


@query("""SELECT e.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'view' AND b.event_id <= e.event_id) AS last_view FROM events e WHERE e.event_type = 'click'""")
def as_of_lookup(spark, sf_dir):
    """The latest partner at or before a row."""
    e = table(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("last_view"))
    return lookup.as_of(e.filter("event_type = 'click'").select("user_id", "event_id"), views, ["user_id"], "event_id", "last_view").select("event_id", "last_view")


@query("""SELECT event_id, n AS n_matches FROM (SELECT event_id, (length(props) - length(replace(props, '"', ''))) AS n FROM events)""")
def pattern_counts(spark, sf_dir):
    """A16."""
    return table(spark, sf_dir, "events").select("event_id", summarize.pattern_count(F.col("props"), '"').alias("n_matches"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(n, '^(\\D*)', 1), try_cast(regexp_extract(n, '(\\d+)', 1) AS BIGINT), n, p_partkey) AS pos FROM (SELECT p_partkey, 'section' || p_partkey || '.xml' AS n FROM part)""")
def natural_sort(spark, sf_dir):
    """Names by the number in them."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("section"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("n"))
    return grid.positions(named, [*grid.natural_key(F.col("n")), F.col("p_partkey")], "pos", scratch(spark, "positions")).select("p_partkey", "pos")


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || 'B' ELSE CASE WHEN k = floor(k) THEN k::BIGINT::VARCHAR ELSE k::VARCHAR END || unit END AS label FROM (SELECT doc_id, b, CASE e WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END AS unit, round(b / pow(1024, e), 1) AS k
          FROM (SELECT doc_id, strlen(text) AS b, CASE WHEN strlen(text) < 1048576 THEN 1 WHEN strlen(text) < 1073741824 THEN 2 ELSE 3 END AS e FROM documents))""")
def size_labels(spark, sf_dir):
    """Sizes with one decimal at most, of texts of any size that a cell can hold."""
    return table(spark, sf_dir, "documents").select("doc_id", X.size_label(F.octet_length("text").cast("long")).alias("label"))


@query("""SELECT page_id, CASE WHEN ends_with(f, '.png') THEN 'image/png' WHEN ends_with(f, '.wav') THEN 'audio/wav' ELSE 'application/octet-stream' END AS mime FROM (SELECT page_id, 'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.wav' ELSE '.zzz' END AS f FROM pages)""")
def mime_types(spark, sf_dir):
    """X19."""
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", X.mime_type(F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".wav").otherwise(".zzz"))).alias("mime"))


@query("""SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(event_id * 0.25 - 40, 6)::DOUBLE AS physical, value BETWEEN -180 AND 180 AND event_id BETWEEN -90 AND 90 AS plausible FROM (SELECT event_id, abs(value) AS value FROM events)""")
def signal_scalars(spark, sf_dir):
    """Physical values, coordinates, mel."""
    e, v = F.col("event_id"), F.abs("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(X.hz_to_mel(v), 6).alias("mel"), F.round(X.can_physical(e, F.lit(0.25), F.lit(-40)), 6).cast("double").alias("physical"), X.looks_lon_lat(v, e, v, e).alias("plausible"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE NULL END AS t, CASE WHEN event_id % 3 = 0 THEN event_id END AS n FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def archive_fields(spark, sf_dir):
    """Times and numbers of listings, null where they are none."""
    e = F.col("event_id")
    raw = F.when(e % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    return table(spark, sf_dir, "events").select("event_id", X.archive_time(raw).cast("timestamp_ntz").alias("t"), X.number_or_null(F.when(e % 3 == 0, F.concat(F.lit(" "), e.cast("string"))).otherwise("x")).alias("n"))


@query("""SELECT c_custkey, '10.0.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 AS v4, '0:0:0:0:0:0:0:' || lower(to_hex(c_custkey % 65536)) AS v6, '00:00:00:00:' || lpad(lower(to_hex(c_custkey // 256 % 256)), 2, '0') || ':' || lpad(lower(to_hex(c_custkey % 256)), 2, '0') AS mac FROM customer""")
def address_texts(spark, sf_dir):
    """Addresses from their bytes."""
    two = F.substring(F.unhex(F.lpad(F.hex("c_custkey"), 8, "0")), 3, 2)
    zero = lambda n: F.unhex(F.lit("00" * n))
    return table(spark, sf_dir, "customer").select("c_custkey", X.ipv4(F.concat(F.unhex(F.lit("0A00")), two)).alias("v4"), X.ipv6(F.concat(zero(14), two)).alias("v6"), X.mac(F.concat(zero(4), two)).alias("mac"))


@query(r"""SELECT page_id, replace(replace(replace(html, '&', '\u0026'), '<', '\u003c'), '>', '\u003e') AS safe FROM pages""")
def script_safe(spark, sf_dir):
    """JSON text that may stand in a script element."""
    return table(spark, sf_dir, "pages").select("page_id", X.html_safe_json(F.col("html")).alias("safe"))


@query("""SELECT p_partkey, ['a' || p_partkey, 'b c', 'd'] AS columns FROM part""".replace("AS columns", "::VARCHAR AS columns"))
def statement_columns(spark, sf_dir):
    """X11: column names of CREATE TABLE statements."""
    sql = F.concat(F.lit("CREATE TABLE t (a"), F.col("p_partkey").cast("string"), F.lit(" DECIMAL(5, 2) DEFAULT 'x,y', \"b c\" TEXT, [d] INT, PRIMARY KEY (d))"))
    found = sqltext.columns_of(sql)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("columns"))


@query("""SELECT 's' || s_suppkey || '.shp' AS shp, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey || '.dbf' END AS dbf FROM supplier""")
def sidecar_files(spark, sf_dir):
    """Files with those of the same stem."""
    stem = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    both = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(stem, F.lit(".shp")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(stem, F.lit(".dbf"))).otherwise(F.concat(stem, F.lit("x.prj"))))).alias("path"))
    return lookup.sidecars(both, "path", "shp", ["dbf"]).select("shp", "dbf")


@query("""SELECT event_id FROM events WHERE event_id >= 100 AND event_id < 300""")
def sound_slice(spark, sf_dir):
    """Frames between two times, given the wrong way round."""
    events = table(spark, sf_dir, "events").select("event_id")
    return grid.time_slice(events, "event_id", 3.0, 1.0, 100, 1_000_000)


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def report_rows(spark, sf_dir):
    """The rows that a report shows."""
    return grid.report_view(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("""SELECT CASE WHEN name = 'C' THEN n ELSE n + (SELECT max(c_custkey) FROM customer) END AS number, name FROM (SELECT c_custkey AS n, 'C' AS name FROM customer UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey), 'S' FROM supplier WHERE s_suppkey % 3 <> 0)""")
def paste_lines(spark, sf_dir):
    """Valid pasted lines after the others."""
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.lit("C").alias("name"), F.lit(True).alias("valid"))
    pasted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number"), F.lit("S").alias("name"), (F.col("s_suppkey") % 3 != 0).alias("valid"))
    return edit.append_valid(lines, pasted, "number", "valid").select("number", "name")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY lower(n), n, p_partkey) AS pos FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'A' WHEN 2 THEN 'b' ELSE 'B' END AS n FROM part)""".replace("lower(n), n,", "lower(n), n DESC,"))
def collated_sort(spark, sf_dir):
    """Dictionary order, a before A before b."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, "aAbB")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("n"))
    return grid.positions(named, [grid.collated("n"), F.col("p_partkey")], "pos", scratch(spark, "positions")).select("p_partkey", "pos")

