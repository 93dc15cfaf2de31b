"""Registered queries over source files that are made from the rows of `part`: extraction, discovery rules, the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import sql as sql_functions
from loomgraph.operators import metrics
from loomgraph.queries import register
from loomgraph.sources import discover
from loomgraph.sources.extract import environment, file_edges, file_nodes, file_rows, made_nodes, spread, symbol_nodes
from loomgraph.sources.lineage import shared_folder
from loomgraph.sources.store import Store

# Both engines read these expressions over part; {k} is the key. JavaScript strings are double-quoted, so no quote needs escaping.
FOLDER = "CASE {k} % 8 WHEN 0 THEN 'screens' WHEN 1 THEN 'hooks' WHEN 2 THEN 'services' WHEN 3 THEN 'api' WHEN 4 THEN 'store' WHEN 5 THEN 'components' WHEN 6 THEN 'navigation' ELSE 'plain' END"
ENDING = "CASE {k} % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.jsx' ELSE '.tsx' END"
PATH = f"concat('src/', {FOLDER}, '/m', {{k}}, {ENDING})"
EXPORTED = "CASE WHEN {k} % 8 = 7 THEN '' ELSE 'export ' END"
THING = "concat(CASE WHEN {k} % 8 = 1 THEN 'useThing' ELSE 'thing' END, {k})"
LINES = (
    """concat('import { helper, other as alias } from "./m', {k} + 24, '";')""",
    """concat('import pkg from "@scope', {k} % 7, '/lib/sub";')""",
    """concat('import * as ns from "lodash', {k} % 5, '/fp";')""",
    f"""concat({EXPORTED}, 'const Widget', {{k}}, ' = async (props) => {{{{')""",
    """concat('  fetch("/api/items/', {k} % 50, '", {{ method: "post" }});')""",
    """concat('  axios.put("/auth/', {k} % 20, '");')""",
    """concat('  apiClient.get(`/users/$', '{{id}}/p', {k} % 9, '`);')""",
    """concat('  const q = useQuery("/q/', {k} % 11, '");')""",
    """concat('  useMutation("/mu/', {k} % 13, '");')""",
    """concat('  nav.navigate("Page', {k} % 30, '");')""",
    "'  nav.push(route);'",
    """concat('  localStorage.setItem("token', {k} % 3, '", v);')""",
    "'  AsyncStorage.getItem(key);'",
    """concat('  store.dispatch({{ type: "ADD_', {k} % 6, '" }});')""",
    "'  store.dispatch(action);'",
    """concat('  socket.emit("msg', {k} % 10, '");')""",
    """concat('  socket.on("evt', {k} % 10, '", f);')""",
    "'  useContext(AuthContext);'",
    """concat('  Linking.openURL("app://open/', {k} % 12, '");')""",
    """concat('  track("click', {k} % 15, '");')""",
    "'  helper(k); _hidden(); x(); console.log(1);'",
    """concat('  return <Stack.Screen name="Home', {k} % 30, '"><Row/></Stack.Screen>;')""",
    "'}};'",
    f"concat('export default function ', {THING}, '() {{{{ inner', {{k}}, '(); useNavigation(); useAuth(); useSelector(); useForm(); Camera.requestAccess(); registerForPushToken(); }}}}')",
    "concat('class Box', {k}, ' extends React.Component {{ componentDidCatch() {{}} }}')",
    "concat('const env', {k}, ' = process.env.KEY_', {k} % 4, ';')",
    "'const AuthContext = createContext(null);'",
    "'const slice = createSlice({{}});'",
    "'const useStore = create();'",
    "'topLevel();'",
)
LINES = (LINES[0].replace("{ helper", "{{ helper").replace("alias }", "alias }}"), *LINES[1:])
#: The line of each declaration and call (from one).
N_LINES = len(LINES)


def expression(template: str) -> str:
    return template.format(k="p_partkey")


CONTENT = f"concat_ws(chr(10), {', '.join(expression(line) for line in LINES)})"
# what the SQL of all queries starts from: files with their keys, paths and ids
BASE = f"""WITH f AS (SELECT p_partkey AS k, {expression(PATH)} AS path, {expression(THING)} AS thing, concat('Widget', p_partkey) AS widget
  FROM part),
i AS (SELECT *,
  'f:' || substr(md5(path), 1, 10) AS fid, substr(md5(path || '::' || widget), 1, 12) AS wid, substr(md5(path || '::' || thing), 1, 12) AS tid
  FROM f)
"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content, p_partkey): one module a part."""
    keys = spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey"), "p_partkey")
    return keys.select(F.expr(expression(PATH)).alias("path"), F.expr(CONTENT).alias("content"), "p_partkey")


def _field(name: str) -> Column:
    """A field of the metadata; tags as one sorted text."""
    if name == "tags":
        return F.coalesce(F.array_join(F.array_sort(F.from_json("metadata", "tags array<string>")["tags"]), ","), F.lit("")).alias("tags")
    return F.get_json_object("metadata", f"$.{name}").alias(name)


def _edges(name: str, kinds: tuple[str, ...], oracle: str, *fields: str) -> None:
    """Edges of the kinds, with fields of their metadata."""
    register(name, BASE + oracle)(lambda spark, sf: file_edges(sources(spark, sf), kinds).select("source", "target", "kind", "label", "line", *map(_field, fields)))


# --- files and symbols ----------------------------------------------------------------------------------------------

FILE_NODES = f"""SELECT fid AS id, CASE k % 8 WHEN 0 THEN 'screen' WHEN 1 THEN 'hook' WHEN 2 THEN 'service' WHEN 3 THEN 'api'
  WHEN 4 THEN 'store' WHEN 5 THEN 'component' WHEN 6 THEN 'service' ELSE 'file' END AS type,
list_last(string_split(path, '/')) AS name, path AS qualified_name, CAST({N_LINES} AS INTEGER) AS end_line, '.' || list_last(string_split(path, '.')) AS ext,
CASE WHEN k % 3 = 2 THEN 'typescript' ELSE 'javascript'
  END AS language, 'auth-file,context-creator-file,env-usage,form-file,navigation-file,state-file,storage-file' AS tags FROM i"""


@register("extract_files", BASE + FILE_NODES)
def extract_files(spark: SparkSession, sf: str) -> DataFrame:
    return file_nodes(sources(spark, sf)).select("id", "type", "name", "qualified_name", "end_line", _field("ext"), _field("language"), _field("tags"))


# "useThing" holds "seT" and a letter more, so it has the role of setters
SYMBOLS = """SELECT id, type, kind, name, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, exported AS is_exported, is_async, tags
  FROM (
SELECT wid AS id, 'component' AS type, 'component' AS kind, widget AS name, 4 AS a, 23 AS b, k % 8 <> 7 AS exported, true AS is_async, '' AS tags
  FROM i
UNION ALL SELECT tid, CASE WHEN k % 8 = 1 THEN 'hook' ELSE 'function' END, CASE
  WHEN k % 8 = 1 THEN 'hook' ELSE 'function' END, thing, 24, 24, true, false,
  'auth-consumer,form-consumer,navigation-consumer,notification-consumer,permission-request,state-consumer' || CASE
  WHEN k % 8 = 1 THEN ',state-mutation' ELSE '' END FROM i
UNION ALL SELECT substr(md5(path || '::Box' || k), 1, 12), 'class', 'class', 'Box' || k, 25, 25, false, false, 'error,react-component' FROM i
UNION ALL SELECT substr(md5(path || '::var:' || name), 1, 12), 'variable', 'variable', name, line, NULL, false, false, tags FROM i,
  (VALUES ('q', 8, ''), ('AuthContext', 27, 'auth,auth-context,context-creator'), ('slice', 28, 'state-slice'), ('useStore', 29, 'state,state-store')) v(name, line, tags)
UNION ALL SELECT substr(md5(path || '::var:env' || k), 1, 12), 'variable', 'variable', 'env' || k, 26, NULL, false, false, 'env-var' FROM i)"""


@register("extract_symbols", BASE + SYMBOLS)
def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, components, hooks, classes, variables; their exports and roles, and what the calls in them tell."""
    return symbol_nodes(sources(spark, sf)).select("id", "type", "kind", "name", "start_line", "end_line", "is_exported", "is_async", _field("tags"))


@register("extract_environment", BASE + "SELECT 'env' || k AS name, path AS file_path, 'KEY_' || (k % 4) AS \"envKey\" FROM i")
def extract_environment(spark: SparkSession, sf: str) -> DataFrame:
    return environment(sources(spark, sf)).withColumnRenamed("env_key", "envKey")


CONTAINS = """SELECT fid AS source, id AS target, 'contains' AS kind, CAST(NULL AS VARCHAR) AS label, CAST(line AS INTEGER) AS line FROM (
SELECT fid, wid AS id, 4 AS line FROM i UNION ALL SELECT fid, tid, 24 FROM i UNION ALL SELECT fid, substr(md5(path || '::Box' || k), 1, 12), 25 FROM i
UNION ALL SELECT fid, substr(md5(path || '::var:env' || k), 1, 12), 26 FROM i
UNION ALL SELECT fid, substr(md5(path || '::var:' || name), 1, 12), line
  FROM i, (VALUES ('q', 8), ('AuthContext', 27), ('slice', 28), ('useStore', 29)) v(name, line))
UNION ALL SELECT substr(md5(path || '::Box' || k), 1, 12), 'React.Component', 'extends', 'React.Component', 25 FROM i"""
_edges("extract_contains", ("contains", "extends"), CONTAINS)

IMPORTS = """SELECT a.fid AS source, b.fid AS target, 'import' AS kind, 'helper, other' AS label, CAST(1 AS INTEGER) AS line, NULL AS package, '' AS tags
  FROM i a JOIN i b ON b.k = a.k + 24
UNION ALL SELECT fid, 'pkg:@scope' || (k % 7), 'external', 'default', 2, '@scope' || (k % 7) || '/lib/sub', '' FROM i
UNION ALL SELECT fid, 'pkg:lodash' || (k % 5), 'external', 'default', 3, 'lodash' || (k % 5) || '/fp', '' FROM i"""
_edges("extract_imports", ("import", "external"), IMPORTS, "package", "tags")

# --- calls ----------------------------------------------------------------------------------------------------------

API_CALLS = """SELECT wid AS source,
  'ep:' || substr(md5(method || ':' || url), 1, 10) AS target, 'api_call' AS kind, label || ' ' || url AS label, CAST(line AS INTEGER) AS line, type, method, url, tags
  FROM (
SELECT wid, 5 AS line, 'fetch' AS type, 'POST' AS method, 'fetch POST' AS label, '/api/items/' || (k % 50) AS url, '' AS tags FROM i
UNION ALL SELECT wid, 6, 'axios', 'PUT', 'axios.put', '/auth/' || (k % 20), 'auth-api' FROM i
UNION ALL SELECT wid, 7, 'apiClient', 'GET', 'apiClient.get', '/users/${…}/p' || (k % 9), '' FROM i
UNION ALL SELECT wid, 8, 'useQuery', 'GET', 'useQuery GET', '/q/' || (k % 11), '' FROM i
UNION ALL SELECT wid, 9, 'useMutation', 'POST', 'useMutation POST', '/mu/' || (k % 13), '' FROM i)"""
_edges("extract_api_calls", ("api_call",), API_CALLS, "type", "method", "url", "tags")

ROUTES = """SELECT wid AS source,
  'route:' || substr(md5('Page' || (k % 30)), 1, 10) AS target, 'navigates_to' AS kind, 'navigate → Page' || (k % 30) AS label, CAST(10 AS INTEGER) AS line, 'navigation' AS tags
  FROM i
UNION ALL SELECT wid,
  'route:' || substr(md5('Home' || (k % 30)), 1, 10), 'defines_route', '<Stack.Screen name="Home' || (k % 30) || '" />', 22, 'navigation'
  FROM i"""
_edges("extract_routes", ("navigates_to", "defines_route"), ROUTES, "tags")

STORAGE = """SELECT wid AS source, 'storage:token' || (k % 3) AS target, 'storage_access' AS kind, 'localStorage.setItem(token' || (k % 3) || ')' AS label, CAST(12 AS INTEGER) AS line, 'write' AS action, 'auth-storage' AS tags
  FROM i
UNION ALL SELECT wid, 'storage:unknown', 'storage_access', 'AsyncStorage.getItem(...)', 13, 'read', '' FROM i"""
_edges("extract_storage", ("storage_access",), STORAGE, "action", "tags")

DISPATCHES = """SELECT wid AS source, substr(md5(path || '::dispatch:ADD_' || (k % 6)), 1, 12) AS target, 'dispatches' AS kind, 'dispatch({type: ADD_' || (k % 6) || '})' AS label, CAST(14 AS INTEGER) AS line, 'state-mutation' AS tags
  FROM i
UNION ALL SELECT wid, substr(md5(path || '::dispatch:store'), 1, 12), 'dispatches', 'dispatch via store', 15, 'state-mutation' FROM i"""
_edges("extract_dispatches", ("dispatches",), DISPATCHES, "tags")

EVENTS = """SELECT wid AS source, 'event:msg' || (k % 10) AS target, 'emits_event' AS kind, 'socket.emit(msg' || (k % 10) || ')' AS label, CAST(16 AS INTEGER) AS line, 'realtime' AS tags
  FROM i
UNION ALL SELECT wid, 'event:evt' || (k % 10), 'subscribes_event', 'socket.on(evt' || (k % 10) || ')', 17, 'realtime' FROM i
UNION ALL SELECT wid, substr(md5(path || '::AuthContext'), 1, 12), 'uses_context', 'useContext(AuthContext)', 18, 'auth-context-usage' FROM i
UNION ALL SELECT wid, 'deeplink:app://open/' || (k % 12), 'deep_link', 'Linking.openURL(app://open/' || (k % 12) || ')', 19, 'deep-link' FROM i
UNION ALL SELECT wid, 'analytics:click' || (k % 15), 'tracks_event', 'track(click' || (k % 15) || ')', 20, 'analytics' FROM i"""
_edges("extract_events", ("emits_event", "subscribes_event", "uses_context", "deep_link", "tracks_event"), EVENTS, "tags")

CALLS = """SELECT wid AS source, substr(md5(path || '::helper'), 1, 12) AS target, 'call' AS kind, widget || ' → helper' AS label, CAST(21 AS INTEGER) AS line, '' AS tags
  FROM i
UNION ALL SELECT tid, substr(md5(path || '::inner' || k), 1, 12), 'call', thing || ' → inner' || k, 24, '' FROM i
UNION ALL SELECT tid, substr(md5(path || '::registerForPushToken'), 1, 12), 'call', thing || ' → registerForPushToken', 24, 'calls-auth-token' FROM i
UNION ALL SELECT wid, substr(md5(path || '::Stack.Screen'), 1, 12), 'jsx', '<Stack.Screen />', 22, 'navigation-component' FROM i
UNION ALL SELECT wid, substr(md5(path || '::Row'), 1, 12), 'jsx', '<Row />', 22, '' FROM i"""
_edges("extract_calls", ("call", "jsx"), CALLS, "tags")

MADE = """SELECT DISTINCT id, type, kind, name, file_path, qualified_name FROM (
SELECT 'pkg:@scope' || (k % 7) AS id, 'package' AS type, 'package' AS kind, '@scope' || (k % 7) AS name, '@scope' || (k % 7) AS file_path, '@scope' || (k % 7) || '/lib/sub' AS qualified_name
  FROM i
UNION ALL SELECT 'pkg:lodash' || (k % 5), 'package', 'package', 'lodash' || (k % 5), 'lodash' || (k % 5), 'lodash' || (k % 5) || '/fp' FROM i
UNION ALL SELECT 'ep:' || substr(md5(m || ':' || u), 1, 10), 'endpoint', 'endpoint', m || ' ' || u, 'external', 'API::' || m || ' ' || u FROM (
  SELECT 'POST' AS m, '/api/items/' || (k % 50) AS u FROM i UNION ALL SELECT 'PUT', '/auth/' || (k % 20) FROM i UNION ALL
  SELECT 'GET', '/users/${…}/p' || (k % 9) FROM i
  UNION ALL SELECT 'GET', '/q/' || (k % 11) FROM i UNION ALL SELECT 'POST', '/mu/' || (k % 13) FROM i)
UNION ALL
  SELECT 'route:' || substr(md5(s || (k % 30)), 1, 10), 'screen', 'route', s || (k % 30), 'route-definition', 'Route::' || s || (k % 30)
  FROM i, (VALUES ('Page'), ('Home')) v(s)
UNION ALL SELECT 'storage:token' || (k % 3), 'store', 'storage-key', 'Storage:token' || (k % 3), 'device-storage', 'Storage::token' || (k % 3) FROM i
UNION ALL SELECT 'storage:unknown', 'store', 'storage-key', 'Storage:unknown', 'device-storage', 'Storage::unknown' FROM i
UNION ALL SELECT 'event:' || s || (k % 10), 'service', 'event', 'Event:' || s || (k % 10), 'realtime', 'Event::' || s || (k % 10)
  FROM i, (VALUES ('msg'), ('evt')) v(s)
UNION ALL
  SELECT 'deeplink:app://open/' || (k % 12), 'endpoint', 'deeplink', 'DeepLink:app://open/' || (k % 12), 'external', 'DeepLink::app://open/' || (k % 12)
  FROM i
UNION ALL
  SELECT 'analytics:click' || (k % 15), 'service', 'analytics-event', 'Analytics:click' || (k % 15), 'analytics', 'Analytics::click' || (k % 15)
  FROM i)"""


@register("extract_made_nodes", BASE + MADE)
def extract_made_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes for what edges lead to: packages, endpoints, routes, keys, events, links, analytics."""
    return made_nodes(sources(spark, sf)).select("id", "type", "kind", "name", "file_path", "qualified_name")


# --- files and the store --------------------------------------------------------------------------------------------

HASHES = f"SELECT {expression(PATH)} AS path, sha256({CONTENT}) AS content_hash, CASE WHEN p_partkey % 3 = 2 THEN 'typescript' ELSE 'javascript' END AS language, CAST({N_LINES} AS INTEGER) AS lines_of_code FROM part"


@register("file_relation", HASHES)
def file_relation(spark: SparkSession, sf: str) -> DataFrame:
    return file_rows(sources(spark, sf)).select("path", "content_hash", "language", "lines_of_code")


RULES = discover.Rules(exclude=("*7.tsx", "src/api/**", "/src/st?re/m1*"), include=("m17.tsx",), exclude_dirs=("plain",), exclude_extensions=("jsx",), only_dirs=("src",), max_file_size=1500)
REASONS = f"""SELECT path, CASE WHEN k % 8 = 7 THEN 'directory' WHEN path LIKE '%jsx' THEN 'extension'
WHEN NOT regexp_matches(path, '(^|/)m17\\.tsx(/|$)')
  AND (regexp_matches(path, '(^|/)[^/]*7\\.tsx$') OR path LIKE 'src/api/%' OR regexp_matches(path, '^src/st[^/]re/m1[^/]*(/|$)')) THEN 'rule'
WHEN k > 1500 THEN 'size' END AS reason FROM (SELECT p_partkey AS k, {expression(PATH)} AS path FROM part)"""


@register("discovery_rules", REASONS)
def discovery_rules(spark: SparkSession, sf: str) -> DataFrame:
    return discover.judged(sources(spark, sf).withColumn("size", F.col("p_partkey").cast("long")), RULES).select("path", "reason")


@register("discovery_counts", f"SELECT reason, count(*) AS n FROM ({REASONS}) GROUP BY reason")
def discovery_counts(spark: SparkSession, sf: str) -> DataFrame:
    return discovery_rules(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _reindexed(spark: SparkSession, sf: str) -> Store:
    """A store of four fifths of the files, brought to the state of six sevenths, every eleventh with a line more."""
    files = sources(spark, sf)
    store = Store(spark, shared_folder(spark, "store"))
    store.reindex(files.filter("p_partkey % 5 <> 0").select("path", "content"))
    more = F.when(F.col("p_partkey") % 11 == 0, F.concat("content", F.lit("\nfunction added() { helper() }"))).otherwise(F.col("content"))
    store.reindex(files.filter("p_partkey % 7 <> 0").select("path", more.alias("content")))
    return store


STORED = f"""SELECT path, CASE
  WHEN p_partkey % 11 = 0 THEN sha256(content || chr(10) || 'function added() {{ helper() }}') ELSE sha256(content) END AS content_hash,
CAST({N_LINES} + (p_partkey % 11 = 0)::INTEGER AS INTEGER) AS lines_of_code
  FROM (SELECT p_partkey, {expression(PATH)} AS path, {CONTENT} AS content FROM part) WHERE p_partkey % 7 <> 0"""


@register("store_files", STORED)
def store_files(spark: SparkSession, sf: str) -> DataFrame:
    return _reindexed(spark, sf).table("files").select("path", "content_hash", "lines_of_code")


STORE_EDGES = BASE + """SELECT source, target, kind, line FROM (
SELECT wid AS source, substr(md5(path || '::helper'), 1, 12) AS target, 'call' AS kind, CAST(21 AS INTEGER) AS line, k FROM i
UNION ALL SELECT tid, substr(md5(path || '::inner' || k), 1, 12), 'call', 24, k FROM i UNION ALL
  SELECT tid, substr(md5(path || '::registerForPushToken'), 1, 12), 'call', 24, k FROM i
UNION ALL SELECT substr(md5(path || '::added'), 1, 12), substr(md5(path || '::helper'), 1, 12), 'call', 31, k FROM i WHERE k % 11 = 0)
  WHERE k % 7 <> 0"""


@register("store_calls", STORE_EDGES)
def store_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _reindexed(spark, sf).table("edges").filter("kind = 'call'").select("source", "target", "kind", "line")


STORE_STATS = f"SELECT count(*) FILTER (p_partkey % 7 <> 0) AS files, sum({N_LINES} + (p_partkey % 11 = 0)::INTEGER) FILTER (p_partkey % 7 <> 0)::BIGINT AS lines_of_code FROM part"


@register("store_stats", STORE_STATS)
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    store = _reindexed(spark, sf)
    return metrics.counts(store.graph(), store.table("files")).select("files", "lines_of_code")


# --- functions for SQL ----------------------------------------------------------------------------------------------

FUNCTIONS = f"""SELECT p_partkey, substr(md5(path || '::' || p_name), 1, 12) AS symbol, 'f:' || substr(md5(path), 1, 10) AS file,
  'pkg:' || p_brand AS package, 'ep:' || substr(md5('GET:' || path), 1, 10) AS endpoint,
'route:' || substr(md5(p_name), 1, 10) AS route, p_partkey % 8 = 3 AS in_api, CASE WHEN p_partkey % 2 = 0 THEN 'auth' ELSE 'state-mutation'
  END AS roles
FROM (SELECT *, {expression(PATH)} AS path FROM part)"""


@register("sql_functions", FUNCTIONS)
def sql_functions_query(spark: SparkSession, sf: str) -> DataFrame:
    sql_functions.register(spark)
    spark.read.parquet(f"{sf}/part.parquet").selectExpr("*", f"{expression(PATH)} AS path").createOrReplaceTempView("loomgraph_parts")
    return spark.sql(
        "SELECT p_partkey, symbol_id(path, p_name) AS symbol, file_id(path) AS file, package_id(concat(p_brand, '/x')) AS package, endpoint_id('GET', path) AS endpoint, route_id(p_name) AS route,"
        " glob_matches(path, 'src/api/**') AS in_api, array_join(semantic_roles(CASE WHEN p_partkey % 2 = 0 THEN 'LOGIN' ELSE 'updateAll' END), ',') AS roles "
            "FROM loomgraph_parts"
    )
