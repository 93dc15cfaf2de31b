"""Source files to graph: facts by a Python pass over each file, everything after that as plans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomgraph.functions import ids, tags

from . import bindings
from .lineage import materialise
from .model import NODES, Graph

#: Longer sources are skipped.
MAX_CHARS = 1_000_000
#: Facts after which a batch leaves the Python worker.
FACTS_A_BATCH = 4096
FACT_COLUMNS = "what name line end_line caller object member exported is_async arg arg_name url method action init super catches env_key names bound imported locals seq".split()
FACTS = (
    "path string, what string, name string, line int, end_line int, caller string, object string, member boolean, exported boolean, is_async boolean, arg string, arg_name string, url string, "
    "method string, action string, init string, super string, catches boolean, env_key string, names array<string>, bound string, imported array<string>, locals array<string>, seq int"
)
# Calls of these names make no call edge.
NO_CALL_EDGE = (
    "require", "fetch", "axios", "console", "Math", "JSON", "Object", "Array", "String", "Number", "Boolean", "Date", "Promise", "React", "process", "window", "document",
    "parseInt", "parseFloat", "isNaN", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "useNavigation", "useAuth", "useSelector", "useDispatch", "useContext", "useForm", "useFormik", "useField", "useQuery", "useMutation", "createContext", "createSlice", "createStore",
    "navigate", "push", "replace", "goBack", "getItem", "setItem", "dispatch", "track", "logEvent", "useCallback", "useMemo", "useEffect", "useRef", "useState", "useReducer",
)
# Calls that navigate.
NAVIGATION = ("navigate", "push", "replace", "reset", "goBack", "pop", "popToTop", "dismiss", "jumpTo", "openDrawer", "closeDrawer", "toggleDrawer")
STORAGE = {"getItem": "read", "setItem": "write", "removeItem": "delete", "multiGet": "multi", "multiSet": "multi", "clear": "multi"}
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")


# What is declared, and the columns that facts of a kind fill and the plans below read.
DECLARED = ("function", "arrow", "variable", "class")
FILLED = {
    **dict.fromkeys(DECLARED, "name line end_line caller exported is_async init super catches env_key"),
    "import": "name line names", "call": "name line caller object member arg arg_name url method action", "jsx": "name line caller object member arg arg_name url method action",
}


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows in few partitions dealt by a key, some partitions for each core: for small rows that texts are made of, before they are."""
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, key)


def read_facts(files: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """Facts of files (path, content). Reading is all processor time, so files in fewer partitions than there are cores are dealt by their paths first; else texts stay where they are.

    wanted: only facts of these kinds (of FILLED), with the columns that they fill.
    """
    wanted = None if wanted is None else frozenset(wanted)
    columns = FACT_COLUMNS if wanted is None else [c for c in FACT_COLUMNS if c in {"what", "seq", *" ".join(FILLED[w] for w in wanted).split()}]
    told_schema = FACTS if wanted is None else ", ".join(f for f in FACTS.split(", ") if f.split()[0] in {"path", *columns})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .jsfacts import facts

        schema = pa.schema([("path", pa.string()), *((c, _ARROW.get(c, pa.string())) for c in columns)])
        paths, found, row = [], [], attrgetter(*columns)

        def told() -> pa.RecordBatch:
            values = [paths, *zip(*map(row, found), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None or len(content) > MAX_CHARS:
                    continue
                new = facts(content, path, wanted)
                paths += [path] * len(new)
                found += new
                if len(found) >= FACTS_A_BATCH:
                    yield told()
                    paths, found = [], []
        if found:
            yield told()

    cores, rows = files.sparkSession.sparkContext.defaultParallelism, files.select("path", "content")
    return (rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, "path")).mapInArrow(read, told_schema)


def fact_reader():  # noqa: ANN201
    """The reader as a table function over rows (path, content); extract() takes its rows as facts."""

    @udtf(returnType=FACTS)
    class SourceFacts:
        def eval(self, row):  # noqa: ANN001, ANN202
            from loomgraph.sources.jsfacts import facts

            if row["path"] is not None and row["content"] is not None and len(row["content"]) <= MAX_CHARS:
                for f in facts(row["content"], row["path"]):
                    yield row["path"], *(getattr(f, c) for c in FACT_COLUMNS)

    return SourceFacts


_ARROW = {c: pa.int32() for c in ("line", "end_line", "seq")} | {c: pa.bool_() for c in ("member", "exported", "is_async", "catches")} | dict.fromkeys(("names", "imported", "locals"), pa.list_(pa.string()))


def resolved_imports(facts: DataFrame, files: DataFrame, what: str = "import") -> DataFrame:
    """Imports (or re-exports) with the path they lead to: the specifier as it is, with an extension, or as a folder's index; null for packages and for nothing found."""
    imports = facts.filter(F.col("what") == what)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    joined = F.when(folder == "", F.col("name")).otherwise(F.concat_ws("/", folder, "name"))
    segments = F.filter(F.split(joined, "/"), lambda s: (s != ".") & (s != ""))
    # folds .. into the segment before it
    flat = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    relative = imports.filter(F.col("name").startswith(".")).select("path", "seq", F.array_join(flat, "/").alias("base"))
    # what each file answers to: its path, that without its extension, and as an index its folder; two rows a file, not one for each ending an import may mean
    path = F.col("path")
    ending = F.regexp_extract("path", f"({'|'.join(e.replace('.', '[.]') for e in EXTENSIONS)})$", 1)
    stem = F.expr("substring(path, 1, char_length(path) - char_length(_ending))")
    place = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("_ending")).cast("int")
    answer = lambda when, place, base: F.when(when, F.struct(place.alias("place"), base.alias("base")))
    answers = F.array(
        F.struct(F.lit(0).alias("place"), path.alias("base")), answer(F.col("_ending") != "", place, stem),
        answer((F.col("_ending") != "") & stem.endswith("/index"), place + len(EXTENSIONS), F.expr("substring(path, 1, char_length(path) - char_length(_ending) - 6)")),
    )
    places = files.select("path").withColumn("_ending", ending).select(path.alias("candidate"), F.explode(F.array_compact(answers)).alias("a")).select("candidate", "a.*")
    hits = relative.join(places, "base").groupBy("path", "seq").agg(F.min(F.struct("place", "candidate")).alias("best"))
    return imports.join(hits.select("path", "seq", F.col("best.candidate").alias("resolved")), ["path", "seq"], "left")


def _metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _tag(condition: Column, tag: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), tag)


def _tags(*columns: Column) -> Column:
    return tags.present(*columns)


def _edge(when: Column, source: Column, target: Column, kind: str, label: Column, metadata: Column) -> tuple[str, Column]:
    """Its kind, and a struct with the edge where it applies and has a source, else null."""
    made = F.struct(
        source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), label.alias("label"), F.col("line"), metadata.alias("metadata")
    )
    return kind, F.when(when & source.isNotNull(), made)


def _like(column: Column, pattern: str) -> Column:
    return column.rlike(f"(?i){pattern}")


def _api_edges(member: Column, plain: Column, caller: Column) -> list[tuple[str, Column]]:
    """Calls of endpoints: fetch, axios, queries and mutations, clients of the project's own."""
    name, url = F.col("name"), F.col("url")
    obj, upper, method = F.coalesce("object", F.lit("")), F.upper("name"), F.coalesce("method", F.lit("GET"))
    query_method = F.when(name == "useQuery", "GET").otherwise("POST")

    def edge(when: Column, kind: Column, method: Column, label: Column, refresh: bool, payment: bool) -> tuple[str, Column]:
        auth = "auth|login|token|session" + ("|refresh" if refresh else "")
        pays = _like(url, "payment|charge|stripe|order") if payment else F.lit(False)
        metadata = _metadata(type=kind, method=method, url=url, tags=_tags(_tag(_like(url, auth), "auth-api"), _tag(pays, "payment-api")))
        return _edge(when, caller, ids.endpoint_id(method, url), "api_call", F.trim(F.concat_ws(" ", label, url)), metadata)

    client = member & _like(obj, "api|client|http") & _like(name, "^(get|post|put|delete|patch)$")
    return [
        edge(plain & (name == "fetch"), F.lit("fetch"), method, F.concat(F.lit("fetch "), method), True, True),
        edge(member & (obj == "axios"), F.lit("axios"), upper, F.concat(F.lit("axios."), F.lower("name")), True, True),
        edge(plain & name.isin("useQuery", "useMutation"), name, query_method, F.concat_ws(" ", "name", query_method), False, False),
        edge(client, F.lit("apiClient"), upper, F.concat_ws(".", "object", "name"), False, True),
    ]


def _keyed_edges(member: Column, plain: Column, caller: Column) -> list[tuple[str, Column]]:
    """Calls that name a route, a storage key, an action, an event, a context, a link or something to track."""
    path, name, key = F.col("path"), F.col("name"), F.col("arg")
    obj, shown = F.coalesce("object", F.lit("")), F.coalesce("arg", F.lit("..."))
    of_object = F.concat(obj, F.lit("."), "name", F.lit("("), shown, F.lit(")"))
    storage_action = F.element_at(F.create_map(*[F.lit(x) for pair in STORAGE.items() for x in pair]), name)
    stored = member & name.isin(list(STORAGE)) & _like(obj, "AsyncStorage|SecureStore|localStorage|sessionStorage|MMKV|storage")
    stored_tags = _tags(
        _tag(_like(key, "token|session|auth|credential"), "auth-storage"), _tag(_like(F.coalesce(key, obj), "secure|encrypted|password"), "secure-storage")
    )
    dispatched = F.coalesce(F.concat(F.lit("dispatch({type: "), "action", F.lit("})")), F.concat(F.lit("dispatch via "), "object"))
    context_tags = _tags(_tag(_like(F.col("arg_name"), "auth|user|session|token"), "auth-context-usage"))
    tracks = _like(name, "^(track|logEvent|identify|screenView|pageView|reportAnalytics)$")
    one = lambda tag: F.array(F.lit(tag))

    def event(kind: str, names: list[str]) -> tuple[str, Column]:
        when = member & name.isin(names) & _like(obj, "socket|ws|connection|io|realtime")
        return _edge(when, caller, ids.keyed_id("event", key), kind, of_object, _metadata(eventName=key, action=name, tags=one("realtime")))

    return [
        _edge(
            member & name.isin(list(NAVIGATION)) & key.isNotNull(), caller, ids.route_id(key), "navigates_to",
            F.concat(F.lit("navigate → "), key), _metadata(action=name, screenName=key, tags=one("navigation")),
        ),
        _edge(stored, caller, ids.keyed_id("storage", key), "storage_access", of_object, _metadata(type=F.lit("storage"), action=storage_action, key=key, tags=stored_tags)),
        _edge(
            member & (name == "dispatch") & F.col("object").isNotNull(), caller, ids.dispatch_id(path, F.coalesce("action", "object")), "dispatches",
            dispatched, _metadata(actionType=F.col("action"), tags=one("state-mutation")),
        ),
        event("emits_event", ["emit"]),
        event("subscribes_event", ["on", "off", "once"]),
        _edge(
            plain & (name == "useContext") & F.col("arg_name").isNotNull(), caller, ids.symbol_id(path, F.col("arg_name")), "uses_context",
            F.concat(F.lit("useContext("), "arg_name", F.lit(")")), _metadata(contextName=F.col("arg_name"), tags=context_tags),
        ),
        _edge(
            member & (obj == "Linking") & (name == "openURL"), caller, ids.keyed_id("deeplink", key), "deep_link",
            F.concat(F.lit("Linking.openURL("), shown, F.lit(")")), _metadata(url=key, tags=one("deep-link")),
        ),
        _edge(
            plain & tracks, caller, ids.keyed_id("analytics", key), "tracks_event",
            F.concat("name", F.lit("("), shown, F.lit(")")), _metadata(eventName=key, tags=one("analytics")),
        ),
    ]


def _jsx_edges(caller: Column) -> list[tuple[str, Column]]:
    """Elements, shown by the function they stand in or else by the file, and the routes that screens define."""
    path, name, key = F.col("path"), F.col("name"), F.col("arg")
    parent, jsx = F.coalesce(caller, ids.file_id(path)), F.col("what") == "jsx"
    provider = name.rlike("Provider$")
    found = _tags(
        _tag(provider, "provides-context"),
        _tag(provider & _like(name, "auth|user|session|token"), "auth-provider"),
        _tag(name.rlike("NavigationContainer|Stack|Tab|Drawer"), "navigation-component"),
        _tag(_like(name, "errorboundary|errorfallback"), "error-boundary"),
        _tag(_like(name, "protectedroute|authguard|privateroute|requireauth|authenticatedroute"), "auth-guard"),
    )
    route = F.concat(F.lit("<"), "name", F.lit(' name="'), key, F.lit('" />'))
    return [
        _edge(jsx & name.rlike("Screen$") & key.isNotNull(), parent, ids.route_id(key), "defines_route", route, _metadata(screenName=key, tags=F.array(F.lit("navigation")))),
        _edge(jsx, parent, ids.symbol_id(path, name), "jsx", F.concat(F.lit("<"), "name", F.lit(" />")), _metadata(tags=found)),
    ]


def _call_edges(facts: DataFrame, kinds: frozenset[str] | None = None) -> DataFrame:
    """Edges of calls and JSX (of the kinds, by default all): each fact lists the edges it makes, and they are exploded once."""
    path, name, call = F.col("path"), F.col("name"), F.col("what") == "call"
    member, plain = call & F.col("member"), call & ~F.col("member")
    facts = facts.filter("what IN ('call', 'jsx')").withColumn("_caller", F.when(F.col("caller").isNotNull(), ids.symbol_id(path, F.col("caller"))))  # once a fact
    caller = F.col("_caller")
    known = ~name.isin(list(NO_CALL_EDGE)) & ~name.startswith("_") & (F.char_length("name") > 1)
    called = tags.roles(name, "calls-")
    edges = [
        *_api_edges(member, plain, caller),
        *_keyed_edges(member, plain, caller),
        _edge(plain & known, caller, ids.symbol_id(path, name), "call", F.concat("caller", F.lit(" → "), "name"), _metadata(tags=called)),
        *_jsx_edges(caller),
    ]
    made = F.array(*[e for kind, e in edges if kinds is None or kind in kinds])
    return _exploded(facts, made, "path", "seq").select("path", "seq", "e.*")


def _exploded(rows: DataFrame, values: Column, *keep: str) -> DataFrame:
    """(keep, e): a row for each value of an array that is not null.

    The array is made in a step of its own: a generator would run it as a tree of expressions, and a plain explode would have the optimizer make it
    twice, once to see whether it is empty. The step must not be compiled with those around it either, as all would be one method, too long for the
    JVM to compile; an expression with a lambda (the last of keep as it is) keeps it apart, and its parts become methods of their own.
    """
    apart = F.element_at(F.transform(F.array(keep[-1]), lambda x: x), 1).alias(keep[-1])
    return rows.select(*keep[:-1], apart, values.alias("e")).select(*keep, F.explode_outer("e").alias("e")).filter("e IS NOT NULL")


def _consumer_tags(facts: DataFrame) -> DataFrame:
    """(path, name, tags) that calls give the function they stand in."""
    c, plain = F.col, ~F.col("member")
    like = lambda pattern: c("name").rlike(f"(?i){pattern}")
    own = F.array(
        _tag(plain & (c("name") == "useNavigation"), "navigation-consumer"),
        _tag(plain & like("^use(Auth|IsAuth|Session|Token|Credential|Login|Logout|User|Permission|Role)"), "auth-consumer"),
        _tag(plain & c("name").isin("useSelector", "useDispatch"), "state-consumer"),
        _tag(plain & like("^(useForm|useFormik|useField|useController|useFieldArray)$"), "form-consumer"),
        _tag(c("member") & like("^(request|check|ask|authorize)"), "permission-request"),
        _tag(plain & like("registerForPush|requestNotification|usePushNotification"), "notification-consumer"),
        _tag(plain & (c("name") == "createContext"), "context-creator"),
    )
    rows = _exploded(facts.filter("what = 'call' AND caller IS NOT NULL"), own, "path", "caller").select("path", F.col("caller").alias("name"), "e")
    return rows.groupBy("path", "name").agg(F.sort_array(F.collect_set("e")).alias("consumer_tags"))


def _declared(facts: DataFrame, last: bool = False) -> DataFrame:
    """Nodes of functions, variables and classes; last: of same-named ones of a file the last, found before anything is made of them."""
    c = F.col
    what, name = c("what"), c("name")
    like = lambda pattern: name.rlike(f"(?i){pattern}")
    variable, cls = what == "variable", what == "class"
    hook, capital = name.rlike("^use[A-Z]"), name.rlike("^[A-Z]")
    type_ = F.when(variable, "variable").when(cls, "class").when(capital, "component").when(hook, "hook").otherwise("function")
    kind = F.when((type_ == "function") & (what == "arrow"), "arrow").otherwise(type_)
    slice_ = F.coalesce("init", F.lit(""))
    called = F.coalesce("consumer_tags", F.array().cast("array<string>"))
    own = F.array_distinct(
        F.concat(
            tags.present(_tag(cls & like("errorboundary|errorfallback"), "error"), _tag(cls & F.lower("super").rlike("errorboundary|component"), "react-component")),
            tags.roles(name),
            tags.present(
                _tag(variable & (slice_ == "createContext"), "context-creator"), _tag(variable & (slice_ == "createContext") & like("auth|user|session|token"), "auth-context"),
                _tag(variable & (slice_ == "createSlice"), "state-slice"),
                _tag(variable & (slice_.isin("createStore", "configureStore", "create()") | ((slice_ == "create") & like("store|slice|state"))), "state-store"),
                _tag(c("env_key").isNotNull(), "env-var"), _tag(cls & c("catches"), "error"),
            ),
            # only functions that are values count as makers of a context
            F.when(what == "arrow", called).otherwise(F.array_remove(called, "context-creator")),
            tags.present(_tag((what == "arrow") & F.array_contains(called, "context-creator") & name.contains("Context"), "auth-context")),
        )
    )
    rows = facts.filter(what.isin(*DECLARED))
    if last:
        same = Window.partitionBy("path", "name", variable).orderBy(F.desc("seq"))
        rows = rows.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    rows = rows.join(_consumer_tags(facts), ["path", "name"], "left")
    node = rows.select(
        F.when(variable, ids.variable_id(c("path"), name)).otherwise(ids.symbol_id(c("path"), name)).alias("id"), type_.alias("type"), "name", c("path").alias("file_path"),
        F.concat_ws("::", "path", "name").alias("qualified_name"), kind.alias("kind"), c("line").alias("start_line"), "end_line", F.lit("public").alias("visibility"), c("exported").alias("is_exported"),
        F.coalesce("is_async", F.lit(False)).alias("is_async"), F.lit(False).alias("is_static"), F.lit(None).cast("string").alias("signature"), _metadata(tags=own, envKey=c("env_key")).alias("metadata"), "seq", c("super").alias("_super"),
    )
    return node


# What edges of a kind lead to: node type and kind, what stands before names and qualified names, and the path
MADE = {
    "external": ("package", "package", "", "", None),
    "api_call": ("endpoint", "endpoint", "", "API::", "external"),
    "navigates_to": ("screen", "route", "", "Route::", "route-definition"),
    "defines_route": ("screen", "route", "", "Route::", "route-definition"),
    "storage_access": ("store", "storage-key", "Storage:", "Storage::", "device-storage"),
    "emits_event": ("service", "event", "Event:", "Event::", "realtime"),
    "subscribes_event": ("service", "event", "Event:", "Event::", "realtime"),
    "deep_link": ("endpoint", "deeplink", "DeepLink:", "DeepLink::", "external"),
    "tracks_event": ("service", "analytics-event", "Analytics:", "Analytics::", "analytics"),
}
#: Kinds of nodes that no file declares.
MADE_KINDS = tuple(dict.fromkeys(v[1] for v in MADE.values()))


def one_made_node(rows: DataFrame, *by: str) -> DataFrame:
    """Of several descriptions (column n) of a made-up node, the smallest: what all files together make does not depend on their order."""
    return rows.groupBy("id", *by).agg(F.min("n").alias("n"))


def _synthetic(edges: DataFrame, *by: str) -> DataFrame:
    """Nodes for packages, endpoints, routes, keys, events, links and analytics that edges lead to; by: for each value of more columns."""
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for kind, v in MADE.items() for x in (kind, v[k])]), F.col("kind"))
    parsed = F.from_json("metadata", "method string, url string, screenName string, package string")
    key = F.regexp_replace("target", "^[a-z]+:", "")
    call = F.concat_ws(" ", parsed["method"], parsed["url"])
    what = F.when(F.col("kind") == "api_call", call).when(F.col("kind").isin("navigates_to", "defines_route"), F.coalesce(parsed["screenName"], "target")).otherwise(key)
    name = F.concat(pick(2), what)
    qualified = F.when(F.col("kind") == "external", F.coalesce(parsed["package"], key)).otherwise(F.concat(pick(3), what))
    made = F.struct(pick(0).alias("type"), pick(1).alias("kind"), name.alias("name"), F.coalesce(pick(4), key).alias("path"), qualified.alias("qualified"), F.when(F.col("kind") != "external", F.col("metadata")).alias("metadata"))
    described = edges.filter(F.col("kind").isin(list(MADE))).select(F.col("target").alias("id"), *by, made.alias("n"))
    rows = one_made_node(described if by else described.distinct(), *by)  # few are told apart by all files together, and the smallest is found by sorting
    none, no = F.lit(None), F.lit(False)
    return rows.select(
        "id", *by, "n.type", "n.name", F.col("n.path").alias("file_path"), F.col("n.qualified").alias("qualified_name"), "n.kind", none.cast("int").alias("start_line"), none.cast("int").alias("end_line"),
        F.lit("public").alias("visibility"), no.alias("is_exported"), no.alias("is_async"), no.alias("is_static"), none.cast("string").alias("signature"), "n.metadata",
    )


def extract(files: DataFrame, resolve: bool = False, synthetic: bool = True, references: bool = False, owned: bool = False, facts: DataFrame | None = None) -> Graph:
    """The graph of source files (path relative to the root, content).

    facts: what the table function source_facts gives of the files, if SQL has read them already. owned: nodes and edges have a column owner, the file that they come from; a made-up node has a row for each.

    Calls, JSX and context lead to symbols of the same file; with resolve, calls and JSX of imported names lead to
    where these are declared, over re-exports and namespaces. With references, other uses of names that a file declares or
    imports are edges too. Same-named symbols of a file are one node, the last. Edges are unique
    by source, target, kind and line; the last stays. Sources are read once: their facts are written, and all else follows from that table.
    """
    files = _readable(files)
    facts = materialise(read_facts(files, None if resolve or references else (*DECLARED, "import", "call", "jsx")) if facts is None else facts)
    calls = _call_edges(facts).withColumnRenamed("path", "file_path")
    imports = resolved_imports(facts, files)
    if resolve or references:
        uses = materialise(resolved_uses(facts, files, imports, _declared(facts)))
    if resolve:
        across = bindings.resolved_edges(uses)
        calls = calls.join(across.select("file_path", "seq", "kind"), ["file_path", "seq", "kind"], "left_anti").unionByName(across)
    if references:
        calls = calls.unionByName(bindings.reference_edges(facts, uses))
    edges = _declaring_edges(facts).unionByName(_import_edges(imports)).unionByName(calls)
    owner = ["owner"] if owned else []
    edges = _unique(edges.withColumnRenamed("file_path", "owner"), *owner)
    columns = [*NODES.fieldNames(), *owner]
    nodes = _file_nodes(facts, files).withColumn("owner", F.col("file_path")).select(columns).unionByName(_declared(facts, last=True).withColumn("owner", F.col("file_path")).select(columns))
    if synthetic:
        edges = materialise(edges)  # for the edges themselves and for the nodes that they make
        nodes = nodes.unionByName(_synthetic(edges, *owner).select(columns))
    return Graph(nodes, edges)


def _readable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("content").isNotNull() & (F.char_length("content") <= MAX_CHARS))


def _file_nodes(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of files; what a text tells is taken from it before it meets what the file exports, so texts are not moved."""
    path = F.col("path")
    exported = facts.filter(F.col("what").isin(*DECLARED) & F.col("exported")).groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("exports"))
    read = files.select("path", F.size(F.split("content", "\n")).alias("end_line"), tags.found(F.col("content"), tags.FILE_TEXT).alias("found"))
    base = read.join(exported, "path", "left").withColumn("exports", F.coalesce("exports", F.array().cast("array<string>")))
    return base.select(
        ids.file_id(path).alias("id"), tags.file_type(path, F.col("exports")).alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), path.alias("file_path"), path.alias("qualified_name"), F.lit("file").alias("kind"),
        F.lit(1).alias("start_line"), "end_line", F.lit("public").alias("visibility"), F.lit(False).alias("is_exported"), F.lit(False).alias("is_async"), F.lit(False).alias("is_static"), F.lit(None).cast("string").alias("signature"),
        _metadata(ext=F.regexp_extract("path", r"(\.[^./]+)$", 1), language=language(path), tags=F.col("found")).alias("metadata"),
    )


def _declaring_edges(facts: DataFrame) -> DataFrame:
    """contains and extends edges."""
    variable, none = F.col("what") == "variable", F.lit(None).cast("string")
    own = F.when(variable, ids.variable_id(F.col("path"), F.col("name"))).otherwise(ids.symbol_id(F.col("path"), F.col("name")))
    rows = facts.filter(F.col("what").isin(*DECLARED)).select(F.col("path").alias("file_path"), "seq", own.alias("id"), "line", F.col("super").alias("_super"))
    contains = F.struct(ids.file_id(F.col("file_path")).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), none.alias("label"), F.col("line"), none.alias("metadata"))
    extends = F.struct(F.col("id").alias("source"), F.col("_super").alias("target"), F.lit("extends").alias("kind"), F.col("_super").alias("label"), F.col("line"), _metadata(unresolved=F.lit(True)).alias("metadata"))
    return _exploded(rows, F.array(contains, F.when(F.col("_super").isNotNull(), extends)), "file_path", "seq").select("file_path", "seq", "e.*")


def _import_edges(imports: DataFrame) -> DataFrame:
    """import and external edges of resolved_imports."""
    package = ~F.col("name").startswith(".")
    return imports.filter(package | F.col("resolved").isNotNull()).select(
        F.col("path").alias("file_path"), "seq", ids.file_id(F.col("path")).alias("source"), F.when(package, ids.package_id(F.col("name"))).otherwise(ids.file_id(F.col("resolved"))).alias("target"),
        F.when(package, "external").otherwise("import").alias("kind"), F.array_join("names", ", ").alias("label"), "line", _metadata(package=F.when(package, F.col("name")), tags=tags.found(F.col("name"), tags.IMPORTS)).alias("metadata"),
    )


def _unique(edges: DataFrame, *more: str) -> DataFrame:
    """Edges unique by source, target, kind and line; the last stays."""
    last = Window.partitionBy("source", "target", "kind", "line").orderBy(F.desc("seq"))
    return edges.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("source", "target", "kind", "label", "line", "metadata", *more)


#: Kinds of edges that calls and elements make.
CALL_KINDS = ("api_call", "navigates_to", "storage_access", "dispatches", "emits_event", "subscribes_event", "uses_context", "deep_link", "tracks_event", "call", "defines_route", "jsx")


def file_edges(files: DataFrame, kinds: Iterable[str], facts: DataFrame | None = None) -> DataFrame:
    """The edges of extract(files) of some kinds, where nothing else is asked: only the facts that make them are read and written, and only these edges are made."""
    files, kinds = _readable(files), frozenset(kinds)
    sides = ((("contains", "extends"), DECLARED), (("import", "external"), ("import",)), (CALL_KINDS, ("call", "jsx")))
    if facts is None:
        facts = read_facts(files, [w for of, whats in sides if kinds & set(of) for w in whats])
    facts = materialise(facts)
    parts = []
    if kinds & {"contains", "extends"}:
        parts.append(_declaring_edges(facts))
    if kinds & {"import", "external"}:
        parts.append(_import_edges(resolved_imports(facts, files)))
    if kinds & set(CALL_KINDS):
        parts.append(_call_edges(facts, kinds).withColumnRenamed("path", "file_path"))
    return _unique(reduce(DataFrame.unionByName, parts).filter(F.col("kind").isin(list(kinds))))


def file_nodes(files: DataFrame) -> DataFrame:
    """The nodes of extract(files) that stand for files."""
    files = _readable(files)
    return _file_nodes(materialise(read_facts(files, DECLARED)), files)


def symbol_nodes(files: DataFrame) -> DataFrame:
    """The nodes of extract(files) that files declare."""
    return _declared(materialise(read_facts(_readable(files), (*DECLARED, "call"))), last=True).select(NODES.fieldNames())


def environment(files: DataFrame) -> DataFrame:
    """(name, file_path, env_key) of the variables among symbol_nodes(files) that hold a key of the environment: only variables are read for it, and nothing is joined or written."""
    variables = read_facts(_readable(files), ("variable",))
    last = variables.groupBy("path", "name").agg(F.max(F.struct("seq", "env_key"))["env_key"].alias("env_key"))
    return last.filter("env_key IS NOT NULL").select("name", F.col("path").alias("file_path"), "env_key")


def made_nodes(files: DataFrame) -> DataFrame:
    """The nodes of extract(files) that no file declares."""
    return _synthetic(file_edges(files, MADE)).select(NODES.fieldNames())


def resolved_uses(facts: DataFrame, files: DataFrame, imports: DataFrame, declared: DataFrame) -> DataFrame:
    """What the imported names that files use mean; see bindings."""
    symbols = declared.select("file_path", "name", "id", (F.col("kind") == "variable").alias("is_variable"))
    return bindings.resolved_uses(facts, imports, resolved_imports(facts, files, "reexport"), symbols)


def project_edges(files: DataFrame) -> DataFrame:
    """Edges (source, target, kind, label, line, metadata) that lead to declarations anywhere in the project: call, jsx, references."""
    files = _readable(files)
    facts = materialise(read_facts(files))
    uses = materialise(resolved_uses(facts, files, resolved_imports(facts, files), _declared(facts)))
    edges = bindings.resolved_edges(uses).unionByName(bindings.reference_edges(facts, uses))
    unique = Window.partitionBy("source", "target", "kind", "line").orderBy(F.desc("seq"))
    return edges.withColumn("_n", F.row_number().over(unique)).filter("_n = 1").select("source", "target", "kind", "label", "line", "metadata")


def language(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.tsx?$"), "typescript").otherwise("javascript")


def file_rows(files: DataFrame) -> DataFrame:
    """The files relation of (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"), language(F.col("path")).alias("language"), F.size(F.split("content", "\n")).alias("lines_of_code"), F.current_timestamp().alias("indexed_at"))
