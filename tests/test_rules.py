"""A snippet for each extraction rule that the registered queries do not vary, and search with an index."""

from __future__ import annotations

import json

import pytest

from loomgraph.operators import search
from loomgraph.sources.extract import extract


def edges(spark, source, path="a.jsx"):
    g = extract(spark.createDataFrame([(path, source)], "path string, content string"))
    return {(r.kind, r.label): (r.target, json.loads(r.metadata or "{}")) for r in g.edges.collect() if r.kind != "contains"}


def tags(spark, source, path="a.jsx"):
    g = extract(spark.createDataFrame([(path, source)], "path string, content string"))
    return {r.name: set(json.loads(r.metadata or "{}").get("tags") or []) for r in g.nodes.collect()}


def test_api_calls(spark):
    found = edges(spark, "function go() {\n axios.get('/token/1');\n axios.delete(`/o/${a}/order`);\n useQuery('key', '/session');\n useQuery(['k'], '/second');\n useMutation(run);\n fetch(url);\n httpClient.PATCH('/stripe');\n other.get('/no') }")
    assert found["api_call", "axios.get /token/1"][1] == {"type": "axios", "method": "GET", "url": "/token/1", "tags": ["auth-api"]}
    assert found["api_call", "axios.delete /o/${…}/order"][1]["tags"] == ["payment-api"]
    assert ("api_call", "useQuery GET key") in found and found["api_call", "useQuery GET /second"][1]["url"] == "/second"
    assert found["api_call", "useMutation POST"][1]["method"] == "POST" and ("api_call", "fetch GET") in found
    assert found["api_call", "httpClient.PATCH /stripe"][1] == {"type": "apiClient", "method": "PATCH", "url": "/stripe", "tags": ["payment-api"]}
    assert len([k for k in found if k[0] == "api_call"]) == 7


def test_links_contexts_and_tracking(spark):
    found = edges(spark, "function go() {\n useContext(UserContext);\n useContext(theme.ctx);\n Linking.openURL(url);\n Linking.openURL('x://y');\n logEvent('paid');\n ScreenView();\n identify(user) }")
    assert found["uses_context", "useContext(UserContext)"][1]["tags"] == ["auth-context-usage"] and len([k for k in found if k[0] == "uses_context"]) == 1
    assert found["deep_link", "Linking.openURL(...)"][0] == "deeplink:unknown" and found["deep_link", "Linking.openURL(x://y)"][0] == "deeplink:x://y"
    assert found["tracks_event", "logEvent(paid)"][0] == "analytics:paid" and found["tracks_event", "identify(...)"][0] == "analytics:unknown"
    assert ("tracks_event", "ScreenView(...)") in found and ("call", "go → identify") in found and ("call", "go → logEvent") not in found


def test_storage_sockets_and_routes(spark):
    found = edges(spark, "function go() {\n MMKV.multiSet(x);\n securestorage.removeItem('password');\n sessionStorage.clear();\n cache.getItem('k');\n ws.once('a');\n nav.reset('Home');\n nav.goBack();\n realtimeClient.off(x) }")
    assert found["storage_access", "MMKV.multiSet(...)"][1]["action"] == "multi"
    assert found["storage_access", "securestorage.removeItem(password)"][1] == {"type": "storage", "action": "delete", "key": "password", "tags": ["secure-storage"]}
    assert ("storage_access", "sessionStorage.clear(...)") in found and not any("cache" in k[1] for k in found)
    assert ("subscribes_event", "ws.once(a)") in found and ("subscribes_event", "realtimeClient.off(...)") in found
    assert found["navigates_to", "navigate → Home"][1]["action"] == "reset" and len([k for k in found if k[0] == "navigates_to"]) == 1


@pytest.mark.parametrize(
    "name, call, tag",
    [
        ("nav", "useNavigation()", "navigation-consumer"), ("auth", "useSessionToken()", "auth-consumer"), ("state", "useDispatch()", "state-consumer"), ("form", "useFieldArray()", "form-consumer"),
        ("ask", "Camera.requestAsync()", "permission-request"), ("push", "registerForPushNotifications()", "notification-consumer"),
    ],
)
def test_consumers(spark, name, call, tag):
    found = tags(spark, f"const {name}Thing = () => {{ {call} }}\nfunction plain() {{}}")
    assert tag in found[f"{name}Thing"] and not found["plain"]


def test_jsx_tags(spark):
    source = "const App = () => <AuthProvider><ThemeProvider/><NavigationContainer><Tab.Screen name=\"Me\"/></NavigationContainer><ErrorBoundary/><RequireAuth/><div/></AuthProvider>;\n<Top/>"
    found = edges(spark, source)
    assert found["jsx", "<AuthProvider />"][1]["tags"] == ["provides-context", "auth-provider"] and found["jsx", "<ThemeProvider />"][1]["tags"] == ["provides-context"]
    assert found["jsx", "<NavigationContainer />"][1]["tags"] == ["navigation-component"] and ("defines_route", '<Tab.Screen name="Me" />') in found
    assert found["jsx", "<ErrorBoundary />"][1]["tags"] == ["error-boundary"] and found["jsx", "<RequireAuth />"][1]["tags"] == ["auth-guard"]
    assert ("jsx", "<Top />") in found and not any("div" in k[1] for k in found)


def test_initialisers_and_classes(spark):
    found = tags(spark, "const sessionCtx = createContext();\nconst s = createSlice({});\nconst a = configureStore({});\nconst userState = create();\nconst b = create()(set => 1);\nconst c = create();\nconst K = process.env.API_KEY;\nclass ErrorFallback extends Base.Component {}\nclass Plain extends make() {}")
    assert found["sessionCtx"] >= {"context-creator", "auth-context"} and "state-slice" in found["s"] and "state-store" in found["a"] & found["userState"] & found["b"]
    assert "state-store" not in found["c"] and "env-var" in found["K"] and found["ErrorFallback"] >= {"error", "react-component"} and not found["Plain"]


def test_exports_and_modules(spark):
    rows = [("src/x/a.ts", "import { b } from '../y';\nimport c from './c.js';\nimport d from './none';\nexport default Main;\nexport { one as two };"), ("src/y/index.tsx", "export class Shown {}"), ("src/x/c.js", "export const useIt = function () {}")]
    g = extract(spark.createDataFrame(rows, "path string, content string"))
    names = {r.id: r.file_path for r in g.nodes.collect()}
    found = {(names.get(r.source), names.get(r.target)) for r in g.edges.filter("kind = 'import'").collect()}
    assert ("src/x/a.ts", "src/y/index.tsx") in found and not any(t is None for _, t in found)
    types = {r.file_path: r.type for r in g.nodes.filter("kind = 'file'").collect()}
    assert types == {"src/x/a.ts": "file", "src/y/index.tsx": "component", "src/x/c.js": "hook"}


def test_search_folds_accents_and_an_index_gives_the_same(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Café crème", "a::LOGIN"), ("2", "cafe au lait, café", None), ("3", "the the the cafe\u0301", "login"), ("4", "caf", "x"), ("5", None, None)], "id string, name string, qualified_name string")
    columns = ("name", "qualified_name")
    index = search.Index.build(rows, f"file://{tmp_path}/index", columns=columns, buckets=3)
    for q in ("cafe", "CAFÉ", "caf*", '"the the"', "login NOT cafe", "login OR caf", "qualified_name:login", '"au lait" cafe', "nothing", "cafe NOT (creme OR lait)", "n_f%", "((", '"the caf" *'):
        plain = [(r.id, round(r.score, 9)) for r in search.search(rows, q, columns=columns).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.search(rows, q).collect()] == plain
    assert {r.id for r in search.search(rows, "cafe", columns=columns).collect()} == {"1", "2", "3"}
    best = search.search(rows, '"the the"', columns=columns).first()
    assert best.id == "3" and len(index.search(rows, "caf*", limit=1).collect()) == 1
    empty = search.Index.build(rows.limit(0), f"file://{tmp_path}/none", columns=columns)
    assert empty.search(rows.limit(0), "cafe").isEmpty()
