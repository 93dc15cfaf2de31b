"""Registered queries over typed projects: twelve kinds of modules a package, made from the keys of `part`.

Part k is module k % 12 of package k // 12. GG stands for the package, PP for the package before it (or none, every
fourth time), which ends chains of re-exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import sql as sql_functions
from loomgraph.queries import register
from loomgraph.sources.extract import CALL_KINDS, file_edges, project_edges, spread, symbol_nodes

MODULES = {
    "core.ts": """export function baseGG<T extends object>(x: T, y?: Map<string, T[]>): Promise<T> {
  return api.get<T[]>('/base/GG');
}
export const rate: number = 5;
export default class StoreGG<T> extends Model<T> implements Sized, Keyed<{ id: string }> {
  private readonly items = new Map<string, T>();
  [key: string]: any;
  constructor(@Inject(TOKEN) private http: HttpClient) { super(); }
  load(id: string): void;
  load(id: any): void { this.http.get<T>('/no'); }
}
const hidden = <T,>(x: T): T => { log<T>(x); return x; };
export { hidden as shown };""",
    "index.ts": """export * from './core';
export { View as Widget } from './view';
export * as tools from './tools';
import D, { rate as speed } from './core';
export { D as Store, speed };
export type { Props } from './types';
export * from './chain';""",
    "view.tsx": """import { baseGG as b, rate, shown, type Props } from '.';
import type { Item } from './types';
export const View = <P extends Props>({ rate, ...rest }: P & { on?: () => void }): JSX.Element => {
  const [s, setS] = useState<Item | null>(null);
  b<P>(rate); shown(s as Item);
  const { data } = useQuery<Item[], Error>('/view/GG');
  return <Row<Item> key={data!} onPress={() => nav.navigate('PageGG')}><Cell x={s} /></Row>;
};
export const other = () => rate;""",
    "tools.ts": """export const mix = (b: number): number => b;
export * from './index';
export function over(a: string): void;
export function over(a: any) { mix(a!); }""",
    "types.ts": """export interface Props extends Base<Item> { fetch(url: string): void; rate: number }
export type Item<T = any> = { [K in keyof T]: T[K] extends (infer U)[] ? U : never };
export type Loader = typeof import('./core').default;
declare function fetch(url: string): Promise<void>;
declare const API: string;
export enum Kind { A = compute('GG'), B }
export namespace Inner { export function deep() { fetch('/deep/GG'); } }""",
    "app.tsx": """import { Widget, Store, baseGG, tools, missing, linkGG } from './index';
import * as core from './core';
export function App() {
  tools.mix(2);
  core.baseGG(core.rate);
  missing(); new Store<string>();
  linkGG(1);
  return <Widget>
    <tools.Widget />
  </Widget>;
}
export function Main(baseGG: number) { baseGG(1); return <Widget on={App} />; }
export const handlers = [baseGG, core];""",
    "service.ts": """import { rate } from './core';
@Injectable({ providedIn: 'root' })
export abstract class Service {
  @Input() name!: string;
  abstract run(): void;
  send = async <R,>(r: R): Promise<void> => { await api.put<R>('/send'); };
}
export async function post<T>(this: Service, body: T): Promise<T> {
  const res = await http.post<T>('/post/GG', body satisfies object);
  return res as unknown as T;
}
export const retry = <T extends object>(x: T) => axios.post<T>('/retry/GG', { x, rate });""",
    "store.ts": """export const useBox = create<State>()((set) => ({ n: 0, inc: () => set((s: State) => ({ n: s.n + 1 })) }));
export const slice = createSlice<State, any>({});
export const Ctx = createContext<Auth | null>(null);
export function pick(s: State) { store.dispatch<Action>({ type: 'PICK' } as Action); return s; }""",
    "old.ts": """const low = <any>window;
const is = a < b && c > (d);
const pickOne = cond ? (x: number): number => x : low;
for (const k of list as string[]) { go(k!); }
export function cmp(i: number, n: number): boolean { if (i < n && n > (i)) { return check(i); } return i < n; }
let later: (a: string, cb: (e: Error) => void) => Promise<void> = async (a, cb) => { cb(a); };""",
    "plain.jsx": """import tools from './tools';
export const List = ({ items }) => <ul>{items.map((i) => <Entry key={i} />)}</ul>;
const Entry = (p) => <li>{p.a < p.b ? 'x' : "it's"}</li>;
export default function Page() { return <List items={rows} />; }
const rows = [1, 2];""",
    "hooks.tsx": """export function useThing<T>(cb: (x: T) => void): T | undefined {
  const ref = useRef<T>(null), [v, setV] = useReducer<R>(reducer, 0);
  useEffect(() => { const off = bus.on<T>('e', cb); return () => off(); }, []);
  function reducer(s: T) { return v ?? s; }
  return ref.current!;
}
const wrap = async (x: string): Promise<Map<string, Array<T>>> => { return fetch<T>(`/wrap/${x}`, { method: 'put' }); };""",
    "chain.ts": """export * from '../pkgPP/chain';
export const linkGG = (x: number): number => x + 1;""",
}


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): one module a part."""
    k = F.col("p_partkey")
    package = F.floor(k / 12).cast("string")
    before = F.when(F.floor(k / 12) % 4 == 0, "none").otherwise((F.floor(k / 12) - 1).cast("string"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 12 + 1).cast("int"))
    content = F.replace(F.replace(of(MODULES.values()), F.lit("GG"), package), F.lit("PP"), before)
    keys = spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey"), "p_partkey")
    return keys.select(F.concat(F.lit("pkg"), package, F.lit("/"), of(MODULES)).alias("path"), content.alias("content"))


#: What SQL starts from: the files of both ends (m: number of the module), and GG put in.
FILES = f"""WITH RECURSIVE modules(m, file) AS (VALUES {", ".join(f"({n}, '{name}')" for n, name in enumerate(MODULES))}),
f AS MATERIALIZED (SELECT p_partkey // 12 AS g, m, 'pkg' || (p_partkey // 12) || '/' || file AS path FROM part JOIN modules ON m = p_partkey % 12)"""

# (module, kind of node, name, first line, last line, exported, async)
SYMBOLS = """, s(m, kind, name, a, b, exported, is_async) AS (VALUES
  (0, 'function', 'baseGG', 1, 3, true, false), (0, 'variable', 'rate', 4, NULL, true, false), (0, 'class', 'StoreGG', 5, 11, true, false), (0, 'arrow', 'hidden', 12, 12, false, false),
  (2, 'component', 'View', 3, 8, true, false), (2, 'arrow', 'other', 9, 9, true, false), (3, 'arrow', 'mix', 1, 1, true, false), (3, 'function', 'over', 4, 4, true, false),
  (4, 'variable', 'API', 5, NULL, false, false), (4, 'function', 'deep', 7, 7, true, false), (5, 'component', 'App', 3, 11, true, false), (5, 'component', 'Main', 12, 12, true, false),
  (5, 'variable', 'handlers', 13, NULL, true, false), (6, 'class', 'Service', 3, 7, true, false), (6, 'function', 'post', 8, 11, true, true), (6, 'variable', 'res', 9, NULL, false, false),
  (6, 'arrow', 'retry', 12, 12, true, false), (7, 'variable', 'useBox', 1, NULL, true, false), (7, 'variable', 'slice', 2, NULL, true, false), (7, 'variable', 'Ctx', 3, NULL, true, false),
  (7, 'function', 'pick', 4, 4, true, false), (8, 'variable', 'low', 1, NULL, false, false), (8, 'variable', 'is', 2, NULL, false, false), (8, 'variable', 'pickOne', 3, NULL, false, false),
  (8, 'variable', 'k', 4, NULL, false, false), (8, 'function', 'cmp', 5, 5, true, false), (8, 'arrow', 'later', 6, 6, false, true), (9, 'component', 'List', 2, 2, true, false),
  (9, 'component', 'Entry', 3, 3, false, false), (9, 'component', 'Page', 4, 4, true, false), (9, 'variable', 'rows', 5, NULL, false, false), (10, 'hook', 'useThing', 1, 6, true, false),
  (10, 'variable', 'ref', 2, NULL, false, false), (10, 'variable', 'off', 3, NULL, false, false), (10, 'function', 'reducer', 4, 4, false, false), (10, 'arrow', 'wrap', 7, 7, false, true),
  (11, 'arrow', 'linkGG', 2, 2, true, false))
SELECT path AS file_path, kind, replace(name, 'GG', g::VARCHAR) AS name, a::INTEGER AS start_line, b::INTEGER AS end_line, exported AS is_exported, is_async FROM f JOIN s USING (m)"""


@register("typed_symbols", FILES + SYMBOLS)
def typed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbol_nodes(sources(spark, sf)).select("file_path", "kind", "name", "start_line", "end_line", "is_exported", "is_async")


# (module, caller, kind of edge, what its target's id is made of, label, line); the id is md5 of the second with the module's path or alone
EDGES = """, e(m, caller, kind, target, label, line) AS (VALUES
  (0, 'baseGG', 'api_call', 'GET:/base/GG', 'api.get /base/GG', 2), (2, 'View', 'api_call', 'GET:/view/GG', 'useQuery GET /view/GG', 6), (4, 'deep', 'api_call', 'GET:/deep/GG', 'fetch GET /deep/GG', 7),
  (6, 'post', 'api_call', 'POST:/post/GG', 'http.post /post/GG', 9), (6, 'retry', 'api_call', 'POST:/retry/GG', 'axios.post /retry/GG', 12), (10, 'wrap', 'api_call', 'PUT:/wrap/${…}', 'fetch PUT /wrap/${…}', 7),
  (2, 'View', 'navigates_to', 'PageGG', 'navigate → PageGG', 7), (7, 'pick', 'dispatches', 'dispatch:PICK', 'dispatch({type: PICK})', 4),
  (0, 'hidden', 'call', 'log', 'hidden → log', 12), (2, 'View', 'call', 'shown', 'View → shown', 5), (3, 'over', 'call', 'mix', 'over → mix', 4), (5, 'App', 'call', 'missing', 'App → missing', 6),
  (5, 'App', 'call', 'linkGG', 'App → linkGG', 7), (5, 'Main', 'call', 'baseGG', 'Main → baseGG', 12), (8, 'cmp', 'call', 'check', 'cmp → check', 5), (8, 'later', 'call', 'cb', 'later → cb', 6), (10, 'useThing', 'call', 'off', 'useThing → off', 3),
  (2, 'View', 'jsx', 'Row', '<Row />', 7), (2, 'View', 'jsx', 'Cell', '<Cell />', 7), (5, 'App', 'jsx', 'Widget', '<Widget />', 8), (5, 'Main', 'jsx', 'Widget', '<Widget />', 12), (9, 'List', 'jsx', 'Entry', '<Entry />', 2), (9, 'Page', 'jsx', 'List', '<List />', 4)),
put AS (SELECT path, kind, line, replace(caller, 'GG', g::VARCHAR) AS caller, replace(target, 'GG', g::VARCHAR) AS target, replace(label, 'GG', g::VARCHAR) AS label FROM f JOIN e USING (m))
SELECT substr(md5(path || '::' || caller), 1, 12) AS source, CASE kind WHEN 'api_call' THEN 'ep:' || substr(md5(target), 1, 10) WHEN 'navigates_to' THEN 'route:' || substr(md5(target), 1, 10)
  ELSE substr(md5(path || '::' || target), 1, 12) END AS target, kind, label, line::INTEGER AS line FROM put"""


@register("typed_edges", FILES + EDGES)
def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return file_edges(sources(spark, sf), CALL_KINDS).select("source", "target", "kind", "label", "line")


@register("typed_edges_by_sql", FILES + EDGES)
def typed_edges_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same edges, with the files read by a table function from SQL text."""
    sql_functions.register(spark)
    files = sources(spark, sf)
    facts = spark.sql("SELECT * FROM source_facts(TABLE({files}))", files=files)
    return file_edges(files, CALL_KINDS, facts).select("source", "target", "kind", "label", "line")


# own: (module, exported name, name there); passed: (module, exported name, other module, name there); stars: (module, other, package step);
# taken: (module, name, other module, name there). * is a namespace.
CLOSURE = """, own(m, name, there) AS (VALUES (0, 'baseGG', 'baseGG'), (0, 'rate', 'rate'), (0, 'default', 'StoreGG'), (0, 'shown', 'hidden'), (2, 'View', 'View'), (2, 'other', 'other'), (3, 'mix', 'mix'), (3, 'over', 'over'), (11, 'linkGG', 'linkGG')),
passed(m, name, o, there) AS (VALUES (1, 'Widget', 2, 'View'), (1, 'Store', 0, 'default'), (1, 'speed', 0, 'rate')),
stars(m, o, step) AS (VALUES (1, 0, 0), (1, 11, 0), (3, 1, 0), (11, 11, 1)),
taken(m, local, o, there) AS (VALUES (1, 'D', 0, 'default'), (1, 'speed', 0, 'rate'), (2, 'b', 1, 'baseGG'), (2, 'rate', 1, 'rate'), (2, 'shown', 1, 'shown'), (5, 'Widget', 1, 'Widget'), (5, 'Store', 1, 'Store'), (5, 'baseGG', 1, 'baseGG'),
  (5, 'tools', 1, 'tools'), (5, 'missing', 1, 'missing'), (5, 'linkGG', 1, 'linkGG'), (5, 'core', 0, '*'), (6, 'rate', 0, 'rate'), (9, 'tools', 3, 'default')),
links AS (SELECT f.g, f.m, p.name, p.o, replace(p.there, 'GG', f.g::VARCHAR) AS there FROM f JOIN passed p USING (m) JOIN f t ON t.g = f.g AND t.m = p.o),
arms AS (SELECT f.g, f.m, s.o, f.g - step AS og FROM f JOIN stars s USING (m) JOIN f t ON t.g = f.g - step AND t.m = s.o WHERE step = 0 OR f.g % 4 <> 0),
known(g, m, name, og, om, there) AS (
  SELECT g, m, replace(name, 'GG', g::VARCHAR), g, m, replace(there, 'GG', g::VARCHAR) FROM f JOIN own USING (m)
  UNION SELECT f.g, 1, 'tools', f.g, 3, '*' FROM f JOIN f t ON t.g = f.g AND t.m = 3 WHERE f.m = 1
  UNION (SELECT l.g, l.m, l.name, k.og, k.om, k.there FROM known k JOIN links l ON l.g = k.g AND l.o = k.m AND l.there = k.name
    UNION ALL SELECT a.g, a.m, k.name, k.og, k.om, k.there FROM known k JOIN arms a ON a.og = k.g AND a.o = k.m WHERE k.name <> 'default'
      AND NOT EXISTS (SELECT 1 FROM own w WHERE w.m = a.m AND replace(w.name, 'GG', a.g::VARCHAR) = k.name) AND NOT EXISTS (SELECT 1 FROM passed p WHERE p.m = a.m AND p.name = k.name) AND NOT (a.m = 1 AND k.name = 'tools'))),
means AS (SELECT f.g, f.m, replace(t.local, 'GG', f.g::VARCHAR) AS local, k.og, k.om, k.there FROM f JOIN taken t USING (m) JOIN known k ON k.g = f.g AND k.m = t.o AND k.name = replace(t.there, 'GG', f.g::VARCHAR)
  UNION ALL SELECT f.g, f.m, 'core', f.g, 0, '*' FROM f JOIN f o ON o.g = f.g AND o.m = 0 WHERE f.m = 5),
uses AS (SELECT f.g, f.m, f.path, u.what, u.caller, replace(u.local, 'GG', f.g::VARCHAR) AS local, replace(u.member, 'GG', f.g::VARCHAR) AS member, u.line FROM f JOIN u USING (m)),
found AS (SELECT u.*, n.og, n.om, n.there FROM uses u JOIN means n USING (g, m, local) WHERE n.there <> '*' AND member IS NULL
  UNION ALL SELECT u.*, k.og, k.om, k.there FROM uses u JOIN means n USING (g, m, local) JOIN known k ON k.g = n.og AND k.m = n.om AND k.name = u.member WHERE n.there = '*')
"""
# (module, call, jsx or use, the function it stands in or null, name, member of a namespace, line)
ACROSS = """, u(m, what, caller, local, member, line) AS (VALUES (2, 'call', 'View', 'b', NULL, 5), (2, 'call', 'View', 'shown', NULL, 5), (5, 'call', 'App', 'tools', 'mix', 4), (5, 'call', 'App', 'core', 'baseGG', 5),
  (5, 'call', 'App', 'missing', NULL, 6), (5, 'call', 'App', 'linkGG', NULL, 7), (5, 'jsx', 'App', 'Widget', NULL, 8), (5, 'jsx', 'App', 'tools', 'Widget', 9), (5, 'jsx', 'Main', 'Widget', NULL, 12))"""
LED = """SELECT substr(md5(u.path || '::' || caller), 1, 12) AS source, substr(md5(t.path || '::' || there), 1, 12) AS target, what AS kind,
  CASE what WHEN 'call' THEN caller || ' → ' || coalesce(member, local) ELSE '<' || local || coalesce('.' || member, '') || ' />' END AS label, line::INTEGER AS line, t.path AS declared
FROM found u JOIN f t ON t.g = og AND t.m = om"""


@register("calls_across_files", FILES + ACROSS + CLOSURE + LED)
def calls_across_files(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and elements of imported names, led to the declarations."""
    edges = project_edges(sources(spark, sf)).filter("kind <> 'references'")
    return edges.select("source", "target", "kind", "label", "line", F.get_json_object("metadata", "$.declared").alias("declared"))


USED = """, u(m, what, caller, local, member, line) AS (VALUES (1, 'use', NULL, 'D', NULL, 5), (1, 'use', NULL, 'speed', NULL, 5), (2, 'use', 'other', 'rate', NULL, 9), (5, 'use', 'App', 'core', 'rate', 5),
  (5, 'use', 'App', 'Store', NULL, 6), (5, 'use', NULL, 'baseGG', NULL, 13), (6, 'use', 'retry', 'rate', NULL, 12))"""
# (module, caller, what its id is made of, name, line)
OWN_USES = """, here(m, caller, target, label, line) AS (VALUES (0, NULL, 'hidden', 'hidden', 13), (5, 'Main', 'App', 'App', 12), (8, NULL, 'var:low', 'low', 3), (9, 'Page', 'var:rows', 'rows', 4))
SELECT coalesce(substr(md5(path || '::' || caller), 1, 12), 'f:' || substr(md5(path), 1, 10)) AS source, substr(md5(path || '::' || target), 1, 12) AS target, 'references' AS kind, label, line::INTEGER AS line FROM f JOIN here USING (m)
UNION ALL SELECT coalesce(substr(md5(u.path || '::' || caller), 1, 12), 'f:' || substr(md5(u.path), 1, 10)), substr(md5(t.path || '::' || CASE there WHEN 'rate' THEN 'var:rate' ELSE there END), 1, 12), 'references', local, line
FROM found u JOIN f t ON t.g = og AND t.m = om"""


@register("references", FILES + USED + CLOSURE + OWN_USES)
def references(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of declared and imported names, bound by scopes."""
    return project_edges(sources(spark, sf)).filter("kind = 'references'").select("source", "target", "kind", "label", "line")
