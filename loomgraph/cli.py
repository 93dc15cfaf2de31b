"""python -m loomgraph.cli [path]: index a source tree, report on it, trace its workflows, write its document."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import prepare
from loomgraph.operators import community, metrics, structure
from loomgraph.plans import document, trace
from loomgraph.plans.trace_catalog import builtin
from loomgraph.sources import discover
from loomgraph.sources.store import Store, write_document

FOLDER = ".loomgraph"
SAMPLE_TRACES = [
    {"id": "search", "name": "Search", "subFlows": [{"id": "query", "name": "Query", "entryPatterns": ["search"], "exitPatterns": ["results"], "edgeKinds": ["import", "call", "api_call"], "maxDepth": 8}]},
    {"id": "upload", "name": "Upload", "subFlows": [{"id": "file", "name": "File", "entryPatterns": ["upload", "picker"], "exitPatterns": ["success", "error"], "edgeKinds": ["import", "call", "jsx", "api_call"], "maxDepth": 10}]},
]
SAMPLE_IGNORE = "# one glob per line; ! takes back\n*.test.*\n*.stories.*\n/scripts/\n!src/important.test.js\n"
SAMPLE_CONFIG = {"exclude": ["*.min.js"], "include": [], "excludeDirs": ["fixtures"], "excludeExtensions": [".d.ts"], "maxFileSize": discover.MAX_FILE_SIZE, "onlyDirs": []}


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--traces", action="store_true", help="list the workflow traces found")
    p.add_argument("--trace", metavar="ID", help="show one workflow trace")
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--only", action="append", default=[], metavar="GLOB")
    p.add_argument("--only-dirs", action="append", default=[], metavar="DIR")
    p.add_argument("--max-file-size", type=int)
    p.add_argument("--stats-only", action="store_true", help="report counts, write no document")
    for name in ("traces", "ignore", "config"):
        p.add_argument(f"--init-{name}", action="store_true", help=f"write a sample {name} file and stop")
    return p.parse_args(argv)


def scaffold(args: argparse.Namespace, root: str) -> bool:
    """Writes the sample files that are asked for, unless they exist."""
    samples = {discover.TRACES_FILE: (args.init_traces, json.dumps(SAMPLE_TRACES, indent=2)), discover.IGNORE_FILE: (args.init_ignore, SAMPLE_IGNORE), discover.CONFIG_FILE: (args.init_config, json.dumps(SAMPLE_CONFIG, indent=2))}
    for name, (wanted, text) in samples.items():
        path = os.path.join(root, name)
        if wanted and not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        if wanted:
            print(path)
    return any(wanted for wanted, _ in samples.values())


#: Lines that are printed of a sub-flow.
MOST_LINES = 200


def on_shared_disk(spark: SparkSession) -> None:
    """A local project is read and written by this machine alone: on a cluster, executors would use disks of their own."""
    if not spark.sparkContext.master.startswith("local"):
        raise SystemExit("the command line reads a local folder; on a cluster use discover() and Store with a folder that all machines share")


def report(store: Store, seconds: float, states: dict[str, int]) -> None:
    g = store.graph()
    stats = store.stats().first()
    print(f"{stats.files} files, {stats.lines_of_code} lines: {stats.nodes} nodes, {stats.edges} edges in {seconds:.1f} s ({', '.join(f'{n} {s}' for s, n in sorted(states.items())) or 'nothing'})")
    for title, df in (("Node types", metrics.histogram(g.nodes, "type")), ("Edge kinds", metrics.histogram(g.edges, "kind"))):
        print(title + ": " + ", ".join(f"{r[0]} {r[1]}" for r in df.collect()))
    print("Hotspots: " + ", ".join(f"{r.name} ({r.fan_in} in, {r.fan_out} out)" for r in metrics.hotspots(g, 5).collect()))
    cycles, n = structure.cycles(g)
    print(f"Cycles: {n}" + "".join("\n  " + " → ".join(c) for c in cycles) + (f"\n  and {n - len(cycles)} more" if n > len(cycles) else ""))
    print(f"Orphans: {structure.orphans(g).count()}, communities: {community.sizes(g).count()}")


def show_traces(store: Store, root: str, wanted: str | None) -> int:
    traces = trace.merged(builtin(), trace.load_traces(os.path.join(root, discover.TRACES_FILE)))
    if wanted is not None and wanted not in {t.id for t in traces}:
        print(f"no trace {wanted}; there are {', '.join(t.id for t in traces)}", file=sys.stderr)
        return 1
    traces = [t for t in traces if wanted in (None, t.id)]
    found = trace.run(store.graph(), traces)
    for r in found.roll_up(traces).orderBy("trace_id").collect():
        print(f"{r.trace_id}: {r.sub_flows} sub-flows, {r.total_steps} steps, {r.files_touched} files, {r.complete_paths} of {r.path_count} paths complete")
    if wanted is not None:
        for r in found.stats().orderBy("subflow_id").collect():
            print(f"\n{r.subflow_id} ({r.status}): {r.unique_nodes} nodes, {r.api_calls} API calls, {r.store_accesses} store accesses, {r.dispatches} dispatches")
            lines = found.narrative().filter(F.col("subflow_id") == r.subflow_id).orderBy("depth", "node_id").limit(MOST_LINES + 1).collect()
            for line in lines[:MOST_LINES]:
                print("  " * (line.depth + 1) + line.line)
            if len(lines) > MOST_LINES:
                print(f"  … only the first {MOST_LINES} of {r.total_steps} steps are shown")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    root = os.path.abspath(args.path)
    if scaffold(args, root):
        return 0
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    on_shared_disk(spark)
    prepare(spark)
    by = discover.rules(root, args.exclude, args.only, args.only_dirs, args.max_file_size)
    found = discover.discover(spark, f"file://{root}", by)
    if found.isEmpty():
        print("no source files", file=sys.stderr)
        return 1
    began = time.time()
    store = Store(spark, f"file://{root}/{FOLDER}")
    states = store.reindex(found)
    if args.traces or args.trace is not None:
        return show_traces(store, root, args.trace)
    report(store, time.time() - began, states)
    if not args.stats_only:
        traces = trace.merged(builtin(), trace.load_traces(os.path.join(root, discover.TRACES_FILE)))
        rows = [r.asDict(recursive=True) for r in trace.run(store.graph(), traces).roll_up(traces).collect()]
        out = os.path.join(root, FOLDER, "graph.json")
        size = metrics.counts(store.graph()).first()
        if size.nodes + size.edges > document.MOST_ROWS:
            out = os.path.join(root, FOLDER, "graph.jsonl")
            store.export(f"file://{out}")
        else:
            write_document(out, document.build(store.graph(), store.table("files")) | {"traces": rows})
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
